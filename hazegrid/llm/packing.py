"""Packing of tokenised documents into sequences of fixed capacity.

A packing depends on the lengths of the pieces only, so it is planned from how many pieces of each length there are (at
most ``capacity`` numbers): dominance reduction fixes bins that some optimal packing holds, best fit places the rest.
The plan says, for each length, which piece in its count goes where. Pieces get their numbers inside a length from
counts per task, so no length is ever gathered in one place.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.llm import dominance
from hazegrid.llm.common import small_batches
from hazegrid.llm.word_cache import encoder
from hazegrid.session import materialize

CAPACITY = 1024
#: What :func:`pack` can return of a piece's ids: the ids, or their unsigned CRC as little-endian 32-bit numbers.
OUTPUTS = {"ids": "array<int>", "ids_crc32": "long"}


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences after a first piece that takes the odd rest."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    starts = range(first, length, capacity)
    return ([(0, first)] if first else []) + [(s, capacity) for s in starts]


def _tokenised(docs: DataFrame, tokenizer: bytes, end_id: int, capacity: int, id_col: str, text_col: str, outputs: Sequence[str]) -> DataFrame:
    """One row per piece; ``task`` and ``nth`` number the pieces of one length."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # a few megabytes
    name = hashlib.sha256(tokenizer).hexdigest()
    kinds = {c: OUTPUTS[c] for c in outputs}
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, task int, nth long" + "".join(f", {c} {k}" for c, k in kinds.items())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, task = encoder(name, shared.value), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for pdf in batches:
            rows = []
            for i, ids in zip(pdf["id"], bpe.encode_all([t or "" for t in pdf["text"]]), strict=True):
                ids += end
                for k, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    values = {"ids_crc32": zlib.crc32(part)} if "ids_crc32" in kinds else {}
                    if "ids" in kinds:
                        values["ids"] = np.frombuffer(part, "<u4").astype(np.int32)
                    rows.append((i, k, start, n, task, seen[n], *[values[c] for c in kinds]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "task", "nth", *kinds]).astype({"id": pdf["id"].dtype})

    ids = docs[id_col]
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        # nulls among whole numbers would come as floats
        source = docs.select(ids.cast("string").alias("id"), docs[text_col].alias("text"))
        out = source.mapInPandas(run, schema.replace(f"id {docs.schema[id_col].dataType.simpleString()}", "id string", 1))
        return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
    return docs.select(ids.alias("id"), docs[text_col].alias("text")).mapInPandas(run, schema)


def placements(patterns: Sequence[dominance.Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, sequence, copies, offset): pieces ``low..high-1`` of a length fill a row of sequences."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for times, sizes in patterns:
        offset = 0
        for size in sorted(set(sizes), reverse=True):
            copies = sizes.count(size)
            out.append((size, used[size], used[size] + times * copies, sequence, copies, offset))
            used[size] += times * copies
            offset += copies * size
        sequence += times
    return out


def pack(
    docs: DataFrame, tokenizer: bytes, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", outputs: Sequence[str] = ("ids",)
) -> DataFrame:
    """``id_col, piece, start, length, sequence_id, offset`` and the chosen outputs, a row for each piece.

    A document is the ids of its text and ``end_id``; a null or empty text is ``end_id`` alone. Only documents of more
    than ``capacity`` tokens are cut. Repeated rows are documents of their own, a null id stays null, an empty table
    has no pieces, and only the named columns are read. Sequences are numbered from 0 and filled without gaps.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # stored: the plan and the placed pieces must see the same numbers
    found = materialize(_tokenised(docs, tokenizer, end_id, capacity, id_col, text_col, outputs), "pieces")
    counts = found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows = placements(dominance.pack(lengths, capacity))
    slots = spark.createDataFrame(pd.DataFrame(rows, columns=["length", "low", "high", "sequence", "copies", "first"]).astype("int64") if rows else [], "length long, low long, high long, sequence long, copies long, first long")
    plan = slots.groupBy("length").agg(F.collect_list(F.struct("low", "high", "sequence", "copies", "first")).alias("slots"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = found.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    # the plan is bounded by the capacity, whatever the input
    placed = numbered.join(F.broadcast(plan), "length")
    mine = F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    placed = placed.withColumn("slot", mine).withColumn("k", F.col("rank") - F.col("slot.low"))
    copies = F.col("slot.copies")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", *outputs,
        (F.col("slot.sequence") + F.floor(F.col("k") / copies)).alias("sequence_id"), (F.col("slot.first") + F.col("k") % copies * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of whole sequences, from the rows of :func:`pack` with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
