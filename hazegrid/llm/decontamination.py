"""Benchmark decontamination by latent semantic retrieval.

Documents are read as blocks of words; two neighbouring blocks are a passage, so that every run of words as long as a
benchmark item lies in one. TF-IDF over the terms of the benchmark is reduced by a distributed randomised SVD, items
and passages are compared by their cosine in the latent space. What the cosine can miss (frequent words without weight,
items outside the leading directions) comes in by an exact rule on shared words that loses no pair. Each candidate is
then judged by its longest common subsequence of words with the item and by whether the item's answer is there as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import in_groups, small_batches
from hazegrid.session import materialize

#: Words of a block at least; doubled until it holds the item, so that items of like length share their passages.
BLOCK_WORDS = 64
#: Latent dimensions and columns of the random sketch.
RANK, SKETCH = 112, 128
#: Terms in a greater share of the blocks carry no weight in the latent space.
MOST_DF = 0.05
#: The items are rows of the decomposed matrix too; together they weigh as much as so many times all passages.
ITEMS_WEIGHT = 3.0
COSINE = 0.5
#: Shares of an item's words, and of its answer's words, that the passage must have in order.
LCS_SHARE, ANSWER_SHARE = 0.8, 0.5
#: The benchmark is held by every task; a larger one is to be checked in parts.
MOST_ITEMS = 20_000
#: Blocks whose rows are worked on at once.
NEAR = 512
#: Cells of a table of passages and terms, and pairs of passages and items, that the exact rule holds at once.
MOST_CELLS, MOST_PAIRS = 1 << 24, 1 << 20
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE = re.compile(r"[.!?]\s+")


def words_of(text: str | None) -> list[str]:
    """Words in lower case without signs at their ends; what has no letter or digit is no word."""
    return [w for w in (_EDGE.sub("", x) for x in (text or "").lower().split()) if w]


def answer_of(text: str | None) -> list[str]:
    """Words of the last sentence, or the last eight if the item is one sentence or the last has fewer than three."""
    parts = [p for p in _SENTENCE.split((text or "").strip()) if words_of(p)]
    last = words_of(parts[-1]) if parts else []
    return last if len(parts) > 1 and len(last) >= 3 else words_of(text)[-8:]


@dataclass
class Benchmark:
    ids: list
    terms: dict[str, int]
    words: list[list[int]]
    answers: list[list[int]]

    def by_block(self) -> list[tuple[int, np.ndarray]]:
        """(words of a block, items that are read by it)."""
        size = np.array([BLOCK_WORDS << max(0, (-(-len(w) // BLOCK_WORDS) - 1).bit_length()) for w in self.words])
        return [(int(s), np.flatnonzero(size == s)) for s in np.unique(size)]


def read_benchmark(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Benchmark:
    """Items that have words; a null, empty or repeated row adds nothing."""
    got = items.select(items[id_col].alias("id"), items[text_col].alias("text")).distinct().limit(MOST_ITEMS + 1).collect()
    if len(got) > MOST_ITEMS:
        raise ValueError(f"the benchmark has more than {MOST_ITEMS} items: check it in parts and unite the results")
    rows = [(r["id"], words_of(r["text"]), answer_of(r["text"])) for r in sorted(got, key=lambda r: (str(r["id"]), r["text"] or "")) if r["id"] is not None]
    rows = [r for r in rows if r[1]]
    terms: dict[str, int] = {}
    number = lambda ws: [terms.setdefault(w, len(terms)) for w in ws]
    return Benchmark([r[0] for r in rows], terms, [number(r[1]) for r in rows], [number(r[2]) for r in rows])


def _numbered(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """``doc, ids``: every word of a text as the number of its benchmark term, -1 for others."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, cache = shared.value, {}

        class Lookup(dict):
            def __missing__(self, raw: str) -> int:
                w = _EDGE.sub("", raw)
                n = self[raw] = known.get(w, -1) if w else -2
                return n

        cache = Lookup()
        for pdf in batches:
            if len(cache) > 500_000:
                cache.clear()
            out = []
            for text in pdf["text"]:
                raw = (text or "").lower().split()
                ids = np.fromiter(map(cache.__getitem__, raw), np.int32, len(raw))
                out.append(ids[ids > -2].tobytes())
            yield pd.DataFrame({"doc": pdf["doc"], "ids": out})

    return docs.mapInPandas(run, f"doc {docs.schema['doc'].dataType.simpleString()}, ids binary")


@dataclass
class Blocks:
    """Entries (block, term, times) of a batch, in order of the blocks; ``first`` has the first block of each text."""

    block: np.ndarray
    term: np.ndarray
    times: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @property
    def total(self) -> int:
        return int(self.count.sum())

    def where(self, kept: np.ndarray) -> Blocks:
        return Blocks(self.block[kept], self.term[kept], self.times[kept], self.first, self.count)

    def passages(self) -> np.ndarray:
        """First block of each passage: block and successor of one text, or the only block of a text."""
        starts = np.ones(self.total, bool)
        starts[(self.first + self.count - 1)[self.count > 1]] = False
        return np.flatnonzero(starts)


def _blocks(ids: list[bytes], size: int, n_terms: int, weight: np.ndarray | None = None) -> tuple[Blocks, list[np.ndarray]]:
    """Blocks of some texts, only with terms that have weight if it is given, and the texts as numbers."""
    texts = [np.frombuffer(x, np.int32) for x in ids]
    count = np.array([max(1, -(-len(t) // size)) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
    length = np.array([len(t) for t in texts])
    at = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(length)])[:-1], length)
    block = np.repeat(first, length) + at // size
    known = flat >= 0 if weight is None else np.append(weight, 0)[flat] > 0
    key, times = np.unique(block[known] * n_terms + flat[known], return_counts=True)
    return Blocks(key // n_terms, key % n_terms, times, first, count), texts


def _over_blocks(numbered: DataFrame, size: int, n_terms: int, width: int, weight: np.ndarray, basis: np.ndarray, second) -> np.ndarray:
    """Sum over all passages of a matrix with ``width`` columns to which ``second(blocks, weight, latent, sum)`` adds.

    ``latent`` has the weighted terms of each passage times ``basis``. Each task adds up its own, Spark adds the rows.
    """
    shared = numbered.sparkSession.sparkContext.broadcast((weight.astype(np.float32), basis.astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = shared.value
        total: np.ndarray | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            blocks, _ = _blocks(list(pdf["ids"]), size, n_terms, w)
            if total is None:
                total = np.zeros((max(n_terms, width), width))
            second(blocks, w, _latent(blocks, w, b), total)
        if total is not None:
            rows = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pd.DataFrame({"row": rows, "cells": [total[r].astype(np.float32).tobytes() for r in rows]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf["row"].to_numpy()
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        cells = np.frombuffer(b"".join(pdf["cells"]), np.float32).reshape(-1, width).astype(np.float64)
        return pd.DataFrame({"row": row[starts], "cells": [c.tobytes() for c in np.add.reduceat(cells, starts)]})

    out = np.zeros((max(n_terms, width), width))
    for r in in_groups(numbered.select("ids").mapInPandas(run, "row long, cells binary"), ["row"], add, "row long, cells binary").collect():
        out[r["row"]] = np.frombuffer(r["cells"], np.float64)
    return out


def _latent(blocks: Blocks, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows of the passages that start at each block (the last block of a longer text is a zero row)."""
    block, term, value = blocks.block, blocks.term, (blocks.times * weight[blocks.term]).astype(np.float32)
    own = np.zeros((blocks.total + 1, basis.shape[1]), np.float32)
    if len(block):
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for lo in range(0, len(starts), NEAR):  # what stays in the processor's cache
            s = starts[lo : lo + NEAR]
            end = starts[lo + NEAR] if lo + NEAR < len(starts) else len(block)
            own[block[s]] = np.add.reduceat(basis[term[s[0] : end]] * value[s[0] : end, None], s - s[0])
    out = own[:-1] + own[1:]
    last = blocks.first + blocks.count - 1
    out[last] = np.where((blocks.count == 1)[:, None], own[last], 0)
    return out


def _by_term(blocks: Blocks, weight: np.ndarray, latent: np.ndarray, out: np.ndarray) -> None:
    """Add the transposed TF-IDF matrix times the rows of the passages, each passage scaled to unit length."""
    own = np.bincount(blocks.block, (blocks.times * weight[blocks.term]) ** 2, blocks.total)
    last = blocks.first + blocks.count - 1
    norm = own + np.append(own[1:], 0)
    norm[last] = own[last]
    scaled = latent / np.maximum(norm, 1e-6)[:, None].astype(np.float32)
    around = scaled.copy()
    around[1:] += scaled[:-1]  # a block is in the passage that it starts and in the one before
    around[blocks.first[1:]] -= scaled[blocks.first[1:] - 1]
    order = np.argsort(blocks.term, kind="stable")
    term, block = blocks.term[order], blocks.block[order]
    value = (blocks.times[order] * weight[term]).astype(np.float32)[:, None]
    for lo in range(0, len(term), 16 * NEAR):
        t = term[lo : lo + 16 * NEAR]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        out[t[starts]] += np.add.reduceat(around[block[lo : lo + 16 * NEAR]] * value[lo : lo + 16 * NEAR], starts)


def latent_space(numbered: DataFrame, bench: Benchmark, rank: int = RANK, sketch: int = SKETCH, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idf weight per term, right singular vectors) of the TF-IDF matrix ``A`` of all passages and the items, and df.

    Randomised SVD in Nystroem's form: one distributed pass gives ``G = A'(A Omega)``; with ``Omega'G = L L'`` the left
    singular vectors of ``G inv(L')`` are the right singular vectors of ``A``. Only matrices of terms by ``sketch``
    reach the driver.
    """
    size, n_terms = BLOCK_WORDS, len(bench.terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(n_terms, np.int64), 0
        for pdf in batches:
            if len(pdf):
                blocks, _ = _blocks(list(pdf["ids"]), size, n_terms)
                total += np.bincount(blocks.term, minlength=n_terms)
                n += blocks.total
        terms = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.append(terms, -1), "n": np.append(total[terms], n)})

    df, n = np.zeros(n_terms), 1
    for r in numbered.select("ids").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            n = max(1, r["n"])
        else:
            df[r["term"]] = r["n"]
    weight = np.where(df <= np.maximum(2, MOST_DF * n), np.log((1 + n) / (1 + np.minimum(df, n))), 0.0)
    sketch = min(sketch, n_terms)
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, sketch)))[0]
    g = _over_blocks(numbered, size, n_terms, sketch, weight, omega, _by_term)[:n_terms]
    items = np.zeros((len(bench.ids), n_terms), np.float32)
    for i, ws in enumerate(bench.words):
        np.add.at(items[i], ws, weight[ws])
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-9)
    g += ITEMS_WEIGHT * n / len(bench.ids) * (items.T @ (items @ omega))
    shift = 1e-7 * max(np.linalg.norm(g), 1e-12)
    g += shift * omega
    square = omega.T @ g
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, shift * 1e-3))
    left, _, _ = np.linalg.svd(g @ root, full_matrices=False)
    return weight, left[:, : min(rank, sketch)], df


class Sharing:
    """Exact candidates: every passage whose common subsequence with an item can be long enough.

    At most ``n - need`` of an item's ``n`` words may be absent from a passage, so one of any ``n - need + 1`` is there.
    The rarest ones are looked up; what they bring must then have ``need`` of all words, in any order.
    """

    def __init__(self, words: list[list[int]], df: np.ndarray):
        self.length = np.array([len(w) for w in words], np.int64)
        self.need = np.ceil(LCS_SHARE * self.length).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.flat = np.concatenate([np.asarray(w, np.int64) for w in words])
        pairs = [(t, i) for i, w in enumerate(words) for t in set(sorted(w, key=lambda t: (df[t], t))[: len(w) - int(self.need[i]) + 1])]
        term, self.item = np.array(sorted(pairs), np.int64).T
        self.bound = np.searchsorted(term, np.arange(len(df) + 1))

    def candidates(self, blocks: Blocks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first block of the passage, item), each pair once; ``blocks`` has all terms."""
        n_terms, n_items = len(self.bound) - 1, len(self.length)
        starts = np.zeros(blocks.total + 1, bool)
        starts[blocks.passages()] = True
        # a block's terms are in the passage that it starts and in the one before
        later = np.ones(blocks.total, bool)
        later[blocks.first] = False
        step = max(1, MOST_CELLS // n_terms)
        for lo in range(0, blocks.total, step):
            hi = min(blocks.total, lo + step)
            a, b = np.searchsorted(blocks.block, [lo, min(blocks.total, hi + 1)])
            block, term = blocks.block[a:b], blocks.term[a:b]
            own = (block < hi) & starts[block]
            prev = (block > lo) & later[block]
            passage, term = np.r_[block[own], block[prev] - 1], np.r_[term[own], term[prev]]
            has = np.zeros((hi - lo, n_terms), bool)
            has[passage - lo, term] = True
            order = np.argsort(passage, kind="stable")
            passage, term = passage[order], term[order]
            times = self.bound[term + 1] - self.bound[term]
            passage, term, times = passage[times > 0], term[times > 0], times[times > 0]
            # cut between passages, so that each pair comes up once
            ends = np.cumsum(times)
            at = 0
            while at < len(passage):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS)))
                to = int(np.searchsorted(passage, passage[to - 1], "right"))
                t = times[at:to]
                within = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                key = np.unique(np.repeat(passage[at:to], t) * n_items + self.item[np.repeat(self.bound[term[at:to]], t) + within])
                at = to
                for k in np.array_split(key, -(-len(key) * 64 // MOST_PAIRS)):
                    p, item = k // n_items, k % n_items
                    n = self.length[item]
                    first = np.cumsum(n) - n
                    word = self.flat[np.repeat(self.start[item], n) + np.arange(n.sum()) - np.repeat(first, n)]
                    shared = np.add.reduceat(has[np.repeat(p - lo, n), word], first, dtype=np.int64)
                    enough = shared >= self.need[item]
                    yield p[enough], item[enough]


def common_subsequence(masks: dict[int, int], length: int, words) -> int:
    """Length of the longest common subsequence, bit-parallel: ``masks`` has the places of each word of the item."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE) -> DataFrame:
    """``id_col, item_id, lcs_words, item_words, lcs_share, answer_share``: which documents hold which items.

    A pair is returned once, with its best passage. An item without words is never found, and a null or empty text
    holds none; repeated rows of a document give one row; a row with a null id is reported with a null id. Only the
    named columns are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bench = read_benchmark(items, item_id, item_text)
    kinds = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, lcs_words int, item_words int, answer_share double"
    if not bench.ids:
        return spark.createDataFrame([], kinds).withColumn("lcs_share", F.lit(0.0))
    n_terms = len(bench.terms)
    numbered = materialize(_numbered(docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")), bench.terms), "terms")
    weight, basis, df = latent_space(numbered, bench)
    queries = np.zeros((len(bench.ids), basis.shape[1]), np.float32)
    for i, ws in enumerate(bench.words):
        queries[i] = (weight[ws, None] * basis[ws]).sum(axis=0)
    norm = np.linalg.norm(queries, axis=1)
    queries /= np.maximum(norm, 1e-12)[:, None]
    classes = [(size, items, queries[items], Sharing([bench.words[i] for i in items], df)) for size, items in bench.by_block()]
    shared = spark.sparkContext.broadcast((bench.words, bench.answers, weight.astype(np.float32), basis.astype(np.float32), classes, bench.ids))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, answers, w, b, by_block, ids = shared.value
        in_words, in_answers = [_places(x) for x in words], [_places(x) for x in answers]
        for pdf in batches:
            if not len(pdf):
                continue
            found: dict[tuple[int, int], tuple[int, float]] = {}
            for size, members, q, sharing in by_block:
                blocks, texts = _blocks(list(pdf["ids"]), size, n_terms)
                latent = _latent(blocks.where(w[blocks.term] > 0), w, b)
                owner = np.repeat(np.arange(len(texts)), blocks.count)
                starts = blocks.passages()

                def near(latent=latent, starts=starts, q=q) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                    for lo in range(0, len(starts), 8192):
                        p = starts[lo : lo + 8192]
                        x = latent[p]
                        size_of = np.linalg.norm(x, axis=1, keepdims=True)
                        row, item = np.nonzero((x @ q.T >= cosine * np.maximum(size_of, 1e-12)) & (size_of > 1e-9))
                        yield p[row], item

                both = [first * len(members) + item for way in (near(), sharing.candidates(blocks)) for first, item in way]
                for key in np.unique(np.concatenate([np.zeros(0, np.int64), *both])).tolist():
                    first, item = divmod(key, len(members))
                    doc, item = int(owner[first]), int(members[item])
                    at = int(first - blocks.first[doc]) * size
                    passage = texts[doc][at : at + 2 * size].tolist()
                    n = len(words[item])
                    lcs = common_subsequence(in_words[item], n, passage)
                    if lcs < LCS_SHARE * n:
                        continue
                    share = common_subsequence(in_answers[item], len(answers[item]), passage) / len(answers[item])
                    if share >= ANSWER_SHARE:
                        found[doc, item] = max(found.get((doc, item), (0, 0.0)), (lcs, share))
            doc_ids = pdf["doc"].tolist()
            yield pd.DataFrame([(doc_ids[d], ids[i], lcs, len(words[i]), share) for (d, i), (lcs, share) in found.items()], columns=[id_col, item_id, "lcs_words", "item_words", "answer_share"])

    best = F.max(F.struct("lcs_words", "item_words", "answer_share")).alias("best")
    found = numbered.mapInPandas(search, kinds).groupBy(id_col, item_id).agg(best)
    return found.select(
        id_col, item_id, "best.lcs_words", "best.item_words", F.round(F.col("best.lcs_words") / F.col("best.item_words"), 6).alias("lcs_share"), F.round("best.answer_share", 6).alias("answer_share")
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text holds no item, with all their columns; rows with a null id stay.

    Each row is judged by its own text: an id with several texts loses those that hold an item.
    """
    key = F.md5(docs[text_col])
    texts = docs.select(key.alias("doc"), docs[text_col].alias("text")).where(docs[id_col].isNotNull() & key.isNotNull())
    found = contaminated(texts, items, "doc", "text").select(F.col("doc").alias("found_key")).distinct()
    return docs.join(found, docs[id_col].isNotNull() & (key == found["found_key"]), "left_anti")
