"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of one Arrow batch for whole texts: with texts of 3 KB some 1.5 MB, with texts of 1 MB half a GB.
TEXT_BATCH = 512


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Keep the Arrow batches of whole texts small in this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> bytes:
    """A vocabulary file, read where the plan is made: its bytes go to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, _UPPER, _LOWER)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many marks before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def per_batch(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``mapInPandas`` body that skips empty batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield fn(pdf)

    return run


def in_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 20_000) -> DataFrame:
    """``fn`` over frames of whole groups, sorted by ``keys``, of about ``rows`` rows or one group if that is larger.

    Unlike ``applyInPandas`` it takes many small groups in one call; callers keep single groups bounded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            size += len(pdf)
            if size < rows:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole[keys].iloc[-1]
            # the last group may go on in the next batch
            open_ = np.logical_and.reduce([(whole[k] == last[k]).to_numpy() for k in keys])
            cut = int(np.argmax(open_))
            if cut:
                yield fn(whole.iloc[:cut].reset_index(drop=True))
            held, size = [whole.iloc[cut:]], len(whole) - cut
        if size:
            yield fn(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
