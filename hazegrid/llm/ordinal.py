"""Quality classifier: cumulative-link regression on graded ratings over hashed words.

A rating counts the good marks of a document: one for its quality, one for not being toxic, so the grades are 0, 1
and 2. All grades share one weight per hashed
word; ordered thresholds cut the score into grades, ``P(grade <= k) = sigmoid(threshold_k - score)``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import per_batch, small_batches

_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Bound of the labelled sample that the model is fitted on (rows by the order of a hash of the id).
FIT_ROWS = 8000
BITS = 18


def features(text: str, cache: dict[str, int], bits: int = BITS) -> np.ndarray:
    """Sorted hashed ids of what occurs in the text: words, runs of signs, and a few shapes of the whole."""
    found = Counter(_TOKEN.findall(text))
    tokens, n = set(found), found.total()
    if n:
        signs = sum(times for t, times in found.items() if not (t[0].isalnum() or t[0] == "_"))
        capitals = sum(times for t, times in found.items() if t.isupper() and len(t) > 1)
        lines = [x for x in text.split("\n") if x]
        tokens = {t.lower() for t in tokens}
        tokens.add(f"\x00signs{min(9, 10 * signs // n)}")
        tokens.add(f"\x00capitals{min(9, 10 * capitals // n)}")
        tokens.add(f"\x00again{min(9, 10 * (len(lines) - len(set(lines))) // max(1, len(lines)))}")
        tokens.add(f"\x00length{min(16, n.bit_length())}")
    mask, out = (1 << bits) - 1, []
    for t in tokens:
        h = cache.get(t)
        if h is None:
            if len(cache) > 500_000:
                cache.clear()
            h = cache[t] = zlib.crc32(t.encode("utf-8", "surrogatepass")) & mask
        out.append(h)
    return np.unique(np.array(out, dtype=np.int32))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """One row per score, one column per grade."""
        below = 1 / (1 + np.exp(-(self.thresholds[None, :] - score[:, None])))
        edges = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        return np.diff(edges, axis=1)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, bits: int = BITS, min_rows: int = 5, least_chi2: float = 16.0, l2: float = 1e-5, epochs: int = 300, rate: float = 0.1) -> OrdinalModel:
    """Penalised maximum likelihood by Adam on the whole sample.

    A weight is fitted for hashed words of at least ``min_rows`` rows whose occurrence depends on the grade (chi
    squared of ``least_chi2`` or more); the other words weigh nothing, so that chance does not.
    """
    size, n = 1 << bits, len(rows)
    col = np.concatenate(rows) if n else np.zeros(0, np.int32)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    used, col = np.unique(col, return_inverse=True)
    by_grade = np.stack([np.bincount(col, grades[row] == g, len(used)) for g in range(n_grades)], axis=1)
    total, of_grade = by_grade.sum(axis=1), np.bincount(grades, minlength=n_grades) / max(1, n)
    expected = np.maximum(total[:, None] * of_grade[None, :], 1e-9)
    often = (total >= min_rows) & (((by_grade - expected) ** 2 / expected).sum(axis=1) >= least_chi2)
    row, col = row[often[col]], col[often[col]]
    share = np.clip(np.array([(grades <= k).mean() for k in range(n_grades - 1)]), 0.005, 0.995)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 0.05 * np.arange(n_grades - 1))
    w = np.zeros(len(used))
    # the first threshold and the logarithms of the gaps, so that the order always holds
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    moments = [np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(t)), np.zeros(len(t))]
    for step in range(1, epochs + 1):
        gaps = np.exp(t[1:])
        cut = np.concatenate([[-np.inf], t[0] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, w[col], n)
        with np.errstate(over="ignore"):
            low, high = 1 / (1 + np.exp(-(cut[grades] - score))), 1 / (1 + np.exp(-(cut[grades + 1] - score)))
        p = np.maximum(high - low, 1e-9)
        by_score = (low + high - 1) / n
        at_high, at_low = high * (1 - high) / p / n, low * (1 - low) / p / n
        by_cut = np.bincount(grades, at_high, n_grades)[:-1] - np.bincount(grades, at_low, n_grades)[1:]
        gw = np.bincount(col, by_score[row], len(used)) - l2 * w
        gt = np.concatenate([[by_cut.sum()], [by_cut[k:].sum() * gaps[k - 1] for k in range(1, len(t))]])
        for x, g, m, v in ((w, gw, moments[0], moments[1]), (t, gt, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    dense = np.zeros(size, np.float32)
    dense[used] = np.where(often, w, 0)
    return OrdinalModel(dense, np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))]), bits)


def grades_of(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of the fully labelled rows, the lowest grade where a document has several."""
    grade = F.when(F.col("quality") > 0, 1).otherwise(0) + F.when(F.col("toxic") > 0, 0).otherwise(1)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS, bits: int = BITS) -> OrdinalModel | None:
    """Model from at most ``max_rows`` labelled documents; None if no document is labelled."""
    small_batches(docs.sparkSession)
    sample = grades_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # the sample has a fixed bound, so the texts stay where they are
    joined = docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(sample), "doc_id").select("grade", "text")

    def hashed(pdf: pd.DataFrame) -> pd.DataFrame:
        cache: dict[str, int] = {}
        return pd.DataFrame({"grade": pdf["grade"], "ids": [features(t, cache, bits) for t in pdf["text"]]})

    got = joined.mapInPandas(per_batch(hashed), "grade int, ids array<int>").toPandas()
    if not len(got):
        return None
    return fit([np.asarray(x, dtype=np.int32) for x in got["ids"]], got["grade"].to_numpy(np.int64), bits=bits)


def score(docs: DataFrame, model: OrdinalModel | None, keep_tail: float = 0.4) -> DataFrame:
    """All rows and columns with ``expected_grade``, ``tail_probability`` (of the best grade) and ``kept``.

    ``kept`` is true where the tail probability reaches ``keep_tail``. A null or empty text gets 0, 0 and false.
    Without a model (no labels) the two figures are null and every row with a text is kept. Works row by row, so
    repeated rows and null ids need no care; columns of the three names are replaced.
    """
    small_batches(docs.sparkSession)
    keep = [docs[c] for c in docs.columns if c not in ("expected_grade", "tail_probability", "kept")]
    has_text = F.coalesce(F.length("text") > 0, F.lit(False))
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select(*keep, nothing.alias("expected_grade"), nothing.alias("tail_probability"), has_text.alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes x 2**bits

    @F.pandas_udf("expected_grade double, tail_probability double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, cache = shared.value, {}
        for texts in batches:
            s = np.array([float(m.weights[features(t, cache, m.bits)].sum()) if t else 0.0 for t in texts], dtype=np.float64)
            p = m.probabilities(s) * np.array([bool(t) for t in texts])[:, None]
            yield pd.DataFrame({"expected_grade": p @ np.arange(p.shape[1]), "tail_probability": p[:, -1]})

    rated = docs.select(*keep, rate(docs["text"]).alias("_rated"))
    grade, tail = F.round("_rated.expected_grade", 6), F.round("_rated.tail_probability", 6)
    return rated.select(*[c for c in rated.columns if c != "_rated"], grade.alias("expected_grade"), tail.alias("tail_probability"), (tail >= keep_tail).alias("kept"))
