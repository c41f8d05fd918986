"""Quality rules and line labelling: a linear-chain CRF marks every line of a text as content or boilerplate.

The base figures are counted exactly over whole texts. The CRF has one weight per line feature and label and one per
pair of neighbouring labels; Viterbi decoding gives the best label sequence, and the share of words in content lines
decides whether a document stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import per_batch, small_batches

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

BOILERPLATE, CONTENT = 0, 1
#: Bound of the labelled sample that the CRF is fitted on.
FIT_ROWS = 3000

_WHITE, _SYMBOL, _UPPER, _LOWER_, _DIGIT, _STOP = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    """Bits of each character of the basic plane; the last entry stands for all characters beyond it."""
    table = np.zeros(0x10001, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        table[c] = _UPPER * ch.isupper() | _LOWER_ * ch.islower() | _DIGIT * ch.isdigit()
    table[[0x20, 9, 10, 11, 12, 13]] |= _WHITE
    table[[ord(c) for c in SYMBOLS]] |= _SYMBOL
    table[[ord(c) for c in ".?!,;:"]] |= _STOP
    return table


_TABLE: list[np.ndarray] = []
#: Features of a line: one weight per bin; the names only say what is binned.
_BINS = {
    "words": [2, 4, 8, 16, 32],
    "symbols_per_word": [0.05, 0.2, 0.5, 0.9],
    "upper_share": [0.02, 0.1, 0.3, 0.7],
    "digit_share": [0.02, 0.1, 0.3],
    "other_sign_share": [0.02, 0.06, 0.15],
    "mean_word": [3.0, 5.0, 7.0, 10.0],
    "ends_with_stop": [0.5],
    "again": [0.5],
}
_OFFSETS = np.concatenate([[0], np.cumsum([len(b) + 1 for b in _BINS.values()])])
N_FEATURES = int(_OFFSETS[-1])


@dataclass
class Lines:
    """The lines with a word of one text: their feature ids and words, and the base figures of the text."""

    features: np.ndarray
    words: np.ndarray
    base: tuple[int, int, int, int, int]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    suspects = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    # equal hashes are compared word by word
    rows = np.ascontiguousarray(ids[suspects[:, None] + np.arange(window)])
    _, group, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = suspects[times[group.ravel()] > 1]
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def describe(text: str) -> Lines:
    """Base figures ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and line features of a text."""
    if not _TABLE:
        _TABLE.append(_classes())
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # white space of bytes is the ASCII white space of the contract
    if not words:
        return Lines(np.zeros((0, len(_BINS)), np.int64), np.zeros(0, np.int64), (0, 0, 0, 0, 0))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = _TABLE[0][np.minimum(code, 0x10000)]
    white = (bits & _WHITE) > 0
    begins = ~white
    begins[1:] &= white[:-1]
    breaks = np.flatnonzero(code == 10)
    first = np.concatenate([[0], breaks + 1])
    # one column of counts per line; a line break counts for the line that it ends
    first_in = np.minimum(first, len(code) - 1)

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[np.concatenate([breaks, [len(code)]])] - total[first]

    n_words, chars = per_line(begins), per_line(~white)
    symbols = per_line((bits & _SYMBOL) > 0)
    letters, upper = per_line((bits & (_UPPER | _LOWER_)) > 0), per_line((bits & _UPPER) > 0)
    digits = per_line((bits & _DIGIT) > 0)
    stops = per_line((bits & _STOP) > 0)
    seen: set[str] = set()
    has_word = n_words > 0
    again = np.zeros(len(first_in), bool)
    for i, line in enumerate(text.split("\n")):
        if has_word[i]:
            again[i] = line in seen
            seen.add(line)
    ends = np.concatenate([breaks, [len(code)]])
    last = np.zeros(len(first), bool)
    # the last character of a line that is no white space
    at = np.maximum.accumulate(np.where(white, -1, np.arange(len(code))))
    ok = has_word & (ends > 0)
    last[ok] = (bits[at[ends[ok] - 1]] & _STOP) > 0
    base = (len(words), int(chars.sum()), int(symbols.sum()), int(again.sum()), repeated_words(words))
    k = has_word
    w, c = np.maximum(n_words[k], 1), np.maximum(chars[k], 1)
    values = [w, symbols[k] / w, upper[k] / np.maximum(letters[k], 1), digits[k] / c, (c - letters[k] - digits[k] - stops[k] - symbols[k]) / c, c / w, last[k], again[k]]
    ids = np.stack([np.searchsorted(b, np.asarray(v, dtype=np.float64), "right") + o for v, b, o in zip(values, _BINS.values(), _OFFSETS, strict=False)], axis=1)
    return Lines(ids, n_words[k], base)


@dataclass
class Crf:
    emit: np.ndarray  # (features, 2)
    step: np.ndarray  # (2, 2): from, to

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: the best label of every line."""
        score = self.emit[features].sum(axis=1).tolist()
        (aa, ab), (ba, bb) = self.step.tolist()
        a, b = score[0]
        back = []
        for x, y in score[1:]:
            from_a, from_b = (a + aa >= b + ba), (a + ab >= b + bb)
            back.append((from_a, from_b))
            a, b = (a + aa if from_a else b + ba) + x, (a + ab if from_b else b + bb) + y
        label = BOILERPLATE if a > b else CONTENT
        out = [label]
        for from_a, from_b in reversed(back):
            label = BOILERPLATE if (from_a if label == BOILERPLATE else from_b) else CONTENT
            out.append(label)
        return np.array(out[::-1])


def fit_crf(sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int = 80, rate: float = 0.2, l2: float = 1e-4) -> Crf:
    """Maximum likelihood by Adam; forward-backward runs over all sequences at once, longest first."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sequences, labels = [sequences[i] for i in order], [labels[i] for i in order]
    size = np.array([len(s) for s in sequences])
    n, longest = len(size), int(size.max())
    feats = np.zeros((longest, n, len(_BINS)), np.int64)
    gold = np.zeros((longest, n), np.int64)
    for i, (s, y) in enumerate(zip(sequences, labels, strict=True)):
        feats[: len(s), i], gold[: len(s), i] = s, y
    live = [int((size > t).sum()) for t in range(longest)]
    total = size.sum()
    emit, step = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    m = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(step), np.zeros_like(step)]
    for it in range(1, epochs + 1):
        score = emit[feats].sum(axis=2)
        alpha, beta = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        alpha[0] = score[0]
        for t in range(1, longest):
            k = live[t]
            alpha[t, :k] = np.logaddexp(alpha[t - 1, :k, :1] + step[0], alpha[t - 1, :k, 1:] + step[1]) + score[t, :k]
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            after = score[t + 1, :k] + beta[t + 1, :k]
            beta[t, :k] = np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1])
        z = np.logaddexp(*alpha[size - 1, np.arange(n)].T)
        ge, gs = -l2 * emit, -l2 * step
        for t in range(longest):
            k = live[t]
            p = np.exp(alpha[t, :k] + beta[t, :k] - z[:k, None])
            diff = -p
            diff[np.arange(k), gold[t, :k]] += 1
            for f in range(len(_BINS)):
                for y in (0, 1):
                    ge[:, y] += np.bincount(feats[t, :k, f], diff[:, y], N_FEATURES) / total
            if t:
                pair = np.exp(alpha[t - 1, :k, :, None] + step[None] + (score[t, :k] + beta[t, :k])[:, None, :] - z[:k, None, None])
                gs -= pair.sum(axis=0) / total
                np.add.at(gs, (gold[t - 1, :k], gold[t, :k]), 1 / total)
        for x, g, a, b in ((emit, ge, m[0], m[1]), (step, gs, m[2], m[3])):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += rate * (a / (1 - 0.9**it)) / (np.sqrt(b / (1 - 0.99**it)) + 1e-8)
    return Crf(emit, step)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> Crf | None:
    """CRF from at most ``max_rows`` rated documents (by the order of a hash of the id); None without ratings.

    Lines of documents of bad quality, and repeated lines of any document, count as boilerplate, the others as
    content.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    joined = docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(sample), "doc_id").select("quality", "text")

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [describe(t).features for t in pdf["text"]]
        return pd.DataFrame({"quality": pdf["quality"], "ids": [f.ravel() for f in found]})

    got = joined.mapInPandas(per_batch(lines), "quality int, ids array<int>").toPandas()
    pairs = [(np.asarray(x, dtype=np.int64).reshape(-1, len(_BINS)), q) for x, q in zip(got["ids"], got["quality"], strict=True) if len(x)]
    if not pairs:
        return None
    again = int(_OFFSETS[-1]) - 1  # the upper bin of the last feature
    gold = [np.where((f[:, -1] == again) | (q < 1), BOILERPLATE, CONTENT) for f, q in pairs]
    return fit_crf([f for f, _ in pairs], gold)


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, content_words long"


def judge(docs: DataFrame, model: Crf | None, least_share: float = 0.5) -> DataFrame:
    """All rows and columns with the base figures, ``content_share``, ``base_failed`` and ``kept``.

    ``content_share`` is the share of words in lines that the CRF marks as content; null where there is no word or
    no model. ``kept`` is false where a base rule fails, else true if the share reaches ``least_share`` (or there is
    no model). A null or empty text has no words and so fails. Each row is judged by itself; columns that carry the
    names of the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen weights

    @F.pandas_udf(_SCHEMA)
    def figures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for texts in batches:
            rows = []
            for t in texts:
                d = describe(t or "")
                good = int(d.words[crf.decode(d.features) == CONTENT].sum()) if crf is not None and len(d.words) else 0
                rows.append((*d.base, len(d.words), good))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")], dtype=np.int64)

    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in new]
    seen = docs.select(*[docs[c] for c in keep], figures(docs["text"]).alias("_f"))
    failed = (F.col("_f.n_words") < LEAST_WORDS) | (100 * F.col("_f.n_repeat_words") > MOST_REPEATED_PERCENT * F.col("_f.n_words"))
    share = F.when((F.col("_f.n_words") > 0) & F.lit(model is not None), F.col("_f.content_words") / F.col("_f.n_words"))
    return seen.select(
        *keep, *[F.col(f"_f.{c}").alias(c) for c in new[:5]], share.alias("content_share"), failed.alias("base_failed"),
        (~failed & F.coalesce(share >= least_share, F.lit(True))).alias("kept"),
    )
