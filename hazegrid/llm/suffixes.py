"""Removal of long repeated byte strings by suffix sorting.

A string of ``length`` bytes is repeated if it starts at another place too, in any document. Sorting all suffixes
would move the corpus many times over, so suffixes are sorted around anchors: of the K-grams inside each string of
``length`` bytes the one with the least hash is its anchor, and equal strings have equal anchors at equal offsets.
Anchors whose K-gram is unique need no further look. Around each other one, what lies to its right and (reversed) to
its left is sorted by deep-shallow sorting, and the common prefixes of neighbours tell which strings are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import in_groups, small_batches, unused
from hazegrid.llm.deepshallow import sort_strings
from hazegrid.session import discard, materialize

LENGTH = 200
#: Bytes of an anchor's K-gram (a power of two times 8).
GRAM = 64
#: Anchors of one K-gram that one task sorts together; larger groups are counted by their strings instead.
GROUP_ROWS = 16_384
_U = np.uint64


def _gram_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position on."""
    data = np.frombuffer(raw, np.uint8)
    h = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    h *= _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    width = 8
    while width < GRAM:
        h = h[:-width] * _U(0xC2B2AE3D27D4EB4F) + (h[width:] ^ (h[width:] >> _U(29))) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(31)
        width *= 2
    return h


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, K-gram hashes) of the anchors; every string of ``length`` bytes has one inside, at ties all."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(raw)
    rank = (h >> _U(32)).astype(np.uint32)
    window = length - GRAM + 1
    least = _sliding(rank, window, np.minimum)
    # the greatest least value of the windows that a position lies in is its own value if it is some window's least
    pad = np.zeros(window - 1, np.uint32)
    at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), window, np.maximum) == rank)
    return at, h[at]


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans as maximal runs."""
    out: list[list[int]] = []
    for i in np.lexsort((ends, starts)):
        s, e = int(starts[i]), int(ends[i])
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_around(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans ``place, start, stop`` around the anchors of whole groups ``gram``, from contexts ``before``, ``after``.

    A row with ``stop`` is a span that is known already.
    """
    known = pdf["stop"].notna().to_numpy()
    done = pdf.loc[known, ["place", "start", "stop"]]
    pdf = pdf[~known].reset_index(drop=True)
    n = len(pdf)
    if n < 2:
        return done.astype({"stop": np.int64})
    key = [int(g).to_bytes(8, "big", signed=True) for g in pdf["gram"]]
    right = [k + bytes(a) for k, a in zip(key, pdf["after"], strict=True)]
    left = [k + bytes(b)[::-1] for k, b in zip(key, pdf["before"], strict=True)]
    group = np.unique(pdf["gram"].to_numpy(), return_inverse=True)[1]
    room_r, room_l = np.array([len(x) for x in right]) - 8, np.array([len(x) for x in left]) - 8
    sides = []
    for strings in (right, left):
        order, lcp = sort_strings(strings)
        order, lcp = np.array(order), np.array(lcp) - 8
        longest = np.zeros(n, np.int64)
        longest[order] = np.maximum(lcp, np.append(lcp[1:], -8))
        sides.append((order, lcp, longest))
    low, high = np.zeros(n, np.int64), np.full(n, -1, np.int64)  # offsets of the anchor in repeated strings
    reach = (sides[0][2] >= GRAM) & (sides[0][2] + sides[1][2] >= length)

    def matched(d: int, pending: np.ndarray) -> np.ndarray:
        """Which rows share the string that starts ``d`` bytes before their anchor with another row."""
        live = np.zeros(group.max() + 1, bool)
        live[group[pending]] = True
        use = live[group] & (room_l >= d) & (room_r >= length - d)
        code = np.zeros(n, np.int64)
        for (order, lcp, _), deep in zip(sides, (length - d, d), strict=True):
            part = use[order]
            # rows in between that are left out share less with their neighbours, or belong to no live group
            run = np.cumsum(lcp < deep)[part]
            code[order[part]] = code[order[part]] * (n + 1) + run
        rows = np.flatnonzero(use)
        _, where, times = np.unique(code[rows], return_inverse=True, return_counts=True)
        out = np.zeros(n, bool)
        out[rows] = times[where] > 1
        return out

    window = length - GRAM
    pending = reach.copy()
    for d in range(window, -1, -1):
        if not pending.any():
            break
        hit = matched(d, pending) & pending
        high[hit] = d
        pending &= ~hit
    pending = high >= 0
    for d in range(window + 1):
        if not pending.any():
            break
        hit = matched(d, pending) & pending
        low[hit] = d
        pending &= ~hit
    ok = high >= 0
    start = pdf["start"].to_numpy()
    spans = pd.DataFrame({"place": pdf["place"].to_numpy()[ok], "start": (start - high)[ok], "stop": (start - low + length)[ok]})
    return pd.concat([done.astype({"stop": np.int64}), spans], ignore_index=True)


_CONTEXT = "gram long, place long, start long, stop long, before binary, after binary"


def _contexts(length: int):
    """Bytes around the anchors of each text; equal contexts in one text are sent once and their spans at once."""
    window = length - GRAM

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for place, text, at, grams in zip(pdf["place"], pdf["text"], pdf["at"], pdf["grams"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                seen: dict[tuple[bytes, bytes], int] = {}
                again: list[tuple[int, int]] = []
                for p, g in zip(at, grams, strict=True):
                    before, after = raw[max(0, p - window) : p], raw[p : p + length]
                    first = seen.setdefault((before, after), p)
                    if first == p:
                        rows.append((g, place, p, None, before, after))
                    elif len(before) + len(after) >= length:
                        again += [(q - len(before), q + len(after)) for q in (first, p)]
                if again:
                    s, e = np.array(again).T
                    rows += [(place, place, a, b, None, None) for a, b in merged(s, e)]
            yield pd.DataFrame(rows, columns=["gram", "place", "start", "stop", "before", "after"]).astype({"stop": "Int64"})

    return run


def _strings(length: int):
    """Every string of ``length`` bytes around the anchors of each text, by its hash."""
    window = length - GRAM

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for place, text, at in zip(pdf["place"], pdf["text"], pdf["at"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                starts = {s for p in at for s in range(max(0, p - window), min(p, len(raw) - length) + 1)}
                rows += [(xxhash.xxh3_128_digest(raw[s : s + length]), place, s) for s in starts]
            yield pd.DataFrame(rows, columns=["string", "place", "start"])

    return run


def _place(id_: Column, text_key: Column) -> Column:
    """A number for each row, the same only for rows with equal id and equal text."""
    return F.xxhash64(id_, text_key)


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.md5(text)
    return docs.select(docs[id_col].alias("id"), _place(docs[id_col], key).alias("place"), F.unhex(key).alias("text_key"), text.alias("text"))


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(copies, spans): which texts occur as a whole in several rows, and what other repeated bytes there are.

    ``copies`` has ``text_key`` (MD5 of the text) of texts in two or more rows. ``spans`` has ``place, text_key`` and
    arrays ``starts``, ``stops`` of bytes that lie in repeated strings, for one row of each distinct text.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8} bytes")
    small_batches(docs.sparkSession)
    rows = _placed(docs, id_col, text_col)
    long_enough = F.octet_length("text") >= length
    texts = rows.where(long_enough).groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    texts = materialize(texts, "texts")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [anchors(t.encode("utf-8", "surrogatepass"), length) for t in pdf["text"]]
            size = [len(at) for at, _ in found]
            if sum(size):
                at, grams = np.concatenate([a for a, _ in found]), np.concatenate([g for _, g in found])
                yield pd.DataFrame({"gram": grams.view(np.int64), "place": np.repeat(pdf["place"].to_numpy(), size), "at": at.astype(np.int32)})

    every = materialize(rows.where(long_enough).select("place", "text").mapInPandas(find, "gram long, place long, at int"), "anchors")
    often = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", (F.col("n") > group_rows).alias("crowded"))
    # hot K-grams are one row on the right, so adaptive execution can split the left
    hits = every.join(often, "gram").groupBy("place").agg(F.sort_array(F.collect_set(F.struct("at", "gram", "crowded"))).alias("hits"))
    hits = materialize(hits.join(texts, "place").select("place", "text_key", "hits"), "hits")
    discard(every)

    bodies = rows.where(long_enough).select("place", "text_key", "text")
    around = bodies.join(hits, ["place", "text_key"])

    def of(crowded: bool) -> DataFrame:
        own = F.filter("hits", lambda x: x["crowded"] == crowded)
        return around.select("place", "text", F.transform(own, lambda x: x["at"]).alias("at"), F.transform(own, lambda x: x["gram"]).alias("grams")).where(F.size("at") > 0)

    found = in_groups(of(False).mapInPandas(_contexts(length), _CONTEXT), ["gram"], lambda pdf: repeated_around(pdf, length), "place long, start long, stop long")
    if not hits.where(F.exists("hits", lambda x: x["crowded"])).isEmpty():
        strings = of(True).mapInPandas(_strings(length), "string binary, place long, start long").distinct()
        again = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
        found = found.union(strings.join(again, "string").select("place", "start", (F.col("start") + length).alias("stop")))
    spans = found.groupBy("place").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = spans.join(texts.select("place", "text_key"), "place").select("place", "text_key", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    return texts.where("n > 1").select("text_key"), spans


def _kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in runs:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def measure(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    All bytes in strings of ``length`` bytes that start anywhere else too are removed; strings are judged on the
    input and never cross rows. A null text counts as empty; repeated rows are copies of each other; a row without
    id is treated like any other; further columns are not read.
    """
    copies, spans = repeats(docs, length, id_col, text_col, group_rows)
    bodies = _placed(docs, id_col, text_col).where(F.octet_length("text") >= length).select("place", "text_key", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, starts, stops in zip(pdf["text_key"], pdf["text"], pdf["starts"], pdf["stops"], strict=True):
                runs = merged(np.asarray(starts), np.asarray(stops))
                kept = _kept_bytes(text.encode("utf-8", "surrogatepass"), runs)
                rows.append((key, sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["text_key", "n_removed", "n_spans", "kept_sha256"])

    changed = bodies.join(spans, ["place", "text_key"]).mapInPandas(cut, "text_key binary, n_removed long, n_spans long, kept_sha256 string")
    whole = copies.select("text_key", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(None).cast("string").alias("kept_sha256"))
    # a text with copies goes as a whole, whatever else was found in it
    figures = changed.join(copies, "text_key", "left_anti").dropDuplicates(["text_key"]).union(whole)
    rows = _placed(docs, id_col, text_col).select("id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    out = rows.join(figures, "text_key", "left")
    gone = F.col("n_spans").isNotNull() & F.col("n_removed").isNull()
    return out.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows with the repeated bytes cut out of their text; parts of characters left at a cut are dropped.

    All rows stay, with an empty text if nothing is left; ``chars_col``, if there is such a column, is counted anew.
    """
    copies, spans = repeats(docs, length, id_col, text_col)
    columns = docs.columns
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.md5(text)
    own_place, own_key, gone, cut_at = (unused(docs, c) for c in ("place", "text_key", "gone", "spans"))
    keyed = docs.withColumns({own_place: _place(docs[id_col], key), own_key: F.unhex(key)})
    whole = copies.select(F.col("text_key").alias(own_key), F.lit(True).alias(gone))
    marked = keyed.join(whole, own_key, "left")
    cuts = spans.select(F.col("place").alias(own_place), F.col("text_key").alias(own_key), F.arrays_zip("starts", "stops").alias(cut_at))
    marked = marked.join(cuts, [own_place, own_key], "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        out = []
        for t, s, e in zip(texts, starts, stops, strict=True):
            if t and s is not None and len(s):
                t = _kept_bytes(t.encode("utf-8", "surrogatepass"), merged(np.asarray(s), np.asarray(e))).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    new = F.when(F.col(gone), "").otherwise(F.when(F.col(cut_at).isNotNull(), cut(F.col(text_col), F.col(f"{cut_at}.starts"), F.col(f"{cut_at}.stops"))).otherwise(F.col(text_col)))
    out = marked.withColumn(text_col, new)
    if chars_col and chars_col in columns:
        out = out.withColumn(chars_col, F.when(F.col(gone).isNotNull() | F.col(cut_at).isNotNull(), F.char_length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out.select(*columns)
