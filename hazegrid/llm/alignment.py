"""Alignment of two tokenizers over the same texts.

Both tokenizers cut a text's bytes; byte offsets where tokens of both end cut the text into groups. They are found by
divide and conquer: in every interval a common end near the middle is looked up by bisection and both halves are
treated alike; an interval without a common end is a group. All intervals of one depth are treated together.

Tokens of the two sides in one group are linked. How many documents hold a pair of ids linked is counted over the
whole corpus; a document's links are then looked up, the most frequent pairs (a fixed number) in a broadcast table and
all others by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import small_batches
from hazegrid.llm.word_cache import encoder
from hazegrid.session import discard, materialize

#: Most frequent pairs that are sent to the tasks; all others are joined.
HEAD = 1 << 19
#: Characters or tokens that a task treats together; a longer document alone.
SLICE = 1 << 20
#: Bits of an id in a pair's number; what 63 bits leave numbers the rows of a slice.
ID_BITS = 24
#: Groups with more pairs than this are first reduced to their different ids.
WIDE = 256
#: Tokens on either side of the middle that are tried before the whole interval is.
NEAR = 3
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


class Pieces:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _middle_cuts(end_a: np.ndarray, end_b: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of A's tokens, a token inside it whose end is an end of B's too, and B's token; -1 if none."""
    middle = (a0 + a1 - 2) // 2
    at = np.full(len(a0), -1)
    other = np.full(len(a0), -1)
    open_ = np.arange(len(a0))
    for step in sorted(range(-NEAR, NEAR + 1), key=abs):
        i = middle[open_] + step
        inside = (i >= a0[open_]) & (i < a1[open_] - 1)
        own, i = open_[inside], i[inside]
        j = np.searchsorted(end_b, end_a[i])
        hit = end_b[j] == end_a[i]
        at[own[hit]], other[own[hit]] = i[hit], j[hit]
        open_ = open_[at[open_] < 0]
        if not len(open_):
            break
    far = np.flatnonzero((at < 0) & (a1 - a0 - 1 > 2 * NEAR + 1))
    if len(far):
        n = a1[far] - a0[far] - 1
        owner = np.repeat(np.arange(len(far)), n)
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a0[far][owner]
        j = np.searchsorted(end_b, end_a[i])
        hit = np.flatnonzero(end_b[j] == end_a[i])
        hit = hit[np.lexsort((np.abs(i[hit] - middle[far][owner[hit]]), owner[hit]))]
        first = hit[np.unique(owner[hit], return_index=True)[1]]
        at[far[owner[first]]], other[far[owner[first]]] = i[first], j[first]
    return at, other


def leaf_groups(end_a: np.ndarray, end_b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups stop, in tokens of A and of B, in order.

    ``end_a`` and ``end_b`` are the tokens' ends in the bytes of all documents, ``docs_a`` and ``docs_b`` the numbers of
    tokens up to the end of each document.
    """
    a0, b0 = np.append(0, docs_a[:-1]), np.append(0, docs_b[:-1])
    a1, b1 = docs_a, docs_b
    some = a1 > a0
    a0, a1, b0, b1 = a0[some], a1[some], b0[some], b1[some]
    stops_a, stops_b = [], []
    while len(a0):
        # one token on a side cannot be cut
        cut = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        at, other = _middle_cuts(end_a, end_b, a0[cut], a1[cut])
        cut, at, other = cut[at >= 0], at[at >= 0] + 1, other[at >= 0] + 1
        whole = np.ones(len(a0), bool)
        whole[cut] = False
        stops_a.append(a1[whole])
        stops_b.append(b1[whole])
        # halves side by side: the intervals stay in order, which keeps the searches local
        a0, a1 = np.column_stack([a0[cut], at]).ravel(), np.column_stack([at, a1[cut]]).ravel()
        b0, b1 = np.column_stack([b0[cut], other]).ravel(), np.column_stack([other, b1[cut]]).ravel()
    if not stops_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sa, sb = np.concatenate(stops_a), np.concatenate(stops_b)
    order = np.argsort(sa)
    return sa[order], sb[order]


def _slices(sizes: Sequence[int], rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of up to ``rows`` entries that hold ``SLICE`` together, or one entry if that holds more."""
    lo = total = 0
    for k, size in enumerate(sizes):
        if k > lo and (total + size > SLICE or k - lo >= rows):
            yield lo, k
            lo, total = k, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def _dump(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, after one byte that says how many."""
    kind = np.dtype(np.min_scalar_type(int(values.max()) if len(values) else 0))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _load(blobs: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the blobs, and how many up to the end of each."""
    parts = [np.frombuffer(b, f"<u{b[0]}", offset=1) for b in blobs]
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64), np.cumsum([len(p) for p in parts])


def _written(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, marked: dict[str, np.ndarray]) -> np.ndarray:
    """Ids as text, with the marks of the groups, in the order of writing; ``marked`` has all ids with each mark."""
    stop_a, stop_b = np.cumsum(size_a), np.cumsum(size_b)
    out = np.empty(len(ids_a) + len(ids_b), object)
    at_a = np.arange(len(ids_a)) + np.repeat(stop_b - size_b, size_a)
    at_b = np.arange(len(ids_b)) + np.repeat(stop_a, size_b)
    out[at_a], out[at_b] = marked[","][ids_a], marked[","][ids_b]
    out[at_a[stop_a - 1]], out[at_b[stop_b - 1]] = marked["|"][ids_a[stop_a - 1]], marked[";"][ids_b[stop_b - 1]]
    return out


class Aligner:
    """Both tokenizers and what is derived from their vocabularies; built once per Python worker."""

    def __init__(self, name_a: str, a_file: bytes, b_model: bytes):
        self.a, self.b = encoder(name_a, a_file, plain_specials=True), Pieces(b_model)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.bytes
        self.length_a, self.length_b = np.array([len(t) for t in self.bytes_a]), np.array([len(t) for t in self.bytes_b])
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.marked = {mark: np.array([f"{i}{mark}" for i in range(most)], object) for mark in ",|;"}

    def __call__(self, texts: list[str]) -> list[tuple]:
        raw_a, raw_b = self.a.encode_all([" " + t for t in texts]), self.b.encode_all(texts)
        ids_a, ids_b, none = [], [], np.zeros(0, np.int64)
        for k, t in enumerate(texts):
            x, y = np.frombuffer(raw_a[k], "<u4").astype(np.int64), np.array(raw_b[k], np.int64)
            want = b" " + t.encode("utf-8", "surrogatepass")
            same = t and b"".join(map(self.bytes_a.__getitem__, x.tolist())) == want == b"".join(map(self.bytes_b.__getitem__, raw_b[k]))
            ids_a.append(x if same else none)
            ids_b.append(y if same else none)
        docs_a, docs_b = np.cumsum([len(x) for x in ids_a]), np.cumsum([len(x) for x in ids_b])
        flat_a, flat_b = np.concatenate(ids_a), np.concatenate(ids_b)
        stop_a, stop_b = leaf_groups(np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b]), docs_a, docs_b)
        size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        until = np.searchsorted(stop_a, docs_a, "right")
        words = _written(flat_a, flat_b, size_a, size_b, self.marked)
        out, g0, w0 = [], 0, 0
        for k in range(len(texts)):
            g1, w1 = int(until[k]), int(docs_a[k] + docs_b[k])
            mine = (ids_a[k], ids_b[k], size_a[g0:g1], size_b[g0:g1])
            digest = hashlib.sha256("".join(words[w0:w1].tolist())[:-1].encode()).hexdigest() if w1 > w0 else ""
            out.append((*map(_dump, mine), len(ids_a[k]), len(ids_b[k]), g1 - g0, int((mine[2] * mine[3]).sum()), digest))
            g0, w0 = g1, w1
        return out


_ALIGNED = "row long, id string, ids_a binary, ids_b binary, size_a binary, size_b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, a_file: bytes, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids and groups of every row, as numbers in bytes, and their counts and hash.

    A encodes a blank and the text, B the text. A text that is null or empty, or whose joined token bytes are not the
    blank and the text on both sides, has no tokens.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((a_file, b_model))  # a few megabytes
    names = hashlib.sha256(a_file).hexdigest(), hashlib.sha256(b_model).hexdigest()
    source = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if names not in _ALIGNERS:
            _ALIGNERS[names] = Aligner(names[0], *shared.value)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for lo, hi in _slices([len(t) for t in texts]):
                rows = _ALIGNERS[names](texts[lo:hi])
                out = pd.DataFrame(rows, columns=["ids_a", "ids_b", "size_a", "size_b", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
                out.insert(0, "row", pdf["row"].to_numpy()[lo:hi])
                out.insert(1, "id", pd.Series(pdf["id"].tolist()[lo:hi], dtype=object))
                yield out

    return source.mapInPandas(run, _ALIGNED)


def _links(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the row, pair, times) of the different linked pairs of rows, in slices of whole rows."""
    for lo, hi in _slices((pdf["n_a"] + pdf["n_b"]).tolist(), 1 << 63 - 2 * ID_BITS - 1):
        part = pdf.iloc[lo:hi]
        ids_a, _ = _load(part["ids_a"])
        ids_b, _ = _load(part["ids_b"])
        size_a, groups = _load(part["size_a"])
        size_b, _ = _load(part["size_b"])
        if not len(size_a):
            continue
        doc = np.searchsorted(groups, np.arange(len(size_a)), "right")
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        wide = size_a * size_b > WIDE
        of_a = np.repeat(np.arange(len(size_a)), size_a)
        narrow = ~wide[of_a]
        of_a, x = of_a[narrow], ids_a[narrow]
        n = size_b[of_a]
        y = ids_b[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_b[of_a], n)]
        # one number for row and pair; most pairs come from small groups and count once each time
        keys, times = np.unique(np.repeat(doc[of_a] << 2 * ID_BITS | x << ID_BITS, n) | y, return_counts=True)
        more, more_times = [keys], [times]
        for g in np.flatnonzero(wide):
            ua, ca = np.unique(ids_a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            ub, cb = np.unique(ids_b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            more.append((doc[g] << 2 * ID_BITS | ua[:, None] << ID_BITS | ub).ravel())
            more_times.append((ca[:, None] * cb).ravel())
        if len(more) > 1:
            flat = np.concatenate(more_times)
            keys, where = np.unique(np.concatenate(more), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, where, flat)
        yield (keys >> 2 * ID_BITS) + lo, keys & ((1 << 2 * ID_BITS) - 1), times


def link_counts(rows: DataFrame) -> DataFrame:
    """``pair, a, b, n, best``: how many rows hold a pair linked, and whether no other pair of its ``a`` has more."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

        for pdf in batches:
            for _, pair, _ in _links(pdf):
                held.append(np.unique(pair, return_counts=True))
                if sum(len(p) for p, _ in held) > 4 * SLICE:
                    held = [summed()]
                    if len(held[0][0]) > 2 * SLICE:
                        yield pd.DataFrame({"pair": held[0][0], "n": held[0][1]})
                        held = []
        if held:
            pairs, n = summed()
            yield pd.DataFrame({"pair": pairs, "n": n})

    found = rows.select("n_a", "n_b", "ids_a", "ids_b", "size_a", "size_b").mapInPandas(count, "pair long, n long")
    counts = found.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", ID_BITS).cast("int"))
    counts = materialize(counts.withColumn("b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1).cast("int")), "pairs")
    # one row for each id of A's vocabulary at most
    most = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    out = counts.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    out._scratch_path = counts._scratch_path
    return out


def link_scores(rows: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """``row, n_best, count_sum`` and what ``rows`` say of each row: links weighed by the counts of their pairs."""
    top = counts.orderBy(F.desc("n"), "pair").limit(head).select("pair", "n", "best").toPandas().sort_values("pair")
    shared = rows.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))
    keys = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = "row long, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, n_best long, count_sum long"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, n, best = shared.value
        for pdf in batches:
            sums, bests = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            number = pdf["row"].to_numpy()
            rest = []
            for owner, pair, times in _links(pdf):
                at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                known = pairs[at] == pair
                np.add.at(sums, owner[known], n[at[known]] * times[known])
                np.add.at(bests, owner[known], best[at[known]] * times[known])
                rest.append(pd.DataFrame({"row": number[owner[~known]], "pair": pair[~known], "n_best": times[~known]}))
            own = pdf[keys].assign(pair=pd.array([None] * len(pdf), "Int64"), n_best=bests, count_sum=sums)
            yield own.astype({"id": object, "groups_sha256": object})
            for more in rest:
                if len(more):
                    yield more.reindex(columns=own.columns).astype({"pair": "Int64", "id": object, "groups_sha256": object})

    scored = materialize(rows.select(*keys, "ids_a", "ids_b", "size_a", "size_b").mapInPandas(score, kinds), "scores")
    own = scored.where(F.col("pair").isNull())
    rare = scored.where(F.col("pair").isNotNull()).select("row", "pair", F.col("n_best").alias("times"))
    looked = rare.join(counts.select("pair", "n", "best"), "pair")
    more = looked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    joined = own.join(more, "row", "left")
    plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return joined.select(*keys, plus("n_best", "more_best"), plus("count_sum", "more_sum"))


def align(docs: DataFrame, a_file: bytes, b_model: bytes, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_links`` counts the pairs of tokens that share a group, ``n_best`` those whose pair of ids is linked in as many
    rows as any pair of its A id, ``count_sum`` adds up the pairs' counts. Rows without tokens (null or empty text,
    or bytes that differ) have zeros and an empty hash. Repeated rows count as often as they occur; a null id stays
    null; an empty table gives no rows; only the named columns are read. ``head`` bounds what is broadcast and does
    not change the result.
    """
    rows = materialize(aligned(docs, a_file, b_model, id_col, text_col), "aligned")
    counts = link_counts(rows)
    scored = link_scores(rows, counts, head)
    discard(rows)
    return scored.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, groups`` (arrays of A's and B's ids, group by group) from the rows of :func:`aligned`."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                (a, _), (b, _), (na, _), (nb, _) = (_load([r[c]]) for c in ("ids_a", "ids_b", "size_a", "size_b"))
                parts = zip(np.split(a, np.cumsum(na)[:-1]), np.split(b, np.cumsum(nb)[:-1]), strict=True) if len(na) else []
                out.append([{"a": x.tolist(), "b": y.tolist()} for x, y in parts])
            yield pd.DataFrame({"id": pdf[id_col].to_numpy(), "groups": out})

    return rows.select(id_col, "ids_a", "ids_b", "size_a", "size_b").mapInPandas(read, "id string, groups array<struct<a:array<int>,b:array<int>>>")
