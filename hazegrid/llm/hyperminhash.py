"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is compressed to 128 registers of 16 bits: the shingles fall into buckets by the
first bits of their hash, and a bucket keeps the greatest pair of (leading zeros + 1, ten mantissa bits) of the rest.
Documents with equal sets are one class. Classes that agree in a band of four registers meet, and collision-corrected
Jaccard estimates against leaders gather those that may be linked into families. Links are confirmed within families
on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import in_groups, small_batches, unused
from hazegrid.operators.components import contract
from hazegrid.session import discard, materialize

#: 2**P buckets, R mantissa bits, ROWS registers in a band: a pair at similarity 0.85 (0.8) misses all 32 bands with
#: probability 5e-11 (5e-8).
P, R, ROWS = 7, 10, 4
BUCKETS = 1 << P
BANDS = BUCKETS // ROWS
#: Estimates: a pair with similarity 0.85 (0.8) has 0.67 (0.6) or more, five standard deviations off; a class with
#: COVER is close to a leader, and whatever is similar to it has EDGE, as 1 - EDGE = (1 - COVER) + (1 - 0.6).
COVER, EDGE = 0.75, 0.35
#: Classes that are compared in one block.
BLOCK = 512

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


class ShingleHasher:
    """64-bit hashes of the distinct shingles of a text, ascending."""

    def __init__(self, size: int):
        self.size, self.cache = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > 500_000:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64) * _C
        for j in range(size):
            out = _mix(out * _A + h[j : len(h) - size + 1 + j] * _B)
        return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16 registers; 0 stands for an empty bucket."""
    rest = (shingles << _U(P)) >> _U(P)
    zeros = (64 - P - np.frexp(rest.astype(np.float64))[1] + 1).astype(np.uint16)
    mantissa = ((_mix(rest) >> _U(64 - R))).astype(np.uint16)
    out = np.zeros(BUCKETS, np.uint16)
    np.maximum.at(out, (shingles >> _U(64 - P)).astype(np.int64), (zeros << np.uint16(R)) | mantissa)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows ``a`` and ``b`` of sets with ``n`` and ``m`` members.

    Equal registers over non-empty ones, less the agreements that truncated hashes give by chance.
    """
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    equal = ((a == b) & (a > 0)).sum(axis=-1)
    n, m = np.asarray(n, dtype=np.float64), np.asarray(m, dtype=np.float64)
    # agreements by chance of two disjoint sets: 0.16992 per bucket and mantissa value, fewer if the sizes differ
    chance = 0.169919487159739 * used / (1 << R) * 4 * n * m / np.maximum(1.0, (n + m) ** 2)
    return np.maximum(0.0, equal - chance) / np.maximum(1, used)


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signatures(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """``id, text_key, n_shingles, set_key, registers`` of every row.

    Set key and registers are null for a text without words; ``text_key`` is the text's MD5 if ``keyed``, else empty.
    """
    small_batches(docs.sparkSession)
    text_key = _text_key(docs[text_col]) if keyed else F.lit(b"")
    source = docs.select(docs[id_col].alias("id"), text_key.alias("text_key"), docs[text_col].alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = ShingleHasher(shingle)
        for pdf in batches:
            sets = [hasher(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "id": pdf["id"],
                "text_key": pdf["text_key"],
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "registers": [registers(s).tobytes() if len(s) else None for s in sets],
            })

    return source.mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, text_key binary, n_shingles long, set_key binary, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """``band, node``: one row for each band of a class that is not empty throughout."""
    width = 2 * ROWS
    empty = F.lit(b"\x00" * width)
    parts = [F.substring("registers", 1 + width * b, width) for b in range(BANDS)]
    keys = F.array(*[F.when(p != empty, F.xxhash64(F.lit(b), p)) for b, p in enumerate(parts)])
    return classes.select(F.explode(keys).alias("band"), "node").where(F.col("band").isNotNull())


def _rows(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, BUCKETS)


def _leader_estimates(met: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, leader, estimate`` for each class and each leader that it meets."""
    pairs = met.where(F.col("node") != F.col("leader")).select("node", "leader").distinct()
    own = classes.select("node", F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    other = classes.select(F.col("node").alias("leader"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))

    @F.pandas_udf("double")
    def compared(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series(estimate(_rows(ra), _rows(rb), na, nb) if len(ra) else [], dtype=float)

    return pairs.join(own, "node").join(other, "leader").select("node", "leader", compared("ra", "rb", "na", "nb").alias("estimate"))


def _in_blocks(members: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Members of each group dealt in blocks of about ``size``, each pair of blocks ``(i, j)`` as one group.

    A group of up to ``size`` members is one block, and each two members of a group meet in some pair of blocks.
    """
    counts = members.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    dealt = members.join(counts, keys).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).drop("blocks", "other")


def _edges_of(pdf: pd.DataFrame, keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a frame that is sorted by ``keys``."""
    change = np.ones(len(pdf), bool)
    change[1:] = np.logical_or.reduce([pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1] for k in keys])
    starts = np.flatnonzero(change)
    for lo, hi in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
        yield pdf.iloc[lo:hi]


def _families(met: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, family``: classes that may be linked, directly or in chains, have one family.

    A bucket's members are first compared with its leader. A member that is not close to it (COVER) is compared with
    the others of that kind, which find leaders among themselves. If x and y are similar and x is close to a leader
    then y is not far (EDGE) from it, as registers in which x agrees with the leader and with y are equal in all three;
    so both join its family.
    """
    seen = materialize(_leader_estimates(met, classes), "estimates")
    first = seen.where(F.col("estimate") >= EDGE).select(F.col("leader").alias("u"), F.col("node").alias("v"))
    far = seen.where(F.col("estimate") < COVER).select("node", "leader")
    rest = met.join(far, ["node", "leader"]).select("band", "node")
    # a bucket with one such member needs no more: the leader has been compared with it
    several = rest.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    blocks = _in_blocks(rest.join(several, "band"), ["band"], BLOCK).join(classes.select("node", "registers", "n_shingles"), "node")

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for group in _edges_of(pdf, ["band", "i", "j"]):
            reg, n, node = _rows(group["registers"]), group["n_shingles"].to_numpy(), group["node"].to_numpy()
            free, part = np.ones(len(node), bool), np.arange(len(node))
            for x in range(len(node)):
                if not free[x]:
                    continue
                near = estimate(reg[x][None, :], reg, n[x], n)
                # an edge within a part tells nothing new: a group gives fewer edges than it has members
                for k in np.flatnonzero((near >= EDGE) & (part != part[x])):
                    if part[k] != part[x]:
                        part[part == part[k]] = part[x]
                        found.append((node[x], node[k]))
                free[near >= COVER] = False
        return pd.DataFrame(found, columns=["u", "v"])

    more = in_groups(blocks, ["band", "i", "j"], lead, "u binary, v binary")
    edges = first.union(more).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    families = contract(edges).select("node", F.col("root").alias("family"))
    discard(seen)
    return families


def _members(roots: DataFrame) -> DataFrame:
    """``node, family`` of all nodes, the roots included."""
    return roots.select("node", "family").union(roots.select(F.col("family").alias("node"), "family")).distinct()


def _full_sets(docs: DataFrame, members: DataFrame, classes: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``node, family, shingles`` of the classes in ``members``; one document of each class gives its text."""
    wanted = classes.join(members, "node").select(F.col("rep.id").alias("id"), "node", "family")
    # both sides are dealt by id at every size
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(wanted.hint("merge"), "id").select("node", "family", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = ShingleHasher(shingle)
        for pdf in batches:
            made = [hasher(t).tobytes() for t in pdf["text"]]
            # a repeated id may have other texts
            right = [xxhash.xxh3_128_digest(s) == bytes(key) for s, key in zip(made, pdf["node"], strict=True)]
            yield pd.DataFrame({"node": pdf["node"], "family": pdf["family"], "shingles": made})[right]

    return materialize(texts.mapInPandas(run, "node binary, family binary, shingles binary").dropDuplicates(["node"]), "sets")


def _able(sets: DataFrame, percent: int) -> DataFrame:
    """Sets of large families without those that too many shingles of their own keep from any link.

    A shingle that only one set of the family has is in no intersection.
    """
    large = sets.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("family")
    known = materialize(large, "large")
    if known.isEmpty():
        return sets
    ours = sets.join(known, "family")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):  # a few hundred thousand rows at once
                part = pdf.iloc[at : at + 64]
                each = [np.frombuffer(x, np.int64) for x in part["shingles"]]
                size = [len(x) for x in each]
                yield pd.DataFrame({"family": np.repeat(part["family"].to_numpy(), size), "node": np.repeat(part["node"].to_numpy(), size), "shingle": np.concatenate(each)})

    single = ours.mapInPandas(split, "family binary, node binary, shingle long").groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = single.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    size = F.length("shingles") / 8
    fit = 100 * (size - F.coalesce("alone", F.lit(0))) >= percent * size
    return sets.join(alone, "node", "left").where(fit).select("node", "family", "shingles")


def _spanning_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` that join the linked sets of each family: 100 * |intersection| >= percent * |union|.

    Intersections are counted exactly, for all pairs of two blocks at once as a product of incidence matrices; a link
    is returned only if it joins parts that the links of its blocks have left apart.
    """

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for group in _edges_of(pdf, ["family", "i", "j"]):
            node, own = group["node"].to_numpy(), group["own"].to_numpy()
            each = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
            n = np.array([len(x) for x in each])
            shared, where, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            row, column = np.repeat(np.arange(len(n)), n), np.cumsum(times > 1)[where] - 1
            keep = times[where] > 1
            row, column = row[keep], column[keep]
            common = np.zeros((len(n), len(n)), np.float32)
            step = 8192
            for lo in range(0, int(column.max()) + 1 if len(column) else 0, step):
                part = (column >= lo) & (column < lo + step)
                matrix = np.zeros((len(n), step), np.float32)
                matrix[row[part], column[part] - lo] = 1
                common += matrix @ matrix.T
            linked = 100 * common.astype(np.int64) >= percent * (n[:, None] + n[None, :] - common.astype(np.int64))
            if group["i"].iloc[0] != group["j"].iloc[0]:
                linked &= own[:, None] != own[None, :]
            part = np.arange(len(n))
            for x, y in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
                if part[x] != part[y]:
                    part[part == part[y]] = part[x]
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
        return pd.DataFrame(found, columns=["u", "v"])

    blocks = _in_blocks(sets, ["family"], BLOCK)
    return in_groups(blocks, ["family", "i", "j"], link, "u binary, v binary", rows=2 * BLOCK).distinct()


def _components(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, keyed: bool) -> DataFrame:
    """``id, text_key, n_shingles, first`` of every row; ``first`` has the least id of the row's component and, among its
    rows, the least text key, or is null for rows that are never linked."""
    signed = materialize(signatures(docs, shingle, id_col, text_col, keyed), "signatures")
    with_words = signed.where(F.col("id").isNotNull() & F.col("set_key").isNotNull())
    classes = materialize(
        with_words.groupBy(F.col("set_key").alias("node")).agg(F.min(F.struct("id", "text_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "classes",
    )
    every = bands(classes)
    leaders = every.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "leader")
    met = materialize(every.join(leaders, "band"), "buckets")
    families = _families(met, classes)
    discard(met)
    sets = _full_sets(docs, _members(families), classes, shingle, id_col, text_col)
    roots = contract(_spanning_links(_able(sets, percent), percent))
    discard(sets)
    placed = classes.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("first"))
    of_class = placed.join(least, "root").select(F.col("node").alias("set_key"), "first")
    # a set that a third of all rows share is one row on the right, so adaptive execution can split the left
    out = signed.join(of_class, "set_key", "left")
    return out.select("id", "text_key", "n_shingles", F.when(F.col("id").isNotNull(), F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every row.

    Words are runs without ASCII white space, A-Z count as a-z, and a set holds the distinct runs of ``shingle``
    words (or all words as one, if there are fewer). Documents with ``100 * intersection >= percent * union`` are
    linked; ``component_id`` is the least id that links lead to and ``kept`` marks the row that carries it. A text
    without words (null, empty, white space) has no shingles and stays alone. A row without id is never linked; its
    component is null and it is kept. Repeated rows get the same values; further columns are not read.
    """
    out = _components(docs, shingle, percent, id_col, text_col, keyed=False)
    component = F.coalesce("first.id", "id")
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document per component, with all their columns.

    A document is an id with a text: an id whose texts differ keeps a row for each component they are in. Of a
    component the least id stays, and of its texts the one with the least MD5. Repeated rows of a document are one;
    rows without id or without words are never copies of others, and rows without id all stay.
    """
    out = _components(docs, shingle, percent, id_col, text_col, keyed=True)
    stays = (F.col("id") == F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))
    gone = out.where(F.col("first").isNotNull() & ~stays).select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    key = _text_key(docs[text_col])
    rest = docs.join(gone, (docs[id_col] == gone["gone_id"]) & (key == gone["gone_key"]), "left_anti")
    row, text_key = unused(docs, "row"), unused(docs, "text_key")
    own = rest.withColumns({row: F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()), text_key: _text_key(F.col(text_col))})
    return own.dropDuplicates([id_col, row, text_key]).select(*docs.columns)
