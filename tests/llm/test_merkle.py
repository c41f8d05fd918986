import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hazegrid.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(level):
    """Levels of a tree, leaves first."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at - at % 16
        out.append((level[run:at], level[at + 1 : run + 16]))
        at //= 16
    return out


def brute(rows):
    """Rows of the contract for (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, leaf_of(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {name: tree([d for _, d in groups[name]]) for name in names}
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (r, digest) in enumerate(groups[name]):
            steps = siblings(trees[name], i) + siblings(top, k)
            x = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                x = leaf_of((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in steps:
                x = h(*left, x, *right)
            out.append((r[0], digest, trees[name][-1][0], top[-1][0], h(*[d for s in steps for part in s for d in part]), x, x == top[-1][0]))
    return out


def check(spark, tmp_path, rows, extra=""):
    kinds = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(rows, kinds)
    for name in extra.split():
        df = df.withColumn(name, F.lit(7))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    order = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute(rows), key=order)


def doc(i, source, text="Some Text"):
    return (i, source, "en", len(text), text)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 700])
def test_one_group_of_every_shape(spark, tmp_path, n):
    check(spark, tmp_path, [doc(i * 3, "web", f"Text {i}") for i in range(n)])


def test_many_groups_and_a_hot_one(spark, tmp_path):
    rows = [doc(i, f"s{i % 23}") for i in range(120)] + [doc(1000 + i, "hot") for i in range(300)]
    check(spark, tmp_path, rows)


def test_nulls_repeats_clashes_and_bytewise_order(spark, tmp_path):
    rows = [
        (None, None, None, None, None), (5, None, "de", 0, ""), (5, "é", "de", 1, "Ä b"), (5, "z", None, None, None), (5, "Z", None, 3, "ABC"),
        (5, "Z", None, 3, "ABC"), (5, "Z", None, 3, "ABD"), (None, "Z", None, 3, "no id"), (None, "", "en", 1, "A"), (-15, "Z", "x", 2, "Up" * 50_000), (20, "=", "en", 4, "-"),
    ]
    check(spark, tmp_path, rows, "grp pos n part block digest path top id")


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])


def test_path_folds_and_any_change_breaks_it(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"t{i}") for i in range(40)], "doc_id long, source string, text string")
    out = merkle.manifest(docs, ["doc_id", "text"], carry={"other": F.sha2(F.col("text"), 256)})
    good = out.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (merkle.fold(F.col("other"), F.col("path")) == F.col("root")).alias("bad"))
    assert {tuple(r) for r in good.collect()} == {(True, False)}
