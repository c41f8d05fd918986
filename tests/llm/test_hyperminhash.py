import random
import re

import numpy as np
import pytest

from hazegrid.llm import hyperminhash as hm


def sets_of(rows, size):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        out.append((i, frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows, size, percent):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = sets_of(rows, size)
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, groups=14, copies=12):
    """Families around a text: some copies are similar to it, some to each other only in chains, some to none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 30, 120, 300]))]
        texts.append(base)
        last = base
        for _ in range(rng.randrange(copies)):
            last = list(rng.choice([base, last]))
            for _ in range(int(len(last) * rng.choice([0, 0.01, 0.02, 0.05, 0.15]))):
                last[rng.randrange(len(last))] = word()
            texts.append(last)
    texts += [["a"], ["a"], ["A", "b"], ["a", "B"], [], ["x"] * 50, ["x"] * 60]
    rng.shuffle(texts)
    return [(3 * i + 1, rng.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "size", "percent", "block"), [(1, 3, 85, 512), (2, 5, 80, 512), (3, 3, 85, 4)])
def test_components_equal_all_pairs(make_docs, monkeypatch, seed, size, percent, block):
    monkeypatch.setattr(hm, "BLOCK", block)  # small blocks take the ways of large families and buckets
    rows = corpus(seed)
    want = brute(rows, size, percent)
    got = hm.near_duplicates(make_docs(rows), size, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_odd_rows(make_docs):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (5, text), (2, text.upper()), (None, text), (None, text), (7, None), (8, ""), (9, " \n"), (10, "one"), (11, "ONE"), (12, "word " * 50_000)]
    docs = make_docs(rows)
    got = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"], r["kept"]) for r in hm.near_duplicates(docs, 3, 85).collect() if r["doc_id"] is not None)
    assert got == [(2, 198, 2, True), (5, 198, 2, False), (5, 198, 2, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True)]
    assert [(r["component_id"], r["kept"]) for r in hm.near_duplicates(docs, 3, 85).where("doc_id is null").collect()] == [(None, True)] * 2
    left = hm.deduplicated(docs.union(docs), 3, 85)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, -1, -1, -1, 2, 7, 8, 9, 10, 12]
    assert hm.near_duplicates(make_docs([]), 3, 85).collect() == []


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2000).astype(np.uint64)
            common = int(2000 * share)
            a, b = np.unique(pool[: common + (2000 - common) // 2]), np.unique(np.concatenate([pool[:common], pool[common + (2000 - common) // 2 :]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(hm.estimate(hm.registers(a), hm.registers(b), len(a), len(b)) - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    x, y = hm.registers(rng.integers(0, 2**63, 9000).astype(np.uint64)), hm.registers(rng.integers(0, 2**63, 9000).astype(np.uint64))
    assert hm.estimate(x, y, 9000, 9000) < 0.03


def test_an_id_with_several_texts_loses_copies_only(make_docs):
    a, b = "one two three four five six seven eight nine ten eleven", "other words that have nothing in common with those of it"
    kept = lambda rows: sorted((r["doc_id"], r["text"]) for r in hm.deduplicated(make_docs(rows), 3, 85).collect())
    assert kept([(0, b), (1, a), (1, b)]) == [(0, b), (1, a)]
    # texts of one id in one component: one stays
    assert len(kept([(1, a), (1, a.upper()), (1, a), (2, a)])) == 1
    assert kept([(1, a), (1, b), (1, b)]) == sorted([(1, a), (1, b)])
    assert sorted(kept([(1, ""), (1, " "), (2, "")])) == [(1, ""), (1, " "), (2, "")]


def test_columns_named_like_helpers_are_kept(make_docs):
    docs = make_docs([(1, "a b c d"), (2, "a b c d")]).selectExpr("*", "7 AS row", "8 AS _row", "9 AS text_key", "1 AS gone_id", "2 AS gone_key")
    (only,) = hm.deduplicated(docs, 3, 85).collect()
    assert only.asDict() == docs.where("doc_id = 1").first().asDict()
