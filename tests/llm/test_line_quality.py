import re
from collections import Counter

import numpy as np
import pytest

from hazegrid.llm import line_quality as lq
from hazegrid.llm.common import table

SF = "/root/testdata/sf0.01"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


ODD = ["", " \n\t ", "one", "a b\na b\na b\r\n", "x\u00a0y\u2028z 🙂 #tag\n\n", "|" * 50 + "\n" + "w " * 30, "a b c d e f g h i " * 40, "\x00 \x1c a", "l\n" * 3000]


def test_base_figures_by_brute_force(spark):
    for text in [*ODD, *[r["text"] for r in table(spark, SF, "documents").select("text").limit(200).collect()]]:
        assert lq.describe(text).base == base(text), text[:80]


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(5)
    crf = lq.Crf(rng.normal(size=(lq.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    for n in range(1, 9):
        ids = np.stack([rng.integers(lo, hi, n) for lo, hi in zip(lq._OFFSETS[:-1], lq._OFFSETS[1:], strict=True)], axis=1)
        emit = crf.emit[ids].sum(axis=1)
        total = lambda y: sum(emit[i, y[i]] for i in range(n)) + sum(crf.step[y[i], y[i + 1]] for i in range(n - 1))
        every = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        assert total(crf.decode(ids)) == pytest.approx(max(map(total, every)))


def test_judge(spark, make_docs):
    docs = table(spark, SF, "documents")
    model = lq.train(docs, table(spark, SF, "labels"))
    rated = lq.judge(docs, model).join(table(spark, SF, "labels"), "doc_id").select("quality", "base_failed", "kept").collect()
    assert all(not r["kept"] for r in rated if r["base_failed"])
    open_ = [r for r in rated if not r["base_failed"]]
    assert np.mean([r["kept"] == bool(r["quality"]) for r in open_]) > 0.95
    long = "Some words of a line that is long enough. " * 2
    rows = [(1, None), (2, ""), (None, long + "\n" + " ".join(f"w{i}" for i in range(60))), (4, "x " * 40), (4, "x " * 40)]
    got = lq.judge(make_docs(rows), model)
    assert got.columns.count("kept") == 1 and "node" in got.columns
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 5 and by[1]["base_failed"] and by[1]["content_share"] is None and not by[2]["kept"]
    assert by[4]["n_repeat_words"] == 40 and by[4]["base_failed"] and not by[None]["base_failed"]
    assert lq.judge(make_docs([]), model).count() == 0
    none = lq.train(make_docs(rows), table(spark, SF, "labels").limit(0))
    assert none is None and lq.judge(make_docs(rows), None).where("kept").count() == 1
