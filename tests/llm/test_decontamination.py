import random

import pytest

from hazegrid.llm import decontamination as dc
from hazegrid.llm.common import table

SF = "/root/testdata/sf0.01"


def brute(docs, items):
    """All passages against all items."""
    items = [(i, dc.words_of(t), dc.answer_of(t)) for i, t in items]
    size = max([dc.BLOCK_WORDS, *(len(w) for _, w, _ in items)])
    out = set()
    for d, t in docs:
        words = dc.words_of(t)
        blocks = max(1, -(-len(words) // size))
        for b in range(max(1, blocks - 1)):
            passage = words[b * size : (b + 2) * size]
            for i, w, a in items:
                lcs = lambda x: dc.common_subsequence(dc._places(x), len(x), passage)  # noqa: E731, B023
                if w and len(set(w) & set(passage)) >= 0.5 * len(set(w)) and lcs(w) >= 0.8 * len(w) and lcs(a) >= 0.5 * len(a):
                    out.add((d, i))
    return out


def test_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
        assert dc.common_subsequence(dc._places(a), len(a), b) == table_[-1][-1]


def test_finds_what_brute_force_finds(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, items).collect()}
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert got <= want and len(got) >= 0.99 * len(want) and want


def test_paraphrases_and_odd_rows(spark, make_docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(40)]
    filler = lambda n: " ".join(word() for _ in range(n))
    para = [w for k, w in enumerate(item) if k % 10 != 3]
    para.insert(20, "extra")
    far = [w if k % 2 else word() for k, w in enumerate(item)]
    rows = [(1, filler(500) + " " + ", ".join(item).upper() + "!"), (2, filler(90) + " " + " ".join(para) + " " + filler(900)), (3, " ".join(far)), (4, filler(300)), (5, None), (6, ""), (1, " ".join(item)), (None, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item), 1), (7, " ".join(item), 1), (8, None, 2), (9, "...", 3), (None, "no id at all here", 4)], "item_id long, text string, doc_id int")
    docs = make_docs(rows)
    got = dc.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"], r["lcs_words"]) for r in got) == [(-1, 7, 40), (1, 7, 40), (2, 7, 36)]
    left = dc.decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 3, 4, 5, 6]
    assert dc.contaminated(docs, bench.limit(0)).count() == 0 and dc.contaminated(make_docs([]), bench).count() == 0


def test_a_benchmark_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(dc, "MOST_ITEMS", 2)
    with pytest.raises(ValueError, match="parts"):
        dc.read_benchmark(spark.createDataFrame([(i, f"t{i}") for i in range(3)], "item_id long, text string"))


def test_frequent_words_of_copies_do_not_hide_an_item(spark, make_docs):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(40)]
    changed = [word() if k % 7 == 3 else w for k, w in enumerate(item)]
    hot = " ".join([word() for _ in range(120)] + changed + [word() for _ in range(120)])
    rows = [(i, hot if i % 3 == 0 else " ".join(word() for _ in range(280))) for i in range(90)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(make_docs(rows), bench).collect()}
    assert got == brute(rows, [(7, " ".join(item))]) == {(i, 7) for i in range(0, 90, 3)}


def test_items_of_mixed_length_are_found_in_windows_of_their_own(spark, make_docs):
    rng = random.Random(8)
    common = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(3000)]
    text = lambda n: [common[min(int(rng.paretovariate(0.6)) - 1, 2999)] for _ in range(n)]
    items = [(k, text(rng.randrange(8, 60))) for k in range(400)] + [(400, text(400)), (401, text(130))]
    rows, planted = [], set()
    for d in range(300):
        k = 400 + d % 2 if d < 20 else rng.randrange(400)
        body = [w if rng.random() < 0.9 else "other" for w in items[k][1]] if d % 2 else items[k][1]
        rows.append((d, " ".join(text(rng.randrange(300)) + body + text(rng.randrange(600)))))
        if d % 2 == 0 or dc.common_subsequence(dc._places(items[k][1]), len(items[k][1]), body) >= 0.8 * len(body):
            planted.add((d, k))
    # words spread over more than two blocks of an item's own size are no copy of it
    spread = [w for x in items[0][1] for w in [x] + ["other"] * 30]
    rows.append((1000, " ".join(spread)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(make_docs(rows), bench).collect()}
    wants_answer = {(d, k) for d, k in planted if d % 2 == 0}
    assert wants_answer <= got and len(planted - got) <= 0.01 * len(planted) and (1000, 0) not in got


def test_rows_are_judged_by_their_own_text(spark, make_docs):
    item = "which of these rivers carries the most water into the northern sea every year the great one"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"before it {item} and after it"), (1, "a clean text with words of its own and nothing else in it"), (None, item), (None, "clean too"), (2, None)]
    left = dc.decontaminated(make_docs(rows), bench)
    assert sorted((r["doc_id"], r["text"]) for r in left.where("doc_id IS NOT NULL").collect()) == [(1, rows[1][1]), (2, None)]
    assert [r["text"] for r in left.where("doc_id IS NULL").collect()] == [rows[2][1], "clean too"]
