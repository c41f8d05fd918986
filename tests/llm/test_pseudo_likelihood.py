import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.llm import pseudo_likelihood as pl
from hazegrid.llm.common import table

SF = "/root/testdata/sf0.01"


def network(seed=0):
    rng = np.random.default_rng(seed)
    net = pl.Network.start(rng.integers(0, 100, pl.SIZE))
    return pl.Network(net.flat.astype(np.float64) + rng.normal(0, 0.1, len(net.flat)))


def test_probabilities_sum_to_one_and_gradient():
    net, rng = network(), np.random.default_rng(1)
    context = rng.integers(0, pl.SIZE + 1, (50, 4))
    every = net.forward(np.repeat(context[:1], pl.SIZE, 0), np.arange(pl.SIZE))
    assert np.exp(every).sum() == pytest.approx(1)
    target = rng.integers(0, pl.SIZE, 50)
    _, grad = net.forward(context, target, back=True)
    for i in rng.choice(np.flatnonzero(np.abs(grad) > 1e-6), 10):
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (pl.Network(up).forward(context, target).mean() - pl.Network(down).forward(context, target).mean()) / 2e-5
        assert slope == pytest.approx(grad[i], abs=1e-6)


def test_contexts_never_cross_texts():
    texts = [np.array([1, 2, 3], np.int32), np.zeros(0, np.int32), np.array([4], np.int32)]
    context, target, owner = pl.contexts(texts)
    p = pl.SIZE
    assert context.tolist() == [[p, p, 2, 3], [p, 1, 3, p], [1, 2, p, p], [p, p, p, p]]
    assert target.tolist() == [1, 2, 3, 4] and owner.tolist() == [0, 0, 0, 2]


def test_training_beats_frequencies_and_order_matters(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    vocabulary = pl.vocabulary_of(docs.select("text"))
    words = docs.select(F.explode(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t\n\r\f\x0B]+")).alias("w")).where("w <> ''")
    top = words.groupBy("w").count().orderBy(F.desc("count"), F.encode("w", "UTF-8")).limit(pl.KNOWN).collect()
    assert [(w.decode(), n) for w, n in vocabulary] == [(r["w"], r["count"]) for r in top]
    counts = np.zeros(pl.SIZE)
    counts[: len(vocabulary)] = [n for _, n in vocabulary]
    counts[pl.KNOWN :] = vocabulary[-1][1] * 4
    net, plain = pl.train(docs, vocabulary), pl.Network.start(counts)
    reader = pl.Reader({w: i for i, (w, _) in enumerate(vocabulary)})
    texts = [reader(r["text"]) for r in docs.limit(200).collect()]
    context, target, _ = pl.contexts(texts)
    assert net.forward(context, target).mean() > plain.forward(context, target).mean() + 0.1


def test_scores_by_hand_and_odd_rows(make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(rng.randint(1, 40)))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, " \n "), (None, "the cat"), (1, rows[1][1]), (50, "zebra " * 40_000)]
    docs = make_docs(rows)
    got = pl.score(docs)
    assert got.count() == len(rows)
    source = docs.select("text")
    vocabulary = pl.vocabulary_of(source)
    net, reader = pl.train(source, vocabulary), pl.Reader({w: i for i, (w, _) in enumerate(vocabulary)})
    by = {r["doc_id"]: r for r in got.collect()}
    for i, text in rows[:5]:
        ids = reader(text)
        padded = [pl.SIZE] * 2 + ids.tolist() + [pl.SIZE] * 2
        total = sum(net.forward(np.array([[padded[k], padded[k + 1], padded[k + 3], padded[k + 4]]]), ids[k : k + 1])[0] for k in range(len(ids)))
        assert by[i]["n_words"] == len(ids) and by[i]["pseudo_log_likelihood"] == pytest.approx(total, abs=0.05 + 0.002 * len(ids))
    assert all((by[i]["n_words"], by[i]["pseudo_log_likelihood"], by[i]["per_word"]) == (0, 0, None) for i in (40, 41, 42))
    assert pl.score(make_docs([])).collect() == []
