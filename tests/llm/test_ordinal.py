import numpy as np
from pyspark.sql import functions as F

from hazegrid.llm import ordinal
from hazegrid.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_grades(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = ordinal.train(docs, labels.where("doc_id % 3 > 0"))
    assert np.all(np.diff(model.thresholds) > 0)
    held = ordinal.score(docs, model).join(ordinal.grades_of(labels.where("doc_id % 3 = 0")), "doc_id")
    r = held.agg(*[F.avg(F.when(F.col("grade") == g, F.col("kept").cast("int"))).alias(f"g{g}") for g in (0, 1, 2)], F.corr("grade", "expected_grade").alias("c")).first()
    assert r["g2"] > 0.96 and r["g1"] < 0.3 and r["c"] > 0.7


def test_gradient_and_probabilities():
    rows = [np.array([1, 2]), np.array([2, 3]), np.array([1, 3]), np.array([4])] * 25
    grades = np.array([0, 1, 2, 2] * 25)
    model = ordinal.fit(rows, grades, bits=4, least_chi2=0.0)
    score = np.array([model.weights[r].sum() for r in rows])
    p = model.probabilities(score)
    assert np.allclose(p.sum(axis=1), 1) and np.all(p >= 0) and np.array_equal(p.argmax(axis=1), grades)


def test_odd_rows(make_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert {(r["doc_id"], r["grade"]) for r in ordinal.grades_of(labels).collect()} == {(1, 1), (2, 0)}
    docs = make_docs([(1, "good words here"), (2, None), (2, ""), (None, "x" * 100_000), (1, "good words here")])
    model = ordinal.train(docs, labels)
    got = ordinal.score(docs, model)
    assert got.count() == 5 and got.columns.count("kept") == 1 and "host" in got.columns
    empty = [r for r in got.collect() if not r["text"]]
    assert all(r["expected_grade"] == 0 and r["tail_probability"] == 0 and r["kept"] is False for r in empty)
    assert ordinal.train(docs, labels.limit(0)) is None
    assert [r["kept"] for r in ordinal.score(docs, None).orderBy("doc_id").collect()].count(True) == 3
    assert ordinal.score(make_docs([]), model).count() == 0
