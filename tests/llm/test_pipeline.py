import public_tokenizers
import pytest
from test_hyperminhash import brute as all_pairs
from test_suffixes import brute as all_strings

import __spark_entry__ as contract
import corpus_pipeline
from hazegrid.llm import bpe, decontamination, ordinal
from hazegrid.llm.common import table
from hazegrid.llm.queries import ORACLES, QUERIES
from oracle_check import duck, frames_equal

SF = "/root/testdata/sf0.001"


def test_each_stage_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        after = spark.createDataFrame(result.collect(), result.schema)
        before = {r["doc_id"]: r for r in docs.collect()}
        kept = {r["doc_id"]: r for r in after.collect()}
        if name != "byte-level BPE":
            assert after.columns == docs.columns
        if name == "quality classifier":
            model = ordinal.train(docs, table(spark, SF, "labels"))
            assert set(kept) == {r["doc_id"] for r in ordinal.score(docs, model).where("tail_probability >= 0.4").collect()}
        elif name == "near duplicates":
            groups = all_pairs([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert set(kept) == {i for i, (_, least) in groups.items() if i == least}
        elif name == "suffix-array dedup":
            rows = [(i, r["text"]) for i, r in before.items()]
            for (i, text), (size, gone, _, _) in zip(rows, all_strings(rows, 200), strict=True):
                assert kept[i]["n_chars"] == len(kept[i]["text"])
                assert (kept[i]["text"] == text) if not gone else size - gone - 6 <= len(kept[i]["text"].encode()) <= size - gone
        elif name == "benchmark decontamination":
            found = decontamination.contaminated(docs, table(spark, SF, "benchmark"))
            assert set(kept) == set(before) - {r["doc_id"] for r in found.collect()}
        else:
            codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
            assert {i: r["n_tokens"] for i, r in kept.items()} == {i: len(codec.encode(r["text"])) for i, r in before.items()}
        docs = after


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert frames_equal(QUERIES[name](spark, SF).toPandas(), duck(SF).execute(ORACLES[name]).df()) is None


def test_registered():
    assert {f"op{n}_" for n in range(1, 11)} == {n.split("_")[0] + "_" for n in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
