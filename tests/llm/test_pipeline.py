"""The pipeline's stages on the small tables and on odd rows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from codesieve.llm import decontamination, simhash
from codesieve.llm.common import write_table
from test_decontamination import brute

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's rows, on the documents and odd rows beside them."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = docs.limit(1).select("doc_id", F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    odd = odd.union(docs.limit(1).select(F.lit(None).cast("long"), F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("long")))
    docs = write_table(docs.unionByName(docs.limit(3)).unionByName(odd), "test")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(write_table(stage(spark, out[-1], SF_DIR), f"test-{name}"))
    return out


def test_columns(stages):
    for stage in stages[1:-1]:
        assert stage.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "shard", "slot"]


def test_quality_keeps_most_labelled_good_documents(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    good = stages[0].select("doc_id").distinct().join(labels, "doc_id").count()
    assert stages[1].select("doc_id").distinct().join(labels, "doc_id").count() >= 0.98 * good


def test_one_of_each_near_duplicate_group_stays(stages):
    groups = {r["component_id"] for r in simhash.near_duplicates(stages[1]).collect()}
    assert stages[2].count() == len(groups)
    assert {r["doc_id"] for r in stages[2].collect()} == groups


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    expected = sorted(str(r["doc_id"]) for r in stages[2].collect() if not brute(r["text"], items)[-1])
    assert sorted(str(r["doc_id"]) for r in stages[3].collect()) == expected
    assert decontamination.matched(stages[3], spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).where("contaminated").count() == 0


def test_mixture_holds_only_what_came_in(stages):
    assert stages[4].distinct().join(stages[3].distinct(), "doc_id", "left_anti").where("doc_id IS NOT NULL").count() == 0
    assert stages[4].count() > 0


def test_shards_are_even_and_whole(stages):
    assert stages[5].drop("shard", "slot").exceptAll(stages[4]).count() == 0
    sizes = [r["count"] for r in stages[5].groupBy("shard").count().collect()]
    assert sum(sizes) == stages[4].count() and len(sizes) == 8 and max(sizes) - min(sizes) <= 1


def test_run_on_empty_documents(spark, fresh_dir):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(f"{fresh_dir}/{name}.parquet")
    assert P.run(spark, fresh_dir).count() == 0
