import os
import re

import pytest

import __spark_entry__ as driver
import check
import corpus_pipeline
from vouchermill.llm import jaccard, suffixes
from vouchermill.llm.queries import registry

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_registered():
    names = set(driver.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == set(map(str, range(1, 14)))
    assert "pipeline" in names and set(registry()) < names


@needs_data
@pytest.mark.parametrize("name", [n for n in registry() if n in driver.oracle_sql()])
def test_statement(spark, name):
    db = check.connect(FOLDER)
    rows, problem = check.difference(driver.queries()[name](spark, FOLDER), db, driver.oracle_sql()[name])
    assert rows and problem == ""


@needs_data
@pytest.mark.parametrize("name", [n for n in registry() if n not in driver.oracle_sql()])
def test_query_returns_every_document(spark, name):
    rows = driver.queries()[name](spark, FOLDER)
    assert rows.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert rows.select("doc_id").distinct().count() == rows.count()


@needs_data
def test_stages(spark, tmp_path):
    docs = first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.columns == first.columns or i == 4
        assert 0.5 * before.count() < docs.count() <= before.count()
        if name == "jaccard_join":
            assert jaccard.near_classes(docs).where("n_links > 0").count() == 0
        if name == "suffix_dedup":
            assert docs.count() == before.count()
        if name == "decontamination":
            kept = docs
    assert docs.count() == kept.count()
    assert suffixes.report_repeats(first).where("n_removed > 0").count() > 0


@needs_data
def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
