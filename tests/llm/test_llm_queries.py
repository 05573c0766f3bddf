"""Queries against their SQL twins; the pipeline against plain Python."""

import pytest

import __spark_entry__ as entry
import check_queries
import corpus_pipeline
from shelfwatch.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    assert check_queries.compare(spark, duck, SF, name) == ""


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "shards"]
