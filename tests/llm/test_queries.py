"""Registered queries against their SQL answers, at the smallest scale."""

import pytest

import corpus_pipeline
from docsieve.llm.catalog import ORACLES, QUERIES
from tests.oracle import check, connect

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [f for _, f in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    problem = check(QUERIES[name](spark, SF_DIR), ORACLES[name], connect(SF_DIR))
    assert problem is None, problem
