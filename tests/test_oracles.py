"""Queries against their SQL twins on the smallest data set."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from casegate.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
SOME = [
    "classification_report",
    "classify_text_export",
    "source_line_number",
    "decision_table_join",
    "domain_coverage",
    "manifest_verify",
    "expectation_diff",
    "ledger_fold",
    "illegal_transitions",
    "gate_checks",
    "abort_verify",
    "correspondence",
    "rule_change_diff",
    "stream_classify",
    "stream_ledger_state",
    "stream_visibility_timeout",
    "stream_visibility_watch",
    "stream_intent_first",
]
NAMES = list(contract.oracle_sql()) if os.environ.get("ALL_ORACLES") else SOME
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(all_oracles())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, duck, name):
    frame = contract.queries()[name](spark, SF)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert counted(frame.columns, map(tuple, frame.collect())) == counted(columns, result.fetchall())
