"""A spread of bound queries against their SQL on the smallest tables (all of them: python tests/compare.py SF_DIR)."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, digest

SF = "/root/testdata/sf0.001"
SPREAD = ["k5_mentions", "k6_coverage", "r2_r3_priorities", "l1_looks_english", "c5_c6_identifiers", "c5_phones", "c2_repeated_edges", "s1_greenhouse", "s4_accounting", "n2_structured_pages",
          "n9_canonical_url", "f1_f4_matches", "d3_greedy_dedup", "d4_d5_pages", "d7_catalogue", "a3_unsupported_numbers", "p1_topics", "t1_schedule_state", "e1_e2_scores"]


def test_every_query_is_listed_once_and_every_oracle_has_a_query():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    # only training-data queries, whose package may be absent, go without SQL
    assert all(name == "pipeline" or name.startswith("op") for name in names - set(entry.oracle_sql()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cursor = connect(SF).execute(entry.oracle_sql()[name])
    mine = digest(df.columns, [tuple(r) for r in df.collect()])
    other = digest([d[0] for d in cursor.description], cursor.fetchall())
    assert mine[0] == other[0] and mine[2] == other[2]
