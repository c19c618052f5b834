"""Queries that write steps, on a session that has the master of a cluster and no folder with a scheme, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import connect, digest
from fitweave.session import owned_steps

#: Small tables in which every query of QUERIES finds rows.
WORDS = "['erin', 'thhe', 'thor', 'thst', 'erly', 'erble', 'thre', 'onan', 'eres', 'wh', 'qui', 'zu', 'thti', 'thnd', 'erat', 'thly', 'a', 'note', 'team', 'er.' || chr(10)]"
TEXT = f"array_to_string([({WORDS})[1 + (i * 7 + j * (3 + i % 5)) % 20] for j in range(40)], ' ')"
TABLES = {
    "documents": f"SELECT i AS doc_id, {TEXT} AS text, 'en' AS lang, 'src' || i % 4 AS source, 100::BIGINT AS n_chars FROM range(40) t(i)",
    "pages": "SELECT i AS page_id, 'https://h' || i % 3 || '.example.com/p' || i % 4 || '/' || i % 11 AS url, '<p>Page ' || i || '</p>' AS html FROM range(40) t(i)",
    "conversations": f"SELECT i // 2 AS conv_id, i % 2 AS turn, CASE i % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS role, {TEXT} AS text FROM range(40) t(i)",
    "benchmark": f"SELECT i AS item_id, {TEXT} AS text FROM range(12) t(i)",
    "customer": "SELECT i AS c_custkey, 'Customer#' || i AS c_name, (i % 5)::INTEGER AS c_nationkey, 1.5 * i AS c_acctbal, 'AUTO' AS c_mktsegment FROM range(20) t(i)",
    "part": "SELECT i AS p_partkey, 'red ' || i % 9 AS p_name, 'Brand#' || i % 3 AS p_brand, 'TYPE ' || i % 4 AS p_type, (i % 50)::INTEGER AS p_size, 10.0 + i AS p_retailprice FROM range(30) t(i)",
    "orders": "SELECT i AS o_orderkey, i % 20 AS o_custkey, 'F' AS o_orderstatus, 100.0 * i AS o_totalprice, TIMESTAMP '2000-10-01' + INTERVAL 2 DAY * i AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(60) t(i)",
    "lineitem": "SELECT i // 3 AS l_orderkey, i * 7 % 30 AS l_partkey, i % 20 AS l_suppkey, (i % 3 + 1)::INTEGER AS l_linenumber, 1.0 AS l_quantity, 'R' AS l_returnflag FROM range(180) t(i)",
    "supplier": "SELECT i AS s_suppkey, 'Supplier#' || i AS s_name FROM range(20) t(i)",
    "events": "SELECT i AS event_id, i % 9 AS user_id, 'view' AS event_type, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * i AS ts, 1.0 * i AS value FROM range(60) t(i)",
}
QUERIES = [
    "d3_greedy_dedup",
    "d4_d5_pages",
    "d4_next_page",
    "f1_f4_matches",
    "f1_keywords",
    "f1_keywords_by_grams",
    "k10_shortlist_order",
    "k5_large_vocabulary",
    "k7_compare",
    "k7_comparison_lists",
    "k8_text_rank",
    "k9_coverage_rank",
    "k9_coverage_rank_filled",
    "p3_resources",
    "r10_r11_evidence",
    "r12_alternatives",
    "r13_summary",
    "r14_gaps",
    "r8_requirements",
    "s12_document_files",
    "s14_report",
    "s14_report_files",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, rows in TABLES.items():
        duckdb.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_steps_of_a_cluster(spark, tables, monkeypatch, name):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://head:7077")
    with owned_steps(spark):
        df = entry.queries()[name](spark, tables)
        mine = digest(df.columns, [tuple(row) for row in df.collect()])
    cursor = connect(tables).execute(entry.oracle_sql()[name])
    other = digest([d[0] for d in cursor.description], cursor.fetchall())
    assert mine[1] and mine[:2] == other[:2]
