import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from spanveil.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["detect_every_spans", "gazetteer", "redact_workbooks", "merge_overlaps", "assign_pseudonyms", "continue_namespace", "redact_documents", "reveal_strict", "reveal_stats", "redact_incremental", "redact_table_nation", "classify_columns", "mime_route", "body_extract_anthropic", "body_apply_openai_chat", "file_rollup", "ttl_live_keys"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR), duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(repr(tuple(x.isoformat() if isinstance(x, datetime.datetime) else x for x in r)) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "redacted", "n_entities"]
    assert {*ORACLE_SQL} <= {*QUERIES} <= {*entry.queries()}


def test_every_pattern_is_met(duck):
    """No detection query is empty on either side."""
    for name in QUERIES:
        if name.startswith("detect_"):
            assert duck.sql(f"SELECT count(*) FROM ({ORACLE_SQL[name]})").fetchone()[0] > 0, name
