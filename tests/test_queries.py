"""Every registered reconciliation query against its SQL, on the smallest tables."""

import os

import pytest

from tallyspan import oracle, registry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


#: One query of each stage: all of them run in the driver's own comparison.
SAMPLE = ("summary", "match_exact", "narration_parse", "dup_payments", "dup_rows", "summary_sheet", "round_numbers", "balance_audit", "layout_parse", "locate_lines", "cell_boxes", "sheet_ingest", "workbook_ingest", "classify_unmatched", "cosine_topk", "semantic_match", "ledger_convention", "anomaly_rows", "anomaly_report", "run_payload", "headline", "model_rows", "model_answers", "mirrored_entries", "match_near", "match_hot_amounts")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    rows = registry.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect())
    found = db.execute(oracle.SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_entry_explains_everything(spark):
    import __spark_entry__

    rows = {r.item: r.amount for r in __spark_entry__.entry(spark).collect()}
    assert rows["UNEXPLAINED"] == 0 and float(rows["Difference to explain"]) == -8116011.45


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", ("match_exact", "unmatched_ledger"))
def test_the_exact_stage_equals_its_sql_in_deep_chains(spark, db, tmp_path, name):
    """Six payments of each amount and day choose one after another."""
    con = db.cursor()
    con.execute(f"COPY (SELECT o.* REPLACE (o_orderkey + i * 1000000 AS o_orderkey) FROM orders o, range(6) t(i)) TO '{tmp_path}/orders.parquet'")
    con.execute(f"COPY customer TO '{tmp_path}/customer.parquet'")
    own = duckdb.connect()
    for table in ("orders", "customer"):
        own.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    rows = registry.QUERIES[name](spark, str(tmp_path))
    found = own.execute(oracle.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect()) == sorted(map(repr, found.fetchall()))
