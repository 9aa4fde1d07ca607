import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import answers, history
from tallyspan.operators.anomalies import Config

NOW = datetime(2026, 7, 30)


@pytest.fixture
def store(spark, tmp_path):
    held = history.Store(spark, f"file://{tmp_path}/store")
    held.add_client("c1", "Acme", datetime(2026, 1, 1), json.dumps({"gap_days": 30, "thresholds": [1000]}))
    held.add_client("c2", "Beta", datetime(2026, 1, 1))
    for n, at in ((1, datetime(2026, 7, 1)), (2, datetime(2026, 7, 20))):
        run = spark.createDataFrame([(f"r{n}", "c1", at, '{"matched": 1}', "{}")], history.SCHEMAS["runs"])
        documents = spark.createDataFrame([(f"d{n}", "c1", f"r{n}", at, f"{n}.csv", bytearray(b"x"))], history.SCHEMAS["documents"])
        held.file_run(run, documents)
    return held


def test_settings_of_a_run_replace_each_other(store):
    assert store.thresholds("c1") == Config(gap_days=30, thresholds=(1000,))
    assert store.thresholds("c1", '{"gap_days": 7}') == Config(gap_days=7)
    assert store.thresholds("c1", "  ") == store.thresholds("c1") and store.thresholds("c2") == store.thresholds(None) == Config()
    with pytest.raises(ValueError, match="gap_dys"):
        store.thresholds("c1", '{"gap_dys": 7}')


def test_runs_and_their_documents(store, spark, tmp_path):
    assert [r.run_id for r in store.runs("c1").collect()] == ["r2", "r1"] and not store.runs("c2").count()
    assert [r.file_name for r in store.documents("r1").collect()] == ["1.csv"] and store.has_documents("r2") and not store.has_documents("r9")
    store.export("c1", f"file://{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/documents").count() == 2 and spark.read.json(f"{tmp_path}/out/clients").count() == 1
    with pytest.raises(ValueError, match="negative"):
        store.purge_older("c1", -1, NOW)
    assert store.purge_older("c1", 15, NOW) == 1 and not store.has_documents("r1") and store.runs("c1").count() == 2


def test_answers_of_models(spark):
    texts = ['[{"date": "1/7/26", "debit": "5"}]', 'Sure:\n```json\n{"rows": [{"date": "2/7/26"}, {"date": "x"}]}\n```', "[]", "none", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r.x for r in rows.select(answers.rows_of(F.col("t"), strict=False).alias("x")).collect()]
    assert [x and [r.date for r in x] for x in found] == [["1/7/26"], ["2/7/26", "x"], [], None, None] and found[0][0].debit == "5"
    said = spark.createDataFrame([('ok {"is_match": true, "confidence": 0.8, "reasoning": "a {b}"}',)], "t string")
    assert said.select(answers.confirmation_of(F.col("t")).alias("x")).first().x == (True, 0.8, "a {b}")
    for read in (answers.rows_of, answers.confirmation_of):
        with pytest.raises(Exception, match="no JSON"):
            rows.where("t = 'none'").select(read(F.col("t"))).collect()
