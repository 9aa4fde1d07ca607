from __future__ import annotations

import os
import sys
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SIDE = "id string, ord long, source string, date date, amount decimal(18,2), description string, reference string, alt_references array<string>"


@pytest.fixture(scope="session")
def side(spark):
    """A side from (id, amount, day, description, reference, other references) rows."""

    def build(source, rows):
        full = [(*r, None, None)[:6] if len(r) < 6 else r for r in rows]
        full = [(*r[:4], r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else None) for r in full]
        return spark.createDataFrame([(i, n, source, date(2026, 7, 1) if d is None else d, Decimal(a), t, ref, alt or []) for n, (i, a, d, t, ref, alt) in enumerate(full)], SIDE)

    return build


def day(n: int) -> date:
    return date(2026, 7, n)
