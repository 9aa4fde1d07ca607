"""The nearest plausible row against every pair."""

import random
import time
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest

from tallyspan.operators import nearest


def brute(cents, days, of_cents, of_days, order):
    out = []
    for c, d in zip(cents, days, strict=True):
        fits = [(abs(e - d), o, i) for i, (b, e, o) in enumerate(zip(of_cents, of_days, order, strict=True)) if abs(b - c) * 50 <= max(50 * 50_000, abs(b), abs(c))]
        out.append(min(fits)[2] if fits else -1)
    return out


@pytest.mark.parametrize("seed, top, span", [(1, 60_000, 10), (2, 10_000_000, 400), (3, 3_000_000, 3)])
def test_equals_every_pair(seed, top, span):
    rng = random.Random(seed)
    make = lambda n: (np.array([rng.randrange(-top, top) for _ in range(n)]), np.array([rng.randrange(span) for _ in range(n)]))
    (cents, days), (of_cents, of_days) = make(300), make(211)
    order = np.array(rng.sample(range(1000), 211))
    best, _ = nearest.nearest_in(cents, days, of_cents, of_days, order)
    assert best.tolist() == brute(cents.tolist(), days.tolist(), of_cents.tolist(), of_days.tolist(), order.tolist())


def test_a_dense_day_is_not_quadratic():
    rng = np.random.default_rng(4)
    cents, days = rng.integers(2_400_000, 2_450_000, 100_000), np.zeros(100_000, np.int64)
    began = time.time()
    best, gap = nearest.nearest_in(cents, days, cents[::-1].copy(), days, np.arange(100_000))
    assert time.time() - began < 20 and (best >= 0).all() and not gap.any()


def test_rows_meet_over_steps_spans_and_signs(spark):
    rng = random.Random(5)
    some = lambda n: [(Decimal(rng.choice([rng.randrange(-60_000, 60_000), rng.randrange(-9_000_000, 9_000_000)])) / 100, date(2020, 1, 1) + timedelta(rng.choice([rng.randrange(20), rng.randrange(3000)]))) for _ in range(n)]
    rows, others = some(150), [(*r, i, f"said {i}") for i, r in enumerate(some(90))]
    left = spark.createDataFrame([*rows, rows[0], (None, rows[0][1]), (rows[0][0], None)], "amount decimal(18,2), date date")
    right = spark.createDataFrame([*others, (None, None, 999, None)], "amount decimal(18,2), date date, ord long, description string")
    got = {(r.amount, r.date): r.near.description for r in nearest.nearest_plausible(left, right).collect()}
    plain = brute([int(a * 100) for a, _ in rows], [d.toordinal() for _, d in rows], [int(o[0] * 100) for o in others], [o[1].toordinal() for o in others], [o[2] for o in others])
    assert got == {r: f"said {others[i][2]}" for r, i in zip(rows, plain, strict=True) if i >= 0}
    assert nearest.nearest_plausible(left.limit(0), right).count() == 0 == nearest.nearest_plausible(left, right.limit(0)).count()
