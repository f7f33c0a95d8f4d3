"""Features as of each label or transaction against plain Python, and the grid descent."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskspark.operators import point_in_time
from riskspark.plans import nearest
from riskspark.plans.running import stretch_moves

START = datetime(2024, 1, 1)
KEYS = "transaction_id bigint, customer_id bigint, timestamp timestamp_ntz, amount double, status string, location_lat double, location_lon double"


def rows_of(seed, n, customers=3):
    """A hot customer, equal instants, equal amounts, missing values, gaps of exactly one window."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = START + timedelta(minutes=rng.choice([rng.randrange(120 * 24 * 60), 60 * rng.randrange(120 * 24)]))
        out.append((i, rng.choice([1] * customers + list(range(customers))), at, rng.choice([None, 5.0, round(rng.uniform(0, 300), 2), 0.0]),
                    rng.choice(["approved", "approved", "rejected"]), rng.choice([None, 1.5, rng.uniform(-89, 89)]), rng.uniform(-180, 180)))
    out += [(n + k, 1, START + timedelta(days=90 * k), 7.25, "approved", 1.5, 179.9) for k in range(2)]
    return out + [(n + 5, None, START, 1.0, "approved", 1.0, 1.0), (n + 6, 77, START, 3.0, "approved", 2.0, 2.0)]


def before(rows, row, hours=2160):
    return [r for r in rows if r[1] is not None and r[1] == row[1] and row[2] - timedelta(hours=hours) <= r[2] < row[2]]


def test_baseline(spark):
    rows = rows_of(1, 250)
    tx = spark.createDataFrame(rows, KEYS)
    got = {r.transaction_id: r for r in point_in_time.baseline_before(tx, tx).collect()}
    for row in rows:
        amounts = sorted(r[3] for r in before(rows, row) if r[4] == "approved" and r[3] is not None)
        if not amounts:
            assert row[0] not in got
            continue
        r, n = got[row[0]], len(amounts)
        mean, place = sum(amounts) / n, (n - 1) * 0.95
        low, high = amounts[math.floor(place)], amounts[math.ceil(place)]
        assert r.max_amount == amounts[-1] and math.isclose(r.p95_amount, low + (high - low) * (place - math.floor(place)), abs_tol=1e-9)
        assert math.isclose(r.avg_amount, mean, abs_tol=1e-9)
        spread = math.sqrt(sum((a - mean) ** 2 for a in amounts) / (n - 1)) if n > 1 else None
        assert (r.std_amount is None) == (spread is None) and (spread is None or math.isclose(r.std_amount, spread, abs_tol=1e-6))


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 6371 * math.acos(max(-1, min(1, math.cos(a) * math.cos(c) * math.cos(d - b) + math.sin(a) * math.sin(c))))


@pytest.mark.parametrize("few", [128, 0])
def test_location(spark, monkeypatch, few):
    monkeypatch.setattr(nearest, "FEW", few)
    rows = rows_of(2, 200)
    tx = spark.createDataFrame(rows, KEYS)
    for r in point_in_time.location_before(tx, tx).collect():
        row = next(x for x in rows if x[0] == r.transaction_id)
        known = [(x[5], x[6]) for x in before(rows, row) if x[5] is not None]
        want = 0.0 if row[5] is None else 0.0 if (row[5], row[6]) in known else min((km(row[5], row[6], *p) for p in known), default=1000.0)
        assert math.isclose(r.distance_from_usual_location_km, want, abs_tol=1e-3), (row, want)


@pytest.mark.parametrize("spread,few", [(60.0, 4), (0.01, 0)])
def test_nearest_of_many_places(spark, monkeypatch, spread, few):
    monkeypatch.setattr(nearest, "FEW", few)
    rng = random.Random(3)

    def places(n):
        return [(rng.gauss(10, spread) % 80, rng.gauss(179, spread)) for _ in range(n)]

    known, asked = places(600), places(120)
    got = nearest.nearest(spark.createDataFrame([(i, 1, *p) for i, p in enumerate(asked)] + [(999, 2, 0.0, 0.0)],
                                                "probe bigint, customer_id bigint, lat double, lon double"),
                          spark.createDataFrame([(1, *p) for p in known], "customer_id bigint, lat double, lon double"))
    found = {r.probe: r.km for r in got.collect()}
    assert set(found) == set(range(120))
    for i, p in enumerate(asked):
        assert math.isclose(found[i], min(km(*p, *q) for q in known), abs_tol=1e-3)


def test_both_searches_agree(spark, monkeypatch):
    from riskspark.operators import context
    rows = [(i, c, t, a, st, y, x) for i, c, t, a, st, y, x in rows_of(4, 200)]
    tx = spark.createDataFrame(rows, KEYS)
    found = []
    for many in (10 ** 6, 20):
        monkeypatch.setattr(context, "MANY_CELLS", many)
        got = context.nearest_usual_location(tx, tx.where("transaction_id % 2 = 0"), START + timedelta(days=91)).collect()
        found.append({r.transaction_id: round(r.distance_from_usual_location_km, 3) for r in got})
    assert found[0] == found[1] and len(set(found[0].values())) > 20


def test_work_is_near_linear_in_places(spark, monkeypatch):
    """20,000 new places meet 20,000 known ones of one customer: a probe keeps few cells on every level."""
    kept = []
    real = nearest._bounded

    def counted(rows, level):
        out = real(rows, level)
        kept.append(out.count())
        return out

    monkeypatch.setattr(nearest, "_bounded", counted)
    at = [F.rand(s) for s in (1, 2, 3, 4)]
    known = spark.range(20_000).select(F.lit(1).alias("customer_id"), (at[0] * 5).alias("lat"), (at[1] * 5).alias("lon"))
    probes = spark.range(20_000).select(F.col("id").alias("probe"), F.lit(1).alias("customer_id"), (at[2] * 5).alias("lat"), (at[3] * 5).alias("lon"))
    assert nearest.nearest(probes, known).count() == 20_000
    assert 3 < len(kept) <= nearest.LEVELS and max(kept) < 20 * 20_000


@pytest.mark.parametrize("hours", [1, 6])
def test_stretches(spark, hours):
    rng = random.Random(hours)
    times = sorted(rng.randrange(60 * 24 * 3) * 60_000_000 for _ in range(60)) + [0, 3_600_000_000]
    moves = stretch_moves(spark.createDataFrame([("v", t) for t in times], "v string, us bigint"), ["v"], {"w": hours}).collect()
    for t in range(0, 60 * 24 * 4, 7):
        now = t * 60_000_000
        alive = sum(m.d for m in moves if m.us < now)
        assert alive == int(any(now - hours * 3_600_000_000 <= x < now for x in times))
    spans = defaultdict(list)
    for m in moves:
        spans[m.stretch].append(m.d)
    assert all(sorted(d) == [-1, 1] for d in spans.values())


def test_no_row_at_or_after_the_label_counts(spark):
    """Adding rows at and after a label changes nothing of its features."""
    from riskspark.operators import registry, training
    from riskspark.sources.driver import AS_OF, DriverTables
    t = DriverTables(spark, "/root/testdata/sf0.001")
    labels = t.fraud_labels().where("customer_id < 4")
    border = labels.agg(F.min("label_timestamp")).first()[0] + timedelta(days=6)
    early = labels.where(F.col("label_timestamp") <= F.lit(border))

    def features(keep):
        tx, ev = t.transactions(), t.customer_events()
        if not keep:
            tx, ev = (df.where(F.col("timestamp") < F.lit(border)) for df in (tx, ev))
        given = registry.Inputs(t.customers(), tx, ev, t.customer_products(), t.risk_profile(), t.fraud_records(), AS_OF)
        return sorted(map(str, training.hub_training_set(early, given, AS_OF).collect()))

    whole = features(True)
    assert whole and whole == features(False)


def test_packed_counts_add_up_with_their_signs(spark):
    names = ["a", "b", "c"]
    rows = [(a + b * point_in_time.PACK, c) for a, b, c in ((3, -5, 7), (-4, 2, -9), (2_000_000_000, 2_000_000_000, 0), (0, 5, 2))]
    df = spark.createDataFrame(rows, "p0 long, p1 long").agg(F.sum("p0").alias("p0"), F.sum("p1").alias("p1"))
    assert tuple(df.select(*point_in_time.unpacked(names)).first()) == (1_999_999_999, 2_000_000_002, 0)


def test_moves_of_distinct_values_are_made_once(spark):
    """Running totals read them twice, from a stored table."""
    seen = spark.createDataFrame([(1, "a", str(i % 7), i * 10 ** 9) for i in range(50)], "customer_id long, kind string, value string, us long")
    probes = spark.createDataFrame([(1, 25 * 10 ** 9 + 1)], "customer_id long, us long")
    found = point_in_time.distinct_before(probes, ["customer_id", "us"], seen, {"a": {"1h": 1, "6h": 6}})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [customer_id") == 2 and "Generate" not in plan
    assert found.first()["a_1h"] == 4 and found.first()["a_6h"] == 7
