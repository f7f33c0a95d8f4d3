import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions import series
from riskspark.operators import context, graph, network, profile, registry, temporal
from riskspark.sources import tables
from riskspark.streaming import online

AS_OF = "2024-03-01 00:00:00"
TX = ("transaction_id long, customer_id long, product_type string, transaction_type string, amount double, beneficiary_id long, "
      "channel string, device_id string, ip_address string, location_lat double, location_lon double, timestamp timestamp_ntz, status string")


def tx_rows(n=300, customers=25, devices=12, seed=3):
    r, base = random.Random(seed), datetime(2024, 2, 1)
    out = []
    for i in range(n):
        device = "busy" if r.random() < 0.35 else f"d{r.randrange(devices)}"
        out.append((i, r.randrange(customers), "pix", "transfer", round(r.uniform(1, 90), 2), r.randrange(customers), "atm",
                    device, f"ip{i % 5}", r.choice([-23.5, -23.1, 10.0, 0.0]) + r.randrange(9) / 7,
                    r.choice([-46.6, 179.6, -179.7, 0.0]) + r.randrange(9) / 30, base + timedelta(minutes=r.randrange(40000)), "approved"))
    return out


@pytest.fixture(scope="module")
def rows():
    return tx_rows()


@pytest.fixture(scope="module")
def tx(spark, rows):
    return spark.createDataFrame(rows, TX)


@pytest.mark.parametrize("many", [0, 1, 2, 8])
def test_device_sharing_is_exact_both_ways(tx, rows, many):
    users, owned = defaultdict(set), defaultdict(set)
    for x in rows:
        users[x[7]].add(x[1])
        owned[x[1]].add(x[7])
    got = {r["customer_id"]: r for r in network.device_sharing(tx, AS_OF, many_devices=many).collect()}
    assert len(got) == len(owned)
    for c, mine in owned.items():
        assert got[c]["customers_sharing_devices"] == len(set().union(*(users[d] for d in mine)) - {c})
        assert got[c]["max_customers_per_device"] == max(len(users[d]) for d in mine)
        assert got[c]["unique_devices_used"] == len(mine)


def test_device_pairs_of_chosen_customers(tx, rows):
    users = defaultdict(set)
    for x in rows:
        users[x[7]].add(x[1])
    members = graph.device_members(tx)
    have = defaultdict(set)
    for r in members.collect():
        have[r["device_id"]].add(r["customer_id"])
        assert r["device_users"] == len(users[r["device_id"]])
    assert dict(have) == {d: c for d, c in users.items() if d is not None and len(c) > 1}
    chosen = {x[1] for x in rows[::7]}
    want = defaultdict(int)
    for c in have.values():
        for a in c:
            for b in c:
                if a < b and {a, b} & chosen:
                    want[a, b] += 1
    got = graph.device_pairs(members, tx.select("customer_id").where(F.col("customer_id").isin(list(chosen))))
    assert {(r["src"], r["dst"]): r["shared_devices"] for r in got.collect()} == dict(want)


def test_no_relationship_is_lost_on_a_busy_device(spark):
    tx = spark.range(1200).selectExpr(
        "id AS transaction_id", "id AS customer_id", "CAST(NULL AS BIGINT) AS beneficiary_id", "'pix' AS product_type", "1.0D AS amount",
        "'hub' AS device_id", "TIMESTAMP_NTZ '2024-01-30 10:00:00' AS timestamp")
    tx = tx.unionByName(tx.withColumn("device_id", F.expr("concat('d', customer_id div 2)")))
    rows = graph.relationships(tx).collect()
    assert len(rows) == 2400 and {r["strength"] for r in rows if r["device_id"] == "hub"} == {1199}
    assert graph.device_pairs(graph.device_members(tx), spark.range(1).withColumnRenamed("id", "customer_id")).count() == 1199
    counts = network.device_sharing(tx, AS_OF).collect()
    assert {r["customers_sharing_devices"] for r in counts} == {1199}


@pytest.mark.parametrize("cell", [0.05, 0.5, 20.0])
def test_nearest_location_matches_all_pairs(tx, rows, cell):
    as_of = "2024-02-12 00:00:00"
    cut = datetime(2024, 2, 12)
    got = {r[0]: r[1] for r in context.nearest_usual_location(tx, tx, as_of, cell_degrees=cell).collect()}

    def km(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        return 6371 * np.arccos(np.clip(np.cos(a) * np.cos(c) * np.cos(d - b) + np.sin(a) * np.sin(c), -1, 1))

    for x in rows:
        known = [(y[9], y[10]) for y in rows if y[1] == x[1] and y[11] <= cut]
        want = 1000.0 if not known else 0.0 if (x[9], x[10]) in known else min(km(x[9], x[10], *k) for k in known)
        assert got[x[0]] == pytest.approx(want, abs=1e-3)


def test_missing_and_zero_coordinates(spark):
    base = (1, 7, "pix", "transfer", 5.0, 1, "atm", "d", "i")
    rows = [(*base, 0.0, 0.0, datetime(2024, 2, 1), "approved"), (2, *base[1:], None, 3.0, datetime(2024, 2, 2), "approved"),
            (3, 8, *base[2:], 0.0, 0.0, datetime(2024, 2, 20), "approved")]
    df = spark.createDataFrame(rows, TX)
    got = {r[0]: r[1] for r in context.nearest_usual_location(df, df.where("customer_id = 7"), AS_OF).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1000.0}


@pytest.mark.parametrize("cuts", [1, 3, 10])
def test_same_day_history_does_not_depend_on_the_cut(spark, cuts):
    rows = tx_rows(240, 4)
    rows = [(*x[:11], datetime(2024, 2, 1) + (x[11] - datetime(2024, 2, 1)) / 9, x[12]) for x in rows]
    tx = spark.createDataFrame(rows, TX).cache()
    whole = {tuple(r) for r in context.same_day_history(tx).collect()}
    assert max(n for _, n, _ in whole) > 5
    parts = [tx.where(F.col("transaction_id") % cuts == k) for k in range(cuts)]
    assert {tuple(r) for p in parts for r in context.same_day_history(p, tx).collect()} == whole
    later = sorted(rows, key=lambda x: x[11])[120][11]
    fresh = context.same_day_history(tx.where(F.col("timestamp") >= F.lit(later)), tx.where(F.col("timestamp") < F.lit(later)))
    assert {tuple(r) for r in fresh.collect()} <= whole
    assert context.same_day_history(tx.limit(0), tx).count() == 0


def test_same_day_history_first_and_zero_minutes(spark):
    t = datetime(2024, 2, 5, 10)
    rows = [(i, 1, "pix", "transfer", 1.0, 1, "atm", "d", "i", None, None, ts, "approved")
            for i, ts in enumerate([t, t, t + timedelta(seconds=20), t + timedelta(days=1)])]
    got = {r["transaction_id"]: (r["minutes_since_last_transaction"], r["transactions_today"])
           for r in context.same_day_history(spark.createDataFrame(rows, TX)).collect()}
    assert got == {0: (1440, 0), 1: (1440, 0), 2: (0, 2), 3: (1440, 0)}


def test_typed_defaults_and_age(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "id long, i int, d double, b boolean, s string")
    assert tuple(profile.fill_typed_defaults(df).first())[1:] == (0, 0.0, False, "")
    births = spark.createDataFrame([("2000-02-29",), ("2000-03-01",), ("2000-03-02",)], "d string").withColumn("d", F.to_date("d"))
    ages = [r[0] for r in births.select(profile.age_years(F.col("d"), AS_OF)).collect()]
    assert ages == [24, 24, 23]


def test_rolling_single_row_and_empty_window(spark):
    rows = [(1, 1, "pix", "transfer", 10.0, 2, "atm", "d", "i", None, None, datetime(2023, 1, 1), "approved"),
            (2, 2, "pix", "transfer", 10.0, 2, "atm", "d", "i", None, None, datetime(2024, 2, 29, 23, 30), "approved")]
    got = {r["customer_id"]: r for r in temporal.rolling_windows(spark.createDataFrame(rows, TX), AS_OF).collect()}
    assert got[1]["90D_transaction_count"] == 0 and got[1]["90D_repeat_beneficiary_rate"] == 1.0
    assert got[2]["1H_std_amount"] == 0.0 and got[2]["1H_repeat_beneficiary_rate"] == 0.0


def test_online_batch_matches_direct_fold_across_chunks(tx, rows):
    got = {r["transaction_id"]: r for r in online.online_features_batch(tx, chunk_rows=128).collect()}
    one = [(*x[:1], 5, *x[2:]) for x in rows]
    hot = {r["transaction_id"]: r for r in online.online_features_batch(tx.withColumn("customer_id", F.lit(5)), chunk_rows=128).collect()}
    gaps, last = [], None
    for n, x in enumerate(sorted(one, key=lambda y: (y[11], y[0])), 1):
        if last is not None:
            gaps.append((x[11] - last).total_seconds() / 3600)
        last, recent = x[11], gaps[-100:]
        r = hot[x[0]]
        assert r["total_transactions"] == n
        assert r["median_inter_transaction_hours"] == pytest.approx(np.median(recent) if recent else 0)
        assert r["std_inter_transaction_hours"] == pytest.approx(np.std(recent) if recent else 0)
    assert len(got) == len(rows)


def test_wavelet_invariants():
    flat = series.wavelet_bands(np.ones(64))
    assert all(np.allclose(d, 0, atol=1e-12) for d in flat[1:])
    x = np.random.default_rng(0).poisson(2, 100).astype(float)
    bands = series.wavelet_bands(x)
    assert [len(b) for b in bands] == [14, 14, 22, 37, 67]


def test_seasonal_parts():
    t = np.arange(60)
    weekly = np.where(t % 7 == 2, 6.0, -1.0)
    seasonal, trend = series.seasonal_trend(10 + 0.3 * t + weekly)
    assert np.allclose(trend, 10 + 0.3 * t, atol=0.2)
    assert np.allclose(seasonal, weekly, atol=0.2)


def test_dominant_period():
    t = np.arange(240)
    period, share = series.dominant_period(5 + np.sin(2 * np.pi * t / 24))
    assert period == 24 and share == pytest.approx(1.0)


def test_classical_and_change_points_on_step(spark):
    rows, start = [], datetime(2024, 1, 1)
    for d in range(40):
        rows.append((d, 1, "pix", "transfer", 10.0 if d < 20 else 30.0, 2, "atm", "d", "i", None, None, start + timedelta(days=d), "approved"))
    got = temporal.change_points(spark.createDataFrame(rows, TX)).first()
    x = np.array([r[4] for r in rows])
    up = down = 0.0
    hits = []
    for i in range(1, 40):
        up, down = max(0, up + x[i] - x.mean() - .5), min(0, down + x[i] - x.mean() + .5)
        if i < 39 and (up > 5 or -down > 5):
            hits.append(i)
    assert got["changepoints_detected"] == len(hits)
    assert got["time_since_last_changepoint_days"] == 39 - hits[-1]


def test_validation_splits_rows(spark):
    rows = [("1", "a", 5.0, "pix", "atm", None, None), ("2", "a", 0.0, "pix", "atm", "USD", None), ("3", None, 5.0, "pix", "atm", None, None),
            ("4", "a", 5.0, "gold", "atm", None, None), ("5", "a", 5.0, "pix", None, None, None)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, amount double, product_type string, channel string, currency string, timestamp timestamp_ntz")
    valid, bad = tables.validate_transactions(df, AS_OF)
    good = valid.collect()
    assert [r["transaction_id"] for r in good] == ["1"] and good[0]["currency"] == "BRL" and str(good[0]["timestamp"]) == AS_OF
    assert {r["transaction_id"]: r["reject_reason"] for r in bad.collect()} == {
        "2": "amount_not_positive", "3": "missing_customer_id", "4": "unknown_product", "5": "missing_channel"}


def test_table_modes(spark, tmp_path):
    df, place = spark.range(3), str(tmp_path / "t")
    tables.write_table(df, place, "fail")
    with pytest.raises(Exception):
        tables.write_table(df, place, "fail")
    tables.write_table(df, place, "append")
    assert tables.read_table(spark, place, "parquet").count() == 6
    tables.write_table(df, place, "replace")
    assert tables.read_table(spark, place, "parquet").count() == 3


def test_registry_builds_only_rows_past_their_time_to_live(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "customer_id long, v double")
    reg = registry.FeatureRegistry()
    reg.register("p", lambda i: rows, description="test", dependencies=("customers",), ttl_seconds=600)
    given = registry.Inputs(rows, None, None, None, None, None, AS_OF)
    definition, = reg.definitions(given)
    assert (definition.data_type, definition.dependencies, definition.ttl_seconds) == ("double", ("customers",), 600)
    at = datetime(2024, 3, 1)
    stored = spark.createDataFrame([(1, 1.0, at - timedelta(minutes=5)), (2, 2.0, at - timedelta(minutes=15))],
                                   "customer_id long, v double, computed_at timestamp_ntz")
    got = {r["customer_id"]: r["v"] for r in reg.refreshed("p", stored, rows.select("customer_id"), given).collect()}
    assert got == {1: 1.0, 2: 20.0, 3: 30.0}
