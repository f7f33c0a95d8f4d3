"""Bucketed running totals, ranks and percentiles against plain computation, with a hot key."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions.quantiles import exact_percentiles
from riskspark.functions.times import HOUR_US, micros
from riskspark.plans.fixpoint import connected_components
from riskspark.plans.running import asof_sums, ranked, running, strictly_before

START = datetime(2024, 1, 1)


def history(n=600, seed=1):
    """Half of the rows belong to one key; times repeat."""
    r = random.Random(seed)
    return [(i, "hot" if r.random() < 0.5 else f"k{r.randrange(6)}", START + timedelta(minutes=r.randrange(0, 4000) // 7 * 7),
             round(r.uniform(-5, 500), 2)) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return history()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, timestamp timestamp_ntz, amount double").repartition(5)


@pytest.mark.parametrize("bucket", [HOUR_US // 4, 30 * HOUR_US])
def test_running_matches_ordered_fold(df, rows, bucket):
    out = {r["id"]: r for r in running(df, ["key"], "timestamp", ["id"], sums={"n": F.lit(1), "total": F.col("amount")},
                                       lags={"prev": F.col("id")}, bucket_us=bucket).collect()}
    state = {}
    for i, k, t, a in sorted(rows, key=lambda x: (x[2], x[0])):
        n, total, prev = state.get(k, (0, 0.0, None))
        assert out[i]["n"] == n + 1
        assert out[i]["total"] == pytest.approx(total + a)
        assert out[i]["prev"] == prev
        state[k] = (n + 1, total + a, i)


def test_strictly_before_leaves_equal_times_out(df, rows):
    out = {r["id"]: r for r in strictly_before(df, ["key"], "timestamp", counts="n", latest="last", bucket_us=HOUR_US).collect()}
    for i, k, t, _ in rows:
        earlier = [x for x in rows if x[1] == k and x[2] < t]
        assert out[i]["n"] == len(earlier)
        want = max((x[2] for x in earlier), default=None)
        assert out[i]["last"] == (None if want is None else int((want - datetime(1970, 1, 1)).total_seconds() * 1e6))


def test_asof_sums_at_and_before(spark, df, rows):
    probes = spark.createDataFrame([(p, k, START + timedelta(minutes=m), inc) for p, (k, m, inc) in enumerate(
        (k, m, inc) for k in ("hot", "k1", "absent") for m in (-5, 7, 700, 1400, 9000) for inc in (True, False))],
        "pid long, key string, at timestamp_ntz, inclusive boolean")
    out = {r["pid"]: r for r in asof_sums(
        df.select("key", micros("timestamp").alias("us"), "amount"), probes.select("pid", "key", micros("at").alias("us2"), "inclusive"),
        ["key"], event_us="us", probe_us="us2", inclusive="inclusive", sums={"n": F.lit(1), "s": F.col("amount")},
        bucket_us=HOUR_US).collect()}
    for p in probes.collect():
        hit = [x for x in rows if x[1] == p["key"] and (x[2] <= p["at"] if p["inclusive"] else x[2] < p["at"])]
        assert out[p["pid"]]["n"] == len(hit)
        assert out[p["pid"]]["s"] == pytest.approx(sum(x[3] for x in hit))


def test_ranked(df, rows):
    out = {r["id"]: r["rank"] for r in ranked(df, ["key"], "amount", ["id"]).collect()}
    for k in {x[1] for x in rows}:
        for place, (a, i) in enumerate(sorted((x[3], x[0]) for x in rows if x[1] == k), 1):
            assert out[i] == place


def test_percentiles_exact(df, rows):
    got = {r["key"]: r for r in exact_percentiles(df, ["key"], "amount", {"p5": 0.05, "p50": 0.5, "p95": 0.95, "near": 0.95},
                                                  nearest={"near"}).collect()}
    for k in {x[1] for x in rows}:
        values = sorted(x[3] for x in rows if x[1] == k)
        for name, p in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95)):
            assert got[k][name] == pytest.approx(np.quantile(values, p))
        assert got[k]["near"] == values[min(int(0.95 * len(values)), len(values) - 1)]


def test_percentile_without_key(df, rows):
    assert exact_percentiles(df, [], "amount", {"q": 0.9}).first()["q"] == pytest.approx(np.quantile([x[3] for x in rows], 0.9))


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    out = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {out[i] for i in range(41)} == {0}
    assert {out[100 + i] for i in range(30)} == {100}


def test_tables_on_the_way_are_deleted(spark):
    from pathlib import Path
    from riskspark.plans import fixpoint
    from riskspark.session import ensure_checkpoint_dir
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))

    def files():
        return {p for p in folder.rglob("part-*") if p.is_file()}

    def make():
        a = fixpoint.cut(spark.range(100).repartition(3))
        b = fixpoint.written(a.selectExpr("id", "id % 7 AS k"))
        return a.join(b, "id").groupBy("k").count()

    before = files()
    out = fixpoint.settled(spark, make)
    kept = files() - before
    assert {Path(p.removeprefix("file://")).name for p in out.inputFiles()} == {p.name for p in kept}
    assert sorted(r["count"] for r in out.collect()) == [14, 14, 14, 14, 14, 15, 15]
    with fixpoint.held(spark.range(5)) as rows:
        assert rows.count() == 5 and files() - before > kept
    assert files() - before == kept


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    from riskspark.session import prepare
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    prepare(spark)
    before = tracker.shuffleStatuses().size()
    for i in range(3):
        spark.range(1000).repartition(4, "id").write.parquet(str(tmp_path / str(i)))
    assert tracker.shuffleStatuses().size() <= before
