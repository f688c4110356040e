import math
import random
import zlib
from datetime import datetime, timedelta

from subsidia.llm import asof_join
from tests.compare import connection, same

EPOCH, HOUR = datetime(1970, 1, 1), asof_join.HOUR
CLICKS = "click_id long, ts timestamp_ntz, client_id long"
SALES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int"


def at(hours, micros=0):
    return datetime(2024, 1, 1) + timedelta(hours=hours, microseconds=micros)


def used(when, name):
    if when is None:
        return None
    t = (when - EPOCH) // timedelta(microseconds=1)
    return t // (6 * HOUR) * 6 * HOUR if name is not None and zlib.crc32(str(name).encode()) % 2 else t


def brute(clicks, sales):
    orders = []
    for name, client, total, sold, _ in sales:
        cents = None if total is None or not math.isfinite(total) else math.floor(100 * total + 0.5)
        twins = [name, -1 - name] if zlib.crc32(str(name).encode()) % 3 else [name]
        orders += [(client, used(sold, name), cents, x) for x in twins]
    out = []
    for name, ts, client in {c[0]: c for c in clicks}.values():
        t = used(ts, name)
        near = [o for o in orders if client is not None and o[0] == client and t is not None and o[1] is not None and 0 <= t - o[1] <= 720 * HOUR]
        last = max((o[1] for o in near), default=None)
        tied = [o for o in near if o[1] == last]
        best = max(tied, key=lambda o: (o[2] is not None, o[2] or 0, o[3]), default=None)
        out.append((name, client, t, *((best[3], t - last, best[2]) if best else (None,) * 3), len(tied)))
    return sorted(out, key=str)


def drawn(n, hot):
    rng = random.Random(n)
    who = lambda: None if rng.random() < 0.03 else 1 if rng.random() < hot else rng.randrange(8)
    when = lambda: None if rng.random() < 0.03 else at(rng.choice((rng.randrange(4000), rng.randrange(100) / 10, 900)), rng.choice((0, rng.randrange(10**6))))
    clicks = [(i, when(), who()) for i in range(n)]
    clicks += rng.sample(clicks, n // 10)
    sales = [(i, who(), rng.choice((None, math.nan, math.inf, 1.005, 20.0, 20.0, rng.random() * 100)), when(), 1) for i in range(n // 4)]
    return clicks, sales


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    for hot, size in ((0.1, 1 << 15), (0.9, 10), (0.5, 2)):
        clicks, sales = drawn(400, hot)
        monkeypatch.setattr(asof_join.latest, "__defaults__", (asof_join.TOLERANCE, size))
        got = asof_join.click_orders(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES))
        assert rows(got) == brute(clicks, sales)
        assert sum(r["n_tied"] > 0 for r in got.collect()) > 100


def test_equals_its_sql(spark, sf_dir):
    same(asof_join.click_orders(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "sales"))), connection(sf_dir), asof_join.click_sql())


def test_bounds_of_the_tolerance(spark):
    a, b = (next(i for i in range(n, n + 99) if zlib.crc32(str(i).encode()) % 6 == 0) for n in (1, 100))
    sales = spark.createDataFrame([(a, 5, 1.0, at(0), 1)], SALES)
    names = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 2 == 0][:4]
    clicks = [(names[0], at(720), 5), (names[1], at(720, 1), 5), (names[2], at(0), 5), (names[3], at(0, -1), 5)]
    got = {r["click_id"]: (r["sale_id"], r["lag_us"]) for r in asof_join.click_orders(spark.createDataFrame(clicks, CLICKS), sales).collect()}
    assert got == {names[0]: (a, 720 * HOUR), names[1]: (None, None), names[2]: (a, 0), names[3]: (None, None)}
    assert b != a


def test_empty_tables_and_other_columns(spark):
    clicks, sales = drawn(60, 0.4)
    c, s = spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES)
    names = ("client", "t", "best", "n", "shard", "piece", "h", "id", "weight", "at", "ts_us", "held", "knots")
    wide = [df.selectExpr("*", *(f"'z' AS `{x}`" for x in names)) for df in (c, s)]
    assert rows(asof_join.click_orders(*wide)) == brute(clicks, sales)
    assert rows(asof_join.click_orders(c, s.limit(0))) == brute(clicks, [])
    assert rows(asof_join.click_orders(c.limit(0), s)) == []


def test_time_zone_of_the_session(spark):
    clicks, sales = drawn(80, 0.4)
    before = spark.conf.get("spark.sql.session.timeZone")
    c, s = spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert rows(asof_join.click_orders(c, s)) == brute(clicks, sales)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_hot_client_is_spread(spark):
    events = spark.range(20_000).selectExpr("1L AS client", "id * 7 AS t").unionByName(spark.range(2000).selectExpr("id AS client", "id AS t"))
    orders = spark.range(10_000).selectExpr("1L AS client", "id * id AS t", "id AS weight", "id")
    once = asof_join.collapsed(orders)
    chunks = asof_join._chunks(events, once, 500)
    sizes = [r["count"] for r in asof_join._placed(events.unionByName(once.select("client", "t")), chunks).groupBy("shard", "piece").count().collect()]
    assert max(sizes) < 2500 and sum(sizes) == 32_000 and chunks.count() <= asof_join.SHARDS
