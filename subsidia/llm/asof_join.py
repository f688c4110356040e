"""Tolerant as-of join: each event takes the latest order of its client at or before it, within a tolerance.

Ties are collapsed first: orders of a client at one time become one row (their best and their number), and events of a
client at one time become one question. Shards are made of a hash of the client and a chunk of time. The chunks of each
hash value are cut from quantiles of its times and then evenly, as finely as its rows ask for, so a client that holds a
third of all rows is spread over many shards; what is broadcast for that has SHARDS rows, whatever the input. A shard's
halo is the latest order of each client before its chunk: no earlier one can be a match. Each shard is a cogroup of
Arrow tables in which Acero's join_asof does the work.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, materialise

HOUR = 3_600_000_000
TOLERANCE = 720 * HOUR
#: Values of the hash of clients, and quantiles of the times under each of them.
SHARDS, KNOTS = 64, 16
#: Collapsed events and orders that a shard holds, about.
SHARD_ROWS = 1 << 15


def micros(x: Column, kind: str) -> Column:
    """Microseconds since 1970 of a timestamp, or of one without a zone taken as UTC, in any time zone of the session."""
    if kind == "timestamp":
        return F.unix_micros(x)
    whole = F.datediff(x.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(x)
    return (whole * 60 + F.minute(x)) * 60_000_000 + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("long")


def collapsed(orders: DataFrame) -> DataFrame:
    """(client, t, best, n) of orders(client, t, weight, id): the greatest weight, then id, and how many there are."""
    known = orders.where("client IS NOT NULL AND t IS NOT NULL")
    return known.groupBy("client", "t").agg(F.max(F.struct("weight", "id")).alias("best"), F.count("*").alias("n"))


def _chunks(events: DataFrame, orders: DataFrame, rows: int) -> DataFrame:
    """(shard, knots, pieces): a row for each shard of clients: SHARDS rows of KNOTS values, whatever the input.

    Between two knots lie equal shares of a shard's rows; each share is cut into as many even pieces as its rows ask for.
    """
    both = events.select("client", "t").unionByName(orders.select("client", "t")).select(_shard().alias("shard"), "t")
    quantile = F.percentile_approx("t", F.array(*(F.lit(i / KNOTS) for i in range(1, KNOTS))), F.lit(20 * KNOTS))
    found = both.groupBy("shard").agg(F.count("*").alias("n"), F.min("t").alias("least"), F.max("t").alias("most"), quantile.alias("inner"))
    knots = F.array_distinct(F.concat(F.array("least"), "inner", F.array(F.col("most") + 1)))
    shares = found.select("shard", knots.alias("knots"), F.ceil(F.col("n") / F.lit(KNOTS * rows)).alias("each"), F.concat(F.array("least"), "inner").alias("lows"))
    # a knot that stands for several quantiles has as many shares
    pieces = F.transform(F.slice("knots", 1, F.size("knots") - 1), lambda k: F.size(F.filter("lows", lambda x: x == k)) * F.col("each"))
    return shares.withColumn("pieces", pieces).select("shard", "knots", "pieces")


def _shard() -> Column:
    return F.pmod(F.xxhash64("client"), F.lit(SHARDS)).cast("int")


def _placed(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows(client, t, ...) with their shard and piece, a number that rises with the time."""
    here = rows.withColumn("shard", _shard()).join(F.broadcast(chunks), "shard")
    here = here.withColumn("i", F.size(F.filter("knots", lambda k: k <= F.col("t"))))
    low, high = F.expr("element_at(knots, i)"), F.expr("element_at(knots, i + 1)")
    inside = F.floor((F.col("t") - low) / (high - low) * F.expr("element_at(pieces, i)"))
    before = F.aggregate(F.slice("pieces", F.lit(1), F.col("i") - 1), F.lit(0).cast("long"), lambda a, b: a + b)
    return here.withColumn("piece", (before + inside).cast("long")).drop("knots", "pieces", "i")


def _halos(events: DataFrame, orders: DataFrame, tolerance: int) -> DataFrame:
    """(shard, piece, client, t, best, n): for each client with events in a piece its latest order of an earlier piece.

    A client has one row for each piece here, not one for each order.
    """
    last = orders.groupBy("client", "shard", "piece").agg(F.max(F.struct("t", "best", "n")).alias("last"))
    asks = events.groupBy("client", "shard", "piece").agg(F.min("t").alias("from"))
    both = last.withColumn("from", F.lit(None).cast("long")).unionByName(asks.withColumn("last", F.lit(None).cast(last.schema["last"].dataType)))
    earlier = Window.partitionBy("client").orderBy("piece").rangeBetween(Window.unboundedPreceding, -1)
    halo = both.withColumn("held", F.max("last").over(earlier)).where(F.col("from") - F.col("held.t") <= tolerance)
    return halo.select("shard", "piece", "client", "held.t", "held.best", "held.n")


def latest(events: DataFrame, orders: DataFrame, tolerance: int = TOLERANCE, rows: int = SHARD_ROWS) -> DataFrame:
    """(client, t, id, weight, at, n): for each distinct events(client, t) with a match the best of the latest orders.

    orders(client, t, weight, id): at is their time, at or before t and at most tolerance earlier; of equal times the
    greatest weight counts, then the greatest id, and nulls lose; n is how many orders the client has at that time. All
    but weight and id are longs, times in any unit. Rows with a null client or time match nothing. Repeated orders count
    each. Empty tables give an empty table; other columns are not looked at.
    """
    bounded_batches(events.sparkSession)
    asked = materialise(events.select("client", "t").where("client IS NOT NULL AND t IS NOT NULL").distinct(), "events")
    once = materialise(collapsed(orders.select("client", "t", "weight", "id")), "orders")
    chunks = materialise(_chunks(asked, once, rows), "chunks")
    left, right = _placed(asked, chunks), _placed(once, chunks)
    right = right.unionByName(_halos(left, right, tolerance).select(right.columns))
    weight, name = (once.schema["best"].dataType[c].dataType.simpleString() for c in ("weight", "id"))

    def joined(these: pa.Table, those: pa.Table) -> pa.Table:
        these = these.select(["client", "t"]).sort_by("t")
        those = those.select(["client", "t", "weight", "id", "n"]).rename_columns(["whose", "at", "weight", "id", "n"]).sort_by("at")
        those = those.append_column("o", those.column("at"))
        found = these.join_asof(those, on="t", by="client", tolerance=-tolerance, right_on="o", right_by="whose")
        return found.filter(found.column("n").is_valid()).select(["client", "t", "id", "weight", "at", "n"])

    right = right.select("shard", "piece", "client", "t", "best.weight", "best.id", "n")
    pairs = left.groupBy("shard", "piece").cogroup(right.groupBy("shard", "piece"))
    return pairs.applyInArrow(joined, f"client long, t long, id {name}, weight {weight}, at long, n long")


def _drawn(name: Column) -> Column:
    return F.crc32(name.cast("string").cast("binary"))


def click_orders(clicks: DataFrame, sales: DataFrame, tolerance: int = TOLERANCE, grid: int = 6 * HOUR) -> DataFrame:
    """(click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied) of every click_id.

    Copies of a click count once; were they to differ, the one of least time, then client, counts, nulls last. Null
    click_ids count as one click, without a grid. Of ids whose crc32 is odd the time is floored to the grid. Every row of
    sales is an order, and where its crc32 isn't divisible by 3 a second one with sale_id -1 - sale_id is at the same
    time. A total that is null, not finite or beyond 9.2e18 cents has null cents, which lose. Clicks without a client, a time
    or a match have n_tied 0 and nulls. Empty tables give what they can; other columns are not looked at.
    """

    def timed(x: Column, kind: str, h: Column) -> Column:
        t = micros(x, kind)
        return F.when(h % 2 == 1, t - F.pmod(t, F.lit(grid))).otherwise(t)

    own = clicks.select("click_id", "client_id", timed(F.col("ts"), clicks.schema["ts"].dataType.simpleString(), _drawn(F.col("click_id"))).alias("ts_us"))
    first = F.min(F.struct(F.col("ts_us").isNull(), "ts_us", F.col("client_id").isNull(), "client_id"))
    own = materialise(own.groupBy("click_id").agg(first.alias("c")).select("click_id", "c.client_id", "c.ts_us"), "clicks")
    sale = F.col("sale_id")
    sold = sales.select(sale, F.col("client_id").alias("client"), timed(F.col("sold_at"), sales.schema["sold_at"].dataType.simpleString(), _drawn(sale)).alias("t"), F.expr("CASE WHEN abs(100 * total + 0.5) < 9.2e18 THEN floor(100 * total + 0.5) END").alias("weight"), _drawn(sale).alias("h"))
    twins = F.when(F.col("h") % 3 != 0, F.array(sale, -1 - sale)).otherwise(F.array(sale))
    orders = sold.select("client", "t", "weight", F.explode(twins).alias("id"))
    found = latest(own.select(F.col("client_id").alias("client"), F.col("ts_us").alias("t")), orders, tolerance)
    found = found.select(F.col("client").alias("client_id"), F.col("t").alias("ts_us"), F.col("id").alias("sale_id"), (F.col("t") - F.col("at")).alias("lag_us"), F.col("weight").alias("total_cents"), F.col("n").alias("n_tied"))
    out = own.join(found, ["client_id", "ts_us"], "left")
    return out.select("click_id", "client_id", "ts_us", "sale_id", "lag_us", "total_cents", F.coalesce("n_tied", F.lit(0).cast("long")).alias("n_tied"))


def _crc(x: str) -> str:
    """crc32 of a number's decimal digits in DuckDB; t is the list of the 256 table values."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295)"


def click_sql() -> str:
    """DuckDB SQL of click_orders() over the views clicks and sales, with the default parameters."""
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    grid = 6 * HOUR
    return f"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: {step})) AS t),
c0 AS (SELECT click_id, min((ts IS NULL, epoch_us(ts), client_id IS NULL, client_id)) AS m FROM clicks GROUP BY click_id),
c1 AS (SELECT click_id, m[2] AS us, m[4] AS client_id, {_crc('click_id')} AS h FROM c0, k),
c AS (SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN us - ((us % {grid}) + {grid}) % {grid} ELSE us END AS ts_us FROM c1),
o1 AS (SELECT sale_id, client_id, epoch_us(sold_at) AS us, CASE WHEN abs(100 * total + 0.5) < 9.2e18 THEN CAST(floor(100 * total + 0.5) AS BIGINT) END AS cents, {_crc('sale_id')} AS h FROM sales, k),
o2 AS (SELECT unnest(CASE WHEN h % 3 <> 0 THEN [sale_id, -1 - sale_id] ELSE [sale_id] END) AS sale_id, client_id, CASE WHEN h % 2 = 1 THEN us - ((us % {grid}) + {grid}) % {grid} ELSE us END AS us, cents FROM o1),
o AS (SELECT client_id, us, count(*) AS n, list((cents, sale_id) ORDER BY cents DESC NULLS LAST, sale_id DESC NULLS LAST)[1] AS best FROM o2 WHERE client_id IS NOT NULL AND us IS NOT NULL GROUP BY ALL),
j AS (SELECT c.*, o.us, o.n, o.best, o.us IS NOT NULL AND c.ts_us - o.us <= {TOLERANCE} AS hit FROM c ASOF LEFT JOIN o ON c.client_id = o.client_id AND c.ts_us >= o.us)
SELECT click_id, client_id, ts_us, CASE WHEN hit THEN best[2] END AS sale_id, CASE WHEN hit THEN ts_us - us END AS lag_us, CASE WHEN hit THEN best[1] END AS total_cents, CASE WHEN hit THEN n ELSE 0 END AS n_tied FROM j"""
