"""Change capture and pass planning. Orders before and after a cutoff stand for two passes; events
for the append-only log (user: listing, value: price)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import cdc, latest
from marlstone.sources.tables import table
from marlstone.streaming import windows

_STATE = """CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderkey % 90 + 20.0 AS area,
(o_orderkey % 5)::INTEGER AS rooms, o_orderpriority AS availability, CASE WHEN o_orderkey % 6 = 0 THEN 'delisted' ELSE 'active' END AS status"""
_STATE_AFTER = """CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_totalprice * 0.9 ELSE o_totalprice END AS price,
o_orderkey % 90 + 20.0 + CASE WHEN o_orderkey % 10 = 0 THEN 5 ELSE 0 END AS area, (o_orderkey % 5)::INTEGER AS rooms,
CASE WHEN o_orderkey % 11 = 0 THEN 'sold' ELSE o_orderpriority END AS availability,
CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 4 <> 0 OR o_orderkey % 9 = 1 THEN 'delisted' ELSE 'active' END AS status"""



def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    to_spark = lambda s: "SELECT o_orderkey, " + s.replace("(o_orderkey % 5)::INTEGER", "cast(o_orderkey % 5 as int)") + " FROM {o}"
    before = spark.sql(to_spark(_STATE), o=orders).where("o_orderkey % 13 <> 0")
    return before, spark.sql(to_spark(_STATE_AFTER), o=orders)


def diff_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass found against what was known, by plan."""
    orders = table(spark, sf_dir, "orders")
    known, found = orders.where("o_orderdate < '2000-01-01'"), orders.where("o_orderdate >= '1996-01-01'")
    stale, shield = orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_custkey % 10 = 0")
    out = cdc.diff(known, found, "o_orderkey", True, stale, shield)
    return out.groupBy("plan").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def compute_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes between two states of all orders."""
    before, after = _states(spark, sf_dir)
    out = cdc.compute_events(before, after, "o_orderkey")
    return out.select("o_orderkey", "type", *(F.round(c, 4).alias(c) for c in ("price_from", "price_to", "delta", "percent")), "direction", "availability_from", "availability_to")


def merge_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after a merge in which nulls don't overwrite, by availability."""
    before, after = _states(spark, sf_dir)
    out = cdc.merged(before, after, "o_orderkey")
    return out.groupBy("availability", "status").agg(F.count("*").alias("n"), F.count("price").alias("priced"), F.round(F.sum("price"), 2).alias("total"))


def refresh_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refresh queue: in hand first, then the 100 oldest that need it."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 97 == 0).alias("in_hand"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("stated"),
        F.when(F.col("o_orderkey") % 3 != 0, F.date_add("o_orderdate", -1).cast("timestamp")).alias("stored"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("fetched"),
    )
    return cdc.plan_refresh(rows, "o_orderkey", 100, F.lit("1996-01-01").cast("timestamp")).select("o_orderkey", "in_hand", "place")


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's value against the one before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("value").over(w))
    rows = rows.where(F.col("before").isNotNull() & (F.col("before") != F.col("value")))
    return rows.select("event_id", "user_id", F.round(F.col("value") - F.col("before"), 6).alias("delta"), F.when(F.col("value") < F.col("before"), "down").otherwise("up").alias("direction"))


def price_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a user's value by a factor of five or more, by day."""
    from marlstone.functions.text import price_jump

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("value").over(w))
    return rows.where(price_jump(F.col("before"), F.col("value"))).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def last_change_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of each user."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return latest.latest_per(rows, ["user_id"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "value")


def events_feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed page that walks record time, so that late events (an hour for every tenth) still come."""
    from marlstone.operators.scope import keyset_page

    late = F.when(F.col("event_id") % 10 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("occurred_at"), late.alias("created_at"))
    return keyset_page(rows.where("event_type IN ('purchase', 'click')"), "created_at", "event_id", 100, ("2024-01-05 12:00:00", -1))


def movements_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest falls of a user's value."""
    return price_changes(spark, sf_dir).where("delta < 0").orderBy("delta", "event_id").limit(20)


def event_counts_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("month", "ts")).alias("month"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def upsert_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after an upsert that leaves finished ones alone, by status."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    out = latest.upserted(old, new, ["o_orderkey"], F.col("o.o_orderstatus") == "F")
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that differ from the stored ones, nulls being equal, by status."""
    before, after = _states(spark, sf_dir)
    return latest.changed_rows(before, after, ["o_orderkey"]).groupBy("status").agg(F.count("*").alias("n"))


def repost_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand for a stored one that left: same brand, type and rounded price."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lit("s").alias("source"), F.col("p_brand").alias("agency"), F.col("p_type").alias("title"), F.round("p_retailprice", -1).alias("price"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size") % 4).alias("area"), F.lit(None).cast("string").alias("place"),
        F.when(F.col("p_partkey") % 3 == 0, "delisted").otherwise("active").alias("status"),
        F.when(F.col("p_partkey") % 3 == 0, F.timestamp_seconds(1704067200 - F.col("p_partkey") * 3600)).alias("delisted_at"),
    )
    new, old = part.where("id % 2 = 0"), part.where("id % 2 = 1")
    return cdc.reposts(new, old, F.lit("2024-01-01").cast("timestamp"))


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user in windows of six hours, by size of the window."""
    per = windows.fixed_windows(table(spark, sf_dir, "events"), "user_id", "ts", 21600)
    return per.groupBy("n").agg(F.count("*").alias("windows"), F.min("window_start").alias("first"))


def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type that a limit of 20 a day admits."""
    rows = windows.limited(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", 86400, 20)
    return rows.groupBy("event_type", "window_start").agg(F.count("*").alias("n"), F.count_if("admitted").alias("admitted"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a reserve-and-settle ledger made of events."""
    kind = F.when(F.col("event_type") == "click", "reserve").when(F.col("event_type") == "purchase", "settle").otherwise("count")
    return windows.ledger_totals(table(spark, sf_dir, "events").select(kind.alias("kind"), F.col("user_id").alias("request_id"), F.lit(1).cast("long").alias("items")))


def newest_until_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest orders up to three known ones in a row, or all; read from a first stretch, and from twice
    as many while it does not hold the stop."""
    orders, newest = table(spark, sf_dir, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    total, n = orders.count(), 500
    while True:
        rows = orders.orderBy(*newest).limit(n)
        found = cdc.numbered(rows, "place", *newest).select("o_orderkey", "place", (F.col("o_orderkey") % 3 == 0).alias("known"))
        read = windows.until_known(found, "place", "known", 3)
        if n >= total or read.count() < n:
            return read
        n *= 2


QUERIES = {
    f.__name__: f
    for f in (
        diff_added_removed, compute_events, merge_parsed, refresh_queue, price_changes, price_jumps, last_change_per_entity,
        events_feed_page, movements_top20, event_counts_by_month, upsert_reconcile, changed_only, repost_lookup, rate_windows,
        rate_limited, ledger, newest_until_known,
    )
}
_B, _A = f"b AS (SELECT o_orderkey, {_STATE} FROM orders WHERE o_orderkey % 13 <> 0)", f"a AS (SELECT o_orderkey, {_STATE_AFTER} FROM orders)"
_CHANGES = """
WITH c AS (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, ts FROM events)
SELECT event_id, user_id, round(value - before, 6) AS delta, CASE WHEN value < before THEN 'down' ELSE 'up' END AS direction
FROM c WHERE before <> value"""
ORACLES = {
    "diff_added_removed": """
WITH k AS (SELECT o_orderkey FROM orders WHERE o_orderdate < '2000-01-01'), f AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01'),
p AS (SELECT o_orderkey, CASE WHEN o_orderkey IN (FROM f) AND o_orderkey NOT IN (FROM k) THEN 'added'
  WHEN o_orderkey IN (FROM f) AND o_orderpriority = '1-URGENT' THEN 'refresh' WHEN o_orderkey IN (FROM f) THEN 'present'
  WHEN o_custkey % 10 = 0 THEN 'suppressed' ELSE 'removed' END AS plan FROM orders)
SELECT plan, count(*) AS n, min(o_orderkey) AS first FROM p GROUP BY 1""",
    "compute_events": f"""
WITH {_B}, {_A}, j AS (SELECT a.*, b.o_orderkey IS NULL AS fresh, b.price AS p0, b.area AS a0, b.rooms AS r0, b.availability AS v0, b.status AS s0
                       FROM a LEFT JOIN b USING (o_orderkey))
SELECT o_orderkey, 'listed' AS type, NULL::DOUBLE AS price_from, round(price, 4) AS price_to, NULL::DOUBLE AS delta, NULL::DOUBLE AS percent, NULL AS direction,
  NULL AS availability_from, NULL AS availability_to FROM j WHERE fresh
UNION ALL SELECT o_orderkey, 'delisted', round(p0, 4), NULL, NULL, NULL, NULL, v0, NULL FROM j WHERE NOT fresh AND s0 = 'active' AND status = 'delisted'
UNION ALL SELECT o_orderkey, 'relisted', NULL, round(price, 4), NULL, NULL, NULL, NULL, NULL FROM j WHERE s0 = 'delisted' AND status = 'active'
UNION ALL SELECT o_orderkey, 'price_changed', round(p0, 4), round(price, 4), round(price - p0, 4), round((price - p0) / p0 * 100, 2), CASE WHEN price < p0 THEN 'down' ELSE 'up' END, NULL, NULL
  FROM j WHERE NOT fresh AND NOT (s0 = 'active' AND status = 'delisted') AND price <> p0
UNION ALL SELECT o_orderkey, 'availability_changed', NULL, NULL, NULL, NULL, NULL, v0, availability FROM j WHERE NOT (s0 = 'active' AND status = 'delisted') AND availability <> v0
UNION ALL SELECT o_orderkey, 'updated', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM j WHERE NOT (s0 = 'active' AND status = 'delisted') AND (area <> a0 OR rooms <> r0)""",
    "merge_parsed": f"""
WITH {_B}, {_A}, m AS (SELECT coalesce(a.availability, b.availability) AS availability, coalesce(a.status, b.status) AS status, coalesce(a.price, b.price) AS price
                       FROM b LEFT JOIN a USING (o_orderkey))
SELECT availability, status, count(*) AS n, count(price) AS priced, round(sum(price), 2) AS total FROM m GROUP BY 1, 2""",
    "refresh_queue": """
WITH r AS (SELECT o_orderkey, o_orderkey % 97 = 0 AS in_hand, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS stated,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate - INTERVAL 1 DAY END AS stored, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS fetched FROM orders),
d AS (SELECT * FROM r WHERE NOT in_hand AND (fetched IS NULL OR fetched < '1996-01-01' OR stated IS NULL OR stored IS NULL OR stated > stored)
      ORDER BY fetched NULLS FIRST, o_orderkey LIMIT 100),
q AS (SELECT * FROM r WHERE in_hand UNION ALL SELECT * FROM d)
SELECT o_orderkey, in_hand, row_number() OVER (ORDER BY in_hand DESC, fetched NULLS FIRST, o_orderkey) AS place FROM q""",
    "price_changes": _CHANGES,
    "price_jumps": """
WITH c AS (SELECT ts::DATE AS day, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT day, count(*) AS n FROM c WHERE before > 0 AND value > 0 AND (value / before >= 5 OR value / before <= 0.2) GROUP BY 1""",
    "last_change_per_entity": """
SELECT DISTINCT ON (user_id) user_id, event_id, value FROM events WHERE event_type = 'purchase' ORDER BY user_id, ts DESC, event_id DESC""",
    "events_feed_page": """
WITH e AS (SELECT event_id, user_id, event_type, ts AS occurred_at, CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS created_at FROM events)
SELECT * FROM e WHERE event_type IN ('purchase', 'click') AND created_at >= TIMESTAMP '2024-01-05 12:00:00' ORDER BY created_at, event_id LIMIT 101""",
    "movements_top20": f"SELECT * FROM ({_CHANGES}) WHERE delta < 0 ORDER BY delta, event_id LIMIT 20",
    "event_counts_by_month": "SELECT date_trunc('month', ts)::DATE AS month, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "upsert_reconcile": """
WITH o AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0),
u AS (SELECT CASE WHEN n.o_orderkey IS NULL OR o.o_orderstatus = 'F' THEN o.o_orderstatus ELSE 'N' END AS o_orderstatus,
             CASE WHEN n.o_orderkey IS NULL OR o.o_orderstatus = 'F' THEN o.o_totalprice ELSE n.o_totalprice + 1 END AS p
      FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT o_orderstatus, count(*) AS n, round(sum(p), 2) AS total FROM u GROUP BY 1""",
    "changed_only": f"""
WITH {_B}, {_A} SELECT a.status, count(*) AS n FROM a LEFT JOIN b USING (o_orderkey)
WHERE b.o_orderkey IS NULL OR (a.price, a.area, a.rooms, a.availability, a.status) IS DISTINCT FROM (b.price, b.area, b.rooms, b.availability, b.status) GROUP BY 1""",
    "repost_lookup": """
WITH p AS (SELECT p_partkey AS id, p_brand, p_type, round(p_retailprice, -1) AS price, CASE WHEN p_size % 2 = 0 THEN p_size % 4 END AS area,
  p_partkey % 3 <> 0 AS active, CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2024-01-01' - to_hours(p_partkey) END AS gone FROM part)
SELECT DISTINCT ON (n.id) n.id, s.id AS repost_of FROM p AS n JOIN p AS s
ON n.id % 2 = 0 AND s.id % 2 = 1 AND n.p_brand = s.p_brand AND n.p_type = s.p_type AND n.price = s.price AND n.area IS NOT DISTINCT FROM s.area
   AND (s.active OR s.gone >= TIMESTAMP '2024-01-01' - INTERVAL 14 DAY)
ORDER BY n.id, s.active DESC, s.gone DESC NULLS LAST, s.id""",
    "rate_windows": """
WITH w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s, count(*) AS n FROM events GROUP BY 1, 2)
SELECT n, count(*) AS windows, min(s) AS first FROM w GROUP BY 1""",
    "rate_limited": """
SELECT event_type, ts::DATE::TIMESTAMP AS window_start, count(*) AS n, least(count(*), 20) AS admitted FROM events GROUP BY 1, 2""",
    "ledger": """
SELECT (SELECT count(*) FROM events WHERE event_type NOT IN ('click', 'purchase')) AS counted,
       (SELECT count(*) FROM events WHERE event_type = 'purchase') AS settled,
       (SELECT count(*) FROM events AS e WHERE event_type = 'click'
          AND NOT EXISTS (SELECT 1 FROM events AS p WHERE p.user_id = e.user_id AND p.event_type = 'purchase')) AS open""",
    "newest_until_known": """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, o_orderkey % 3 = 0 AS known FROM orders),
s AS (SELECT min(place) AS stop FROM (SELECT place, known AND lag(known) OVER (ORDER BY place) AND lag(known, 2) OVER (ORDER BY place) AS hit FROM r) WHERE hit)
SELECT o_orderkey, place, known FROM r WHERE place <= coalesce((SELECT stop FROM s), place)""",
}
