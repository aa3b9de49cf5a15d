"""Market statistics and serving queries. Orders stand for entities, lineitems for listings,
suppliers for sources, nations for places, parts for kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import dates, text
from marlstone.operators import latest, scope
from marlstone.sources.tables import table

AS_OF = "2001-08-02"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def commune_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: orders, open orders, their exact median price, large ones, last 30 days."""
    orders, customer, nation = _tables(spark, sf_dir, "orders", "customer", "nation")
    is_open = F.col("o_orderstatus") == "O"
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(
            F.count("*").alias("n_listings"),
            F.count_if(is_open).alias("n_active"),
            F.percentile(F.when(is_open, F.col("o_totalprice")), F.lit(0.5)).alias("median_price"),
            F.count_if(F.col("o_orderdate") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 30 DAYS")).alias("new_30d"),
            F.max("o_orderdate").alias("last_seen"),
        )
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # a list of countries
        .select("n_name", "n_listings", "n_active", F.round("median_price", 4).alias("median_price"), "new_30d", "last_seen")
    )


def agency_stats_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 suppliers with most lines: lines, median price, part brands."""
    lineitem, supplier, part = _tables(spark, sf_dir, "lineitem", "supplier", "part")
    per = (
        lineitem.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey")
        .agg(
            F.count("*").alias("n"),
            F.round(F.percentile("l_extendedprice", F.lit(0.5)), 4).alias("median_price"),
            F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("brands"),
        )
    )
    top = per.orderBy(F.col("n").desc(), "l_suppkey").limit(25)
    return top.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "n", "median_price", "brands")


def source_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier: distinct orders with a line of its own that isn't returned."""
    lineitem, supplier = _tables(spark, sf_dir, "lineitem", "supplier")
    per = lineitem.where("l_returnflag <> 'R'").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("properties"))
    return supplier.join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_name", F.coalesce("properties", F.lit(0)).alias("properties"))


def served_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an open line of an enabled, subscribed supplier."""
    orders, lineitem, supplier = _tables(spark, sf_dir, "orders", "lineitem", "supplier")
    listings = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("source"), F.when(F.col("l_linestatus") == "O", "active").otherwise("delisted").alias("status"))
    sources = supplier.select(F.col("s_suppkey").alias("source"), (F.col("s_acctbal") > 0).alias("enabled"))
    return scope.served(orders, listings, sources, "o_orderkey", "source", list(range(1, 40))).select("o_orderkey", "o_totalprice")


def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on which no line stands."""
    orders, lineitem = _tables(spark, sf_dir, "orders", "lineitem")
    return orders.join(lineitem.where("l_linestatus = 'O'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus")


def own_duplicate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left when those that repeat an own supplier's open line are hidden, by supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("agency"), F.when(F.col("l_linestatus") == "O", "active").otherwise("gone").alias("status"))
    left = scope.without_own_duplicates(rows, "l_orderkey", "agency", [1, 2, 3])
    return left.groupBy("agency").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("entities"))


def latest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    events = table(spark, sf_dir, "events")
    last = latest.latest_per(events, ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc())
    return last.select("user_id", "event_type", "event_id", "ts")


def latest_turn_per_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest.latest_per(table(spark, sf_dir, "conversations"), ["conv_id"], F.col("turn").desc(), F.col("text"))
    return rows.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


def exclusive_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier: customers that buy from it, and those that buy from no other."""
    orders, lineitem = _tables(spark, sf_dir, "orders", "lineitem")
    pairs = orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("l_suppkey", "o_custkey").distinct()
    one = pairs.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return pairs.join(one, "o_custkey").groupBy("l_suppkey").agg(F.count("*").alias("customers"), F.count_if(F.col("n") == 1).alias("exclusive"))


def price_on_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an event whose JSON field k is 3, by a field of a variant."""
    events = table(spark, sf_dir, "events")
    return scope.on_request(events.select("user_id").distinct(), events, "user_id", "props", "$.k", 3)


def json_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: events with the JSON field k, its range and sum."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.min(k).alias("low"), F.max(k).alias("high"), F.sum(k).alias("total"))


def free_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name or type holds a text in any case."""
    part = table(spark, sf_dir, "part")
    return part.where(scope.free_text("AN", F.col("p_name"), F.col("p_type"))).select("p_partkey", "p_name", "p_type")


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 events after a cursor, and one more."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return scope.keyset_page(events, "ts", "event_id", 50, ("2024-01-10 00:00:00", 0)).select("event_id", "ts", "event_type")


def cursor_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's cursor, and what it decodes to."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", scope.encode_cursor(F.col("ts"), F.col("event_id")).alias("cursor"))
    back = scope.decode_cursor(F.col("cursor"))
    return rows.select("event_id", "cursor", back["time"].alias("decoded_ts"), back["key"].alias("decoded_id"))


def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 20 orders, newest first."""
    orders = table(spark, sf_dir, "orders")
    return orders.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).offset(40).limit(20).select("o_orderkey", "o_orderdate", "o_totalprice")


def impossible_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with impossible figures, by problem."""
    part = table(spark, sf_dir, "part")
    price, area = F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice") * 200000), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") * 60.0 - 120)
    kind = F.when(F.col("p_partkey") % 5 == 0, "Terrain").when(F.col("p_partkey") % 5 != 1, "Maison")
    rows = part.select(price.alias("price"), area.alias("area"), kind.alias("kind"))
    bad = scope.impossible(F.col("price"), F.col("area"), F.col("kind"))
    clean = scope.scrubbed(rows.withColumn("problem", bad), "price", "area", "kind")
    return clean.groupBy("problem").agg(F.count("*").alias("n"), F.count("price").alias("prices"), F.count("area").alias("areas"))


def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and language: documents, and the shares of short and very long ones."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", "lang").agg(
        F.count("*").alias("n"),
        F.round(100.0 * F.count_if(F.col("n_chars") < 500) / F.count("*"), 4).alias("short_pct"),
        F.round(100.0 * F.count_if(F.col("n_chars") > 5000) / F.count("*"), 4).alias("long_pct"),
    )


def samples_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three shortest documents of each source."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return latest.first_n_per(docs, ["source"], 3, F.col("n_chars"), F.col("doc_id")).select("source", "doc_id", "n_chars", "rank")


def minute_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in its last minute with events."""
    events = table(spark, sf_dir, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    last = F.max("minute").over(Window.partitionBy("event_type"))
    return events.withColumn("last", last).where("minute = last").groupBy("event_type", "last").agg(F.count("*").alias("n"))


def ppm_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose price per size lies over six times off their type's median."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", (F.col("p_retailprice") / F.col("p_size")).alias("ppm"))
    med = part.groupBy("p_type").agg(F.percentile("ppm", F.lit(0.5)).alias("median"))
    far = (F.col("ppm") > 6 * F.col("median")) | (F.col("ppm") < F.col("median") / 6)
    return part.join(F.broadcast(med), "p_type").where(far).select("p_partkey", "p_type", F.round("ppm", 6).alias("ppm"), F.round("median", 6).alias("median"))  # a few types


def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts with one brand and price, another type: one entity, perhaps."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.round("p_retailprice", 0).alias("price"))
    on = (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.price") == F.col("b.price")) & (F.col("a.p_type") != F.col("b.p_type")) & (F.col("a.p_partkey") < F.col("b.p_partkey"))
    return p.alias("a").join(p.alias("b"), on).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"))


def price_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines' prices spread over 90 % and that have over 6 of them."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    spread = (F.col("high") - F.col("low")) / F.nullif("high", F.lit(0))
    return per.where((F.col("n") > 6) & (spread > 0.9)).select("l_orderkey", "n", F.round(spread, 6).alias("spread"))


def array_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose nation is on a supplier list, joined by membership of an array."""
    customer, supplier = _tables(spark, sf_dir, "customer", "supplier")
    lists = supplier.groupBy(F.pmod("s_suppkey", F.lit(4)).alias("team")).agg(F.collect_set("s_nationkey").alias("nations"))
    return lists.select("team", F.explode("nations").alias("c_nationkey")).join(customer, "c_nationkey").groupBy("team").agg(F.count("*").alias("customers"))


def monthly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per month and nation: new orders, their median and total price."""
    orders, customer, nation = _tables(spark, sf_dir, "orders", "customer", "nation")
    first, _ = dates.month_bounds(F.col("o_orderdate"))
    rows = orders.withColumn("month", first).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    per = rows.groupBy("month", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.percentile("o_totalprice", F.lit(0.5)), 4).alias("median_price"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return per.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.to_date("month").alias("month"), "n_name", "n", "median_price", "total")


def period_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's orders and median against the month before, in percent."""
    orders = table(spark, sf_dir, "orders")
    per = orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.count("*").alias("n"), F.percentile("o_totalprice", F.lit(0.5)).alias("median_price"), F.countDistinct("o_orderpriority").alias("coverage"))
    before = per.select(F.add_months("month", 1).alias("month"), F.col("n").alias("n0"), F.col("median_price").alias("m0"), F.col("coverage").alias("c0"))
    change = lambda a, b: F.round((F.col(a) - F.col(b)) / F.nullif(b, F.lit(0)) * 100, 4)
    return per.join(before, "month", "left").select("month", "n", change("n", "n0").alias("n_pct"), change("median_price", "m0").alias("median_pct"), (F.col("coverage") != F.col("c0")).alias("coverage_changed"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers and of suppliers: both, only one of them."""
    customer, supplier = _tables(spark, sf_dir, "customer", "supplier")
    c, s = customer.select(F.col("c_nationkey").alias("k")), supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, name: df.select("k", F.lit(name).alias("side"))
    return tag(c.intersect(s), "both").union(tag(c.subtract(s), "customers")).union(tag(s.subtract(c), "suppliers"))


def page_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the registrable label of their host."""
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(text.site_key(F.col("url")).alias("site")).agg(F.count("*").alias("n"), F.countDistinct(text.host_of(F.col("url"))).alias("hosts"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and their rows."""
    out = None
    for n in TABLES:
        row = table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        commune_stats, agency_stats_top25, source_options, served_semi, orphan_anti, own_duplicate_filter, latest_per_source,
        latest_turn_per_conversation, exclusive_agencies, price_on_request, json_field_stats, free_text_search, keyset_page,
        cursor_codec, offset_page, impossible_values, missing_profile, samples_top3, minute_batches, ppm_band, review_pairs,
        price_spread, array_membership, monthly_report, period_compare, set_operations, page_host, catalogue,
    )
}
ORACLES = {
    "commune_stats": f"""
SELECT n_name, count(*) AS n_listings, count(*) FILTER (o_orderstatus = 'O') AS n_active,
       round(quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'O'), 4) AS median_price,
       count(*) FILTER (o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS new_30d, max(o_orderdate) AS last_seen
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "agency_stats_top25": """
WITH per AS (SELECT l_suppkey, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price,
                    array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands
             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 25)
SELECT s_name, n, median_price, brands FROM per JOIN supplier ON l_suppkey = s_suppkey""",
    "source_options": """
SELECT s_name, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag <> 'R') AS properties
FROM supplier""",
    "served_semi": """
SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (
  SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND s_acctbal > 0 AND s_suppkey BETWEEN 1 AND 39)""",
    "orphan_anti": """
SELECT o_orderkey, o_orderstatus FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')""",
    "own_duplicate_filter": """
WITH l AS (SELECT l_orderkey, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS agency, l_linestatus = 'O' AS active FROM lineitem)
SELECT agency, count(*) AS n, count(DISTINCT l_orderkey) AS entities FROM l
WHERE coalesce(agency IN (1, 2, 3), false)
   OR NOT EXISTS (SELECT 1 FROM l AS o WHERE o.l_orderkey = l.l_orderkey AND o.active AND o.agency IN (1, 2, 3))
GROUP BY agency""",
    "latest_per_source": """
SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, ts FROM events
ORDER BY user_id, event_type, ts DESC, event_id DESC""",
    "latest_turn_per_conversation": """
SELECT DISTINCT ON (conv_id) conv_id, turn, role, length(text)::BIGINT AS n_chars FROM conversations ORDER BY conv_id, turn DESC, text""",
    "exclusive_agencies": """
WITH pairs AS (SELECT DISTINCT l_suppkey, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT l_suppkey, count(*) AS customers,
       count(*) FILTER ((SELECT count(*) FROM pairs AS q WHERE q.o_custkey = pairs.o_custkey) = 1) AS exclusive
FROM pairs GROUP BY l_suppkey""",
    "price_on_request": "SELECT DISTINCT user_id FROM events AS e WHERE EXISTS (SELECT 1 FROM events AS f WHERE f.user_id = e.user_id AND f.props->>'k' = '3')",
    "json_field_stats": """
SELECT event_type, count(k) AS n, min(k) AS low, max(k) AS high, sum(k)::BIGINT AS total
FROM (SELECT event_type, (props->>'k')::BIGINT AS k FROM events) GROUP BY 1""",
    "free_text_search": "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%AN%' OR p_type ILIKE '%AN%'",
    "keyset_page": """
SELECT event_id, ts, event_type FROM events
WHERE ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 0) ORDER BY ts, event_id LIMIT 51""",
    "cursor_codec": """
SELECT event_id, date_trunc('millisecond', ts) AS decoded_ts, event_id::VARCHAR AS decoded_id,
       rtrim(translate(base64(encode(strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z|' || event_id)), '+/', '-_'), '=') AS cursor
FROM events""",
    "offset_page": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40",
    "impossible_values": """
WITH l AS (SELECT CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice * 200000 END AS price,
                  CASE WHEN p_partkey % 7 <> 0 THEN p_size * 60.0::DOUBLE - 120 END AS area,
                  CASE WHEN p_partkey % 5 = 0 THEN 'Terrain' WHEN p_partkey % 5 <> 1 THEN 'Maison' END AS kind FROM part),
c AS (SELECT CASE WHEN price > 250000000 THEN 'price' WHEN area < 5 THEN 'area, unit error'
                  WHEN area > 2000 AND kind = 'Maison' THEN 'area, too large for a home' END AS problem,
             CASE WHEN price > 250000000 THEN NULL ELSE price END AS price,
             CASE WHEN area < 5 OR (area > 2000 AND kind = 'Maison') THEN NULL ELSE area END AS area FROM l)
SELECT problem, count(*) AS n, count(price) AS prices, count(area) AS areas FROM c GROUP BY 1""",
    "missing_profile": """
SELECT source, lang, count(*) AS n, round(100.0 * count(*) FILTER (n_chars < 500) / count(*), 4)::DOUBLE AS short_pct,
       round(100.0 * count(*) FILTER (n_chars > 5000) / count(*), 4)::DOUBLE AS long_pct FROM documents GROUP BY 1, 2""",
    "samples_top3": """
SELECT source, doc_id, n_chars, rank::INTEGER AS rank
FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents) WHERE rank <= 3""",
    "minute_batches": """
SELECT event_type, date_trunc('minute', ts) AS last, count(*) AS n FROM events
WHERE date_trunc('minute', ts) = (SELECT date_trunc('minute', max(ts)) FROM events AS e WHERE e.event_type = events.event_type) GROUP BY 1, 2""",
    "ppm_band": """
WITH p AS (SELECT p_partkey, p_type, p_retailprice / p_size AS ppm FROM part),
m AS (SELECT p_type, quantile_cont(ppm, 0.5) AS median FROM p GROUP BY 1)
SELECT p_partkey, p_type, round(ppm, 6) AS ppm, round(median, 6) AS median FROM p JOIN m USING (p_type) WHERE ppm > 6 * median OR ppm < median / 6""",
    "review_pairs": """
SELECT a.p_partkey AS a, b.p_partkey AS b FROM part AS a JOIN part AS b
ON a.p_brand = b.p_brand AND round(a.p_retailprice, 0) = round(b.p_retailprice, 0) AND a.p_type <> b.p_type AND a.p_partkey < b.p_partkey""",
    "price_spread": """
SELECT l_orderkey, count(*) AS n, round((max(l_extendedprice) - min(l_extendedprice)) / nullif(max(l_extendedprice), 0), 6) AS spread
FROM lineitem GROUP BY 1 HAVING count(*) > 6 AND (max(l_extendedprice) - min(l_extendedprice)) / nullif(max(l_extendedprice), 0) > 0.9""",
    "array_membership": """
WITH lists AS (SELECT s_suppkey % 4 AS team, list(DISTINCT s_nationkey) AS nations FROM supplier GROUP BY 1)
SELECT team, count(*) AS customers FROM lists JOIN customer ON list_contains(nations, c_nationkey) GROUP BY 1""",
    "monthly_report": """
SELECT date_trunc('month', o_orderdate)::DATE AS month, n_name, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS median_price,
       round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "period_compare": """
WITH per AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS m,
                    count(DISTINCT o_orderpriority) AS c FROM orders GROUP BY 1)
SELECT a.month, a.n, round((a.n - b.n) / b.n * 100, 4) AS n_pct, round((a.m - b.m) / nullif(b.m, 0) * 100, 4) AS median_pct,
       a.c <> b.c AS coverage_changed
FROM per AS a LEFT JOIN per AS b ON a.month = b.month + INTERVAL 1 MONTH""",
    "set_operations": """
WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT k, 'both' AS side FROM (FROM c INTERSECT FROM s) UNION ALL SELECT k, 'customers' FROM (FROM c EXCEPT FROM s)
UNION ALL SELECT k, 'suppliers' FROM (FROM s EXCEPT FROM c)""",
    "page_host": """
WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages)
SELECT string_split(host, '.')[-2] AS site, count(*) AS n, count(DISTINCT host) AS hosts FROM h GROUP BY 1""",
    "catalogue": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in TABLES),
}
