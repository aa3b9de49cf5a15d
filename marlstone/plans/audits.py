"""Audits of stored data, and landed answers and pages read as listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import cdc, health
from marlstone.sources import adapters
from marlstone.sources.tables import table


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search answers per nation (the place), 40 customers a page; every seventh customer is another's, every
    eleventh for rent; pages of place 3 state more than they hold."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    item = F.struct(
        k.alias("id"), F.when(k % 7 == 0, "elsewhere").otherwise(F.col("c_nationkey").cast("string")).alias("city"), F.when(k % 11 == 0, "rent").otherwise("buy").alias("adType"), F.when(k % 3 != 0, F.round(F.col("c_acctbal") * 100)).alias("price"),
        F.when(k % 5 != 0, (k % 200 + 10).cast("double")).alias("surfaceArea"), F.concat(F.lit("House "), k.cast("string")).alias("title"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("agency"), (k % 17 * 0.1).alias("viewed"),
    )
    page = F.floor((F.row_number().over(Window.partitionBy("c_nationkey").orderBy(k)) - 1) / 40)
    rows = c.withColumn("page", page).groupBy(F.col("c_nationkey").alias("place"), "page").agg(F.array_sort(F.collect_list(item)).alias("ads"))
    stated = c.groupBy(F.col("c_nationkey").alias("place")).agg((F.count("*") + F.when(F.col("c_nationkey") == 3, 5).otherwise(0)).alias("total"))
    return rows.join(stated, "place").select(F.lit("search").alias("source"), "place", "page", F.to_json(F.struct("total", "ads")).alias("body"))


_ITEM = "id long, city string, adType string, price double, surfaceArea double, title string, agency string, viewed double"


def search_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers landed as search answers and read as listings."""
    records, r = adapters.search_records(_answers(spark, sf_dir), "ads", "total", _ITEM), (lambda f: F.col(f"r.{f}"))
    fields = {"title": r("title"), "price": r("price"), "area": r("surfaceArea"), "agency": r("agency"), "place": r("city")}
    out = adapters.search_listings(records, fields, r("id"), (r("city") == F.col("place").cast("string")) & (r("adType") == "buy"), ["viewed"])
    return out.select(F.col("key").cast("long").alias("c_custkey"), "f.price", "f.area", "f.agency", F.col("result.status").alias("status"), F.array_join("result.missing", ",").alias("missing"))


def search_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of which as much was read as their answers state."""
    records = adapters.search_records(_answers(spark, sf_dir), "ads", "total", _ITEM)
    return adapters.search_completeness(records).select("place", "read", "stated", "complete", adapters.last_page_needed(F.col("stated"), 40).alias("pages"))


def page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts landed as pages with structured data and labelled cells, read as listings."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    ld = F.when(k % 4 != 0, F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"Maison '), k.cast("string"), F.lit('","offers":{"price":"'), F.col("p_retailprice").cast("string"), F.lit('","priceCurrency":"'), F.when(k % 6 == 0, "USD").otherwise("EUR"), F.lit('"}}</script>')))
    cells = F.concat(F.lit("<dl><dt>Surface :</dt><dd>"), size, F.lit(" m&sup2;</dd><dt>Pi&egrave;ces</dt><dd>"), F.when(k % 3 == 0, "-").otherwise(size), F.lit("</dd>"), F.when(k % 2 == 0, F.concat(F.lit("<dt>Agence</dt><dd>"), F.col("p_brand"), F.lit("</dd>"))).otherwise(""), F.lit("</dl>"))
    body = F.concat(F.lit("<html><title>"), F.when(k % 20 == 0, "").otherwise(F.concat(F.lit("Terrain &amp; vue "), k.cast("string"))), F.lit("</title>"), F.coalesce(ld, F.lit("")), cells, F.lit("</html>"))
    pages = table(spark, sf_dir, "part").select(k.alias("key"), F.concat(F.lit("https://x.fr/"), k.cast("string")).alias("url"), body.alias("body"))
    out = adapters.page_listings(pages, {"area": "Surface", "rooms": "Pièces", "agency": "Agence"})
    return out.select(F.col("key").alias("p_partkey"), "f.title", "f.price", "f.area", "f.rooms", "f.kind", "f.agency", F.col("result.status").alias("status"), F.array_join("result.missing", ",").alias("missing"))


def size_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines' quantities lie over a fifth apart, of three or more."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return per.where("n >= 3 AND (high - low) / nullif(high, 0) > 0.2")


def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose newest line is over a week old at a date, and how old in days."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("newest"))
    now = F.lit("2001-11-25").cast("timestamp")
    return per.where(F.col("newest") < now - F.expr("INTERVAL 7 DAYS")).select("l_suppkey", "newest", F.floor((F.unix_timestamp(now) - F.unix_timestamp("newest")) / 86400).alias("days"))


def missing_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand and type, land (the first type) left out: the shares of parts without a figure."""
    part = table(spark, sf_dir, "part").where("p_type <> 'ECONOMY'")
    share = lambda c, name: F.round(100.0 * F.count_if(c) / F.count("*"), 2).alias(name)
    return part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), share(F.col("p_size") < 10, "no_size"), share(F.col("p_partkey") % 9 == 0, "no_price"))


def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest groups of lines of one order, and all whose prices lie over a tenth apart: by why."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("sources"), ((F.max("l_extendedprice") - F.min("l_extendedprice")) / F.nullif(F.max("l_extendedprice"), F.lit(0.0))).alias("spread"))
    largest = per.orderBy(F.col("n").desc(), "l_orderkey").limit(5).select("l_orderkey", "n", "sources", F.lit("largest").alias("why"))
    return largest.union(per.where("n > 1 AND spread > 0.1").select("l_orderkey", "n", "sources", F.lit("apart")))


def unplaced_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order is of another place than all of its supplier's: strays, by supplier."""
    o, s, lines, c = (table(spark, sf_dir, n) for n in ("orders", "supplier", "lineitem", "customer"))
    place = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", (F.col("c_nationkey") % 5).alias("place"))
    rows = lines.join(place, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("place") != F.col("s_nationkey") % 5).alias("strays"), F.array_join(F.array_sort(F.collect_set("place")), ",").alias("places"))


def taken_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that take over a stored one that left: by the stored one."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lit("s").alias("source"), F.col("p_brand").alias("agency"), F.col("p_type").alias("title"), F.round("p_retailprice", -1).alias("price"), F.lit(1).alias("area"), F.lit(None).cast("string").alias("place"),
        F.when(F.col("p_partkey") % 3 == 0, "delisted").otherwise("active").alias("status"), F.when(F.col("p_partkey") % 3 == 0, F.timestamp_seconds(1704067200 - F.col("p_partkey") * 60)).alias("delisted_at"), F.col("p_size").alias("first_seen"),
    )
    new, old = part.where("id % 2 = 0"), part.where("id % 2 = 1")
    rows, events = cdc.taken_over(old, new, cdc.reposts(new, old, F.lit("2024-01-01").cast("timestamp")))
    return rows.join(events.select("id", F.col("price_to")), "id", "left").select("id", "repost_of", "first_seen", "status", "price_to")


def carried_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of the addresses that JSON lists carry, by supplier."""
    s = table(spark, sf_dir, "supplier")
    raw = F.concat(F.lit('{"listings":[{"url":"https://a'), (F.col("s_suppkey") % 4).cast("string"), F.lit('.fr/x"},{"url":"http://b.fr/'), F.col("s_suppkey").cast("string"), F.lit('"},{"other":1}]}'))
    each = s.select("s_suppkey", F.explode(F.try_variant_get(F.try_parse_json(raw), "$.listings", "array<variant>")).alias("x"))
    host = F.nullif(F.regexp_extract(F.try_variant_get("x", "$.url", "string"), "^https?://([^/]+)", 1), F.lit(""))
    return each.select("s_suppkey", host.alias("host")).where("host IS NOT NULL").distinct()


def merged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties with others put in: the field k is counted, others stay."""
    e = table(spark, sf_dir, "events")
    new = F.when(F.col("event_id") % 2 == 0, F.lit('{"k":-1,"m":"x"}')).otherwise(F.lit('{"m":"y"}'))
    v = F.try_parse_json(T.json_merged(F.col("props"), new))
    return e.groupBy(F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.m", "string").alias("m")).agg(F.count("*").alias("n"))


def portal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by how their portal is shown."""
    p = table(spark, sf_dir, "pages")
    return p.groupBy(T.portal_named(T.site_key(F.col("url")), {"example": "Example"}).alias("portal")).agg(F.count("*").alias("n"))


def explained_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged checks of two runs, with what the reader's rule flags alone."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    pick = lambda x: F.element_at(F.array(*map(F.lit, ("green", "amber", "red", "unknown"))), (x % 4 + 1).cast("int"))
    run = lambda a, b: s.select(F.lit("c").alias("check"), k.alias("source"), pick(k * a).alias("status"), pick(k * b + 1).alias("rule"))
    return health.triage(run(1, 3), run(3, 1))


def check_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last 14 days' orders of each priority came to, and how often that changed."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("check"), F.col("o_orderdate").alias("run")).agg(F.count("*").alias("n"))
    rows = o.select("check", F.lit(1).alias("source"), "run", F.when(F.col("n") > 2, "red").when(F.col("n") > 1, "amber").otherwise("green").alias("status"))
    return health.brief(rows).select("check", "statuses", "changes")


QUERIES = {
    f.__name__: f
    for f in (
        search_listings, search_completeness, page_listings, size_disagreement, stale_sources, missing_by_kind, merged_groups, unplaced_strays, taken_over, carried_hosts, merged_json, portal_names,
        explained_checks, check_brief,
    )
}
ORACLES = {
    "search_listings": """
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN round(c_acctbal * 100) END AS price, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 200 + 10)::DOUBLE END AS area, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS agency
  FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0),
m AS (SELECT *, array_to_string(list_filter([CASE WHEN price IS NULL THEN 'price' END, CASE WHEN area IS NULL THEN 'area' END, CASE WHEN agency IS NULL THEN 'agency' END], lambda x: x IS NOT NULL), ',') AS missing FROM c)
SELECT k AS c_custkey, price, area, agency, CASE WHEN missing = '' THEN 'ok' ELSE 'partial' END AS status, missing FROM m""",
    "search_completeness": """
SELECT c_nationkey AS place, count(*) AS read, count(*) + CASE WHEN c_nationkey = 3 THEN 5 ELSE 0 END AS stated, c_nationkey <> 3 AS complete, ceil((count(*) + CASE WHEN c_nationkey = 3 THEN 5 ELSE 0 END) / 40)::INTEGER AS pages FROM customer GROUP BY 1""",
    "page_listings": """
WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN 'Maison ' || p_partkey WHEN p_partkey % 20 <> 0 THEN 'Terrain & vue ' || p_partkey END AS title, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 6 <> 0 THEN p_retailprice END AS price,
  p_size::DOUBLE AS area, CASE WHEN p_partkey % 3 <> 0 AND p_size > 0 THEN p_size END AS rooms, CASE WHEN p_partkey % 4 <> 0 THEN 'Maison' WHEN p_partkey % 20 <> 0 THEN 'Terrain' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS agency FROM part),
m AS (SELECT *, array_to_string(list_filter([CASE WHEN price IS NULL THEN 'price' END, CASE WHEN agency IS NULL THEN 'agency' END], lambda x: x IS NOT NULL), ',') AS missing FROM p)
SELECT k AS p_partkey, title, price, area, rooms::INTEGER AS rooms, kind, agency, CASE WHEN title IS NULL THEN 'failed' WHEN missing <> '' THEN 'partial' ELSE 'ok' END AS status, missing FROM m""",
    "size_disagreement": "SELECT l_orderkey, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND (max(l_quantity) - min(l_quantity)) / nullif(max(l_quantity), 0) > 0.2",
    "stale_sources": "SELECT l_suppkey, max(l_shipdate) AS newest, floor(date_diff('second', max(l_shipdate), TIMESTAMP '2001-11-25') / 86400)::BIGINT AS days FROM lineitem GROUP BY 1 HAVING max(l_shipdate) < TIMESTAMP '2001-11-18'",
    "missing_by_kind": """
SELECT p_brand, p_type, count(*) AS n, round(100.0 * count(*) FILTER (p_size < 10) / count(*), 2)::DOUBLE AS no_size, round(100.0 * count(*) FILTER (p_partkey % 9 = 0) / count(*), 2)::DOUBLE AS no_price FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1, 2""",
    "merged_groups": """
WITH p AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS sources, (max(l_extendedprice) - min(l_extendedprice)) / nullif(max(l_extendedprice), 0) AS spread FROM lineitem GROUP BY 1)
SELECT * FROM (SELECT l_orderkey, n, sources, 'largest' AS why FROM p ORDER BY n DESC, l_orderkey LIMIT 5) UNION ALL SELECT l_orderkey, n, sources, 'apart' FROM p WHERE n > 1 AND spread > 0.1""",
    "unplaced_strays": """
SELECT l_suppkey, count(*) AS n, count(*) FILTER (c_nationkey % 5 <> s_nationkey % 5) AS strays, array_to_string(list_sort(list(DISTINCT c_nationkey % 5)), ',') AS places
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""",
    "taken_over": """
WITH p AS (SELECT p_partkey AS id, p_brand, p_type, round(p_retailprice, -1) AS price, p_partkey % 3 <> 0 AS active, CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2024-01-01' - to_minutes(p_partkey) END AS gone, p_size FROM part),
r AS (SELECT DISTINCT ON (n.id) n.id, n.price, s.id AS repost_of, s.p_size AS first_seen, s.active FROM p AS n JOIN p AS s ON n.id % 2 = 0 AND s.id % 2 = 1 AND n.p_brand = s.p_brand AND n.p_type = s.p_type AND n.price = s.price
  AND (s.active OR s.gone >= TIMESTAMP '2024-01-01' - INTERVAL 14 DAY) ORDER BY n.id, s.active DESC, s.gone DESC NULLS LAST, s.id)
SELECT id, repost_of, first_seen, 'active' AS status, CASE WHEN NOT active THEN price END AS price_to FROM r QUALIFY row_number() OVER (PARTITION BY repost_of ORDER BY id) = 1""",
    "carried_hosts": "SELECT s_suppkey, 'a' || s_suppkey % 4 || '.fr' AS host FROM supplier UNION ALL SELECT s_suppkey, 'b.fr' FROM supplier",
    "merged_json": "SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE (props->>'k')::BIGINT END AS k, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'y' END AS m, count(*) AS n FROM events GROUP BY 1, 2",
    "portal_names": """
WITH h AS (SELECT string_split(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', ''), '.')[-2] AS site FROM pages)
SELECT CASE WHEN site = 'example' THEN 'Example' WHEN site IS NOT NULL THEN 'agency sites' END AS portal, count(*) AS n FROM h GROUP BY 1""",
    "explained_checks": """
WITH s AS (SELECT s_suppkey AS k, (['green', 'amber', 'red', 'unknown'])[k % 4 + 1] AS a, (['green', 'amber', 'red', 'unknown'])[(k * 3 + 1) % 4 + 1] AS ar, (['green', 'amber', 'red', 'unknown'])[k * 3 % 4 + 1] AS b, (['green', 'amber', 'red', 'unknown'])[(k + 1) % 4 + 1] AS br FROM supplier),
t AS (SELECT *, a IN ('red', 'amber') AS fa, ar IN ('red', 'amber') AS far, b IN ('red', 'amber') AS fb, br IN ('red', 'amber') AS fbr FROM s)
SELECT 'c' AS "check", k AS source, CASE WHEN fa THEN a WHEN far THEN ar WHEN fb THEN b ELSE br END AS status,
  CASE WHEN NOT fa AND NOT far THEN 'cleared' WHEN NOT fa THEN 'explained' WHEN fb THEN 'known' ELSE 'new' END AS state FROM t WHERE fa OR far OR fb OR fbr""",
    "check_brief": """
WITH d AS (SELECT DISTINCT o_orderdate AS run FROM orders ORDER BY 1 DESC LIMIT 14), r AS (SELECT o_orderpriority AS c, o_orderdate AS run, CASE WHEN count(*) > 2 THEN 'r' WHEN count(*) > 1 THEN 'a' ELSE 'g' END AS s FROM orders WHERE o_orderdate IN (FROM d) GROUP BY 1, 2),
l AS (SELECT c, run, s, s <> lag(s) OVER (PARTITION BY c ORDER BY run) AS moved FROM r)
SELECT c AS "check", string_agg(s, '' ORDER BY run) AS statuses, count(*) FILTER (moved)::INTEGER AS changes FROM l GROUP BY 1""",
}
