"""Serving and feed-health queries. Orders stand for properties, their lines for listings, suppliers for
sources, customers for agencies and buyers. The stand-ins are one text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import dates
from marlstone.operators import health, latest, serving
from marlstone.sources.tables import table

NOW = "1999-07-01"
PLACES, SUBSCRIBED = range(12), range(1, 80)

_P = """SELECT o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderstatus = 'F' THEN 'delisted' ELSE 'active' END AS status, o_orderdate AS first_listed, o_custkey % 25 AS place,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS agency FROM orders"""
_L = """SELECT l_orderkey AS id, l_suppkey AS source, CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'delisted' END AS status, l_shipdate AS first_seen,
  CASE WHEN l_partkey % 3 = 0 THEN l_shipdate ELSE TIMESTAMP '1999-06-29 00:00:00' END AS updated, l_partkey % 25 AS place, l_extendedprice AS price, l_partkey, l_linenumber FROM lineitem"""
_S = "SELECT s_suppkey AS source, s_name AS name, s_acctbal > 0 AS enabled FROM supplier"
_R = """SELECT o_orderkey AS run, o_custkey % 100 + 1 AS source, o_orderdate AS started_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at,
  CASE WHEN o_orderkey % 7 = 0 THEN 'partial' WHEN o_orderkey % 11 = 0 THEN 'aborted' ELSE 'done' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN 'broken' END AS error, o_orderkey % 50 AS seen FROM orders"""
_B = "SELECT c_custkey AS buyer, c_custkey % 7 = 0 AS is_test FROM customer"
_M = """SELECT o_custkey AS buyer, o_orderkey AS property, CASE o_orderkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'seen' WHEN 2 THEN 'sent' ELSE 'dismissed' END AS status FROM orders"""
_H = """SELECT p_partkey AS id, p_size % 8 AS place, round(p_retailprice * 1000) AS price, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 2.0e0 END AS area,
  CASE WHEN p_partkey % 3 <> 0 THEN p_size % 5 END AS bedrooms, p_partkey % 4 AS source_count, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 50 END AS first_listed,
  CASE WHEN p_partkey % 30 = 0 THEN p_brand END AS image, CASE p_partkey % 5 WHEN 0 THEN 'Maison' WHEN 1 THEN 'Appartement' WHEN 2 THEN 'Terrain' END AS kind, p_name AS title FROM part"""


def _frames(spark: SparkSession, sf_dir: str, *texts: str) -> list[DataFrame]:
    names = ("orders", "lineitem", "supplier", "customer", "part", "events")
    tables = {n: table(spark, sf_dir, n) for n in names}
    out = []
    for text in texts:
        name = next(n for n in names if text.endswith(f"FROM {n}"))
        out.append(spark.sql(text.removesuffix(name) + "{t}", t=tables[name]))
    return out


def _now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


def _shown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    p, lines, s = _frames(spark, sf_dir, _P, _L, _S)
    return p, lines, s, serving.live(p, lines, s, PLACES, SUBSCRIBED)


def property_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 20 live properties of a price, newest first, with the totals over all pages."""
    _, lines, s, live = _shown(spark, sf_dir)
    page = serving.property_page(live.where("price >= 50000"), serving.shown_listings(lines, s, SUBSCRIBED), 20, 20)
    agency = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agency"), F.col("c_name").alias("agency_name"))
    page = page.join(agency, "agency", "left")
    return page.select("id", "price", "agency_name", dates.days_between(F.col("first_listed"), F.lit("2002-01-01").cast("timestamp")).alias("days"), "total", "total_listings")


def portal_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which portals carry each property: directly held ones, then what an aggregator carries."""
    (lines,) = _frames(spark, sf_dir, _L)
    rows = lines.select(F.xxhash64("id", "source", "l_partkey", "l_linenumber", "first_seen").alias("row"), "id", (F.col("source") % 5).alias("source"), F.when(F.col("l_partkey") % 2 == 0, "agg").alias("via"), F.col("first_seen").alias("last_seen"))
    return serving.chips(rows).select("id", F.array_join(F.transform("chips", lambda c: F.concat(c["source"].cast("string"), c["via"])), ",").alias("chips"))


def property_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property with its listings, its last three events and its agency's live properties."""
    p, lines, s, live = _shown(spark, sf_dir)
    held = lines.join(s.where("enabled").where(F.col("source").isin(*SUBSCRIBED)).select("source"), "source", "left_semi")
    events = lines.select("id", F.col("first_seen").alias("at"), F.concat_ws("-", "source", "l_partkey", "l_linenumber").alias("event"), F.col("status").alias("type"))
    out = serving.details(p, held, events, live, 3)
    return out.select("id", F.size("listings").alias("n_listings"), F.array_join(F.transform("listings", lambda x: x["source"].cast("string")), ",").alias("sources"), F.size("history").alias("n_events"), F.element_at("history", 1)["at"].alias("last_event"), "agency_active")


def market_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live properties, new ones, buyers and open matches."""
    p, _, _, live = _shown(spark, sf_dir)
    b, m = _frames(spark, sf_dir, _B, _M)
    return serving.overview(p.where(F.col("place").isin(*PLACES)), live, b, m, _now())


def source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: listings by state and age, whether it is being filled up, its last run."""
    lines, s, r = _frames(spark, sf_dir, _L, _S, _R)
    out = serving.source_stats(s, lines, r, _now())
    return out.select("name", "active", "ever", "delisted", "places", "new_1d", "new_7d", "stale", "filling", "last_status", "last_started", "last_seen_count")


def snapshot_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot page of 100 live properties and one more: listings as served, and the last change."""
    _, lines, _, live = _shown(spark, sf_dir)
    rows = lines.select(
        F.xxhash64("id", "source", "l_partkey", "l_linenumber", "first_seen").alias("row"), "id", (F.col("source") % 5).alias("source"), "status",
        F.when(F.col("l_partkey") % 2 == 0, "agg").alias("via"), F.col("first_seen").alias("last_seen"), (F.col("source") % 9).alias("agency"),
    )
    changes = lines.where("l_partkey % 2 = 0").select("id", F.col("first_seen").alias("at"), F.concat_ws("-", "source", "l_partkey", "l_linenumber").alias("event"), F.col("price").alias("price_from"), (F.col("price") + 1).alias("price_to"))
    out = serving.snapshot(live, rows, changes, [1, 2], 100, 500)
    return out.select("id", F.coalesce(F.array_join(F.transform("chips", lambda c: F.concat(c["source"].cast("string"), c["via"])), ","), F.lit("")).alias("chips"), F.col("last_change.at").alias("changed_at"))


def collection_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last completed run of each source, or of what it carries, came to."""
    s, r, lines = _frames(spark, sf_dir, _S, _R, _L)
    carried = lines.where("status = 'active'").select("source", (F.col("l_partkey") % 130 + 1).alias("key"))
    return serving.outcomes(s, r, carried, [1, 2, 3, 4]).select("key", "last_run", "outcome", "via")


def last_good_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a run last ended well."""
    (r,) = _frames(spark, sf_dir, _R)
    return serving.last_good_run(r)


def report_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored monthly reports after a new run of the last year: by place and month."""
    (p,) = _frames(spark, sf_dir, _P)
    month = F.to_date(F.date_trunc("month", "first_listed"))
    report = lambda df: df.groupBy("place", month.alias("month")).agg(F.count("*").alias("n"), F.round(F.percentile("price", F.lit(0.5)), 4).alias("median"))
    old, new = report(p.where("status = 'active'")), report(p.where("first_listed >= '2000-06-01'"))
    return serving.stored_reports(old, new, ["place", "month"])


def gallery_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a source's listings: parts a supplier ships stand for images."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_partkey").alias("images"))
    return serving.gallery_counts(rows, "l_returnflag")


def sample_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand, those of a size, and the first five of these."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"))
    return serving.sampled(part, "p_brand", "p_size", "p_partkey")


def subscribed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of active clients by the sources they subscribe to."""
    c = table(spark, sf_dir, "customer")
    clients = c.select(F.col("c_custkey").alias("client"), (F.col("c_acctbal") > 0).alias("active"), F.array(F.col("c_nationkey"), F.col("c_custkey") % 25).alias("places"))
    subscriptions = c.select(F.col("c_custkey").alias("client"), (F.col("c_custkey") % 10).alias("source"), (F.col("c_mktsegment") != "BUILDING").alias("enabled"))
    return serving.subscribed_places(clients, subscriptions)


def hidden_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are perhaps a higher-ranked one again."""
    (p,) = _frames(spark, sf_dir, _H)
    return serving.hidden_duplicates(p)


def agency_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agencies after a pass: stored ones filled in, new ones named by their first row."""
    part = table(spark, sf_dir, "part")
    seen = part.select(F.col("p_partkey").alias("row"), F.concat_ws(" ", "p_brand", F.when(F.col("p_partkey") % 2 == 0, "SARL")).alias("name"), F.when(F.col("p_size") % 3 != 0, (F.col("p_size") % 3).cast("string")).alias("postcode"),
                       F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).alias("address"), F.lit(None).cast("string").alias("city"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey").cast("string")).alias("phone"))
    stored = table(spark, sf_dir, "supplier").where("s_suppkey <= 5").select(
        F.col("s_suppkey").alias("agency"), F.concat(F.lit("brand#"), F.col("s_suppkey").cast("string"), F.lit("2")).alias("name"), F.lit("1").alias("postcode"), F.lit("old street").alias("address"), F.lit("").alias("city"), F.lit(None).cast("string").alias("phone"))
    agencies, which = serving.resolved_agencies(stored, seen)
    n = which.groupBy("agency").agg(F.count("*").alias("n"))
    return agencies.join(n, "agency", "left").select("name", "postcode", "address", "phone", F.coalesce("n", F.lit(0)).alias("n"))


def fill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which a figure is missing and could be read."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        "doc_id", F.when(F.col("doc_id") % 5 != 0, "active").otherwise("gone").alias("status"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("place"), F.col("text").alias("description"), F.col("doc_id").isin(1, 2, 3).alias("was_read"),
        F.when(F.col("doc_id") % 3 == 0, "Maison").when(F.col("doc_id") % 3 == 1, "Terrain").alias("kind"), F.when(F.col("doc_id") % 2 == 0, 3).alias("bedrooms"), F.when(F.col("doc_id") % 4 != 0, 90.0).alias("area"), F.when(F.col("doc_id") % 8 == 1, " Vente : x").otherwise("Belle vue").alias("title"),
    )
    return serving.fill_candidates(rows).select("doc_id", "kind")


def missed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price changes that old pages show and no event tells."""
    lines = table(spark, sf_dir, "lineitem")
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price"))
    pages = lines.select(F.col("l_orderkey").alias("key"), F.when(F.col("l_partkey") % 3 != 0, F.round("l_extendedprice", -3)).alias("price"), F.col("l_shipdate").alias("fetched_at"))
    events = lines.where("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("key"), F.round("l_extendedprice", -3).alias("price_to")).join(stored.withColumnRenamed("price", "price_from"), "key")
    return serving.missed_changes(stored, pages, events)


def replay_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as their last landed page says, where that differs."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    body = F.to_json(F.struct(F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).alias("flag"), F.col("l_linenumber").alias("line")))
    pages = lines.select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("fetched_at"), body.alias("body"))
    stored = orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("flag"), F.lit(1).alias("line"))
    parse = lambda df: df.select("key", F.from_json("body", "flag string, line int").alias("x")).select("key", "x.*")
    return serving.replayed(pages, stored, parse, "key").groupBy("flag").agg(F.count("*").alias("n"))


def parse_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read as listings: how many are whole, in part, or failed, and what they lack."""
    part = table(spark, sf_dir, "part")
    fields = F.struct(F.when(F.col("p_partkey") % 50 != 0, F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("price"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("area"), F.col("p_brand").alias("agency"))
    got = part.select(serving.parsed_result(fields).alias("r"))
    return got.groupBy(F.col("r.status").alias("status"), F.array_join("r.missing", ",").alias("missing")).agg(F.count("*").alias("n"))


def euro_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The euro price of pages in several currencies, by its origin."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    got = serving.euro_price(
        F.when(k % 2 == 0, "eur").otherwise("USD"), F.col("p_retailprice"), k % 3 == 0, F.when(k % 5 == 0, "EUR").otherwise("USD"), F.when(k % 10 == 0, F.col("p_size")), F.when(k % 7 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" 500 €"))))
    return p.select(k.alias("p_partkey"), got["price"].alias("price"), got["origin"].alias("origin")).where("origin IS NOT NULL")


def feed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: verdicts on its feed of orders, by size, age and closings."""
    o = table(spark, sf_dir, "orders").withColumn("place", F.col("o_custkey") % 25)
    day = F.datediff(F.lit(NOW).cast("date"), F.to_date("o_orderdate"))
    per = o.groupBy("place").agg(
        F.count("*").alias("size"), ((F.unix_timestamp(_now()) - F.unix_timestamp(F.max(F.when(F.col("o_orderdate") < _now(), F.col("o_orderdate"))))) / 60).alias("age"),
        F.count_if(day.between(0, 30)).alias("closed"), *(F.count_if(day.between(31 * k, 31 * k + 30)).alias(f"c{k}") for k in (1, 2, 3)),
    )
    checks = health.feed_checks(F.col("size"), F.col("age"), F.array(F.col("size") * 2, F.lit(700)), F.col("closed"), F.array(F.col("c1"), F.col("c2"), F.col("c3")))
    return per.select("place", F.explode(checks).alias("c")).select("place", "c.check", "c.status")


def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: a verdict on its last run."""
    (r,) = _frames(spark, sf_dir, _R)
    last = latest.latest_per(r, ["source"], F.col("started_at").desc(), F.col("run").desc())
    age = (F.unix_timestamp(F.lit("2001-08-02").cast("timestamp")) - F.unix_timestamp("started_at")) / 60
    return health.run_checks(last.select("source", F.col("status").alias("outcome"), age.alias("age"))).select("source", "status", "hours")


def portal_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand: part types of this and of the previous run."""
    p = table(spark, sf_dir, "part")
    now, before = F.array_sort(F.collect_set(F.when(F.col("p_size") > 20, F.col("p_type")))), F.collect_set(F.when((F.col("p_size") < 22) & (F.col("p_brand") != "Brand#11"), F.col("p_type")))
    per = p.groupBy("p_brand").agg(health.portals_changed(now, before).alias("v"))
    return per.select("p_brand", "v.status", F.array_join("v.added", ",").alias("added"), F.array_join("v.gone", ",").alias("gone"))


def value_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose lines carry refused values, as a share of their lines."""
    lines = table(spark, sf_dir, "lineitem")
    refused = lines.where("l_discount > 0.07 AND l_suppkey % 3 <> 0 OR l_tax > 0.075").select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("property"), F.when(F.col("l_tax") > 0.075, "tax").otherwise("discount").alias("field"))
    return health.origins(refused, lines.groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("active")))


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What served listings and their properties have, by source."""
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    properties = o.select(
        k.alias("property"), F.col("o_orderpriority").alias("kind"), F.when(k % 6 != 0, k % 5).alias("place"), F.when(k % 3 == 0, 2).alias("bedrooms"), F.when(k % 4 == 0, "http://a/x").when(k % 4 == 1, "https://a/x").alias("image"),
        F.when(k % 5 == 0, F.array(F.lit("http://b"), F.lit("https://b"))).alias("images"), F.when(k % 7 == 0, F.array(F.lit("Surface 3"), F.lit("4 chambres"))).when(k % 7 == 1, F.array(F.lit("Studio"))).alias("labels"),
    )
    listings = lines.select(F.col("l_orderkey").alias("property"), F.col("l_suppkey").alias("source"), F.when(F.col("l_partkey") % 8 != 0, F.col("l_shipdate")).alias("first_seen"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_extendedprice")).alias("price"), F.col("l_quantity").alias("area"), F.lit(None).cast("int").alias("bedrooms"))
    h = health.history(properties, listings)
    return h.groupBy("source").agg(*(F.count_if(c).alias(c) for c in ("has_price", "has_area", "has_bedrooms", "property_has_bedrooms", "has_photo", "has_place")), F.count("*").alias("n"))


def status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each nation by status."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("side"), F.when(F.col("s_suppkey") % 5 != 0, F.when(F.col("s_acctbal") > 5000, "green").when(F.col("s_acctbal") > 1000, "amber").when(F.col("s_acctbal") > 0, "unknown").otherwise("red")).alias("status"))
    return health.tally(s, "side")


def duplicate_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand: a verdict on its share of hidden duplicates against two earlier shares."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 46).alias("hidden"))
    v = health.duplicates_share(F.col("hidden"), F.col("n"), F.array(F.lit(0.02), F.lit(0.06)))
    return p.select("p_brand", "n", "hidden", v["status"].alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        property_page, portal_chips, property_details, market_overview, source_statistics, snapshot_page, collection_outcomes, last_good_run, report_store, gallery_check,
        sample_covers, subscribed_places, hidden_duplicates, agency_resolution, fill_candidates, missed_changes, replay_scan, parse_results, euro_prices, feed_verdicts,
        run_verdicts, portal_changes, value_origins, history_rows, status_tally, duplicate_shares,
    )
}

_FROM = f"p AS ({_P}), l AS ({_L}), s AS ({_S})"
_SHOWN = "x AS (SELECT l.* FROM l JOIN s USING (source) WHERE l.status = 'active' AND s.enabled AND source BETWEEN 1 AND 79)"
_LIVE = f"{_FROM}, {_SHOWN}, v AS (SELECT * FROM p WHERE status = 'active' AND place < 12 AND id IN (SELECT id FROM x))"
_CARRIED = """c AS (SELECT id, source % 5 AS source, CASE WHEN l_partkey % 2 = 0 THEN 'agg' END AS via, status, source % 9 AS agency, first_seen FROM l)"""


def _chips(rows: str) -> str:
    """SQL of the chips of rows (id, source, via)."""
    return f"""(SELECT id, string_agg(source || coalesce(via, ''), ',' ORDER BY via IS NOT NULL, source) AS chips FROM (SELECT id, source, via FROM {rows} WHERE via IS NULL
  UNION ALL SELECT DISTINCT id, source, via FROM {rows} AS a WHERE via IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {rows} AS d WHERE d.id = a.id AND d.source = a.source AND d.via IS NULL)) GROUP BY id)"""


ORACLES = {
    "property_page": f"""
WITH {_LIVE}, f AS (SELECT * FROM v WHERE price >= 50000)
SELECT id, price, c_name AS agency_name, date_diff('day', first_listed::DATE, DATE '2002-01-01') AS days, (SELECT count(*) FROM f) AS total,
  (SELECT count(*) FROM x WHERE id IN (SELECT id FROM f)) AS total_listings FROM f LEFT JOIN customer ON c_custkey = agency ORDER BY first_listed DESC, id DESC LIMIT 20 OFFSET 20""",
    "portal_chips": f"WITH {_FROM}, {_CARRIED} SELECT id, chips FROM {_chips('c')}",
    "property_details": f"""
WITH {_LIVE}, h AS (SELECT l.* FROM l JOIN s USING (source) WHERE s.enabled AND source BETWEEN 1 AND 79),
n AS (SELECT id, count(*)::INTEGER AS n_listings, string_agg(source, ',' ORDER BY source, status, price) AS sources FROM h GROUP BY 1),
e AS (SELECT id, least(count(*), 3)::INTEGER AS n_events, max(first_seen) AS last_event FROM l GROUP BY 1), a AS (SELECT agency, count(*) AS k FROM v GROUP BY 1)
SELECT id, n_listings, sources, n_events, last_event, CASE WHEN p.agency IS NOT NULL THEN coalesce(k, 0) END AS agency_active FROM p JOIN n USING (id) LEFT JOIN e USING (id) LEFT JOIN a USING (agency)""",
    "market_overview": f"""
WITH {_LIVE}, b AS ({_B}), m AS ({_M})
SELECT (SELECT count(*) FROM v) AS active, (SELECT count(*) FROM v WHERE first_listed > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS new_in_window,
  (SELECT count(*) FROM b WHERE NOT is_test) AS buyers_real, (SELECT count(*) FROM b WHERE is_test) AS buyers_test,
  (SELECT count(*) FROM m JOIN b USING (buyer) WHERE status IN ('new', 'seen') AND NOT is_test AND property IN (SELECT id FROM v)) AS matches_open""",
    "source_statistics": f"""
WITH {_FROM}, r AS ({_R}), t AS (SELECT TIMESTAMP '{NOW}' AS now),
c AS (SELECT source, count(*) FILTER (status = 'active') AS active, count(*) AS ever, count(*) FILTER (status <> 'active') AS delisted, count(DISTINCT place) FILTER (status = 'active') AS places,
  count(*) FILTER (status = 'active' AND first_seen > now - INTERVAL 1 DAY) AS new_1d, count(*) FILTER (status = 'active' AND first_seen > now - INTERVAL 7 DAY) AS new_7d,
  count(*) FILTER (status = 'active' AND updated < now - INTERVAL 7 DAY) AS stale FROM l, t GROUP BY 1),
q AS (SELECT DISTINCT ON (source) source, status AS last_status, started_at AS last_started, seen AS last_seen_count FROM r ORDER BY source, started_at DESC, run DESC)
SELECT name, coalesce(active, 0) AS active, coalesce(ever, 0) AS ever, coalesce(delisted, 0) AS delisted, coalesce(places, 0) AS places, coalesce(new_1d, 0) AS new_1d, coalesce(new_7d, 0) AS new_7d,
  coalesce(stale, 0) AS stale, coalesce(new_1d, 0) > coalesce(active, 0) * 0.5 AS filling, last_status, last_started, last_seen_count FROM s LEFT JOIN c USING (source) LEFT JOIN q USING (source)""",
    "snapshot_page": f"""
WITH {_LIVE}, {_CARRIED}, g AS (SELECT id FROM v WHERE id > 500 ORDER BY id LIMIT 101),
o AS (SELECT * FROM c WHERE status = 'active' AND id IN (FROM g)), w AS (SELECT * FROM o WHERE agency IN (1, 2) OR NOT EXISTS (SELECT 1 FROM o AS q WHERE q.id = o.id AND q.agency IN (1, 2))),
k AS {_chips('w')}, z AS (SELECT id, max(first_seen) AS changed_at FROM l WHERE l_partkey % 2 = 0 GROUP BY 1)
SELECT g.id, coalesce(chips, '') AS chips, changed_at FROM g LEFT JOIN k USING (id) LEFT JOIN z USING (id)""",
    "collection_outcomes": f"""
WITH {_FROM}, r AS ({_R}), q AS (SELECT DISTINCT ON (source) source, completed_at, CASE WHEN status = 'partial' THEN 'partial' WHEN error IS NOT NULL THEN 'error' ELSE status END AS outcome
  FROM r WHERE completed_at IS NOT NULL ORDER BY source, completed_at DESC, run DESC),
t AS (SELECT source, completed_at, coalesce(outcome, 'never') AS outcome FROM s LEFT JOIN q USING (source) WHERE enabled), d AS (SELECT * FROM t WHERE source NOT IN (1, 2, 3, 4)),
k AS (SELECT DISTINCT source, l_partkey % 130 + 1 AS key FROM l WHERE status = 'active')
SELECT source AS key, completed_at AS last_run, outcome, NULL AS via FROM d
UNION ALL SELECT * FROM (SELECT DISTINCT ON (key) key, completed_at, outcome, source::VARCHAR FROM t JOIN k USING (source) WHERE source IN (1, 2, 3, 4) AND key NOT IN (SELECT source FROM d) ORDER BY key, completed_at DESC NULLS LAST, source)""",
    "last_good_run": f"WITH r AS ({_R}) SELECT max(completed_at) AS last_good FROM r WHERE status = 'partial' OR (status = 'done' AND error IS NULL)",
    "report_store": f"""
WITH {_FROM}, q AS (SELECT *, date_trunc('month', first_listed)::DATE AS month FROM p),
o AS (SELECT place, month, count(*) AS n, round(quantile_cont(price, 0.5), 4) AS median FROM q WHERE status = 'active' GROUP BY 1, 2),
w AS (SELECT place, month, count(*) AS n, round(quantile_cont(price, 0.5), 4) AS median FROM q WHERE first_listed >= '2000-06-01' GROUP BY 1, 2)
SELECT * FROM w UNION ALL SELECT * FROM o WHERE (place, month) NOT IN (SELECT (place, month) FROM w)""",
    "gallery_check": """
WITH g AS (SELECT l_orderkey, l_returnflag, count(*) AS k FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, count(*) AS n, count(*) FILTER (k > 1) AS with_gallery, max(k)::INTEGER AS most FROM g GROUP BY 1""",
    "sample_covers": """
SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 25) AS with_value, array_to_string((list(p_size ORDER BY p_partkey) FILTER (p_size > 25))[1:5], ',') AS samples FROM part GROUP BY 1""",
    "subscribed_places": """
SELECT DISTINCT source, place FROM (SELECT c_custkey % 10 AS source, unnest([c_nationkey, c_custkey % 25]) AS place FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING')""",
    "hidden_duplicates": f"""
WITH h AS ({_H}), a AS (SELECT *, coalesce(area < 25 OR price / nullif(area, 0) > 100000, false) AND area IS NOT NULL AS bad, CASE WHEN NOT coalesce(area < 25 OR price / nullif(area, 0) > 100000, false) THEN area END AS ok,
  CASE kind WHEN 'Maison' THEN 'house' WHEN 'Appartement' THEN 'flat' WHEN 'Terrain' THEN 'land' END AS k, row_number() OVER (PARTITION BY place ORDER BY source_count DESC, first_listed NULLS LAST, id) AS rk FROM h)
SELECT DISTINCT y.id FROM a AS x JOIN a AS y ON x.place = y.place AND x.rk < y.rk WHERE x.image = y.image OR (
  abs(x.price - y.price) <= 0.01 * greatest(x.price, y.price) AND (x.k IS NULL OR y.k IS NULL OR x.k = y.k) AND (x.bedrooms IS NULL OR y.bedrooms IS NULL OR abs(x.bedrooms - y.bedrooms) <= 1)
  AND (coalesce(abs(x.ok - y.ok) <= CASE WHEN x.price >= 1000000 THEN 0.2 ELSE 0.03 END * greatest(x.ok, y.ok), false)
    OR ((x.bad OR y.bad) AND (x.ok IS NOT NULL OR x.bad) AND (y.ok IS NOT NULL OR y.bad) AND coalesce(x.k = y.k, false) AND (x.bedrooms IS NULL OR y.bedrooms IS NULL OR x.bedrooms = y.bedrooms))))""",
    "agency_resolution": """
WITH q AS (SELECT p_partkey AS row, p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' SARL' ELSE '' END AS name, replace(lower(p_brand), '#', ' ') AS norm, CASE WHEN p_size % 3 <> 0 THEN (p_size % 3)::VARCHAR END AS postcode,
  CASE WHEN p_partkey % 7 = 0 THEN p_name END AS address, CASE WHEN p_partkey % 5 = 0 THEN p_partkey::VARCHAR END AS phone FROM part),
n AS (SELECT norm, postcode, arg_min(name, row) AS name, arg_min(address, row) FILTER (address IS NOT NULL) AS address, arg_min(phone, row) FILTER (phone IS NOT NULL) AS phone, count(*) AS n FROM q GROUP BY 1, 2),
o AS (SELECT 'brand#' || s_suppkey || '2' AS name, 'brand ' || s_suppkey || '2' AS norm, '1' AS postcode, 'old street' AS address FROM supplier WHERE s_suppkey <= 5)
SELECT coalesce(o.name, n.name) AS name, coalesce(o.postcode, n.postcode) AS postcode, coalesce(o.address, n.address) AS address, phone, coalesce(n, 0) AS n
FROM o FULL JOIN n ON o.norm = n.norm AND o.postcode = n.postcode""",
    "fill_candidates": """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Maison' WHEN 1 THEN 'Terrain' END AS kind FROM documents
WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id NOT IN (1, 2, 3) AND length(coalesce(text, '')) >= 80
  AND (doc_id % 2 = 1 AND doc_id % 3 <> 1 OR doc_id % 4 = 0 AND doc_id % 3 <> 1 OR doc_id % 3 = 2 OR doc_id % 8 = 1)""",
    "missed_changes": """
WITH s AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price FROM orders),
g AS (SELECT l_orderkey AS key, round(l_extendedprice, -3) AS price, l_shipdate AS seen_at, l_suppkey % 2 = 0 AS told, l_partkey % 3 <> 0 AS priced FROM lineitem)
SELECT key, s.price AS price_from, g.price AS price_to, min(seen_at) AS occurred_at, g.price - s.price AS delta, round((g.price - s.price) / s.price * 100, 2) AS percent
FROM g JOIN s USING (key) WHERE priced AND s.price <> g.price AND NOT EXISTS (SELECT 1 FROM g AS e WHERE e.key = g.key AND e.told AND e.price = g.price) GROUP BY key, s.price, g.price""",
    "replay_scan": """
WITH b AS (SELECT l_orderkey AS key, l_shipdate AS seen_at, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS flag, l_linenumber AS line,
  CASE WHEN l_partkey % 2 = 0 THEN '{"flag":"' || l_returnflag || '",' ELSE '{' END || '"line":' || l_linenumber || '}' AS body FROM lineitem),
n AS (SELECT DISTINCT ON (key) * FROM b ORDER BY key, seen_at DESC, sha256(body)), m AS (SELECT coalesce(n.flag, o_orderstatus) AS flag, coalesce(n.line, 1) AS line, o_orderstatus AS was FROM orders LEFT JOIN n ON key = o_orderkey)
SELECT flag, count(*) AS n FROM m WHERE flag <> was OR line <> 1 GROUP BY 1""",
    "parse_results": """
WITH r AS (SELECT p_partkey % 50 = 0 AS f, array_to_string(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'price' END, CASE WHEN p_partkey % 3 = 0 THEN 'area' END], lambda x: x IS NOT NULL), ',') AS missing FROM part)
SELECT CASE WHEN f THEN 'failed' WHEN missing <> '' THEN 'partial' ELSE 'ok' END AS status, missing, count(*) AS n FROM r GROUP BY 1, 2""",
    "euro_prices": """
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'offer' WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 10 = 0 THEN 'shown' END WHEN p_partkey % 7 = 0 THEN 'line' END AS origin, p_retailprice, p_size FROM part)
SELECT p_partkey, CASE origin WHEN 'offer' THEN round(p_retailprice) WHEN 'shown' THEN p_size ELSE p_size * 1000 + 500 END::DOUBLE AS price, origin FROM r WHERE origin IS NOT NULL""",
    "feed_verdicts": f"""
WITH o AS (SELECT o_custkey % 25 AS place, o_orderdate, date_diff('day', o_orderdate::DATE, DATE '{NOW}') AS d FROM orders),
p AS (SELECT place, count(*) AS n, date_diff('second', max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '{NOW}'), TIMESTAMP '{NOW}') / 60 AS age, count(*) FILTER (d BETWEEN 0 AND 30) AS c0,
  list_sort([count(*) FILTER (d BETWEEN 31 AND 61), count(*) FILTER (d BETWEEN 62 AND 92), count(*) FILTER (d BETWEEN 93 AND 123)])[2] AS usual FROM o GROUP BY 1),
q AS (SELECT *, n / ((n * 2 + 700) / 2) - 1 AS change FROM p)
SELECT place, 'sync' AS "check", CASE WHEN change < -0.4 THEN 'red' WHEN change < -0.15 THEN 'amber' WHEN age IS NULL OR age > 1800 THEN 'red' WHEN age > 1560 THEN 'amber' ELSE 'green' END AS status FROM q
UNION ALL SELECT place, 'delisted', CASE WHEN c0 > n * 0.05 THEN 'red' WHEN c0 > greatest(30, usual * 3) THEN 'amber' ELSE 'green' END FROM q""",
    "run_verdicts": f"""
WITH r AS ({_R}), q AS (SELECT DISTINCT ON (source) source, status AS outcome, date_diff('second', started_at, TIMESTAMP '2001-08-02') / 60 AS age FROM r ORDER BY source, started_at DESC, run DESC)
SELECT source, CASE WHEN outcome = 'aborted' OR age > 2880 THEN 'red' WHEN age > 1560 THEN 'amber' ELSE 'green' END AS status, floor(age / 60 + 0.5)::BIGINT AS hours FROM q""",
    "portal_changes": """
WITH p AS (SELECT p_brand, coalesce(list(DISTINCT p_type) FILTER (p_size > 20), []) AS a, coalesce(list(DISTINCT p_type) FILTER (p_size < 22 AND p_brand <> 'Brand#11'), []) AS b FROM part GROUP BY 1),
q AS (SELECT p_brand, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS added, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS gone, len(b) = 0 AS first FROM p)
SELECT p_brand, CASE WHEN len(gone) > 0 THEN 'red' WHEN len(added) > 0 AND NOT first THEN 'amber' ELSE 'green' END AS status, CASE WHEN first THEN '' ELSE array_to_string(added, ',') END AS added, array_to_string(gone, ',') AS gone FROM q""",
    "value_origins": """
WITH r AS (SELECT l_suppkey AS source, count(DISTINCT l_orderkey) AS properties, array_to_string(list_sort(list(DISTINCT CASE WHEN l_tax > 0.075 THEN 'tax' ELSE 'discount' END)), ',') AS fields
  FROM lineitem WHERE l_discount > 0.07 AND l_suppkey % 3 <> 0 OR l_tax > 0.075 GROUP BY 1), a AS (SELECT l_suppkey AS source, count(*) AS active FROM lineitem GROUP BY 1)
SELECT source, properties, fields, active, CASE WHEN properties / active >= 0.1 AND properties >= 20 THEN 'red' WHEN properties / active >= 0.01 THEN 'amber' ELSE 'green' END AS status FROM r JOIN a USING (source)""",
    "history_rows": """
SELECT l_suppkey AS source, count(*) FILTER (l_partkey % 3 <> 0) AS has_price, count(l_quantity) AS has_area, 0::BIGINT AS has_bedrooms,
  count(*) FILTER (o_orderkey % 3 = 0 OR o_orderkey % 7 IN (0, 1)) AS property_has_bedrooms, count(*) FILTER (o_orderkey % 4 = 1 OR o_orderkey % 5 = 0) AS has_photo, count(*) FILTER (o_orderkey % 6 <> 0) AS has_place, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 8 <> 0 GROUP BY 1""",
    "status_tally": """
WITH s AS (SELECT s_nationkey AS side, CASE WHEN s_acctbal > 5000 THEN 'green' WHEN s_acctbal > 1000 THEN 'amber' WHEN s_acctbal > 0 THEN 'unknown' ELSE 'red' END AS st FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT side, count(*) AS checks, count(*) FILTER (st = 'green') AS green, count(*) FILTER (st = 'amber') AS amber, count(*) FILTER (st = 'red') AS red, count(*) FILTER (st = 'unknown') AS unknown FROM s GROUP BY 1""",
    "duplicate_shares": """
WITH p AS (SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 46) AS hidden FROM part GROUP BY 1)
SELECT p_brand, n, hidden, CASE WHEN hidden / n - 0.04 >= 0.08 THEN 'red' WHEN hidden / n - 0.04 >= 0.03 THEN 'amber' ELSE 'green' END AS status FROM p""",
}
