"""Readers over landed pages and nested data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.sources import readers
from marlstone.sources.tables import table


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each page, entities decoded."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", readers.xml_text(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page, each once."""
    pages = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.explode(F.array_distinct(found)).alias("href"))


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page's first main heading, by the HTML reader."""
    elements = readers.html_elements(table(spark, sf_dir, "pages"), "page_id", "html").where("element = 'h1' OR element LIKE 'h1.%'")
    return elements.groupBy("page_id").agg(F.min_by("text", "at").alias("heading"))


def wrapped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON-LD pages and read back: nodes by type."""
    o = table(spark, sf_dir, "orders")
    body = F.format_string(
        '<html><script type="application/ld+json">{"@graph":[{"@type":"Product","sku":"%s","offers":{"price":%s}},{"@type":["Place","Thing"],"name":"%s"}]}</script>'
        '<script type="application/ld+json">{broken</script></html>',
        F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.col("o_orderpriority"),
    )
    nodes = readers.json_ld_nodes(o.select("o_orderkey", body.alias("body")))
    offers = readers.primary_nodes(nodes.where(readers.has_type(F.col("node"), "Product", "Offer")), "o_orderkey")
    price = F.try_variant_get("node", "$.offers.price", "double")
    return offers.select("o_orderkey", price.alias("price"))


def sitemap_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below an index of maps, one per host label."""
    pages = table(spark, sf_dir, "pages").select("url", T.site_key(F.col("url")).alias("site"))
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024-01-01</lastmod></url>"))
    leaves = pages.groupBy("site").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("body"))
    leaves = leaves.select(F.concat(F.lit("map:"), "site").alias("url"), "body")
    index = leaves.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("body"))
    maps = leaves.union(index.select(F.lit("map:root").alias("url"), "body"))
    return readers.walk_sitemaps(maps, F.col("url") == "map:root")


def embedding_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: vectors, their length, and the mean of the first component."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dims"), F.round(F.avg(F.element_at("embedding", 1).cast("double")), 6).alias("mean_first"))


QUERIES = {f.__name__: f for f in (page_title, page_links, page_headings, wrapped_nodes, sitemap_walk, embedding_profile)}
_DECODED = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
ORACLES = {
    "page_title": f"SELECT page_id, trim({_DECODED.format("regexp_extract(html, '<title>(.*?)</title>', 1, 'is')")}) AS title FROM pages",
    "page_headings": f"""
WITH h AS (SELECT page_id, regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is') AS h FROM pages WHERE regexp_matches(html, '<h1[^>]*>.*?</h1>', 'is'))
SELECT page_id, trim(regexp_replace({_DECODED.format("regexp_replace(h, '<[^>]+>', '', 'g')")}, '\\s+', ' ', 'g')) AS heading FROM h""",
    "page_links": """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""",
    "wrapped_nodes": "SELECT o_orderkey, o_totalprice AS price FROM orders",
    "sitemap_walk": "SELECT DISTINCT url AS loc, '2024-01-01' AS lastmod FROM pages",
    "embedding_profile": "SELECT label, count(*) AS n, max(len(embedding)) AS dims, round(avg(embedding[1]::DOUBLE), 6) AS mean_first FROM embeddings GROUP BY 1",
}
