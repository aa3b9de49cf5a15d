"""Landed answers and pages of sources as listings, with a three-valued result and what is complete.

Two shapes cover the sources: a search answer in JSON, and a listing's page with structured data and
labelled cells. What differs from source to source are names, which are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.serving import parsed_result
from marlstone.sources import readers

#: What a listing may state; a source fills what it knows.
FIELDS = "title string, price double, area double, land double, rooms int, bedrooms int, kind string, place string, postcode string, agency string, ref string, phone string, description string, updated string"


def search_records(answers: DataFrame, items: str, total: str, schema: str) -> DataFrame:
    """(source, place, page, stated, at, r): one row per record of search answers (source, place, page,
    body): ``items`` and ``total`` name the list and the stated total in the answer. Answers that don't
    parse have no records."""
    whole = F.from_json("body", f"{total} long, {items} array<struct<{schema}>>")
    rows = answers.select("source", "place", "page", whole.alias("w"))
    return rows.select("source", "place", "page", F.col(f"w.{total}").alias("stated"), F.posexplode_outer(f"w.{items}").alias("at", "r"))


def search_listings(records: DataFrame, fields: dict[str, Column], key: Column, wanted: Column, volatile: list[str]) -> DataFrame:
    """Listings of search records: each key once (of its first page), records that aren't ``wanted`` (another
    place, not for sale) left out. ``hash`` leaves out the fields that change from read to read."""
    rows = records.where(F.col("r").isNotNull()).where(F.coalesce(wanted, F.lit(False)))
    rows = rows.select("source", "place", "page", "at", key.cast("string").alias("key"), readers.stable_hash(F.col("r"), volatile).alias("hash"), _struct(fields).alias("f"))
    first = Window.partitionBy("source", "key").orderBy("page", "at")
    rows = rows.withColumn("__rank", F.row_number().over(first)).where("__rank = 1")
    return rows.select("source", F.col("place").alias("searched"), "key", "hash", "f", parsed_result(F.col("f")).alias("result"))


def search_completeness(records: DataFrame, slack: Column | int = 0) -> DataFrame:
    """(source, place, read, stated, complete): whether as many records came as the source states, less the
    slack; pages that state nothing are complete."""
    per = records.groupBy("source", "place").agg(F.count("r").alias("read"), F.max("stated").alias("stated"))
    return per.withColumn("complete", F.coalesce(F.col("read") + slack >= F.col("stated"), F.lit(True)))


def last_page_needed(stated: Column, per_page: int) -> Column:
    """How many pages a search has: one at least."""
    return F.greatest(F.lit(1), F.ceil(stated / per_page)).cast("int")


def page_listings(pages: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Listings of pages (key, url, body) by their structured data, and where it says nothing by labelled
    cells. ``labels``: field (area, land, rooms, bedrooms, agency, ref) -> the label's text. A page without
    a title failed."""
    nodes = readers.json_ld_nodes(pages.select("key", "body"))
    offer = readers.primary_nodes(nodes, "key")
    get = lambda path, kind: F.try_variant_get("node", path, kind)
    stated = offer.select(
        "key", get("$.name", "string").alias("name"), F.coalesce(get("$.offers.price", "double"), T.number(get("$.offers.price", "string"))).alias("price"),
        get("$.offers.priceCurrency", "string").alias("currency"), get("$.description", "string").alias("description"),
    )
    elements = readers.html_elements(pages.select("key", "body"), "key")
    out = pages.select("key", "url", readers.xml_text(F.regexp_extract("body", r"(?is)<title>(.*?)</title>", 1)).alias("heading")).join(stated, "key", "left")
    for field, label in labels.items():
        out = out.join(readers.labelled(elements, "key", label).withColumnRenamed("value", f"c_{field}"), "key", "left")
    cell = lambda f: F.col(f"c_{f}") if f in labels else F.lit(None).cast("string")
    title = F.coalesce("name", F.nullif("heading", F.lit("")))
    fields = {
        "title": title, "price": F.when(F.coalesce(F.upper("currency"), F.lit("EUR")) == "EUR", F.col("price")), "area": T.surface(cell("area")), "land": T.surface(cell("land")),
        "rooms": T.first_count(cell("rooms")), "bedrooms": T.first_count(cell("bedrooms")), "kind": T.canonical_kind(F.lit(None).cast("string"), title), "agency": cell("agency"), "ref": cell("ref"),
        "description": F.col("description"),
    }
    return out.select("key", "url", _struct(fields).alias("f")).withColumn("result", parsed_result(F.col("f")))


def _struct(fields: dict[str, Column]) -> Column:
    """The fields of a listing in their order; those a source doesn't know are null."""
    parts = [x.split() for x in FIELDS.split(", ")]
    return F.struct(*(fields.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in parts))
