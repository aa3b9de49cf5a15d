"""What a market's readers are served: pages, details, snapshots, counts, run outcomes, reports."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.latest import latest_per
from marlstone.operators.portals import served_copies
from marlstone.operators.scope import served, within, without_own_duplicates
from marlstone.operators.tables import written

# Tables: properties (id, status, place, first_listed, ...), listings (id: the property's, source, status,
# first_seen, ...), sources (source, name, enabled). The present is always an argument.


def shown_listings(listings: DataFrame, sources: DataFrame, subscribed: Sequence) -> DataFrame:
    """Active listings of enabled sources that the reader subscribes to."""
    open_ = sources.where("enabled").where(within(F.col("source"), subscribed))
    return listings.where("status = 'active'").join(open_.select("source"), "source", "left_semi")


def live(properties: DataFrame, listings: DataFrame, sources: DataFrame, places: Sequence, subscribed: Sequence) -> DataFrame:
    """Active properties of the places that have such a listing."""
    return served(properties.where("status = 'active'").where(within(F.col("place"), places)), listings, sources, "id", "source", subscribed)


def property_page(found: DataFrame, shown: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of properties, newest first, each with ``total`` (all found) and ``total_listings`` (the
    listings they were folded from), both over all pages."""
    folded = shown.join(found.select("id"), "id", "left_semi").agg(F.count("*").alias("total_listings"))
    totals = found.agg(F.count("*").alias("total")).crossJoin(folded)  # one row each
    rows = found.orderBy(F.col("first_listed").desc(), F.col("id").desc()).offset(offset).limit(min(limit, 200))
    return rows.crossJoin(F.broadcast(totals))


def chips(listings: DataFrame) -> DataFrame:
    """(id, chips): per property an array of (via, source): one for each direct listing, then one for each
    portal that only an aggregator's row carries. Listings: row, id, source, via, last_seen."""
    rows = served_copies(listings.withColumnRenamed("id", "__entity").withColumnRenamed("row", "id"), "__entity")
    return rows.groupBy(F.col("__entity").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("via", F.lit("")).alias("via"), "source"))).alias("chips"))


def details(properties: DataFrame, listings: DataFrame, events: DataFrame, active: DataFrame, most: int = 100) -> DataFrame:
    """Properties with their ``listings`` (by source), the last ``most`` events of these as ``history``, and
    how many active properties their agency has. Events (id: the property's, at, event, type) reach a
    property through its listings. Properties without a listing have no details."""
    held = listings.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("source", "status", "price"))).alias("listings"))
    newest = Window.partitionBy("id").orderBy(F.col("at").desc(), F.col("event").desc())
    last = events.withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= most)
    history = last.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("__rank").alias("rank"), "at", "event", "type"))).alias("history"))
    agency = active.groupBy("agency").agg(F.count("*").alias("agency_active"))
    out = properties.join(held, "id").join(history, "id", "left").join(agency, "agency", "left")
    return out.withColumn("agency_active", F.when(F.col("agency").isNotNull(), F.coalesce("agency_active", F.lit(0))))


def overview(properties: DataFrame, shown: DataFrame, buyers: DataFrame, matches: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row: live properties, those of the last days (null until the first is older than that), real and
    test buyers, and open matches of real buyers on live properties."""
    start = now - F.expr(f"INTERVAL {int(days)} DAYS")
    watched = properties.agg((F.min("first_listed") < start).alias("long_enough"))
    counts = shown.agg(F.count("*").alias("active"), F.count_if(F.col("first_listed") > start).alias("fresh"))
    people = buyers.agg(F.count_if(~F.col("is_test")).alias("buyers_real"), F.count_if("is_test").alias("buyers_test"))
    open_ = matches.where(F.col("status").isin("new", "seen")).join(shown.select(F.col("id").alias("property")), "property", "left_semi")
    open_ = open_.join(buyers.where(~F.col("is_test")).select("buyer"), "buyer", "left_semi").agg(F.count("*").alias("matches_open"))
    out = watched.crossJoin(counts).crossJoin(people).crossJoin(open_)  # one row each
    return out.select("active", F.when(F.col("long_enough"), F.col("fresh")).alias("new_in_window"), "buyers_real", "buyers_test", "matches_open")


def source_stats(sources: DataFrame, listings: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Per source: its listings by state and age, whether its stock is being filled up (over half of it came
    in the last day), and its last run (columns ``last_``)."""
    ago = lambda d: now - F.expr(f"INTERVAL {d} DAYS")
    on = F.col("status") == "active"
    per = listings.groupBy("source").agg(
        F.count_if(on).alias("active"), F.count("*").alias("ever"), F.count_if(~on).alias("delisted"), F.countDistinct(F.when(on, F.col("place"))).alias("places"),
        F.count_if(on & (F.col("first_seen") > ago(1))).alias("new_1d"), F.count_if(on & (F.col("first_seen") > ago(7))).alias("new_7d"),
        F.count_if(on & (F.col("updated") < ago(7))).alias("stale"), F.min("first_seen").alias("first_seen"), F.max("first_seen").alias("last_seen"),
    )
    last = latest_per(runs, ["source"], F.col("started_at").desc(), F.col("run").desc())
    last = last.select("source", F.col("status").alias("last_status"), F.col("started_at").alias("last_started"), F.col("seen").alias("last_seen_count"))
    out = sources.join(per, "source", "left").join(last, "source", "left").na.fill(0, ["active", "ever", "delisted", "places", "new_1d", "new_7d", "stale"])
    return out.withColumn("filling", F.col("new_1d") > F.col("active") * 0.5)


def snapshot(found: DataFrame, listings: DataFrame, changes: DataFrame, own: Sequence, limit: int, after=None) -> DataFrame:
    """A page of live properties by id past a cursor, and one more if more follow, each with the listings it
    is served with (copies of own listings are hidden; of what aggregators carry only what isn't held
    directly, the last seen) and its last price change (at, event, price_from, price_to)."""
    page = (found if after is None else found.where(F.col("id") > after)).orderBy("id").limit(limit + 1)
    here = listings.where("status = 'active'").join(page.select("id"), "id", "left_semi")
    left = without_own_duplicates(here, "id", "agency", own).drop("agency", "status")
    out = page.join(chips(left), "id", "left")
    last = latest_per(changes.join(page.select("id"), "id", "left_semi"), ["id"], F.col("at").desc(), F.col("event").desc())
    return out.join(last.select("id", F.struct("at", "price_from", "price_to").alias("last_change")), "id", "left")


def outcomes(sources: DataFrame, runs: DataFrame, carried: DataFrame, aggregators: Sequence) -> DataFrame:
    """(key, last_run, outcome, via): what the last completed run of each enabled source came to (an error
    beats a state, but a partial pass is one; never without a run). An aggregator stands for the
    portals it carries (source, key) that aren't read directly; of two aggregators the later run's."""
    last = latest_per(runs.where("completed_at IS NOT NULL"), ["source"], F.col("completed_at").desc(), F.col("run").desc())
    state = F.when(F.col("status") == "partial", "partial").when(F.col("error").isNotNull(), "error").otherwise(F.col("status"))
    per = sources.where("enabled").join(last.select("source", F.col("completed_at").alias("last_run"), state.alias("outcome")), "source", "left")
    per = per.withColumn("outcome", F.coalesce("outcome", F.lit("never")))
    direct = per.where(~within(F.col("source"), aggregators)).select(F.col("source").alias("key"), "last_run", "outcome", F.lit(None).cast("string").alias("via"))
    through = per.where(within(F.col("source"), aggregators)).join(carried.select("source", "key").distinct(), "source").join(direct.select("key"), "key", "left_anti")
    through = latest_per(through, ["key"], F.col("last_run").desc_nulls_last(), F.col("source"))
    return direct.unionByName(through.select("key", "last_run", "outcome", F.col("source").cast("string").alias("via")))


def last_good_run(runs: DataFrame) -> DataFrame:
    """One row: when a run last ended well, or saw all it wanted to."""
    return runs.where("status = 'partial' OR (status = 'done' AND error IS NULL)").agg(F.max("completed_at").alias("last_good"))


def stored_reports(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored reports with new ones put in by key."""
    from marlstone.operators.latest import upserted

    return upserted(old, new, keys)


def filling(active: Column, fresh: Column) -> Column:
    """A stock of which over half came in the last day is being filled up, not watched."""
    return (active > 0) & (fresh > active * 0.5)


def gallery_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows, those with more than one image, and the most images, of an array column ``images``."""
    n = F.coalesce(F.size("images"), F.lit(0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(n > 1).alias("with_gallery"), F.max(n).alias("most"))


def sampled(rows: DataFrame, by: str, value: str, order: str, most: int = 5) -> DataFrame:
    """Per group: rows, those with a value, and the first ``most`` of the values by ``order``, joined. No
    group's values are gathered but these."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"), F.count(value).alias("with_value"))
    first = Window.partitionBy(by).orderBy(order)
    few = rows.where(F.col(value).isNotNull()).withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= most)
    few = few.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", F.col(value).cast("string").alias("v")))), lambda s: s["v"]), ",").alias("samples"))
    return counts.join(few, by, "left")


def subscribed_places(clients: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Distinct (source, place) of active clients (client, active, places) with enabled subscriptions
    (client, source, enabled)."""
    who = clients.where("active").select("client", F.explode("places").alias("place"))
    return subscriptions.where("enabled").join(who, "client").select("source", "place").distinct()


# ---- hidden duplicates ----------------------------------------------------------------------

#: Words of kinds, and bounds of the rule (fixed values).
_KIND_WORDS = (
    ("kind", "flat", r"(?i)(appart|studio|duplex|loft|flat)"), ("kind", "house", r"(?i)(maison|villa|house|bastide|propri)"), ("kind", "land", r"(?i)(terrain|land)"),
    ("title", "house", r"(?i)(maison|villa|house|bastide|\bmas\b)"), ("title", "flat", r"(?i)(appart|studio|duplex|loft)"), ("title", "land", r"(?i)(terrain|\bland\b)"),
)
PRICE_GAP, AREA_GAP, WIDE_AREA_GAP, WIDE_FROM, LEAST_AREA, MOST_PER_M2 = 0.01, 0.03, 0.2, 1_000_000, 25, 100_000


def hidden_duplicates(properties: DataFrame) -> DataFrame:
    """Distinct ids that are perhaps a higher-ranked property of the same place again.

    Rank within a place: more sources, listed earlier, smaller id. Two are alike if their prices lie
    within 1 %, no known kind or bedroom count speaks against it, and their areas agree, or both can't
    be told from a wrong one; or if they show the same image. Prices meet by bands of 1 %, images by
    themselves: equi-joins in both cases. Rows that the rule can't tell apart are one class, which meets
    others once; a row goes if the first in rank of a class alike to its own is before it. Columns: id, place, price, area, bedrooms, source_count,
    first_listed, image, kind, title.
    """
    bad = F.coalesce((F.col("area") < LEAST_AREA) | (F.col("price") / F.nullif("area", F.lit(0.0)) > MOST_PER_M2), F.lit(False))
    named = F.coalesce(*(F.when(F.coalesce(c, F.lit("")).rlike(p), F.lit(k)) for c, k, p in _KIND_WORDS))
    order = Window.partitionBy("place").orderBy(F.col("source_count").desc(), F.col("first_listed").asc_nulls_last(), "id")
    rows = properties.where("place IS NOT NULL").select(
        "id", "place", "price", "bedrooms", "image", named.alias("named"), (F.col("area").isNotNull() & bad).alias("bad"), F.when(~bad, F.col("area")).alias("ok"),
        F.row_number().over(order).alias("rank"), F.floor(F.ln(F.when(F.col("price") > 0, F.col("price"))) / -math.log(1 - PRICE_GAP)).cast("long").alias("band"),
    )
    rows = written(rows)
    told = ["place", "price", "bedrooms", "named", "bad", "ok"]
    classes = rows.groupBy(*told, "band").agg(F.min("rank").alias("lead"), F.max("rank").alias("last"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()))
    y = classes.alias("y")
    c = lambda s, k: F.col(f"{s}.{k}")
    ahead = [c("x", "place") == c("y", "place"), c("x", "lead") < c("y", "last")]
    within_ = lambda k, gap: F.abs(c("x", k) - c("y", k)) <= gap * F.greatest(c("x", k), c("y", k))
    unknown = lambda k: c("x", k).isNull() | c("y", k).isNull()
    beds = lambda most: unknown("bedrooms") | (F.abs(c("x", "bedrooms") - c("y", "bedrooms")) <= most)
    sized = within_("ok", F.when(c("x", "price") >= WIDE_FROM, WIDE_AREA_GAP).otherwise(AREA_GAP))
    stated = lambda s: c(s, "ok").isNotNull() | c(s, "bad")
    unsure = (c("x", "bad") | c("y", "bad")) & stated("x") & stated("y") & (c("x", "named") == c("y", "named")) & beds(0)
    alike = within_("price", PRICE_GAP) & (unknown("named") | (c("x", "named") == c("y", "named"))) & beds(1) & (F.coalesce(sized, F.lit(False)) | F.coalesce(unsure, F.lit(False)))
    near = classes.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("x")
    met = near.join(y, [*ahead, c("x", "band") == c("y", "band"), alike]).groupBy(c("y", "class").alias("class")).agg(F.min(c("x", "lead")).alias("ahead"))
    found = classes.join(met, "class").alias("f")
    same = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in told))
    by_price = rows.alias("r").join(found, same & (F.col("r.rank") > F.col("f.ahead"))).select("r.id")
    # of one image the first in rank is left; the others each have it before them
    first = rows.where("image IS NOT NULL").groupBy("place", "image").agg(F.min("rank").alias("first"))
    by_image = rows.join(first, ["place", "image"]).where("rank > first").select("id")
    return by_price.union(by_image).distinct()


# ---- agencies, candidates, prices -----------------------------------------------------------


def resolved_agencies(stored: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agencies after a pass, (row, agency) of the rows): an agency is one name without legal form in one
    postcode, null being a postcode. What a stored one lacks is filled in from the first row that has
    it; a new one gets the name of its first row. Columns: agency, name, postcode, address, city,
    phone; of ``seen`` row instead of agency."""
    from marlstone.functions.text import agency_form

    key = [agency_form(F.col("name")).alias("norm"), F.nullif(F.trim("postcode"), F.lit("")).alias("postcode")]
    facts = ["address", "city", "phone"]
    rows = seen.select("row", F.trim("name").alias("name"), *facts, *key).where("norm <> ''")
    first = [F.min_by(f, F.when(F.nullif(f, F.lit("")).isNotNull(), F.col("row"))).alias(f"new_{f}") for f in facts]
    per = rows.groupBy("norm", "postcode").agg(F.min_by("name", "row").alias("new_name"), *first)
    old = stored.select("agency", "name", *facts, *key)
    on = (F.col("o.norm") == F.col("n.norm")) & F.col("o.postcode").eqNullSafe(F.col("n.postcode"))
    both = old.alias("o").join(per.alias("n"), on, "full_outer")
    norm, code = F.coalesce("o.norm", "n.norm"), F.coalesce("o.postcode", "n.postcode")
    name = F.sha2(F.concat_ws("|", norm, F.coalesce(code, F.lit("-"))), 256)
    out = both.select(
        F.coalesce(F.col("o.agency").cast("string"), name).alias("agency"), F.coalesce("o.name", "n.new_name").alias("name"), code.alias("postcode"),
        *(F.coalesce(F.nullif(f"o.{f}", F.lit("")), F.col(f"n.new_{f}")).alias(f) for f in facts), norm.alias("norm"),
    )
    r, a = rows.alias("r"), out.alias("a")
    which = r.join(a, (F.col("r.norm") == F.col("a.norm")) & F.col("r.postcode").eqNullSafe(F.col("a.postcode"))).select("r.row", "a.agency")
    return out.drop("norm"), which


#: Titles that say nothing, and kinds that have no bedrooms or no floor area (fixed values).
GENERIC_TITLE = r"(?i)^\s*(achat|vente)\s*:"
WITHOUT_AREA = ("Terrain", "Parking")
WITHOUT_BEDROOMS = (*WITHOUT_AREA, "Commerce", "Bureau", "Immeuble")


def fill_candidates(listings: DataFrame, least: int = 80) -> DataFrame:
    """Active, placed listings with a description to read, not read before, of which a figure that their
    kind has, the kind or a telling title is missing."""
    kind = F.coalesce("kind", F.lit(""))
    wanted = (
        (F.col("bedrooms").isNull() & ~kind.isin(*WITHOUT_BEDROOMS))
        | (F.col("area").isNull() & ~kind.isin(*WITHOUT_AREA))
        | F.col("kind").isNull()
        | F.coalesce(F.col("title").rlike(GENERIC_TITLE), F.lit(False))
    )
    readable = (F.col("status") == "active") & F.col("place").isNotNull() & (F.length(F.coalesce("description", F.lit(""))) >= least)
    return listings.where(readable & ~F.coalesce(F.col("was_read"), F.lit(False)) & wanted)


def euro_price(offer_currency: Column, offer_price: Column, own_image: Column, shown_currency: Column, shown_price: Column, line: Column) -> Column:
    """(price, origin): a page's price in euros: of its own offer, else the shown one if in euros, else of
    the line that quotes euros; nothing is converted."""
    from marlstone.functions.text import number

    offer = F.when((F.upper(offer_currency) == "EUR") & own_image & (offer_price > 0), F.struct(F.round(offer_price).alias("price"), F.lit("offer").alias("origin")))
    shown = F.struct(shown_price.cast("double").alias("price"), F.lit("shown").alias("origin"))
    quoted = number(F.regexp_replace(line, "€", ""))
    by_line = F.when(line.contains("€") & (quoted > 0), F.struct(quoted.alias("price"), F.lit("line").alias("origin")))
    return F.coalesce(offer, F.when(shown_currency == "EUR", F.when(shown_price.isNotNull(), shown)).otherwise(by_line))


def missed_changes(stored: DataFrame, pages: DataFrame, events: DataFrame) -> DataFrame:
    """(key, price_from, price_to, delta, percent, occurred_at): changes that old pages show and no event
    tells: the page's price (key, price, fetched_at) differs from the stored one, at the time of the
    page, once for each pair of prices."""
    both = pages.where("price IS NOT NULL").join(stored.where("price IS NOT NULL").select("key", F.col("price").alias("was")), "key").where("price <> was")
    new = both.groupBy("key", F.col("was").alias("price_from"), F.col("price").alias("price_to")).agg(F.min("fetched_at").alias("occurred_at"))
    new = new.join(events.select("key", "price_from", "price_to"), ["key", "price_from", "price_to"], "left_anti")
    delta = F.col("price_to") - F.col("price_from")
    return new.withColumns({"delta": delta, "percent": F.round(delta / F.col("price_from") * 100, 2)})


def replayed(pages: DataFrame, stored: DataFrame, parse, key: str) -> DataFrame:
    """Stored rows as their last page says, parsed anew: ``parse`` gives a table (key, fields) of pages
    (key, fetched_at, body). Only rows that change come out; a null never overwrites."""
    from marlstone.operators.cdc import merged
    from marlstone.operators.latest import changed_rows

    last = latest_per(pages, [key], F.col("fetched_at").desc(), F.sha2("body", 256))
    return changed_rows(stored, merged(stored, parse(last), key), [key])


#: Fields without which a parsed listing is only part of one (fixed values).
EXPECTED = ("price", "area", "agency")


def parsed_result(fields: Column, required: Sequence[str] = ("title",), expected: Sequence[str] = EXPECTED) -> Column:
    """(status, missing) of a struct of parsed fields: ``failed`` without a required one, ``partial`` if
    expected ones are missing, else ``ok``."""
    lost = F.array_compact(F.array(*(F.when(fields[f].isNull(), F.lit(f)) for f in expected)))
    failed = F.lit(False)
    for f in required:
        failed = failed | fields[f].isNull()
    status = F.when(failed, "failed").when(F.size(lost) > 0, "partial").otherwise("ok")
    return F.struct(status.alias("status"), lost.alias("missing"))
