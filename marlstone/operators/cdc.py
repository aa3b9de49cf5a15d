"""Passes over a source: planning by set difference, and changes as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.tables import written


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows with their number from 1 in a total order: sorted by ranges, numbered within each, and
    counted on from range to range, so no task holds them all."""
    ranged = written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    parted = ranged.withColumn("__part", F.shiftright("__at", 33))  # the range, then the place in it
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a task
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    return parted.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, place).drop("__at", "__part", "__before")


def diff(known: DataFrame, found: DataFrame, key: str, complete: bool = True, stale: DataFrame | None = None, shielded: DataFrame | None = None) -> DataFrame:
    """(key, plan) with plan ``added``, ``present``, ``refresh``, ``removed`` or ``suppressed``.

    What is known and not found is removed, unless the pass was incomplete or the key is shielded.
    """
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = flag(known, "k").join(flag(found, "f"), key, "full_outer")
    for df, name in ((stale, "stale"), (shielded, "shielded")):
        out = out.join(flag(df, name), key, "left") if df is not None else out.withColumn(name, F.lit(None).cast("boolean"))
    has = lambda c: F.col(c).isNotNull()
    plan = (
        F.when(has("f") & ~has("k"), "added")
        .when(has("f") & has("stale"), "refresh")
        .when(has("f"), "present")
        .when(F.lit(not complete) | has("shielded"), "suppressed")
        .otherwise("removed")
    )
    return out.select(key, plan.alias("plan"))


def should_abort(found: Column, baseline: Column, threshold: float = 0.5, least: int = 20) -> Column:
    """Too few were found against a baseline that is large enough to tell."""
    return (baseline >= least) & (found / baseline < threshold)


def needs_refresh(stated: Column, stored: Column, fetched: Column, ceiling: Column) -> Column:
    """Never fetched, fetched before the ceiling, a date missing, or stated later than stored."""
    return fetched.isNull() | (fetched < ceiling) | stated.isNull() | stored.isNull() | (stated > stored)


def plan_refresh(candidates: DataFrame, key: str, limit: int, ceiling: Column) -> DataFrame:
    """The refresh queue: rows in hand first and without a limit, then the ``limit`` oldest that need it.

    Columns: ``in_hand``, ``stated``, ``stored``, ``fetched``. Adds ``place``; other rows are left out.
    """
    due = F.col("in_hand") | needs_refresh(F.col("stated"), F.col("stored"), F.col("fetched"), ceiling)
    order = [F.col("fetched").asc_nulls_first(), F.col(key)]
    spare = candidates.where(due & ~F.col("in_hand")).orderBy(*order).limit(limit)
    queue = candidates.where("in_hand").withColumn("__rank", F.lit(0)).unionByName(spare.withColumn("__rank", F.lit(1)))
    return numbered(queue, "place", F.col("__rank").asc(), *order).drop("__rank")


def changed_in_hand(present: DataFrame, offered: DataFrame, stored: DataFrame, key: str, queued: DataFrame) -> DataFrame:
    """Present rows whose offered hash differs from the stored one (none stored: differs), not queued."""
    out = present.select(key).join(offered.select(key, F.col("hash").alias("offered")).where("offered IS NOT NULL"), key)
    out = out.join(stored.select(key, F.col("hash").alias("stored")), key, "left").join(queued.select(key), key, "left_anti")
    return out.where(~F.col("offered").eqNullSafe(F.col("stored"))).select(key)


def plan_fetch(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to fetch, (syndicated, n)): new syndicated rows (columns ``is_new``, ``syndicated``) are counted instead."""
    left_out = F.col("is_new") & F.col("syndicated").isNotNull()
    return rows.where(~left_out), rows.where(left_out).groupBy("syndicated").agg(F.count("*").alias("n"))


def unseen_to_verify(candidates: DataFrame, found: DataFrame, shielded: DataFrame, key: str, seen: str, before: Column, limit: int) -> DataFrame:
    """Shielded keys that this pass didn't find and that were last seen before a time, oldest first."""
    out = candidates.join(shielded.select(key), key, "left_semi").join(found.select(key), key, "left_anti")
    return out.where(F.col(seen) < before).orderBy(seen, key).limit(limit)


def trust_gone(checked: Column, gone: Column) -> Column:
    """Whether so many gone pages are believable."""
    return (checked < 20) | (gone / checked <= 0.9)


def event_array(prefix_before: str, prefix_after: str, exists_before: Column) -> Column:
    """The events between two states (structs ``price, area, rooms, availability, status``).

    A new row is ``listed`` and nothing else; leaving is ``delisted``, with the last price and
    availability, and nothing else; coming back is ``relisted``, at its price, and may change more. A value that is null on either side hasn't changed.
    """
    b, a = (lambda c: F.col(f"{prefix_before}.{c}")), (lambda c: F.col(f"{prefix_after}.{c}"))
    changed = lambda c: F.coalesce(b(c) != a(c), F.lit(False))
    none, unsaid = F.lit(None).cast("double"), F.lit(None).cast("string")

    def event(kind: str, old: Column = none, new: Column = none, delta: Column = none, percent: Column = none, was: Column = unsaid, now: Column = unsaid) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            old.cast("double").alias("price_from"),
            new.cast("double").alias("price_to"),
            delta.cast("double").alias("delta"),
            percent.cast("double").alias("percent"),
            was.cast("string").alias("availability_from"),
            now.cast("string").alias("availability_to"),
        )

    delta = a("price") - b("price")
    percent = F.when(b("price") != 0, F.round(delta / b("price") * 100, 2))
    back = (b("status") == "delisted") & (a("status") == "active")
    later = F.array_compact(
        F.array(
            F.when(back, event("relisted", new=a("price"))),
            F.when(changed("price"), event("price_changed", b("price"), a("price"), delta, percent)),
            F.when(changed("availability"), event("availability_changed", was=b("availability"), now=a("availability"))),
            F.when(changed("area") | changed("rooms"), event("updated")),
        )
    )
    gone = F.coalesce((b("status") == "active") & (a("status") == "delisted"), F.lit(False))
    return F.when(~exists_before, F.array(event("listed", none, a("price")))).when(gone, F.array(event("delisted", b("price"), was=b("availability")))).otherwise(later)


def compute_events(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row per change: key, type, price_from, price_to, delta, percent, availability_from,
    availability_to, direction."""
    fields = ["price", "area", "rooms", "availability", "status"]
    old = before.select(key, F.struct(*fields).alias("old"))
    new = after.select(key, F.struct(*fields).alias("new"))
    both = new.join(old, key, "left")
    rows = both.select(key, F.explode(event_array("old", "new", F.col("old").isNotNull())).alias("e")).select(key, "e.*")
    return rows.withColumn("direction", F.when(F.col("delta") < 0, "down").when(F.col("delta") > 0, "up"))


def merged(existing: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Existing rows with what was parsed; a null never overwrites."""
    news = [c for c in parsed.columns if c != key]
    right = parsed.select(key, *(F.col(c).alias(f"__{c}") for c in news))
    pick = lambda c: F.coalesce(f"__{c}", c).alias(c) if c in news else F.col(c)
    return existing.join(right, key, "left").select(*(pick(c) for c in existing.columns))


def delisted(listings: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(listings with the gone ones delisted, an event for each that wasn't yet)."""
    flagged = listings.join(gone.select(key).distinct().withColumn("__gone", F.lit(True)), key, "left")
    leaves = F.col("__gone").isNotNull() & (F.col("status") != "delisted")
    events = flagged.where(leaves).select(key, F.lit("delisted").alias("type"), F.col("availability").alias("last_availability"))
    status = F.when(leaves, F.lit("delisted")).otherwise(F.col("status"))
    return flagged.withColumn("status", status).select(listings.columns), events


def reposts(incoming: DataFrame, stored: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """(id, repost_of): a stored row of the same source, agency, title and price, and null-safely of
    the same area and place, that left at most ``days`` ago or is active; active ones and later
    leavers first."""
    n, s = incoming.alias("n"), stored.alias("s")
    same = [F.col(f"n.{c}") == F.col(f"s.{c}") for c in ("source", "agency", "title", "price")]
    same += [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("area", "place")]
    fresh = (F.col("s.status") == "active") | (F.col("s.delisted_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    out = n.join(s, [*same, fresh, F.col("n.id") != F.col("s.id")])
    rank = F.row_number().over(
        Window.partitionBy("n.id").orderBy((F.col("s.status") == "active").desc(), F.col("s.delisted_at").desc_nulls_last(), F.col("s.id"))
    )
    return out.withColumn("__rank", rank).where("__rank = 1").select(F.col("n.id").alias("id"), F.col("s.id").alias("repost_of"))


def run_status(saw_all: Column, fetched_all: Column) -> Column:
    """``done``, or ``partial`` if discovery saw all but fetching stopped; else ``aborted``."""
    return F.when(saw_all & fetched_all, "done").when(saw_all, "partial").otherwise("aborted")


def incomplete(read: Column, stated: Column, slack: Column | int = 0) -> Column:
    """Fewer rows were read than the source states, beyond the slack."""
    return F.coalesce(read + slack < stated, F.lit(False))


def unaddressable(wanted: DataFrame, configured: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted partitions without a configuration: incomplete, never empty."""
    return wanted.join(configured, keys, "left_anti")


def coverage_gaps(portals: DataFrame, places: DataFrame, configured: DataFrame) -> DataFrame:
    """Every (portal, place) that has no configuration; both lists are small configuration."""
    return places.crossJoin(F.broadcast(portals)).join(configured, ["portal", "place"], "left_anti")


def shielded(known: DataFrame, incomplete_places: DataFrame, place: str) -> DataFrame:
    """Known rows in places whose enumeration is incomplete."""
    return known.join(incomplete_places.select(place), place, "left_semi")


def retries(runs: DataFrame, sources: DataFrame, now: Column, hours: int = 20) -> DataFrame:
    """Sources whose latest run failed within ``hours`` after one that finished, and are enabled."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("started_at").desc(), F.col("run_id").desc()))
    two = runs.withColumn("rank", rank).where("rank <= 2").groupBy("source").agg(
        F.max(F.when(F.col("rank") == 1, F.col("status"))).alias("latest"),
        F.max(F.when(F.col("rank") == 1, F.col("started_at"))).alias("at"),
        F.max(F.when(F.col("rank") == 2, F.col("status"))).alias("previous"),
    )
    failed = F.col("latest").isin("error", "aborted") & (F.col("at") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return two.where(failed & F.col("previous").isin("done", "partial")).join(sources.where("enabled").select("source"), "source", "left_semi")


def stalest(places: DataFrame, runs: DataFrame, count: int) -> DataFrame:
    """Places by the last good run that covered them (an array column ``places``), never-run first."""
    good = runs.where("status = 'done' AND error IS NULL").select(F.explode("places").alias("place"), "finished_at")
    last = good.groupBy("place").agg(F.max("finished_at").alias("last_run"))
    return places.join(last, "place", "left").orderBy(F.col("last_run").asc_nulls_first(), "place").limit(count)


def moving_whole(listings: DataFrame, entity: str, place: str, new_place: str) -> DataFrame:
    """Entities whose live listings all get one new place (null counts as a value), unlike the old one."""
    one = listings.where("status = 'active'").groupBy(entity).agg(
        F.countDistinct(F.struct(F.coalesce(F.col(new_place), F.lit("\x00")))).alias("n"),
        F.max(new_place).alias(new_place),
        F.max(place).alias(place),
    )
    return one.where((F.col("n") == 1) & ~F.col(new_place).eqNullSafe(F.col(place))).select(entity, place, new_place)


def taken_over(stored: DataFrame, incoming: DataFrame, reposts_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored rows that go on under a new id, events): a repost (id, repost_of) takes its stored row over,
    with the history's ``first_seen``; two reposts of one row don't share it, the smaller id gets it."""
    one = reposts_.groupBy("repost_of").agg(F.min("id").alias("id"))
    old = stored.select(F.col("id").alias("repost_of"), "first_seen", F.col("status").alias("was"))
    rows = incoming.drop("first_seen").join(one, "id").join(old, "repost_of").withColumn("status", F.lit("active"))
    events = rows.where("was = 'delisted'").select("id", F.lit("relisted").alias("type"), F.col("price").alias("price_to"), "repost_of")
    return rows.drop("was"), events
