"""Who may see what: scope predicates, served entities, paging, impossible values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(column: Column, allowed: Sequence) -> Column:
    """Membership; an empty list admits nothing, and null is never a member."""
    return F.coalesce(column.isin(*allowed), F.lit(False)) if allowed else F.lit(False)


def narrowed(allowed: Sequence, requested: Sequence | None) -> list:
    """What was asked for and is allowed; all that is allowed if nothing was asked for."""
    return list(allowed) if requested is None else [x for x in allowed if x in set(requested)]


def served(entities: DataFrame, listings: DataFrame, sources: DataFrame, key: str, source: str, subscribed: Sequence | None = None) -> DataFrame:
    """Entities with an active listing of an enabled (and, if given, subscribed) source: a semi join."""
    open_ = sources.where("enabled")
    if subscribed is not None:
        open_ = open_.where(within(F.col(source), subscribed))
    live = listings.where("status = 'active'").join(open_.select(source), source, "left_semi")
    return entities.join(live.select(key), key, "left_semi")


def without_own_duplicates(listings: DataFrame, key: str, agency: str, own: Sequence) -> DataFrame:
    """Rows of own agencies, and rows of entities on which no active own row stands; a null agency
    is not an own one. One window over the entity, no self join."""
    mine = within(F.col(agency), own)
    here = F.max(mine & F.col("status").eqNullSafe("active")).over(Window.partitionBy(key))
    return listings.withColumn("__own", here).where(mine | ~F.col("__own")).drop("__own")


def free_text(pattern: str, *columns: Column) -> Column:
    """Case-blind search for a text in any of the columns; its ``% _ \\`` are plain characters."""
    like = "%" + pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(c.ilike(like), F.lit(False))
    return found


def on_request(entities: DataFrame, listings: DataFrame, key: str, raw: str, path: str, value) -> DataFrame:
    """Entities with a listing whose JSON says so: the field at ``path`` of column ``raw`` has the value. A
    semi join on a field of a variant; JSON that doesn't parse says nothing."""
    kind = {bool: "boolean", int: "long", float: "double"}.get(type(value), "string")
    hit = listings.where(F.try_variant_get(F.try_parse_json(raw), path, kind) == F.lit(value))
    return entities.join(hit.select(key), key, "left_semi")


def keyset_page(df: DataFrame, time: str, key: str, limit: int, after: tuple | None = None) -> DataFrame:
    """The next ``limit`` + 1 rows by (time, key) past a cursor; one more than a page tells that more follow."""
    if after is not None:
        at = F.lit(after[0]).cast(df.schema[time].dataType)
        df = df.where((F.col(time) > at) | ((F.col(time) == at) & (F.col(key) > after[1])))
    return df.orderBy(time, key).limit(limit + 1)


def encode_cursor(time: Column, key: Column) -> Column:
    """A page's end as URL-safe base64 of ``time|key``, to the millisecond, in UTC."""
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    raw = F.base64(F.encode(F.concat_ws("|", stamp, key.cast("string")), "UTF-8"))
    return F.regexp_replace(F.translate(raw, "+/", "-_"), r"[=\s]", "")


def decode_cursor(cursor: Column) -> Column:
    """(time, key) of a cursor; null if it is malformed."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    time = F.substring_index(text, "|", 1).try_cast("timestamp")
    key = F.substr(text, F.instr(text, "|") + 1)
    return F.when(text.contains("|") & time.isNotNull() & (key != ""), F.struct(time.alias("time"), key.alias("key")))


#: Bounds, and what is wrong beyond them (fixed values).
MAX_PRICE, MAX_ROOMS, MIN_AREA, MAX_DWELLING = 250_000_000, 1000, 5, 2000
LAND_KIND = r"(?i)terrain|land|plot"
PRICE, UNIT, HOME = "price", "area, unit error", "area, too large for a home"


def impossible(price: Column, area: Column, kind: Column) -> Column:
    """What can't be true of a listing; null if nothing."""
    dwelling = kind.isNotNull() & ~kind.rlike(LAND_KIND)
    return (
        F.when(price > MAX_PRICE, PRICE)
        .when(area < MIN_AREA, UNIT)
        .when((area > MAX_DWELLING) & dwelling, HOME)
    )


def scrubbed(df: DataFrame, price: str, area: str, kind: str, per_m2: str | None = None) -> DataFrame:
    """Impossible figures become null; rows stay."""
    dwelling = F.col(kind).isNotNull() & ~F.col(kind).rlike(LAND_KIND)
    bad_price = F.coalesce(F.col(price) > MAX_PRICE, F.lit(False))
    bad_area = F.coalesce((F.col(area) < MIN_AREA) | ((F.col(area) > MAX_DWELLING) & dwelling), F.lit(False))
    out = {price: F.when(~bad_price, F.col(price)), area: F.when(~bad_area, F.col(area))}
    if per_m2:
        out[per_m2] = F.when(~bad_price, F.col(per_m2))
    return df.withColumns(out)


def land_out_of_area(kind: Column, area: Column, land: Column) -> Column:
    """The floor area, unless it repeats a plot's."""
    return F.when(F.coalesce(kind.rlike(LAND_KIND) & (area == land), F.lit(False)), F.lit(None)).otherwise(area)


def sane(value: Column, most: float) -> Column:
    """A finite figure from 0 to ``most``; else null."""
    return F.when(~F.isnan(value.cast("double")) & value.between(0, most), value)


def scope_decision(known: Column, user_active: Column, client: Column, client_active: Column) -> Column:
    """Why a reader is refused, the first reason that holds; null if none does. Nobody without a client reads."""
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unknown user")
        .when(~F.coalesce(user_active, F.lit(False)), "inactive user")
        .when(F.nullif(client, F.lit("")).isNull(), "no client")
        .when(~F.coalesce(client_active, F.lit(False)), "inactive client")
    )
