"""Text columns: normal forms, shingles, kinds, figures in prose, site keys. Built-in expressions
throughout; only the repair of garbled text and the hashes of word runs need Python."""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# ---- fixed values ---------------------------------------------------------------------------

#: Phrases that adverts share and that say nothing about the entity, replaced by a space in turn.
#: Each with a word that every match has, as most texts have none of these.
BOILERPLATE = (
    ("risques", r"les informations sur les risques auxquels ce bien est exposé[^.]*\."),
    ("georisques", r"(?:www\.)?georisques\.gouv\.fr"),
    ("soumise", r"bien situé dans une zone soumise à l'obligation[^.]*\."),
    ("soumise", r"propriété située dans une zone soumise à l'obligation[^.]*\."),
    ("honoraire", r"honoraires? (?:à la )?charge (?:du )?(?:vendeur|acquéreur)[^.]*\."),
    ("lot", r"copropriété de \d+ lots?[^.]*\."),
    ("rsac", r"(?:no|n°)\s*rsac[^.\n]*"),
    ("immobilier", r"r[ée]seau immobilier [a-z]+\s*-\s*votre agent commercial[^.]*\."),
    ("entrepreneur", r"entrepreneur individuel[^.]*\."),
    ("propos", r"ce bien vous est propos[ée] par[^.]*\."),
    ("propos", r"cette annonce vous est propos[ée]e par[^.]*\."),
    ("contactez", r"contactez[- ]nous[^.]*\."),
    ("information", r"pour (?:toute )?informations? compl[ée]mentaires?[^.]*\."),
)
#: Canonical kinds and the words that name them.
KINDS = (
    ("Appartement", r"\b(appart\w*|apartment|flat|studio|duplex|triplex|loft|penthouse|[tf][1-7])\b"),
    ("Maison", r"\b(maisons?|house|villas?|demeure|propriete|bastide|mas|chateau|chalet|ferme|longere|hotelparticulier)\b"),
    ("Terrain", r"\b(terrains?|land\w*|plot|parcelle)\b"),
    ("Commerce", r"\b(commerces?|commercial|locaux|local|fonds|boutique|shop|restaurant|restauration|hotel|bar|droit au bail)\b"),
    ("Bureau", r"\b(bureaux?|office)\b"),
    ("Parking", r"\b(parking|garage|box|stationnement)\b"),
    ("Immeuble", r"\b(immeuble|building)\b"),
)
#: Wishes and the words that fulfil them.
FEATURES = {
    "pool": ("piscine", "pool"),
    "sea_view": ("vue mer", "vue sur mer", "sea view", "vue panoramique mer"),
    "garden": ("jardin", "garden"),
    "garage": ("garage", "parking"),
    "walking_distance_beach": ("plage à pied", "plage a pied", "walk to the beach", "beachfront"),
    "renovated": ("rénové", "renove", "renovated", "refait à neuf"),
    "air_conditioning": ("climatisation", "climatisé", "air conditioning"),
    "guest_house": ("maison d'amis", "dépendance", "guest house", "pool house"),
}
ABROAD = r"(?iu)(?:^|[^\p{L}\p{N}])(phuket|tha[iï]lande?|thailand|bangkok|pattaya|krabi|koh? samui|thb|bahts?)(?![\p{L}\p{N}])"
LEGAL_FORMS = r"\b(sarl|sas|sasu|eurl|sci|snc|s\.?a\.?r\.?l|ei|eirl)\b"
#: What the bytes 0x80 to 0x9F are read as in Windows-1252.
_C1 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
MOJIBAKE = f"Ã[\u0080-¿{_C1}]|â€|Å[’“”Ž]|Â[\u00a0-¿]"
_FIGURE = r"(\d{1,2}[ \u00a0.]\d{3}|\d{1,4}(?:[.,]\d{1,2})?)"
_SQM = r"\s*m(?:²|2|\s?carres?)(?![a-z0-9])"
LIVING = (
    _FIGURE + _SQM + r"\s*(?:environ\s+)?(?:habitables?|de surface habitable|de surface de plancher habitable)",
    r"surface\s+habitable\s*(?:de|:|d'environ|d’environ|environ|d'env\.?)?\s*(?:environ\s+)?" + _FIGURE + _SQM,
)
SQ_FT, ACRE, HECTARE = 0.09290304, 4046.8564224, 10000.0

# ---- normal forms ---------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]



def _accented() -> tuple[str, str]:
    """Latin letters with marks, and their bare letters, by decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accented()


def without_accents(text: Column) -> Column:
    """Latin letters without their marks; combining marks go."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), "[̀-ͯ]", "")


def without_boilerplate(text: Column) -> Column:
    """Shared phrases replaced by spaces, in any case."""

    def step(low: Column, word: str, phrase: str) -> Callable[[Column], Column]:
        return lambda t: F.when(low.contains(word), F.regexp_replace(t, f"(?iu){phrase}", " ")).otherwise(t)

    def cut(both: Column) -> Column:
        out = both["text"]
        for word, phrase in BOILERPLATE:  # bound at each step, as an expression used twice would double
            out = let(out, step(both["low"], word, phrase))
        return out

    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), cut)


def normal_form(text: Column) -> Column:
    """Words of plain lower-case letters, joined by single spaces."""
    text = F.regexp_replace(without_boilerplate(text), "<[^>]+>", " ")
    text = F.lower(without_accents(text))
    return F.trim(F.regexp_replace(text, r"[^a-z]+", " "))


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct word runs of a normal form; shorter texts are one run, empty ones none."""
    none = F.array().cast("array<string>")

    def runs(words: Column) -> Column:
        n = F.size(words)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))
        return F.when(n <= 0, none).when(n < size, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(every))

    return F.when(text.isNull(), none).otherwise(let(F.filter(F.split(text, " "), lambda w: w != ""), runs))


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """The shingles of a normal form as distinct 64-bit hashes, which are made and compared faster."""
    none = F.array().cast("array<bigint>")

    def runs(words: Column) -> Column:
        n = F.size(words)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size)))
        return F.when(n <= 0, none).otherwise(F.array_distinct(every))

    return F.when(text.isNull(), none).otherwise(let(F.filter(F.split(text, " "), lambda w: w != ""), runs))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, each bit of which depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text that are hashed at a time.
_HASHED_BYTES = 1 << 22
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93


def _runs_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many each) of the distinct runs of texts, which lie in ``data`` between ``offsets``."""
    count = len(offsets) - 1
    word = np.concatenate([data != 32, [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(word[:-1] & (edge[:-1] | ~np.concatenate([[False], word[:-2]])))
    last = np.flatnonzero(word[:-1] & (edge[1:] | ~word[1:])) + 1
    power = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), base, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power(_BASE)[:-1], dtype=np.uint64)])
    words = mixed((sums[last] - sums[first]) * power(pow(_BASE, -1, 1 << 64))[first] + (last - first).astype(np.uint64))
    owner = np.searchsorted(offsets, first, side="right") - 1
    n = np.bincount(owner, minlength=count)
    at = np.concatenate([[0], np.cumsum(n)])[:-1]

    def run(begin: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(begin), k, np.uint64)
        for i in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[begin + i])
        return out

    whole = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :]) if len(owner) >= size else np.zeros(0, int)
    begins, hashes = [whole], [run(whole, size)]
    for k in range(1, size):  # shorter texts are one run
        begins.append(at[n == k])
        hashes.append(run(begins[-1], k))
    who, h = owner[np.concatenate(begins)], np.concatenate(hashes).view(np.int64)
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (who[1:] != who[:-1]) | (h[1:] != h[:-1])
    return h[new], np.bincount(who[new], minlength=count)


def _hashed(text: pa.Array, size: int) -> pa.Array:
    text = text.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    every, counts, at = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _HASHED_BYTES)) - 1)
        h, n = _runs_of(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], size)
        every.append(h)
        counts.append(n)
        at = to
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(every)))


def with_shingle_hashes(rows: DataFrame, form: str, name: str, size: int = 5) -> DataFrame:
    """``rows`` with their shingles, as distinct 64-bit hashes, in place of the column ``form``, a normal form;
    none of a null. Python hashes whole batches, as lambdas over words cost ten times the seconds."""
    kept = [c for c in rows.columns if c != form]
    schema = rows.select(*kept, F.array().cast("array<bigint>").alias(name)).schema

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _hashed(batch.column(form), size)], [*kept, name])

    return rows.mapInArrow(hashed, schema)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united runs of two shingle columns; 0 where either is empty or null."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared runs over the smaller side's; 0 where either is empty or null."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.least(F.size(a), F.size(b))).otherwise(0.0)


def place_form(text: Column) -> Column:
    """A place name without case, marks and punctuation."""
    return F.trim(F.regexp_replace(F.lower(without_accents(text)), "[^a-z0-9]+", " "))


def agency_form(text: Column) -> Column:
    """A firm's name without case, marks, punctuation and legal form."""
    text = F.regexp_replace(F.lower(without_accents(text)), LEGAL_FORMS, " ")
    text = F.regexp_replace(F.regexp_replace(text, "&", " and "), r"\bst\b", "saint")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


# ---- kinds and figures ----------------------------------------------------------------------


def kind_named(text: Column) -> Column:
    """The kind whose word comes first in the text; null without one."""
    plain = F.regexp_replace(F.lower(without_accents(text)), "[-_/]", " ")
    plain = F.regexp_replace(plain, r"hotel\s+particulier", "hotelparticulier")
    places = [F.struct(F.nullif(F.regexp_instr(plain, F.lit(p)), F.lit(0)).alias("at"), F.lit(i).alias("rank"), F.lit(k).alias("kind")) for i, (k, p) in enumerate(KINDS)]
    found = F.filter(F.array(*places), lambda s: s["at"].isNotNull())
    return F.when(F.size(found) > 0, F.array_min(found)["kind"])


def canonical_kind(stated: Column, title: Column) -> Column:
    """The stated kind, else the one that the title names."""
    return F.coalesce(kind_named(stated), kind_named(title))


def number(text: Column) -> Column:
    """A number as adverts write it: grouped by commas or dots, with a decimal comma or point."""
    raw = F.regexp_replace(text, r"[^\d.,-]", "")
    comma_last = F.instr(F.reverse(raw), ",") < F.instr(F.reverse(raw), ".")
    only_comma = raw.contains(",") & ~raw.contains(".")
    continental = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    english = F.replace(raw, F.lit(","), F.lit(""))
    chosen = (
        F.when(raw.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), english)
        .when(raw.rlike(r"^-?\d{1,3}(\.\d{3}){2,}(,\d+)?$"), continental)
        .when(only_comma | (raw.contains(",") & raw.contains(".") & comma_last), continental)
        .otherwise(english)
    )
    return F.when(raw.rlike(r"\d"), chosen.try_cast("double"))


def surface(text: Column) -> Column:
    """Square metres, rounded, from a figure with a unit; null for a range or without a figure."""
    low = F.lower(text)
    value = number(F.regexp_extract(low, r"([\d][\d.,\s\u00a0]*)", 1))
    factor = F.when(low.rlike(r"sq\.?\s*f|ft"), SQ_FT).when(low.rlike(r"acre"), ACRE).when(low.rlike(r"\bha\b|hectare"), HECTARE).otherwise(1.0)
    return F.when(~low.rlike(r"\d\s*(-|–|to|à)\s*\d"), F.round(value * factor))


def first_count(text: Column) -> Column:
    """The first whole number, if above 0."""
    found = F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")
    return F.when(found > 0, found)


def living_area(*texts: Column) -> Column:
    """The living area that prose states first, between 10 and 2000 square metres."""
    text = F.lower(without_accents(F.concat_ws(" \n ", *texts)))

    def stated(pattern: str) -> Column:
        raw = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"[ \u00a0]", "")
        value = F.replace(F.regexp_replace(raw, r"\.(?=\d{3}\b)", ""), F.lit(","), F.lit(".")).try_cast("double")
        return F.struct(F.regexp_instr(text, F.lit(pattern)).alias("at"), value.alias("value"))

    fit = F.filter(F.array(*map(stated, LIVING)), lambda s: (s["at"] > 0) & s["value"].between(10, 2000))
    return F.when(F.size(fit) > 0, F.array_min(fit)["value"])


def licence_only(title: Column, area: Column) -> Column:
    """A licence for sale by itself: the title starts with it and no area is stated."""
    low = F.lower(without_accents(title))
    return F.coalesce(area.isNull() & low.rlike(r"^\s*licen[cs]e\s+(?:iv|4|iii|3|grande)\b"), F.lit(False))


def programme_page(url: Column) -> Column:
    """A building programme's page, by a segment of its path."""
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")).rlike(r"(?i)(^|/)programmes?(/|$)"), F.lit(False))


def placed_abroad(*texts: Column) -> Column:
    """The first marker of a place abroad, in lower case; else null."""
    return F.nullif(F.lower(F.regexp_extract(F.concat_ws("\n", *texts), ABROAD, 1)), F.lit(""))


def has_feature(text: Column, feature: str) -> Column:
    """Whether the text mentions a wish."""
    low, found = F.lower(text), F.lit(False)
    for word in FEATURES.get(feature, (feature.replace("_", " "),)):
        found = found | low.contains(word.lower())
    return F.coalesce(found, F.lit(False))


def display_title(title: Column, kind: Column, area: Column, place: Column) -> Column:
    """The title, unless a machine wrote it; then kind, area and place."""
    clean = F.trim(F.coalesce(title, F.lit("")))
    digits = F.length(F.regexp_replace(clean, r"\D", "")) / F.greatest(F.length(clean), F.lit(1))
    units = F.regexp_count(clean, F.lit(r"(?iu)\d+\s*(m²|pièces?|ch(ambres?)?|p)(?!\w)"))
    machine = (clean == "") | clean.rlike(r"(?i)^(vente|location|achat)\s") | ((digits > 0.3) & (units >= 2))
    size = F.when(area > 0, F.concat(F.lit(" · "), F.round(area).cast("long").cast("string"), F.lit(" m²")))
    composed = F.concat(F.coalesce(kind, F.lit("Property")), F.coalesce(size, F.lit("")), F.coalesce(F.concat(F.lit(" — "), place), F.lit("")))
    return F.when(machine, composed).otherwise(clean)


def characteristics(cells: Column, most_label: int = 40) -> tuple[Column, Column]:
    """(map of labels to values, array of flags) of cell texts: ``label : value`` or a bare flag."""
    tidy = F.transform(cells, lambda c: F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " ")))
    tidy = F.array_distinct(F.filter(tidy, lambda c: c != ""))
    at = lambda c: F.instr(c, ":")
    split = lambda c: (at(c) > 1) & (at(c) <= most_label + 1)
    label = lambda c: F.trim(F.substring_index(c, ":", 1))
    value = lambda c: F.trim(F.substr(c, at(c) + 1))

    def pairs(all_: Column) -> Column:
        found = F.filter(all_, lambda c: split(c) & (label(c) != "") & (value(c) != ""))
        found = F.transform(found, lambda c: F.struct(label(c).alias("k"), value(c).alias("v")))
        last = lambda f: F.filter(f, lambda s, i: ~F.exists(F.slice(f, i + 2, F.size(f)), lambda o: o["k"] == s["k"]))
        return let(found, last)

    bare = F.transform(tidy, lambda c: F.when(~split(c), c).when((value(c) == "") & (label(c) != ""), label(c)))
    return F.map_from_entries(let(tidy, pairs)), F.filter(bare, lambda c: c.isNotNull())


# ---- garbled text ---------------------------------------------------------------------------


def has_mojibake(text: Column) -> Column:
    """UTF-8 read as Latin-1 or Windows-1252 somewhere in the text."""
    return F.coalesce(text.rlike(MOJIBAKE), F.lit(False))


#: What follows a lead byte of the marks that Latin texts use, and where the sequences lie (fixed values).
_LATER = f"[\u0080-¿{_C1}]"
_GARBLED = re.compile(f"[ÂÃÅ]{_LATER}|â{_LATER}{{2}}|ð{_LATER}{{3}}")
# bytes that Windows-1252 has no sign for stand for themselves
codecs.register_error("marlstone-latin-1", lambda e: (e.object[e.start : e.end].encode("latin-1"), e.end))


def repaired(text: str) -> str:
    """Each misread two- to four-byte character put right; what doesn't decode stays. A no-break space
    behind à is often a plain one by then."""
    again = lambda m: m[0].encode("cp1252", "marlstone-latin-1").decode("utf-8", "ignore") or m[0]
    return _GARBLED.sub(again, text.replace("Ã ", "Ã\u00a0"))


@pandas_udf(StringType())
def repair_mojibake(text: pd.Series) -> pd.Series:
    """Texts with their garbled characters repaired; nulls stay."""
    return text.map(lambda t: None if t is None else repaired(t))


def with_repaired(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a column's garbled texts repaired; only rows that have one go through Python."""
    bad = has_mojibake(F.col(column))
    return df.where(~bad).unionByName(df.where(bad).withColumn(column, repair_mojibake(column)))


def beyond_repair(df: DataFrame, column: str) -> DataFrame:
    """The rows whose text is garbled still after the repair."""
    bad = df.where(has_mojibake(F.col(column)))
    return bad.where(has_mojibake(repair_mojibake(column)))


# ---- sites, hashes, formats -----------------------------------------------------------------

TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.nz", "com.br")


def host_of(url: Column) -> Column:
    """The lower-case host without ``www.``; null where the url doesn't parse."""
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def site_key(url: Column, overrides: dict[str, str] | None = None) -> Column:
    """The host's registrable label, or what ``overrides`` calls the host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    drop = F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)
    key = F.when(F.size(labels) > drop, F.try_element_at(labels, F.size(labels) - drop))
    for h, k in (overrides or {}).items():
        key = F.when(host == h, F.lit(k)).otherwise(key)
    return key


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(text, 256)


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def price_per_m2(price: Column, area: Column) -> Column:
    return F.when(area > 0, F.round(price / area))


def price_jump(before: Column, after: Column) -> Column:
    """A factor of five either way between two positive prices."""
    ratio = after / F.nullif(before, F.lit(0))
    return F.coalesce((before > 0) & (after > 0) & ((ratio >= 5) | (ratio <= 0.2)), F.lit(False))


def money(amount: Column) -> Column:
    """Millions, whole or with up to two decimals, else thousands."""
    parts = F.regexp_replace(F.format_string("%.2f", amount / 1e6), r"0$", "")
    millions = F.when(amount % 1e6 == 0, F.format_string("%.0f", amount / 1e6)).otherwise(parts)
    return F.when(amount >= 1e6, F.concat(millions, F.lit(" M€"))).otherwise(F.concat(F.floor(amount / 1000 + 0.5).cast("string"), F.lit(" k€")))


def percent(share: Column) -> Column:
    tenths = F.floor(share * 1000 + 0.5) / 10
    return F.concat(F.regexp_replace(tenths.cast("string"), r"\.0$", ""), F.lit(" %"))


def block_page(body: Column, markers: tuple[str, ...] = ("captcha", "access denied", "are you a robot", "unusual traffic", "datadome")) -> Column:
    """The first marker of a blocking page within its first 4000 characters."""
    head = F.lower(F.substring(body, 1, 4000))
    return F.coalesce(*(F.when(head.contains(m), F.lit(m)) for m in markers))


def portal_named(key: Column, names: dict[str, str], other: str = "agency sites") -> Column:
    """How a portal's key is shown; those that have no name are one group."""
    shown = F.lit(None).cast("string")
    for k, name in names.items():
        shown = F.when(key == k, F.lit(name)).otherwise(shown)
    return F.when(key.isNotNull(), F.coalesce(shown, F.lit(other)))


def json_merged(old: Column, new: Column) -> Column:
    """Two JSON objects as one, the new one's fields first in right; null where one isn't an object."""
    entries = lambda j: F.map_entries(F.from_json(j, "map<string,variant>", {"mode": "PERMISSIVE"}))
    mine, theirs = entries(new), entries(old)
    kept = F.filter(theirs, lambda e: ~F.exists(mine, lambda m: m["key"] == e["key"]))
    return F.to_json(F.map_from_entries(F.concat(kept, mine)))
