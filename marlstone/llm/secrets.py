"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

All of it is DataFrame functions; only the trained table of log ratios, whose size the alphabet
fixes, passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import only
from marlstone.sources.tables import spread, table

KINDS = ("assign", "access", "hex")
#: kind -> (expression, group whose length counts, least length); no expression matches emptily.
PATTERNS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # of a run's start, all or nothing: as [0-9a-f]+ of 16 or more
}
#: What the models judge: whole runs of token characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Nats per character by which a run must look more like a random string than like an identifier.
MARGIN = 0.25
#: Labelled samples of each class; the bound of what the models are fitted on.
SAMPLES = 3000
_SIDE = len(ALPHABET) + 1  # place 0: a run's start

#: Parts of ordinary identifiers, paths and compounds (fixed values).
PARTS = (
    "account action active address admin amount array async backup base batch benchmark buffer build button cache "
    "call campaign channel check client close cluster code column command comment common config connection container "
    "content context control convert cookie copy count create current customer data date debug default delete device "
    "dialog display document domain download driver edit element email enable encode engine entity entry error event "
    "example execute export factory feature field file filter folder format function gateway group handler header "
    "history home host image import index info input install instance interface internal invoice item january key "
    "label language layout level library license limit line link list load local location login manager map market "
    "master member memory menu message method model module monitor name network node note number object offset "
    "option order output owner package page parameter parser partition path pattern payment plugin policy position "
    "price print private process product profile project property protocol provider public quality query queue "
    "reader record region register release remote remove render report request reset resource response result "
    "return role route rule sample scan schedule schema scope search section select sequence server service session "
    "setting shared single size source stage start state static status storage store stream string structure style "
    "submit summary support switch system table target task template test text theme thread time title toggle total "
    "track transfer transform tree trigger type update upload user utils value version view visible web width window "
    "worker write zone und der die das nicht für les des que para con una los"
).split()


def _pick(items: tuple[str, ...] | list[str], seed: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(seed, F.lit(len(items))) + 1).cast("int"))


def labelled_samples(spark: SparkSession, size: int = SAMPLES) -> DataFrame:
    """(value, random): ``size`` random strings and as many ordinary identifiers, the same each time.

    Random strings are base64 or hexadecimal texts of digests and mixed-case cuts of them; ordinary
    ones join common parts in the usual styles, some with a number or a date.
    """
    rows = spark.range(size, numPartitions=1)
    noise = lambda k: F.sha2(F.concat(F.lit(f"marlstone-{k}-"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(F.concat(noise(1), noise(2))))
    style = F.pmod(F.col("id"), F.lit(5))
    random = (
        F.when(style == 0, F.substring(noise(3), 1, 40))
        .when(style == 1, F.substring(b64, 3, 40))
        .when(style == 2, F.upper(F.substring(F.translate(b64, "+/=", "Zq7"), 5, 24)))
        .when(style == 3, F.translate(F.substring(b64, 11, 32), "+/", "-_"))
        .otherwise(F.translate(F.substring(b64, 2, 28), "+/=", "k3X"))
    )
    draw = [F.xxhash64(F.col("id"), F.lit(k)) for k in range(6)]
    words = [_pick(PARTS, d) for d in draw[:4]]
    camel = F.concat(words[0], *(F.initcap(w) for w in words[1:]))
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *words))
        .when(style == 1, camel)
        .when(style == 2, F.concat_ws("-", *words[:3], F.pmod(draw[4], F.lit(2100)).cast("string")))
        .when(style == 3, F.concat_ws("/", *words))
        .otherwise(F.when(F.pmod(draw[5], F.lit(2)) == 0, F.upper(F.concat_ws("_", *words[:3]))).otherwise(F.concat(*words)))
    )
    ruled = F.repeat(_pick(["-", "=", "_", "/", "+", "x", "0", "-=", "ha"], draw[4]), 24)
    plain = F.when(F.pmod(draw[5], F.lit(25)) == 1, ruled).otherwise(ordinary)
    return rows.select(random.alias("value"), F.lit(True).alias("random")).union(rows.select(plain, F.lit(False)))


def _places(value: Column) -> Column:
    """Places of a text's characters in the alphabet; 0 for any other."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _steps(value: Column) -> Column:
    """A number for each character and its predecessor; the first one follows the start."""
    at = _places(value)
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(at, 1, F.size(at) - 1)), at, lambda a, b: a * _SIDE + b)


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio, random over ordinary, of each step from character to character.

    Add-one smoothed first-order models of both classes. Rows with a null are ignored; without any
    rows all ratios are 0. The result has as many numbers as pairs of the alphabet.
    """
    counted = (
        samples.where("value IS NOT NULL AND random IS NOT NULL AND value <> ''")
        .select("random", F.explode(_steps(F.col("value"))).alias("step"))
        .groupBy("step")
        .agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    )
    cells = samples.sparkSession.range(_SIDE * _SIDE, numPartitions=1).select(F.col("id").cast("int").alias("step"))
    cells = cells.join(counted, "step", "left").na.fill(0).withColumn("before", F.floor(F.col("step") / _SIDE))
    sums = cells.groupBy("before").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    ratio = F.log((F.col("r") + 1) / (F.col("rs") + _SIDE)) - F.log((F.col("o") + 1) / (F.col("os") + _SIDE))
    rows = cells.join(sums, "before").select("step", ratio.alias("ratio")).orderBy("step").collect()
    return [row.ratio for row in rows]


def running_starts(pieces: Column, matches: Column, block: int = 256) -> Column:
    """Start of each match, from the lengths of the pieces between matches and of the matches.

    Sums run within blocks, and over blocks' sums, so the work stays near linear.
    """
    both = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(p.alias("p"), (p + m).alias("t")))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(both) / block).cast("int") - 1), lambda b: F.slice(both, b * block + 1, block))
    total = lambda a: F.aggregate(a, F.lit(0).cast("int"), lambda s, x: s + x["t"])
    sums = F.transform(blocks, total)

    def within(rows: Column, b: Column) -> Column:
        base = F.aggregate(F.slice(sums, 1, b), F.lit(0).cast("int"), lambda s, x: s + x)
        return F.transform(rows, lambda x, i: base + total(F.slice(rows, 1, i)) + x["p"])

    return F.when(F.size(both) > 0, F.flatten(F.transform(blocks, within))).otherwise(F.array().cast("array<int>"))


def _found(text: Column, kind: str, expression: str, group: int, least: int) -> Column:
    """Array of (start, rank, end, kind) of the matches that are long enough, in code points."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(expression), F.lit(0)), F.length)
    part = F.transform(F.regexp_extract_all(text, F.lit(expression), F.lit(group)), F.length) if group else whole
    starts = running_starts(F.transform(F.split(text, expression, -1), F.length), whole)
    rank = (*KINDS, "markov").index(kind)
    spans = F.arrays_zip(starts.alias("start"), whole.alias("size"), part.alias("part"))
    spans = F.filter(spans, lambda s: s["part"] >= least)
    spans = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), (s["start"] + s["size"]).alias("end"), F.lit(kind).alias("kind")),
    )
    return F.when(F.regexp_like(text, F.lit(expression)), spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))


def _listed(spans: Column) -> Column:
    named = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(named, ",")


def _mean_ratio(value: Column, table: Column) -> Column:
    steps = _steps(value)
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.element_at(table, x + 1)) / F.size(steps)


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    The models add runs of 20 token characters or more whose mean log ratio is at least ``margin``
    and which no pattern's span overlaps. Row-local but for the small training; whole texts. Null
    and empty texts have no spans; repeated rows are each scanned; null ids stay null; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ratios = train(samples if samples is not None else labelled_samples(spark))
    table = F.from_json(F.lit(str([round(x, 6) for x in ratios])), "array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", *(_found(F.col("text"), k, *PATTERNS[k]).alias(k) for k in KINDS))
    rows = rows.select("doc_id", "text", *KINDS, F.concat(*KINDS).alias("base"))
    looks = _found(F.col("text"), "markov", CANDIDATE, 0, 20)
    clear = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    odd = lambda s: _mean_ratio(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]), table) >= margin
    rows = rows.withColumn("more", F.filter(F.filter(looks, clear), odd))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_markov"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``."""
    return find_secrets(spread(table(spark, sf_dir, "documents")))
