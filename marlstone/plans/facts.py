"""Functions and small operators over samples and stand-ins. Samples are dealt to the rows of ``part`` by
their key; beside each stands what must be read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import dates
from marlstone.functions import text as T
from marlstone.operators import cdc, health, latest, portals, scope
from marlstone.operators.resolution import cover, evidence
from marlstone.operators.tables import shared_folder
from marlstone.sources import readers
from marlstone.sources.tables import table
from marlstone.streaming import windows

#: column -> (samples and what each must give, SQL type, the function over column ``x``).
SAMPLES: dict[str, tuple[list[tuple], str]] = {
    "number": ([("1,234", 1234.0), ("12,345,678 €", 12345678.0), ("1.900.000", 1900000.0), ("85,5", 85.5), ("1.900,50", 1900.5), ("12.25", 12.25), ("none", None)], "DOUBLE"),
    "surface": ([("120 m²", 120.0), ("1,076 sq ft", 100.0), ("2 ha", 20000.0), ("3 acres", 12141.0), ("50 - 80 m²", None), ("1.5 hectare", 15000.0)], "DOUBLE"),
    "counted": ([("3 chambres", 3), ("0", None), ("aucune", None), ("T12 duplex", 12)], "INTEGER"),
    "living": ([("Villa de 160 m² habitables", 160.0), ("surface habitable : 85,5 m2", 85.5), ("5 m² habitables", None), ("1 200 m² habitables, terrain", 1200.0), ("rien", None)], "DOUBLE"),
    "kind": ([("Bel appartement T3", "Appartement"), ("Villa avec terrain", "Maison"), ("Terrain à bâtir", "Terrain"), ("Fonds de commerce", "Commerce"), ("Hôtel particulier", "Maison"), ("Box", "Parking"), ("rien", None)], "VARCHAR"),
    "licence": ([("Licence IV à vendre", True), ("Vend licence", False), ("licence 3", True)], "BOOLEAN"),
    "programme": ([("https://a.fr/programmes/1", True), ("https://a.fr/x-programme", False), ("https://a.fr/programme", True)], "BOOLEAN"),
    "abroad": ([("Villa à Phuket, plage", "phuket"), ("Saint-Tropez", None), ("10 000 THB", "thb"), ("thbx", None)], "VARCHAR"),
    "place": ([("La Môle (83)", "la mole 83"), ("  Saint-Tropez ", "saint tropez"), ("L'Été", "l ete")], "VARCHAR"),
    "agency": ([("BARNES St Tropez SARL", "barnes saint tropez"), ("A & B", "a and b"), ("Été S.A.R.L", "ete")], "VARCHAR"),
    "site": ([("https://www.a.example.co.uk/x", "example"), ("http://shop.bien.fr", "bien"), ("not a url", None)], "VARCHAR"),
    "form": ([("Belle <b>Maison</b>, Contactez-nous vite. Mer!", "belle maison mer"), ("Copropriété de 12 lots (détail). Été", "ete"), ("12", "")], "VARCHAR"),
    "blocked": ([("<p>Captcha</p>", "captcha"), ("fine", None), ("ACCESS DENIED", "access denied")], "VARCHAR"),
    "garbled": ([("Ã©tÃ©", True), ("été", False), ("lâ€™eau", True)], "BOOLEAN"),
    "repaired": ([("Ã©tÃ©", "été"), ("été", "été"), ("lâ€™eau", "l’eau"), ("voilÃ  tout", "voilà tout")], "VARCHAR"),
    "uuid": ([("123e4567-e89b-12d3-a456-426614174000", True), ("123E4567-E89B-12D3-A456-426614174000", True), ("x", False)], "BOOLEAN"),
    "pool": ([("Belle PISCINE", True), ("mer", False), ("swimming pool", True)], "BOOLEAN"),
    "slug": ([("/annonces/la-mole-83", True), ("/xla-mole", False), ("la-mole", True)], "BOOLEAN"),
    "canonical": ([('{"b": 1, "a": [2]}', '{"a":[2],"b":1}'), ("bad", None)], "VARCHAR"),
    "payload": ([('[{"a":1},["Ref",2],"x"]', '{"a": "x"}'), ('[[1,1],{"up":0}]', '[{"up": null}, {"up": null}]'), ("bad", None)], "VARCHAR"),
    "title": ([("Villa vue mer", "Villa vue mer"), ("Vente Maison 5 pièces", "Maison · 120 m² — Grimaud"), ("", "Maison · 120 m² — Grimaud")], "VARCHAR"),
}


def _reading(name: str, x: Column) -> Column:
    return {
        "number": T.number, "surface": T.surface, "counted": T.first_count, "living": T.living_area, "kind": T.kind_named, "licence": lambda c: T.licence_only(c, F.lit(None).cast("double")),
        "programme": T.programme_page, "abroad": T.placed_abroad, "place": T.place_form, "agency": T.agency_form, "site": T.site_key, "form": T.normal_form, "blocked": T.block_page,
        "garbled": T.has_mojibake, "repaired": T.repair_mojibake, "uuid": T.is_uuid, "pool": lambda c: T.has_feature(c, "pool"), "slug": lambda c: readers.slug_matches(c, ["la-mole"]),
        "canonical": readers.canonical_json, "payload": readers.payload_json, "title": lambda c: T.display_title(c, F.lit("Maison"), F.lit(120.4), F.lit("Grimaud")),
    }[name](x)


def _sample(name: str) -> Column:
    texts = [s for s, _ in SAMPLES[name][0]]
    return F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % len(texts) + 1).cast("int"))


def text_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reader of text makes of its samples."""
    part = table(spark, sf_dir, "part").select("p_partkey", *(_sample(n).alias(n) for n in SAMPLES))
    return part.select("p_partkey", *(_reading(n, F.col(n)).alias(n) for n in SAMPLES))


def listing_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and formats of parts as listings."""
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    area, at = F.when(k % 5 != 0, size * 2.0), F.timestamp_seconds(946684800 + k * 40000)
    image, images = cover(F.when(k % 2 == 0, "b"), F.array(F.lit("a"), F.lit(""), F.when(k % 4 < 2, "b"), F.lit("a")))
    labels, flags = T.characteristics(F.array(F.concat(F.lit("Vue : mer "), size.cast("string")), F.lit("Alarme :"), F.lit("Piscine"), F.lit(" ")))
    fact = portals.accepted("area", size * 1.0, F.concat(size.cast("string"), F.lit(" m²")), F.when(k % 3 == 0, F.lit(9.0)), F.concat(F.lit("Villa de "), F.when(k % 7 == 0, F.lit("x")).otherwise(size.cast("string")), F.lit(" m² au calme")))
    kind = F.when(k % 2 == 0, "Terrain").otherwise("Maison")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.price_per_m2(price * 1000, area).alias("per_m2"), T.money(size * 52000.0).alias("money"), T.percent(size / 50.0).alias("percent"), T.content_hash(F.col("p_name")).alias("hash"),
        dates.days_between(at, F.lit("2003-01-01").cast("timestamp")).alias("days"), dates.hour_in("UTC", at).alias("hour"), dates.inside_window("UTC", 22, 6, at).alias("inside"), dates.stamp_in("UTC", at).alias("stamp"),
        dates.period_start(at, 20).alias("period"), dates.age_label(size * 7.0).alias("age"), F.array_join(dates.day_slice(F.array(*map(F.lit, "abcde")), 2, at), "").alias("slice"),
        scope.land_out_of_area(kind, size * 1.0, F.when(k % 3 == 0, size * 1.0)).alias("floor"), scope.sane(F.when(k % 6 == 0, F.lit(float("nan"))).otherwise(price), 1500).alias("sane"),
        image.alias("image"), F.size(images).alias("images"), F.element_at(labels, "Vue").alias("view"), F.array_join(flags, ",").alias("flags"), fact["value"].alias("fact"), fact["refused"].alias("refused"),
        evidence(F.when(k % 4 == 0, "ref").when(k % 4 == 1, "structure").when(k % 4 == 2, "text")).alias("evidence"), health.bedrooms_from_labels(F.array(F.lit("Surface 3"), F.concat(size.cast("string"), F.lit(" chambres")))).alias("bedrooms"),
        scope.scope_decision(k % 11 != 0, k % 7 != 0, F.when(k % 5 != 0, "c"), k % 3 != 0).alias("refusal"),
    )


def run_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over runs: suppliers stand for runs."""
    k = F.col("s_suppkey")
    runs = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 40).alias("found"), (k % 25 + 15).alias("baseline"), F.when(k % 6 == 0, "error").when(k % 6 == 1, "partial").when(k % 6 == 2, "disabled").otherwise("done").alias("status"),
                                                   (k % 4).alias("discovered"), F.when(k % 3 != 0, k % 2).alias("incomplete"), F.when(k % 13 == 0, "blocked").alias("stopped"), (k % 5 - 3).alias("failed"))
    stale = health.stale_share(k % 30, k % 37 + 10, k % 12, k % 2 == 0)
    return runs.select(
        "s_suppkey", cdc.should_abort(F.col("found"), F.col("baseline")).alias("abort"), cdc.trust_gone(F.col("baseline"), F.col("baseline") - F.col("discovered")).alias("believed"),
        cdc.run_status(k % 2 == 0, k % 3 == 0).alias("came_to"), portals.grade().alias("grade"), cdc.incomplete(F.col("found"), F.col("baseline"), 3).alias("incomplete"),
        health.threshold(F.col("discovered"), 1, 3, "x")["status"].alias("anomalies"), health.meter(F.col("found"), F.lit(40))["status"].alias("meter"),
        stale["by_rule"].alias("stale_by_rule"), stale["by_us"].alias("stale_by_us"), T.price_jump(F.col("found"), F.col("baseline")).alias("jump"),
    )


def pass_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass does with orders: fetched, left out, read again, verified, shielded; counts and sums."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("place"), F.col("o_orderdate").alias("seen"))
    k = F.col("id")
    tally = lambda name, df: df.agg(F.count("*").alias("n"), F.sum("id").alias("sum")).select(F.lit(name).alias("step"), "n", "sum")
    fetch, left = cdc.plan_fetch(o.select("id", (k % 3 == 0).alias("is_new"), F.when(k % 4 == 0, "x").when(k % 4 == 1, "y").alias("syndicated")))
    hashes = lambda m: o.where(k % m != 0).select("id", F.when(k % 10 != 0, (k % m).cast("string")).alias("hash"))
    changed = cdc.changed_in_hand(o.where(k % 2 == 0), hashes(7), hashes(5), "id", o.where(k % 11 == 0))
    shield = cdc.shielded(o, o.select("place").where("place < 5").distinct(), "place")
    verify = cdc.unseen_to_verify(o, o.where(k % 3 == 0), shield, "id", "seen", F.lit("1998-01-01").cast("timestamp"), 50)
    new = latest.inserted(o.where(k % 2 == 0), o.where(k % 3 == 0), ["id"])
    kept = latest.retained(o, "seen", "2001-08-02", 400)
    since = windows.changes_since(o, "seen", "2001-01-01", 7 * 3600)
    steps = {"fetch": fetch, "changed": changed, "shielded": shield, "verify": verify, "inserted": new, "retained": kept, "since": since}
    out = left.select(F.concat(F.lit("left "), "syndicated").alias("step"), "n", F.lit(None).cast("long").alias("sum"))
    for name, df in steps.items():
        out = out.union(tally(name, df))
    return out


def delisted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of listings that leave, for those that hadn't left before."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "delisted").otherwise("active").alias("status"), F.col("o_orderpriority").alias("availability"))
    after, events = cdc.delisted(o, o.where("o_orderkey % 6 = 0").select("o_orderkey"), "o_orderkey")
    gone = after.where("status = 'delisted'").agg(F.count("*").alias("gone"))
    return events.groupBy("type", "last_availability").agg(F.count("*").alias("n")).crossJoin(gone)


def retry_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose last run failed lately after one that finished."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    runs = o.select(k.alias("run_id"), (F.col("o_custkey") % 100).alias("source"), F.col("o_orderdate").alias("started_at"), F.when(k % 3 == 0, "error").when(k % 3 == 1, "partial").otherwise("done").alias("status"))
    sources = o.select((F.col("o_custkey") % 100).alias("source")).distinct().withColumn("enabled", F.col("source") % 7 != 0)
    return cdc.retries(runs, sources, F.lit("2001-08-02").cast("timestamp"), 24 * 30).select("source", "latest", "previous")


def stalest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten places that no good run has covered for longest."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    runs = o.where("o_orderdate < '1996-06-01'").select(F.array(F.col("o_custkey") % 40, F.col("o_custkey") % 60).alias("places"), F.when(k % 2 == 0, "done").otherwise("error").alias("status"), F.when(k % 10 == 0, "x").alias("error"), F.col("o_orderdate").alias("finished_at"))
    places = spark.range(70).select(F.col("id").alias("place"))
    return cdc.stalest(places, runs, 10)


def configuration_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a nation and a segment without customers, and nations that a list wants and none has."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    had = c.where("c_custkey % 9 = 0").select(F.col("c_mktsegment").alias("portal"), F.col("c_nationkey").alias("place")).distinct()
    every = n.select(F.col("n_nationkey").alias("place"))
    gaps = cdc.coverage_gaps(c.select(F.col("c_mktsegment").alias("portal")).distinct(), every, had).select("portal", "place")
    return gaps.union(cdc.unaddressable(every, had.where("portal = 'BUILDING'").select("place"), ["place"]).select(F.lit("none"), "place"))


def moved_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose open lines all get one new place."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "O", "active").otherwise("x").alias("status"), (F.col("l_orderkey") % 5).cast("string").alias("place"), F.when(F.col("l_suppkey") % 3 != 0, (F.col("l_suppkey") % 2).cast("string")).alias("new_place"))
    return cdc.moving_whole(lines, "l_orderkey", "place", "new_place")


def worst_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst status of each customer's orders, and the upper middle of their prices."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(k % 5 == 0, "red").when(k % 5 == 1, "amber").when(k % 5 == 2, "unknown").otherwise("green")
    per = o.groupBy("o_custkey").agg(latest.worst(status).alias("worst"), F.collect_list("o_totalprice").alias("prices"))
    return per.select("o_custkey", "worst", latest.upper_middle(F.col("prices")).alias("middle"))


def carried_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of aggregators' rows by the portals they carry."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    struct = lambda u, d: F.struct(u.alias("url"), F.lit(d).alias("published"))
    rows = p.select(k.alias("id"), F.when(k % 3 == 0, "agg").otherwise("x").alias("source"), F.concat(F.lit("https://agg.com/"), k.cast("string")).alias("url"), F.array(struct(F.col("url"), "d1"), struct(F.concat(F.lit("https://www.portal.fr/"), k.cast("string")), "d2"), struct(F.lit("bad"), None)).alias("carried"))
    return portals.carried_links(rows, ["agg"]).select("id", "key", "published")


def resolved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of parts by stated names, postcodes and prose."""
    names = [("saint tropez", "119"), ("grimaud", "068"), ("la mole", "079"), ("mole", "x")]
    k, pick = F.col("p_partkey"), lambda *t: F.element_at(F.array(*(F.lit(x) for x in t)), (F.col("p_partkey") % len(t) + 1).cast("int"))
    said, code, prose = pick("Grimaud", None, "La Môle et Grimaud", "Nice"), pick(None, "83310", "83990"), pick("villa à Port-Grimaud", "belle vue, Grimaud", "rien", "x", "saint tropez")
    place = portals.resolve_place(said, code, prose, names, {"068": [("port grimaud", "068p")], "119": []}, {"83310": ["042", "068"], "83990": ["119"]})
    return table(spark, sf_dir, "part").select("p_partkey", place.alias("place")).where(k >= 0)


def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of parts that a strict client refuses or mends."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select("p_partkey", F.when(k % 5 == 0, -1.0).otherwise(F.col("p_retailprice")).alias("price"), F.when(k % 7 == 0, 2e5).otherwise(F.col("p_size")).alias("area"), F.when(k % 3 == 0, "http://x").otherwise("https://x").alias("url"), F.when(k % 4 == 0, "Ã©").otherwise("é").alias("text"))
    return health.contract_issues(rows, "p_partkey")


def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the last 14 days that have any."""
    return health.recent_runs(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey")


def sitemap_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the dates of a map of all pages can drive refreshes."""
    entries = table(spark, sf_dir, "pages").select(F.col("url").alias("loc"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))).alias("lastmod"))
    return readers.lastmod_verdict(entries, "2024-02-10").select("n", "dated", "days", "newest", "verdict")


def encoded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that pages carry as base64 in an attribute, read back."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<a data-o="'), F.translate(F.base64(F.encode("url", "UTF-8")), "\r\n", ""), F.lit('"></a><a data-o="Yg==">')).alias("body"))
    return readers.encoded_links(p, "page_id")


def joined_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the nations they refer to, in the order of the references."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    ref = lambda x: F.struct(F.lit("nation").alias("type"), x.cast("string").alias("id"))
    records = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 6 != 0, F.array(ref(F.col("c_nationkey")), ref(F.col("c_custkey") % 30))).alias("refs"))
    included = n.select(F.lit("nation").alias("type"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("attributes"))
    return readers.with_includes(records, included, "refs", "nations").select("id", F.array_join(F.transform("nations", lambda x: x["attributes"]), ",").alias("nations"))


def stable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are one record once what changes from read to read is left out."""
    record = F.struct("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate")
    return table(spark, sf_dir, "lineitem").groupBy(readers.stable_hash(record, ["l_shipdate"]).alias("h")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("records"))


def labelled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values behind a label in pages' markup, by the HTML reader."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<div><span>Area :</span><b class='v'>"), F.col("p_size").cast("string"), F.lit(" m&sup2;</b><script>x<b</script><i>Area</i></div>")).alias("body"))
    return readers.labelled(readers.html_elements(rows, "p_partkey"), "p_partkey", "area")


def icon_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand around an icon, some steps out."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    inner = F.when(k % 3 == 0, "<span class='w'><i class='icon bed'></i></span>").when(k % 3 == 1, "<i class='bed'></i>").otherwise("<i class='bedroom'></i>")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<ul class='l'><li class='x'>"), inner, size, F.lit("</li><li class='y'>other</li></ul>")).alias("body"))
    return readers.by_icon(readers.html_elements(rows, "p_partkey"), "p_partkey", "bed")


def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as snapshots by source and day; the last of each user."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("id"), F.col("ts").alias("fetched_at"), F.col("event_id").cast("string").alias("body"))
    path = shared_folder(spark)
    readers.write_snapshots(rows, path)
    return readers.latest_snapshots(spark, path).select("source", "id", "fetched_at")


def landed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as gzipped JSON lines and as a page, read back as rows and as one text."""
    nation, path = table(spark, sf_dir, "nation"), shared_folder(spark)
    nation.coalesce(1).write.option("compression", "gzip").json(path)
    rows = readers.json_lines(spark, path, "n_nationkey int, n_name string, n_regionkey int")
    page = readers.pages_at(spark, path).select(F.size(F.split(F.rtrim(F.regexp_replace("body", r"\n$", "")), "\n")).alias("lines"))
    return rows.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names")).crossJoin(page)


def advanced_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored marks after passes, of which only finished ones count."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    marks = o.groupBy((F.col("o_custkey") % 50).alias("place")).agg(F.min("o_orderdate").alias("mark")).where("place < 40")
    passes = o.select((F.col("o_custkey") % 50).alias("place"), F.col("o_orderdate").alias("started_at"), (k % 3 == 0).alias("finished")).where("place >= 10")
    return windows.advanced_marks(marks, passes)


def appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of nations delivered twice, in the log once: rows by region."""
    folder = shared_folder(spark)
    table(spark, sf_dir, "nation").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    for n in range(2):
        windows.append_changes(spark, stream, ["n_nationkey"], f"{folder}/log", f"{folder}/marks{n}").awaitTermination()
    return spark.read.parquet(f"{folder}/log").groupBy("n_regionkey").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        text_readings, listing_figures, run_rules, pass_plan, delisted_events, retry_sources, stalest_places, configuration_gaps, moved_whole, worst_statuses, carried_links, resolved_places,
        contract_issues, last_runs, sitemap_dates, encoded_links, joined_includes, stable_records, labelled_values, icon_values, snapshot_round_trip, landed_lines, advanced_marks, appended_once,
    )
}


def _expected(name: str) -> str:
    pairs, kind = SAMPLES[name]
    say = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"
    return f"CASE p_partkey % {len(pairs)} {' '.join(f'WHEN {i} THEN {say(v)}' for i, (_, v) in enumerate(pairs))} END::{kind} AS {name}"


_HTTP = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '')"
ORACLES = {
    "text_readings": f"SELECT p_partkey, {', '.join(map(_expected, SAMPLES))} FROM part",
    "listing_figures": """
WITH p AS (SELECT *, p_partkey AS k, p_size AS z, TIMESTAMP '2000-01-01' + to_seconds(p_partkey * 40000) AS t FROM part),
q AS (SELECT *, CASE WHEN day(t) >= 20 THEN date_trunc('month', t)::DATE + 19 ELSE (date_trunc('month', t) - INTERVAL 1 MONTH)::DATE + 19 END AS period FROM p)
SELECT p_partkey, CASE WHEN k % 5 <> 0 THEN round(p_retailprice * 1000 / (z * 2.0)) END AS per_m2,
  CASE WHEN z * 52000 >= 1000000 THEN CASE WHEN z * 52000 % 1000000 = 0 THEN (z * 52000 // 1000000)::VARCHAR ELSE regexp_replace(printf('%.2f', z * 0.052), '0$', '') END || ' M€' ELSE floor(z * 52 + 0.5)::BIGINT || ' k€' END AS money,
  CASE WHEN z * 20 % 10 = 0 THEN (z * 2)::VARCHAR ELSE (z * 20 / 10)::VARCHAR END || ' %' AS percent, sha256(p_name) AS hash, greatest(0, floor(date_diff('second', t, TIMESTAMP '2003-01-01') / 86400))::BIGINT AS days,
  hour(t)::INTEGER AS hour, hour(t) >= 22 OR hour(t) < 6 AS inside, strftime(t, '%Y-%m-%d %H:%M:%S') AS stamp, period,
  CASE WHEN z * 7 >= 120 THEN floor(z * 7 / 60 + 0.5)::BIGINT || ' h' ELSE z * 7 || ' min' END AS age, substr('abcdeabcde', ((dayofyear(t) - 1) * 2) % 5 + 1, 2) AS slice,
  CASE WHEN NOT (k % 2 = 0 AND k % 3 = 0) THEN z::DOUBLE END AS floor, CASE WHEN k % 6 <> 0 AND p_retailprice <= 1500 THEN p_retailprice END AS sane,
  CASE WHEN k % 2 = 0 AND k % 4 < 2 THEN 'b' ELSE 'a' END AS image, CASE WHEN k % 4 < 2 THEN 2 ELSE 1 END AS images, 'mer ' || z AS view, 'Alarme,Piscine' AS flags,
  CASE WHEN k % 3 <> 0 AND z >= 10 AND k % 7 <> 0 THEN z::DOUBLE END AS fact, CASE WHEN k % 3 = 0 THEN NULL WHEN z < 10 THEN 'out of range' WHEN k % 7 = 0 THEN 'quote not in the advert' END AS refused,
  CASE k % 4 WHEN 0 THEN 'mandate' WHEN 1 THEN 'measurements' WHEN 2 THEN 'text' END AS evidence, z::INTEGER AS bedrooms,
  CASE WHEN k % 11 = 0 THEN 'unknown user' WHEN k % 7 = 0 THEN 'inactive user' WHEN k % 5 = 0 THEN 'no client' WHEN k % 3 = 0 THEN 'inactive client' END AS refusal FROM q""",
    "run_rules": """
WITH r AS (SELECT s_suppkey AS k, s_suppkey % 40 AS f, s_suppkey % 25 + 15 AS b, s_suppkey % 4 AS d, s_suppkey % 37 + 10 AS a, s_suppkey % 30 AS s, s_suppkey % 12 AS e FROM supplier)
SELECT k AS s_suppkey, b >= 20 AND f / b < 0.5 AS abort, b < 20 OR (b - d) / b <= 0.9 AS believed, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'done' WHEN k % 2 = 0 THEN 'partial' ELSE 'aborted' END AS came_to,
  CASE WHEN k % 6 = 0 THEN 'fail' WHEN k % 6 = 2 THEN 'warn' WHEN d = 0 AND k % 3 <> 0 AND k % 2 > 0 THEN 'fail' WHEN k % 6 = 1 THEN 'warn' WHEN k % 13 = 0 THEN 'fail' WHEN k % 5 > 3 THEN 'warn' ELSE 'ok' END AS grade,
  f + 3 < b AS incomplete, CASE WHEN d >= 3 THEN 'red' WHEN d >= 1 THEN 'amber' ELSE 'green' END AS anomalies, CASE WHEN f / 40 >= 0.95 THEN 'red' WHEN f / 40 >= 0.8 THEN 'amber' ELSE 'green' END AS meter,
  CASE WHEN a < 20 THEN 'unknown' WHEN s / a > 0.3 THEN CASE WHEN k % 2 = 0 THEN 'amber' ELSE 'red' END ELSE 'green' END AS stale_by_rule,
  CASE WHEN a < 20 THEN 'unknown' WHEN a - e >= 20 AND (s - least(s, e)) / (a - e) > 0.3 THEN CASE WHEN k % 2 = 0 THEN 'amber' ELSE 'red' END ELSE 'green' END AS stale_by_us, f > 0 AND (b / nullif(f, 0) >= 5 OR b / nullif(f, 0) <= 0.2) AS jump FROM r""",
    "pass_plan": """
WITH o AS (SELECT o_orderkey AS id, o_custkey % 25 AS place, o_orderdate AS seen FROM orders),
v AS (SELECT id FROM o WHERE place < 5 AND id % 3 <> 0 AND seen < '1998-01-01' ORDER BY seen, id LIMIT 50)
SELECT 'fetch' AS step, count(*) AS n, sum(id)::BIGINT AS sum FROM o WHERE NOT (id % 3 = 0 AND id % 4 < 2) UNION ALL SELECT 'left ' || CASE id % 4 WHEN 0 THEN 'x' ELSE 'y' END, count(*), NULL FROM o WHERE id % 3 = 0 AND id % 4 < 2 GROUP BY 1
UNION ALL SELECT 'changed', count(*), sum(id)::BIGINT FROM o WHERE id % 2 = 0 AND id % 7 <> 0 AND id % 10 <> 0 AND id % 11 <> 0 AND id % 7 IS DISTINCT FROM CASE WHEN id % 5 <> 0 THEN id % 5 END
UNION ALL SELECT 'shielded', count(*), sum(id)::BIGINT FROM o WHERE place < 5 UNION ALL SELECT 'verify', count(*), sum(id)::BIGINT FROM v UNION ALL SELECT 'inserted', count(*), sum(id)::BIGINT FROM o WHERE id % 2 = 0 OR id % 3 = 0
UNION ALL SELECT 'retained', count(*), sum(id)::BIGINT FROM o WHERE seen >= TIMESTAMP '2001-08-02' - INTERVAL 400 DAY UNION ALL SELECT 'since', count(*), sum(id)::BIGINT FROM o WHERE seen >= TIMESTAMP '2001-01-01' - INTERVAL 7 HOUR""",
    "delisted_events": """
SELECT 'delisted' AS type, o_orderpriority AS last_availability, count(*) AS n, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 0) AS gone FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 4 <> 0 GROUP BY 2""",
    "retry_sources": """
WITH r AS (SELECT o_custkey % 100 AS source, o_orderdate AS t, CASE o_orderkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'partial' ELSE 'done' END AS st, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT a.source, a.st AS latest, b.st AS previous FROM r AS a JOIN r AS b USING (source) WHERE a.k = 1 AND b.k = 2 AND a.st = 'error' AND a.t >= TIMESTAMP '2001-08-02' - INTERVAL 30 DAY AND b.st IN ('done', 'partial') AND source % 7 <> 0""",
    "stalest_places": """
WITH g AS (SELECT unnest([o_custkey % 40, o_custkey % 60]) AS place, o_orderdate AS t FROM orders WHERE o_orderdate < '1996-06-01' AND o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0), l AS (SELECT place, max(t) AS last_run FROM g GROUP BY 1)
SELECT range AS place, last_run FROM range(70) LEFT JOIN l ON place = range ORDER BY last_run NULLS FIRST, range LIMIT 10""",
    "configuration_gaps": """
WITH h AS (SELECT DISTINCT c_mktsegment AS portal, c_nationkey AS place FROM customer WHERE c_custkey % 9 = 0)
SELECT portal, n_nationkey AS place FROM (SELECT DISTINCT c_mktsegment AS portal FROM customer), nation WHERE (portal, n_nationkey) NOT IN (SELECT (portal, place) FROM h)
UNION ALL SELECT 'none', n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT place FROM h WHERE portal = 'BUILDING')""",
    "moved_whole": """
WITH l AS (SELECT l_orderkey, (l_orderkey % 5)::VARCHAR AS place, CASE WHEN l_suppkey % 3 <> 0 THEN (l_suppkey % 2)::VARCHAR END AS w FROM lineitem WHERE l_linestatus = 'O')
SELECT l_orderkey, max(place) AS place, max(w) AS new_place FROM l GROUP BY 1 HAVING count(DISTINCT coalesce(w, '-')) = 1 AND max(w) IS DISTINCT FROM max(place)""",
    "worst_statuses": """
SELECT o_custkey, (['unknown', 'green', 'amber', 'red'])[max(CASE o_orderkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END)] AS worst, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS middle FROM orders GROUP BY 1""",
    "carried_links": f"""
WITH p AS (SELECT page_id AS id, {_HTTP} AS host FROM pages WHERE page_id % 3 = 0)
SELECT DISTINCT id, string_split(host, '.')[-2] AS key, 'd1' AS published FROM p UNION ALL SELECT id, 'portal', 'd2' FROM p WHERE string_split(host, '.')[-2] <> 'portal' UNION ALL SELECT id, 'agg', NULL FROM p WHERE string_split(host, '.')[-2] <> 'agg'""",
    "resolved_places": """
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '068' WHEN 2 THEN '079' END AS named, p_partkey % 4 = 1 AS unsaid, p_partkey % 3 AS c, p_partkey % 5 AS t FROM part),
q AS (SELECT *, coalesce(named, CASE WHEN c = 1 THEN CASE WHEN t IN (0, 1) THEN '068' ELSE '042' END WHEN c = 2 THEN '119' END, CASE WHEN unsaid AND t = 0 THEN '068p' END) AS place FROM p)
SELECT p_partkey, CASE WHEN place = '068' AND t = 0 THEN '068p' ELSE place END AS place FROM q""",
    "contract_issues": """
SELECT p_partkey, unnest(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'price' END, CASE WHEN p_partkey % 7 = 0 THEN 'area' END, CASE WHEN p_partkey % 3 = 0 THEN 'url' END, CASE WHEN p_partkey % 4 = 0 THEN 'text' END], lambda x: x IS NOT NULL)) AS field,
  CASE field WHEN 'url' THEN 'flagged' WHEN 'text' THEN 'repaired' ELSE 'dropped' END AS action FROM part""",
    "last_runs": "SELECT o_orderkey FROM orders WHERE o_orderdate IN (SELECT DISTINCT o_orderdate FROM orders ORDER BY 1 DESC LIMIT 14)",
    "sitemap_dates": """
WITH e AS (SELECT CASE WHEN page_id % 3 <> 0 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS d FROM pages)
SELECT count(*) AS n, count(d) AS dated, count(DISTINCT d) AS days, max(d) AS newest, CASE WHEN DATE '2024-02-10' - max(d)::DATE > 30 THEN 'stale' ELSE 'usable' END AS verdict FROM e""",
    "encoded_links": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^(https?://|/)')",
    "joined_includes": """
WITH c AS (SELECT c_custkey AS id, [c_nationkey, c_custkey % 30] AS refs FROM customer WHERE c_custkey % 6 <> 0), u AS (SELECT id, unnest(refs) AS r, generate_subscripts(refs, 1) AS i FROM c),
j AS (SELECT id, string_agg(n_name, ',' ORDER BY i) AS nations FROM u JOIN nation ON n_nationkey = r GROUP BY 1) SELECT c_custkey AS id, nations FROM customer LEFT JOIN j ON id = c_custkey""",
    "stable_records": "WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus) SELECT n, count(*) AS records FROM g GROUP BY 1",
    "labelled_values": "SELECT p_partkey, p_size || ' m²' AS value FROM part",
    "icon_values": "SELECT p_partkey, p_size::VARCHAR AS value FROM part WHERE p_partkey % 3 < 2",
    "snapshot_round_trip": "SELECT event_type AS source, user_id::VARCHAR AS id, max(ts) AS fetched_at FROM events GROUP BY 1, 2",
    "landed_lines": "SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names, (SELECT count(*) FROM nation)::INTEGER AS lines FROM nation GROUP BY 1",
    "advanced_marks": """
WITH m AS (SELECT o_custkey % 50 AS place, min(o_orderdate) AS mark FROM orders GROUP BY 1 HAVING place < 40), p AS (SELECT o_custkey % 50 AS place, max(o_orderdate) AS t FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1 HAVING place >= 10)
SELECT place, greatest(mark, t) AS mark FROM m FULL JOIN p USING (place)""",
    "appended_once": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1",
}
