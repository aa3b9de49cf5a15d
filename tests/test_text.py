import json
import random
import unicodedata

from pyspark.sql import functions as F

from marlstone.functions import dates
from marlstone.functions import text as T
from marlstone.sources import readers


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_accents_and_normal_form(spark):
    r = random.Random(1)
    texts = ["".join(chr(r.choice([*range(0x41, 0x7B), *range(0xC0, 0x180), 0x301, 32])) for _ in range(40)) for _ in range(200)]
    want = ["".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) <= 0x36F) for t in texts]
    assert values(spark, T.without_accents(F.col("x")), texts) == want
    got = values(spark, T.normal_form(F.col("x")), ["Belle <b>Maison</b> à 350 m², Contactez-nous vite. Mer!", None, "www.georisques.gouv.fr"])
    assert got == ["belle maison a m mer", None, ""]


def test_shingles_and_similarity(spark):
    assert values(spark, T.shingles(F.col("x")), ["a b c d e f a b c d e", "a b", "", None]) == [["a b c d e", "b c d e f", "c d e f a", "d e f a b", "e f a b c", "f a b c d"], ["a b"], [], []]
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d", "e"]), ([], ["a"])], "a array<string>, b array<string>")
    rows = df.select(T.jaccard(F.col("a"), F.col("b")), T.containment(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(2 / 5, 2 / 3), (0.0, 0.0)]


def test_kinds_and_figures(spark):
    x = F.col("x")
    assert values(spark, T.kind_named(x), ["Hôtel particulier", "Vente terrain et villa", "Bel appartement T3", "rien", None, "Fonds de commerce"]) == ["Maison", "Terrain", "Appartement", None, None, "Commerce"]
    assert values(spark, T.number(x), ["9,500,000 €", "1.900.000", "1.900,50", "85,5", "2,666", "12.5", "abc", None, "-3"]) == [9500000.0, 1900000.0, 1900.5, 85.5, 2666.0, 12.5, None, None, -3.0]
    assert values(spark, T.surface(x), ["100 m²", "1,076 sq ft", "2 ha", "1 acre", "50 - 80 m²", None]) == [100.0, 100.0, 20000.0, 4047.0, None, None]
    assert values(spark, T.first_count(x), ["3 chambres", "0", "aucune", None]) == [3, None, None, None]
    assert values(spark, T.living_area(x), ["Villa de 160 m² habitables sur 1 200 m²", "surface habitable de 85,5 m2", "surface habitable : 1 200 m²", "5 m² habitables", None]) == [160.0, 85.5, 1200.0, None, None]
    assert values(spark, T.licence_only(x, F.lit(None).cast("double")), ["Licence IV à vendre", "Vend licence", None]) == [True, False, False]
    assert values(spark, T.programme_page(x), ["https://a.fr/programmes/1", "https://a.fr/x-programme", None]) == [True, False, False]
    assert values(spark, T.placed_abroad(x), ["Villa à Phuket, Thaïlande", "Saint-Tropez", None]) == ["phuket", None, None]
    assert values(spark, T.has_feature(x, "pool"), ["Belle PISCINE", "non", None]) == [True, False, False]


def test_names_titles_sites(spark):
    x = F.col("x")
    assert values(spark, T.agency_form(x), ["BARNES Saint-Tropez", "Barnes St Tropez SARL", "A & B"]) == ["barnes saint tropez", "barnes saint tropez", "a and b"]
    title = T.display_title(x, F.lit("Maison"), F.lit(120.4), F.lit("Grimaud"))
    assert values(spark, title, ["Villa vue mer", "Vente Maison 5 pièces", "", "5 pièces 120 m² 3 p 100 m²"]) == ["Villa vue mer"] + ["Maison · 120 m² — Grimaud"] * 3
    assert values(spark, T.site_key(x, {"b.example.fr": "own"}), ["https://www.a.example.co.uk/x", "http://B.example.fr/", "http://x.example.fr", "not a url", None]) == ["example", "own", "example", None, None]
    attributes, flags = T.characteristics(x)
    got = values(spark, F.struct(attributes.alias("a"), flags.alias("f")), [["Vue : mer", "Alarme :", "Piscine", "Vue : mer", "Vue : port", " "]], "array<string>")[0]
    assert got.a == {"Vue": "port"} and got.f == ["Alarme", "Piscine"]
    assert values(spark, T.money(x), [9_500_000.0, 2_000_000.0, 1_250_000.0, 950_000.0, 1_999.0], "double") == ["9.5 M€", "2 M€", "1.25 M€", "950 k€", "2 k€"]
    assert values(spark, T.money(x), [1_999_999.0, 3e6], "double") == ["2.0 M€", "3 M€"]
    assert values(spark, T.percent(x), [0.25, 0.1234, 1.0], "double") == ["25 %", "12.3 %", "100 %"]
    assert values(spark, T.block_page(x), ["<p>Captcha</p>", "fine", None]) == ["captcha", None, None]


def test_garbled_text(spark):
    bad = "é".encode().decode("cp1252") + "t" + "é".encode().decode("latin1")
    texts = [bad, "été", None, "’".encode().decode("cp1252"), "Ã "]
    assert values(spark, T.has_mojibake(F.col("x")), texts) == [True, False, False, True, False]
    assert values(spark, T.repair_mojibake(F.col("x")), texts) == ["été", "été", None, "’", "à"]
    odd = ["É’", "Ãx", "ð\x9f\x98\x80", "Å’uvre", "â€x", "Ã\x8d plus", "ÂÃ©"]
    assert [T.repaired(t) for t in odd] == ["É’", "Ãx", "😀", "Œuvre", "â€x", "Í plus", "Âé"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + ["â€x"])], "i int, x string")
    assert [r.x for r in T.with_repaired(df, "x").orderBy("i").collect()] == ["été", "été", None, "’", "Ã ", "â€x"]
    assert [r.i for r in T.beyond_repair(df, "x").collect()] == [5]


def test_dates(spark):
    df = spark.sql("SELECT timestamp'2026-01-15 23:30:00' AS t, timestamp'2026-01-10 00:00:00' AS s")
    row = df.select(
        dates.days_between(F.col("s"), F.col("t")), dates.days_between(F.col("t"), F.col("s")), dates.hour_in("Europe/Paris", F.col("t")), dates.inside_window("Europe/Paris", 22, 6, F.col("t")),
        dates.stamp_in("Europe/Paris", F.col("t")), dates.period_start(F.col("t"), 20).cast("string"), dates.age_label(F.lit(125.0)), dates.age_label(F.lit(90.0)),
        dates.day_slice(F.array(*map(F.lit, "abcde")), 2, F.col("t")),
    ).first()
    assert tuple(row) == (5, 0, 0, True, "2026-01-16 00:30:00", "2025-12-20", "2 h", "90 min", ["d", "e"])


def test_readers(spark):
    page = '<script type="application/ld+json">[{"@type":"A","url":"u"},{"@graph":[{"@type":["B","C"],"offers":[]}]}]</script>'
    df = spark.createDataFrame([(1, page), (2, "<script type=application/ld+json>{bad</script>"), (3, None)], "id int, body string")
    nodes = readers.json_ld_nodes(df)
    assert nodes.where(readers.has_type(F.col("node"), "C")).count() == 1
    assert readers.primary_nodes(nodes, "id").select("id", F.try_variant_get("node", '$["@type"][0]', "string").alias("t")).collect() == [(1, "B")]
    xml = "<urlset><url><loc> http://a/?x=1&amp;y </loc><lastmod>2024-01-02</lastmod></url><url><loc>http://b</loc></url></urlset>"
    maps = spark.createDataFrame([("m", xml), ("bare", "<loc>http://c</loc>"), ("none", "")], "url string, body string")
    assert sorted(map(tuple, readers.sitemap_entries(maps).collect()), key=str) == [("bare", "http://c", None), ("m", "http://a/?x=1&y", "2024-01-02"), ("m", "http://b", None)]
    assert readers.lastmod_verdict(readers.sitemap_entries(maps), "2024-03-01").first()["verdict"] == "one date"
    html = spark.createDataFrame([(1, "<div><span>Area :</span><b class='v'>12 m&sup2;</b><script>x<b</script><a href='/q'></a></div>")], "id int, body string")
    elements = readers.html_elements(html, "id")
    assert readers.labelled(elements, "id", "area").collect() == [(1, "12 m²")]
    assert readers.resolved_payload('[{"a":1,"b":2},[3],["Ref",3],"x"]') == {"a": ["x"], "b": "x"}
    twice = '[{"a":1,"b":1,"c":2},[3,3,3],{"up":0,"s":3},["Map",4],"x"]'
    assert readers.resolved_payload(twice) == {"a": ["x"] * 3, "b": ["x"] * 3, "c": {"up": None, "s": "x"}}
    deep = [[i + 1, i + 1] for i in range(40)] + ["end"]  # 2 ** 40 ways to the end
    assert str(readers.resolved_payload(json.dumps(deep[:12] + ["end"]))).count("end") == 2**12 and readers.resolved_payload(json.dumps(deep)) is not None
    assert values(spark, readers.canonical_json(F.col("x")), ['{"b": 1, "a": [2]}', "bad", None]) == ['{"a":[2],"b":1}', None, None]
    links = spark.createDataFrame([(1, 'x data-o="aHR0cHM6Ly9hL2I=" data-o="aHR0cHM6Ly9hL2I=" data-o="Yg=="')], "id int, body string")
    assert readers.encoded_links(links, "id").collect() == [(1, "https://a/b")]
    assert values(spark, readers.slug_matches(F.col("x"), ["la-mole"]), ["/annonces/la-mole-83", "/xla-mole", None]) == [True, False, False]
    assert readers.ranges("2020", "2021", {"2021": 10000, "2021-05": 10000})[0] == ("2020-01-01", "2021-01-01", False)
    records = spark.createDataFrame([(1, [("a", "9")]), (2, None)], "id int, refs array<struct<type:string,id:string>>")
    included = spark.createDataFrame([("a", "9", "nine")], "type string, id string, attributes string")
    got = {r.id: r.parts for r in readers.with_includes(records, included, "refs", "parts").collect()}
    assert got[1][0].attributes == "nine" and got[2] is None


def test_snapshots(spark, tmp_path):
    rows = [("s", "1", "2024-01-01 00:00:00", "old"), ("s", "1", "2024-01-02 00:00:00", "new"), ("t", "1", "2024-01-01 00:00:00", "x")]
    df = spark.createDataFrame(rows, "source string, id string, t string, body string").select("source", "id", F.col("t").cast("timestamp").alias("fetched_at"), "body")
    readers.write_snapshots(df, str(tmp_path / "s"))
    assert sorted(r.body for r in readers.latest_snapshots(spark, str(tmp_path / "s")).collect()) == ["new", "x"]
    (tmp_path / "p.html").write_text("<p>\nx</p>")
    assert readers.pages_at(spark, str(tmp_path / "p.html")).first().body == "<p>\nx</p>"
