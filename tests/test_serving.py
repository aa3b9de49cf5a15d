import datetime
import random

from pyspark.sql import functions as F

from marlstone.operators import health, serving, similar


def frames(spark):
    t = lambda d: datetime.datetime(2026, 1, d)
    p = spark.createDataFrame([(1, "active", "p", t(1), "a"), (2, "active", "p", t(1), "a"), (3, "active", "q", t(3), None), (4, "gone", "p", t(4), "b"), (5, "active", None, t(5), "b")], "id int, status string, place string, first_listed timestamp, agency string")
    lines = spark.createDataFrame([(1, 10, "active", 5.0), (1, 11, "active", 6.0), (2, 10, "active", 5.0), (2, 12, "active", 5.0), (3, 12, "active", 1.0), (4, 10, "active", 1.0), (5, 10, "active", 1.0)], "id int, source int, status string, price double")
    s = spark.createDataFrame([(10, "ten", True), (11, "eleven", False), (12, "twelve", True)], "source int, name string, enabled boolean")
    return p, lines, s


def test_pages_and_details(spark):
    p, lines, s = frames(spark)
    live = serving.live(p, lines, s, ["p", "q"], [10, 11])
    assert sorted(r.id for r in live.collect()) == [1, 2]
    assert serving.live(p, lines, s, [], [10]).count() == 0 == serving.live(p, lines, s, ["p"], []).count()
    page = serving.property_page(live, serving.shown_listings(lines, s, [10, 11]), 1, 0).collect()
    assert [(r.id, r.total, r.total_listings) for r in page] == [(2, 2, 2)]  # of one date the larger id
    events = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y"), (1, 2, "c", "z")], "id int, at int, event string, type string")
    (one,) = serving.details(p.where("id = 1"), lines, events, live, 2).collect()
    assert [x.source for x in one.listings] == [10, 11] and [x.event for x in one.history] == ["c", "b"] and one.agency_active == 2
    (none,) = serving.details(p.where("id = 3"), lines, events, live, 2).collect()
    assert none.history is None and none.agency_active is None


def test_chips_and_outcomes(spark):
    rows = spark.createDataFrame([(1, 7, "x", None, 1), (2, 7, "x", None, 2), (3, 7, "y", "agg", 3), (4, 7, "x", "agg", 9)], "row int, id int, source string, via string, last_seen int")
    assert [[tuple(c) for c in r.chips] for r in serving.chips(rows).collect()] == [[("", "x"), ("", "x"), ("agg", "y")]]
    s = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("g", True), ("h", True)], "source string, enabled boolean")
    runs = spark.createDataFrame([(1, "a", 5, "done", None), (2, "a", 6, "done", "x"), (3, "g", 4, "partial", "x"), (4, "h", 8, "done", None), (5, "a", None, "running", None)], "run int, source string, completed_at int, status string, error string")
    carried = spark.createDataFrame([("g", "a"), ("g", "z"), ("h", "z")], "source string, key string")
    got = {(r.key, r.last_run, r.outcome, r.via) for r in serving.outcomes(s, runs, carried, ["g", "h"]).collect()}
    assert got == {("a", 6, "error", None), ("b", None, "never", None), ("z", 8, "done", "h")}
    assert serving.last_good_run(runs).first().last_good == 8


def test_overview_waits_for_a_window(spark):
    p, lines, s = frames(spark)
    buyers = spark.createDataFrame([(1, False), (2, True)], "buyer int, is_test boolean")
    matches = spark.createDataFrame([(1, 1, "new"), (1, 9, "new"), (2, 1, "seen"), (1, 2, "sent")], "buyer int, property int, status string")
    live = serving.live(p, lines, s, ["p"], [10])
    at = lambda day: F.lit(f"2026-01-{day:02}").cast("timestamp")
    assert tuple(serving.overview(p, live, buyers, matches, at(6)).first()) == (2, None, 1, 1, 1)
    assert tuple(serving.overview(p, live, buyers, matches, at(20)).first()) == (2, 0, 1, 1, 1)


def test_hidden_duplicates(spark):
    rows = [
        (1, "p", 100000.0, 100.0, 3, 2, 1, None, "Maison", None), (2, "p", 100900.0, 101.0, 4, 1, 1, None, None, None), (3, "p", 102000.0, 100.0, 3, 1, 1, None, "Maison", None),
        (4, "q", 100000.0, 100.0, 3, 1, 1, None, "Maison", None), (5, "p", None, None, None, 1, 1, "u", None, None), (6, "p", None, None, None, 1, 2, "u", None, None), (7, "p", 100000.0, 100.0, 3, 1, 1, None, "studio", None),
        (8, "p", 0.0, 10.0, None, 1, 1, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, place string, price double, area double, bedrooms int, source_count int, first_listed int, image string, kind string, title string")
    assert sorted(r.id for r in serving.hidden_duplicates(df).collect()) == [2, 6, 7]


def test_agencies_and_prices(spark):
    stored = spark.createDataFrame([(1, "Barnes St Tropez", "1", "", None, "5")], "agency int, name string, postcode string, address string, city string, phone string")
    seen = spark.createDataFrame([(1, " BARNES Saint-Tropez SARL", "1", "a", "c", "9"), (2, "New", None, None, None, None), (3, "NEW", " ", "b", None, None), (4, "SARL", "1", None, None, None), (5, None, "1", None, None, None)], "row int, name string, postcode string, address string, city string, phone string")
    agencies, which = serving.resolved_agencies(stored, seen)
    got = {r.name: (r.postcode, r.address, r.city, r.phone) for r in agencies.collect()}
    assert got == {"Barnes St Tropez": ("1", "a", "c", "5"), "New": (None, "b", None, None)}
    rows = {r.row: r.agency for r in which.collect()}
    assert set(rows) == {1, 2, 3} and rows[1] == "1" and rows[2] == rows[3]
    one = lambda *a: spark.range(1).select(serving.euro_price(*(x if isinstance(x, F.Column) else F.lit(x) for x in a)).alias("r")).first().r
    assert tuple(one("eur", 99.6, True, "USD", 5.0, None)) == (100.0, "offer") and tuple(one("EUR", 99.6, False, "EUR", 5.0, None)) == (5.0, "shown")
    assert tuple(one("USD", 1.0, True, "USD", 5.0, "2 350 000 €")) == (2350000.0, "line") and one("USD", 1.0, True, "USD", 5.0, "$ 5") is None and one(None, None, None, "EUR", None, "5 €") is None


def test_feed_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    checks = lambda *a: {x.check: x.status for x in one(health.feed_checks(*a))}
    days = lambda *n: F.array(*map(F.lit, n))
    assert checks(F.lit(1000), F.lit(60.0), days(1000), F.lit(20), days(5, 6)) == {"sync": "green", "delisted": "green"}
    assert checks(F.lit(500), F.lit(60.0), days(1000), F.lit(40), days(5, 6)) == {"sync": "red", "delisted": "red"}
    assert checks(F.lit(1000), F.lit(1700.0), days(1000), F.lit(40), days(5, 6)) == {"sync": "amber", "delisted": "amber"}
    assert tuple(one(health.portals_changed(days("a", "b"), F.lit(None).cast("array<string>")))) == ("green", [], [])
    assert tuple(one(health.portals_changed(days("a", "b"), days("b", "c")))) == ("red", ["a"], ["c"])
    assert tuple(one(health.stale_share(F.lit(9), F.lit(25), F.lit(9), F.lit(False)))) == ("red", "green")
    runs = spark.createDataFrame([("a", "error", 10.0), ("b", "done", 10.0), ("c", "done", None)], "source string, outcome string, age double")
    assert {r.source: r.status for r in health.run_checks(runs).collect()} == {"a": "red", "b": "green", "c": "red"}


def test_similar_pairs_are_all_pairs(spark):
    r = random.Random(3)
    base = [r.sample(range(300), r.randint(1, 60)) for _ in range(25)]
    sets = [sorted({*r.sample(b, r.randint(max(1, len(b) * 2 // 3), len(b))), *r.sample(range(320), r.randint(0, 8))}) for b in base for _ in range(4)] + [[], base[0], base[0]]
    df = spark.createDataFrame(list(enumerate(sets)) + [(999, None)], "id int, s array<long>")
    for least, contained in ((0.3, False), (0.5, True), (0.8, False)):
        want = {}
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i < j and a and b:
                    both = len({*a} & {*b})
                    x = both / (min(len({*a}), len({*b})) if contained else len({*a} | {*b}))
                    if x >= least:
                        want[i, j] = round(x, 9)
        got = {(x.a, x.b): round(x.similarity, 9) for x in similar.similar_pairs(df, least, contained).collect()}
        assert got == want and len(want) > 5


def test_search_answers(spark):
    from marlstone.sources import adapters

    body = '{"total":4,"ads":[{"id":1,"city":"p","price":5.0,"seen":1},{"id":2,"city":"q","price":null,"seen":1}]}'
    again = '{"total":4,"ads":[{"id":1,"city":"p","price":5.0,"seen":2}]}'
    df = spark.createDataFrame([("s", "p", 0, body), ("s", "p", 1, again), ("s", "r", 0, "{bad"), ("s", "t", 0, None)], "source string, place string, page int, body string")
    records = adapters.search_records(df, "ads", "total", "id long, city string, price double, seen int")
    got = adapters.search_listings(records, {"title": F.col("r.city"), "price": F.col("r.price")}, F.col("r.id"), F.col("r.city") == F.col("place"), ["seen"]).collect()
    assert [(g.key, g.f.price, g.result.status, g.result.missing) for g in got] == [("1", 5.0, "partial", ["area", "agency"])]
    hashes = records.where("r.id = 1").select(adapters.readers.stable_hash(F.col("r"), ["seen"]).alias("h")).distinct()
    assert hashes.count() == 1  # a view counter is no change
    assert {r.place: (r.read, r.complete) for r in adapters.search_completeness(records).collect()} == {"p": (3, False), "r": (0, True), "t": (0, True)}
    assert adapters.search_completeness(records, 1).where("place = 'p'").first().complete


def test_pages_as_listings(spark):
    from marlstone.sources import adapters

    ld = '<script type="application/ld+json">{"@type":"Product","name":"Villa","offers":{"price":"1,500,000","priceCurrency":"%s"}}</script><dl><dt>Surface :</dt><dd>120 m²</dd></dl>'
    df = spark.createDataFrame([(1, "u", ld % "EUR"), (2, "u", ld % "USD"), (3, "u", "<title>Studio</title>"), (4, "u", "<p>x</p>"), (5, "u", None)], "key int, url string, body string")
    got = {g.key: (g.f.title, g.f.price, g.f.area, g.f.kind, g.result.status) for g in adapters.page_listings(df, {"area": "surface"}).collect()}
    assert got == {1: ("Villa", 1500000.0, 120.0, "Maison", "partial"), 2: ("Villa", None, 120.0, "Maison", "partial"), 3: ("Studio", None, None, "Appartement", "partial"), 4: (None, None, None, None, "failed"), 5: (None, None, None, None, "failed")}
