import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import buyers, cdc, health, resolution
from marlstone.operators.latest import upper_middle, worst
from marlstone.operators.scope import decode_cursor, free_text, sane, within
from marlstone.streaming import windows

SCHEMA = "id string, source string, place string, price double, area double, land double, rooms int, kind string, agency string, ref string, title string, description string"


def corpus(seed=42, n=160):
    r = random.Random(seed)
    prose = [" ".join(r.choices(["villa", "mer", "jardin", "vue", "calme", "piscine", "terrasse", "garage", "chambre", "salon"], k=30)) for _ in range(5)]
    pick = lambda *xs: r.choice(xs)
    return [
        (f"i{i:03}", pick("s1", "s2"), pick("p1", "p1", "p2", None), pick(1e6, 2e6, 3e6, None), pick(100.0, 102.0, 130.0, None), pick(1000.0, 1100.0, None), pick(4, 5, None),
         pick("Maison", "Appartement", "Terrain", None), pick("a1", "a2", None), pick("ref1", "ref2", "xx", "2024-01-01", None), None, pick(*prose, None))
        for i in range(n)
    ]


def test_blocking_loses_nothing(spark):
    rows = spark.createDataFrame(corpus(), SCHEMA)
    ready = resolution.prepared(rows).cache()
    pairs = resolution.candidate_pairs(ready)
    every = rows.select(F.col("id").alias("a"), "place").crossJoin(rows.select(F.col("id").alias("b"), F.col("place").alias("q"))).where("a < b AND coalesce(place = q, true)").select("a", "b")
    same = lambda p: {(r.a, r.b) for r in resolution.score_pairs(p, ready).where("same").collect()}
    assert same(pairs) == same(every) == same(resolution.acceptable_pairs(ready)) != set()
    assert resolution.acceptable_pairs(ready).count() < pairs.count()
    assert pairs.count() == pairs.distinct().count() < every.count()


BASE = ("a", "s1", "p", 1e6, 200.0, 1000.0, 5, "Maison", "ag", None, "Belle villa", " ".join(f"mot{chr(97 + i)}{chr(98 + i)} suite" for i in range(20)))


@pytest.mark.parametrize(
    "change,want",
    [
        ({}, (True, "text")),
        ({"place": "q"}, (False, "place")),
        ({"price": 2e6}, (False, "price")),
        ({"area": 300.0}, (False, "area")),
        ({"area": 230.0}, (True, "text")),
        ({"description": "autre chose", "area": 204.0}, (True, "structure")),
        ({"description": "autre chose", "land": 5000.0}, (False, "none")),
        ({"description": "autre chose", "price": None}, (False, "none")),
        ({"ref": "m1", "price": 3e6}, (False, "price")),
        ({"description": None, "price": None}, (False, "none")),
    ],
)
def test_pair_score(spark, change, want):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    other = dict(zip(names, BASE)) | {"id": "b", "source": "s2"} | change
    ready = resolution.prepared(spark.createDataFrame([BASE, tuple(other[n] for n in names)], SCHEMA))
    row = resolution.score_pairs(spark.createDataFrame([("a", "b")], "a string, b string"), ready).first()
    assert (row.same, row.reason) == want
    if change.get("description", "") is None:
        assert row.confidence == 0.0  # too short to tell, however alike


def test_equal_short_texts_are_no_evidence(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    make = lambda i, **change: tuple((dict(zip(names, BASE)) | {"id": i, "description": "même texte", "price": None, "area": None, **change})[n] for n in names)
    ready = resolution.prepared(spark.createDataFrame([make("a"), make("b", source="s2"), make("c", description=BASE[-1][:140])], SCHEMA))
    got = {(r.a, r.b): (r.same, r.confidence, r.reason) for r in resolution.score_pairs(spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string"), ready).collect()}
    assert got == {("a", "b"): (False, 0.0, "none"), ("a", "c"): (False, 0.0, "none")}


def test_references_decide(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    make = lambda i, ref: tuple((dict(zip(names, BASE)) | {"id": i, "ref": ref, "price": float(hash(i) % 7)})[n] for n in names)
    ready = resolution.prepared(spark.createDataFrame([make("a", " M12 "), make("b", "m12"), make("c", "m13")], SCHEMA))
    got = {(r.a, r.b): (r.same, r.confidence, r.reason) for r in resolution.score_pairs(spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string"), ready).collect()}
    assert got == {("a", "b"): (True, 1.0, "ref"), ("a", "c"): (False, 0.0, "ref_conflict")}


MEMBER = "part string, id string, price double, area double, land double, kind string, flat boolean"


def leavers(spark, rows):
    return {r.id for r in resolution.with_leavers(spark.createDataFrame(rows, MEMBER)).where("leaves").collect()}


def test_guards(spark):
    row = lambda part, i, price=None, area=None, land=None, kind="Maison", flat=False: (part, f"{part}{i}", price, area, land, kind, flat)
    rows = [row("p", 1, 100.0), row("p", 2, 101.0), row("p", 3, 200.0), row("p", 4)]
    rows += [row("q", i, area=a, land=x) for i, a, x in ((1, 100.0, 100.0), (2, 109.0, 300.0), (3, 119.0, 900.0))]  # plots disagree: 10 %
    rows += [row("c", i, area=a) for i, a in ((1, 100.0), (2, 115.0), (3, 130.0))]  # a chain of 30 %, none beyond 20 % of the middle
    rows += [row("f", i, area=a, flat=True) for i, a in ((1, 100.0), (2, 101.0), (3, 108.0))]
    rows += [row("a", 1, 1.0, 100.0), row("a", 2, 1.0, 150.0), row("a", 3, 1.0, 101.0), row("b", 1, 5.0, 10.0), row("b", 2, 9.0, 90.0)]
    rows += [row("w", i, price=v) for i, v in enumerate((100.0, 120.0, 150.0, 154.0))]  # none beyond 35 % of 150, the span is: cut at the widest step
    assert leavers(spark, rows) == {"p3", "q3", "f3", "a2", "b1", *widest_step([100.0, 120.0, 150.0, 154.0], "w")}


def widest_step(values, part):
    """The side of the widest relative step that the upper middle isn't on; by the rule in words."""
    middle = sorted(values)[len(values) // 2]
    if any(abs(v - middle) / max(v, middle) > 0.35 for v in values) or (max(values) - min(values)) / max(values) <= 0.35:
        return {f"{part}{i}" for i, v in enumerate(values) if abs(v - middle) / max(v, middle) > 0.35}
    k = max(range(1, len(values)), key=lambda i: (values[i] - values[i - 1]) / values[i])
    return {f"{part}{i}" for i in range(len(values)) if (i < k) == (middle >= values[k])}


def test_parts_are_cut_until_nothing_leaves(spark):
    rows = [("x", i, p, 100.0, None, "Maison", False) for i, p in (("a", 1.0), ("b", 9.0), ("c", 1.0), ("d", 9.0), ("e", 1.0), ("f", 40.0))]
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("d", "f"), ("c", "e")], "a string, b string")
    got = {}
    for r in resolution.coherent_parts(spark.createDataFrame(rows, MEMBER), edges).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    # 9 is the upper middle, so 1 and 40 leave; a, c and e stay together by their edges
    assert sorted(map(sorted, got.values())) == [["a", "c", "e"], ["b", "d"], ["f"]]


def test_clusters_and_survivors(spark):
    rows = spark.createDataFrame(corpus(7), SCHEMA)
    ready = resolution.prepared(rows).cache()
    scored = resolution.score_pairs(resolution.candidate_pairs(ready), ready).cache()
    got = resolution.clusters(ready, scored).toPandas()
    assert len(got) == 160 and (got.cluster <= got.id).all()
    parts = spark.createDataFrame(got[["id", "cluster"]]).withColumnRenamed("cluster", "part").join(ready, "id")
    assert resolution.with_leavers(parts).where("leaves").count() == 0
    edges = {(r.a, r.b) for r in scored.where("same AND confidence >= 0.8").collect()}
    name = dict(zip(got.id, got.cluster))
    assert len(edges) > 100 and sum(name[a] == name[b] for a, b in edges) > 0.5 * len(edges)
    at = F.lit("2024-01-01").cast("timestamp")
    best = resolution.survivors(rows.join(spark.createDataFrame(got[["id", "cluster"]]), "id").withColumns({"first_seen": at, "last_seen": at}))
    assert best.count() == got.cluster.nunique()
    image, gallery = resolution.cover(F.lit("b"), F.array(*map(F.lit, ["a", "", "b", "a"])))
    assert tuple(spark.range(1).select(image, gallery).first()) == ("b", ["a", "b"])


def test_buyers(spark):
    columns = "buyer int, budget_min double, budget_max double, places array<string>, bedrooms_min int, area_min double, land_min double, kinds array<string>, must_have array<string>, nice_to_have array<string>"
    who = spark.createDataFrame([(1, 1e6, 2e6, ["p"], 4, 200.0, 900.0, ["maison"], ["pool"], ["garden", "garage"]), (2, None, None, [], None, None, None, [], [], [])], columns)
    what = spark.createDataFrame(
        [(1, 1.5e6, "p", 4, 200.0, 1000.0, "Maison", "piscine et jardin"), (2, 2.1e6, "p", 3, 180.0, None, "Maison", ""), (3, 5e6, "p", 4, 200.0, None, "Maison", ""), (4, None, None, None, None, None, None, None), (5, 1.5e6, "q", 1, 50.0, 1.0, "Terrain", "")],
        "entity int, price double, place string, bedrooms int, area double, land double, kind string, text string",
    )
    got = {(r.buyer, r.entity): r for r in buyers.score_pairs(who.crossJoin(what)).collect()}
    assert {k: r.score for k, r in got.items()} == {(1, 1): 96, (1, 2): 61, (1, 3): 0, (1, 4): 0, (1, 5): 0} | {(2, e): 0 for e in range(1, 6)}
    assert [k for k, r in got.items() if r.matched] == [(1, 1)] and set(got[1, 1].asDict()) == {*who.columns, *what.columns, "score", "matched", "reasons"}
    found = {r.field: (r.ok, r.code, r.have, r.want, r.disqualifying) for r in got[1, 2].reasons}
    assert found == {
        "budget": (False, "over", 2.1e6, 2e6, False), "place": (True, "listed", None, None, False), "bedrooms": (False, "one short", 3.0, 4.0, False), "area": (False, "too little", 180.0, 200.0, False),
        "land": (None, "unknown", None, 900.0, False), "kind": (True, "wanted", None, None, False), "pool": (False, "not mentioned", None, None, False),
    }
    assert [(r.field, r.code, r.disqualifying) for r in got[1, 3].reasons][:1] == [("budget", "far over", True)] and got[2, 1].reasons == []
    for most in (100, 0):
        (one,) = buyers.with_reasons(buyers.matches(who, what, most)).collect()
        assert (one.buyer, one.entity, one.score) == (1, 1, 96) and one.reasons == got[1, 1].reasons


def test_matches_are_all_pairs_that_match_at_every_size(spark, monkeypatch):
    columns = "buyer int, budget_min double, budget_max double, places array<string>, bedrooms_min int, area_min double, land_min double, kinds array<string>, must_have array<string>, nice_to_have array<string>"
    r = random.Random(5)
    some = lambda *xs: r.choice(xs)
    who = spark.createDataFrame(
        [(i, some(None, 0.0, 1e6, 1.4e6), some(None, 1.2e6, 2e6, 9e6), some([], ["p"], ["p", "p", "q"]), some(None, 3, 4), some(None, 100.0, 200.0), None, some([], ["Maison"], ["villa", "FLAT"]), [], some([], ["garden"], ["garden", "garden", "big_door"])) for i in range(80)],
        columns,
    )
    what = spark.createDataFrame(
        [(j, some(None, 0.0, 0.5, 7e5, 1e6, 1.5e6, 2.2e6, 2.21e6, 5e6), some("p", "q", None), some(2, 3, 4, None), some(90.0, 170.0, 250.0, None), None, some("maison", "Flat", None), some("jardin", "a BIG door", "", None)) for j in range(120)],
        "entity int, price double, place string, bedrooms int, area double, land double, kind string, text string",
    )
    rows = lambda df: sorted(map(tuple, df.select("buyer", "entity", "score").collect()))
    want = rows(buyers.score_pairs(who.crossJoin(what)).where("matched"))
    assert 200 < len(want) < 80 * 120 and rows(buyers.matches(who, what)) == rows(buyers.matches(who, what, 0)) == want
    monkeypatch.setattr(buyers, "MOST_WISHES", 1)
    assert rows(buyers.matches(who, what)) == want
    assert rows(buyers.matches(who.limit(0), what)) == rows(buyers.matches(who, what.limit(0), 0)) == []


def test_reused_ids_equal_taking_in_turn(spark):
    r = random.Random(8)
    rows = [(r.choice(["p", "q", None]), r.choice([*range(14), None]), i, r.choice([*"abcdefghi", None])) for i in range(150)]
    got = {(g.place, g.cluster): g.entity for g in resolution.reused_ids(spark.createDataFrame(rows, "place string, cluster int, id int, entity string")).collect()}
    want, taken = {}, set()
    members = {k: [x for x in rows if x[:2] == k] for k in {x[:2] for x in rows} if k[1] is not None}
    for k in sorted(members, key=lambda k: (-len(members[k]), k[1])):
        want[k] = next((x[3] for x in members[k] if x[3] and (k[0], x[3]) not in taken), None)
        taken.add((k[0], want[k]))
    assert got == want and None in want.values()


def test_plans_read_whole_tables(spark, tmp_path):
    from marlstone.plans import changes, entities

    rows = spark.range(1, 1202).selectExpr(
        "id AS o_orderkey", "CASE WHEN id > 400 THEN id + 1000000 ELSE id END AS o_custkey", "timestamp_seconds(id) AS o_orderdate", "CASE WHEN id > 400 THEN 'late' ELSE 'early' END AS o_orderpriority"
    )
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    assert {r.place for r in entities.stable_ids(spark, str(tmp_path)).collect()} == {"early", "late"}
    assert changes.newest_until_known(spark, str(tmp_path)).count() == 1201


def test_verdicts(spark):
    one = lambda v: tuple(spark.range(1).select(v.alias("v")).select("v.*").first())[::2]
    days = lambda *n: F.array(*map(F.lit, n))
    assert one(health.volume(F.lit(50), days(100, 100, 100))) == ("red", "50 against 100")
    assert one(health.volume(F.lit(70), days(100, 100, 100)))[0] == "amber" and one(health.volume(F.lit(1), days(1, 2)))[0] == "unknown"
    assert one(health.volume(F.lit(0), days(3, 3, 3))) == ("amber", "0 against 3")
    assert one(health.share(F.lit(5), F.lit(20), F.lit(0.1))) == ("amber", "missing: 5/20 = 25 %")
    assert one(health.fresh(F.lit(None).cast("double"), 60, 120, "run")) == ("red", "run: none yet")
    assert one(health.drop_vs_previous(F.lit(1500), F.lit(2000), 0.2, 0.1, "rows")) == ("red", "rows: 1,500, before 2,000 (-25 %)")
    assert one(health.threshold(F.lit(3), 1, 5, "jumps")) == ("amber", "jumps: 3")
    assert one(health.meter(F.lit(96), F.lit(100)))[0] == "red"
    df = spark.createDataFrame([("green",), ("red",), ("amber",)], "s string")
    assert df.agg(worst(F.col("s"))).first()[0] == "red" and df.limit(0).agg(worst(F.col("s"))).first()[0] == "unknown"
    assert spark.range(1).select(upper_middle(F.array(*map(F.lit, [4, 1, 3, 2])))).first()[0] == 3
    assert spark.range(1).select(health.bedrooms_from_labels(F.array(F.lit("Pièces 5"), F.lit("3 chambres")))).first()[0] == 3


def test_scope_and_cdc(spark):
    df = spark.createDataFrame([("a", 1.0), ("50%_x", float("nan")), (None, -1.0)], "s string, v double")
    assert df.where(within(F.col("s"), [])).count() == 0 and df.where(~within(F.col("s"), ["a"])).count() == 2
    assert [r.s for r in df.where(free_text("0%_", F.col("s"))).collect()] == ["50%_x"]
    assert [r[0] for r in df.select(sane(F.col("v"), 10)).collect()] == [1.0, None, None]
    assert spark.range(1).select(decode_cursor(F.lit("!!"))).first()[0] is None
    plain = lambda c: spark.range(1).select(c).first()[0]
    assert plain(cdc.should_abort(F.lit(9), F.lit(20))) and not plain(cdc.should_abort(F.lit(0), F.lit(19)))
    assert plain(cdc.trust_gone(F.lit(10), F.lit(10))) and not plain(cdc.trust_gone(F.lit(20), F.lit(19)))
    assert plain(cdc.run_status(F.lit(True), F.lit(False))) == "partial"
    places = spark.createDataFrame([("p",), ("q",)], "place string")
    runs = spark.createDataFrame([(["p"], "done", None, 5), (["q"], "error", "x", 9)], "places array<string>, status string, error string, finished_at int")
    assert [r.place for r in cdc.stalest(places, runs, 2).collect()] == ["q", "p"]
    gaps = cdc.coverage_gaps(spark.createDataFrame([("x",)], "portal string"), places, spark.createDataFrame([("x", "p")], "portal string, place string"))
    assert [(r.portal, r.place) for r in gaps.collect()] == [("x", "q")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, f"2024-01-01 00:00:{i:02}", i) for i in range(30)], "k int, t string, id int").select("k", F.col("t").cast("timestamp").alias("at"), "id")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windows.fixed_windows(stream, "k", "at", 10, "1 minute").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = sorted(map(tuple, windows.fixed_windows(rows, "k", "at", 10).collect()))
    assert sorted(map(tuple, spark.table("counts").collect())) == want and len(want) == 9
    for n in range(2):
        q = windows.append_changes(spark, stream, ["id"], str(tmp_path / "log"), str(tmp_path / f"check{n}"))
        q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 30
    for n in range(2):
        windows.append_changes(spark, stream, ["id", "k"], str(tmp_path / "by"), str(tmp_path / f"more{n}"), by="k").awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "by")).count() == 30 and (tmp_path / "by" / "k=1").exists()
    late = spark.createDataFrame([("u", "2024-01-01 00:01:05", 1), ("u", "2024-01-01 00:00:30", 2), ("u", "2024-01-01 00:01:10", 3)], "k string, t string, id int").select("k", F.col("t").cast("timestamp").alias("at"), "id")
    got = [(r.id, r.n, r.admitted) for r in windows.limited(late, "k", "at", "id", 60, 2).orderBy("id").collect()]
    assert got == [(1, 1, True), (2, 2, True), (3, 3, False)]
    marks = spark.createDataFrame([("p", "2024-01-02"), ("q", "2024-01-05")], "place string, m string").select("place", F.col("m").cast("date").alias("mark"))
    passes = spark.createDataFrame([("p", "2024-01-03", True), ("q", "2024-01-09", False), ("r", "2024-01-01", True)], "place string, s string, finished boolean").select("place", F.col("s").cast("date").alias("started_at"), "finished")
    assert sorted((r.place, str(r.mark)) for r in windows.advanced_marks(marks, passes).collect()) == [("p", "2024-01-03"), ("q", "2024-01-05"), ("r", "2024-01-01")]




def test_written_tables_can_be_removed(spark):
    from pathlib import Path

    from marlstone.operators.tables import removed, written

    df = written(spark.range(5))
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and removed(spark) >= 1 and not folder.exists()


def test_reading_ends_behind_a_run_of_known_ones(spark):
    r = random.Random(6)
    for run in (1, 2, 3, 50):
        rows = [(i * 10, r.random() < 0.5) for i in range(60)]
        want, streak = [], 0
        for at, known in rows:
            want.append(at)
            streak = streak + 1 if known else 0
            if streak == run:
                break
        df = spark.createDataFrame(r.sample(rows, 60), "at int, known boolean").repartition(4)
        assert sorted(x.at for x in windows.until_known(df, "at", "known", run).collect()) == want
    assert windows.until_known(df.limit(0), "at", "known", 2).count() == 0


def test_hot_keys_are_joined_where_they_are(spark, monkeypatch):
    from marlstone.operators import components, tables

    monkeypatch.setattr(tables, "HOT_ROWS", 5)
    r = random.Random(2)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 100 + r.randrange(i)) for i in range(1, 40)] + [(300 + i, 301 + i) for i in range(30)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: 0 for n in range(60)} | {n: 100 for n in range(100, 140)} | {n: 300 for n in range(300, 331)}
    rows = spark.createDataFrame([("hot", i) for i in range(20)] + [("cold", 1), ("none", 2)], "k string, v int")
    per = spark.createDataFrame([("hot", "x", 20), ("cold", "y", 1)], "k string, w string, n int")
    assert sorted(map(tuple, tables.joined_back(rows, per, "k", "n", 21).collect())) == [("cold", 1, "y")] + [("hot", i, "x") for i in range(20)]
