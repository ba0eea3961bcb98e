"""Operators against brute force and worked cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from milap.operators import geography, graph, matching, ranking, scoring, slabs
from milap.operators.slabs import near_pairs, points_inside
from milap.sources import cache, store


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"p{i % 40}", 27 + rng.random() * 0.01, 85 + rng.random() * 0.01) for i in range(150)]
    rows += [(200 + i, f"c{i % 3}", 27.005, 85.005) for i in range(12)] + [(300, "x", None, 85.0), (301, "x", float("nan"), 85.0), (302, None, 27.005, 85.005)]
    df = spark.createDataFrame(rows, "id long, place string, lat double, lng double")
    got = {tuple(r) for r in near_pairs(df, 0.05, id_col="id", lat_col="lat", lng_col="lng", apart_col="place", tile_deg=0.003).collect()}
    ok = [r for r in rows if r[2] is not None and r[2] == r[2] and r[1] is not None]
    want = {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[1] != b[1] and km(a[2], a[3], b[2], b[3]) <= 0.05}
    assert got == want and len(want) > 60
    assert {tuple(r) for r in near_pairs(df, 0.05, id_col="id", lat_col="lat", lng_col="lng", apart_col="place", most=10).collect()} == want


def test_points_inside(spark):
    rng = random.Random(6)
    pts = [(i, 27 + rng.random(), 85 + rng.random()) for i in range(300)]
    discs = [(j, 27 + rng.random(), 85 + rng.random(), 1 + 30 * rng.random()) for j in range(20)] + [(99, None, 85.0, 5.0), (98, 27.5, 85.5, -1.0)]
    p, r = spark.createDataFrame(pts, "id long, lat double, lng double"), spark.createDataFrame(discs, "rid long, clat double, clng double, rad double")
    got = sorted(map(tuple, points_inside(p, r, id_col="id", lat_col="lat", lng_col="lng", region_col="rid", centre_lat="clat", centre_lng="clng", radius_col="rad").collect()))
    assert got == sorted((i, j) for i, a, b in pts for j, c, d, q in discs if c is not None and q >= 0 and km(a, b, c, d) <= q)
    cut = points_inside(p, r, id_col="id", lat_col="lat", lng_col="lng", region_col="rid", centre_lat="clat", centre_lng="clng", radius_col="rad", slab_deg=1.0, tile_deg=1.0, most=15)
    assert sorted(map(tuple, cut.collect())) == got
    assert points_inside(p.limit(0), r, id_col="id", lat_col="lat", lng_col="lng", region_col="rid", centre_lat="clat", centre_lng="clng", radius_col="rad").count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (5, 5), (5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in graph.components(df, "a", "b").collect()} == {(n, find(n)) for n in list(root)}
    assert graph.components(df.limit(0), "a", "b").count() == 0


def listing(i, name, **kw):
    base = {"listing_index": i, "name": name, "phones": [], "mobiles": [], "emails": [], "websites": [], "social_links": (None, None, None, None), "latitude": None, "longitude": None, "confidence": 0.5, "source": "maps"}
    return tuple({**base, **kw}.values())


SCHEMA = "listing_index long, name string, phones array<string>, mobiles array<string>, emails array<string>, websites array<string>, social_links struct<facebook:string,tiktok:string,instagram:string,other:map<string,string>>, latitude double, longitude double, confidence double, source string"


def test_conflicts_and_merge(spark):
    rows = [
        listing(1, "Sunrise Cafe", phones=["01-4311600"], websites=["https://sunrise.example"], latitude=27.7, longitude=85.3), listing(2, "Sunrise Cafe Pvt Ltd", phones=["+977-1-4311600"], websites=["http://www.sunrise.example/x"], latitude=27.7, longitude=85.3001),
        listing(3, "Other", emails=["info@o.example"]), listing(4, "Another", emails=["info@o.example"]), listing(5, "Alone", phones=None, emails=None), listing(6, "Alone", phones=None, emails=None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    view = graph.contact_view(df)
    assert {(r.rep, r.copies) for r in view.collect()} >= {(5, 2)}
    got = {(r.a, r.b): r.type for r in graph.conflict_pairs(view).collect()}
    assert got == {(1, 2): "DUPLICATE_MAPS_LISTING", (3, 4): "SHARED_OFFICE"}
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, component long")
    m = {r.component: r for r in graph.merge_duplicates(df, members).collect()}
    assert m[1].survivor in (1, 2) and len(m[1].phones) == 2 and not m[1].suspected
    many = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "node long, component long")
    assert graph.merge_duplicates(df, many).first().suspected


def test_conflicts_of_a_crowd_are_all_pairs(spark):
    rows = [listing(i, f"Place {i}", phones=["01-4311600"] if i < 230 else [], emails=["info@o.example"] if i >= 220 else []) for i in range(240)]
    view = graph.contact_view(spark.createDataFrame(rows, SCHEMA))
    want = {(a, b) for a in range(240) for b in range(a + 1, 240) if b < 230 or a >= 220}
    for block in (200, 7):
        got = [(r.a, r.b) for r in graph.conflict_pairs(view, block).select("a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pair_cascade(spark):
    cols = "id long, name string, phone string, site string, address string"
    a = spark.createDataFrame([(1, "Om Samaj Dental", "01-4311600", None, "x"), (2, "Lone Peak Trekking Agency", None, None, "5 hill road"), (3, None, None, None, None)], cols)
    b = spark.createDataFrame([(7, "Other", "+977-1-4311600", "", ""), (8, "Lone Peak Trekking Agency", None, "", "5 hill road"), (9, "Lone Peak Trekking Agency", None, "n/a", None)], cols)
    v = lambda d: matching.evidence_view(d, "id", "name", "phone", "site", "address")
    assert {(r.a_id, r.b_id, r.method) for r in matching.pair_cascade(v(a), v(b)).collect()} == {(1, 7, "phone"), (2, 8, "name_address"), (2, 9, "name")}


def test_first_wins_is_not_transitive(spark):
    df = spark.createDataFrame([("x", 1, 0), ("x", 2, 1), ("x", 3, 2)], "k string, ord int, v int")
    kept = matching.first_wins(df, "k", "ord", lambda a, b: abs(a.v - b.v) <= 1)
    assert sorted(r.ord for r in kept.collect()) == [1, 3]


def test_locality(spark):
    loc = spark.createDataFrame([(1, "thayim", (27.0, 85.0), 5.0, ["badi-1"]), (2, "miyel", (28.0, 85.0), 5.0, []), (3, "nowhere", None, 1.0, None)], "locality_id long, canonical_name string, centroid struct<lat:double,lng:double>, max_radius_km double, aliases array<string>")
    rows = [(1, "A", "Thayim 3", "thayim", None, None), (2, "A", "Thayim Marg, Miyel", "thayim", None, None), (3, "A", "x", "thayim", 27.01, 85.0), (4, "A", "x", "thayim", 27.5, 85.0), (5, "A", None, "thayim", None, None), (6, "A", "x", "atlantis", 27.0, 85.0), (7, None, "Badi-1", "thayim", None, None), (8, "![map](", "(a", "thayim", None, None)]
    df = spark.createDataFrame(rows, "id long, title string, address string, requested string, lat double, lng double")
    got = {r.id: r.status for r in geography.requested_status(df, loc, id_col="id", title="title", address="address", requested="requested", lat="lat", lng="lng").collect()}
    assert got == {1: "inside", 2: "outside", 3: "inside", 4: "outside", 5: "ambiguous", 6: "ambiguous", 7: "inside", 8: "ambiguous"}


@pytest.mark.parametrize(("mode", "explicit", "eligible", "want"), [("production", None, 25, 10), ("benchmark", None, 25, 25), ("benchmark", None, 80, 50), ("production", 120, 25, 25), ("production", 0, 25, 0), ("production", -5, 25, 10), ("production", float("nan"), 25, 10), ("odd", None, 25, 10)])
def test_budget(mode, explicit, eligible, want):
    assert ranking.budget(mode, explicit, eligible) == want


def test_website_ranking(spark):
    rows = [("https://ever-vision.edu.np/", "Ever Vision School"), ("https://facebook.com/evervision", "Ever Vision"), ("https://schools.example/listing/ever-vision", "Ever Vision School")]
    df = spark.createDataFrame(rows, "url string, title string")
    s, e = ranking.website_score(F.col("url"), F.col("title"), F.lit("Ever Vision School"), F.lit("Satungal"))
    got = {r.url: (r.s, r.e) for r in df.select("url", s.alias("s"), e.alias("e")).collect()}
    assert got[rows[0][0]][1] and got[rows[0][0]][0] >= ranking.LEAST and not got[rows[1][0]][1] and not got[rows[2][0]][1]


def test_confidence(spark):
    t, f = F.lit(True), F.lit(False)
    r = spark.range(1).select(
        scoring.maps_confidence(t, F.lit(250), t, f, t).alias("m"), scoring.overall_confidence(F.lit(0.9), F.lit(0.0), F.lit(0.0), F.lit(1.0), t).alias("o"), scoring.conflict_penalty(F.lit("SHARED_OFFICE")).alias("p"), scoring.conflict_penalty(F.lit(None).cast("string")).alias("n"),
        scoring.verification({"gate": t, "domain": t, "name": t, "phone": t, "address": f, "email": f, "social": f}, t).alias("v"),
    ).first()
    assert (r.m, r.o, r.p, r.n, r.v.status, r.v.confidence) == (1.0, 0.76, 0.9, 1.0, "verified", 0.7)


def test_store(spark):
    d = spark.createDataFrame([("Lawyers in X",), ("widgets",), ("dental clinic here",), ("School",), (None,)], "q string")
    assert [r.d for r in d.select(store.fresh_days(F.col("q")).alias("d")).collect()] == [90, 30, 90, 180, 30]
    cols = "canonical_key string, name string, phones array<string>, mobiles array<string>, emails array<string>, websites array<string>, ingested_at timestamp_ntz, listing_index long, run_id string"
    ts = __import__("datetime").datetime
    a = store.accumulate(spark.createDataFrame([("k", "A", ["1"], None, [], [], ts(2025, 1, 1), 1, "r1"), ("", "B", [], [], [], [], ts(2025, 1, 1), 2, "r1")], cols))
    b = store.accumulate(spark.createDataFrame([("k", "A2", [" 1 ", "2"], [], [], [], ts(2025, 2, 1), 3, "r2")], cols))
    r = store.fold(a, b).collect()
    assert [(x.canonical_key, x.first_name, x.phones, x.run_count, x.first_seen) for x in r] == [("k", "A", ["1", "2"], 2, ts(2025, 1, 1))]


def test_sources(spark, tmp_path):
    p, s = spark.createDataFrame([("r1", 1)], "run string, id int"), spark.createDataFrame([("r1", 2), ("r2", 3)], "run string, id int")
    assert sorted(r.id for r in cache.with_fallback(p, s, "run").collect()) == [1, 3]
    e = spark.createDataFrame([("HTTP 429 rate limit",), ("request timed out",), (None,)], "m string")
    assert [r.k for r in e.select(cache.classify_error(F.col("m")).alias("k")).collect()] == ["rate_limited", "timeout", "unknown"]
    pages = spark.createDataFrame([("q", 1, "a"), ("q", 1, "b"), ("q", 2, "a"), ("q", 3, "b"), ("q", 4, "c")], "k string, page int, item string")
    assert {r.page for r in cache.stop_page(pages, "k", "page", "item", target=10).collect()} == {1, 2, 3}
    store.write_artifact(p, str(tmp_path), "search", "run-1")
    assert spark.read.json(str(tmp_path / "latest" / "search")).count() == 1 and spark.read.json(str(tmp_path / "runs" / "run-1" / "search")).count() == 1
    store.write_snapshot(p.withColumnRenamed("run", "run_id"), str(tmp_path / "runs_table"))
    store.write_snapshot(s.withColumnRenamed("run", "run_id").where("run_id = 'r1'"), str(tmp_path / "runs_table"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "runs_table")).collect()] == [2]


def test_streams(spark, tmp_path):
    from milap.streaming import edges

    ts = __import__("datetime").datetime
    cols = "canonical_key string, name string, phones array<string>, mobiles array<string>, emails array<string>, websites array<string>, ingested_at timestamp_ntz, listing_index long, run_id string"
    src = tmp_path / "in"
    for n, (phone, run) in enumerate((("1", "r1"), ("2", "r2"))):
        spark.createDataFrame([("k", "A", [phone], [], [], [], ts(2025, 1, 1 + n), n, run)], cols).coalesce(1).write.mode("append").parquet(str(src))
        q = spark.readStream.schema(cols).parquet(str(src)).writeStream.foreachBatch(edges.folding_sink(str(tmp_path / "store"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r.phones, r.run_count) for r in spark.read.parquet(str(tmp_path / "store" / "v1")).collect()] == [(["1", "2"], 2)]
    ev = spark.createDataFrame([(1, ts(2024, 1, 1, 5), "a"), (2, ts(2024, 1, 1, 5, 30), "a"), (1, ts(2024, 1, 1, 5), "a")], "event_id long, ts timestamp_ntz, event_type string")
    ev.write.parquet(str(tmp_path / "ev"))
    s = edges.once(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), "event_id", "ts")
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "once")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2
    assert [r["count"] for r in edges.windowed_counts(ev, "ts", "event_type").collect()] == [3]


def test_one_to_one_equals_greedy_walk(spark):
    from milap.operators import gates

    rng = random.Random(12)
    pairs = list({(rng.randrange(15), rng.randrange(15), rng.randrange(5)) for _ in range(90)}) + [(None, 1, 0), (3, None, 0)]
    got = {(r.a, r.b) for r in gates.one_to_one(spark.createDataFrame(pairs, "a int, b int, o int"), "a", "b", "o").collect()}
    used_a, used_b, want = set(), set(), set()
    for o, a, b in sorted((o, a, b) for a, b, o in pairs if a is not None and b is not None):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b))
    assert got == want


def test_gates(spark):
    from milap.operators import gates

    df = spark.createDataFrame([("Top 10 cafes in Nepal 2024",), ("Home",), (None,), ("Om Samaj Dental",)], "n string")
    assert [r.x for r in df.select(gates.artifact_name(F.col("n")).alias("x")).collect()] == [True, True, True, False]
    arr = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    d = spark.createDataFrame([("om dental clinic",), ("bank atm dental",), ("grocery",)], "s string")
    assert [r.x for r in d.select(gates.relevance(F.col("s"), arr("dental"), arr("clinic"), arr("atm"))["label"].alias("x")).collect()] == ["relevant", "irrelevant", "ambiguous"]
    assert spark.range(1).select(gates.expand_queries(F.lit("gym"), F.lit("Miyel"), arr("gym", "fitness in Miyel")).alias("q")).first().q == ["gym Miyel", "fitness in Miyel"]
    assert spark.range(1).select(gates.lifecycle(F.lit("first_party"), F.lit(True)).alias("x")).first().x == "first_party_owned"


def test_pipeline_accounts_for_every_candidate(spark):
    from milap.plans import pipeline

    place = "row_id long, place_id string, cid string, run_id string, title string, address string, phone_number string, website string, latitude double, longitude double, rating_count double, category string, requested string"
    places = spark.createDataFrame([
        (1, "a", None, "r", "Om Samaj Dental", "Thayim 3", "01-4311600", None, None, None, 5.0, "Dental", "thayim"), (2, "a", None, "r", "Om Samaj", "Thayim", None, "https://omsamaj.example", None, None, 9.0, None, "thayim"),
        (3, "b", None, "r", "Home", "Thayim", None, None, None, None, None, None, "thayim"), (4, "c", None, "r", "Far Cafe", "Miyel", "9851239227", None, 28.0, 85.0, None, None, "thayim"), (5, None, None, "r", None, None, None, None, None, None, None, None, None), (6, "d", None, "r", "Lone Hill", "Thayim", None, None, None, None, None, None, "thayim"),
    ], place)
    evidence = spark.createDataFrame([(1, "r", "Web Only", "01-4311601", None, "webonly.example"), (2, "r", "Om Samaj", None, None, "omsamaj.example"), (3, "r", "x", None, None, "facebook.com"), (4, None, None, None, None, None)], "evidence_id long, run_id string, name string, phone string, address string, domain string")
    loc = spark.createDataFrame([(1, "thayim", (27.0, 85.0), 5.0, []), (2, "miyel", (28.0, 85.0), 5.0, [])], "locality_id long, canonical_name string, centroid struct<lat:double,lng:double>, max_radius_km double, aliases array<string>")
    docs = spark.createDataFrame([("omsamaj.example", "https://omsamaj.example/contact"), (None, None)], "site string, url string")
    found = pipeline.candidates(places, evidence, loc)
    book = pipeline.ledger(pipeline.listings(found, docs))
    got = {r.candidate: r.outcome for r in book.collect()}
    assert got == {"map:a": "finalized", "map:b": "artifact_name", "map:c": "outside", "map:|": "artifact_name", "map:d": "no_contact", "web:webonly.example": "finalized"}
    report = pipeline.outcome_report(book).first()
    assert report.candidates == 6 and report.finalized == 2 and report.over_target == 0


def test_pipeline_reads_pages_and_conflicts(spark):
    from milap.plans import pipeline

    cols = "candidate string, origin string, run_id string, name string, address string, phone string, website string, category string, lat double, lng double, rating_count double, geo string"
    one = lambda c, name, phone, site: (c, "maps", "r", name, "5 Hill Road", phone, site, None, None, None, 0.0, "inside")
    found = spark.createDataFrame([one("a", "Om Samaj Dental", "01-4311600", "https://omsamaj.example"), one("b", "Lone Peak", "01-4311700", "https://lonepeak.example"), one("c", "Twin One", "01-4311800", None), one("d", "Other Two", "01-4311800", None)], cols)
    docs = spark.createDataFrame([("omsamaj.example", "u1", "Om Samaj Dental, 5 Hill Road. Call 01-4311600, info@omsamaj.example"), ("lonepeak.example", "u2", "nothing here")], "site string, url string, text string")
    got = {r.candidate: (r.verification, r.confidence) for r in pipeline.listings(found, docs).collect()}
    assert got["a"][0] == "verified" and got["b"][0] == "weak" and got["a"][1] > got["b"][1]
    alone = {r.candidate: r.confidence for r in pipeline.listings(found.where("candidate = 'c'"), docs).collect()}
    assert got["c"][1] < alone["c"]


def test_backfill_geocode_status_reason(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "1"), (None, "")], "k string, phone string")
    known = spark.createDataFrame([("a", "9"), ("a", "8"), ("b", "7"), (None, "6")], "k string, phone string")
    assert sorted(((r.k, r.phone) for r in matching.backfill(rows, known, "k", "phone").collect()), key=str) == [("a", "8"), ("b", "1"), (None, None)]
    geo = matching.geocoded(spark.createDataFrame([("x",), ("y",), ("z",)], "q string"), spark.createDataFrame([("x", 1.0, 2.0)], "q string, lat double, lng double"), spark.createDataFrame([("x", 9.0, 9.0), ("y", 3.0, 4.0), ("y", None, 4.0)], "q string, lat double, lng double"), "q")
    assert {r.q: (r.lat, r.found_in) for r in geo.collect()} == {"x": (1.0, "registry"), "y": (3.0, "cache"), "z": (None, None)}
    assert store.status(spark, str(tmp_path / "none")) == "unreachable"
    rows.write.parquet(str(tmp_path / "t"))
    assert store.status(spark, str(tmp_path / "t")) == "connected"
    p = spark.createDataFrame([('{"results":[1]}',), ('{"results":[]}',), ("[",), (None,)], "p string")
    assert [r.u for r in p.select(cache.usable_payload(F.col("p")).alias("u")).collect()] == [True, False, False, False]
    none = F.array().cast("array<string>")
    said = spark.range(1).select(graph.conflict_reason(F.lit("SHARED_OFFICE"), F.lit("A"), F.lit("B"), none, F.array(F.lit("x@y.z")), none, none, F.lit(0.02)).alias("s")).first().s
    assert said == "A and B share e-mails [x@y.z] and a distance of 20 m: a shared office"


def _inside(ring, lat, lng):
    """Even-odd rule by the crossings west of a point."""
    n = 0
    for (a, x), (b, y) in zip(ring, ring[1:] + ring[:1]):
        if (a <= lat) != (b <= lat):
            n += x + (y - x) * (lat - a) / (b - a) < lng
    return n % 2 == 1


def test_polygons_over_points_against_brute_force(spark):
    rng = random.Random(15)
    rings = [[(27 + rng.random() * 0.6, 85 + rng.random() * 0.6) for _ in range(rng.randint(3, 9))] for _ in range(25)]
    rings.append([(27.1, 85.1), (27.5, 85.1), (27.5, 85.5), (27.1, 85.5), (27.1, 85.1)])  # closed, and a box
    pts = [(i, 27 + rng.random() * 0.6, 85 + rng.random() * 0.6) for i in range(400)]
    struct = lambda r: [{"lat": a, "lng": b} for a, b in r]
    regions = spark.createDataFrame([(j, 1, struct(r)) for j, r in enumerate(rings)] + [(90, 1, None), (91, 1, []), (92, 1, struct([(27.0, None), (27.5, 85.0), (27.1, 85.4)])), (93, 1, struct([(27.1, 85.0), (27.1, 85.4)]))], "id long, tag long, ring array<struct<lat double, lng double>>")
    points = spark.createDataFrame([(*p, "x") for p in pts] + [(900, None, 85.1, "x"), (None, 27.2, 85.2, "x")], "id long, lat double, lng double, ring string").withColumn("tag", F.lit(1))
    want = {(j, i) for j, r in enumerate(rings) for i, a, b in pts if _inside(r, a, b)}
    for most in (500_000, 40):
        assert {(r.region, r.point) for r in slabs.polygons_over_points(regions, points, most=most).collect()} == want
    assert len(want) > 500 and slabs.polygons_over_points(regions.limit(0), points).count() == 0


def test_discs_of_very_different_widths(spark):
    rng = random.Random(16)
    pts = [(i, 27 + rng.random(), 85 + rng.random()) for i in range(400)]
    discs = [(j, 27 + rng.random(), 85 + rng.random(), 10 ** rng.uniform(-1, 2)) for j in range(60)]
    got = points_inside(spark.createDataFrame(pts, "id long, lat double, lng double"), spark.createDataFrame(discs, "rid long, clat double, clng double, rad double"), id_col="id", lat_col="lat", lng_col="lng", region_col="rid", centre_lat="clat", centre_lng="clng", radius_col="rad", slab_deg=0.03)
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, a, b in pts for j, c, d, q in discs if km(a, b, c, d) <= q)
