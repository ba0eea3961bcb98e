"""Operators that find and read sites, and kinds of business, on worked cases."""

from pyspark.sql import functions as F

from milap.functions import categories, text, urls
from milap.operators import discovery, matching
from milap.sources import store


def one(spark, make, *values, schema="a string, b string, c string"):
    row = (*values, *[None] * 3)[: schema.count(",") + 1]
    return spark.createDataFrame([row], schema).select(make(*(F.col(c.split()[0]) for c in schema.split(", "))).alias("x")).first().x


def test_kinds(spark):
    kind = lambda t, glued=False: one(spark, lambda a, b, c: categories.kind_of(a, glued), t)
    assert [kind(x) for x in ("Nepal Tourism Board", "Bihani Hotel", "Hotel & Tours", "", None)] == [None, "hotel", None, None, None]
    assert kind("bihanihotel.com", True) == "hotel"
    clash = lambda x, y: one(spark, lambda a, b, c: categories.kinds_conflict(a, b), x, y)
    assert [clash("travel", "hotel"), clash("hotel", "travel"), clash("retail", "education"), clash("hotel", "hotel"), clash(None, "hotel")] == [True, True, False, False, False]
    line = lambda *t: one(spark, lambda a, b, c: categories.line_of_business(F.array(a, b)), *t)
    assert [line("Driving School"), line("school", "dental"), line("School"), line("xyz"), line(None)] == ["driving", "dental", "education", "services", "services"]


def test_second_query(spark):
    q = lambda n, p, cat, loc, run=None: one(spark, lambda a, b, c, d, e: categories.second_query(a, b, c, d, e), n, p, cat, loc, run, schema="a string, b string, c string, d string, e string")
    assert q("Ever Vision", None, None, "Satungal", "schools") == '"Ever Vision" "Satungal" site:.edu.np'
    assert q("Om Cafe", " 01-4311600 ", None, "Satungal") == '"Om Cafe" "01-4311600"' and q("Om Cafe", "", None, "") == '"Om Cafe" official' and q("", None, None, None) is None


def test_names_and_signatures(spark):
    f = lambda fn, v: one(spark, lambda a, b, c: fn(a), v)
    assert [f(text.brand_segment, x) for x in ("Om Cafe | Thamel", "Om Cafe - Best", "A: Om", "Om-Cafe", None)] == ["Om Cafe", "Om Cafe", "A: Om", "Om-Cafe", None]
    assert f(text.without_vendor, "Call us. <b>Website developed by Acme Tech</b> Open daily <!-- powered by X -->") == "Call us. <b> </b> Open daily" and f(text.without_vendor, None) == ""
    assert one(spark, lambda a, b, c: text.union_of(F.array(a, b), F.array(c, a)), "x", "", " y") == ["x", "y"]


def test_owners_of_hosts(spark):
    f = lambda fn, v: one(spark, lambda a, b, c: fn(a), v)
    assert [f(urls.map_url, x) for x in ("https://www.google.com/maps/x", "google_maps:1", "https://a.example", None)] == [True, True, False, False]
    assert [f(urls.issued_subdomain, x) for x in ("om.business.site", "business.site", "www.blogspot.com", "a.nepalyp.com", "om.com.np")] == [True, False, False, True, False]
    assert one(spark, lambda a, b, c: discovery.corporate_parent(a, b), "www.ihg.com", "Holiday  Inn Kathmandu") and not one(spark, lambda a, b, c: discovery.corporate_parent(a, b), "ihg.com", "Om Hotel") and not one(spark, lambda a, b, c: discovery.corporate_parent(a, b), None, None)


def test_directories_are_found_by_their_names(spark):
    rows = [("dir.example", f"alpha{i} beta{i}") for i in range(6)] + [("own.example", f"himal cafe{i}") for i in range(6)] + [("few.example", f"x{i}xxx") for i in range(3)] + [("", "a"), ("none.example", ""), (None, None)]
    df = spark.createDataFrame(rows, "host string, name string")
    assert [r.host for r in matching.directories(df).collect()] == ["dir.example"] and matching.directories(df.limit(0)).count() == 0


def test_name_blocking_loses_no_pair(spark):
    import random

    rng = random.Random(3)
    pool = [f"w{i}" for i in range(14)]
    made = lambda k: [(i, "", "", " ".join(rng.sample(pool, rng.randint(1, 8))), "x y") for i in range(k)]
    a, b = made(60), made(60)
    cols = "id long, phone string, host string, name string, address string"
    jac = lambda x, y: len({*x.split()} & {*y.split()}) / len({*x.split()} | {*y.split()})
    want = {(x[0], y[0]) for x in a for y in b if jac(x[3], y[3]) >= 0.85}
    got = {(r.a_id, r.b_id) for r in matching.pair_cascade(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols)).collect()}
    assert got == want and len(want) > 3


def test_caps():
    assert [discovery.overfetch_cap(x) for x in (None, 1, 3, 10)] == [None, 6, 8, 20] and [discovery.deep_verify_cap(*x) for x in ((3, 50), (None, 50), (None, 4), (None, None))] == [3, 50, 10, 10]


def test_pages_to_read(spark):
    sites = spark.createDataFrame([("s", "https://s.example/"), ("t", "https://t.example")], "site string, origin string")
    links = spark.createDataFrame([("s", f"https://s.example/p{i}", i) for i in range(6)] + [("s", "https://s.example/contact", 9), ("s", "https://s.example/contact/", 10), ("s", "https://s.example", 11)], "site string, url string, at int")
    got = {(r.site, r.rank): (r.url, r.found) for r in discovery.pages_to_read(sites, links).collect()}
    assert got["s", 1] == ("https://s.example", "homepage") and got["s", 2] == ("https://s.example/contact", "link") and got["s", 3] == ("https://s.example/p0", "link")
    assert [got["t", i] for i in (1, 2, 5)] == [("https://t.example", "homepage"), ("https://t.example/contact", "fallback_guess"), ("https://t.example/contact-us.php", "fallback_guess")] and len(got) == 10
    assert discovery.pages_to_read(sites.limit(0), links).count() == 0


def test_own_domain_phone(spark):
    rows = [("k", "a.example", "a.example", 1, "call 9851012345"), ("k", "a.example", "a.example", 2, "or 01-4311600"), ("k", "b.example", "a.example", 0, "01-5363501"), ("m", "c.example", "", 0, "01-4311600"), ("n", "d.example", "d.example", 0, None)]
    got = discovery.own_domain_phone(spark.createDataFrame(rows, "key string, host string, own string, at int, said string")).collect()
    assert [(r.key, r.phone) for r in got] == [("k", "14311600")]


def test_needs_script(spark):
    f = lambda ok, content, html, soc, con: spark.createDataFrame([(ok, content, html, soc, con)], "o boolean, c string, h string, s boolean, k boolean").select(discovery.needs_script(F.col("o"), F.col("c"), F.col("h"), F.col("s"), F.col("k")).alias("x")).first().x
    long = "x" * 3000
    assert [f(True, long, long, False, False), f(True, "", long, False, False), f(True, long, "", False, False), f(True, long, long + " __NEXT_DATA__", False, False), f(True, long, long + " on facebook", False, True), f(False, long, long, True, True), f(True, long, long + " __NEXT_DATA__", True, False)] == [False, True, True, True, True, False, False]


def test_unattributed(spark):
    f = lambda cs, m: spark.createDataFrame([(cs, m)], "c array<struct<digits string, attribution string>>, m string").select(discovery.all_unattributed(F.col("c"), F.col("m")).alias("x")).first().x
    assert [f([("1", "unattributed")], ""), f([("1", "branch"), ("2", "unattributed")], ""), f([("1", "branch"), ("2", "unattributed")], "1"), f([("1", "branch")], "1"), f([], None)] == [True, False, True, False, False]


def test_verified_evidence(spark):
    cols = "u boolean, s boolean, p int, g int, r string, st string"
    f = lambda *v: tuple(spark.createDataFrame([v], cols).select(discovery.verified_evidence(*(F.col(c.split()[0]) for c in cols.split(", "))).alias("x")).first().x)
    assert f(False, True, 3, 3, "first_party", "verified") == ("failed", "directory", "discovered", "wrong_source") and f(False, False, 0, 0, "unverified", "failed")[3] == "unverified"
    assert f(True, True, 2, 1, "related_entity", "verified") == ("verified", "first_party", "first_party_owned", "verified") and f(True, True, 2, 1, "unrelated", "verified")[3] == "wrong_source"
    assert f(True, True, 2, 0, "first_party", "verified") == ("failed", "unverified", "fetched", "transient_failure") and f(True, True, 0, 0, "first_party", "verified") == ("weak", "unverified", "discovered", "unverified")


def test_newest_fresh_against_brute_force(spark):
    import datetime
    import random

    rng = random.Random(4)
    day = lambda d: datetime.datetime(2026, 1, 1) + datetime.timedelta(days=d)
    runs = [(q, l, f"r{i}", day(rng.randint(0, 60)), i, rng.choice(["success", "empty", "failed"])) for i in range(120) for q, l in [(rng.choice(["gym", "cafe"]), rng.choice(["x", "y"]))]]
    asked = [(q, l, day(d)) for q in ("gym", "cafe", "zoo") for l in ("x", "y") for d in range(0, 70, 7)] + [(None, "x", day(3)), ("gym", None, day(3)), ("gym", "x", day(7))]
    df = spark.createDataFrame(runs, "query_key string, locality_key string, run_id string, completed_at timestamp_ntz, listing_count long, status string")
    got = {(r.query_key, r.locality_key, r["at"]): r.run_id for r in store.newest_fresh(df, spark.createDataFrame(asked, "query_key string, locality_key string, at timestamp_ntz")).collect()}
    days = {"gym": 30, "cafe": 14, "zoo": 30}

    def want(q, l, t):
        ok = [(c, r) for a, b, r, c, _, s in runs if a == q and b == l and s != "failed" and c < t and (t - c).days < days[q] + ((t - c).seconds > 0) and c > t - datetime.timedelta(days=days[q])]
        return max(ok)[1] if ok else None

    assert got == {(q, l, t): want(q, l, t) if q and l else None for q, l, t in asked}


def test_summary(spark, tmp_path):
    store.write_summary(spark, {"query": "gym", "n": 3}, str(tmp_path), "run1")
    texts = [spark.read.text(f"{tmp_path}/{f}/summary-report").first().value for f in ("latest", "history/run1")]
    assert texts[0] == texts[1] and '"n": 3' in texts[0] and "timestamp" in texts[0]
