"""Names, addresses, matches, groups and survivors on small fixtures."""

import random

from pyspark.sql import functions as F

from milap.llm import buildings, components, names, retrieval, survivor
from milap.llm.addresses import parse_address
from milap.llm.forms import parse_name


def test_hash_to_min_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(70), rng.randrange(70)) for _ in range(55)] + [(200 + i, 201 + i) for i in range(40)] + [(500, 501 + i) for i in range(60)] + [(None, 1), (9, None), (4, 4), (500, 501), (501, 500)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame([(*e, "extra") for e in edges], "a long, b long, v string")
    got = components.hash_to_min(df, "a", "b")
    assert sorted(map(tuple, got.collect())) == sorted((n, find(n)) for n in list(root))
    assert components.hash_to_min(df.limit(0), "a", "b").count() == 0


def test_parse_name():
    assert parse_name("Dr. Baabudha Tamaaphe Trek. Agency Pvt. Ltd. - Best in Miyel") == (parse_name("Babudha Tamaphe Trekking")[0], "trekking")
    assert parse_name("Heneva, B. Sports Academy") == (("heneba", "b"), "sports")
    assert [parse_name(x)[0] for x in ("Unknown Name", "", None, "Home", "Pvt. Ltd.")] == [()] * 5
    assert parse_name("Caf&eacute; Om Samaj")[1] == "cafe" and parse_name("Travels Int'l Om Samaj")[1] == "travel"


def test_parse_address():
    assert parse_address("H.No. 2, Yogasel St., Ghaavopraa-21 48689 Nepal.") == ("yogasel", "2", "21", "48689", ["ghabopra"])
    assert parse_address("2nd floor, near the bus park, Varum Marg-3; Miyel; Ward No. 1") == ("barum", "3", "1", "", ["miyel"])
    assert parse_address("Daateesa - 14, behind the temple, 1 Pheshaayus")[:3] == ("phesayus", "1", "14")
    assert [parse_address(x)[:2] for x in ("", None, "N/A", "Miyel, Nepal")] == [("", "")] * 4


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


LISTING = "listing_index long, canonical_key string, name string, phones array<string>, mobiles array<string>, websites array<string>"
EVIDENCE = "evidence_id long, name string, phone string, domain string, listing_index string"


def test_variant_pairs(spark):
    listings = spark.createDataFrame([
        (1, "k1", "Baabudha Tamaaphe Trekking Agency", ["01-4311600"], [], []), (2, "k1", "Unknown Name", None, None, None), (3, "k2", "Baabudha Tamaaphe Cafe", [], [], []), (4, None, None, [], [], []), (5, "", "Kumihi Jegheebeen Gym", [], [], []),
        (6, "k3", "Jebrul Sohos Gym", ["061-565497"], [], []), (7, "k4", "Jebrul Sinom Gym", [], [], []),
    ], LISTING)
    evidence = spark.createDataFrame([
        (10, "Tamaphe-Babudha Treks", None, None, "x"), (11, "Babudhatamaphe Trekking", None, None, "x"), (12, "B. Tamaaphe Trekking Agency", None, None, "x"), (13, "BAABUDHA TAMAAPHE TREKKING AGENCY", None, None, "x"), (14, "Baabudha Tamaafe Cafe", None, None, "x"),
        (15, "Baabudhe Tamaaphe Trekking", None, None, "x"), (16, "", "01-4311600", None, "x"), (17, None, None, None, None), (18, "Jegeebeen Kumihi Fitness", None, None, "x"), (18, "Jegeebeen Kumihi Fitness", None, None, "x"),
        (19, "Jebrul S. Gym", "061 565497", "", "x"), (20, "Jebrul S. Gym", None, None, "x"),
    ], EVIDENCE)
    got = {tuple(r) for r in names.variant_pairs(listings, evidence).collect()}
    # 13 differs in case only, 14 is the cafe, 20 could be either gym
    assert {(1, 10), (1, 11), (1, 12), (1, 15), (3, 14), (6, 19)} <= got
    assert not {(1, 13), (1, 14), (3, 10), (2, 10), (1, 16), (6, 20), (7, 20), (7, 19)} & got
    assert names.variant_pairs(listings.limit(0), evidence).count() == 0


def test_small_plans_leave_little_on_the_driver(spark, monkeypatch):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("bdgklmnprt") + rng.choice("aeiou") for _ in range(4)).title()
    brands = [(word(), word()) for _ in range(30)]
    listings = spark.createDataFrame([(i, f"k{i}", f"{a} {b} Gym", [f"061-5654{i:02d}"], [], []) for i, (a, b) in enumerate(brands)], LISTING)
    evidence = spark.createDataFrame([(100 + i, (f"{b} {a} Fitness", f"{a[0]}. {b} Gym", f"{a[:3]}{a[4:]} {b} Gym", b)[i % 4], f"061-5654{i:02d}", None, "x") for i, (a, b) in enumerate(brands)], EVIDENCE)
    plans = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()

    def pairs():
        before = plans().size()
        got = sorted(map(tuple, names.variant_pairs(listings, evidence).collect()))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        written = [x for x in map(plans().apply, range(before, plans().size())) if "InsertIntoHadoopFsRelationCommand" in x.physicalPlanDescription()]
        return got, sum("BroadcastExchange" in x.physicalPlanDescription() for x in written), sum(x.metrics().size() for x in written)

    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    light = pairs()
    assert kept == {k: spark.conf.get(k) for k in kept}
    monkeypatch.setattr(names, "stage", names.session.stage)
    monkeypatch.setattr(names, "LIGHT", 0)
    heavy = pairs()
    # a plan is carried out in another way, with the same result
    assert light[0] == heavy[0] and len({(i, 100 + i) for i in range(30)} & set(light[0])) > 25
    # near words keep their broadcasts
    assert 2 * light[1] < heavy[1] and 2 * light[2] < heavy[2], (light[1:], heavy[1:])


def test_contact_of_a_crowd_still_decides_by_a_brand_word(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bdgklmnprt") + rng.choice("aeiou") for _ in range(4)).title()
    brands = [(word(), word()) for _ in range(60)]
    listings = spark.createDataFrame([(i, f"k{i}", f"{a} {b} Gym", [], [], ["crowd.example"]) for i, (a, b) in enumerate(brands)] + [(60, "k60", f"{brands[0][0]} {word()} Gym", [], [], ["crowd.example"])], LISTING)
    asked = [(100 + i, f"{brands[i][1]}", None, "crowd.example", "x") for i in range(1, 6)] + [(110, f"{brands[7][1][:3]}{brands[7][1][4:]}", None, "crowd.example", "x"), (111, brands[0][0], None, "crowd.example", "x"), (112, brands[8][1], None, "other.example", "x"), (113, f"{brands[9][1]} Cafe", None, "crowd.example", "x")]
    got = {tuple(r) for r in names.variant_pairs(listings, spark.createDataFrame(asked, EVIDENCE)).collect()}
    # 111 is a word of two, 112 has another host, 113 another trade
    assert got == {(i, 100 + i) for i in range(1, 6)} | {(7, 110)}


def test_near_words_against_brute_force(spark):
    rng = random.Random(22)
    made = lambda n: sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(n)})
    w, y = made(60), made(60)
    got = {tuple(r) for r in names._near_words(spark.createDataFrame([(x,) for x in w], "w string"), spark.createDataFrame([(x,) for x in y], "y string")).collect()}
    assert got == {(a, b) for a in w for b in y if distance(a, b) <= (2 if len(b) >= 6 else 1)}


def test_same_building(spark):
    streets = ["Yogasel", "Varum", *"Hapuhe Bothoval Kshuku Tuhot Jeprepa Matuba Risuyat Gibrane Brami Heelana Pradhaaphi Krikrur Bepepree Lophil".split()]
    rows = [(i, f"{s} Marg {h}, Miyel, Ward 1, Seelot") for i, (s, h) in enumerate((s, h) for s in streets for h in range(1, 9))]
    places = spark.createDataFrame([*rows, (100, None), (101, ""), (102, "N/A"), (103, "Yogasel Marg, Miyel")], "row_id long, address string")
    evidence = spark.createDataFrame([(1, "H.No. 3 Yogsael Road; Seelot - 1; Nepal"), (2, "yogasel marg 3 miyel ward 1 seelot"), (3, "#3, Yogasel Rd, Seelott, Miyel"), (4, "2nd Floor, Varum St. No. 5, Miyel"), (5, "Varum Marg 77, Miyel"), (6, None), (4, "2nd Floor, Varum St. No. 5, Miyel")], "evidence_id long, address string")
    loc = spark.createDataFrame([(1, "miyel", ["miyel", "seelot-1"]), (2, "thayim", None)], "locality_id long, canonical_name string, aliases array<string>")
    got = sorted(map(tuple, buildings.same_building(places, evidence, loc).collect()))
    # 2 is written the same but for punctuation
    assert got == [(2, 1), (2, 3), (12, 4)]
    assert buildings.same_building(places.limit(0), evidence, loc).count() == 0


def test_retrieval(spark):
    rng = random.Random(11)
    made = ["".join(rng.choice("bdgklmnprstvy") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(80)]

    def business(i):
        return f"{made[2 * i]} {made[2 * i + 1]} Cafe"

    rows = [(i, business(i), f"98510{i:05d}", f"https://site{i}.example/x", None, f"No. {i} Road, Alpha Beta{i}") for i in range(40)]
    cols = "id long, name string, phone string, web string, site string, address string"
    left = spark.createDataFrame([*rows, (90, None, None, None, None, None), (91, "", "", "", "", "")], cols)
    right = spark.createDataFrame([(200, "", "+977 9851000003", None, None, None), (201, "Home", None, "http://www.site4.example", None, None), (202, business(5), None, None, "n/a", None), (203, "Other Bakery Gym", None, None, None, "n/a"), (204, None, None, None, None, None), (205, "Totally Different Law Chamber", "9851000007", None, None, None), (202, business(5), None, None, "n/a", None)], cols)
    got = {(r.left_id, r.right_id): r.confidence for r in retrieval.match(left, right).collect()}
    assert set(got) == {(3, 200), (4, 201), (5, 202)} and all(0 < c <= 1 for c in got.values())
    assert retrieval.match(left.limit(0), right).count() == 0


def test_logistic_recovers_weights():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0])))).astype(float)
    assert np.allclose(retrieval.fit_logistic(x, y), [0.5, 2.0], atol=0.25)


def test_usable_values(spark):
    def one(f, v):
        return spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("x")).first().x

    assert [one(survivor.phone_key, v) for v in ("+977 (61) 308-301", "Tel: 056-573 543", "०५१-७८४९१३", "01-", "0000000", "9851239227", None)] == ["61308301", "56573543", "51784913", None, None, None, None]
    assert [one(survivor.host_key, v) for v in ("HTTPS://www.A.com.example/x?y", "a.example", "http://", "coming soon", "N/A", "https://www.single")] == ["a.com.example", "a.example", None, None, None, None]
    assert [one(survivor.email_key, v) for v in ("mailto:A@b.example", " X@B.EXAMPLE ", "user@", "a@b", "none")] == ["a@b.example", "x@b.example", None, None, None]
    assert [one(survivor.handle_key, v) for v in ("https://m.facebook.example/Abc.np?ref=page", "facebook.example/abc/", "https://facebook.example/share", "https://facebook.example/", "#", None)] == ["abc.np", "abc", None, None, None, None]


def test_consensus_by_alignment():
    assert survivor.consensus(survivor.profile_of([("ram.example", 1.0), ("ramm.example", 0.9), ("ram.exampel", 0.9)])) == "ram.example"
    assert survivor.profile_of([]) == [] and survivor.consensus([]) == ""


def test_the_consensus_can_outvote_the_heaviest_value(spark):
    rows = [("g", "ram-shop.exampel", 3.0), ("g", "ram-shop.example", 2.0), ("g", "ramshop.example", 2.0), ("g", "ram-shopp.example", 2.0)]
    got = survivor.closest_to_consensus(spark.createDataFrame(rows, "g string, value string, weight double")).first()
    assert (got.value, got.heaviest) == ("ram-shop.example", False)


def test_a_directorys_host_is_no_ones(spark):
    ts = __import__("datetime").datetime(2025, 1, 1)
    cols = "canonical_key string, source string, phones array<string>, emails array<string>, websites array<string>, social_links struct<facebook:string>, extracted_at timestamp_ntz, ingested_at timestamp_ntz"
    rows = [(f"k{i}", "maps", [], [], ["http://dir.example/x"], (None,), ts, ts) for i in range(30) for _ in range(2)] + [("k0", "maps", [], [], ["http://own.example"], (None,), ts, ts), ("k1", "maps", [], [], ["http://own.example"], (None,), ts, ts)]
    got = survivor.survivors(spark.createDataFrame(rows, cols), spark.createDataFrame([("maps", 3)], "source string, trust int"))
    assert {tuple(r)[:3] for r in got.collect()} == {("k0", "websites", "own.example"), ("k1", "websites", "own.example")}


def test_a_value_added_is_a_profile_merged():
    rng = random.Random(9)
    for _ in range(200):
        values = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))), float(rng.randint(1, 9))) for _ in range(rng.randint(1, 4))]
        profile, held = [], 0.0
        for v, w in sorted(values, key=lambda x: (-x[1], x[0])):
            profile = survivor._add(profile, [{t: w} for t in v], w, held) if held else [{t: w} for t in v]
            held += w
        assert survivor.profile_of(values) == profile


def test_closest_to_consensus_in_parts(spark):
    rng = random.Random(4)
    base = "abcdefghij"
    rows = [("g", "".join(rng.choice("xyz") if rng.random() < 0.1 else c for c in base), 1.0) for _ in range(60)]
    rows = [(g, v, float(sum(w for _, x, w in rows if x == v))) for g, v in {(g, v) for g, v, _ in rows}] + [("h", "one", 1.0), ("t", "b", 1.0), ("t", "a", 1.0)]
    df = spark.createDataFrame(rows, "g string, value string, weight double")
    for part in (500, 7):
        got = {r.g: r.value for r in survivor.closest_to_consensus(df, part=part).collect()}
        assert got["h"] == "one" and got["t"] in "ab" and distance(got["g"], base) <= 1


def test_parts_keep_the_votes_of_all_values():
    import pyarrow as pa

    rows = [("g", 0, "abcx", 3.0), ("g", 0, "abcy", 2.0), ("g", 1, "abzy", 2.0)]
    parts = survivor._partial([pa.RecordBatch.from_pylist([dict(zip("gpvw", r, strict=True)) for r in rows])])
    said = list(survivor._merged(parts))
    assert said[0].to_pylist() == [{"g": "g", "said": "abcy"}] and survivor.consensus(survivor.profile_of([r[2:] for r in rows])) == "abcy"


def test_survivors(spark):
    ts = __import__("datetime").datetime
    cols = "canonical_key string, source string, phones array<string>, emails array<string>, websites array<string>, social_links struct<facebook:string>, extracted_at timestamp_ntz, ingested_at timestamp_ntz"
    row = lambda k, s, p, t, e=None: (k, s, p, [], None, (None,), t, e or t)
    df = spark.createDataFrame([
        row("a", "maps", ["061-111111"], ts(2025, 1, 1)), row("a", "maps", ["061-222222"], ts(2025, 6, 1)), row("a", "directory", ["061-111111"], ts(2025, 9, 1)), row("a", "directory", ["061-111111"], ts(2025, 9, 2)),
        row("b", "maps", ["061-333333"], ts(2035, 1, 1), ts(2025, 1, 1)), row("b", "maps", ["061-444444"], ts(2025, 2, 1)), row("c", "maps", ["061-555555"], ts(2025, 1, 1)), row(None, "maps", ["061-555555"], ts(2025, 1, 1)), row("d", None, None, None, ts(2025, 1, 1)), row("d", "x", ["n/a", None], None, ts(2025, 1, 1)),
    ], cols)
    trust = spark.createDataFrame([("maps", 3), ("directory", 1)], "source string, trust int")
    assert {tuple(r)[:3] for r in survivor.survivors(df, trust).collect()} == {("a", "phones", "61222222"), ("b", "phones", "61444444")}
    assert survivor.survivors(df.limit(0), trust).count() == 0


def test_a_street_without_a_word_for_it_is_known_from_the_others(spark):
    rows = [(i, f"Yogasel Marg {i}, Miyel, Seelot") for i in range(1, 9)] + [(i + 10, f"Varum Marg {i}, Miyel, Seelot") for i in range(1, 9)]
    places = spark.createDataFrame(rows, "row_id long, address string")
    evidence = spark.createDataFrame([(1, "Yogasel 3, Miyel, Seelot"), (2, "3, Yogasel, Miyel, Seelot"), (3, "Seelot-3, Miyel"), (4, "Miyel, Varum-5")], "evidence_id long, address string")
    loc = spark.createDataFrame([(1, "miyel", ["miyel"])], "locality_id long, canonical_name string, aliases array<string>")
    assert sorted(map(tuple, buildings.same_building(places, evidence, loc).collect())) == [(3, 1), (3, 2), (15, 4)]


def test_abbreviations_are_mined(spark):
    rng = random.Random(12)
    streets = ["Yogasel", "Pradhaaphi", "Bothoval", "Kshuku", "Tuhot", "Jeprepa", "Matuba", "Risuyat", "Gibrane", "Heelana"]
    rows = [(n, f"{s} Marg {h}, {t}") for n, (s, h, t) in enumerate((s, h, t) for s in streets for h in range(1, 15) for t in ("Miyel", "Thayim"))]
    short = [(1000 + h, f"Prdhph Marg {h}, Miyel") for h in range(1, 7)]
    forms = buildings.address_parts(spark.createDataFrame([*rows, *short, (2000, "Zzz Marg 3, Miyel")], "id long, address string").withColumn("side", F.lit(0).cast("byte")))
    got = {(r.role, r.word, r.better) for r in buildings.mine_rewrites(forms.select("street", "number", "places")).collect()}
    assert got == {("street", "prdhph", "pradhaphi")}


def test_profiles_merge_by_typos_and_nicknames(spark):
    listings = spark.createDataFrame([(1, "k1", "Silaamum Banohee Dental Clinic", [], [], []), (2, "k2", "Silaamun Banohee Dental Clinic", [], [], []), (3, "k3", "Sileghor Banohe Gym", [], [], []), (4, "k4", "Himalaya Dental", [], [], []), (5, "k5", "Om Shanti Kumari Cafe", [], [], [])], LISTING)
    evidence = spark.createDataFrame([(10, "Sili Banohee Dental", None, None, "x"), (11, "Sil. Banohee Dental", None, None, "x"), (12, "Himalya Dental Clinic", None, None, "x"), (13, "Kumari Om Shanti Cafe", None, None, "x"), (14, "Om Shanti Kumary Cafe", None, None, "x")], EVIDENCE)
    got = {tuple(r) for r in names.variant_pairs(listings, evidence).collect()}
    assert {(1, 10), (2, 10), (4, 12), (5, 13), (5, 14)} <= got and not any(a == 3 for a, _ in got)


def test_a_stage_leaves_no_shuffle_files(spark):
    import time

    from milap.session import stage

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(f) for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    held = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count().repartition("k")
    out = stage(held)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == held.count() == 97


def test_tables_of_a_round_are_deleted_when_names_are_matched(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from milap.session import shared_dir

    at = Path(urlparse(shared_dir(spark)).path)
    there = lambda: {p.name for k in ("brands", "said", "asking", "contact", "links") for p in at.glob(f"{k}-*")}
    before = there()
    listings = spark.createDataFrame([(1, "k1", "Himal Sagar Dental Clinic", ["014412345"], [], []), (2, "k2", "Himal Sagar Dental", [], [], [])], LISTING)
    evidence = spark.createDataFrame([(10, "Sagar", "014412345", None, "x"), (11, "Himal Sagr Dental", None, None, "x")], EVIDENCE)
    got = {tuple(r) for r in names.variant_pairs(listings, evidence).collect()}
    assert got == {(i, e) for i in (1, 2) for e in (10, 11)} and not there() - before


def test_a_contact_that_becomes_a_crowd_in_a_later_round_is_asked_for_words_known_before(spark):
    rows = [(1, "Himal Sagar Dental"), (2, "Bihani Tara Gym"), (3, "Sunaulo Nadi Cafe"), (4, "Kopila Dhara Law")]
    ours = names.parsed(spark.createDataFrame([(i, i, n) for i, n in rows], "id long, owner long, name string"))
    theirs = names.parsed(spark.createDataFrame([(10, None, "Sunaulo Bihani"), (11, None, "Sunaulo"), (12, None, "Gaurishankar")], "id long, owner long, name string"))
    left = spark.createDataFrame([(1, "P"), (2, "Q"), (3, "D"), (4, "D")], "owner long, contact string")
    right = spark.createDataFrame([(10, "P"), (10, "Q"), (11, "P"), (12, "D")], "id long, contact string")
    # 10 joins the gym by Q; P is of two then, and the gym is also called by the word that 11 asks for
    for crowded in (0, 1, 20):
        got = {tuple(r) for r in names.resolve(ours, theirs, left, right, crowded=crowded)[1].collect()}
        assert {(10, 2), (11, 2)} <= got


def test_left_of_words_is_the_same_for_the_same_letters():
    rng = random.Random(31)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(80)})

    def cut(w):
        one = {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
        return one | {x[:i] + x[i + 1 :] for x in one for i in range(len(x))} if len(w) >= 4 else one

    left = [set(x.tolist()) for x in names._left_of(words, 4)]
    assert all(bool(left[i] & left[j]) == bool(cut(a) & cut(b)) for i, a in enumerate(words) for j, b in enumerate(words))


def test_rewrites_are_mined_from_each_address_once(spark, monkeypatch):
    streets = ["Yogasel", "Varum", *"Hapuhe Bothoval Kshuku Tuhot Jeprepa Matuba Risuyat Gibrane Brami Heelana Pradhaaphi Krikrur Bepepree Lophil".split()]
    rows = [(i, f"{s} Marg {h}, Miyel, Ward 1, Seelot") for i, (s, h) in enumerate((s, h) for s in streets for h in range(1, 9))]
    rows += [(1000 + i, a.replace(" Ward 1,", "")) for i, a in rows]
    evidence = spark.createDataFrame([(1, "H.No. 3 Yogsael Road; Seelot - 1; Nepal"), (3, "#3, Yogasel Rd, Seelott, Miyel"), (4, "2nd Floor, Varum St. No. 5, Miyel")], "evidence_id long, address string")
    loc = spark.createDataFrame([(1, "miyel", ["miyel", "seelot-1"]), (2, "thayim", None)], "locality_id long, canonical_name string, aliases array<string>")
    seen, mine = [], buildings._mined
    monkeypatch.setattr(buildings, "_mined", lambda triples, *a: (seen.append((triples.count(), triples.distinct().count())), mine(triples, *a))[1])
    got = buildings.same_building(spark.createDataFrame(rows, "row_id long, address string"), evidence, loc).collect()
    assert sorted(map(tuple, got)) == [(2, 1), (2, 3), (12, 4), (1002, 1), (1002, 3), (1012, 4)]
    # the ward makes another form of an address and no other evidence
    assert len(seen) > 1 and all(a == b for a, b in seen)
