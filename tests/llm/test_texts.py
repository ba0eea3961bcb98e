"""Leaks, mixes and reading levels on small fixtures."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from milap.llm import leaks, levels, mixing


def test_fm_index_against_brute_force():
    rng = random.Random(2)
    for sigma, n in ((2, 60), (5, 300), (40, 500)):
        seq = [rng.randint(1, sigma) for _ in range(n)]
        index = leaks.FMIndex(np.array(seq), sample=4)
        for m in (1, 2, 3, 4):
            pats = [[rng.randint(1, sigma) for _ in range(m)] for _ in range(20)] + [seq[:m], seq[-m:], [-1] * m, [sigma + 5] * m]
            lo, hi = index.search(np.array(pats))
            for p, a, b in zip(pats, lo, hi, strict=True):
                assert sorted(index.locate(np.arange(a, b))) == [i for i in range(n - m + 1) if seq[i : i + m] == p]


ITEM = "Although the careful farmer at Miyel borrowed a yellow ladder, the baker on the corner quietly counted seven wooden spoons before the rain arrived in the valley that evening."


def test_leaks(spark):
    w = ITEM.split()
    filler = "one two three four five six seven eight nine ten eleven twelve "
    docs = spark.createDataFrame([
        (1, filler + ITEM + " " + filler), (2, filler + " ".join(w[:17])), (3, filler + " ".join(w[:6])), (4, (filler + " ".join(w[4:27])).upper().replace(" ", "  ​")), (5, None), (6, ""), (7, ITEM), (8, filler * 3000 + ITEM + filler * 3000), (9, " ".join(w[i] for i in random.Random(1).sample(range(len(w)), len(w)))),
    ], "doc_id long, text string")
    items = spark.createDataFrame([(50, ITEM), (51, ""), (52, None), (53, "too short here")], "item_id long, text string")
    got = leaks.find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 50), (2, 50), (4, 50), (7, 50), (8, 50)]
    span = {r.doc_id: (r.start_word, r.end_word) for r in got}
    assert span[1] == (12, 12 + len(w)) and span[8][0] == 36000
    assert {r.doc_id for r in leaks.find_leaks(docs, items, shard_words=500).collect()} == {1, 2, 4, 7, 8}
    assert leaks.find_leaks(docs.limit(0), items).count() == 0 and leaks.find_leaks(docs, items.limit(0)).count() == 0


def test_short_items_and_items_of_stock_phrases(spark):
    docs = spark.createDataFrame([(1, "say hello big world again"), (2, "hello world"), (3, "choose the best answer from the list below"), (4, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Hello, big world!"), (2, "choose the best answer from the list"), (3, "choose the best answer from the list"), (4, "choose the best answer from the list"), (5, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_word, r.end_word) for r in leaks.find_leaks(docs, items).collect())
    # three copies of one item don't make its phrases stock
    assert got == [(1, 1, 1, 4), (3, 2, 0, 7), (3, 3, 0, 7), (3, 4, 0, 7)]


def test_every_copy_is_a_span(spark):
    n, filler = len(ITEM.split()), "one two three four five six seven eight nine ten eleven twelve "
    docs = spark.createDataFrame([(1, filler + ITEM + " " + filler + ITEM + " " + filler * 100 + ITEM), (2, ITEM + " " + ITEM), (3, filler * 20 + ITEM + " " + filler * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(50, ITEM)], "item_id long, text string")
    for shard in (400_000, 30):
        got = sorted((r.doc_id, r.start_word, r.end_word, r.covered) for r in leaks.find_leaks(docs, items, shard_words=shard).collect())
        assert got == [(1, 12, 12 + n, n), (1, 24 + n, 24 + 2 * n, n), (1, 1224 + 2 * n, 1224 + 3 * n, n), (2, 0, n, n), (2, n, 2 * n, n), (3, 240, 240 + n, n)]


def test_leaf_budgets_hand_shortages_to_siblings_first():
    targets = pd.DataFrame({"source": ["a", "b", "c", "d"], "target_share": [0.4, 0.2, 0.2, 0.2], "max_repeats": [1, 3, 3, 3]})
    supply = pd.DataFrame({"source": ["a", "b", "c"], "domain": ["x", "x", "y"], "language": ["en", "en", "en"], "tokens": [10, 100, 100]})
    r = mixing.leaf_budgets(targets, supply, 100.0).set_index("source").budget
    # a holds 10 of 40, its sibling b takes the other 30; d has no documents, its 20 go to b and c by weight
    assert np.allclose(r[["a", "b", "c", "d"]], [10, 60, 30, 0])


def test_a_source_has_a_leaf_for_each_domain_and_language():
    targets = pd.DataFrame({"source": ["a", "b", "c"], "target_share": [0.5, 0.3, 0.2], "max_repeats": [1, 9, 9]})
    supply = pd.DataFrame({"source": ["a", "a", "b", "c"], "domain": ["x", "y", "x", "y"], "language": ["en", "ne", "en", "en"], "tokens": [30, 10, 100, 100]})
    r = mixing.leaf_budgets(targets, supply, 100.0).set_index(["source", "domain"])
    # a's 50 are wanted 3 to 1 of its leaves, which hold 30 and 10; the rest of the first goes to b in x, that of the second to c in y
    assert np.allclose(r.wanted, [37.5, 12.5, 30, 20]) and np.allclose(r.budget, [30, 10, 37.5, 22.5])


def test_draw_reaches_budgets(spark):
    rng = random.Random(8)
    docs = [(i, "s" if i % 3 else "t", rng.randint(1, 50)) for i in range(900)] + [(1000, None, 5), (1001, "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("page_type", F.lit(None).cast("string")).withColumn("lang", F.lit("en"))
    total = {s: sum(n for _, x, n in docs if x == s) for s in "st"}
    plan = spark.createDataFrame([(1, "s", 0.5 * total["s"], float(total["s"]), 2), (1, "t", 2.5 * total["t"], float(total["t"]), 3), (2, "t", 3.0 * total["t"], float(total["t"]), 3)], "mix_id int, source string, budget double, tokens double, max_repeats int").withColumn("domain", F.lit("")).withColumn("language", F.lit("en"))
    got = mixing.draw(df, plan).join(df.drop("source"), "doc_id").groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n"), F.max("copies").alias("c")).collect()
    by = {(r.mix_id, r.source): (r.n, r.c) for r in got}
    assert 0 <= by[1, "s"][0] - 0.5 * total["s"] < 50 and by[1, "s"][1] == 1
    assert 0 <= by[1, "t"][0] - 2.5 * total["t"] < 50 and by[1, "t"][1] == 3
    assert by[2, "t"] == (3 * total["t"], 3)
    assert sorted(map(tuple, mixing.draw(df, plan).collect())) == sorted(map(tuple, mixing.draw(df.repartition(5), plan).collect()))


def test_count_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a" * 20000)], "id long, text string")
    n = {r.id: r.n_tokens for r in mixing.count_tokens(df, "text").collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 100


def test_levels_on_held_out_documents(spark):
    rng = random.Random(9)
    vocabulary = [[f"w{'abcdefghij'[k]}{'abcdefghijklmnopqrstuvwxyz'[j]}" for j in range(26)] for k in range(5)]
    common = "the of and to in is that for".split()
    docs, level = [], {}
    for i in range(400):
        level[i] = 1 + i % 5
        near = [level[i] - 1] * 6 + [max(0, level[i] - 2), min(4, level[i])]
        docs.append((i, " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary[rng.choice(near)]) for _ in range(80))))
    docs += [(900, None), (901, ""), (902, "नमस्ते " * 50), (903, "phone 123")]
    labels = spark.createDataFrame([(i, "r", level[i]) for i in range(0, 400, 2)] + [(1, "r", None), (None, "r", 3)], "doc_id long, rater string, level int")
    got = {r.doc_id: r.level for r in levels.reading_levels(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()}
    held = [i for i in range(1, 400, 2)]
    assert set(got) == set(range(400)) and sum(got[i] == level[i] for i in held) / len(held) > 0.9
    assert levels.reading_levels(spark.createDataFrame(docs, "doc_id long, text string"), labels.limit(0)).count() == 0


def test_mix_plan_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", 60, "en", "blog"), (2, "b", 40, None, None), (3, None, 999, "en", "x"), (4, "b", 0, "en", None)], "doc_id long, source string, n_tokens long, lang string, page_type string")
    targets = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.1, 2), (1, "b", 0.05, 1), (2, "zz", 1.0, 5), (None, "a", 1.0, 1), (3, "a", None, None)], "mix_id int, source string, target_share double, max_repeats int")
    got = {(r.mix_id, r.source): (r.short, round(r.budget)) for r in mixing.of_sources(mixing.mix_plan(docs, targets)).collect()}
    assert got == {(1, "a"): (True, 60), (1, "b"): (False, 40), (2, "zz"): (True, 0), (3, "a"): (False, 0)}
    assert mixing.mix_plan(docs, targets.limit(0)).count() == 0
    assert {r.source: r.budget for r in mixing.mix_plan(docs.limit(0), targets).collect()}["zz"] == 0
