"""Addresses of one building written differently, by mined rewrites.

Addresses are taken apart into street, house number, ward, postcode and place words. A rewrite replaces a rare word by a frequent one of the same role. Candidates look alike (one letter more, less, other
or swapped, twice at most) or abbreviate (the beginning of the word or of its consonants, down to its initial, or the consonants); they are kept if they are found in addresses that agree elsewhere (the same
number and place for a street, the same street and number for a place) more often than chance allows. Addresses are then rewritten and matched again,
as rewritten streets make more places agree and the other way round, until no new rewrite appears.

Where no word says what the street is, each word beside a number may be it; that word is taken which the surely read addresses use for streets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milap.llm.addresses import other_readings, parse_address
from milap.llm.names import _OTHER, _dropped
from milap.session import release, stage


def address_parts(rows: DataFrame) -> DataFrame:
    """``(side, id, address)`` -> ``(side, id, squeezed, street, number, ward, post, places, sure)`` of addresses with street and number.

    An address in which no word is marked as the street has one row with ``sure`` false for each word that may be.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["side", "id", "squeezed", "street", "number", "ward", "post", "places", "sure"]
        for b in batches:
            out = []
            for side, i, a in zip(b.column("side").to_pylist(), b.column("id").to_pylist(), b.column("address").to_pylist(), strict=True):
                read = parse_address(a)
                if read[0] and read[1]:
                    out.append((side, i, _OTHER.sub("", a.lower()), *read, True))
                else:
                    out += ((side, i, _OTHER.sub("", a.lower()), *r, False) for r in other_readings(a))
            if out:
                kinds = [pa.int8(), pa.int64(), *[pa.string()] * 5, pa.list_(pa.string()), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.where("address is not null and address <> ''").select("side", "id", "address").mapInArrow(parse, "side byte, id long, squeezed string, street string, number string, ward string, post string, places array<string>, sure boolean")


def chosen_readings(parts: DataFrame, seen: int = 5) -> DataFrame:
    """``parts`` with the sure rows, and of the others those whose word the sure ones use for streets, at least ``seen`` times and more often than for places, if that leaves one street and number."""
    sure = parts.where("sure")
    use = sure.select(F.col("street").alias("w"), F.lit(1).alias("s")).unionByName(sure.select(F.explode("places").alias("w"), F.lit(-1).alias("s")))
    streets = use.groupBy("w").agg(F.sum("s").alias("s"), F.count(F.when(F.col("s") > 0, 1)).alias("n")).where((F.col("s") > 0) & (F.col("n") >= seen)).select(F.col("w").alias("street"))
    maybe = stage(parts.where("not sure").join(streets, "street"), "maybe")
    one = maybe.groupBy("squeezed").agg(F.min(F.struct("street", "number")).alias("lo"), F.max(F.struct("street", "number")).alias("hi")).where("lo = hi").select("squeezed")
    return sure.unionByName(maybe.join(one, "squeezed").select(*parts.columns))


def _triples(forms: DataFrame) -> DataFrame:
    """``(street, number, place)`` of ``(street, number, places)``, each once."""
    return forms.select("street", "number", F.explode("places").alias("place")).distinct()


def _uses(triples: DataFrame) -> DataFrame:
    """``(role, word, context)``: each word and what the rest of its address says."""
    use = lambda role, word, *rest: F.struct(F.lit(role).alias("role"), F.col(word).alias("word"), F.xxhash64(*rest).alias("context"))
    return triples.select(F.explode(F.array(use("street", "street", "number", "place"), use("place", "place", "number", "street"))).alias("x")).select("x.*")


def mine_rewrites(forms: DataFrame, alpha: float = 0.01, ratio: float = 4.0) -> DataFrame:
    """``(role, word, better)``: significant rewrites among ``(street, number, places)``, of words of any length; no ``better`` is itself rewritten."""
    return _mined(_triples(forms), alpha, ratio)


def _mined(triples: DataFrame, alpha: float = 0.01, ratio: float = 4.0) -> DataFrame:
    """``mine_rewrites`` among ``(street, number, place)`` that are each there once.

    With k shared contexts, n contexts of the rare word, the share p of contexts that hold the frequent one, and the share q of all pairs
    of words that look alike (or abbreviate), chance gives n p q such words in shared contexts; Poisson's bound on k or more of these must be under ``alpha``.
    The frequent word has at least ``ratio`` times the contexts of the rare one. Of several, the nearest, then the most shared, then the smaller wins; abbreviations come last and need two shared contexts.
    """
    uses = stage(_uses(triples), "uses")
    words = stage(uses.groupBy("role", "word").agg(F.count("*").alias("n")), "words")
    total = {r["role"]: (r["v"], r["c"]) for r in words.groupBy("role").agg(F.count("*").alias("v"), F.sum("n").alias("c")).collect()}
    # one letter dropped, of the word or of its consonants: a letter typed into a long vowel, which is one letter by sound, makes two more
    consonants = F.regexp_replace("word", "[aeiou]", "")
    bare = F.concat(F.lit("-"), consonants)
    near = F.concat(_dropped(F.col("word")), F.when(F.length(bare) > 3, _dropped(bare)).otherwise(F.array(bare)))
    keys = words.where("length(word) >= 4").select("role", "word", "n", F.explode(F.array_distinct(near)).alias("key")).where("length(key) > 2")
    side = lambda df, w, m: df.select("role", "key", F.col("word").alias(w), F.col("n").alias(m))
    often = (F.col("m") >= ratio * F.col("n")) & (F.col("word") != F.col("better"))
    alike = side(keys, "word", "n").join(side(keys, "better", "m"), ["role", "key"]).where(often).select("role", "word", "n", "better", "m").distinct().withColumn("far", F.levenshtein("word", "better")).where("far <= 2")
    # abbreviations: what a word may be cut down to, from its initial to all but a letter, with or without its vowels
    begins = lambda x: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: i < F.length("word")), lambda i: F.substring(x, F.lit(1), i))
    cut = words.where("length(word) >= 4").select("role", "word", "n", F.explode(F.array_distinct(F.concat(begins(F.col("word")), begins(F.concat(F.substring("word", 1, 1), F.regexp_replace(F.substring("word", 2, 400), "[aeiou]", "")))))).alias("key"))
    short = side(words.withColumn("key", F.col("word")), "word", "n").join(side(cut, "better", "m"), ["role", "key"]).where(often).select("role", "word", "n", "better", "m").distinct().withColumn("far", F.lit(3))
    pairs = stage(alike.unionByName(short.join(alike.select("role", "word", "better"), ["role", "word", "better"], "left_anti")), "pairs")
    share = {(r["role"], r["cut"]): r["c"] for r in pairs.groupBy("role", (F.col("far") == 3).alias("cut")).agg(F.count("*").alias("c")).collect()}
    shared = pairs.join(uses, ["role", "word"]).join(uses.withColumnRenamed("word", "better"), ["role", "better", "context"]).groupBy("role", "word", "better", "n", "m", "far").agg(F.count("*").alias("k"))
    chance = F.lit(0.0)
    for role, (v, c) in total.items():
        for is_cut in (False, True):
            q = share.get((role, is_cut), 0) / max(1.0, v * (v - 1) / 2.0)
            chance = F.when((F.col("role") == role) & ((F.col("far") == 3) == is_cut), F.col("n") * F.col("m") / float(max(1, c)) * q).otherwise(chance)
    # log of k!, by Stirling's series where it doesn't fit into a long
    factorial = F.when(F.col("k") <= 20, F.log(F.factorial(F.least("k", F.lit(20))).cast("double"))).otherwise(F.col("k") * F.log(F.col("k")) - F.col("k") + F.log(2 * math.pi * F.col("k")) / 2 + 1 / (12 * F.col("k")))
    kept = shared.withColumn("tail", F.col("k") * F.log(chance + 1e-300) - factorial).where((F.col("tail") < math.log(alpha)) & ((F.col("far") < 3) | (F.col("k") > 1)))
    best = kept.groupBy("role", "word").agg(F.min(F.struct("far", (-F.col("k")).alias("k"), "better")).alias("b")).select("role", "word", F.col("b.better").alias("better"))
    # a word that is rewritten itself hands on its own rewrite; ratio > 1 rules out circles, and each hop doubles the way
    best = stage(best, "best")
    for _ in range(64):
        again = best.select("role", F.col("word").alias("better"), F.col("better").alias("last"))
        best = stage(best.join(again, ["role", "better"], "left").select("role", "word", F.coalesce("last", "better").alias("better"), F.col("last").isNotNull().alias("moved")), "best")
        if not best.where("moved").limit(1).count():
            return best.drop("moved")
        best = best.drop("moved")
    raise RuntimeError("rewrites go in circles")


def rewritten(forms: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Streets and places of ``forms`` with the rewrites applied."""
    streets = rewrites.where("role = 'street'").select(F.col("word").alias("street"), F.col("better").alias("_street"))
    places = rewrites.where("role = 'place'").select(F.col("word").alias("place"), F.col("better").alias("_place"))
    out = forms.join(streets, "street", "left").withColumn("street", F.coalesce("_street", "street")).drop("_street")
    wide = out.select("form", F.posexplode("places").alias("at", "place")).join(places, "place").groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("at", "_place"))).alias("_new"))
    return out.join(wide, "form", "left").withColumn("places", F.when(F.col("_new").isNull(), F.col("places")).otherwise(F.transform("places", lambda p, i: F.coalesce(F.element_at("_new", i), p)))).drop("_new")


def all_rewrites(forms: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(role, word, better)``: rewrites of ``(street, number, places)`` mined until no new one appears, each word's with what becomes of it later. ``RuntimeError`` if they still appear after ``max_rounds``."""
    triples, known = stage(_triples(forms), "triples"), None
    for _ in range(max_rounds):
        found = stage(_mined(triples), "rewrites")
        if not found.limit(1).count():
            release(triples)
            return found if known is None else known
        if known is None:
            known = found
        else:
            # what was rewritten before is in no address any more, but what it became may be
            again = found.select("role", F.col("word").alias("better"), F.col("better").alias("last"))
            known = stage(known.join(again, ["role", "better"], "left").select("role", "word", F.coalesce("last", "better").alias("better")).unionByName(found), "known")
        of = lambda role: found.where(F.col("role") == role).select(F.col("word").alias(role), F.col("better").alias(f"_{role}"))  # noqa: E731, B023
        before, triples = triples, triples.join(of("street"), "street", "left").join(of("place"), "place", "left").select(F.coalesce("_street", "street").alias("street"), "number", F.coalesce("_place", "place").alias("place"))
        triples = stage(triples.distinct(), "triples")
        release(before)
    raise RuntimeError(f"new rewrites appear after {max_rounds} rounds")


def located(forms: DataFrame, registry: DataFrame) -> DataFrame:
    """``forms`` with ``place``, the locality, and the places' first word: by its name, else by town and ward, else by postcode.

    ``registry``: ``(alias, locality)`` with aliases as words by sound, "town ward" or a postcode. Where the registry knows nothing, ``place`` is null.
    """
    key = lambda rank, c: F.struct(F.lit(rank).alias("rank"), c.alias("alias"))
    keys = F.concat(F.transform("places", lambda p: key(1, p)), F.when(F.col("ward") != "", F.transform("places", lambda p: key(2, F.concat_ws(" ", p, "ward")))).otherwise(F.array().cast("array<struct<rank:int,alias:string>>")), F.when(F.col("post") != "", F.array(key(3, F.col("post")))).otherwise(F.array().cast("array<struct<rank:int,alias:string>>")))
    hits = forms.select("form", F.explode(keys).alias("k")).select("form", "k.rank", "k.alias").join(registry, "alias")
    # two localities by equally good signs decide nothing
    best = hits.groupBy("form", "rank").agg(F.min("locality").alias("lo"), F.max("locality").alias("hi")).groupBy("form").agg(F.min(F.struct("rank", "lo", "hi")).alias("b"))
    return forms.join(best.where("b.lo = b.hi").select("form", F.col("b.lo").alias("place")), "form", "left")


def registry_aliases(localities: DataFrame) -> DataFrame:
    """``(alias, locality)`` of the registry of localities, aliases by sound; an alias of several localities is left out."""
    from milap.llm.forms import plain_text, sound

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, name, aliases in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for a in {name, *(aliases or [])} - {None, ""}:
                    w = plain_text(a).replace("-", " ").split()
                    out.append((" ".join(x.lstrip("0") if x.isdigit() and len(x) < 5 else sound(x) for x in w if x != "new"), i))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["alias", "locality"])

    out = localities.where("locality_id is not null").select("locality_id", "canonical_name", "aliases").mapInArrow(spelt, "alias string, locality long")
    return out.groupBy("alias").agg(F.min("locality").alias("locality"), F.max("locality").alias("hi")).where("locality = hi and alias <> ''").select("alias", "locality")


def _righted(forms: DataFrame, seen: int = 5) -> DataFrame:
    """``forms`` where a word that mostly names places stands for the street, and one that mostly names streets among the places, with the two exchanged."""
    use = forms.select(F.col("street").alias("w"), F.lit(1).alias("s"), F.lit(0).alias("p")).unionByName(forms.select(F.explode("places").alias("w"), F.lit(0).alias("s"), F.lit(1).alias("p")))
    kind = stage(use.groupBy("w").agg(F.sum("s").alias("s"), F.sum("p").alias("p")).where(F.col("s") + F.col("p") >= seen), "kinds")
    odd = forms.join(kind.where("p > s").select(F.col("w").alias("street")), "street", "left_semi").select("form", F.explode("places").alias("w")).join(kind.where("s > p"), "w").groupBy("form").agg(F.max_by("w", F.struct("s", "w")).alias("_street"))
    out = forms.join(odd, "form", "left")
    return out.withColumn("places", F.when(F.col("_street").isNull(), F.col("places")).otherwise(F.concat(F.array("street"), F.array_remove("places", F.col("_street"))))).withColumn("street", F.coalesce("_street", "street")).drop("_street")


def building_keys(rows: DataFrame, localities: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(side, id, squeezed, building)`` of ``(side, id, address)`` rows whose address names street, number and a place that is known.

    Addresses without a locality are placed by their town if only one of the town's localities has that street and number. Null, empty and placeholder
    addresses, and those without street or house number, have no building. Ids need not be unique. ``RuntimeError`` if rewrites still appear after ``max_rounds``.
    """
    read = stage(address_parts(rows), "read")
    parts = stage(chosen_readings(read).drop("sure").withColumn("form", F.xxhash64("street", "number", "ward", "post", "places")), "parts")
    first = stage(parts.select("form", "street", "number", "ward", "post", "places").distinct(), "forms")
    rewrites = stage(all_rewrites(first.select("street", "number", "places"), max_rounds), "rewrites")
    forms = stage(rewritten(first, rewrites), "forms")
    release(first)
    registry = stage(registry_aliases(localities), "registry")
    placed = stage(located(_righted(forms), registry), "placed")
    sure = placed.where("place is not null").select("form", F.xxhash64("street", "number", "place").alias("building"))
    # by town: the words beside the locality's in placed addresses
    known = placed.where("place is not null").select("street", "number", F.explode("places").alias("town"), "place").distinct().groupBy("street", "number", "town").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    guess = placed.where("place is null").select("form", "street", "number", F.explode("places").alias("town")).join(known.where("lo = hi"), ["street", "number", "town"]).groupBy("form").agg(F.first("street").alias("street"), F.first("number").alias("number"), F.min("lo").alias("lo"), F.max("lo").alias("hi"))
    both = sure.unionByName(guess.where("lo = hi").select("form", F.xxhash64("street", "number", "lo").alias("building")))
    return parts.select("side", "id", "squeezed", "form").join(both, "form").select("side", "id", "squeezed", "building")


def same_building(places: DataFrame, evidence: DataFrame, localities: DataFrame) -> DataFrame:
    """``(row_id, evidence_id)`` whose addresses denote one building and differ even when squeezed to letters and digits."""
    side = lambda df, n, c: df.where(F.col(c).isNotNull()).select(F.lit(n).cast("byte").alias("side"), F.col(c).alias("id"), "address")
    keys = stage(building_keys(side(places, 0, "row_id").unionByName(side(evidence, 1, "evidence_id")), localities), "keys")
    a = keys.where("side = 0").select(F.col("id").alias("row_id"), "building", F.col("squeezed").alias("sa"))
    b = keys.where("side = 1").select(F.col("id").alias("evidence_id"), "building", F.col("squeezed").alias("sb")).distinct()
    return a.join(b, "building").where("sa <> sb").select("row_id", "evidence_id").distinct()
