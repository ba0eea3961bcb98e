"""Variant spellings of names, by merge-and-rematch.

Records of one listing key are one profile from the start; a profile holds all its spellings, initials and contacts. Names that state two brand words and a trade (full forms) join the profile of the
same form, and profiles whose full forms differ by a typo in one word, or by a nickname for one, merge. Then what is left is blocked against the profiles by everything a spelling can turn into: each two of the words, one letter dropped
from a word (which finds any single typo and swap), an initial, a nickname, words run together, no trade. A name joins a profile if it is the only one at the best kind of key. Each merge adds its spellings and
initials to the profile, and what is still left is matched again with the new spellings only, until nothing more merges. Names that meet no profile are profiles themselves, whatever they are made of, and merge
among each other. Names that several profiles fit are decided by a shared phone or host, if a brand word agrees; a spelling that was unknown until then is blocked again. Profiles that one listing key joins are one.

All blocking keys hold two brand words in some form, or one with the trade, so a word that a third of all names share makes no large block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from milap import session
from milap.llm.forms import parse_name
from milap.llm.survivor import host_text
from milap.session import release

#: Plans that read at most so many bytes are light.
LIGHT = 1 << 21
stage = partial(session.stage, light=LIGHT)

_OTHER = re.compile(r"[^a-z0-9]")


def parsed(rows: DataFrame) -> DataFrame:
    """``(id, owner, name)`` -> ``(id, owner, words, trade, squeezed, form)``; names that mean nothing are dropped.

    ``words`` are the brand words by sound, ``form`` a hash of their set and the trade, ``squeezed`` one of the name's letters and digits.
    """
    known: dict = {}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, trades, squeezed = [], [], []
            for n in b.column("name").to_pylist():
                if n not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[n] = (*parse_name(n), xxhash.xxh64_intdigest(_OTHER.sub("", n.lower())) - (1 << 63))
                w, t, s = known[n]
                words.append(w)
                trades.append(t)
                squeezed.append(s)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("owner"), pa.array(words, pa.list_(pa.string())), pa.array(trades, pa.string()), pa.array(squeezed, pa.int64())], ["id", "owner", "words", "trade", "squeezed"])

    out = rows.select("id", "owner", "name").where("name is not null").mapInArrow(parse, "id long, owner long, words array<string>, trade string, squeezed long")
    return out.where("exists(words, w -> length(w) > 1)").withColumn("form", F.xxhash64("trade", F.array_sort("words")))


def _is_full() -> Column:
    return (F.size("words") == 2) & F.forall("words", lambda w: F.length(w) > 1) & (F.col("trade") != "")


def _dropped(x: Column) -> Column:
    """The word, and the word with each letter dropped once, as one array."""
    return F.concat(F.array(x), F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(400)))))


def _key(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def _run_together(a: Column, b: Column) -> Column:
    return F.regexp_replace(F.concat(a, b), r"(.)\1+", "$1")


#: Words of a name are taken together if they are at most so many words apart.
REACH = 12


def _twos(words: Column) -> Column:
    """Each two words at most ``REACH`` apart, both ways round, as an array of structs ``(x, y, at)``; ``at`` is 1 for the first two, 2 for others."""
    n = F.size(words)
    one_way = F.flatten(F.transform(words, lambda x, i: F.transform(F.slice(words, i + 2, F.lit(REACH)), lambda y, j: F.struct(x.alias("x"), y.alias("y"), F.when(i + j == 0, 1).otherwise(2).alias("at"), (j == 0).alias("next")))))
    none = F.filter(F.array(F.struct(F.lit("").alias("x"), F.lit("").alias("y"), F.lit(1).alias("at"), F.lit(True).alias("next"))), lambda z: F.lit(False))
    return F.when(n >= 2, F.concat(one_way, F.transform(one_way, lambda z: F.struct(z["y"].alias("x"), z["x"].alias("y"), z["at"].alias("at"), z["next"].alias("next"))))).otherwise(none)


def _split(forms: DataFrame) -> DataFrame:
    forms = forms.withColumn("long", F.filter("words", lambda w: F.length(w) > 1)).withColumn("short", F.filter("words", lambda w: F.length(w) == 1))
    return forms.withColumn("two", _twos(F.col("long")))


def typo_keys(full: DataFrame, to: str = "entity") -> DataFrame:
    """``(key, to)`` of forms with two words or more: one word, and another without any one letter."""
    return _split(full).select(to, F.explode(F.array_distinct(F.flatten(F.transform("two", lambda z: F.transform(_dropped(z["x"]), lambda v: _key("typo", z["y"], F.col("trade"), v)))))).alias("key"))


def nick_keys(z: Column, trade: Column, long: bool) -> Column:
    """Keys of a word beside another that stays: as a nickname, which is the beginning of a word and another vowel, or as a word that a nickname of three to six letters and a vowel may stand for."""
    if not long:
        return F.when((F.length(z["x"]) >= 4) & z["x"].rlike("[aeiou]$"), F.array(_key("nick", F.substring(z["x"], F.lit(1), F.length(z["x"]) - 1), z["y"], trade))).otherwise(F.array().cast("array<long>"))
    ends = F.filter(F.array(*map(F.lit, (3, 4, 5, 6))), lambda n: n <= F.length(z["x"]) - 2)
    return F.transform(ends, lambda n: _key("nick", F.substring(z["x"], F.lit(1), n), z["y"], trade))


def is_nick(x: Column, y: Column) -> Column:
    """Is one of the two words a nickname of the other."""
    one = lambda a, b: (F.length(a) >= 4) & a.rlike("[aeiou]$") & (F.length(b) > F.length(a)) & F.startswith(b, F.substring(a, F.lit(1), F.length(a) - 1))
    return one(x, y) | one(y, x)


def profile_keys(spellings: DataFrame) -> DataFrame:
    """Every key under which spellings ``(entity, words, trade)`` may be found: ``(key, entity)``. Spellings without a trade are found without it only."""
    trades = F.array_distinct(F.array("trade", F.lit("")))
    each = lambda f: F.flatten(F.transform(trades, f))
    first = lambda x: F.substring(x, 1, 1)
    keys = F.concat(
        each(lambda t: F.transform("two", lambda z: _key("pair", F.least(z["x"], z["y"]), F.greatest(z["x"], z["y"]), t))),
        each(lambda t: F.transform("two", lambda z: _key("initial", z["x"], first(z["y"]), t))),
        each(lambda t: F.flatten(F.transform("long", lambda x: F.transform("short", lambda y: _key("initial", x, y, t))))),
        each(lambda t: F.transform(F.filter("two", lambda z: z["next"]), lambda z: _key("run", _run_together(z["x"], z["y"]), t))),
        F.when(F.col("trade") != "", F.flatten(F.transform("two", lambda z: F.transform(_dropped(z["x"]), lambda v: _key("typo", z["y"], F.col("trade"), v))))).otherwise(F.array().cast("array<long>")),
        F.when((F.size("long") == 1) & (F.size("short") == 0) & (F.col("trade") != ""), F.transform(_dropped(F.col("long")[0]), lambda v: _key("one", v, F.col("trade")))).otherwise(F.array().cast("array<long>")),
        F.when(F.col("trade") != "", F.flatten(F.transform("two", lambda z: nick_keys(z, F.col("trade"), True)))).otherwise(F.array().cast("array<long>")),
    )
    return _split(spellings).select("entity", F.explode(F.array_distinct(keys)).alias("key"))


def name_keys(forms: DataFrame) -> DataFrame:
    """Keys to look for, of forms ``(form, words, trade)``: ``(form, rank, key)``; a lower rank is the surer kind of key.

    A name without a trade is looked for without it; one with a trade only with it.
    """
    t = F.col("trade")
    found = lambda rank, keys: F.transform(keys, lambda k: F.struct(F.lit(rank).alias("rank"), k.alias("key")))
    none = F.array().cast("array<long>")
    pairs = F.transform("two", lambda z: F.struct(z["at"].alias("rank"), _key("pair", F.least(z["x"], z["y"]), F.greatest(z["x"], z["y"]), t).alias("key")))
    run = F.transform(F.filter("long", lambda w: F.length(w) >= 6), lambda w: _key("run", w, t))
    initial = F.flatten(F.transform("long", lambda w: F.transform("short", lambda i: _key("initial", w, i, t))))
    typo = F.when(t != "", F.flatten(F.transform("two", lambda z: F.transform(_dropped(z["x"]), lambda v: _key("typo", z["y"], t, v))))).otherwise(none)
    one = F.when((F.size("long") == 1) & (F.size("short") == 0) & (t != ""), F.transform(_dropped(F.col("long")[0]), lambda v: _key("one", v, t))).otherwise(none)
    nick = F.when(t != "", F.flatten(F.transform("two", lambda z: nick_keys(z, t, False)))).otherwise(none)
    return _split(forms).select("form", F.explode(F.array_distinct(F.concat(pairs, found(3, run), found(4, typo), found(5, initial), found(6, one), found(7, nick)))).alias("k")).select("form", "k.rank", "k.key")


def _met(sought: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates ``(form, rank, entity)`` of ``(form, rank, key)`` against ``(key, entity)``."""
    return sought.join(index, "key").groupBy("form", "entity").agg(F.min("rank").alias("rank")).select("form", "rank", "entity")


def _decided(candidates: DataFrame) -> DataFrame:
    """The forms that have one entity at their best rank."""
    ranked = candidates.groupBy("form", "rank").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))
    top = ranked.groupBy("form").agg(F.min(F.struct("rank", "lo", "hi")).alias("b"))
    return top.where("b.lo = b.hi").select("form", F.col("b.lo").alias("entity"))


def _near(x: Column, y: Column) -> Column:
    """Is ``x`` a misspelling of the brand word ``y``."""
    return F.levenshtein(x, y) <= F.when(F.length(y) >= 6, 2).otherwise(1)


#: Base of the words' hashes, which are polynomials of their letters.
_BASE = 0x9E3779B97F4A7C15


def _left_of(words: list[str], twice: int) -> list[np.ndarray]:
    """Hashes of each word, and of what is left of it without any one letter, or any two if it has ``twice`` letters."""
    out: list = [None] * len(words)
    by_length: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by_length.setdefault(len(w), []).append(at)
    for n, ats in by_length.items():
        letters = np.array([words[at] for at in ats], f"U{max(1, n)}").view(np.uint32).reshape(len(ats), -1)[:, :n].astype(np.uint64) + np.uint64(1)
        power = np.array([pow(_BASE, k, 1 << 64) for k in range(n + 1)], np.uint64)
        begun = np.zeros((n + 1, len(ats)), np.uint64)
        for k in range(n):
            begun[k + 1] = begun[k] * power[1] + letters[:, k]
        end = [begun[n] - begun[k] * power[n - k] for k in range(n + 1)]
        left = [begun[n], *(begun[i] * power[n - 1 - i] + end[i + 1] for i in range(n))]
        if n >= twice:
            for i in range(n):
                for j in range(i + 1, n):
                    left.append((begun[i] * power[j - i - 1] + begun[j] - begun[i + 1] * power[j - i - 1]) * power[n - 1 - j] + end[j + 1])
        for at, x in zip(ats, np.stack(left, 1).view(np.int64), strict=True):
            out[at] = x
    return out


def _cuts(words: DataFrame, twice: int) -> DataFrame:
    """``(word)`` -> ``(word, k)``: hashes of the word, and of what is left of it without any one letter, or any two if it has ``twice`` letters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = _left_of(b.column(0).to_pylist(), twice)
            if left:
                ends = np.cumsum([0, *map(len, left)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(left)))], ["word", "cuts"])

    return words.toDF("word").mapInArrow(work, "word string, cuts array<long>").select("word", F.explode("cuts").alias("k"))


def _near_words(asked: DataFrame, known: DataFrame) -> DataFrame:
    """All ``(w, y)`` of the distinct words ``asked`` and ``known`` that are near: words within an edit distance share what is left of them without so many letters."""
    w, y = _cuts(asked.select("w"), 4).withColumnRenamed("word", "w"), _cuts(known.select("y"), 6).withColumnRenamed("word", "y")
    return w.join(y, "k").where(_near(F.col("w"), F.col("y"))).select("w", "y").distinct()


def _merged(links: DataFrame) -> DataFrame | None:
    """``(node, root)`` of what links ``(x, y)`` put together; None without any."""
    from milap.llm.components import hash_to_min

    links = stage(links.where("x <> y").distinct(), "links")
    roots = stage(hash_to_min(links, "x", "y", light=LIGHT).select("node", F.col("group_id").alias("root")), "roots") if not links.isEmpty() else None
    release(links)
    return roots


def _rooted(df: DataFrame, roots: DataFrame | None, c: str = "entity") -> DataFrame:
    return df if roots is None else df.join(roots.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")


def _blocked(sought: DataFrame, candidates: DataFrame, left_over: DataFrame, done: DataFrame | None, max_rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """Match and rematch until nothing merges: ``(candidates of forms still open, found forms and their entities or None)``. Forms in ``done`` have their entity."""
    known = index = None
    for _ in range(max_rounds):
        candidates = stage(candidates, "candidates")
        if index is not None:
            release(index)
        found = stage(_decided(candidates), "found")
        if found.isEmpty():
            return candidates, known
        known = found if known is None else known.unionByName(found)
        # new spellings and initials re-enter blocking
        index = stage(profile_keys(left_over.join(found, "form").select("words", "trade", "entity")), "index")
        candidates = _open(candidates.unionByName(_met(sought, index)), known.select("form") if done is None else done.unionByName(known.select("form")))
    raise RuntimeError(f"names still merge after {max_rounds} rounds")


def _open(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Each form and entity once, without the forms that are done."""
    return candidates.join(done, "form", "left_anti").groupBy("form", "entity").agg(F.min("rank").alias("rank")).select("form", "rank", "entity")


def resolve(ours: DataFrame, theirs: DataFrame, left_contacts: DataFrame, right_contacts: DataFrame, max_rounds: int = 60, crowded: int = 20) -> tuple[DataFrame, DataFrame]:
    """Entities of the rows of two tables: ``(owner, entity)`` for the left's owners, ``(id, entity)`` for the right's rows.

    Both are ``parsed``; rows of one owner are known to be one business, the right's owner is not used. Contacts: ``(owner, contact)`` and
    ``(id, contact)``, phones and hosts as strings. A contact of more than ``crowded`` entities is asked by near words, which changes the plan and not the result. Rows whose name means nothing, and rows that nothing decides, are in no result. Repeated rows don't matter.
    ``RuntimeError`` if names still merge after ``max_rounds``.
    """
    left_contacts, right_contacts = stage(left_contacts, "left_contacts"), stage(right_contacts, "right_contacts")
    form = lambda df: df.groupBy("form").agg(F.min("words").alias("words"), F.min("trade").alias("trade"))
    # profiles: owners, and owners that state one and the same full form are one; full forms of the other side that no owner states are profiles too
    full_ours = ours.where(_is_full())
    stated = stage(full_ours.groupBy("form").agg(F.min("owner").alias("entity"), F.max("owner").alias("other"), F.min("words").alias("words"), F.min("trade").alias("trade")), "stated")
    their_forms = stage(form(theirs), "their_forms")
    nodes = stage(stated.select("form", "words", "trade", "entity").unionByName(their_forms.where(_is_full()).join(stated.select("form"), "form", "left_anti").select("form", "words", "trade", F.col("form").alias("entity"))), "nodes")
    # profiles whose full forms differ by a typo merge; of those that share a key all are linked to the smallest
    of_key = Window.partitionBy("key")
    keyed = typo_keys(nodes).repartition("key").select("entity", F.min("entity").over(of_key).alias("lo"))
    near = keyed.where("lo < entity").select(F.col("entity").alias("x"), F.col("lo").alias("y"))
    same = full_ours.select("form", "owner").join(stated.where("entity <> other").select("form", "entity"), "form").select(F.col("owner").alias("x"), F.col("entity").alias("y"))
    roots = _merged(same.unionByName(near))
    full = stage(_rooted(nodes, roots), "full")
    # a nickname beside an equal word joins the profile whose name it may stand for, if that is one
    two = _split(full)
    short = stage(two.select(F.col("entity").alias("x"), F.explode(F.flatten(F.transform("two", lambda z: nick_keys(z, F.col("trade"), False)))).alias("key")), "short")
    meant = two.select("entity", F.explode(F.flatten(F.transform("two", lambda z: nick_keys(z, F.col("trade"), True)))).alias("key")).join(short.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("entity").alias("y"), F.max("entity").alias("hi")).where("y = hi").select("key", "y")
    more = _merged(short.join(meant, "key").select("x", "y"))
    full = full if more is None else stage(_rooted(full, more), "full")
    named = _rooted(full_ours.select("owner").distinct().withColumn("entity", F.col("owner")), roots)
    named = stage(_rooted(named, more), "named")
    release(stated, nodes, short, *(x for x in (roots, more) if x is not None))
    # names of owners without a full form, and the forms that are not full
    weak = stage(ours.join(named.select("owner"), "owner", "left_anti").select("owner", "form", "words", "trade").distinct(), "weak")
    left_over = stage(form(their_forms.where(~_is_full()).unionByName(form(weak))), "left_over")
    release(their_forms)
    # every candidate is met once: what is sought against the profiles' keys, later only against the keys of new spellings
    sought = stage(name_keys(left_over), "sought")
    candidates, known = _blocked(sought, _met(sought, profile_keys(full)), left_over, None, max_rounds)
    by_form = full.select("form", "entity") if known is None else full.select("form", "entity").unionByName(known)
    done = None if known is None else known.select("form")
    their_rows = stage(theirs.select("id", "form").join(by_form, "form", "left"), "their_rows")
    weak_rows = stage(weak.select("owner", "form").join(by_form, "form", "left"), "weak_rows")
    rows = their_rows.where("entity is not null").select("id", "entity")
    owned = named.unionByName(weak_rows.where("entity is not null").select("owner", "entity"))
    spellings = full.select("words", "trade", "entity") if known is None else full.select("words", "trade", "entity").unionByName(left_over.join(known, "form").select("words", "trade", "entity"))
    brands, fresh = stage(_brands(spellings), "brands"), owned
    spoken = [brands]
    # rows of undecided forms that state a contact; those without entity are asked
    waiting = stage(_waiting(their_rows, right_contacts, left_over, False).unionByName(_waiting(weak_rows.withColumnRenamed("owner", "id"), left_contacts.withColumnRenamed("owner", "id"), left_over, True)), "waiting")
    asked = waiting.where("open").select("contact").distinct()
    contact = stage(left_contacts.join(asked, "contact", "left_semi").join(owned, "owner").select("contact", "entity").unionByName(right_contacts.join(asked, "contact", "left_semi").join(rows, "id").select("contact", "entity")).distinct(), "contact")
    release(left_contacts, right_contacts)
    heard_of: dict = {}
    for _ in range(max_rounds):
        # an owner's names may have joined several profiles, which are one then
        apart = owned.join(fresh.select("owner").distinct(), "owner", "left_semi") if fresh is not owned else owned
        apart = stage(apart.groupBy("owner").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi")).where("lo < hi"), "apart")
        if not apart.isEmpty():
            roots = _merged(owned.join(apart.select("owner", "lo"), "owner").select(F.col("entity").alias("x"), F.col("lo").alias("y")))
            before = (contact, *spoken)
            rows, owned, candidates, contact, brands = (stage(_rooted(x, roots), "rooted") for x in (rows, owned, candidates, contact, brands))
            release(*before)
            spoken = [brands]
        one = _by_contacts(waiting.where("open"), contact, brands, crowded, heard_of)
        # a spelling that met no profile, or none that alone fits, is learnt if all rows that contacts decide agree; one that several profiles fit stays open
        open_forms = candidates.select("form").distinct()
        learnt = waiting.where("open").select("ours", "id", "form").distinct().join(one, ["ours", "id"]).groupBy("form").agg(F.min("entity").alias("entity"), F.max("entity").alias("hi")).where("entity = hi")
        learnt = stage(learnt.join(open_forms, "form", "left_anti").select("form", "entity"), "learnt")
        if learnt.isEmpty():
            break
        done = learnt.select("form") if done is None else done.unionByName(learnt.select("form"))
        index = stage(profile_keys(left_over.join(learnt, "form").select("words", "trade", "entity")), "index")
        candidates, known = _blocked(sought, _open(candidates.unionByName(_met(sought, index)), done), left_over, done, max_rounds)
        news = learnt if known is None else stage(learnt.unionByName(known), "news")
        done = done if known is None else done.unionByName(known.select("form"))
        # what the new members are, state and are called
        fresh = stage(weak.select("owner", "form").join(news, "form").select("owner", "entity"), "fresh")
        rows, owned = rows.unionByName(stage(theirs.select("id", "form").join(news, "form").select("id", "entity"), "rows")), owned.unionByName(fresh)
        facts = waiting.join(news, "form")
        before, contact = contact, stage(contact.unionByName(facts.select("contact", "entity")).distinct(), "contact")
        release(before)
        grown = stage(_brands(left_over.join(news, "form").select("words", "trade", "entity")), "brands")
        brands = brands.unionByName(grown)
        spoken.append(grown)
        heard_of["near"] = heard_of["near"].unionByName(session.stage(_near_words(heard_of["words"], _said(grown).select("y").distinct()), "near"))
        taken = facts.select("ours", "id").distinct().withColumn("taken", F.lit(True))
        waiting = stage(waiting.join(news.select("form"), "form", "left_anti").join(taken, ["ours", "id"], "left").withColumn("open", F.col("open") & F.col("taken").isNull()).drop("taken"), "waiting")
        release(index)
    else:
        raise RuntimeError(f"names still merge after {max_rounds} rounds")
    rows = stage(rows.unionByName(one.where("not ours").select("id", "entity")), "rows")
    owned = owned.unionByName(one.where("ours").select(F.col("id").alias("owner"), "entity")).groupBy("owner").agg(F.min("entity").alias("entity"))
    # what meets no profile is one itself, and those merge among each other
    alone = left_over if done is None else left_over.join(done, "form", "left_anti")
    alone = stage(alone.join(open_forms, "form", "left_anti").withColumn("entity", F.col("form")), "alone")
    found = _decided(_met(sought, stage(profile_keys(alone), "index")).join(alone.select("form"), "form", "left_semi").where("form <> entity"))
    alone = stage(_rooted(alone, _merged(found.select(F.col("form").alias("x"), F.col("entity").alias("y")))).select("form", "entity"), "alone")
    release(contact, *spoken)
    rest_rows = theirs.select("id", "form").join(alone, "form").join(rows, "id", "left_anti").select("id", "entity").distinct()
    rest_owners = weak.select("owner", "form").join(alone, "form").join(owned, "owner", "left_anti").groupBy("owner").agg(F.min("entity").alias("entity"))
    return owned.unionByName(rest_owners), rows.unionByName(rest_rows)


def _brands(spellings: DataFrame) -> DataFrame:
    """``(entity, trade, brands)``: the words of spellings ``(entity, words, trade)``, and neighbours run together."""
    return _split(spellings).select("entity", "trade", F.array_distinct(F.concat("long", F.transform(F.filter("two", lambda z: z["next"]), lambda z: _run_together(z["x"], z["y"])))).alias("brands"))


def _said(brands: DataFrame) -> DataFrame:
    return brands.select("entity", "trade", F.explode("brands").alias("y"))


def _waiting(at: DataFrame, contacts: DataFrame, forms: DataFrame, ours: bool) -> DataFrame:
    """``(ours, id, form, words, trade, contact, open)`` of ``(id, form, entity)`` rows without entity that state a contact; ``open`` if no other name of the id has one."""
    left = stage(at.where("entity is null").select("id", "form").distinct(), "left")
    taken = at.where("entity is not null").join(left.select("id").distinct(), "id", "left_semi").select("id", F.lit(True).alias("taken")).distinct()
    return left.join(taken, "id", "left").join(forms, "form").join(contacts, "id").select(F.lit(ours).alias("ours"), "id", "form", "words", "trade", "contact", F.col("taken").isNull().alias("open")).distinct()


def _by_contacts(asked: DataFrame, contact: DataFrame, brands: DataFrame, crowded: int, heard_of: dict) -> DataFrame:
    """``(ours, id, entity)`` of rows ``(ours, id, words, trade, contact)`` that a shared contact decides, if a brand word agrees and the trades don't differ.

    ``contact``: ``(contact, entity)``; ``brands``: ``(entity, trade, brands)``. ``heard_of`` keeps the words that crowds are asked for, and the near ones of all brands, from one call to the next.
    """
    crowd = stage(contact.groupBy("contact").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("contact"), "crowd")
    few = stage(asked.join(contact.join(crowd, "contact", "left_anti"), "contact").select("ours", "id", "contact", "words", "trade", "entity"), "few")
    few = few.alias("r").join(brands.alias("p"), F.col("r.entity") == F.col("p.entity")).where(((F.col("r.trade") == "") | (F.col("r.trade") == F.col("p.trade"))) & F.exists("r.words", lambda w: (F.length(w) > 2) & F.exists("p.brands", lambda y: _near(w, y)))).select("r.ours", "r.id", "r.contact", F.col("r.entity").alias("lo"), F.col("r.entity").alias("hi"))
    # in a crowd, words meet near words only, and of the entities that say a word the smallest and the largest tell whether it is one
    asking = stage(asked.join(crowd, "contact").select("ours", "id", "contact", "trade", F.explode(F.array_distinct(F.filter("words", lambda w: F.length(w) > 2))).alias("w")), "asking")
    words = asking.select("w").distinct()
    words = stage(words.join(heard_of["words"], "w", "left_anti") if heard_of else words, "words")
    # words that were asked for in an earlier call are not compared again
    if not heard_of or not words.isEmpty():
        # never light: a few words asked for may meet all that is left of many
        near = session.stage(_near_words(words, _said(brands).select("y").distinct()), "near")
        heard_of["words"], heard_of["near"] = (heard_of["words"].unionByName(words), heard_of["near"].unionByName(near)) if heard_of else (words, near)
    near = heard_of["near"]
    said = _said(brands).join(near.select("y").distinct(), "y", "left_semi").select("entity", "y", F.explode(F.array_distinct(F.array("trade", F.lit("")))).alias("trade"))
    said = stage(said, "said")
    said_here = contact.join(crowd, "contact").join(said, "entity").groupBy("contact", "y", "trade").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))
    heard = asking.select("contact", "w", "trade").distinct().join(near, "w").join(said_here, ["contact", "y", "trade"]).groupBy("contact", "w", "trade").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    many = asking.join(heard, ["contact", "w", "trade"]).select("ours", "id", "contact", "lo", "hi")
    # a contact decides if it leaves one entity; contacts that decide must agree
    left_one = few.unionByName(many).groupBy("ours", "id", "contact").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi")
    one = stage(left_one.groupBy("ours", "id").agg(F.min("lo").alias("lo"), F.max("lo").alias("hi")).where("lo = hi").select("ours", "id", F.col("lo").alias("entity")), "one")
    release(said, asking)
    return one


def phone_digits(c: Column) -> Column:
    """National digits of a phone, 8 or 10 of them; '' otherwise."""
    d = F.regexp_replace(F.translate(c, "०१२३४५६७८९", "0123456789"), "[^0-9]", "")
    d = F.regexp_replace(F.regexp_replace(d, "^(00)?977(?=[0-9]{8,10}$)", ""), "^0(?=[0-9]{8}$)", "")
    return F.regexp_extract(d, "^[1-9][0-9]{7}([0-9]{2})?$", 0)


def variant_pairs(listings: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(listing_index, evidence_id)`` of one business whose names differ even when squeezed.

    A listing without ``canonical_key`` is an owner by itself. Null ids are dropped.
    """
    left = listings.where("listing_index is not null").select(F.col("listing_index").alias("id"), F.coalesce(F.xxhash64(F.nullif("canonical_key", F.lit(""))) * F.when(F.nullif("canonical_key", F.lit("")).isNotNull(), 1), F.xxhash64(F.lit("row"), "listing_index")).alias("owner"), "name", "phones", "mobiles", "websites")
    right = evidence.where("evidence_id is not null").select(F.col("evidence_id").alias("id"), "name", "phone", "domain")
    arr = lambda c, f: F.transform(F.coalesce(c, F.array().cast("array<string>")), f)
    left_contacts = left.select("owner", F.explode(F.concat(arr("phones", phone_digits), arr("mobiles", phone_digits), arr("websites", host_text))).alias("contact")).where("contact <> ''")
    right_contacts = right.select("id", F.explode(F.array(phone_digits(F.col("phone")), host_text(F.col("domain")))).alias("contact")).where("contact <> ''")
    ours, theirs = stage(parsed(left), "ours"), stage(parsed(right.withColumn("owner", F.lit(None).cast("long"))), "theirs")
    owners, rows = (stage(x, "resolved") for x in resolve(ours, theirs, left_contacts, right_contacts))
    a = ours.join(owners, "owner").select(F.col("id").alias("listing_index"), "entity", F.col("squeezed").alias("sl"))
    # by id first: what is distinct of an id needs no shuffle of its own
    b = theirs.select("id", "squeezed").repartition("id").distinct().join(rows.repartition("id").distinct(), "id").select(F.col("id").alias("evidence_id"), "entity", F.col("squeezed").alias("sr")).distinct()
    return a.join(b, "entity").where("sl <> sr").select("listing_index", "evidence_id").distinct()
