"""The best representative of each duplicate group, field by field, by token-level consensus.

The values of a group are aligned one after the other, heaviest first, to a growing profile; each column of the profile votes with the weights of
the tokens in it, and the existing value closest to the winning tokens is kept. Tokens are single characters, so a profile's size does not
grow with the number of values, and profiles of parts of a large group are merged in the same way as values are added.

Weights say how far a value is believed to be in use: trusted sources before all others; among trusted sources the latest
statement; among others, all statements, the later the heavier.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milap.session import stage

#: Path segments of the social network that are no page of a business (fixed values).
RESERVED_HANDLES = ("share", "sharer", "sharer.php", "profile.php", "pages", "people", "groups", "events", "login", "home", "watch", "photo", "photo.php", "story.php", "hashtag", "search", "help", "policies", "p")


def phone_key(v: Column) -> Column:
    """Eight ASCII digits of a subscriber number, without country code 977 and trunk 0; null if it is not one."""
    d = F.regexp_replace(F.translate(v, "०१२३४५६७८९", "0123456789"), "[^0-9]", "")
    d = F.regexp_replace(F.regexp_replace(d, "^(00)?977(?=0?[0-9]{8}$)", ""), "^0(?=[0-9]{8}$)", "")
    return F.when(d.rlike("^[1-9][0-9]{7}$"), d)


def host_key(v: Column) -> Column:
    """Host of a URL or bare host, lower case, without ``www.``; null if it has no dot or odd characters."""
    h = F.regexp_replace(F.regexp_extract(F.lower(F.trim(v)), r"^(?:[a-z]+:/*)?([^/?#:\s]+)", 1), r"^www\.", "")
    return F.when(h.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$") & (F.length(h) <= 253), h)


def host_text(v: Column) -> Column:
    """``host_key`` with '' for values without one, in an expression that reads the value once."""
    h = F.regexp_replace(F.regexp_extract(F.lower(F.trim(v)), r"^(?:[a-z]+:/*)?([^/?#:\s]+)", 1), r"^www\.", "")
    return F.regexp_extract(h, r"^(?=.{1,253}$)[a-z0-9-]+(\.[a-z0-9-]+)+$", 0)


def email_key(v: Column) -> Column:
    """A bare address in lower case; null if it is none."""
    e = F.regexp_replace(F.lower(F.trim(v)), r"^mailto:\s*", "")
    return F.when(e.rlike(r"^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+$") & (F.length(e) <= 320), e)


def handle_key(v: Column, host: str = "facebook") -> Column:
    """Handle of a page on the social network, lower case; null for other hosts and for segments that are no page."""
    h = F.regexp_extract(F.lower(F.trim(v)), rf"^(?:https?://)?(?:www\.|m\.|web\.)?{host}\.[a-z.]+/([^/?#\s]+)", 1)
    return F.when(h.rlike(r"^[a-z0-9._-]{2,100}$") & ~h.isin(*RESERVED_HANDLES), h)


# ---- alignment -------------------------------------------------------------------------------------------------------------


def _add(profile: list[dict], other: list[dict], weight: float, held: float) -> list[dict]:
    """Two profiles aligned (most shared weight); '' is a gap. ``held`` and ``weight`` are the weights of the two."""
    n, m = len(profile), len(other)
    share = lambda p, q: sum(min(w, q[t]) for t, w in p.items() if t and t in q)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + share(profile[i], other[j]))
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and best[i][j] == best[i + 1][j + 1] + share(profile[i], other[j]):
            merged = dict(profile[i])
            for t, w in other[j].items():
                merged[t] = merged.get(t, 0.0) + w
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i][j] == best[i + 1][j]):
            merged = dict(profile[i])
            merged[""] = merged.get("", 0.0) + weight
            i += 1
        else:
            merged = dict(other[j])
            merged[""] = merged.get("", 0.0) + held
            j += 1
        out.append(merged)
    return out


def _add_value(profile: list[dict], value: str, weight: float, held: float) -> list[dict]:
    """``_add`` of a single value, whose columns hold one token each."""
    n, m = len(profile), len(value)
    rows = [[0.0] * (m + 1)]
    for column in reversed(profile):
        below, row, right = rows[-1], [0.0] * (m + 1), 0.0
        for j in range(m - 1, -1, -1):
            w = column.get(value[j], 0.0)
            right = max(below[j], right, below[j + 1] + (w if w < weight else weight))
            row[j] = right
        rows.append(row)
    out, i, j = [], 0, 0
    while i < n or j < m:
        row = rows[n - i]
        if i < n and j < m and row[j] == rows[n - i - 1][j + 1] + min(profile[i].get(value[j], 0.0), weight):
            merged = dict(profile[i])
            merged[value[j]] = merged.get(value[j], 0.0) + weight
            i, j = i + 1, j + 1
        elif i < n and (j == m or row[j] == rows[n - i - 1][j]):
            merged = dict(profile[i])
            merged[""] = merged.get("", 0.0) + weight
            i += 1
        else:
            merged = {value[j]: weight, "": held}
            j += 1
        out.append(merged)
    return out


def profile_of(values: list[tuple[str, float]]) -> list[dict]:
    """Profile of values with weights, aligned one after the other, heaviest first, ties by value; these may be a part of a group."""
    profile, held = [], 0.0
    for v, w in sorted(values, key=lambda x: (-x[1], x[0])):
        profile = _add_value(profile, v, w, held) if held else [{t: w} for t in v]
        held += w
    return profile


def consensus(profile: list[dict]) -> str:
    """Winning token of each column; ties go to the smaller token, gaps last."""
    return "".join(min(c.items(), key=lambda x: (-x[1], x[0] == "", x[0]))[0] for c in profile)


# ---- groups ----------------------------------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    key, held = None, []
    for r in _rows(batches):
        if r[:n_keys] != key:
            if held:
                yield key, held
            key, held = r[:n_keys], []
        held.append(r[n_keys:])
    if held:
        yield key, held


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for (g, _), rows in _groups(batches, 2):
        out.append((g, json.dumps(profile_of(rows)), sum(w for _, w in rows)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["g", "profile", "weight"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for (g,), rows in _groups(batches, 1):
        parts = sorted(((-w, p) for p, w in rows))
        profile, held = json.loads(parts[0][1]), -parts[0][0]
        for w, p in parts[1:]:
            profile = _add(profile, json.loads(p), -w, held)
            held -= w
        out.append((g, consensus(profile)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["g", "said"])


def closest_to_consensus(values: DataFrame, part: int = 500) -> DataFrame:
    """``(g, value, heaviest)``: of each group ``g`` the existing value closest to the consensus of its ``(g, value, weight)`` rows.

    Values of a group are distinct and weights positive. All values of a group are aligned and vote; ties go to the heavier, then the smaller value. ``heaviest`` says whether the heaviest value
    was kept. A group of more than ``part`` values is aligned in parts, whose profiles are then merged.
    """
    size = values.groupBy("g").agg(F.count("*").alias("size"), F.max_by("value", F.struct("weight", "value")).alias("top"))
    plain = size.where("size = 1").select("g", F.col("top").alias("value"), F.lit(True).alias("heaviest"))
    hard = stage(values.join(size.where("size > 1"), "g").select("g", "value", "weight", "top", F.pmod(F.xxhash64("value"), F.ceil(F.col("size") / part).cast("int")).cast("int").alias("p")), "hard")
    partial = hard.repartition("g", "p").sortWithinPartitions("g", "p", "value").select("g", "p", "value", "weight").mapInArrow(_partial, "g string, profile string, weight double")
    said = partial.repartition("g").sortWithinPartitions("g").mapInArrow(_merged, "g string, said string")
    near = hard.join(said, "g").groupBy("g").agg(F.min(F.struct(F.levenshtein("value", "said").alias("far"), (-F.col("weight")).alias("w"), "value")).alias("b"), F.first("top").alias("top"))
    return plain.unionByName(near.select("g", "b.value", (F.col("b.value") == F.col("top")).alias("heaviest")))


def survivors(listings: DataFrame, trust: DataFrame, *, trusted_from: int = 2, trusted_days: float = 30.0, other_days: float = 120.0, tier: float = 5.0, own_share: float = 0.1, late_days: int = 120) -> DataFrame:
    """``(canonical_key, field_name, kept_value, heaviest)`` for keys of two or more rows and each field with a usable value; ``heaviest``: the value with most weight was kept.

    A row's time is ``extracted_at`` if that lies at most ``late_days`` before ``ingested_at`` and not after it, else ``ingested_at``. Values of which no key
    makes the share ``own_share`` of the statements belong to directories or are stopgaps, and unusable. What only untrusted sources say is not kept if a trusted one says it of another key and the group has other values.
    Sources without trust count as 0; null keys form no group; null, empty and malformed values are unusable; repeated rows change nothing among trusted statements.
    """
    days = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")) / 86400.0
    rows = listings.where("canonical_key is not null").select(
        "canonical_key", "source", "phones", "emails", "websites", F.col("social_links.facebook").alias("facebook"),
        F.coalesce(F.when((days("extracted_at") <= days("ingested_at")) & (days("extracted_at") >= days("ingested_at") - late_days), days("extracted_at")), days("ingested_at"), days("extracted_at"), F.lit(0.0)).alias("t"),
    )
    rows = rows.join(trust.groupBy("source").agg(F.max("trust").alias("trust")), "source", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))
    each = lambda name, key: F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("field_name"), key(v).alias("value")))
    stated = rows.select(
        "canonical_key", "t", "trust",
        F.explode(F.concat(each("phones", phone_key), each("emails", email_key), each("websites", host_key), F.array(F.struct(F.lit("facebook").alias("field_name"), handle_key(F.col("facebook")).alias("value"))))).alias("x"),
    ).select("canonical_key", "t", "trust", "x.*").where("value is not null")
    good = F.col("trust") >= trusted_from
    known = stage(
        stated.groupBy("canonical_key", "field_name", "value").agg(F.max(F.when(good, F.col("t"))).alias("last"), F.max(F.when(good, F.col("trust"))).alias("top"), F.sum(F.when(~good, F.exp(F.col("t") / other_days))).alias("others"), F.max("t").alias("seen"), F.count("*").alias("n")),
        "stated",
    )
    # whose is a value: keys that use it, and those of which a trusted source says so
    use = known.groupBy("field_name", "value").agg(F.count("*").alias("keys"), (F.max("n") / F.sum("n")).alias("share"), F.min(F.when(F.col("last").isNotNull(), F.col("canonical_key"))).alias("o1"), F.max(F.when(F.col("last").isNotNull(), F.col("canonical_key"))).alias("o2"))
    shared = use.where("keys > 1")
    mine = known.join(shared, ["field_name", "value"], "left").where(f"keys is null or share >= {own_share}")
    mine = mine.withColumn("foreign", F.col("last").isNull() & F.coalesce((F.col("o1") != F.col("canonical_key")) | (F.col("o2") != F.col("canonical_key")), F.lit(False)))
    two = listings.where("canonical_key is not null").groupBy("canonical_key").count().where("count > 1").select("canonical_key")
    mine = mine.join(two, "canonical_key", "left_semi")
    g = F.concat_ws("\x1f", "field_name", "canonical_key")
    peak = mine.groupBy("canonical_key", "field_name").agg(F.max("last").alias("g_last"), F.max("seen").alias("g_seen"))
    weighed = mine.join(peak, ["canonical_key", "field_name"]).select(
        g.alias("g"), "value",
        (
            F.coalesce(F.pow(F.lit(tier), "top") * F.exp((F.col("last") - F.col("g_last")) / trusted_days), F.lit(0.0))
            + F.coalesce(F.col("others") * F.exp(-F.col("g_seen") / other_days), F.lit(0.0)) * F.when(F.col("foreign"), 1e-6).otherwise(1.0)
            + 1e-12
        ).alias("weight"),
    )
    kept = closest_to_consensus(stage(weighed, "weighed"))
    return kept.select(F.split("g", "\x1f")[1].alias("canonical_key"), F.split("g", "\x1f")[0].alias("field_name"), F.col("value").alias("kept_value"), "heaviest")
