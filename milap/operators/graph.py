"""Conflicts between listings, their components and the merge of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from milap.functions import contacts, phones, text, urls
from milap.operators.matching import SHARED_HOSTS, directories
from milap.operators.slabs import haversine_km
from milap.session import stage

#: Severity of conflicts (fixed values).
SEVERITY = {"DUPLICATE_MAPS_LISTING": 4, "POSSIBLY_SAME_ENTITY": 3, "RELATED_BRAND": 2, "SHARED_OFFICE": 1, "NO_CONFLICT": 0}


SAID = ("name_key", "phones", "emails", "hosts", "socials", "lat", "lng")


def contacts_said(listings: DataFrame, shared: tuple[str, ...] = SHARED_HOSTS) -> DataFrame:
    """``listing_index`` and what the listing says, in the forms that are compared, sorted; nulls count as none."""
    arr = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    tidy = lambda x: F.array_sort(F.array_distinct(x))
    digits = F.filter(F.transform(F.concat(arr("phones"), arr("mobiles")), phones.match_digits), lambda d: F.length(d) >= 7)
    mails = F.filter(F.transform(arr("emails"), lambda e: F.lower(F.trim(e))), lambda e: F.contains(e, F.lit("@")))
    hosts = F.filter(F.transform(arr("websites"), urls.domain_or_host), lambda h: F.contains(h, F.lit(".")) & ~urls.third_party(h, shared))
    links = F.filter(
        F.transform(F.concat(F.array("social_links.facebook", "social_links.tiktok", "social_links.instagram"), F.coalesce(F.map_values("social_links.other"), F.array().cast("array<string>"))), lambda u: F.regexp_replace(F.lower(F.trim(u)), "/+$", "")),
        lambda u: u.isNotNull() & (u != ""),
    )
    return listings.where("listing_index is not null").select(
        "listing_index", text.name_key(F.col("name")).alias("name_key"), tidy(digits).alias("phones"), tidy(mails).alias("emails"), tidy(hosts).alias("hosts"), tidy(links).alias("socials"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng")
    )


def without_directories(said: DataFrame) -> DataFrame:
    """``contacts_said`` with the hosts left out that the listings themselves show to be directories'."""
    said = stage(said, "said")
    each = said.select("listing_index", F.col("name_key").alias("name"), F.explode("hosts").alias("host"))
    bad = each.join(directories(each.select("host", "name")), "host").groupBy("listing_index").agg(F.collect_set("host").alias("_bad"))
    out = said.join(bad, "listing_index", "left").withColumn("hosts", F.when(F.col("_bad").isNull(), F.col("hosts")).otherwise(F.array_except("hosts", "_bad")))
    return out.select(*said.columns)


def run_conflicts(listings: DataFrame, near_km: float = 0.5) -> DataFrame:
    """``(run_id, a, b, type, confidence)`` of the listings of one run that share a contact or lie within ``near_km``, ``a < b``.

    Candidates meet on the run with a value, or with a cell of the map and its neighbours. Null runs have no conflicts; listing indices are unique.
    """
    rows = stage(contacts_said(listings).join(listings.where("run_id is not null").select("listing_index", "run_id"), "listing_index"), "said")
    marked = lambda c: F.transform(c, lambda v: F.concat(F.lit(c[0]), v))
    value = rows.select("run_id", "listing_index", F.explode(F.concat(*map(marked, ("phones", "emails", "hosts", "socials")))).alias("v"))
    shared = value.select("run_id", "v", F.col("listing_index").alias("a")).join(value.select("run_id", "v", F.col("listing_index").alias("b")), ["run_id", "v"]).where("a < b").select("a", "b")
    # a degree of longitude shrinks towards the poles, so cells are as wide as their row of latitude needs
    deg = near_km / 111.0
    row = F.floor(F.col("lat") / deg).cast("long")
    col = lambda r: F.floor(F.col("lng") / (deg / F.greatest(F.cos(F.radians((F.abs(r) + 2) * deg)), F.lit(0.01)))).cast("long")
    at = rows.where("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)").select("run_id", "listing_index", "lat", "lng", row.alias("r"))
    here = at.select("run_id", F.col("listing_index").alias("a"), "r", col(F.col("r")).alias("c"))
    around = at.select("run_id", F.col("listing_index").alias("b"), "lng", F.explode(F.sequence(F.col("r") - 1, F.col("r") + 1)).alias("r"))
    around = around.withColumn("c0", col(F.col("r"))).select("run_id", "b", "r", F.explode(F.sequence(F.col("c0") - 1, F.col("c0") + 1)).alias("c"))
    near = here.join(around, ["run_id", "r", "c"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = shared.unionByName(near).distinct()
    x, y = (rows.select(*(F.col(c).alias(f"{p}_{c}" if c != "listing_index" else p) for c in rows.columns)) for p in ("a", "b"))
    both = met.join(x, "a").join(y, "b")
    verdict = score_conflict(*(F.array_intersect(f"a_{c}", f"b_{c}") for c in ("phones", "emails", "hosts", "socials")), haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")), text.token_jaccard(F.col("a_name_key"), F.col("b_name_key")))
    return both.select(F.col("a_run_id").alias("run_id"), "a", "b", verdict.alias("v")).where("v.type is not null").select("run_id", "a", "b", "v.type", "v.confidence")


def contact_view(listings: DataFrame, shared: tuple[str, ...] = SHARED_HOSTS) -> DataFrame:
    """One row for each class of listings that say the same: ``(rep, copies, name_key, phones, emails, hosts, socials, lat, lng)``; ``rep`` is the class's smallest index."""
    return without_directories(contacts_said(listings, shared)).groupBy(*SAID).agg(F.min("listing_index").alias("rep"), F.count("*").alias("copies"))


def conflict_kinds(listings: DataFrame) -> DataFrame:
    """``(listing_index, type)``: the kinds of conflict of each listing, with those of its own class too."""
    own = stage(without_directories(contacts_said(listings)).withColumn("rep", F.min("listing_index").over(Window.partitionBy(*SAID))), "said")
    view = stage(own.groupBy("rep", *SAID).agg(F.count("*").alias("copies")), "view")
    pairs = conflict_pairs(view).select("type", F.explode(F.array("a", "b")).alias("rep"))
    same = view.where("copies > 1").select(score_conflict(F.col("phones"), F.col("emails"), F.col("hosts"), F.col("socials"), F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), 0.0), F.lit(1.0))["type"].alias("type"), "rep").where("type is not null")
    return own.select("listing_index", "rep").join(pairs.unionByName(same).distinct(), "rep").select("listing_index", "type")


def score_conflict(shared_phones: Column, shared_emails: Column, shared_hosts: Column, shared_socials: Column, km: Column, name_similarity: Column) -> Column:
    """Struct ``(type, confidence)`` of what two listings share; the type is null where it is no conflict."""
    n = F.size
    named = F.exists(shared_emails, contacts.identifying_email)
    gps = F.when(km < 0.05, 0.35).when(km < 0.5, 0.30).otherwise(0.0)
    total = (
        F.when(named, 0.40).when(n(shared_emails) > 0, 0.30).otherwise(0.0)
        + F.when(n(shared_phones) >= 2, 0.45).when(n(shared_phones) == 1, 0.35).otherwise(0.0)
        + F.when(n(shared_hosts) > 0, 0.35).otherwise(0.0)
        + F.when(n(shared_socials) >= 3, 0.25).when(n(shared_socials) > 0, 0.15).otherwise(0.0)
        + gps
        + F.when(name_similarity >= 0.85, 0.15).otherwise(0.0)
    )
    confidence = F.least(F.lit(0.99), text.js_round(total, 2))
    kind = (
        F.when((km < 0.05) & (n(shared_phones) > 0) & (n(shared_hosts) > 0), "DUPLICATE_MAPS_LISTING")
        .when((n(shared_phones) > 0) | named, "POSSIBLY_SAME_ENTITY")
        .when((n(shared_hosts) > 0) | (n(shared_socials) > 0), "RELATED_BRAND")
        .when((n(shared_emails) > 0) | (km < 0.5), "SHARED_OFFICE")
    )
    return F.struct(F.when(confidence >= 0.30, kind).alias("type"), confidence.alias("confidence"))


def conflict_pairs(view: DataFrame, block: int = 200) -> DataFrame:
    """``(a, b, type, confidence)`` between classes of ``contact_view`` that share a contact, ``a < b``.

    Candidates come from an equi-join on shared values. The classes of a value are cut into blocks of about ``block`` by a hash, and blocks meet in twos, so that no task holds all pairs of a value that
    many share (a directory's phone, a stopgap); every pair is met, whatever their number. Pairs that share nothing but nearness are found by the slab search and are no part of this.
    """
    marked = lambda c: F.transform(c, lambda v: F.concat(F.lit(c[0]), v))
    value = view.select("rep", F.explode(F.concat(*map(marked, ("phones", "emails", "hosts", "socials")))).alias("v"))
    value = stage(value.join(value.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"), "v").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("k", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "values")
    low = value.select("v", F.col("rep").alias("x"), F.col("k").alias("i"), F.explode(F.sequence("k", F.col("blocks") - 1)).alias("j"))
    high = value.select("v", F.col("rep").alias("y"), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), F.col("k").alias("j"))
    met = low.join(high, ["v", "i", "j"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    x, y = (view.select(*(F.col(c).alias(f"{p}_{c}" if c != "rep" else p) for c in view.columns)) for p in ("a", "b"))
    both = met.join(x, "a").join(y, "b")
    shared = [F.array_intersect(f"a_{c}", f"b_{c}") for c in ("phones", "emails", "hosts", "socials")]
    verdict = score_conflict(*shared, haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")), text.token_jaccard(F.col("a_name_key"), F.col("b_name_key")))
    return both.select("a", "b", verdict.alias("v")).where("v.type is not null").select("a", "b", "v.type", "v.confidence")


def components(links: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` by the smallest label of the neighbours and of the label's own label, until nothing changes.

    Links with a null end are dropped; an empty table has no nodes.
    """
    pair = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    both = stage(pair.unionByName(pair.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    label = stage(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("l")), "labels")
    for _ in range(max_rounds):
        heard = both.join(label.select(F.col("x").alias("y"), F.col("l").alias("m")), "y").groupBy("x").agg(F.min("m").alias("m"))
        jump = label.select(F.col("x").alias("l"), F.col("l").alias("j"))
        new = stage(label.join(heard, "x").join(jump, "l").select("x", F.least("l", "m", "j").alias("l"), F.col("l").alias("old")), "labels")
        label = new.select("x", "l")
        if not new.where("l <> old").limit(1).count():
            return label.select(F.col("x").alias("node"), F.col("l").alias("component"))
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")


def merge_duplicates(listings: DataFrame, members: DataFrame, size_cap: int = 3, domain_cap: int = 2) -> DataFrame:
    """One row for each component of ``(node, component)``: ``(component, members, survivor, suspected, phones, emails, websites, aliases)``.

    Components of more than ``size_cap`` listings, or of ``domain_cap`` hosts or more, are suspected of a false merge and not merged: their survivor is null and their arrays are empty, so nothing
    unbounded is gathered. The survivor has the highest confidence, then most contacts, then comes from maps, then the smaller name and index. Arrays hold the distinct values, sorted.
    """
    arr = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    rows = members.join(listings, F.col("node") == F.col("listing_index"))
    hosts = rows.select("component", F.explode(arr("websites")).alias("w")).select("component", urls.domain_or_host(F.col("w")).alias("h")).where("h <> ''").groupBy("component").agg(F.count_distinct("h").alias("domains"))
    size = rows.groupBy("component").agg(F.count("*").alias("members")).join(hosts, "component", "left").withColumn("suspected", (F.col("members") > size_cap) | (F.coalesce("domains", F.lit(0)) >= domain_cap)).drop("domains")
    n = F.size(arr("phones")) + F.size(arr("mobiles")) + F.size(arr("emails"))
    best = F.min(F.struct(-F.coalesce("confidence", F.lit(0.0)), -n, F.when(F.col("source") == "maps", 0).otherwise(1), F.coalesce("name", F.lit("")), "listing_index")).getField("listing_index")
    sure = rows.join(size.where("not suspected").select("component"), "component")
    all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(arr(c))))).alias(c)
    merged = sure.groupBy("component").agg(best.alias("survivor"), all_of("phones"), all_of("emails"), all_of("websites"), F.array_sort(F.collect_set("name")).alias("aliases"))
    none = F.array().cast("array<string>")
    return size.join(merged, "component", "left").select("component", "members", "survivor", "suspected", *(F.coalesce(c, none).alias(c) for c in ("phones", "emails", "websites", "aliases")))


def conflict_reason(kind: Column, name_a: Column, name_b: Column, shared_phones: Column, shared_emails: Column, shared_hosts: Column, shared_socials: Column, km: Column) -> Column:
    """A sentence that says what two listings share and what that suggests."""
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label} ["), F.array_join(c, ", "), F.lit("]")))
    parts = F.array_compact(F.array(part("phones", shared_phones), part("e-mails", shared_emails), part("hosts", shared_hosts), part("profiles", shared_socials), F.when(km < 0.5, F.concat(F.lit("a distance of "), F.round(km * 1000).cast("int").cast("string"), F.lit(" m")))))
    lead = F.when(kind == "DUPLICATE_MAPS_LISTING", "one place listed twice").when(kind == "POSSIBLY_SAME_ENTITY", "one business").when(kind == "RELATED_BRAND", "related brands").when(kind == "SHARED_OFFICE", "a shared office").otherwise("overlap")
    return F.concat(name_a, F.lit(" and "), name_b, F.lit(" share "), F.array_join(parts, " and "), F.lit(": "), lead)
