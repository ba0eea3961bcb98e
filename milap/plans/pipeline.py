"""The stages of a run as DataFrames: from map and search hits to scored listings, with the outcome of every candidate.

Each stage takes and returns DataFrames and labels rows instead of dropping them; ``ledger`` has one row for each candidate with what became of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milap.functions import contacts, phones, social, text, urls
from milap.operators import gates, graph, matching, ranking, scoring
from milap.operators.geography import requested_status
from milap.session import stage


def candidates(places: DataFrame, evidence: DataFrame, localities: DataFrame) -> DataFrame:
    """One row for each map identity and each host or name that only search hits know.

    ``(candidate, origin, run_id, name, address, phone, website, category, lat, lng, geo)``; ``geo`` is the locality gate's label, ambiguous for search hits, which have no position.
    """
    k = F.coalesce(F.nullif("place_id", F.lit("")), F.nullif("cid", F.lit("")), F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit("|"), F.lower(F.coalesce("address", F.lit("")))))
    pick = lambda c: F.min_by(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)), F.when(F.coalesce(c, F.lit("")) != "", F.struct(-F.coalesce("rating_count", F.lit(0.0)), "row_id"))).alias(c)
    geo = requested_status(places, localities, id_col="row_id", title="title", address="address", requested="requested", lat="latitude", lng="longitude")
    maps = places.withColumn("candidate", F.concat(F.lit("map:"), k)).join(geo.select(F.col("id").alias("row_id"), "status"), "row_id").groupBy("candidate").agg(
        F.min("run_id").alias("run_id"), *(pick(c) for c in ("title", "address", "phone_number", "website", "category")), F.max("latitude").alias("lat"), F.max("longitude").alias("lng"),
        F.max(F.coalesce("rating_count", F.lit(0.0))).alias("rating_count"), F.min(F.when(F.col("status") == "inside", "a_inside").when(F.col("status") == "ambiguous", "b_ambiguous").otherwise("c_outside")).alias("geo"),
    )
    maps = maps.select("candidate", F.lit("maps").alias("origin"), "run_id", F.col("title").alias("name"), "address", F.col("phone_number").alias("phone"), "website", "category", "lat", "lng", "rating_count", F.substring("geo", 3, 20).alias("geo"))
    host = urls.domain_or_host(F.col("domain"))
    hits = evidence.select("run_id", "name", "phone", "address", host.alias("host"), "evidence_id").where((F.col("host") != "") & F.contains("host", F.lit(".")) & ~urls.third_party(F.col("host"), matching.SHARED_HOSTS))
    # what the hits show to be a directory is no one's site
    hits = hits.join(matching.directories(hits.select("host", text.name_key(F.col("name")).alias("name"))), "host", "left_anti")
    web = matching.unmatched(hits, maps.select(urls.domain_or_host(F.col("website")).alias("host")), ["host"]).groupBy("host").agg(*(F.min_by(c, "evidence_id").alias(c) for c in ("run_id", "name", "phone", "address")))
    none = lambda t: F.lit(None).cast(t)
    web = web.select(F.concat(F.lit("web:"), "host").alias("candidate"), F.lit("web").alias("origin"), "run_id", "name", "address", "phone", F.concat(F.lit("https://"), "host", F.lit("/")).alias("website"), none("string").alias("category"), none("double").alias("lat"), none("double").alias("lng"), F.lit(0.0).alias("rating_count"), F.lit("ambiguous").alias("geo"))
    return maps.unionByName(web)


def site_signs(found: DataFrame, pages: DataFrame) -> DataFrame:
    """``(candidate, said_name, said_phone, said_address)``: what of a candidate ``(candidate, site, name, phone, address)`` the texts ``(site, text)`` of its site say.

    Each word is looked for once in a site's pages, which are never gathered.
    """
    own = found.join(pages.select("site").distinct(), "site", "left_semi")
    words = lambda c, k: F.transform(F.filter(F.split(k, " "), lambda t: F.length(t) >= 3), lambda t, i: F.struct(F.lit(c).alias("c"), i.alias("i"), t.alias("t")))
    asked = own.select("candidate", "site", F.explode(F.concat(words("n", text.name_key(F.coalesce("name", F.lit("")))), words("a", text.address_key(F.coalesce("address", F.lit("")))))).alias("x")).select("candidate", "site", "x.*")
    held = asked.select("site", "t").distinct().join(pages.select("site", F.lower("text").alias("body")), "site").groupBy("site", "t").agg(F.bool_or(F.contains("body", F.col("t"))).alias("v"))
    share = lambda c: F.avg(F.when(F.col("c") == c, F.col("v").cast("double")))
    covered = asked.join(held, ["site", "t"]).groupBy("candidate").agg((share("n") >= 0.6).alias("said_name"), (share("a") >= 0.5).alias("said_address"))
    numbers = pages.select("site", F.explode(phones.extract(F.col("text"))).alias("stated")).distinct()
    called = own.where("phone is not null").select("candidate", "site", "phone").join(numbers, "site").groupBy("candidate").agg(F.bool_or(phones.overlap(F.col("phone"), F.col("stated"))).alias("said_phone"))
    return covered.join(called, "candidate", "full_outer")


def penalties(found: DataFrame, pages: DataFrame) -> DataFrame:
    """``(candidate, penalty)`` by the worst conflict of candidates over their phones, hosts, and the e-mails and profiles ``(site, emails, profiles)`` of their own sites."""
    none = F.array().cast("array<string>")
    own = ~urls.third_party(F.col("site"), matching.SHARED_HOSTS)
    rows = found.join(pages, "site", "left").select(
        F.xxhash64("candidate").alias("listing_index"), "name", F.when(F.col("phone").isNotNull(), F.array("phone")).otherwise(none).alias("phones"), none.alias("mobiles"), F.when(own, F.col("emails")).alias("emails"), F.array_compact(F.array("website")).alias("websites"),
        F.struct(*(F.lit(None).cast("string").alias(c) for c in ("facebook", "tiktok", "instagram")), F.when(own & (F.size("profiles") > 0), F.map_from_arrays("profiles", "profiles")).alias("other")).alias("social_links"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude"),
    )
    worst = graph.conflict_kinds(rows).groupBy("listing_index").agg(F.min(scoring.conflict_penalty(F.col("type"))).alias("penalty"))
    return found.select("candidate", F.xxhash64("candidate").alias("listing_index")).join(worst, "listing_index").select("candidate", "penalty")


def listings(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates with the evidence of their site's pages, contacts by kind, verification and confidence.

    E-mail and profile are signs if the site states any. Documents without texts say nothing. A site that the candidates themselves show to be a directory is none of theirs and is not read.
    """
    site = urls.domain_or_host(F.col("website"))
    said = F.coalesce("text", F.lit("")) if "text" in documents.columns else F.lit("")
    texts = documents.where("site is not null").select("site", "url", said.alias("text"))
    links = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"https?://[^\s)\]<>\"']+"), 0), social.canonical_social), lambda u: u != "")
    pages = texts.groupBy("site").agg(F.count("*").alias("pages"), F.max(F.when(urls.page_role(F.col("url")) == "contact", 1).otherwise(0)).alias("has_contact_page"), F.array_distinct(F.flatten(F.collect_set(contacts.emails(F.col("text"))))).alias("emails"), F.array_distinct(F.flatten(F.collect_set(links))).alias("profiles"))
    pages = stage(pages, "pages")
    found = found.withColumn("site", site)
    shared = matching.directories(found.select(F.col("site").alias("host"), text.name_key(F.col("name")).alias("name"))).select(F.col("host").alias("site"), F.lit(True).alias("_shared"))
    found = stage(found.join(shared, "site", "left").withColumn("site", F.when(F.col("_shared"), "").otherwise(F.col("site"))).drop("_shared"), "candidates")
    phone = phones.classify(F.col("phone"))
    rows = found.join(pages, "site", "left").join(site_signs(found, texts.select("site", "text")), "candidate", "left").join(penalties(found, pages.select("site", "emails", "profiles")), "candidate", "left").withColumn("p", phone).withColumn("relation", gates.relationship(F.col("site"), F.coalesce("website", F.lit("")), F.col("name"), F.lit(None).cast("string")))
    has_pages, mapped = F.coalesce("pages", F.lit(0)) > 0, F.col("origin") == "maps"
    signs = {"gate": gates.official(F.col("website"), F.col("site"), F.col("name")), "domain": has_pages, "name": F.col("said_name"), "phone": F.col("said_phone"), "address": F.col("said_address"), "email": F.size("emails") > 0, "social": F.size("profiles") > 0}
    v = scoring.verification(signs, has_pages)
    maps = scoring.maps_confidence(mapped, F.col("rating_count"), mapped, F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.coalesce("address", F.lit("")) != "")
    web = scoring.website_confidence(v["confidence"], F.col("relation"))
    valid = F.col("p.type") != "invalid"
    contact = scoring.contact_confidence(mapped & valid & (~has_pages | F.coalesce("said_phone", F.lit(False))), F.size("emails") > 0, F.coalesce("address", F.lit("")) != "", F.when(valid, 1).otherwise(0))
    return rows.select(
        "candidate", "origin", "run_id", "name", "address", "website", "geo", "relation", F.when(F.col("p.type") == "mobile", F.col("p.digits")).alias("mobile"), F.when(F.col("p.type").isin("landline", "international"), F.col("p.digits")).alias("phone"),
        v["status"].alias("verification"), scoring.overall_confidence(maps, web, contact, F.coalesce("penalty", F.lit(1.0)), mapped & ~has_pages).alias("confidence"), gates.lifecycle(F.col("relation"), has_pages).alias("lifecycle"),
    )


def ledger(scored: DataFrame, target: int = 10) -> DataFrame:
    """``(candidate, run_id, outcome, confidence)``: the first reason that holds, else finalized, for the ``target`` best of a run.

    Reasons in order: artifact_name, outside, no_contact (neither phone, mobile nor website), over_target. Nulls in any column count as absent.
    """
    reason = F.when(gates.artifact_name(F.col("name")), "artifact_name").when(F.col("geo") == "outside", "outside").when(F.col("phone").isNull() & F.col("mobile").isNull() & (F.coalesce("website", F.lit("")) == ""), "no_contact")
    rows = scored.withColumn("reason", reason)
    kept = ranking.top_per(rows.where("reason is null").select("candidate", "run_id", "confidence"), ["run_id"], [F.col("confidence").desc(), F.col("candidate")], target).select("candidate", F.lit(True).alias("kept"))
    return rows.join(kept, "candidate", "left").select("candidate", "run_id", F.coalesce("reason", F.when(F.col("kept"), "finalized").otherwise("over_target")).alias("outcome"), "confidence")


def outcome_report(book: DataFrame) -> DataFrame:
    """Counts by outcome, zero-filled for the known ones, in one row."""
    kinds = ("artifact_name", "outside", "no_contact", "over_target", "finalized")
    return book.agg(F.count("*").alias("candidates"), *(F.coalesce(F.sum(F.when(F.col("outcome") == k, 1).otherwise(0)), F.lit(0)).alias(k) for k in kinds))

