"""Queries of the operators that find and read a business's site, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milap.functions import categories, text, urls
from milap.operators import discovery, gates, ranking
from milap.plans.reference_queries import s_host, s_host_or_bare, s_lenient, s_match_digits, s_name_key, s_normal, s_path, s_third, s_tokens
from milap.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def s_kind(x: str, glued: bool = False) -> str:
    pad = "" if glued else " "
    hit = lambda words: " OR ".join(f"contains(' ' || lower(coalesce({x}, '')) || ' ', '{pad}{w}{pad}')" for w in words.split())
    hits = "list_filter([" + ", ".join(f"CASE WHEN {hit(words)} THEN '{k}' END" for k, (words, _) in categories.KINDS.items()) + "], lambda k: k IS NOT NULL)"
    return f"(CASE WHEN len({hits}) = 1 THEN ({hits})[1] END)"


_AGAINST = ", ".join(f"('{k}', '{c}')" for k, (_, against) in categories.KINDS.items() for c in against.split())


@_query(
    f"""WITH k AS (SELECT evidence_id, {s_kind('name')} AS business, {s_kind(s_host_or_bare('domain'), True)} AS site FROM evidence)
      SELECT evidence_id, business, site, business IS NOT NULL AND site IS NOT NULL AND ((business, site) IN ({_AGAINST}) OR (site, business) IN ({_AGAINST})) AS conflict FROM k"""
)
def business_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of business a name and a host say, and whether they exclude each other."""
    k = table(spark, sf_dir, "evidence").select("evidence_id", categories.kind_of(F.col("name")).alias("business"), categories.kind_of(urls.domain_or_host(F.col("domain")), True).alias("site"))
    return k.select("*", categories.kinds_conflict(F.col("business"), F.col("site")).alias("conflict"))


def s_line(words: str, tables: tuple[dict, dict]) -> str:
    one = lambda t: f"list_filter({words}, lambda w: w IN ({', '.join(repr(w) for ws in t.values() for w in ws.split())}))[1]"
    case = lambda t: f"(CASE {' '.join(f'WHEN {one(t)} IN ({chr(44).join(repr(w) for w in ws.split())}) THEN {k!r}' for k, ws in t.items())} END)"
    return f"coalesce({case(tables[0])}, {case(tables[1])}, 'services')"


_WORDS = "string_split_regex(regexp_replace(lower(coalesce(category, '') || ' ' || coalesce(title, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')"


@_query(f"SELECT row_id, {s_line(_WORDS, (categories.FIRST_WORDS, categories.THEN_WORDS))} AS line FROM places")
def lines_of_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of business of a map hit, by its category, then its title."""
    return table(spark, sf_dir, "places").select("row_id", categories.line_of_business(F.array("category", "title")).alias("line"))


@_query(
    f"""WITH p AS (SELECT row_id, trim(coalesce(title, '')) AS n, trim(coalesce(phone_number, '')) AS t, trim(coalesce(requested, '')) AS l, {s_kind("concat_ws(' ', title, category)")} = 'education' AS edu FROM places)
      SELECT row_id, CASE WHEN length(t) >= 6 THEN '"' || n || '" "' || t || '"' ELSE '"' || n || '"' || CASE WHEN l <> '' THEN ' "' || l || '"' ELSE '' END || CASE WHEN coalesce(edu, false) THEN ' site:.edu.np' ELSE ' official' END END AS query FROM p WHERE n <> ''"""
)
def second_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refined query of each map hit."""
    q = categories.second_query(F.col("title"), F.col("phone_number"), F.col("category"), F.col("requested"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "places").select("row_id", q.alias("query")).where("query is not null")


@_query(
    """WITH b AS (SELECT evidence_id, name, trim(string_split_regex(name, '\\s*[:|]\\s*|\\s+[-–—]\\s+')[1]) AS s FROM evidence WHERE name IS NOT NULL)
      SELECT evidence_id, CASE WHEN length(s) >= 2 THEN s ELSE name END AS brand FROM b"""
)
def brand_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without what follows a bar, a colon or a dash."""
    return table(spark, sf_dir, "evidence").where("name is not null").select("evidence_id", text.brand_segment(F.col("name")).alias("brand"))


@_query(
    f"""WITH p AS (SELECT row_id, trim(coalesce(place_id, '')) AS pid, {s_host_or_bare('website')} AS h, {s_name_key("coalesce(nullif(title, ''), 'unknown')")} AS n, {s_match_digits("coalesce(phone_number, '')")} AS d FROM places),
      i AS (SELECT *, array_to_string(list_filter([CASE WHEN contains(h, 'google.com') THEN '' ELSE h END, n, d], lambda x: x <> ''), '|') AS parts FROM p)
      SELECT row_id, CASE WHEN pid <> '' THEN 'maps:' || pid ELSE 'candidate:' || parts END AS ledger_id, 'candidate:' || parts AS without_place FROM i WHERE parts <> ''"""
)
def ledger_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of a candidate in the ledger, and the one it would have without a place id."""
    id_of = lambda c: discovery.ledger_id(c, F.col("website"), F.col("title"), F.col("phone_number"), F.col("website"))
    return table(spark, sf_dir, "places").select("row_id", id_of(F.col("place_id")).alias("ledger_id"), id_of(F.lit(None).cast("string")).alias("without_place")).where("without_place <> 'candidate:'")


@_query("SELECT row_id, list_distinct(list_filter(list_transform(list_concat(coalesce(types, []), [category]), lambda v: trim(v)), lambda v: v IS NOT NULL AND v <> '')).list_sort() AS kinds FROM places")
def category_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: all the categories a map hit was given, once each."""
    return table(spark, sf_dir, "places").select("row_id", F.array_sort(text.union_of(F.col("types"), F.array("category"))).alias("kinds"))


_HOSTERS = ", ".join(f"'{h}'" for h in urls.HOSTERS)


@_query(
    f"""WITH h AS (SELECT evidence_id, coalesce(website, '') AS u, {s_host_or_bare('domain')} AS h FROM evidence)
      SELECT evidence_id, starts_with(u, 'google_maps:') OR contains(u, 'google.com/maps') OR contains(u, 'maps.google.com') OR contains(u, 'maps.app.goo.gl') AS on_map, {s_third('h')} AS shared,
        coalesce(nullif(regexp_extract(h, '([^.]+\\.(?:{"|".join(s.replace(".", chr(92) + ".") for s in urls.SUFFIXES)}))$', 1), ''), nullif(regexp_extract(h, '([^.]+\\.[^.]+)$', 1), ''), h) IN ({_HOSTERS}) AND NOT starts_with(h, 'www.')
          AND h <> coalesce(nullif(regexp_extract(h, '([^.]+\\.(?:{"|".join(s.replace(".", chr(92) + ".") for s in urls.SUFFIXES)}))$', 1), ''), nullif(regexp_extract(h, '([^.]+\\.[^.]+)$', 1), ''), h) AS issued FROM h"""
)
def host_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a site a map's, a directory's or network's, or a host given out by one."""
    h = urls.domain_or_host(F.col("domain"))
    return table(spark, sf_dir, "evidence").select("evidence_id", urls.map_url(F.coalesce("website", F.lit(""))).alias("on_map"), urls.third_party(h, urls.SHARED).alias("shared"), urls.issued_subdomain(h).alias("issued"))


_GUESSES = " UNION ALL ".join(f"SELECT {i} AS i, '{p}' AS path, '{t}' AS page_type" for i, (p, t) in enumerate(discovery.GUESSED))
_POINTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in discovery.PAGE_POINTS.items())
_CRAWL = "CASE WHEN lower({p}) IN ('', '/') THEN 'home' " + " ".join(f"WHEN regexp_matches(lower({{p}}), '{rx}') THEN '{k}'" for k, rx in urls.CRAWL_PAGES) + " ELSE 'other' END"


@_query(
    f"""WITH d AS (SELECT site, doc_id, regexp_replace({s_normal('url')}, '/+$', '') AS url FROM documents WHERE {s_host('url')} <> '' AND site IS NOT NULL),
      s AS (SELECT site, 'https://' || site AS origin FROM d GROUP BY site),
      h AS (SELECT site, origin AS url, 'home' AS page_type, 'homepage' AS found, 0 AS tier, 0 AS pos FROM s),
      u AS (SELECT site, url, min(doc_id) AS pos FROM d GROUP BY site, url),
      l AS (SELECT u.site, u.url, {_CRAWL.format(p=s_path('u.url'))} AS page_type, 'link' AS found, u.pos FROM u WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.site = u.site AND h.url = u.url)),
      k AS (SELECT site, url, page_type, found, tier, pos FROM h UNION ALL SELECT site, url, page_type, found, 10 - (CASE page_type {_POINTS} ELSE 0 END), pos FROM l),
      g AS (SELECT s.site, s.origin || q.path AS url, q.page_type, 'fallback_guess' AS found, 20 AS tier, q.i AS pos FROM s CROSS JOIN ({_GUESSES}) q WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.site = s.site AND k.url = s.origin || q.path)),
      r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY tier, pos, url) AS rank FROM (SELECT * FROM k UNION ALL SELECT * FROM g))
      SELECT site, url, page_type, found, rank FROM r WHERE rank <= 5"""
)
def pages_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pages of each site to read: home, known pages by kind, guessed ones."""
    d = table(spark, sf_dir, "documents").where((urls.domain_of(F.col("url")) != "") & F.col("site").isNotNull()).select("site", urls.normalize_url(F.col("url")).alias("url"), F.col("doc_id").alias("at"))
    sites = d.groupBy("site").agg(F.concat(F.lit("https://"), F.first("site")).alias("origin"))
    return discovery.pages_to_read(sites, d).select("site", "url", "page_type", "found", F.col("rank").cast("long").alias("rank"))


@_query(
    f"""WITH r AS (SELECT run_id, row_id, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(rating_count, 0) DESC, row_id) AS rank FROM places WHERE run_id IS NOT NULL)
      SELECT run_id, row_id, rank FROM r WHERE rank <= {discovery.overfetch_cap(10)}"""
)
def overfetched_places(spark: SparkSession, sf_dir: str, target: int = 10) -> DataFrame:
    """Of each run the hits that are scanned for ten wanted ones, those with most ratings first."""
    p = table(spark, sf_dir, "places").where("run_id is not null").select("run_id", "row_id", F.coalesce("rating_count", F.lit(0)).alias("n"))
    return ranking.top_per(p, ["run_id"], [F.col("n").desc(), F.col("row_id")], discovery.overfetch_cap(target)).select("run_id", "row_id", F.col("rank").cast("long").alias("rank"))


_NAME_WORDS = f"list_filter(string_split({s_name_key('title')}, ' '), lambda t: length(t) >= 3)"


@_query(
    f"""WITH p AS (SELECT run_id, row_id, website, {s_host_or_bare('website')} AS h, {_NAME_WORDS} AS words FROM places WHERE run_id IS NOT NULL AND coalesce(website, '') <> ''),
      u AS (SELECT *, regexp_matches(website, '(?i)^https?://') AND h <> '' AND NOT {s_third('h')} AND NOT regexp_matches(website, '{urls.ARTICLE}')
              AND NOT (regexp_matches(h, '(pulse|news)|\\.(info|org)$') AND len(words) > 0 AND len(list_filter(words, lambda t: contains(h, t))) = 0) AS usable FROM p),
      r AS (SELECT run_id, row_id, row_number() OVER (PARTITION BY run_id ORDER BY row_id) AS rank FROM u WHERE usable)
      SELECT run_id, row_id, rank, rank <= {discovery.deep_verify_cap(None, None)} AS verified FROM r"""
)
def deep_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of a run with a usable site, and which of them the cap leaves to be verified in depth."""
    p = table(spark, sf_dir, "places").where("run_id is not null and coalesce(website, '') <> ''")
    u = p.where(gates.official(F.col("website"), urls.domain_or_host(F.col("website")), F.col("title"))).select("run_id", "row_id")
    r = u.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("row_id")).cast("long"))
    return r.withColumn("verified", F.col("rank") <= discovery.deep_verify_cap(None, None))


@_query(
    """WITH p AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      q AS (SELECT doc_id, t, regexp_matches(t, '(?i)\\b(facebook|instagram|tiktok|linkedin|youtube)\\b') AND NOT regexp_matches(t, '(?i)https?://(www\\.)?(facebook|instagram|tiktok|linkedin|youtube)\\.com') AS named FROM p)
      SELECT doc_id, length(t) < 100 OR length(t) < 2000 OR named AS again FROM q"""
)
def script_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to be fetched anew with their scripts, none of which is known to have profiles or contacts."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", discovery.needs_script(F.lit(True), F.col("text"), F.col("text"), F.lit(False), F.lit(False)).alias("again"))


@_query(
    """WITH p AS (SELECT run_id, coalesce(nullif(place_id, ''), nullif(cid, ''), lower(coalesce(title, '')) || '|' || lower(coalesce(address, ''))) AS k, max(coalesce(website, '')) = '' AS lacks, max(coalesce(phone_number, '')) = '' AS unphoned FROM places WHERE run_id IS NOT NULL GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY run_id, lacks ORDER BY k) AS rank FROM p)
      SELECT run_id, count(*) AS groups, CAST(sum(CASE WHEN lacks AND rank <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS looked_up, CAST(sum(CASE WHEN lacks AND rank <= 10 THEN 2 ELSE 0 END) AS BIGINT) AS searches,
        CAST(sum(CASE WHEN lacks AND rank > 10 THEN 1 ELSE 0 END) AS BIGINT) AS not_attempted, CAST(sum(CASE WHEN NOT lacks AND unphoned THEN 1 ELSE 0 END) AS BIGINT) AS phone_only FROM r GROUP BY run_id"""
)
def gate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run the groups of hits, those looked up within the budget, the searches sent (two for each at most), those left over, and those that lack a phone only."""
    k = F.coalesce(F.nullif("place_id", F.lit("")), F.nullif("cid", F.lit("")), F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit("|"), F.lower(F.coalesce("address", F.lit("")))))
    none = lambda c: F.max(F.coalesce(c, F.lit(""))) == ""
    p = table(spark, sf_dir, "places").where("run_id is not null").groupBy("run_id", k.alias("k")).agg(none("website").alias("lacks"), none("phone_number").alias("unphoned"))
    r = p.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "lacks").orderBy("k")))
    n = lambda c, x=1: F.sum(F.when(c, x).otherwise(0))
    asked, over = F.col("lacks") & (F.col("rank") <= 10), F.col("lacks") & (F.col("rank") > 10)
    return r.groupBy("run_id").agg(F.count("*").alias("groups"), n(asked).alias("looked_up"), n(asked, 2).alias("searches"), n(over).alias("not_attempted"), n(~F.col("lacks") & F.col("unphoned")).alias("phone_only"))


_TOKENS = f"list_filter({s_tokens(s_lenient('name'))}, lambda t: NOT list_contains([{', '.join(repr(g) for g in text.GENERIC)}], t))"


@_query(
    f"""WITH d AS (SELECT site, count(*) AS pages, CAST(sum(CASE WHEN coalesce(text, '') <> '' THEN 1 ELSE 0 END) AS BIGINT) AS good FROM documents WHERE site IS NOT NULL GROUP BY site),
      e AS (SELECT DISTINCT evidence_id, name, coalesce(website, '') AS u, {s_host_or_bare('domain')} AS h, {_TOKENS} AS words, list_filter(string_split({s_name_key('name')}, ' '), lambda t: length(t) >= 3) AS long FROM evidence),
      x AS (SELECT e.*, coalesce(d.pages, 0) AS pages, coalesce(d.good, 0) AS good,
          regexp_matches(u, '(?i)^https?://') AND h <> '' AND NOT {s_third('h')} AND NOT regexp_matches(u, '{urls.ARTICLE}') AND NOT (regexp_matches(h, '(pulse|news)|\\.(info|org)$') AND len(long) > 0 AND len(list_filter(long, lambda t: contains(h, t))) = 0) AS usable,
          CASE WHEN h = '' THEN 'unverified' WHEN regexp_matches(h, '\\.(sitehost|weebpage|wixsite|blogspot|wordpress)\\.') THEN 'service_platform' WHEN {s_third('h')} OR regexp_matches(u, '{urls.DIRECTORY_PATH}') THEN 'directory'
            WHEN len(list_filter(words, lambda t: length(t) >= 4 AND contains(h, t))) > 0 THEN 'first_party' WHEN len(words) = 0 THEN 'related_entity' ELSE 'unrelated' END AS rel FROM e LEFT JOIN d ON d.site = e.h),
      y AS (SELECT *, CASE WHEN rel = 'first_party' THEN 'verified' WHEN rel = 'related_entity' THEN 'partial' ELSE 'failed' END AS st, rel IN ('directory', 'marketplace', 'service_platform', 'unrelated') AS wrong FROM x),
      z AS (SELECT *, CASE WHEN NOT usable THEN 'failed' WHEN good > 0 THEN st WHEN pages > 0 THEN 'failed' ELSE 'weak' END AS status,
          CASE WHEN NOT usable THEN CASE WHEN u <> '' THEN 'directory' ELSE 'unverified' END WHEN good > 0 THEN CASE WHEN st = 'verified' AND NOT wrong THEN 'first_party' WHEN st = 'failed' THEN 'unverified' ELSE rel END ELSE 'unverified' END AS relation FROM y)
      SELECT status, relation,
        CASE WHEN NOT usable THEN CASE WHEN u <> '' THEN 'wrong_source' ELSE 'unverified' END WHEN good > 0 THEN CASE WHEN wrong THEN 'wrong_source' WHEN relation = 'first_party' AND status IN ('verified', 'partial') THEN 'verified' WHEN status = 'failed' THEN 'transient_failure' ELSE 'unverified' END
          WHEN pages > 0 THEN 'transient_failure' ELSE 'unverified' END AS health, count(*) AS rows FROM z GROUP BY ALL"""
)
def evidence_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification makes of search hits without a usable site, with pages of it, and with a site that was not read, counted."""
    h = urls.domain_or_host(F.col("domain"))
    e = table(spark, sf_dir, "evidence").select("evidence_id", "name", F.coalesce("website", F.lit("")).alias("u"), h.alias("site")).distinct()
    d = table(spark, sf_dir, "documents").where("site is not null").groupBy("site").agg(F.count("*").alias("pages"), F.sum(F.when(F.coalesce("text", F.lit("")) != "", 1).otherwise(0)).alias("good"))
    x = e.join(d, "site", "left").withColumn("rel", gates.relationship(F.col("site"), F.col("u"), F.col("name"), F.lit(None).cast("string")))
    st = F.when(F.col("rel") == "first_party", "verified").when(F.col("rel") == "related_entity", "partial").otherwise("failed")
    zero = lambda c: F.coalesce(c, F.lit(0))
    v = discovery.verified_evidence(gates.official(F.col("u"), F.col("site"), F.col("name")), F.col("u") != "", zero("pages"), zero("good"), F.col("rel"), st)
    return x.select(v.alias("v")).groupBy("v.status", "v.relation", "v.health").agg(F.count("*").alias("rows"))


@_query()
def own_domain_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number in the pages of a search hit's own host."""
    e = table(spark, sf_dir, "evidence").select("evidence_id", urls.domain_or_host(F.col("domain")).alias("own")).where((F.col("own") != "") & ~urls.third_party(F.col("own"), urls.SHARED)).distinct()
    pages = table(spark, sf_dir, "documents").where("site is not null and text is not null").select(F.col("site").alias("host"), F.col("doc_id").alias("at"), F.col("text").alias("said"))
    # a number is looked for once in each site, not for each hit of it
    found = discovery.own_domain_phone(pages.join(e.select(F.col("own").alias("host")).distinct(), "host").withColumn("key", F.col("host")).withColumn("own", F.col("host")))
    return e.join(found.withColumnRenamed("key", "own"), "own").select("evidence_id", "phone")
