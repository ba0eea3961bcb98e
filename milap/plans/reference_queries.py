"""Queries of the record operators on the project's tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milap.functions import contacts, phones, social, text, urls
from milap.operators import gates, geography, graph, matching, ranking, scoring
from milap.plans import pipeline
from milap.operators.slabs import haversine_km
from milap.session import stage, table
from milap.sources import cache, store
from milap.streaming import edges

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- SQL of the scalar functions ------------------------------------------------------------------------------------------


def s_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def s_name_key(x: str) -> str:
    words = f"regexp_replace(lower(coalesce({x}, '')), '[^0-9A-Za-z_\\s]', ' ', 'g')"
    return s_squeeze(f"regexp_replace({words}, '\\b({'|'.join(text.LEGAL)}|p\\s*ltd)\\b', ' ', 'g')")


def s_lenient(x: str) -> str:
    out = f"coalesce({x}, '')"
    for a, b in text.ENTITIES:
        out = f"regexp_replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}', 'gi')"
    return s_name_key(out)


def s_address_key(x: str) -> str:
    return s_squeeze(f"regexp_replace(lower(coalesce({x}, '')), '[^0-9A-Za-z_\\s]', ' ', 'g')")


def s_tokens(key: str, least: int = 2) -> str:
    return f"list_filter(string_split({key}, ' '), lambda t: length(t) >= {least})"


def s_jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({s_tokens(a)})", f"list_distinct({s_tokens(b)})"
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"


def s_host(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(regexp_extract(trim(coalesce({x}, '')), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\s]+)', 1)), ':[0-9]+$', ''), '^www\\.', '')"


def s_host_or_bare(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '^https?://', ''), '^www\\.', '')"
    return f"CASE WHEN {s_host(x)} <> '' THEN {s_host(x)} ELSE regexp_extract({bare}, '^([^/:]*)', 1) END"


def s_path(x: str) -> str:
    return f"regexp_extract(trim(coalesce({x}, '')), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+([^?#]*)', 1)"


def s_digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def s_match_digits(x: str) -> str:
    d = s_digits(x)
    return f"""CASE WHEN starts_with({d}, '9771') AND length({d}) = 11 THEN substr({d}, 4)
      WHEN starts_with({d}, '97701') AND length({d}) = 12 THEN substr({d}, 5)
      WHEN regexp_matches({d}, '^977(98|97|96)') AND length({d}) = 13 THEN substr({d}, 4)
      WHEN starts_with({d}, '977977') THEN CASE WHEN length({d}) IN (16, 17) THEN substr({d}, 7) ELSE substr({d}, 4) END
      WHEN length({d}) = 9 AND starts_with({d}, '0') THEN substr({d}, 2) ELSE {d} END"""


def s_third(h: str, listed: tuple[str, ...] = matching.SHARED_HOSTS) -> str:
    names = ", ".join(f"'{x}'" for x in listed)
    tail = "|".join(x.replace(".", "\\.") for x in listed)
    return f"({h} IN ({names}) OR regexp_matches({h}, '\\.({tail})$'))"


def s_round(x: str, n: int = 2) -> str:
    return f"floor(({x}) * {10**n}.0 + 0.5) / {10**n}.0"


def s_haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"2 * 6371.0 * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - {h})))"


def s_clean(x: str) -> str:
    """Distinct non-empty values, sorted."""
    return f"list_sort(list_distinct(list_filter(list_transform(coalesce({x}, []), lambda v: trim(v)), lambda v: v IS NOT NULL AND v <> '')))"


# ---- normalisation --------------------------------------------------------------------------------------------------------


@_query(f"SELECT evidence_id, {s_name_key('name')} AS name_key, {s_lenient('name')} AS lenient_key, {s_address_key('address')} AS address_key FROM evidence")
def name_and_address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of names and addresses."""
    return table(spark, sf_dir, "evidence").select("evidence_id", text.name_key(F.col("name")).alias("name_key"), text.name_key_lenient(F.col("name")).alias("lenient_key"), text.address_key(F.col("address")).alias("address_key"))


@_query(
    f"""SELECT run_id, {s_squeeze("lower(coalesce(query, ''))")} AS query_key2, {s_squeeze("regexp_replace(lower(coalesce(location, '')), '[,_/-]', ' ', 'g')")} AS locality_string,
      substr(sha256('broad-search::' || query), 1, 16) AS cache_key,
      substr(regexp_replace(regexp_replace(lower(coalesce(query, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 50) AS slug FROM runs"""
)
def run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a run."""
    return table(spark, sf_dir, "runs").select(
        "run_id", text.query_key(F.col("query")).alias("query_key2"), text.locality_string(F.col("location")).alias("locality_string"), text.cache_key(F.lit("broad-search"), F.col("query")).alias("cache_key"), text.slug(F.col("query")).alias("slug")
    )


@_query(
    f"""SELECT listing_index, CASE WHEN {s_name_key('trim(name)')} = '' THEN '' ELSE 'name:' || {s_name_key('trim(name)')} || '|' || coalesce(nullif({s_squeeze("regexp_replace(lower(coalesce(location, '')), '[,_/-]', ' ', 'g')")}, ''), 'unknown-location') END AS key FROM listings"""
)
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity by name and locality."""
    return table(spark, sf_dir, "listings").select("listing_index", text.canonical_key(F.col("name"), text.locality_string(F.col("location"))).alias("key"))


@_query(
    f"SELECT listing_index, list_sort(list_distinct(list_filter({s_tokens(s_lenient('name'))}, lambda t: NOT list_contains([{', '.join(repr(g) for g in text.GENERIC)}], t)))) AS words FROM listings"
)
def distinctive_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinctive words of a name."""
    return table(spark, sf_dir, "listings").select("listing_index", F.array_sort(text.distinctive_tokens(F.col("name"))).alias("words"))


@_query(f"SELECT evidence_id, {s_host('website')} AS host, {s_host_or_bare('domain')} AS domain_host FROM evidence")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of URLs and of bare hosts."""
    return table(spark, sf_dir, "evidence").select("evidence_id", urls.domain_of(F.col("website")).alias("host"), urls.domain_or_host(F.col("domain")).alias("domain_host"))


_TRACK = ", ".join(f"'{t}'" for t in urls.TRACKING)
_S_NORMAL = """CASE WHEN {host} = '' THEN trim(coalesce({x}, '')) ELSE lower(regexp_extract(trim({x}), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(trim({x}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\s]+)', 1)), '^www\\.', '')
  || CASE WHEN length({path}) > 1 THEN regexp_replace({path}, '/$', '') ELSE '/' END
  || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"""


def s_normal(x: str) -> str:
    query = f"regexp_extract(trim(coalesce({x}, '')), '^[^?#]*\\?([^#]*)', 1)"
    kept = f"list_sort(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({_TRACK})))"
    return _S_NORMAL.format(x=x, host=s_host(x), path=s_path(x), kept=kept)


@_query(f"SELECT doc_id, {s_normal('url')} AS normal FROM documents UNION ALL SELECT evidence_id + 1000000000 AS doc_id, {s_normal('website')} AS normal FROM evidence WHERE website IS NOT NULL")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs without what doesn't change the page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", urls.normalize_url(F.col("url")).alias("normal"))
    return docs.unionByName(table(spark, sf_dir, "evidence").where("website is not null").select((F.col("evidence_id") + 1000000000).alias("doc_id"), urls.normalize_url(F.col("website")).alias("normal")))


_TWO = "|".join(s.replace(".", "\\.") for s in urls.SUFFIXES)


@_query(
    f"""WITH h AS (SELECT DISTINCT {s_host_or_bare('domain')} AS host FROM evidence)
      SELECT host, coalesce(nullif(regexp_extract(host, '([^.]+\\.(?:{_TWO}))$', 1), ''), nullif(regexp_extract(host, '([^.]+\\.[^.]+)$', 1), ''), host) AS root,
        CASE WHEN regexp_matches(host, '{urls.TLD_BEST}') THEN 'best' WHEN regexp_matches(host, '{urls.TLD_GOOD}') THEN 'good' WHEN regexp_matches(host, '{urls.TLD_GENERIC}') THEN 'generic' ELSE 'other' END AS tier,
        {s_third('host')} AS third_party FROM h"""
)
def host_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrable domain, tier and third parties of the hosts."""
    h = table(spark, sf_dir, "evidence").select(urls.domain_or_host(F.col("domain")).alias("host")).distinct()
    return h.select("host", urls.root_domain(F.col("host")).alias("root"), urls.tld_tier(F.col("host")).alias("tier"), urls.third_party(F.col("host"), matching.SHARED_HOSTS).alias("third_party"))


def _s_ladder(subject: str, rules, last: str) -> str:
    return " ".join(f"WHEN regexp_matches({subject}, '{p}') THEN '{r}'" for r, p in rules) + f" ELSE '{last}' END"


_ROLE_PATH = f"regexp_replace(lower({s_path('url')}), '/+$', '')"


@_query(
    f"""SELECT doc_id, CASE WHEN coalesce(url, '') = '' THEN 'other' {_s_ladder(_ROLE_PATH, urls.PAGE_ROLES, 'other')} AS role,
      CASE WHEN coalesce(url, '') = '' THEN 'other' WHEN lower({s_path('url')}) IN ('', '/') THEN 'home' {_s_ladder(f"lower({s_path('url')})", urls.CRAWL_PAGES, 'other')} AS crawl,
      len(list_filter(string_split({s_path('url')}, '/'), lambda s: s <> '')) AS segments, ({s_host('url')} = '' OR regexp_matches({s_path('url')}, '{urls.IGNORED}')) AS ignored,
      {' + '.join(f"CASE WHEN regexp_matches(url, '(?i)/{p}') THEN 1 ELSE 0 END" for p in urls.PRIORITY)} AS priority, regexp_matches(url, '{urls.ARTICLE}') AS article FROM documents WHERE url IS NOT NULL"""
)
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's path says."""
    u = F.col("url")
    return table(spark, sf_dir, "documents").where("url is not null").select("doc_id", urls.page_role(u).alias("role"), urls.crawl_page(u).alias("crawl"), urls.path_segments(u).cast("long").alias("segments"), urls.ignored_path(u).alias("ignored"), urls.priority_score(u).alias("priority"), u.rlike(urls.ARTICLE).alias("article"))


@_query(f"SELECT evidence_id, {s_match_digits('phone')} AS digits FROM evidence")
def phone_match_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits for matching."""
    return table(spark, sf_dir, "evidence").select("evidence_id", phones.match_digits(F.col("phone")).alias("digits"))


_AREA, _MOB = "|".join(phones.AREA_CODES), "|".join(phones.MOBILE_PREFIXES)
_PHONE_SQL = f"""
WITH c AS (SELECT evidence_id, phone, regexp_replace(regexp_replace(trim(coalesce(phone, '')), '^[^+0-9]+', ''), '[^0-9]+$', '') AS c FROM evidence),
g AS (SELECT *, regexp_replace(c, '[^0-9]', '', 'g') AS d0 FROM c),
d AS (SELECT *, CASE WHEN starts_with(d0, '977977') THEN substr(d0, 4) ELSE d0 END AS d,
      length(regexp_replace(c, '[^(]', '', 'g')) = length(regexp_replace(c, '[^)]', '', 'g')) AS bal FROM g),
e AS (SELECT *, substr(d, 4) AS r, starts_with(c, '+') AND length(d) BETWEEN 8 AND 15 AND bal AS abroad FROM d),
k AS (SELECT evidence_id, phone, c,
  CASE WHEN c = '' THEN ['invalid', '', 'EMPTY'] WHEN d0 = '' THEN ['invalid', '', 'NO_DIGITS']
    WHEN regexp_matches(trim(phone), '\\b[0-9]{{1,3}}\\.[0-9]{{4,8}}\\b') THEN ['invalid', d0, 'COORDINATE_FLOAT'] WHEN length(d) > 15 THEN ['invalid', d, 'TOO_LONG']
    WHEN starts_with(d, '977') THEN
      CASE WHEN regexp_matches(r, '^({_MOB})') THEN CASE WHEN length(r) = 10 THEN ['mobile', r, NULL] ELSE ['invalid', d, 'INCOMPLETE_MOBILE'] END
        WHEN starts_with(r, '01') THEN CASE WHEN length(r) = 9 THEN ['landline', substr(r, 2), NULL] ELSE ['invalid', d, 'INCOMPLETE_LANDLINE'] END
        WHEN starts_with(r, '1') THEN CASE WHEN length(r) = 8 THEN ['landline', r, NULL] ELSE ['invalid', d, 'INCOMPLETE_LANDLINE'] END
        WHEN regexp_matches(r, '^({_AREA})[0-9]{{6}}$') THEN ['landline', r, NULL] WHEN abroad THEN ['international', d, NULL] ELSE ['invalid', d, 'INVALID_STRUCTURE'] END
    ELSE
      CASE WHEN regexp_matches(d, '^({_MOB})') THEN CASE WHEN length(d) = 10 THEN ['mobile', d, NULL] ELSE ['invalid', d, 'INCOMPLETE_MOBILE'] END
        WHEN regexp_matches(d, '^0(1[0-9]{{7}}|({_AREA})[0-9]{{6}})$') THEN ['landline', substr(d, 2), NULL] WHEN regexp_matches(d, '^(1[0-9]{{7}}|({_AREA})[0-9]{{6}})$') THEN ['landline', d, NULL]
        WHEN abroad THEN ['international', d, NULL] WHEN regexp_matches(d, '^(01|1)') THEN ['invalid', d, 'INCOMPLETE_LANDLINE'] ELSE ['invalid', d, 'INVALID_STRUCTURE'] END END AS k FROM e)
SELECT evidence_id, k[1] AS type, k[2] AS digits, k[3] AS reason,
  CASE WHEN k[1] = 'mobile' AND length(k[2]) = 10 THEN '+977-' || substr(k[2], 1, 3) || '-' || substr(k[2], 4)
    WHEN k[1] = 'landline' AND length(k[2]) = 8 AND starts_with(k[2], '1') THEN '+977-01-' || substr(k[2], 2)
    WHEN k[1] = 'international' THEN CASE WHEN starts_with(c, '+') THEN c ELSE '+' || c END ELSE coalesce(phone, k[2]) END AS display FROM k"""


@_query(_PHONE_SQL)
def phone_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, canonical digits and display of phones."""
    e = table(spark, sf_dir, "evidence").select("evidence_id", "phone", phones.classify(F.col("phone")).alias("k"))
    return e.select("evidence_id", "k.type", "k.digits", "k.reason", phones.display(F.col("k.type"), F.col("k.digits"), F.col("phone")).alias("display"))


@_query(
    "SELECT doc_id, " + " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}', {g}))" for p, g in ((phones.INTERNATIONAL_TEXT, 0), (phones.MOBILE_TEXT, 1), (phones.LANDLINE_TEXT, 1))) + " AS found FROM documents"
)
def phones_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for phones in page texts."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", sum((F.size(F.regexp_extract_all(t, F.lit(p), g)) for p, g in ((phones.INTERNATIONAL_TEXT, 0), (phones.MOBILE_TEXT, 1), (phones.LANDLINE_TEXT, 1))), F.lit(0)).cast("long").alias("found"))


@_query(
    rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\s*[\[(]at[\])]\s*', '@', 'g'), '(?i)\s*[\[(]dot[\])]\s*', '.', 'g') AS t FROM (SELECT doc_id, text FROM documents UNION ALL SELECT listing_index + 1000000000, array_to_string(emails, ' ; ') FROM listings)),
      f AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '{contacts.EMAIL_TEXT}'), lambda e: lower(regexp_replace(e, '^[.%+-]+|[.-]+$', '', 'g'))),
        lambda e: regexp_matches(e, '{contacts._EMAIL}') AND NOT regexp_matches(e, '{contacts.PLACEHOLDER}')))) AS emails FROM t)
      SELECT doc_id, emails FROM f WHERE len(emails) > 0"""
)
def emails_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails of page texts, and of the lists that listings hold, read as texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(table(spark, sf_dir, "listings").select((F.col("listing_index") + 1000000000).alias("doc_id"), F.array_join("emails", " ; ").alias("text")))
    return docs.select("doc_id", F.array_sort(contacts.emails(F.col("text"))).alias("emails")).where("size(emails) > 0")


_ROLES = ", ".join(f"'{r}'" for r in contacts.ROLE_INBOXES)


def s_identifying(e: str) -> str:
    return f"({e} LIKE '%@%' AND lower(trim(split_part({e}, '@', 1))) NOT IN ({_ROLES}))"


@_query(
    f"""WITH e AS (SELECT DISTINCT listing_index, lower(trim(unnest(emails))) AS e FROM listings)
      SELECT listing_index, e AS email, (e LIKE '%@%' AND trim(split_part(e, '@', 1)) NOT IN ({_ROLES})) AS identifying FROM e"""
)
def email_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails of persons and of roles."""
    e = table(spark, sf_dir, "listings").select("listing_index", F.explode("emails").alias("e")).select("listing_index", F.lower(F.trim("e")).alias("email")).distinct()
    return e.select("listing_index", "email", contacts.identifying_email(F.col("email")).alias("identifying"))


@_query(
    f"SELECT listing_index, {s_clean('phones')} AS phones, {s_clean('emails')} AS emails, CASE WHEN latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 THEN [longitude, latitude] END AS point FROM listings"
)
def clean_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean arrays and points."""
    c = lambda x: F.array_sort(text.clean_array(F.col(x))).alias(x)
    return table(spark, sf_dir, "listings").select("listing_index", c("phones"), c("emails"), F.when(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.array("longitude", "latitude")).alias("point"))


@_query(
    r"""SELECT doc_id, length(trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS n, substr(coalesce(text, ''), 1, 200) AS summary,
      regexp_matches(lower(coalesce(text, '')), '\b(lorem ipsum)\b') AS lorem FROM documents"""
)
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without tags, summaries."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.squeeze(F.regexp_replace(t, "<[^>]+>", " "))).cast("long").alias("n"), text.content_summary(F.array(t)).alias("summary"), F.lower(t).rlike(r"\b(lorem ipsum)\b").alias("lorem"))


@_query(
    r"""WITH t AS (SELECT doc_id, url, coalesce(text, '') AS t FROM documents),
      n AS (SELECT doc_id, url, len(regexp_extract_all(t, '(?m)^(?:#+\s*)?[0-9]{1,2}[.)]\s+[A-Z]')) AS heads,
        len(list_distinct(regexp_extract_all(t, '([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){0,4}) (?:Pvt|Private|P)\.? ?(?:Ltd|Limited)', 1))) AS firms FROM t)
      SELECT doc_id, (regexp_matches(coalesce(url, ''), '(?i)/(top|best)-?[0-9]*-|/list(ing)?s?/|-in-nepal') OR heads >= 3 OR firms >= 4 OR (heads >= 2 AND firms >= 3)) AS multi FROM n"""
)
def multi_business_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages that list several businesses."""
    return table(spark, sf_dir, "documents").select("doc_id", contacts.multi_business(F.col("text"), F.col("url")).alias("multi"))


# ---- classifiers and gates ------------------------------------------------------------------------------------------------


@_query(
    f"""WITH h AS (SELECT evidence_id, {s_host_or_bare('domain')} AS host, coalesce(website, '') AS url FROM evidence),
      l AS (SELECT evidence_id, CASE WHEN host = '' OR host NOT LIKE '%.%' THEN 'ambiguous' WHEN split_part(host, '.', 1) IN ('facebook', 'instagram', 'tiktok', 'linkedin', 'youtube', 'twitter', 'x') THEN 'social'
        WHEN {s_third('host')} THEN 'directory' WHEN regexp_matches(url, '{urls.DIRECTORY_PATH}') THEN 'directory' WHEN regexp_matches(url, '{urls.ARTICLE}') THEN 'article' ELSE 'business' END AS label FROM h)
      SELECT label, count(*) AS n, CAST(sum(CASE WHEN label = 'business' THEN 1 ELSE 0 END) AS BIGINT) AS usable FROM l GROUP BY label"""
)
def search_hit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder over search hits, every row labelled, and its histogram."""
    h, u = urls.domain_or_host(F.col("domain")), F.coalesce("website", F.lit(""))
    label = (
        F.when((h == "") | ~F.contains(h, F.lit(".")), "ambiguous").when(F.split(h, r"\.")[0].isin(*social.PLATFORMS), "social").when(urls.third_party(h, matching.SHARED_HOSTS) | u.rlike(urls.DIRECTORY_PATH), "directory")
        .when(u.rlike(urls.ARTICLE), "article").otherwise("business")
    )
    return table(spark, sf_dir, "evidence").select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == "business", 1).otherwise(0)).alias("usable"))


_SIGNALS = [f"(i & {1 << k}) <> 0" for k in range(8)]
_M = dict(zip(("maps", "cta", "leader", "staff", "branch", "platform", "front", "team"), _SIGNALS, strict=True))


@_query(
    f"""SELECT i, CASE WHEN {_M['maps']} THEN 'primary_business' WHEN {_M['branch']} THEN 'branch_contact' WHEN {_M['platform']} THEN 'unknown'
      WHEN {_M['front']} AND {_M['cta']} THEN 'primary_business' WHEN {_M['cta']} AND NOT ({_M['staff']}) AND NOT ({_M['team']}) THEN 'primary_business' WHEN {_M['front']} AND NOT ({_M['staff']}) THEN 'primary_business'
      WHEN {_M['team']} AND ({_M['leader']} OR {_M['staff']}) THEN 'staff_person' WHEN {_M['staff']} THEN 'staff_person' ELSE 'unknown' END AS role FROM (SELECT unnest(range(256)) AS i)"""
)
def contact_role_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of a contact for all 256 vectors of signals."""
    bit = lambda k: F.col("i").bitwiseAND(1 << k) != 0
    return spark.range(256).withColumnRenamed("id", "i").select("i", contacts.role_matrix(*(bit(k) for k in range(8)))["role"].alias("role"))


_FRESH_SQL = (
    "CASE "
    + " ".join(f"WHEN query_key IN ({', '.join(repr(k) for k in ks)}) THEN {d}" for d, ks in store.FRESH_DAYS.items())
    + " "
    + " ".join(f"WHEN split_part(query_key, ' ', 1) IN ({', '.join(repr(k) for k in ks)}) THEN {d}" for d, ks in store.FRESH_DAYS.items())
    + " "
    + " ".join(f"WHEN contains(query_key, '{k}') THEN {d}" for k, d in sorted(((k, d) for d, ks in store.FRESH_DAYS.items() for k in ks), key=lambda x: (-len(x[0]), x[0])))
    + f" ELSE {store.DEFAULT_DAYS} END"
)


@_query(
    f"""WITH a AS (SELECT DISTINCT query_key, locality_key, completed_at AS at FROM runs WHERE locality_key IS NOT NULL AND query_key IS NOT NULL),
      r AS (SELECT query_key, locality_key, run_id, completed_at, listing_count FROM runs WHERE status IN ('success', 'empty')),
      m AS (SELECT a.query_key, a.locality_key, a.at, r.run_id, r.completed_at, r.listing_count, row_number() OVER (PARTITION BY a.query_key, a.locality_key, a.at ORDER BY r.completed_at DESC, r.run_id DESC) AS rn
        FROM a JOIN r ON a.query_key = r.query_key AND a.locality_key = r.locality_key AND r.completed_at < a.at AND epoch(r.completed_at) > epoch(a.at) - 86400 * (CASE WHEN TRUE THEN {_FRESH_SQL.replace('query_key', 'a.query_key')} END))
      SELECT a.query_key, a.locality_key, a.at, m.completed_at, m.run_id, m.listing_count FROM a LEFT JOIN m ON a.query_key = m.query_key AND a.locality_key = m.locality_key AND a.at = m.at AND m.rn = 1"""
)
def fresh_run_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each run, the newest earlier one that could have been served."""
    runs = table(spark, sf_dir, "runs")
    return store.newest_fresh(runs, runs.where("locality_key is not null and query_key is not null").select("query_key", "locality_key", F.col("completed_at").alias("at")))


_SAID = s_squeeze("regexp_replace(lower(coalesce(concat_ws(' ', title, address), '')), '[,_/-]', ' ', 'g')")


@_query(
    f"""WITH b AS (SELECT row_id AS id, {_SAID} AS said, {s_squeeze("regexp_replace(lower(coalesce(requested, '')), '[,_/-]', ' ', 'g')")} AS asked, latitude AS lat, longitude AS lng FROM places),
      g AS (SELECT locality_id, lower(canonical_name) AS nm, centroid.lat AS clat, centroid.lng AS clng, max_radius_km AS rad,
        list_transform(coalesce(aliases, []), lambda a: {s_squeeze("regexp_replace(lower(a), '[,_/-]', ' ', 'g')")}) AS al FROM localities),
      q AS (SELECT a.asked, min(g.locality_id) AS lid FROM (SELECT DISTINCT asked FROM b) a JOIN g ON list_contains(string_split(a.asked, ' '), g.nm) AND length(g.nm) > 2 GROUP BY a.asked),
      f AS (SELECT b.*, g.* FROM b LEFT JOIN q ON b.asked = q.asked LEFT JOIN g ON g.locality_id = q.lid),
      w AS (SELECT DISTINCT id, said, lid, unnest(string_split(said, ' ')) AS word FROM b JOIN q ON b.asked = q.asked),
      o AS (SELECT DISTINCT w.id FROM w JOIN g ON g.nm = w.word AND g.locality_id <> w.lid AND length(w.word) > 2
        WHERE NOT (len(regexp_extract_all(said, '\\b' || nm || '\\b')) = len(regexp_extract_all(said, '\\b' || nm || '\\s+({geography.ROAD})\\b')))),
      v AS (SELECT f.*, o.id IS NOT NULL AS other, {s_round(s_haversine('f.clat', 'f.clng', 'f.lat', 'f.lng'))} AS km,
        len(regexp_extract_all(said, '\\b' || nm || '\\b')) AS n_all, len(regexp_extract_all(said, '\\b' || nm || '\\s+({geography.ROAD})\\b')) AS n_road FROM f LEFT JOIN o ON f.id = o.id)
      SELECT id, CASE WHEN locality_id IS NULL THEN 'ambiguous' WHEN contains(said, nm) AND NOT (n_all > 0 AND n_all = n_road) THEN 'inside'
        WHEN len(list_filter(al, lambda a: a <> '' AND contains(said, a) AND NOT (len(regexp_extract_all(said, '\\b' || a || '\\b')) > 0
          AND len(regexp_extract_all(said, '\\b' || a || '\\b')) = len(regexp_extract_all(said, '\\b' || a || '\\s+({geography.ROAD})\\b'))))) > 0 THEN 'inside'
        WHEN other THEN 'outside' WHEN km IS NULL THEN 'ambiguous' WHEN km <= rad THEN 'inside' ELSE 'outside' END AS status FROM v"""
)
def locality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is each map hit in the locality asked for."""
    places = table(spark, sf_dir, "places")
    return geography.requested_status(places, table(spark, sf_dir, "localities"), id_col="row_id", title="title", address="address", requested="requested", lat="latitude", lng="longitude").select("id", "status")


@_query(
    f"""WITH l AS (SELECT locality_id, centroid.lat AS a, centroid.lng AS b, max_radius_km AS r FROM localities WHERE centroid IS NOT NULL),
      q AS (SELECT x.locality_id AS id, min({s_round(s_haversine('x.a', 'x.b', 'y.a', 'y.b'))}) AS nearest_km FROM l x JOIN l y ON x.locality_id <> y.locality_id AND floor(y.a) BETWEEN floor(x.a) - 1 AND floor(x.a) + 1 GROUP BY x.locality_id)
      SELECT id, nearest_km, {s_round('least(greatest(nearest_km * 1.25, 2.0), 8.0)', 1)} AS radius FROM q"""
)
def locality_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest other locality within a band of latitude, and the radius it would give."""
    l = table(spark, sf_dir, "localities").where("centroid is not null").select(F.col("locality_id").alias("id"), F.col("centroid.lat").alias("a"), F.col("centroid.lng").alias("b"))
    near = l.withColumn("band", F.explode(F.sequence(F.floor("a") - 1, F.floor("a") + 1)))
    other = l.select(F.col("id").alias("id2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.floor("a").alias("band"))
    km = text.js_round(haversine_km(F.col("a"), F.col("b"), F.col("a2"), F.col("b2")), 2)
    q = near.join(other, "band").where("id <> id2").groupBy("id").agg(F.min(km).alias("nearest_km"))
    return q.select("id", "nearest_km", geography.clamped_radius(F.col("nearest_km")).alias("radius"))


@_query(
    f"""WITH f AS (SELECT evidence_id, lower(regexp_extract(website, '(?i)^(?:https?://)?(?:(?:www|m)\\.)?facebook\\.[a-z.]+/([^/?#\\s]+)', 1)) AS h FROM evidence WHERE website IS NOT NULL)
      SELECT evidence_id, regexp_replace(h, '[^a-z0-9._-]', '', 'g') AS handle FROM f WHERE h <> '' AND h NOT IN ({', '.join(repr(a) for a in social.ACTIONS)}) AND h NOT IN ('profile.php', 'people', 'pages', 'p', 'pg', 'in', 'company', 'channel', 'c', 'user')"""
)
def social_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of the pages on the largest network."""
    e = table(spark, sf_dir, "evidence").where("website is not null").select("evidence_id", social.platform_of(F.col("website")).alias("p"), social.handle_of(F.col("website")).alias("handle"))
    return e.where("p = 'facebook' and handle <> ''").select("evidence_id", "handle")


@_query()
def social_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by what their handle has of the business's name."""
    e = table(spark, sf_dir, "evidence").where("website is not null")
    return e.select("evidence_id", social.classify_social(F.col("website"), F.col("name")).alias("s")).select("evidence_id", "s.*").where("platform <> ''")


# ---- joins and components -------------------------------------------------------------------------------------------------


@_query(
    f"""WITH k AS (SELECT listing_index, canonical_key, {s_name_key('name')} AS k FROM listings),
      r AS (SELECT canonical_key, min(listing_index) AS rep FROM listings GROUP BY canonical_key)
      SELECT a.listing_index, r.rep, {s_jaccard('a.k', 'b.k')} AS similarity FROM k a JOIN r ON a.canonical_key = r.canonical_key JOIN k b ON b.listing_index = r.rep WHERE a.listing_index <> r.rep"""
)
def name_similarity_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each listing's name with that of the first of its key."""
    l = table(spark, sf_dir, "listings").select("listing_index", "canonical_key", text.name_key(F.col("name")).alias("k"))
    first = l.groupBy("canonical_key").agg(F.min("listing_index").alias("rep"), F.min_by("k", "listing_index").alias("k2"))
    return l.join(first, "canonical_key").where("listing_index <> rep").select("listing_index", "rep", text.token_jaccard(F.col("k"), F.col("k2")).alias("similarity"))


_VIEW = """SELECT {id} AS id, CASE WHEN length({d}) >= 7 THEN {d} ELSE '' END AS phone, CASE WHEN {t} OR ({h}) NOT LIKE '%.%' THEN '' ELSE ({h}) END AS host, {n} AS name, {a} AS address FROM {table}"""


def _s_view(t: str, id_: str, name: str, phone: str, site: str) -> str:
    h = s_host_or_bare(site)
    return _VIEW.format(table=t, id=id_, d=f"({s_match_digits(phone)})", t=s_third(f"({h})"), h=h, n=s_name_key(name), a=s_address_key("address"))


_VIEWS = f"""v AS ({_s_view('places', 'row_id', 'title', 'phone_number', 'website')}), w AS (SELECT DISTINCT * FROM ({_s_view('evidence', 'evidence_id', 'name', 'phone', 'domain')})),
      named AS (SELECT host, list_filter(list_distinct({s_tokens('name', 4)}), lambda t: NOT list_contains([{', '.join(repr(g) for g in text.GENERIC)}], t)) AS words FROM (SELECT host, name FROM v UNION ALL SELECT host, name FROM w) WHERE host <> '' AND name <> ''),
      often AS (SELECT host, max(k) AS k FROM (SELECT host, t, count(*) AS k FROM (SELECT host, unnest(words) AS t FROM named) GROUP BY host, t) GROUP BY host),
      shared AS (SELECT host FROM (SELECT host, count(*) AS n FROM named GROUP BY host HAVING count(*) >= 5) LEFT JOIN often USING (host) WHERE coalesce(k, 0) * 2 < n),
      a AS (SELECT id, phone, CASE WHEN host IN (SELECT host FROM shared) THEN '' ELSE host END AS host, name, address FROM v),
      b AS (SELECT id, phone, CASE WHEN host IN (SELECT host FROM shared) THEN '' ELSE host END AS host, name, address FROM w)"""


def _evidence_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = matching.evidence_view(table(spark, sf_dir, "places"), "row_id", "title", "phone_number", "website", "address")
    b = matching.evidence_view(table(spark, sf_dir, "evidence"), "evidence_id", "name", "phone", "domain", "address").distinct()
    return matching.own_hosts(a, b)


@_query(
    f"""WITH {_VIEWS},
      p AS (SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.phone <> '' AND a.phone = b.phone UNION SELECT a.id, b.id FROM a JOIN b ON a.host <> '' AND a.host = b.host),
      m AS (SELECT DISTINCT p.*, CASE WHEN a.phone <> '' AND a.phone = b.phone THEN 'phone' ELSE 'domain' END AS method FROM p JOIN a ON p.a_id = a.id JOIN b ON p.b_id = b.id
            WHERE (a.phone <> '' AND a.phone = b.phone) OR (a.host <> '' AND a.host = b.host))
      SELECT method, count(*) AS pairs, count(DISTINCT a_id) AS places, count(DISTINCT b_id) AS evidence FROM m GROUP BY method"""
)
def hard_match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of places and evidence by equal phone or host, counted by rule.

    Only keys are joined: no pair is compared again, and of a pair only its ids are kept.
    """
    a, b = _evidence_views(spark, sf_dir)
    on = lambda df, c, i: df.where(F.col(c) != "").select(F.col("id").alias(i), c).distinct()
    met = lambda c: on(a, c, "a_id").join(on(b, c, "b_id"), c).select("a_id", "b_id")
    m = met("phone").withColumn("rule", F.lit(0)).unionByName(met("host").withColumn("rule", F.lit(1))).groupBy("a_id", "b_id").agg(F.min("rule").alias("rule"))
    return m.groupBy(F.when(F.col("rule") == 0, "phone").otherwise("domain").alias("method")).agg(F.count("*").alias("pairs"), F.count_distinct("a_id").alias("places"), F.count_distinct("b_id").alias("evidence"))


@_query(
    f"""WITH {_VIEWS},
      wa AS (SELECT id, name, unnest(list_distinct({s_tokens('name')})) AS w FROM a), wb AS (SELECT id, name, unnest(list_distinct({s_tokens('name')})) AS w FROM b),
      alike AS (SELECT x.id AS a_id, y.id AS b_id FROM (SELECT id, w, count(*) OVER (PARTITION BY id, name) AS n FROM wa) x JOIN (SELECT id, w, count(*) OVER (PARTITION BY id, name) AS n FROM wb) y ON x.w = y.w GROUP BY x.id, y.id HAVING count(*) >= 0.85 * max(x.n) AND count(*) >= 0.85 * max(y.n)),
      p AS (SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.phone <> '' AND a.phone = b.phone UNION SELECT a.id, b.id FROM a JOIN b ON a.host <> '' AND a.host = b.host UNION SELECT a_id, b_id FROM alike),
      m AS (SELECT p.*, CASE WHEN a.phone <> '' AND a.phone = b.phone THEN 'phone' WHEN a.host <> '' AND a.host = b.host THEN 'domain'
              WHEN (a.phone <> '' AND b.phone <> '') OR (a.host <> '' AND b.host <> '') THEN 'none'
              WHEN {s_jaccard('a.name', 'b.name')} >= 0.85 AND {s_jaccard('a.address', 'b.address')} >= 0.5 THEN 'name_address' WHEN {s_jaccard('a.name', 'b.name')} >= 0.95 THEN 'name' ELSE 'none' END AS method
            FROM p JOIN a ON p.a_id = a.id JOIN b ON p.b_id = b.id)
      SELECT a_id, b_id, method, CASE WHEN method IN ('phone', 'domain') THEN 1.0::DOUBLE WHEN method = 'name' THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM m WHERE method <> 'none'"""
)
def entity_pair_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and evidence by the whole cascade."""
    return matching.pair_cascade(*_evidence_views(spark, sf_dir))


_SAID_BY = f"""SELECT run_id, listing_index, {s_name_key('name')} AS name_key,
        list_distinct(list_filter(list_transform(list_concat(phones, mobiles), lambda p: {s_match_digits('p')}), lambda d: length(d) >= 7)) AS phones,
        list_distinct(list_filter(list_transform(emails, lambda e: lower(trim(e))), lambda e: contains(e, '@'))) AS emails,
        list_distinct(list_filter(list_transform(websites, lambda w: {s_host_or_bare('w')}), lambda h: contains(h, '.') AND NOT {s_third('h')})) AS hosts,
        list_distinct(list_filter(list_transform(list_concat([social_links.facebook, social_links.tiktok, social_links.instagram], coalesce(map_values(social_links.other), [])), lambda u: regexp_replace(lower(trim(u)), '/+$', '')), lambda u: u IS NOT NULL AND u <> '')) AS socials,
        latitude AS lat, longitude AS lng FROM listings WHERE run_id IS NOT NULL"""


@_query(
    f"""WITH s AS ({_SAID_BY}),
      p AS (SELECT a.run_id, a.listing_index AS a, b.listing_index AS b, len(list_intersect(a.phones, b.phones)) AS np, len(list_intersect(a.emails, b.emails)) AS ne, len(list_filter(list_intersect(a.emails, b.emails), lambda e: {s_identifying('e')})) AS nm,
          len(list_intersect(a.hosts, b.hosts)) AS nh, len(list_intersect(a.socials, b.socials)) AS ns, {s_haversine('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS km, {s_jaccard('a.name_key', 'b.name_key')} AS j
        FROM s a JOIN s b ON a.run_id = b.run_id AND a.listing_index < b.listing_index),
      c AS (SELECT *, least(0.99, {s_round("(CASE WHEN nm > 0 THEN 0.40 WHEN ne > 0 THEN 0.30 ELSE 0.0 END + CASE WHEN np >= 2 THEN 0.45 WHEN np = 1 THEN 0.35 ELSE 0.0 END + CASE WHEN nh > 0 THEN 0.35 ELSE 0.0 END + CASE WHEN ns >= 3 THEN 0.25 WHEN ns > 0 THEN 0.15 ELSE 0.0 END + CASE WHEN km < 0.05 THEN 0.35 WHEN km < 0.5 THEN 0.30 ELSE 0.0 END + CASE WHEN j >= 0.85 THEN 0.15 ELSE 0.0 END)::DOUBLE")}) AS confidence,
          CASE WHEN km < 0.05 AND np > 0 AND nh > 0 THEN 'DUPLICATE_MAPS_LISTING' WHEN np > 0 OR nm > 0 THEN 'POSSIBLY_SAME_ENTITY' WHEN nh > 0 OR ns > 0 THEN 'RELATED_BRAND' WHEN ne > 0 OR km < 0.5 THEN 'SHARED_OFFICE' END AS type FROM p)
      SELECT run_id, a, b, type, confidence FROM c WHERE type IS NOT NULL AND confidence >= 0.30"""
)
def run_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts between the listings of one run, by what they share and by nearness."""
    return graph.run_conflicts(table(spark, sf_dir, "listings"))


@_query()
def listing_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts between classes of listings that share a contact."""
    return graph.conflict_pairs(graph.contact_view(table(spark, sf_dir, "listings")))


@_query(
    """WITH RECURSIVE e AS (SELECT DISTINCT CAST(listing_index_a AS BIGINT) AS a, CAST(listing_index_b AS BIGINT) AS b FROM conflicts WHERE listing_index_a IS NOT NULL AND listing_index_b IS NOT NULL AND conflict_type = 'DUPLICATE_MAPS_LISTING'),
      u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS m FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.node)
      SELECT node, min(m) AS component FROM r GROUP BY node"""
)
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the duplicates found on the map."""
    c = table(spark, sf_dir, "conflicts").where("conflict_type = 'DUPLICATE_MAPS_LISTING'")
    return graph.components(c, "listing_index_a", "listing_index_b")


@_query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT CAST(listing_index_a AS BIGINT) AS a, CAST(listing_index_b AS BIGINT) AS b FROM conflicts WHERE listing_index_a IS NOT NULL AND listing_index_b IS NOT NULL AND conflict_type = 'DUPLICATE_MAPS_LISTING'),
      u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS m FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.node),
      c AS (SELECT node, min(m) AS component FROM r GROUP BY node), l AS (SELECT c.component, l.* FROM c JOIN listings l ON c.node = l.listing_index),
      h AS (SELECT component, count(DISTINCT h) AS domains FROM (SELECT component, {s_host_or_bare('w')} AS h FROM (SELECT component, unnest(websites) AS w FROM l)) WHERE h <> '' GROUP BY component),
      s AS (SELECT l.component, count(*) AS members, count(*) > 3 OR coalesce(max(h.domains), 0) >= 2 AS suspected FROM l LEFT JOIN h ON l.component = h.component GROUP BY l.component),
      k AS (SELECT l.component, l.listing_index, row_number() OVER (PARTITION BY l.component ORDER BY coalesce(confidence, 0) DESC, len(phones) + len(mobiles) + len(emails) DESC, CASE WHEN source = 'maps' THEN 0 ELSE 1 END, coalesce(name, ''), listing_index) AS rn FROM l),
      g AS (SELECT component, list_sort(list_distinct(flatten(list(phones)))) AS phones, list_sort(list_distinct(list(name) FILTER (name IS NOT NULL))) AS aliases FROM l GROUP BY component)
      SELECT s.component, s.members, s.suspected, CASE WHEN NOT s.suspected THEN k.listing_index END AS survivor, CASE WHEN s.suspected THEN [] ELSE g.phones END AS phones, CASE WHEN s.suspected THEN [] ELSE g.aliases END AS aliases
      FROM s JOIN k ON s.component = k.component AND k.rn = 1 JOIN g ON s.component = g.component"""
)
def duplicate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates merged, suspected clusters left."""
    listings = table(spark, sf_dir, "listings").select("listing_index", "name", "phones", "mobiles", "emails", "websites", "confidence", "source")
    return graph.merge_duplicates(listings, duplicate_components(spark, sf_dir)).select("component", "members", "suspected", "survivor", "phones", "aliases")


@_query(
    f"""WITH w AS (SELECT DISTINCT {s_host_or_bare('w')} AS host FROM (SELECT unnest(websites) AS w FROM listings))
      SELECT host, count(*) AS n FROM (SELECT {s_host_or_bare('domain')} AS host FROM evidence WHERE domain IS NOT NULL) WHERE host <> '' AND host NOT IN (SELECT host FROM w) GROUP BY host"""
)
def unlisted_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of evidence that no listing has."""
    listed = table(spark, sf_dir, "listings").select(F.explode("websites").alias("w")).select(urls.domain_or_host(F.col("w")).alias("host"))
    e = table(spark, sf_dir, "evidence").where("domain is not null").select(urls.domain_or_host(F.col("domain")).alias("host")).where("host <> ''")
    return matching.unmatched(e, listed, ["host"]).groupBy("host").agg(F.count("*").alias("n"))


@_query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seen_at, evidence_id) AS rn FROM (SELECT DISTINCT * FROM evidence WHERE provider = 'page_extract') x)
      SELECT r.run_id, o.evidence_id, o.name FROM runs r LEFT JOIN (SELECT * FROM o WHERE rn = 1) o ON r.run_id = o.run_id"""
)
def first_page_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run with the first page read for it."""
    e = table(spark, sf_dir, "evidence").where("provider = 'page_extract'").distinct().select("run_id", "evidence_id", "name", F.struct("seen_at", "evidence_id").alias("o"))
    return matching.first_match(table(spark, sf_dir, "runs").select("run_id"), e, ["run_id"], "o").select("run_id", "evidence_id", "name")


@_query(
    """WITH p AS (SELECT run_id, evidence_id FROM evidence WHERE provider = 'serp_primary'), s AS (SELECT run_id, evidence_id FROM evidence WHERE provider = 'serp_secondary')
      SELECT * FROM p UNION ALL SELECT s.* FROM s WHERE s.run_id NOT IN (SELECT run_id FROM p WHERE run_id IS NOT NULL)"""
)
def search_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the first provider, of the second for runs without."""
    e = table(spark, sf_dir, "evidence").select("run_id", "evidence_id", "provider")
    pick = lambda p: e.where(F.col("provider") == p).drop("provider")
    return cache.with_fallback(pick("serp_primary"), pick("serp_secondary"), "run_id").select("run_id", "evidence_id")


_ASKED = "string_split(trim(split_part(query_key, ' in ', 1)), ' ')"


@_query(
    f"""WITH r AS (SELECT run_id, {_ASKED} AS terms FROM runs WHERE query_key IS NOT NULL),
      p AS (SELECT row_id, run_id, string_split({s_name_key("concat_ws(' ', title, category)")}, ' ') AS words FROM places)
      SELECT p.row_id, CASE WHEN list_has_any(p.words, ['closed', 'atm', 'parking']) THEN 'irrelevant' WHEN list_has_any(p.words, r.terms) THEN 'relevant' ELSE 'ambiguous' END AS label FROM p JOIN r ON p.run_id = r.run_id"""
)
def category_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do map hits belong to the kind of business that was searched for."""
    r = table(spark, sf_dir, "runs").where("query_key is not null").select("run_id", F.split(F.trim(F.split("query_key", " in ")[0]), " ").alias("terms"))
    p = table(spark, sf_dir, "places").select("row_id", "run_id", text.name_key(F.concat_ws(" ", "title", "category")).alias("said"))
    lit = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    return p.join(r, "run_id").select("row_id", gates.relevance(F.col("said"), F.col("terms"), F.col("terms"), lit("closed", "atm", "parking"))["label"].alias("label"))


@_query(
    """WITH q AS (SELECT run_id, trim(split_part(query, ' in ', 1)) AS c, coalesce(location, '') AS l FROM runs WHERE query IS NOT NULL),
      v AS (SELECT run_id, unnest([c, c || ' services', 'best ' || c]) AS q, l FROM q)
      SELECT DISTINCT run_id, CASE WHEN l = '' OR contains(lower(q), lower(l)) THEN q ELSE q || ' ' || l END AS query FROM v"""
)
def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries into which a search is expanded."""
    c = F.trim(F.split("query", " in ")[0])
    q = gates.expand_queries(c, F.coalesce("location", F.lit("")), F.array(F.concat(c, F.lit(" services")), F.concat(F.lit("best "), c)))
    return table(spark, sf_dir, "runs").where("query is not null").select("run_id", F.explode(q).alias("query"))


@_query(
    f"""WITH h AS (SELECT evidence_id, {s_host_or_bare('domain')} AS host, coalesce(website, '') AS url, list_filter({s_tokens(s_lenient('name'))}, lambda t: NOT list_contains([{', '.join(repr(g) for g in text.GENERIC)}], t)) AS words FROM evidence)
      SELECT evidence_id, CASE WHEN host = '' THEN 'unverified' WHEN regexp_matches(host, '\\.(sitehost|weebpage|wixsite|blogspot|wordpress)\\.') THEN 'service_platform' WHEN {s_third('host')} OR regexp_matches(url, '{urls.DIRECTORY_PATH}') THEN 'directory'
        WHEN len(list_filter(words, lambda t: length(t) >= 4 AND contains(host, t))) > 0 THEN 'first_party' WHEN len(words) = 0 THEN 'related_entity' ELSE 'unrelated' END AS relation FROM h"""
)
def website_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the website of a search hit is to the business it names."""
    rel = gates.relationship(urls.domain_or_host(F.col("domain")), F.coalesce("website", F.lit("")), F.col("name"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "evidence").select("evidence_id", rel.alias("relation"))


@_query(
    _PHONE_SQL.replace("FROM evidence)", "FROM (SELECT DISTINCT listing_index AS evidence_id, unnest(list_concat(phones, mobiles)) AS phone FROM listings))").split("SELECT evidence_id, k[1] AS type")[0]
    + "SELECT evidence_id AS listing_index, coalesce(list_sort(list_distinct(list(k[2]) FILTER (k[1] IN ('landline', 'international')))), []) AS phones, coalesce(list_sort(list_distinct(list(k[2]) FILTER (k[1] = 'mobile'))), []) AS mobiles FROM k WHERE k[1] <> 'invalid' GROUP BY evidence_id"
)
def contact_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V06, V08, §1.5: numbers sorted into phones and mobiles, each once, so that the two never share one."""
    n = table(spark, sf_dir, "listings").select("listing_index", F.explode(F.array_distinct(F.concat("phones", "mobiles"))).alias("p")).select("listing_index", phones.classify(F.col("p")).alias("k")).where("k.type <> 'invalid'")
    kept = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("k.digits"))))
    return n.groupBy("listing_index").agg(kept(F.col("k.type").isin("landline", "international")).alias("phones"), kept(F.col("k.type") == "mobile").alias("mobiles"))


@_query(
    """WITH f AS (SELECT canonical_key, arg_min(social_links.facebook, (ingested_at, listing_index)) AS first_page FROM listings WHERE coalesce(social_links.facebook, '') <> '' AND canonical_key IS NOT NULL GROUP BY canonical_key)
      SELECT l.listing_index, coalesce(nullif(l.social_links.facebook, ''), f.first_page) AS page, coalesce(l.social_links.facebook, '') = '' AND f.first_page IS NOT NULL AS filled FROM listings l LEFT JOIN f ON l.canonical_key = f.canonical_key"""
)
def social_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing pages filled from the first row of the same key that has one."""
    l = table(spark, sf_dir, "listings").select("listing_index", "canonical_key", F.nullif("social_links.facebook", F.lit("")).alias("page"), "ingested_at")
    first = l.where("page is not null and canonical_key is not null").groupBy("canonical_key").agg(F.min_by("page", F.struct("ingested_at", "listing_index")).alias("first_page"))
    return l.join(first, "canonical_key", "left").select("listing_index", F.coalesce("page", "first_page").alias("page"), (F.col("page").isNull() & F.col("first_page").isNotNull()).alias("filled"))


@_query()
def candidate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01-P05, F05-F09, F26-F28, C15, A12, §3.1: the run of all stages; what became of every candidate."""
    found = pipeline.candidates(table(spark, sf_dir, "places"), table(spark, sf_dir, "evidence"), table(spark, sf_dir, "localities"))
    return pipeline.ledger(pipeline.listings(found, table(spark, sf_dir, "documents")))


# ---- aggregations, windows, top-k -----------------------------------------------------------------------------------------


@_query(
    """WITH g AS (SELECT *, coalesce(nullif(place_id, ''), nullif(cid, ''), lower(coalesce(title, '')) || '|' || lower(coalesce(address, ''))) AS k FROM places)
      SELECT k, count(*) AS members, min(row_id) AS first_row, bool_or(coalesce(website, '') <> '') AS has_website, bool_or(coalesce(phone_number, '') <> '') AS has_phone FROM g GROUP BY k"""
)
def discovery_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map hits grouped by identity."""
    k = F.coalesce(F.nullif("place_id", F.lit("")), F.nullif("cid", F.lit("")), F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit("|"), F.lower(F.coalesce("address", F.lit("")))))
    has = lambda c: F.bool_or(F.coalesce(c, F.lit("")) != "")
    return table(spark, sf_dir, "places").withColumn("k", k).groupBy("k").agg(F.count("*").alias("members"), F.min("row_id").alias("first_row"), has("website").alias("has_website"), has("phone_number").alias("has_phone"))


_LOOKUP = "CASE WHEN coalesce(phone_number, '') <> '' THEN 1.0 ELSE 0.0 END + CASE WHEN coalesce(address, '') <> '' THEN 1.0 ELSE 0.0 END + coalesce(rating, 0) / 5 + least(coalesce(rating_count, 0), 500) / 500"


@_query(
    f"""WITH s AS (SELECT run_id, row_id, {_LOOKUP} AS score FROM places WHERE coalesce(website, '') = ''),
      r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, row_id) AS rank FROM s) SELECT run_id, row_id, rank, CASE WHEN rank <= 3 THEN 'looked_up' ELSE 'not_attempted' END AS state FROM r"""
)
def lookup_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places without website ranked per run; the budget decides their state."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "places").where("coalesce(website, '') = ''").select("run_id", "row_id", ranking.lookup_score(F.col("phone_number"), F.col("address"), F.col("rating"), F.col("rating_count")).alias("score"))
    r = p.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("score").desc(), "row_id")))
    return r.select("run_id", "row_id", F.col("rank").cast("long").alias("rank"), F.when(F.col("rank") <= 3, "looked_up").otherwise("not_attempted").alias("state"))


_STATES = ("success", "empty", "failed", "cache-hit", "partial")


@_query("SELECT query_key, count(*) AS runs, " + ", ".join(f"CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{s.replace('-', '_')}\"" for s in _STATES) + ", CAST(sum(coalesce(listing_count, 0)) AS BIGINT) AS listings, CAST(sum(CASE WHEN served_from_cache THEN 1 ELSE 0 END) AS BIGINT) AS cached, CAST(sum(CASE WHEN listing_count <> len(canonical_keys) THEN 1 ELSE 0 END) AS BIGINT) AS miscounted FROM runs GROUP BY query_key")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03, A11-A14, A17, A18, §1.5: counters of runs, zero-filled, with a check of their counts."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table(spark, sf_dir, "runs").groupBy("query_key").agg(
        F.count("*").alias("runs"), *(n(F.col("status") == s).alias(s.replace("-", "_")) for s in _STATES), F.sum(F.coalesce("listing_count", F.lit(0))).alias("listings"), n(F.col("served_from_cache")).alias("cached"), n(F.col("listing_count") != F.size("canonical_keys")).alias("miscounted")
    )


@_query(
    """WITH r AS (SELECT run_id, listing_index, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(confidence, 0) DESC, len(phones) + len(mobiles) + len(emails) + len(websites) DESC, listing_index) AS rank FROM listings)
      SELECT run_id, listing_index, rank FROM r WHERE rank <= 10"""
)
def quality_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best listings of each run."""
    l = table(spark, sf_dir, "listings").select("run_id", "listing_index", F.coalesce("confidence", F.lit(0.0)).alias("c"), (F.size("phones") + F.size("mobiles") + F.size("emails") + F.size("websites")).alias("n"))
    return ranking.top_per(l, ["run_id"], [F.col("c").desc(), F.col("n").desc(), F.col("listing_index")], 10).select("run_id", "listing_index", F.col("rank").cast("long").alias("rank"))


@_query(
    f"""WITH n AS (SELECT doc_id, site, {s_normal('url')} AS u FROM documents WHERE url IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY doc_id) AS rn FROM n)
      SELECT site, doc_id, u, row_number() OVER (PARTITION BY site ORDER BY doc_id) AS rank FROM f WHERE rn = 1"""
)
def url_dedupe_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each URL, ranked anew within its site.

    Pages are counted by stretches of ids first, so the pages of a large site are never sorted in one task.
    """
    from pyspark.sql import Window

    n = table(spark, sf_dir, "documents").where("url is not null").select("doc_id", "site", urls.normalize_url(F.col("url")).alias("u"))
    f = stage(n.groupBy("u").agg(F.min_by(F.struct("doc_id", "site"), "doc_id").alias("d")).select("d.site", "d.doc_id", "u"), "firsts")
    lo, hi = f.agg(F.min("doc_id"), F.max("doc_id")).first()
    stretch = F.floor((F.col("doc_id") - (lo or 0)) / max(1, ((hi or 0) - (lo or 0)) // 256 + 1)).cast("int")
    f = f.withColumn("stretch", stretch)
    sums = f.groupBy("site", "stretch").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("site").orderBy("stretch")) - F.col("n")).drop("n").withColumnRenamed("site", "s").withColumnRenamed("stretch", "k")
    ranked = f.join(before, F.col("site").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("k")))
    return ranked.select("site", "doc_id", "u", (F.col("before") + F.row_number().over(Window.partitionBy("site", "stretch").orderBy("doc_id"))).cast("long").alias("rank"))


@_query(
    f"""WITH s AS (SELECT site, doc_id, {' + '.join(f"CASE WHEN regexp_matches(url, '(?i)/{p}') THEN 1 ELSE 0 END" for p in urls.PRIORITY)} AS score FROM documents WHERE url IS NOT NULL AND NOT ({s_host('url')} = '' OR regexp_matches({s_path('url')}, '{urls.IGNORED}'))),
      r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, doc_id) AS rank FROM s) SELECT site, doc_id, score, rank FROM r WHERE rank <= 5"""
)
def site_top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pages of each site to read first."""
    d = table(spark, sf_dir, "documents").where("url is not null").where(~urls.ignored_path(F.col("url"))).select("site", "doc_id", urls.priority_score(F.col("url")).alias("score"))
    return ranking.top_per(d, ["site"], [F.col("score").desc(), F.col("doc_id")], 5).select("site", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@_query()
def official_website(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best first-party website of each name in a run, with its score."""
    e = table(spark, sf_dir, "evidence").where("website is not null and name is not null").select("run_id", "name", "website", "evidence_id", F.coalesce("address", F.lit("")).alias("place")).distinct()
    score, eligible = ranking.website_score(F.col("website"), F.lit(""), F.col("name"), F.col("place"))
    s = e.withColumn("score", score).withColumn("eligible", eligible).where(F.col("eligible") & (F.col("score") >= ranking.LEAST))
    return ranking.top_per(s, ["run_id", "name"], [F.col("score").desc(), F.col("evidence_id")], 1).select("run_id", "name", "website", "score")


@_query(
    f"""WITH c AS (SELECT DISTINCT listing_index, {s_match_digits('p')} AS d FROM (SELECT listing_index, unnest(list_concat(phones, mobiles)) AS p FROM listings))
      SELECT listing_index, count(*) AS numbers, list_sort(list(d)) AS digits FROM c WHERE length(d) >= 7 GROUP BY listing_index"""
)
def contact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a listing, once each."""
    l = table(spark, sf_dir, "listings").select("listing_index", F.explode(F.concat("phones", "mobiles")).alias("p")).select("listing_index", phones.match_digits(F.col("p")).alias("d")).where("length(d) >= 7").distinct()
    return l.groupBy("listing_index").agg(F.count("*").alias("numbers"), F.array_sort(F.collect_list("d")).alias("digits"))


@_query(
    f"""WITH l AS (SELECT canonical_key, {s_clean('phones')} AS phones, {s_clean('emails')} AS emails, ingested_at, run_id, name, listing_index FROM listings WHERE canonical_key IS NOT NULL AND canonical_key <> '')
      SELECT canonical_key, arg_min(name, (ingested_at, listing_index)) AS first_name, list_sort(list_distinct(flatten(list(phones)))) AS phones, list_sort(list_distinct(flatten(list(emails)))) AS emails, min(ingested_at) AS first_seen, max(ingested_at) AS last_seen, count(DISTINCT run_id) AS run_count
      FROM l WHERE name IS NOT NULL GROUP BY canonical_key"""
)
def accumulated_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of each key as they accumulate over runs."""
    return store.accumulate(table(spark, sf_dir, "listings").where("name is not null")).select("canonical_key", "first_name", "phones", "emails", "first_seen", "last_seen", "run_count")


@_query(
    """WITH e AS (SELECT run_id, unnest(canonical_keys) AS k FROM runs) SELECT run_id, count(DISTINCT k) AS keys, min(k) AS first_key FROM e GROUP BY run_id"""
)
def run_canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of each run."""
    return table(spark, sf_dir, "runs").select("run_id", F.explode("canonical_keys").alias("k")).groupBy("run_id").agg(F.count_distinct("k").alias("keys"), F.min("k").alias("first_key"))


@_query(
    """WITH e AS (SELECT 'broad-search' AS provider, query, completed_at AS stored_at, run_id AS payload FROM runs WHERE query IS NOT NULL),
      k AS (SELECT *, substr(sha256(provider || '::' || query), 1, 16) AS key, row_number() OVER (PARTITION BY sha256(provider || '::' || query) ORDER BY stored_at DESC, payload) AS rn FROM e WHERE stored_at > TIMESTAMP '2026-06-30' - INTERVAL 7 DAY)
      SELECT key, query, stored_at, payload FROM k WHERE rn = 1"""
)
def cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest cached answer of each query that is young enough."""
    e = table(spark, sf_dir, "runs").where("query is not null").select(F.lit("broad-search").alias("provider"), "query", F.col("completed_at").alias("stored_at"), F.col("run_id").alias("payload"))
    return cache.read_fresh(e, F.expr("TIMESTAMP_NTZ '2026-06-30'")).select("key", "query", "stored_at", "payload")


@_query(
    """WITH p AS (SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY row_id) - 1 AS BIGINT) // 5 + 1 AS page, place_id, row_id FROM places),
      f AS (SELECT run_id, place_id, min(page) AS page FROM p GROUP BY run_id, place_id), n AS (SELECT run_id, page, count(*) AS new FROM f GROUP BY run_id, page),
      a AS (SELECT d.run_id, d.page, coalesce(n.new, 0) AS new FROM (SELECT DISTINCT run_id, page FROM p) d LEFT JOIN n ON d.run_id = n.run_id AND d.page = n.page),
      r AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY page) AS seen, sum(new) OVER (PARTITION BY run_id ORDER BY page ROWS 1 PRECEDING) AS two, row_number() OVER (PARTITION BY run_id ORDER BY page) AS k FROM a),
      s AS (SELECT run_id, min(CASE WHEN seen >= 12 OR (two = 0 AND k >= 2) OR page >= 10 THEN page END) AS last FROM r GROUP BY run_id)
      SELECT p.run_id, count(*) AS rows_read, max(p.page) AS last_page FROM p JOIN s ON p.run_id = s.run_id WHERE s.last IS NULL OR p.page <= s.last GROUP BY p.run_id"""
)
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S04, §2.6: recorded pages of a scan up to its reason to stop."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("row_id")
    p = table(spark, sf_dir, "places").select("run_id", "place_id", "row_id").withColumn("page", (F.floor((F.row_number().over(w) - 1) / 5) + 1).cast("long"))
    return cache.stop_page(p, "run_id", "page", "place_id", target=12).groupBy("run_id").agg(F.count("*").alias("rows_read"), F.max("page").alias("last_page"))


@_query(
    f"""WITH b AS (SELECT listing_index, source IN ('maps') AS is_maps, latitude IS NOT NULL AND longitude IS NOT NULL AS gps, coalesce(location, '') <> '' AS addr, len(phones) + len(mobiles) AS n, len(emails) > 0 AS mail, coalesce(confidence, 0) AS v, len(websites) > 0 AS web,
        CASE WHEN has_conflict THEN 0.75 ELSE 1.0 END AS pen FROM listings),
      c AS (SELECT *, CASE WHEN is_maps THEN {s_round('least(0.8 + (CASE WHEN gps THEN 0.05 ELSE 0.0 END + CASE WHEN addr THEN 0.05 ELSE 0.0 END), 1.0)')} ELSE 0.0 END AS maps, CASE WHEN web THEN {s_round('least(v * 1.0, 1.0)')} ELSE 0.0 END AS website,
        {s_round('least(CASE WHEN is_maps AND n > 0 AND NOT web THEN 0.4 ELSE 0.0 END + CASE WHEN mail THEN 0.3 ELSE 0.0 END + CASE WHEN addr THEN 0.2 ELSE 0.0 END + CASE WHEN n >= 2 THEN 0.1 ELSE 0.0 END, 1.0)')} AS contact FROM b)
      SELECT listing_index, maps, website, contact, {s_round('least((CASE WHEN is_maps AND NOT web THEN maps * 0.65 + 0.175 ELSE maps * 0.3 + website * 0.35 + contact * 0.35 END) * pen, 1.0)')} AS overall FROM c"""
)
def confidence_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence of listings by what is known of them."""
    l = table(spark, sf_dir, "listings")
    maps, web, addr, n = F.col("source") == "maps", F.size("websites") > 0, F.coalesce("location", F.lit("")) != "", F.size("phones") + F.size("mobiles")
    b = l.select(
        "listing_index", maps.alias("is_maps"), web.alias("web"), F.when(F.col("has_conflict"), "POSSIBLY_SAME_ENTITY").alias("kind"),
        scoring.maps_confidence(maps, F.lit(0), F.lit(False), F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), addr).alias("maps"),
        F.when(web, scoring.website_confidence(F.coalesce("confidence", F.lit(0.0)), F.lit("first_party"))).otherwise(0.0).alias("website"),
        scoring.contact_confidence(maps & (n > 0) & ~web, F.size("emails") > 0, addr, n).alias("contact"),
    )
    return b.select("listing_index", "maps", "website", "contact", scoring.overall_confidence(F.col("maps"), F.col("website"), F.col("contact"), scoring.conflict_penalty(F.col("kind")), F.col("is_maps") & ~F.col("web")).alias("overall"))


@_query(
    f"""WITH t AS (SELECT site, string_agg(lower(coalesce(text, '')), chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY site),
      e0 AS (SELECT evidence_id, {s_host_or_bare('domain')} AS host, {s_name_key('name')} AS k, {s_address_key('address')} AS a FROM (SELECT evidence_id, min(domain) AS domain, min(name) AS name, min(address) AS address FROM evidence WHERE domain IS NOT NULL GROUP BY evidence_id)),
      named AS (SELECT host, list_filter(list_distinct({s_tokens('k', 4)}), lambda t: NOT list_contains([{', '.join(repr(g) for g in text.GENERIC)}], t)) AS words FROM e0 WHERE host <> '' AND k <> '' AND NOT {s_third('host')}),
      often AS (SELECT host, max(k) AS k FROM (SELECT host, t, count(*) AS k FROM (SELECT host, unnest(words) AS t FROM named) GROUP BY host, t) GROUP BY host),
      shared AS (SELECT host FROM (SELECT host, count(*) AS n FROM named GROUP BY host HAVING count(*) >= 5) LEFT JOIN often USING (host) WHERE coalesce(k, 0) * 2 < n),
      e AS (SELECT * FROM e0 WHERE host NOT IN (SELECT host FROM shared)),
      j AS (SELECT e.evidence_id, len(list_filter(string_split(k, ' '), lambda x: length(x) >= 3)) AS nk, len(list_filter(string_split(k, ' '), lambda x: length(x) >= 3 AND contains(body, x))) AS hk,
        len(list_filter(string_split(a, ' '), lambda x: length(x) >= 3)) AS na, len(list_filter(string_split(a, ' '), lambda x: length(x) >= 3 AND contains(body, x))) AS ha FROM e JOIN t ON e.host = t.site WHERE NOT {s_third('e.host')}),
      s AS (SELECT evidence_id, nk > 0 AND hk / nk >= 0.6 AS nm, na > 0 AND ha / na >= 0.5 AS ad FROM j)
      SELECT evidence_id, CASE WHEN nm AND ad THEN 'verified' ELSE 'weak' END AS status, CAST({s_round('0.15 + 0.05 + CASE WHEN nm THEN 0.25 ELSE 0.0 END + CASE WHEN ad THEN 0.15 ELSE 0.0 END')} AS DOUBLE) AS confidence FROM s"""
)
def website_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a business's own site say its name and address."""
    docs = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "evidence").where("domain is not null").groupBy("evidence_id").agg(F.min("domain").alias("domain"), F.min("name").alias("name"), F.min("address").alias("address"))
    e = e.select("evidence_id", urls.domain_or_host(F.col("domain")).alias("site"), text.name_key(F.col("name")).alias("k"), text.address_key(F.col("address")).alias("a")).where(~urls.third_party(F.col("site"), matching.SHARED_HOSTS))
    e = stage(e, "asked")
    e = e.join(matching.directories(e.select(F.col("site").alias("host"), F.col("k").alias("name"))).withColumnRenamed("host", "site"), "site", "left_anti")
    # each word is looked for once in a site's pages, which are never gathered: a site's pages may be a tenth of all
    words = lambda c: F.transform(F.filter(F.split(c, " "), lambda t: F.length(t) >= 3), lambda t, i: F.struct(F.lit(c).alias("c"), i.alias("i"), t.alias("t")))
    asked = e.select("evidence_id", "site", F.explode(F.concat(words("k"), words("a"))).alias("x")).select("evidence_id", "site", "x.*")
    said = asked.select("site", "t").distinct().join(docs.select("site", F.lower(F.coalesce("text", F.lit(""))).alias("body")), "site").groupBy("site", "t").agg(F.bool_or(F.contains("body", F.col("t"))).alias("v"))
    count = lambda c, v: F.sum(F.when((F.col("c") == c) & v, 1).otherwise(0))
    held = asked.join(said, ["site", "t"]).groupBy("evidence_id").agg(*(count(c, F.col("v")).alias(f"n{c}") for c in ("k", "a")), *(count(c, F.lit(True)).alias(f"t{c}") for c in ("k", "a")))
    all_ = e.join(docs.select("site").distinct(), "site", "left_semi").select("evidence_id").join(held, "evidence_id", "left").fillna(0)
    share = lambda c: F.when(F.col(f"t{c}") > 0, F.col(f"n{c}") / F.col(f"t{c}")).otherwise(0.0)
    no, yes = F.lit(False), F.lit(True)
    v = scoring.verification({"gate": yes, "domain": yes, "name": share("k") >= 0.6, "phone": no, "address": share("a") >= 0.5, "email": no, "social": no}, yes)
    return all_.select("evidence_id", v.alias("v")).select("evidence_id", "v.status", "v.confidence")


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS \"count\" FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.15: counts by hour and type, by the plan that also runs on a stream."""
    return edges.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "count")
