"""Finding and reading a business's site: pages to read, who may be asked, and what the reading proved."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from milap.functions import phones, text, urls

#: Paths that are tried where a site's links don't fill the pages to read, with the page they should hold (fixed values).
GUESSED = (
    ("/contact", "contact"), ("/contact.php", "contact"), ("/contact-us", "contact"), ("/contact-us.php", "contact"), ("/about", "about"), ("/about.php", "about"), ("/aboutus.php", "about"),
    ("/about-us", "about"), ("/services", "services"), ("/our-services", "services"), ("/locations", "location"), ("/team", "team"), ("/menu", "menu"),
)
#: Points of pages among the links of a site (fixed values).
PAGE_POINTS = {"contact": 8, "location": 7, "about": 6, "services": 5, "team": 4, "menu": 3, "home": 2, "other": 1}
#: Domains of chains, with the brands that are theirs (fixed values).
CHAINS = {
    "ihg.com": "holiday inn|crowne plaza|intercontinental|kimpton|indigo",
    "marriott.com": "marriott|sheraton|westin|renaissance|courtyard",
    "hyatt.com": "hyatt|park hyatt|grand hyatt",
    "accor.com": "ibis|mercure|novotel|sofitel|pullman",
    "hilton.com": "hilton|hampton|waldorf|conrad|doubletree",
    "wyndham.com": "wyndham|ramada|days inn|super 8|la quinta",
}
#: Marks of pages that a script builds (fixed pattern).
SCRIPTED = r"(?i)__NEXT_DATA__|window\.__NUXT__|data-reactroot|data-svelte|window\.__remixContext"


def overfetch_cap(target: int | None) -> int | None:
    """How many places are scanned for ``target`` wanted ones: twice as many, five more at least; no cap without a target."""
    return None if target is None else max(math.ceil(target * 2.0), target + 5)


def deep_verify_cap(explicit: int | None, target: int | None) -> int:
    """How many candidates are verified in depth: the explicit number, else the target, ten at least."""
    return explicit if explicit is not None else max(target, 10) if target else 10


def guessed_pages(sites: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``(site, url, page_type, rank)``: for each ``(site, origin)`` the first ``most`` guessed pages whose URL isn't among the ``(site, url)`` known ones."""
    guess = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t).alias("page_type"), F.lit(i).alias("i")) for i, (p, t) in enumerate(GUESSED)))
    g = sites.select("site", "origin", F.explode(guess).alias("g")).select("site", F.concat(F.regexp_replace("origin", "/+$", ""), "g.path").alias("url"), "g.page_type", "g.i")
    left = g.join(known.select("site", "url").distinct(), ["site", "url"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("i"))).where(F.col("rank") <= most).drop("i")


def pages_to_read(sites: DataFrame, links: DataFrame, most: int = 5) -> DataFrame:
    """``(site, url, page_type, found, rank)``: the homepage, then the site's links by the page they lead to, contact pages first, then guessed pages, ``most`` in all.

    ``sites``: (site, origin), one row each; ``links``: (site, url, at) in the order found. Repeated links count once. Sites without links are guessed whole.
    """
    home = sites.select("site", F.regexp_replace("origin", "/+$", "").alias("url"), F.lit("home").alias("page_type"), F.lit("homepage").alias("found"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("at"))
    kind = urls.crawl_page(F.col("url"))
    points = F.lit(0)
    for k, v in PAGE_POINTS.items():
        points = F.when(F.col("page_type") == k, v).otherwise(points)
    own = links.join(sites.select("site"), "site", "left_semi").groupBy("site", F.regexp_replace("url", "/+$", "").alias("url")).agg(F.min("at").cast("long").alias("at")).join(home.select("site", "url"), ["site", "url"], "left_anti")
    linked = own.withColumn("page_type", kind).select("site", "url", "page_type", F.lit("link").alias("found"), (10 - points).alias("tier"), "at")
    both = home.unionByName(linked)
    guessed = guessed_pages(sites, both.select("site", "url"), most).select("site", "url", "page_type", F.lit("fallback_guess").alias("found"), F.lit(20).alias("tier"), F.col("rank").cast("long").alias("at"))
    w = Window.partitionBy("site").orderBy("tier", "at", "url")
    return both.unionByName(guessed).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("site", "url", "page_type", "found", "rank")


def own_domain_phone(results: DataFrame) -> DataFrame:
    """``(key, phone)``: the first number in the texts of results ``(key, host, own, at, said)`` that lie on the business's own host, as digits; landlines before mobiles, then by ``at``.

    Texts are searched where they are, and only the best number of each is brought together, so a host of any size is no one task's. Keys without a number are left out.
    """
    own = results.where((F.col("own") != "") & (F.col("host") == F.col("own"))).select("key", "at", F.posexplode(F.transform(phones.extract(F.col("said")), phones.classify)).alias("i", "k")).where("k.type in ('landline', 'international', 'mobile')")
    return own.groupBy("key").agg(F.min(F.struct(F.when(F.col("k.type") == "mobile", 1).otherwise(0).alias("late"), "at", "i", F.col("k.digits").alias("phone"))).getField("phone").alias("phone"))


def needs_script(ok: Column, content: Column, html: Column, has_socials: Column, has_contacts: Column) -> Column:
    """Must a page be fetched anew with its scripts run: it failed, is nearly empty, or is built by a script or names networks without linking them, and no profiles were found."""
    html_ = F.coalesce(html, F.lit(""))
    names = html_.rlike(r"(?i)\b(facebook|instagram|tiktok|linkedin|youtube)\b") & ~html_.rlike(r"(?i)https?://(www\.)?(facebook|instagram|tiktok|linkedin|youtube)\.com")
    return F.when(has_socials & has_contacts, False).when(~ok | (F.length(F.coalesce(content, F.lit(""))) < 100), True).when(F.length(html_) < 2000, True).otherwise(~has_socials & (html_.rlike(SCRIPTED) | names))


def corporate_parent(host: Column, name: Column) -> Column:
    """Is the host a chain's and the name one of its brands."""
    out = F.lit(False)
    for domain, brands in CHAINS.items():
        out = out | ((host == domain) | host.endswith(f".{domain}")) & name.rlike(rf"(?i)\b({brands.replace(' ', r'\s+')})\b")
    return F.coalesce(out, F.lit(False))


def all_unattributed(contacts: Column, map_digits: Column) -> Column:
    """Are all contacts ``array<struct<digits, attribution>>`` but the map's own number unattributed; false without any other."""
    others = F.filter(contacts, lambda c: ~F.coalesce((map_digits != "") & (c["digits"] == map_digits), F.lit(False)))
    return (F.size(others) > 0) & F.forall(others, lambda c: c["attribution"] == "unattributed")


def verified_evidence(usable: Column, has_site: Column, pages: Column, good_pages: Column, relation: Column, status: Column) -> Column:
    """Struct ``(status, relation, lifecycle, health)`` of a candidate: without a usable site, with pages that were read, or with a site that was not or could not be read."""
    wrong = relation.isin("directory", "marketplace", "service_platform", "unrelated")
    final = F.when((status == "verified") & ~wrong, "first_party").when(status == "failed", "unverified").otherwise(relation)
    read = good_pages > 0
    failed = (pages > 0) & ~read
    s = F.when(~usable, "failed").when(read, status).when(failed, "failed").otherwise("weak")
    r = F.when(~usable, F.when(has_site, "directory").otherwise("unverified")).when(read, final).otherwise("unverified")
    life = F.when(~usable, "discovered").when(read & (r == "first_party") & s.isin("verified", "partial"), "first_party_owned").when(read & (s == "verified"), "verified").when(pages > 0, "fetched").otherwise("discovered")
    health = (
        F.when(~usable, F.when(has_site, "wrong_source").otherwise("unverified"))
        .when(read, F.when(wrong, "wrong_source").when((r == "first_party") & s.isin("verified", "partial"), "verified").when(s == "failed", "transient_failure").otherwise("unverified"))
        .otherwise(F.when(failed, "transient_failure").otherwise("unverified"))
    )
    return F.struct(s.alias("status"), r.alias("relation"), life.alias("lifecycle"), health.alias("health"))


def ledger_id(place_id: Column, host: Column, title: Column, phone: Column, url: Column) -> Column:
    """``maps:<place>``, else ``candidate:`` with host, name key and digits, those that are there; else with the normalised URL."""
    pid = F.trim(F.coalesce(place_id, F.lit("")))
    h = F.when(F.contains(F.coalesce(host, F.lit("")), F.lit("google.com")), F.lit("")).otherwise(urls.domain_or_host(host))
    parts = F.array_join(F.filter(F.array(h, text.name_key(F.coalesce(F.nullif(title, F.lit("")), F.lit("unknown"))), phones.match_digits(F.coalesce(phone, F.lit("")))), lambda x: x != ""), "|")
    return F.when(pid != "", F.concat(F.lit("maps:"), pid)).otherwise(F.concat(F.lit("candidate:"), F.when(parts != "", parts).otherwise(urls.normalize_url(url))))
