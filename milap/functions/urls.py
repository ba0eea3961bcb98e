"""URLs and hosts, as expressions. Input that is no URL never fails: hosts are '' then, and URLs stay as they are."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that track visits, besides ``utm_*`` (fixed values).
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "ref", "ref_src", "ref_url", "mc_cid", "mc_eid", "igshid", "si", "yclid", "vero_id", "_ga")
#: Public suffixes of two labels (fixed values).
SUFFIXES = (
    "com.np", "edu.np", "org.np", "gov.np", "net.np", "mil.np", "coop.np", "museum.np", "ac.np", "co.uk", "org.uk", "gov.uk", "ac.uk", "net.uk",
    "co.in", "net.in", "org.in", "gen.in", "firm.in", "ind.in", "com.au", "net.au", "org.au", "edu.au", "gov.au",
)
#: Networks, portals and search engines, whose pages are other people's (fixed values).
NETWORKS = ("facebook.com", "instagram.com", "tiktok.com", "linkedin.com", "youtube.com", "twitter.com", "x.com", "pinterest.com", "reddit.com", "quora.com", "wikipedia.org", "google.com", "maps.google.com")
#: Directories, portals and shops that list businesses (fixed values).
DIRECTORIES = (
    "yellowpages.com", "justdial.com", "yelp.com", "signalhire.com", "zoominfo.com", "manta.com", "crunchbase.com", "foursquare.com", "mapquest.com", "nepalyp.com", "yellowpages.com.np", "dnb.com",
    "kompass.com", "indiamart.com", "tradeindia.com", "sulekha.com", "whitepages.com", "superpages.com", "bbb.org", "trustpilot.com", "sitejabber.com", "edusanjal.com", "collegesnepal.com", "noshnepal.com",
    "mapcarta.com", "restaurantguru.com", "usnepal.com", "directoryofnepal.com", "wikimapia.org", "openstreetmap.org", "bhansaghar.com", "bhansaghar.com.np", "skillsewa.com", "nepalhotel.com", "yandex.ru",
    "yandex.com", "booking.com", "agoda.com", "tripadvisor.com", "airbnb.com", "expedia.com", "trivago.com", "searchactual.com", "realestateinnepal.com", "prolinknepal.com", "hamrobazaar.com", "volza.com",
    "collegenp.com", "suvidhasewa.com.np", "aarohnepal.org", "virtualedufairnepal.com", "play.google.com", "apps.apple.com", "merokirana.com", "nepalhomesearch.com", "bihebazaar.com", "playo.co", "cybo.com",
    "turantcall.com", "findallnepal.com", "scorchdeal.com", "hospitalnepal.com", "nepalcompany.com", "inquirynepal.com", "esscobathware.com", "companynepal.com", "nepalbusinessdirectory.com", "biznepal.com",
    "ghargharsewa.com", "gamatrain.com", "getyourguide.com", "afnobazar.com.np", "kinbechshop.com", "worldtravelserver.com", "pasaulineskeliones.lt", "bizdirenepal.com", "ypnepal.com", "mysleepwell.com",
    "furniturehub.com.np", "eticketnepal.com", "yopoho.com", "ticketing.com.np", "nepalticket.com", "khabarhub.com", "hamropatro.com", "onlinekhabar.com", "ratopati.com", "setopati.com", "ekantipur.com", "nagariknetwork.com",
)
#: Hosts of documents and of sites under trial (fixed values).
DOCUMENTS = ("slideshare.net", "scribd.com", "docs.google.com", "prezi.com", "issuu.com", "coursehero.com", "studocu.com", "slideserve.com", "speakerdeck.com")
STAGING = ("vercel.app", "netlify.app", "github.io", "pages.dev", "webflow.io", "render.com", "railway.app", "herokuapp.com", "surge.sh", "glitch.me", "firebaseapp.com", "web.app")
#: Domains that give businesses a host of their own below them (fixed values).
HOSTERS = (
    "localo.site", "wordpress.com", "blogspot.com", "business.site", "wixsite.com", "weebly.com", "site123.me", "godaddysites.com", "jimdofree.com", "hubspotpagebuilder.com", "webador.com", "mystrikingly.com",
    "yolasite.com", "yellowpages.com.np", "biznepal.com", "nepalyp.com",
)
#: All hosts that are nobody's own, each once.
SHARED = tuple(dict.fromkeys(NETWORKS + DIRECTORIES + DOCUMENTS + STAGING))
#: Top-level domains by how official they look (fixed values).
TLD_BEST, TLD_GOOD, TLD_GENERIC = (r"\.(edu\.np|gov\.np|ac\.np|edu)$", r"\.(com\.np|org\.np|net\.np|mil\.np)$", r"\.(com|org|net|io|co)$")
#: Paths by what they say of a page (fixed patterns).
PAGE_ROLES = (
    ("homepage", r"^/*$|^/index\.html$|^/index\.php$|^/home$"),
    ("contact", r"\b(contact|reach-us|get-in-touch|get-a-quote|contactus|location|branches)\b"),
    ("team", r"\b(team|leadership|board|management|staff|members)\b"),
    ("about", r"\b(about|who-we-are|company|profile)\b"),
    ("services", r"\b(service|services)\b"),
)
CRAWL_PAGES = (("contact", "contact|reach-us|get-in-touch|enquiry"), ("about", "about|who-we-are|our-story"), ("services", "service|what-we-do|products"), ("location", "location|branch|find-us"), ("team", "team|staff|people|doctors"), ("menu", "menu"))
PRIORITY = ("contact", "about", "booking", "enquiry", "reach-us", "our-locations", "branches", "location")
IGNORED = r"(?i)/(blog|news|careers?|jobs?|privacy|terms|login|admin|cart|search|tag|category|wp-[a-z]+)\b|\.(pdf|jpe?g|png|gif|svg|zip|css|js|xml)$"
ARTICLE = r"(?i)/(news|articles?|blog|posts?|story|stories|reviews?)\b|/\d{4}/\d{1,2}/"
DIRECTORY_PATH = r"(?i)/(listings?|directory|places?|business(es)?|compan(y|ies)|biz|profile|search|category|categories|browse|tag|dealers?)\b|[?&](q|query|search|s|category|district|page)="


def _parts(x: Column) -> tuple[Column, Column, Column, Column]:
    """scheme, authority, path, query of an absolute URL; '' where it has none."""
    t = F.trim(F.coalesce(x, F.lit("")))
    part = lambda p: F.regexp_extract(t, p, 1)
    return F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*)://")), F.lower(part(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]+)")), part(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+([^?#]*)"), part(r"^[^?#]*\?([^#]*)")


def is_http(x: Column) -> Column:
    """Does it begin with http:// or https://."""
    return F.coalesce(F.trim(x).rlike("(?i)^https?://"), F.lit(False))


def domain_of(x: Column) -> Column:
    """Host in lower case without ``www.`` and port; '' unless the URL is absolute."""
    return F.regexp_replace(F.regexp_replace(_parts(x)[1], r":\d+$", ""), r"^www\.", "")


def domain_or_host(x: Column) -> Column:
    """``domain_of``, or what stands for the host in a bare host with or without path."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "^https?://", ""), r"^www\.", "")
    return F.when(domain_of(x) != "", domain_of(x)).otherwise(F.regexp_extract(bare, "^([^/:]*)", 1))


def path_of(x: Column) -> Column:
    """Path of an absolute URL, '' if it has none."""
    return _parts(x)[2]


def normalize_url(x: Column) -> Column:
    """Without ``www.``, closing slash, fragment and tracking parameters, the others in order of name; a text that is no URL is only trimmed."""
    scheme, host, path, query = _parts(x)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING)))
    short = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(F.lit("/"))
    return F.when(host == "", F.trim(F.coalesce(x, F.lit("")))).otherwise(F.concat(scheme, F.lit("://"), F.regexp_replace(host, r"^www\.", ""), short, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def root_domain(host: Column) -> Column:
    """The registrable domain: the label before the public suffix, and the suffix."""
    two = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    return F.coalesce(F.nullif(F.regexp_extract(host, rf"([^.]+\.(?:{two}))$", 1), F.lit("")), F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def tld_tier(host: Column) -> Column:
    """best, good, generic or other."""
    return F.when(host.rlike(TLD_BEST), "best").when(host.rlike(TLD_GOOD), "good").when(host.rlike(TLD_GENERIC), "generic").otherwise("other")


def path_segments(x: Column) -> Column:
    """Number of parts of the path."""
    return F.size(F.filter(F.split(path_of(x), "/"), lambda s: s != ""))


def page_role(x: Column) -> Column:
    """homepage, contact, team, about, services or other, by the path; a bare host is a homepage."""
    full = F.when(F.lower(x).startswith("http"), x).otherwise(F.concat(F.lit("https://"), x))
    path = F.regexp_replace(F.lower(path_of(full)), "/+$", "")
    out = F.when(F.coalesce(x, F.lit("")) == "", "other")
    for role, pattern in PAGE_ROLES:
        out = out.when(path.rlike(pattern), role)
    return out.otherwise("other")


def crawl_page(x: Column) -> Column:
    """home, contact, about, services, location, team, menu or other."""
    path = F.lower(F.when(domain_of(x) != "", path_of(x)).otherwise(F.coalesce(x, F.lit(""))))
    out = F.when(F.coalesce(x, F.lit("")) == "", "other").when(path.isin("", "/"), "home")
    for role, pattern in CRAWL_PAGES:
        out = out.when(path.rlike(pattern), role)
    return out.otherwise("other")


def ignored_path(x: Column) -> Column:
    """Is it no page to read: blogs, legal pages, logins, carts, files; anything that is no URL."""
    return F.coalesce((domain_of(x) == "") | path_of(x).rlike(IGNORED), F.lit(True))


def priority_score(x: Column) -> Column:
    """Number of telling words in the path."""
    return sum((F.when(F.coalesce(x.rlike(f"(?i)/{p}"), F.lit(False)), 1).otherwise(0) for p in PRIORITY), F.lit(0))


def third_party(host: Column, listed: tuple[str, ...]) -> Column:
    """Is the host one of ``listed`` or below one."""
    return host.isin(*listed) | host.rlike(r"\.(" + "|".join(s.replace(".", r"\.") for s in listed) + ")$") if listed else F.lit(False)


def internal_urls(base: Column, links: Column) -> Column:
    """Links of a page as absolute URLs of the same host, without query and fragment, ``/index.*`` as ``/``, ignored paths left out; distinct in order.

    Resolved in Arrow batches by the rules of RFC 3986. A base that is no URL has no internal links.
    """
    @F.pandas_udf("array<string>")
    def resolve(b: pd.Series, ls: pd.Series) -> pd.Series:
        bad = re.compile(IGNORED)

        def one(page, targets):
            host = (urlsplit(page).hostname or "").removeprefix("www.") if page else ""
            out = {}
            for t in (t for t in targets if t) if targets is not None and host else ():
                try:
                    u = urlsplit(urljoin(page, t))
                except (ValueError, TypeError):
                    continue
                if u.scheme in ("http", "https") and (u.hostname or "").removeprefix("www.") == host:
                    path = re.sub(r"/index\.[a-z]+$", "/", u.path) or "/"
                    if not bad.search(path):
                        out[f"{u.scheme}://{host}{path if path == '/' else path.rstrip('/')}"] = None
            return list(out)

        return pd.Series([one(x, y) for x, y in zip(b, ls, strict=True)])

    return resolve(base, links)


def map_url(x: Column) -> Column:
    """Does a URL lead to a place on a map."""
    return F.coalesce(x.startswith("google_maps:") | F.contains(x, F.lit("google.com/maps")) | F.contains(x, F.lit("maps.google.com")) | F.contains(x, F.lit("maps.app.goo.gl")), F.lit(False))


def issued_subdomain(host: Column) -> Column:
    """Is it a host that a directory or site builder gave out, below one of its domains."""
    return F.coalesce(root_domain(host).isin(*HOSTERS) & (root_domain(host) != host) & ~host.startswith("www."), F.lit(False))
