"""E-mails, page content and contact roles, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts before the @ that name a role and no person (fixed values).
ROLE_INBOXES = ("info", "contact", "office", "admin", "support", "sales", "hello", "enquiry", "inquiry", "reception", "booking", "legal", "hr", "accounts", "billing", "marketing")
#: Addresses that are no evidence (fixed patterns).
PLACEHOLDER = (
    r"^(test|user|email|name|your|youremail|noreply|no-reply|dummy|demo|john\.doe|jane\.doe|example)[@.-]|@example\.(com|org|net|co|np)$|"
    r"@(mail|email|test|domain|yoursite|yourdomain|mycompany|sitename|companyname|themename|ourschool|myschool|yourschool|template|dummy)\.(com|org|net|co|edu)$|"
    r"(sentry\.io|wixpress\.com|\.wix\.com|privacy\.cloudflare\.com|email\.cloudflare\.com)$|@(yopmail|mailinator)\.|\.co\.np$|\.(png|jpe?g|gif|svg|webp|bmp|ico|tiff?|avif)$"
)
EMAIL_TEXT = r"[a-zA-Z0-9_.%+-]{1,64}@[a-zA-Z0-9-]{1,63}(?:\.[a-zA-Z0-9-]{1,63})+"
_EMAIL = r"^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$"
#: Signs that a page is a template's demonstration (fixed patterns).
TEMPLATE_SIGNS = ("lorem ipsum", "(your|company) (name|address) here|123 (main|street)", "(\\+1|1)?[ (-]*555[ )-]", "example\\.(com|org)|yourdomain")


def emails(text: Column) -> Column:
    """Addresses in a text, lower case, distinct in order, without placeholders and names of files."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\s*[\[(]at[\])]\s*", "@"), r"(?i)\s*[\[(]dot[\])]\s*", ".")
    found = F.transform(F.regexp_extract_all(t, F.lit(EMAIL_TEXT), 0), lambda e: F.lower(F.regexp_replace(e, r"^[.%+-]+|[.-]+$", "")))
    return F.array_distinct(F.filter(found, lambda e: e.rlike(_EMAIL) & ~e.rlike(PLACEHOLDER)))


def cloudflare_email(code: Column) -> Column:
    """The address behind a protected one: each byte in hex is XORed with the first."""
    at = lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    n = F.floor(F.length(code) / 2).cast("int")
    return F.when(code.rlike("^([0-9a-fA-F]{2}){2,}$"), F.array_join(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.char(at(i).bitwiseXOR(at(F.lit(0))))), ""))


def mailto(text: Column) -> Column:
    """Addresses of ``mailto:`` links, decoded."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"mailto:([^\"'?\s>)]+)"), 1), lambda e: F.lower(F.try_url_decode(e))))


def identifying_email(e: Column) -> Column:
    """Does the address name a person or business, no role."""
    return F.coalesce(F.contains(e, F.lit("@")) & ~F.lower(F.trim(F.split(e, "@")[0])).isin(*ROLE_INBOXES), F.lit(False))


def email_role(e: Column, site: Column) -> Column:
    """role (a role's inbox), first_party (at the site's domain), personal (a name with a dot) or consumer."""
    domain = F.split(e, "@")[1]
    return F.when(~identifying_email(e), "role").when((site != "") & (domain == site), "first_party").when(F.split(e, "@")[0].rlike(r"^[a-z]+\.[a-z]+$"), "personal").otherwise("consumer")


def role_matrix(maps: Column, cta: Column, leader: Column, staff: Column, branch: Column, platform: Column, front: Column, team: Column) -> Column:
    """Struct ``(role, owner)`` of a contact from its signals; ``front``: seen on home or contact page, ``team``: on about or team page. The first that holds decides."""
    out = lambda r, o: F.struct(F.lit(r).alias("role"), F.lit(o).alias("owner"))
    return (
        F.when(maps, out("primary_business", "business"))
        .when(branch, out("branch_contact", "branch"))
        .when(platform, out("unknown", "platform"))
        .when((front & (cta | ~staff)) | (cta & ~staff & ~team), out("primary_business", "business"))
        .when(staff | (team & leader), out("staff_person", "person"))
        .otherwise(out("unknown", "unknown"))
    )


def template_content(text: Column) -> Column:
    """At least two signs of a template's demonstration text."""
    return sum((F.when(F.lower(F.coalesce(text, F.lit(""))).rlike(s), 1).otherwise(0) for s in TEMPLATE_SIGNS), F.lit(0)) >= 2


def multi_business(text: Column, url: Column) -> Column:
    """Does a page list several businesses: by its URL, three numbered headings, four company names, or two and three of these."""
    t = F.coalesce(text, F.lit(""))
    heads = F.size(F.regexp_extract_all(t, F.lit(r"(?m)^(?:#+\s*)?\d{1,2}[.)]\s+[A-Z]"), 0))
    firms = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){0,4}) (?:Pvt|Private|P)\.? ?(?:Ltd|Limited)"), 1)))
    return F.coalesce(url, F.lit("")).rlike(r"(?i)/(top|best)-?\d*-|/list(ing)?s?/|-in-nepal") | (heads >= 3) | (firms >= 4) | ((heads >= 2) & (firms >= 3))


def markdown_links(text: Column) -> Column:
    """``(label, target)`` of the links of a Markdown text, images left out."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", "")
    pattern = r"\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    return F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), 1).alias("label"), F.regexp_extract_all(t, F.lit(pattern), 2).alias("target"))


def hrefs(html: Column) -> Column:
    """Targets of the links of an HTML page, distinct in order, without fragments and scripts."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']([^\"'#]+)"), 1), lambda u: ~u.rlike("(?i)^(javascript|data):")))


def page_name(html: Column) -> Column:
    """The business's name on a page: structured data, then og:site_name, h1, the first Markdown heading, the title; '' if none."""
    pick = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), p, 1), "<[^>]+>", "")), F.lit(""))
    return F.coalesce(
        pick(r"(?s)application/ld\+json[^>]*>.*?\"name\"\s*:\s*\"([^\"]+)\""), pick(r"(?i)og:site_name[\"'][^>]*content=[\"']([^\"']+)"), pick(r"(?is)<h1[^>]*>(.*?)</h1>"),
        pick(r"(?m)^#\s+(.+)$"), F.nullif(F.trim(F.regexp_replace(pick(r"(?is)<title[^>]*>(.*?)</title>"), r"\s+[|–-]\s+.*$", "")), F.lit("")), F.lit(""),
    )


def favicon(html: Column) -> Column:
    """Target of the page's icon link, null if none."""
    return F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<link[^>]*rel=[\"'](?:shortcut )?icon[\"'][^>]*href=[\"']([^\"']+)", 1), F.lit(""))


def structured_data(html: Column) -> Column:
    """Struct of telephone, email, address, latitude, longitude and sameAs in the page's JSON-LD; nulls where absent."""
    doc = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?s)application/ld\+json[^>]*>\s*(\{.*?\})\s*</script>", 1)
    get = lambda p: F.get_json_object(doc, p)
    links = F.from_json(get("$.sameAs"), "array<string>")
    return F.struct(
        get("$.telephone").alias("telephone"), get("$.email").alias("email"), F.coalesce(get("$.address.streetAddress"), get("$.address")).alias("address"),
        get("$.geo.latitude").try_cast("double").alias("latitude"), get("$.geo.longitude").try_cast("double").alias("longitude"),
        F.transform(links, lambda u: F.regexp_replace(u, "&amp;", "&")).alias("same_as"),
    )


def branch_blocks(text: Column) -> Column:
    """``(name, body)`` of the parts of a Markdown page under headings that name an office or branch; a part ends at the next heading."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n#{1,4}\s+")
    block = F.transform(parts, lambda p: F.struct(F.trim(F.split(p, "\n")[0]).alias("name"), F.trim(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))
    return F.filter(block, lambda b: b["name"].rlike(r"(?i)\b(office|branch|outlet|location|centre|center)\b"))


def opening_hours(text: Column) -> Column:
    """What a page says of its hours, on one line after a word for them; null if nothing."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?im)(?:opening hours|business hours|office hours|hours)\s*[:\-]\s*([^\n]{3,120})", 1)), F.lit(""))


def services(text: Column, most: int = 10) -> Column:
    """The listed services after a heading for them, distinct in order, at most ``most``."""
    part = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?is)(?:^|\n)#*\s*(?:our )?services\s*:?\s*\n((?:\s*[-*•][^\n]+\n?)+)", 1)
    lines = F.filter(F.transform(F.split(part, "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s*[-*•]\s*", ""))), lambda s: s != "")
    return F.slice(F.array_distinct(lines), 1, most)


def address_of(html: Column) -> Column:
    """The page's address: structured data, then an element or line that is labelled as one; null if none."""
    t = F.coalesce(html, F.lit(""))
    pick = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(t, p, 1), "<[^>]+>", " ")), F.lit(""))
    return F.coalesce(structured_data(html)["address"], pick(r"(?is)<address[^>]*>(.*?)</address>"), pick(r"(?im)^(?:address|location)\s*:\s*([^\n]{5,200})$"))


def branch_address(x: Column) -> Column:
    """An address without images, links, e-mails, phones, labels and map buttons."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"!\[[^\]]*\]\([^)]*\)|\S+\.(?:png|jpe?g|svg|webp)\b|https?://\S+|[\w.+-]+@[\w-]+\.[\w.]+", " ")
    t = F.regexp_replace(t, r"(?i)\b(get directions?|view (on )?map|call now|address|phone|tel|mobile|email)\b\s*:?", " ")
    t = F.regexp_replace(t, r"\+?\d[\d\s()-]{6,}\d", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"(\s*[,;|]\s*)+", ", ")), r"^[,\s]+|[,\s]+$", "")


def head_office(name: Column, body: Column, locality: Column) -> Column:
    """Is a block the head office: named so, or at the locality and naming no branch."""
    said = F.lower(F.concat_ws(" ", name, body))
    return F.lower(name).rlike(r"\b(head|main|corporate|central) office\b") | (F.contains(said, F.lower(locality)) & ~F.lower(name).rlike(r"\b(branch|outlet)\b"))


def block_of(blocks: Column, value: Column) -> Column:
    """The first of the ``branch_blocks`` that holds a contact: the address of an e-mail, the last eight digits of a number; null if none."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    mail = F.contains(value, F.lit("@"))
    return F.get(F.filter(blocks, lambda b: F.when(mail, F.contains(F.lower(b["body"]), F.lower(value))).otherwise((F.length(digits(value)) >= 7) & F.contains(digits(b["body"]), F.substring(digits(value), -8, 8)))), F.lit(0))


def attribute_branch(value_digits: Column, block_name: Column, locality: Column, area_locality: Column, maps_digits: Column) -> Column:
    """Struct ``(attribution, label)`` of a number at a business of several branches; the first that holds decides.

    hotline (16 digits of a toll-free number or 1660/1800), the block it stands in (primary at the locality, else branch), the area code's region, the number known from the map, else unattributed.
    """
    out = lambda a, label: F.struct(F.lit(a).alias("attribution"), label.cast("string").alias("label"))
    here = F.contains(F.lower(block_name), F.lower(locality)) | F.lower(block_name).rlike(r"\b(head|main|corporate) office\b")
    return (
        F.when(value_digits.rlike("^(1660|1800)"), out("hotline", F.lit(None)))
        .when(block_name.isNotNull() & here, out("primary", block_name))
        .when(block_name.isNotNull(), out("branch_contact", block_name))
        .when(area_locality.isNotNull() & (F.lower(area_locality) != F.lower(locality)), out("branch_contact", area_locality))
        .when(value_digits == maps_digits, out("primary", locality))
        .otherwise(out("unattributed", F.lit(None)))
    )
