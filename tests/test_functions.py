"""Scalar functions on small fixtures."""

import pytest
from pyspark.sql import functions as F

from milap.functions import contacts, phones, social, text, urls


def one(spark, column_of, *values):
    """The expression's value for one row of strings."""
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column_of(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(("raw", "kind", "digits"), [
    ("+977-01-4311600", "landline", "14311600"), ("01-4311600", "landline", "14311600"), ("+977-61-520123", "landline", "61520123"), ("9851239227", "mobile", "9851239227"),
    ("+977 977 9851234567", "mobile", "9851234567"), ("98512", "invalid", "98512"), ("+1 (212) 555-0100", "international", "12125550100"), ("27.382262", "invalid", "27382262"), ("", "invalid", ""), (None, "invalid", ""), ("n/a", "invalid", ""),
])
def test_phone_kinds(spark, raw, kind, digits):
    k = one(spark, phones.classify, raw)
    assert (k.type, k.digits) == (kind, digits)


def test_phone_digits_for_matching(spark):
    assert [one(spark, phones.match_digits, x) for x in ("+977-01-4311600", "01-4311600", "+977 9851239227", None)] == ["14311600", "14311600", "9851239227", ""]
    assert one(spark, phones.expand_slashes, "01-5363501/511") == ["01-5363501", "01-5363511"]
    assert one(spark, lambda k, d, r: phones.display(k, d, r), "landline", "14311600", "01-4311600") == "+977-01-4311600"
    assert one(spark, phones.extract, "call +977-9851239227 or 01-4311600.") != []


def test_names(spark):
    assert one(spark, text.name_key, "The Care & Co. Pvt. Ltd.") == "care"
    assert one(spark, text.distinctive_tokens, "Care Dental Clinic") == []
    assert one(spark, text.distinctive_tokens, "Om Samaj Dental Hospital") == ["om", "samaj"]
    align = lambda a, b: one(spark, text.names_align, a, b)
    assert align("Om Samaj Dental Hospital", "Om Samaj Dental") and not align("Apex Law", "Summit Dental") and align(None, None) and not align("Apex", None)
    ev = lambda a, b, p: one(spark, lambda x, y: text.names_align_for_evidence(x, y, F.lit(p), F.lit(False)), a, b)
    assert not ev("Apex Summit Law", "Apex Everest Dental", False) and ev("Om Samaj Dental Hospital", "Om Samaj Dental", False)


def test_keys(spark):
    assert one(spark, lambda n: text.canonical_key(n, F.lit("")), "Care Pvt Ltd") == "name:care|unknown-location"
    assert one(spark, lambda n: text.canonical_key(n, F.lit("x")), "Pvt Ltd") == ""
    assert one(spark, lambda p, q: text.cache_key(p, q), "a", "b") == __import__("hashlib").sha256(b"a::b").hexdigest()[:16]
    assert one(spark, text.slug, "Dental Clinic, in X!") == "dental-clinic-in-x"


@pytest.mark.parametrize(("url", "want"), [
    ("https://www.a.example/x/?utm_source=m&b=2&a=1#top", "https://a.example/x?a=1&b=2"), ("http://a.example", "http://a.example/"), ("not a url", "not a url"), (None, ""), ("", ""),
])
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url, url) == want


@pytest.mark.parametrize(("path", "role"), [("/", "homepage"), ("/index.html", "homepage"), ("/contact-us/", "contact"), ("/get-a-quote", "contact"), ("/about-us", "about"), ("/our-team", "team"), ("/services", "services"), ("/blog/x", "other")])
def test_page_roles(spark, path, role):
    assert one(spark, urls.page_role, "https://a.example" + path) == role


def test_hosts(spark):
    assert one(spark, urls.root_domain, "x.ever.edu.np") == "ever.edu.np"
    assert [one(spark, urls.tld_tier, h) for h in ("a.edu.np", "a.com.np", "a.com", "a.xyz")] == ["best", "good", "generic", "other"]
    assert one(spark, urls.domain_or_host, "WWW.A.example/x") == "a.example" and one(spark, urls.domain_or_host, None) == ""


def test_emails(spark):
    assert one(spark, contacts.emails, "Write to Info@Shop.example, or ram [at] shop [dot] example; logo@2x.png test@x.com") == ["info@shop.example", "ram@shop.example"]
    key, mail = 0x42, "a@b.co"
    assert one(spark, contacts.cloudflare_email, bytes([key, *(ord(c) ^ key for c in mail)]).hex()) == mail
    assert one(spark, contacts.mailto, '<a href="mailto:a%40b.co?x">') == ["a@b.co"]
    assert one(spark, contacts.identifying_email, "ram@b.co") and not one(spark, contacts.identifying_email, "info@b.co") and not one(spark, contacts.identifying_email, None)


def test_pages(spark):
    html = '<html><head><title>Ever Vision | Home</title><link rel="icon" href="/f.ico"><script type="application/ld+json">{"name":"Ever Vision","telephone":"01-4311600","geo":{"latitude":27.7,"longitude":"85.3"},"sameAs":["https://facebook.example/p?a=1&amp;b=2"]}</script></head><body><a href="/contact">c</a></body></html>'
    assert one(spark, contacts.page_name, html) == "Ever Vision" and one(spark, contacts.favicon, html) == "/f.ico" and one(spark, contacts.hrefs, html) == ["/f.ico", "/contact"]
    d = one(spark, contacts.structured_data, html)
    assert (d.telephone, d.latitude, d.longitude, d.same_as) == ("01-4311600", 27.7, 85.3, ["https://facebook.example/p?a=1&b=2"])
    assert [(b.name, b.body) for b in one(spark, contacts.branch_blocks, "# Us\nhi\n## Butwal Office\n071-1\n## Other\nx")] == [("Butwal Office", "071-1")]
    assert one(spark, contacts.page_name, None) == ""


def test_social(spark):
    c = lambda u, n: one(spark, social.classify_social, u, n)
    assert c("https://facebook.com/chandragiripartypalace", "Chandragiri Party Palace").status == "accepted"
    assert c("https://facebook.com/yellowpagesnepal", "Global Eye Education Consultancy").reason == "BUSINESS_NAME_MISMATCH"
    assert c("https://facebook.com/profile.php?id=1234", "X").reason == "NUMERIC_ID" and c("https://facebook.com/share", "X").reason == "NO_PROFILE"
    assert one(spark, social.handle_of, "https://facebook.com/p/Sunrise-Dental-100012345/") == "sunrise-dental"


def test_json_repair_and_text(spark):
    rows = one(spark, lambda x: text.parse_json_rows(x, "array<struct<name:string,n:int>>"), '```json\n[{name: "A", n: 1,},]\n```')
    assert [(r.name, r.n) for r in rows] == [("A", 1)]
    assert one(spark, text.strip_html, "<p>A&amp;B<script>x</script></p>") == "A&B"
    assert one(spark, lambda x: text.context_around(x, F.lit("q"), 2), "abcqdef") == "bcqde"


def test_more_of_pages(spark):
    assert one(spark, contacts.opening_hours, "x\nOpening hours: Sun-Fri 10-5\ny") == "Sun-Fri 10-5" and one(spark, contacts.opening_hours, None) is None
    assert one(spark, contacts.services, "# Services\n- Scaling\n- Braces\n- Scaling\n\nx") == ["Scaling", "Braces"]
    assert one(spark, contacts.address_of, "<address>1 Hill Road</address>") == "1 Hill Road" and one(spark, contacts.address_of, "") is None
    assert one(spark, contacts.branch_address, "![pin](/img/p.png) 1 Hill Road, Miyel, Phone: 01-4311600 get direction https://m.example/q") == "1 Hill Road, Miyel"
    pick = lambda v: one(spark, lambda t: contacts.block_of(contacts.branch_blocks(t), F.lit(v))["name"], "# Us\n## Butwal Office\n071-544460\n## Chitwan Office\na@b.example\n")
    assert (pick("+977-71544460"), pick("A@b.example"), pick("1234567")) == ("Butwal Office", "Chitwan Office", None)
    at = lambda d, b, area: one(spark, lambda x, y, z: contacts.attribute_branch(x, y, F.lit("Miyel"), z, F.lit("14311600")), d, b, area)
    assert at("71544460", "Butwal Office", None).attribution == "branch_contact" and at("14311600", None, None).attribution == "primary" and at("71544460", None, "Butwal").label == "Butwal" and at("9851239227", None, None).attribution == "unattributed"
    assert one(spark, lambda n, b: contacts.head_office(n, b, F.lit("Miyel")), "Head Office", "x")


def test_internal_urls(spark):
    df = spark.createDataFrame([("https://www.a.example/x/", ["/contact/", "about.html?x=1#y", "https://b.example/", "mailto:x", "/index.php", "/blog/x", None]), ("nonsense", ["/a"]), (None, None)], "b string, l array<string>")
    assert [r.u for r in df.select(urls.internal_urls(F.col("b"), F.col("l")).alias("u")).collect()] == [["https://a.example/contact", "https://a.example/x/about.html", "https://a.example/"], [], []]
