"""Hosts as the URL standard reads them."""

import encodings.idna
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sievefold.functions import hosts
from sievefold.functions.urls import canonical_url, dedupe_hash, link_host
from sievefold.operators import careers


def each(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


#: (as written, as connected to); the pairs follow the standard's own examples
HOSTS = [
    ("Example.COM", "example.com"), ("ex%41mple.com", "example.com"), ("EXAMPLE.com.", "example.com."), ("example.com%2e", "example.com."), ("faß.ExAmPlE", "xn--fa-hia.example"),
    ("café.fr", "xn--caf-dma.fr"), ("MÜNCHEN.de", "xn--mnchen-3ya.de"), ("b%C3%BCcher.de", "xn--bcher-kva.de"), ("日本語。ＪＰ", "xn--wgv71a119e.jp"), ("Ｇｏ.com", "go.com"), ("a­b.com", "ab.com"),
    ("例え.テスト", "xn--r8jz45g.xn--zckzah"), ("💩.la", "xn--ls8h.la"), ("xn--fa-hia.de", "xn--fa-hia.de"), ("_dmarc.a-b.com", "_dmarc.a-b.com"), ("a..b", "a..b"), ("ΣΊΣΥΦΟΣ.gr", "xn--kxa6akbbkh.gr"),
    ("127.0.0.1", "127.0.0.1"), ("2130706433", "127.0.0.1"), ("0x7f.0.0.1", "127.0.0.1"), ("0177.0.0.1", "127.0.0.1"), ("0x7F000001", "127.0.0.1"), ("127.1", "127.0.0.1"), ("127.0.1", "127.0.0.1"), ("10", "0.0.0.10"),
    ("0x", "0.0.0.0"), ("1.2.3.4.", "1.2.3.4"), ("１２７.0.0.1", "127.0.0.1"), ("4294967295", "255.255.255.255"), ("0xff.0377.1", "255.255.0.1"), ("00000000000000000000000000000000001", "0.0.0.1"),
    ("[::1]", "[::1]"), ("[2001:DB8::1]", "[2001:db8::1]"), ("1e2.com", "1e2.com"), ("0x7g.com", "0x7g.com"),
    # no hosts
    ("", None), ("a b.com", None), ("a<b", None), ("a%zz.com", None), ("%ff.com", None), ("a%00b", None), ("a%2525.com", None), ("4294967296", None), ("256.0.0.1", None), ("1.2.3.4.5", None), ("1.2.3.08", None),
    ("example.1", None), ("a.0x", None), ("1..2", None), ("[::1", None), ("[g::1]", None), ("ﬁsh.com", None), ("ⓛinkedin.com", None), ("a‍b.com", None), ("é.com", None), ("a％41.com", None), ("1.18446744073709551617", None),
]


def test_hosts(spark):
    got = each(spark, hosts.ascii_host, [h for h, _ in HOSTS])
    assert {h: (g, w) for (h, w), g in zip(HOSTS, got, strict=True) if g != w} == {}


def test_punycode_of_any_letters(spark):
    """Against the standard library's encoder, over labels of several scripts."""
    r = random.Random(3)
    pools = ["abcxyz019-", "éüßñøœ", "абвгд", "日本語漢字", "한국어", "😀🎉", "عربي", "ไทย"]
    labels = []
    for _ in range(400):
        letters = r.choice(pools[1:]) + r.choice(pools)
        labels.append("".join(r.choice(letters) for _ in range(r.randint(1, 20))))
    labels = [x for x in labels if not x.isascii()]
    assert each(spark, hosts.punycode, labels) == [x.encode("punycode").decode() for x in labels]


def test_hosts_agree_with_the_library(spark):
    """Plain international names, which both older and newer rules read alike."""
    r = random.Random(4)
    names = [".".join("".join(r.choice("abcéüñøабвгд日本語") for _ in range(r.randint(1, 12))) for _ in range(2)) + ".example" for _ in range(200)]
    assert names == [unicodedata.normalize("NFKC", n) for n in names]
    want = [".".join(encodings.idna.ToASCII(x).decode() for x in n.split(".")) for n in names]
    assert each(spark, hosts.ascii_host, names) == want


@pytest.mark.parametrize(
    "url",
    [
        "http://2130706433/", "http://0x7f.0.0.1/", "http://0177.0.0.1/", "http://10.0x10000/", "http://127.1/", "http://linke%64in.com/", "http://seek.com.au%2e/", "http://ｌｉｎｋｅｄｉｎ.com/", "http://linkedin。com/", "http://SEEK.com.au./",
        "http://linkedin.com:80/", "https:linkedin.com", "https:/\\linkedin.com", "http://a@b@linkedin.com/", "http://x.com\\@linkedin.com\t/", "ht\ntp://link\ted\nin.com", "http://[::1]/", "http://[::ffff:127.0.0.1]/", "http://localhost%2E/",
        "http://a.loc%61l/", "http://0/", "http://example.com:99999/", "http://example.com:8x/", "http://exa mple.com/", "http://ⓛinkedin.com/", "http:///", "http://", "mailto:a@b.c", None,
    ],
)
def test_guard_fails_closed(spark, url):
    blocked = each(spark, careers.blocked_reason, [url])[0]
    # a backslash ends the host, so this one goes to x.com
    assert (blocked is None) == (url == "http://x.com\\@linkedin.com\t/")


def test_guard_lets_others_pass(spark):
    urls = ["https://seekers.com.au/careers", "https://myindeed.com", "http://172.32.0.1/", "http://8.8.8.8:8080/x", "https://münchen.example/jobs", "https://x.example/http://linkedin.com/", "https://x.example/?u=@linkedin.com", "https://u:p@x.example/"]
    assert each(spark, careers.blocked_reason, urls) == [None] * len(urls)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://www.müller.example/a", "https://xn--mller-kva.example/a"), ("https://xn--mller-kva.example/a", "https://xn--mller-kva.example/a"), ("https://exa\tmple.com/a\n/b", "https://example.com/a/b"),
        ("HTTP:\\\\Example.com\\a", "https://example.com/a"), ("http://example.com:80/", "https://example.com/"), ("http://example.com:443/x", "https://example.com/x"), ("https://example.com:80/", "https://example.com:80/"), ("https://example.com:00443/", "https://example.com/"),
        ("https://0x7f.1/x", "https://127.0.0.1/x"), ("https://exa mple.com/A", "https://exa mple.com/a"), ("https://example.com:99999/A", "https://example.com:99999/a"), ("https://www./x", "https://www./x"),
    ],
)
def test_canonical_hosts(spark, raw, want):
    assert each(spark, canonical_url, [raw]) == [want]


def test_one_listing_has_one_hash(spark):
    same = ["https://www.bücher.example/jobs/1", "http://B%C3%BCcher.example/jobs/1?utm_source=x", "https://xn--bcher-kva.example:443/jobs/1#a", "https://bü\tcher.example/jobs/1/"]
    assert len(set(each(spark, dedupe_hash, same))) == 1
    assert each(spark, link_host, ["https://www.bücher.example/d", "https://[x]/"]) == ["xn--bcher-kva.example", "the listing"]


def test_pages_from_guard_to_postings(spark):
    post = '<script type="application/ld+json">{"@type":"JobPosting","title":"A"}</script>'
    pages = [
        (1, "https://a.example/jobs", 200, None, post, None),
        (2, "HTTPS://A.EXAMPLE:443/private/x", 200, None, post, None),
        (3, "https://b.example/", 200, None, post, None),
        (4, "https://a.example/gone", 404, None, post, None),
        (5, "https://a.example/moved", 200, "http://linke%64in.com/x", post, None),
        (6, "https://a.example/list", 200, "https://a.example/list/", "<p>none</p>", None),
        (7, "https://a.example/slow", None, None, None, "timed out"),
        (8, "http://2130706433/", 200, None, post, None),
        (9, None, 200, None, post, None),
        (10, "https://a.example/none", None, None, None, None),
    ]
    frame = spark.createDataFrame(pages, "page_id int, url string, status int, landed_url string, html string, error string")
    robots = careers.robots_by_origin(spark.createDataFrame([("https://a.example", 200, "User-agent: *\nDisallow: /private\nCrawl-delay: 3")], "origin string, status int, body string"), "x")
    read = careers.read_pages(frame, robots)
    got = {r.page_id: (r.reason, r.status, r.crawl_delay, r.n_postings, r.needs_rendering) for r in careers.page_outcomes(read, careers.extract_postings(read.where("reason IS NULL"))).collect()}
    assert got == {
        1: (None, 200, 3.0, 1, False), 2: ("robots.txt disallows /private/x", None, 3.0, 0, None), 3: ("robots.txt could not be read, so fetching is not permitted", None, None, 0, None), 4: ("HTTP 404", 404, 3.0, 0, None),
        5: ("redirected to a blocked host: linkedin.com is a job board", 200, 3.0, 0, None), 6: (None, 200, 3.0, 0, True), 7: ("timed out", None, 3.0, 0, None), 8: ("private or loopback address", None, None, 0, None),
        9: ("not a valid absolute URL", None, None, 0, None), 10: ("HTTP 0", None, 3.0, 0, None),
    }
