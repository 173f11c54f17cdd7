"""Scalar functions against literal cases and plain-Python statements of the rules."""

import html
import random
import re
from datetime import datetime
from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageforge.functions import dates, entities, product, text, urls

PAGE_ALPHABET = "ab éÀ.!?,;-_&#x3;<>\t\n  \x07\x85\x1c日0129"
TEXTS = [
    "", "   ", "Done.", "One. Two. Three.", "a" * 201 + ". b", "x. " * 90, "No end", "A... B?! C. D. E.",
    "Ünïcode — slug_test  (x)! 日本", "the the the and cat cat dog dog dog a ab", "&amp;lt; &copy &notit; &#233; &eacute; &#x80; &bogus;",
    "  Hello\n\nWorld  &amp; stuff  ", " a\x1cb\x85c\x07 \x07d",
]


def random_texts(n=150):
    rng = random.Random(7)
    return ["".join(rng.choice(PAGE_ALPHABET) for _ in range(rng.randrange(0, 260))) for _ in range(n)]


def clean(t):
    if not t:
        return ""
    t = re.sub(r"\s+", " ", html.unescape(t)).strip()
    return "".join(c for c in t if not (ord(c) < 9 or ord(c) in (11, 12) or 14 <= ord(c) < 32 or 127 <= ord(c) <= 132 or 134 <= ord(c) <= 159))


def test_clean_text(values):
    inputs = TEXTS + random_texts() + [None]
    assert values(entities.clean_text, inputs) == [clean(t) for t in inputs]
    assert values(entities.clean_text, ["  Hello\n\nWorld  &amp; stuff  "]) == ["Hello World & stuff"]


def test_word_counts(values):
    inputs = [clean(t) for t in TEXTS + random_texts()]
    wanted = [len(t.split()) for t in inputs]
    assert values(text.word_count, inputs) == wanted
    assert values(text.clean_word_count, inputs) == wanted
    assert values(text.word_count, [None]) == [0]


@pytest.mark.parametrize("words, minutes", [(0, 0), (10, 1), (500, 2), (700, 4), (300, 2), (900, 4)])
def test_reading_time(values, words, minutes):
    assert values(text.reading_time, [" ".join(["w"] * words)]) == [minutes]


def filled(sentences, limit):
    out = ""
    for s in sentences:
        if len(out + s) > limit:
            break
        out += s + ". "
    return out.strip()


def test_excerpt(values):
    inputs = TEXTS + random_texts()
    assert values(text.excerpt, inputs) == [(filled(t.split(". "), 200) or None) if t else None for t in inputs]
    assert values(text.excerpt, ["Done.", "a" * 201]) == ["Done..", None]


def test_summary(values):
    def rule(t):
        parts = [p.strip() for p in re.split(r"[.!?]+", t) if p.strip()]
        return filled(parts[:3], 300) or None

    inputs = TEXTS + random_texts()
    assert values(text.summary, inputs) == [rule(t) for t in inputs]


def test_slug(values):
    def rule(t):
        if not t:
            return None
        return re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", t.lower())).strip("-")

    inputs = TEXTS + random_texts()
    assert values(text.slug, inputs) == [rule(t) for t in inputs]


def test_keywords(values):
    def rule(t):
        counts = {}
        for w in re.findall(r"\b[a-zA-Z]{3,}\b", (" " + t).lower()):
            if w not in text.STOP_WORDS:
                counts[w] = counts.get(w, 0) + 1
        return [w for w, n in sorted(counts.items(), key=lambda e: -e[1])[:10] if n > 1]

    rng = random.Random(3)
    vocabulary = ["cat", "dog", "the", "theory", "éclair", "abc_d", "ab", "Zebra", "with", "within", "x1y", "tree"] + [f"w{chr(97+i)}q" for i in range(20)]
    inputs = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))) for _ in range(80)] + TEXTS
    assert values(text.keywords, inputs, F.lit("")) == [rule(t) for t in inputs]


def test_language_and_topic(values):
    assert values(text.language, ["", None, "the cat and it is with that", "el que y un se la", "être avoir il le", "zzz"]) == [
        "en", "en", "en", "es", "fr", "en"]
    assert values(text.topic, ["nothing", "the doctor and the patient", "market health", "tech"], F.lit("")) == [
        "general", "health", "business", "technology"]


def test_prompt_rules(values):
    assert values(text.mined_tags, ["an algorithm in javascript", "a linked list"]) == [["javascript", "java", "go"], ["list", "linked-list"]]
    assert values(text.code_language, ["def f", "System.out", "let mut x", "public class A", "#include", "none"]) == [
        "python", None, "javascript", "java", "c++", None]
    assert values(text.difficulty, ["simple complex", "optimize", "w " * 60, "w " * 201, ""]) == ["easy", "hard", "medium", "hard", "easy"]
    assert values(text.prompt_category, ["solve code", "solve", "think", "zzz"], F.lit("mathsite.org")) == [
        "programming", "mathematics", "logic", "mathematics"]


EXTRACTION = ["%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%B %d, %Y",
              "%d %B %Y", "%Y-%m-%dT%H:%M:%S.%fZ"]
BLOG = ["%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%B %d, %Y", "%d %B %Y", "%m/%d/%Y", "%d/%m/%Y"]


@pytest.mark.parametrize("fn, formats", [(dates.parse_extracted_date, EXTRACTION), (dates.parse_blog_date, BLOG)])
def test_dates(values, fn, formats):
    def rule(t):
        for f in formats:
            try:
                return datetime.strptime(t.strip(), f)
            except ValueError:
                continue
        return None

    inputs = ["2024-01-15T10:30:00Z", "2024-01-15T10:30:00", "2024-1-5 1:2:3", " 2024-01-15 ", "01/02/2024", "25/12/2024", "12/25/2024",
              "31/02/2024", "January 15, 2024", "january  5, 2024", "15 MARCH 2024", "2024-01-15T10:30:00.5Z", "2024-01-15T10:30:00.123456Z",
              "soon", "", "2024-02-30", "24-01-01", "2024-01-15t10:30:00z", "Foo 5, 2024", "2024-01-15T25:00:00Z", "1/1/20245"]
    assert values(fn, inputs) == [rule(t) for t in inputs]


PRICES = {"$1,234.50": 1234.5, "1.234,50 €": 1234.5, "900,1": 900.1, "1,234": 1234.0, "call us": None, "1.2.3": None, "": None,
          "1,234,567": 1234567.0, ",": None, ".5": 0.5, "5.": 5.0, "USD 900.10": 900.1, "1,23,4.5": 1234.5}


def test_prices(values):
    assert values(product.parse_price, list(PRICES)) == list(PRICES.values())


def price_rule(t):
    k = re.sub(r"[^0-9.,]", "", t)
    if "," in k and "." in k:
        k = k.replace(".", "").replace(",", ".") if k.rfind(",") > k.rfind(".") else k.replace(",", "")
    elif "," in k:
        k = k.replace(",", ".") if k.count(",") == 1 and len(k.split(",")[1]) <= 2 else k.replace(",", "")
    try:
        return float(k)
    except ValueError:
        return None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789.,$€ x", max_size=9), min_size=30, max_size=60))
def test_price_property(values, inputs):
    assert values(product.parse_price, inputs) == [price_rule(t) for t in inputs]


def test_numbers(values):
    assert values(product.clamp_rating, ["7", "-1", "4.5 out of 5", "1.0d", "nan", "inf", None, " 3.5 ", "1e0"]) == [5.0, 0.0, None, None, 5.0, 5.0, None, 3.5, 1.0]
    assert values(product.parse_int_via_float, ["3.9", "-3.7", "nan", "inf", "x", "1e3"]) == [3, -3, None, None, None, 1000]
    assert values(product.parse_strict_int, ["12", "12.5", " -7 ", "1_000", "", "x"]) == [12, None, -7, 1000, None, None]


def test_availability_and_currency(values):
    assert values(product.availability, ["Unavailable", "Sold out", "few left", "?", "Pre-Order", "", None]) == [
        "in_stock", "out_of_stock", "limited", "unknown", "pre_order", None, None]
    assert values(product.currency_of, ["€5 $", "5 chf", "£5", "5", "¥"]) == ["USD", "CHF", "GBP", "USD", "JPY"]


def test_specifications_and_examples(values):
    assert values(product.specifications_from_text, ["a: 1\nb : 2:3\nnone\na: 4", "", "no"]) == [{"a": "4", "b": "2:3"}, None, {}]
    got = values(product.examples, ["plain  text", '[{"input": " a &amp; b ", "output": 3}, "x", 5, true]', "[]", "", "[broken"])
    shape = [None if g is None else [tuple(e) for e in g] for g in got]
    assert shape == [[("plain  text", "", "")], [("a & b", "3", ""), ("x", "", ""), ("5", "", ""), ("True", "", "")], None, None, [("[broken", "", "")]]


URLS = {
    "file:///etc/passwd": "scheme", "https://localhost/admin": "blocked_domain", "https://example.com/page": "blocked_domain",
    "https://localnews.com/": "private_address", "https://a.org/x.PDF": "skipped_extension", "https://a.org/?q=config": "suspicious_pattern",
    "": "empty", "https:///x": "host", "https://sub.example.com/x": None, "http://10.1.2.3/": "private_address", "http://11.1.2.3/": None,
    "http://192.0.0.9/": None, "http://[::1]/": "blocked_domain", "http://[fe80::1]/": "private_address", "http://[2606:4700::1]/": None,
    "  https://ok.org/a  ": None, "https://u:p@127.0.0.1:80/": "blocked_domain", "https://ok.org/environment": "suspicious_pattern",
    "https://a.org/x.pdf;v=1": "skipped_extension", "https://a.org/x?f=.pdf": None, "http://300.1.1.1/": None, "http://[::1/": "malformed",
}


def test_url_reasons(values):
    assert dict(zip(URLS, values(urls.url_reject_reason, list(URLS)))) == URLS


def test_private_addresses(values):
    import ipaddress

    rng = random.Random(5)
    hosts = [f"{rng.choice([10, 100, 127, 169, 172, 192, 198, 203, 224, 240, rng.randrange(256)])}.{rng.choice([0, 16, 18, 51, 168, 254, rng.randrange(256)])}."
             f"{rng.choice([0, 2, 100, 113, rng.randrange(256)])}.{rng.randrange(256)}" for _ in range(1500)]
    assert values(urls.is_private_host, hosts) == [ipaddress.ip_address(h).is_private or ipaddress.ip_address(h).is_loopback for h in hosts]


def test_normal_form(values):
    def rule(u):
        p = urlparse(u.strip())
        n = f"{p.scheme}://{p.netloc}{p.path}"
        if p.query:
            n += "?" + "&".join(sorted(p.query.split("&")))
        return n.rstrip("/") if n.endswith("/") and len(p.path) <= 1 else n

    inputs = ["https://example.com/page?b=2&a=1#section", "https://h.org/", "HTTP://H.Org/A;p=1?x", "https://h.org/?b=/", "https://h.org?", "//h/p",
              "plain", "mailto:a;b@c", "https://h.org//", " https://h.org/a/ ", "https://h.org/a;b/c;d", "https://h.org/#f", "https://h.org/?q=1#f?g"]
    assert values(urls.normalize_url, inputs) == [rule(u) for u in inputs]
    assert values(urls.domain_of, inputs + ["https://U@H.org:8/x", None]) == [urlparse(u).netloc.lower() for u in inputs] + ["u@h.org:8", ""]


def test_resolve(values):
    base = "https://h.org/a/b/c?x=1#f"
    refs = ["/r", "r", "../r", "./r/", "?q", "#g", "//o.org/z", "mailto:a", "..", "../..", "../../../r?y#z", "", ".", "./", "r/./s", "r/../s", "http://x/y", "a:b/../c", "/a/../b/."]
    assert [v for v in values(lambda v: urls.resolve_url(F.lit(base), v), refs)] == [urljoin(base, r) for r in refs]


def test_private_ipv6_equals_the_address_library(values):
    import ipaddress
    import random

    rng = random.Random(4)
    heads = [0, 1, 0x64, 0x100, 0x2001, 0x2002, 0xFC00, 0xFE80, 0xFF9B, 0xDB8, 0xFFFF, 0x20, 0x7F00, 0x4860]
    found = []
    for _ in range(400):
        number = 0
        for _ in range(8):
            number = number << 16 | rng.choice([0, 0, 0, rng.choice(heads), rng.randrange(1 << 16)])
        a = ipaddress.IPv6Address(number if rng.random() < 0.8 else 0xFFFF << 32 | rng.randrange(1 << 32))
        found.append(rng.choice([a.exploded, a.compressed, str(a)]))
    found += ["::ffff:127.0.0.1", "::ffff:1.1.1.1", "1::2::3", "1:2:3", ":::", "1:2:3:4:5:6:7:8:9", "::1.2.3.400", "g::1"]

    def private(h):
        try:
            a = ipaddress.ip_address(h)
        except ValueError:
            return any(m in h for m in ("localhost", "local", "127.0.0.1", "::1"))
        return a.is_private or a.is_loopback or a.is_link_local

    from pageforge.functions.urls import is_private_host

    assert values(is_private_host, found) == [private(h) for h in found]


def test_every_reference_is_decoded_as_by_the_standard_library(values):
    import html
    import random

    from pageforge.functions.entities import clean_text, decode_entities

    rng = random.Random(1)
    texts = [f"&{n}" for n in html.entities.html5] + [f"&{n.rstrip(';')}x" for n in html.entities.html5]
    codes = [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 10**22]
    texts += [f"a &#{i}; &#{i} b &#x{i:x};&#X{i:X}g" for i in codes]
    bits = ["&", "#", "x", "X", "amp", ";", "lt", "notit", "not", "é", "12", "0", "ff", " ", "\n", "<", "&amp;", "&amp;lt;", "a" * 33, "&#0000000000065;", "&copy", "&copy;"]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(2000)]
    assert values(decode_entities, texts) == [html.unescape(t) for t in texts]
    assert values(clean_text, ["&nbsp;a &eacute;&#9;b&#x80;"]) == ["a é b€"]
