"""URL expressions: splitting, validity, normal form, domain, resolution.

All of them are plain Column expressions. A URL is cut once, by one regex, and
every check reads the pieces, so an expression stays small however many parts
it uses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageforge.functions.base import any_contains, count_of, let, squeezed_strip, strip

# Hosts that are never crawled (exact host match).
BLOCKED_DOMAINS = (
    "localhost", "127.0.0.1", "0.0.0.0", "::1", "example.com", "example.org", "example.net",
)

# Path endings that are skipped.
SKIP_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".tar", ".gz",
    ".exe", ".dmg", ".pkg", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".jpg", ".jpeg",
    ".png", ".gif", ".bmp", ".svg", ".ico", ".css", ".js", ".xml", ".json", ".txt", ".log",
)

# Texts searched in the lower-cased URL, and one pattern whose dot
# is unescaped on purpose: any character followed by "env" counts.
SUSPICIOUS_TEXTS = (
    "../", "%2e%2e%2f", "%252e%252e%252f", "file://", "ftp://", "sftp://",
    "admin", "login", "password", "secret", "wp-admin", "wp-login", "config",
)
SUSPICIOUS_ENV = ".env"

# IPv4 ranges that count as private, loopback or link-local
# (0/8 10/8 127/8 169.254/16 172.16/12 192.0.0/24 192.0.2/24 192.168/16
# 198.18/15 198.51.100/24 203.0.113/24 240/4, less two public addresses).
_PRIVATE_IPV4 = (
    r"^(?!192\.0\.0\.(?:9|10)\z)(?:(?:0|10|127|24[0-9]|25[0-5])\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\."
    r"|192\.0\.[02]\.|192\.168\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.)"
)

# IPv6 networks that count as private, loopback or link-local, as
# (first groups, prefix length), and networks inside 2001::/23 that do not.
_PRIVATE_IPV6 = (
    ((0, 0, 0, 0, 0, 0, 0, 0), 128), ((0, 0, 0, 0, 0, 0, 0, 1), 128), ((0x64, 0xFF9B, 1), 48), ((0x100, 0, 0, 0), 64),
    ((0x2001, 0), 23), ((0x2001, 0xDB8), 32), ((0x2002,), 16), ((0x3FFF, 0), 20), ((0xFC00,), 7), ((0xFE80,), 10),
)
_PUBLIC_IPV6 = (
    ((0x2001, 1, 0, 0, 0, 0, 0, 1), 128), ((0x2001, 1, 0, 0, 0, 0, 0, 2), 128), ((0x2001, 3), 32),
    ((0x2001, 4, 0x112), 48), ((0x2001, 0x20), 28), ((0x2001, 0x30), 28),
)

# Words whose presence in a non-numeric host marks it as local.
LOCAL_HOST_MARKS = ("localhost", "local", "127.0.0.1", "::1")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Schemes whose last path segment may carry ";params".
_PARAM_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps",
                  "sip", "sips", "mms", "sftp", "tel")


# White space as Python strips it, and the characters a URL may not start with.
_OUTER = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_LEADING = "".join(map(chr, range(33)))

# One regex cuts a URL into scheme, network location, host, path and query;
# the pieces are joined by a noncharacter and split into an array.
_CUT = "\ufdd1"
_PIECES = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
    r"(?://((?:[^/?#]*@)?(\[[^\]/?#]*|[^/?#:\[]*)[^/?#]*))?([^?#]*)(?:\?([^#]*))?.*\z"
)


@dataclass(frozen=True)
class UrlParts:
    scheme: Column
    netloc: Column
    path: Column
    query: Column
    host: Column
    malformed: Column


def with_parts(url: Column, body: Callable[[UrlParts], Column], outer: bool = False) -> Column:
    """Evaluate ``body`` on the parts of a URL, which is cut once.

    The path comes without ``;params``. ``outer`` strips surrounding white space
    first; leading control characters and line breaks never belong to a URL.
    """
    stripped = F.btrim(url, F.lit(_OUTER)) if outer else url
    clean = F.translate(F.ltrim(stripped, F.lit(_LEADING)), "\t\r\n", "")

    def read(pieces: Column) -> Column:
        scheme, netloc, full_path = F.lower(F.get(pieces, F.lit(0))), F.get(pieces, F.lit(1)), F.get(pieces, F.lit(3))
        path = F.when(
            full_path.contains(";") & scheme.isin(*_PARAM_SCHEMES), F.regexp_replace(full_path, r";[^/]*\z", "")
        ).otherwise(full_path)
        host = F.ltrim(F.lower(F.get(pieces, F.lit(2))), F.lit("["))
        malformed = netloc.contains("[") != netloc.contains("]")
        return body(UrlParts(scheme, netloc, path, F.get(pieces, F.lit(4)), host, malformed))

    return let(F.split(F.regexp_replace(clean, _PIECES, _CUT.join(f"${k}" for k in range(1, 6))), _CUT), read)


def domain_of(url: Column) -> Column:
    """Lower-cased network location, user info and port kept; empty when absent."""
    domain = with_parts(url, lambda p: F.when(p.malformed, "").otherwise(F.lower(p.netloc)))
    return F.coalesce(domain, F.lit(""))


def same_domain(left: Column, right: Column) -> Column:
    return domain_of(left) == domain_of(right)


def scheme_of(url: Column) -> Column:
    return with_parts(url, lambda p: p.scheme, outer=True)


def url_path(url: Column) -> Column:
    return with_parts(url, lambda p: p.path)


def origin_of(url: Column) -> Column:
    """``scheme://netloc``, the key under which robots rules are kept."""
    return with_parts(url, lambda p: F.concat(p.scheme, F.lit("://"), p.netloc))


def host_of(url: Column) -> Column:
    """Host name without user info, port or brackets, lower-cased; empty when absent."""
    return with_parts(url, lambda p: p.host, outer=True)


def ipv6_groups(host: Column) -> Column:
    """The eight numbers of an IPv6 literal, in any of its spellings; null when it is none."""
    bare = F.regexp_replace(host, r"%[^%]+\z", "")
    octets = F.split(F.regexp_extract(bare, rf"(?:^|:)({_OCTET}(?:\.{_OCTET}){{3}})\z", 1), r"\.")
    pair = lambda k: F.hex(F.get(octets, k).try_cast("int") * 256 + F.get(octets, k + 1).try_cast("int"))
    plain = F.when(
        bare.contains("."), F.lower(F.concat(F.regexp_extract(bare, r"^(.*:)[^:]*\z", 1), pair(0), F.lit(":"), pair(2)))
    ).otherwise(bare)

    def read(halves: Column) -> Column:
        side = lambda k: F.when(F.coalesce(F.get(halves, k), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(halves, k), ":"))

        def of(left: Column, right: Column) -> Column:
            missing = 8 - F.size(left) - F.size(right)
            groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
            numbers = F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int"))
            whole = F.forall(groups, lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
            shape = F.when(F.size(halves) == 1, missing == 0).otherwise((F.size(halves) == 2) & (missing >= 1))
            return F.when(whole & shape, numbers)

        return let(side(0), lambda left: let(side(1), lambda right: of(left, right)))

    return let(F.split(plain, "::", -1), read)


def _in_network(groups: Column, network: tuple[tuple[int, ...], int]) -> Column:
    first, bits = network
    test = F.lit(True)
    for k, number in enumerate(first):
        width = min(16, bits - 16 * k)
        if width > 0:
            test = test & (F.shiftright(F.get(groups, k), 16 - width) == number >> (16 - width))
    return test


def _is_private_ipv6(groups: Column) -> Column:
    any_of = lambda networks: F.exists(F.array(*[_in_network(groups, n) for n in networks]), lambda x: x)
    byte = lambda k, shift: F.shiftright(F.get(groups, k), shift).bitwiseAND(255).cast("string")
    quad = F.concat_ws(".", byte(6, 8), byte(6, 0), byte(7, 8), byte(7, 0))
    mapped = _in_network(groups, ((0, 0, 0, 0, 0, 0xFFFF), 96))
    return F.when(mapped, quad.rlike(_PRIVATE_IPV4)).otherwise(any_of(_PRIVATE_IPV6) & ~any_of(_PUBLIC_IPV6))


def is_private_host(host: Column) -> Column:
    """Private IP literal, or a host name that contains a local marker."""
    named = any_contains(host, LOCAL_HOST_MARKS)
    literal = let(ipv6_groups(host), lambda g: F.coalesce(F.when(g.isNotNull(), _is_private_ipv6(g)), named))
    return F.when(host.rlike(_IPV4), host.rlike(_PRIVATE_IPV4)).when(host.contains(":"), literal).otherwise(named)


_ENDINGS = r"(?i)\.(?:" + "|".join(e[1:] for e in SKIP_EXTENSIONS) + r")\z"


def has_skipped_extension(url: Column) -> Column:
    return with_parts(url, lambda p: p.path.rlike(_ENDINGS), outer=True)


def has_suspicious_pattern(url: Column) -> Column:
    def search(lowered: Column) -> Column:
        return any_contains(lowered, SUSPICIOUS_TEXTS) | (lowered.contains("env") & lowered.rlike(SUSPICIOUS_ENV))

    return let(F.lower(url), search)


def url_reject_reason(url: Column, blocked: tuple[str, ...] = BLOCKED_DOMAINS) -> Column:
    """First failing check of a URL, or null when the URL may be crawled.

    ``blocked`` is the exact-host block list; an empty list switches that check
    off (used when the list is applied as an anti join instead).
    """

    def checks(parts: UrlParts) -> Column:
        reason = (
            F.when(parts.malformed, "malformed")
            .when(~parts.scheme.isin("http", "https"), "scheme")
            .when(parts.host == "", "host")
        )
        if blocked:
            reason = reason.when(parts.host.isin(*blocked), "blocked_domain")
        return reason.when(is_private_host(parts.host), "private_address").when(
            parts.path.rlike(_ENDINGS), "skipped_extension"
        )

    return F.when(url.isNull() | (url == ""), "empty").otherwise(
        F.coalesce(with_parts(url, checks, outer=True), F.when(has_suspicious_pattern(url), "suspicious_pattern"))
    )


def is_valid_url(url: Column, blocked: tuple[str, ...] = BLOCKED_DOMAINS) -> Column:
    return url_reject_reason(url, blocked).isNull()


def normalize_url(url: Column) -> Column:
    """Normal form for deduplication: no fragment, sorted query, bare root."""

    def build(parts: UrlParts) -> Column:
        sorted_query = F.array_join(F.sort_array(F.split(parts.query, "&")), "&")
        joined = F.concat(
            parts.scheme, F.lit("://"), parts.netloc, parts.path,
            F.when(parts.query != "", F.concat(F.lit("?"), sorted_query)).otherwise(""),
        )
        bare = F.when(F.length(parts.path) <= 1, F.rtrim(joined, F.lit("/"))).otherwise(joined)
        return F.when(parts.malformed, url).otherwise(bare)

    return with_parts(url, build, outer=True)


def has_http_protocol(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def _remove_dot_segments(path: Column) -> Column:
    def collapse(p: Column) -> Column:
        segments = F.split(p, "/")

        def step(kept: Column, segment: Column) -> Column:
            # The leading empty segment (the root slash) is never popped.
            popped = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
            return (
                F.when(segment == ".", kept)
                .when(segment == "..", popped)
                .otherwise(F.concat(kept, F.array(segment)))
            )

        joined = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
        closed = p.rlike(r"/\.\.?\z")
        return F.when(
            p.contains("/."), F.concat(joined, F.when(closed, "/").otherwise(""))
        ).otherwise(p)

    return let(path, collapse)


_ROOT = r"^([A-Za-z][^:/?#]*:(?://[^/?#]*)?)"
_FOLDER = r"^[A-Za-z][^:/?#]*:(?://[^/?#]*)?(/(?:[^?#]*/)?)"


def resolve_url(base: Column, reference: Column) -> Column:
    """Reference resolution against a base URL (RFC 3986, section 5.2)."""
    root = F.regexp_extract(base, _ROOT, 1)
    folder = F.regexp_extract(base, _FOLDER, 1)
    no_fragment = F.substring_index(base, "#", 1)
    ref_path = F.regexp_extract(reference, r"^([^?#]*)", 1)
    tail = F.regexp_extract(reference, r"(?s)^[^?#]*(.*)", 1)
    merged = F.concat(F.when(folder == "", "/").otherwise(folder), ref_path)
    return (
        F.when(reference == "", base)
        .when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), reference)
        .when(reference.startswith("//"), F.concat(F.substring_index(base, ":", 1), F.lit(":"), reference))
        .when(reference.startswith("#"), F.concat(no_fragment, reference))
        .when(reference.startswith("?"), F.concat(F.substring_index(no_fragment, "?", 1), reference))
        .when(reference.startswith("/"), F.concat(root, _remove_dot_segments(ref_path), tail))
        .otherwise(F.concat(root, _remove_dot_segments(merged), tail))
    )


def absolute_link(base: Column, value: Column) -> Column:
    """Link rule: values that do not start with ``http`` are resolved."""
    return F.when((value == "") | value.startswith("http"), value).otherwise(resolve_url(base, value))


def absolute_image(base: Column, value: Column) -> Column:
    """Product image rule: only values with a leading slash are resolved."""
    return F.when(value.startswith("/"), resolve_url(base, value)).otherwise(value)


def url_entry_messages(url: Column, index: Column, duplicate: Column) -> Column:
    """Messages of one entry of a URL list, in check order."""
    trimmed = strip(url)
    at = F.concat(F.lit("URL at index "), index.cast("string"))
    protocol = F.concat(at, F.lit(" must use http or https protocol: "), trimmed)
    later = F.array_compact(
        F.array(
            F.when(duplicate, F.concat(F.lit("Duplicate URL found: "), trimmed)),
            F.when(trimmed.contains(" "), F.concat(at, F.lit(" contains spaces: "), trimmed)),
            F.when(
                F.length(trimmed) > 2048, F.concat(at, F.lit(" is too long (max 2048 characters)"))
            ),
        )
    )
    return (
        F.when(url.isNull(), F.array(F.concat(at, F.lit(" must be a string"))))
        .when(trimmed == "", F.array(F.concat(at, F.lit(" cannot be empty"))))
        .when(~has_http_protocol(trimmed), F.array(protocol))
        .otherwise(later)
    )


def selector_messages(field: Column, selector: Column) -> Column:
    """Messages of one selector: blank, unbalanced, suspicious."""

    def about(prefix: str, suffix: Column) -> Column:
        return F.concat(F.lit(prefix), F.lit("'"), field, F.lit("'"), suffix)

    shown = F.concat(F.lit(": "), selector)
    lowered = F.lower(selector)
    checks = F.array_compact(
        F.array(
            F.when(
                count_of(selector, "[") != count_of(selector, "]"),
                about("Unmatched brackets in selector for ", shown),
            ),
            F.when(
                count_of(selector, "(") != count_of(selector, ")"),
                about("Unmatched parentheses in selector for ", shown),
            ),
            F.when(
                lowered.contains("<script") | lowered.contains("javascript:") | lowered.contains("data:"),
                about("Suspicious content in selector for ", shown),
            ),
        )
    )
    return (
        F.when(selector.isNull(), F.array(about("Selector for ", F.lit(" must be a string"))))
        .when(squeezed_strip(selector) == "", F.array(about("Selector for ", F.lit(" cannot be empty"))))
        .otherwise(checks)
    )
