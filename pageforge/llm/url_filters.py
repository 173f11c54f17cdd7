"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

The canonical URL is host, path and query: what follows the first ``://`` up to
a ``#``, the host's A-Z in lower case. Every pattern is a glob for the whole of
it: ``*`` stands for any run without ``/`` and ``?``, ``**`` for any run, ``?`` for
one character but those two, and ``\\`` makes the next character plain. A leading
``||`` lets the pattern begin at the host or at any of its parent domains.

All patterns stand side by side in the bits of a row of 64-bit words: a bit for
each number of matched symbols. One step over a character moves all patterns at
once, ``((D & ADVANCE[c]) << 1) | (D & STAY[c])``, with a carry from word to word;
after a dot of the host the first bits of the ``||`` patterns are set again. A
batch of URLs moves together, character by character, so the work is URLs times
characters times words, whatever the patterns hold. Nothing is shuffled.

Path rules (verdict, ``host/path``) become ``||host/path**``; the longest that fits
decides. Where none fits, the first list of globs with a match decides: allowed
ones, then blocked ones; a URL that none matches is allowed.

Defined results: a null URL or one without ``://`` has an empty host and path and
is judged as the empty string, so it is allowed unless a glob matches that; rows
are judged one by one, repeated or not; all columns of the input are kept, those
named like a result (host, path, rule, verdict, glob) are replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# State words of one step that are held at once: bounds a task's memory whatever the number of rules.
STEP_WORDS = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Production patterns of the method: hosts and paths a text corpus does not want.
BLOCKED = (
    "*adult-**", "*casino**", "*cheap-pills**", "*spam-farm**", "*porn**", "*viagra**", "*betting**", "*lottery-win**", "*free-money**", "*warez**",
    "**/wp-admin/**", "**/wp-login.php**", "**/cgi-bin/**", "**/login", "**/logout", "**/checkout/**", "**/cart/**",
    "**.jpg", "**.jpeg", "**.png", "**.gif", "**.mp3", "**.mp4", "**.avi", "**.zip", "**.tar.gz", "**.exe", "**.dmg", "**.iso", "**.apk",
    "**\\?**sessionid=**", "**\\?**replytocom=**",
)
ALLOWED = ("||w3.org/**", "||archive.org/details/**")


def symbols(pattern: str) -> tuple[bool, list[tuple[str, int]], int]:
    """(domain-anchored, [(character or '' for any one, loop before it)], loop at the end); loops: 0 none, 1 inside a part, 2 any."""
    domain = pattern.startswith("||")
    rest, out, loop = iter(pattern[2:] if domain else pattern), [], 0
    stars = 0
    for c in rest:
        if c == "*":
            stars += 1
            loop = 2 if stars > 1 else max(loop, 1)
            continue
        stars = 0
        if c == "\\":
            c = next(rest, "\\")
            out.append((c, loop))
        else:
            out.append(("" if c == "?" else c, loop))
        loop = 0
    return domain, out, loop


class Automaton:
    """Masks of a list of patterns; of several matches the pattern with the highest place in the list counts."""

    def __init__(self, patterns: list[str]):
        parsed = [symbols(p) for p in patterns]
        bits = sum(len(s) + 1 for _, s, _ in parsed)
        self.words = max(1, -(-bits // 64))
        letters = sorted({ord(c) for _, s, _ in parsed for c, _ in s if c} | {ord("/"), ord("?"), ord(".")})
        self.letters = np.array(letters, np.uint32)
        kind = {c: i for i, c in enumerate(letters)}
        # The last class is every other character.
        n = len(letters) + 1
        # Bits are set as rows of booleans, packed into words once.
        advance, stay = np.zeros((n, self.words * 64), bool), np.zeros((n, self.words * 64), bool)
        start, domain, accept = (np.zeros(self.words * 64, bool) for _ in range(3))
        self.owner = np.full(self.words * 64, -1, np.int32)
        inside = np.ones(n, bool)
        inside[[kind[ord("/")], kind[ord("?")]]] = False
        at = 0
        for p, (anchored, syms, loop) in enumerate(parsed):
            start[at] = True
            domain[at] = anchored
            for c, before in [*syms, (None, loop)]:
                if before:
                    stay[:, at] = inside if before == 1 else True
                if c is None:
                    accept[at] = True
                    self.owner[at] = p
                elif c:
                    advance[kind[ord(c)], at] = True
                else:
                    advance[:, at] = inside
                at += 1
        pack = lambda b: np.packbits(b, axis=-1, bitorder="little").view("<u8").astype(np.uint64)
        self.advance, self.stay, self.start, self.domain, self.accept = map(pack, (advance, stay, start, domain, accept))
        self.dot = kind[ord(".")]

    def _classes(self, texts: list[str]) -> np.ndarray:
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, code), len(self.letters) - 1)
        return np.where(self.letters[at] == code, at, len(self.letters))

    def best(self, texts: list[str], host_lengths: np.ndarray) -> np.ndarray:
        """Per text the last pattern of the list that matches it, or -1."""
        out = np.full(len(texts), -1, np.int64)
        rows = max(1, STEP_WORDS // self.words)
        for at in range(0, len(texts), rows):
            out[at : at + rows] = self._best(texts[at : at + rows], host_lengths[at : at + rows])
        return out

    def _best(self, texts, host_lengths):
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")
        length, begin, hosts = length[order], (np.cumsum(length) - length)[order], host_lengths[order]
        code = self._classes(texts)
        state = np.broadcast_to(self.start, (len(texts), self.words)).copy()
        live = len(texts) - np.searchsorted(length[::-1], np.arange(1, (length[0] if len(length) else 0) + 1))
        for i, n in enumerate(live.tolist()):
            c = code[begin[:n] + i]
            moved = state[:n] & self.advance[c]
            kept = state[:n] & self.stay[c]
            kept |= moved << np.uint64(1)
            kept[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            dots = (c == self.dot) & (i < hosts[:n])
            if dots.any():
                kept[dots] |= self.domain
            state[:n] = kept
        done = state & self.accept
        row, word = np.nonzero(done)
        found = np.full(len(texts), -1, np.int64)
        for lo in range(0, len(row), 1 << 16):
            r, w = row[lo : lo + (1 << 16)], word[lo : lo + (1 << 16)]
            hit, bit = np.nonzero(np.unpackbits(done[r, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            np.maximum.at(found, r[hit], self.owner[w[hit] * 64 + bit])
        out = np.empty(len(texts), np.int64)
        out[order] = found
        return out


def _plain(text: str) -> str:
    return "".join("\\" + c if c in "*?\\|" else c for c in text)


def rule_glob(rule: str) -> str:
    """The glob of a path rule ``host/path``."""
    host, slash, path = rule.partition("/")
    if not host or not slash or any(c in rule for c in "?#"):
        raise ValueError(f"a rule is host/path without query or fragment, not {rule!r}")
    return "||" + _plain(host.translate(str.maketrans(UPPER, LOWER)) + "/" + path) + "**"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query with its question mark) of a URL; all empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return host, path, query


def judge(pages: DataFrame, rules: list[tuple[str, str]], blocked=BLOCKED, allowed=ALLOWED, url: str = "url") -> DataFrame:
    """The rows with host, path, rule (the path rule that decides), verdict (allow or block) and glob (what else decides)."""
    if bad := [r for r in rules if r[0] not in ("allow", "block")]:
        raise ValueError(f"verdicts are allow and block, not {bad}")
    # Weakest first. Of rules of equal length the one with the longer host wins, then a block.
    ranked = sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), r[0] == "block"))
    table = [("block", g, None) for g in reversed(blocked)] + [("allow", g, None) for g in reversed(allowed)] + [(v, None, r) for v, r in ranked]
    patterns = [g if g is not None else rule_glob(r) for _, g, r in table]
    # No match is the last row: allow, by nothing.
    lists = [pa.array([row[i] for row in [*table, ("allow", None, None)]], pa.string()) for i in (2, 0, 1)]
    built: list[Automaton] = []

    @F.arrow_udf("rule string, verdict string, glob string")
    def decide(host: pa.Array, path: pa.Array, query: pa.Array) -> pa.Array:
        if not built:
            built.append(Automaton(patterns))
        hosts = host.to_pylist()
        texts = [h + p + q for h, p, q in zip(hosts, path.to_pylist(), query.to_pylist())]
        best = pa.array(built[0].best(texts, np.array([len(h) for h in hosts], np.int64)) % len(lists[0]))
        return pa.StructArray.from_arrays([x.take(best) for x in lists], names=["rule", "verdict", "glob"])

    results = ("host", "path", "rule", "verdict", "glob")
    kept = [c for c in pages.columns if c.lower() not in results]
    host, path, query = parts(pages[url])
    cut = pages.select(*[pages[c] for c in kept], F.struct(host.alias("host"), path.alias("path"), query.alias("query")).alias("__url"))
    found = cut.withColumn("__found", decide(F.col("__url.host"), F.col("__url.path"), F.col("__url.query")))
    return found.select(*kept, "__url.host", "__url.path", "__found.rule", "__found.verdict", "__found.glob")
