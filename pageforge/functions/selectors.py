"""CSS selectors: parsing, and their form as data.

Nothing here needs Spark. Functions of this module travel to Python workers by
value, so executors need no copy of it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ATTR_VALUE = r"""(?:"[^"]*+"|'[^']*+')"""

# A selector set as data: per field the selectors in priority order, each a chain of steps; a step's
# attribute tests carry the pattern that reads the attribute. ``problem`` is why a field's list was cut short.
COMPILED = (
    "array<struct<field:string,choices:array<array<struct<combinator:string,tag:string,"
    "tests:array<struct<pattern:string,op:string,wanted:string>>>>>,problem:string>>"
)


@dataclass(frozen=True)
class Step:
    """One compound selector and how it relates to the one before it."""

    combinator: str  # '' for the first, ' ' descendant, '>' child
    tag: str
    tests: tuple[tuple[str, str, str], ...]  # (attribute, operator, value)


class UnsupportedSelector(ValueError):
    pass


_COMPOUND_PART = re.compile(
    r"""\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]""",
    re.X,
)


def parse_selector(text: str) -> tuple[Step, ...]:
    """Compile one selector; forms outside tag, class, id, attribute, descendant and child raise."""
    spaced = re.sub(r"\s*>\s*(?![^\[]*\])", " > ", text.strip())
    pieces = re.findall(r"(?:\[[^\]]*\]|\S)+", spaced)
    steps: list[Step] = []
    combinator = ""
    for piece in pieces:
        if piece == ">":
            if not steps or combinator == ">":
                raise UnsupportedSelector(f"Malformed selector: {text}")
            combinator = ">"
            continue
        tag = re.match(r"\*|[A-Za-z][\w-]*|", piece).group(0)
        tests, at = [], len(tag)
        while at < len(piece):
            part = _COMPOUND_PART.match(piece, at)
            if part is None:
                raise UnsupportedSelector(f"Unsupported selector: {text}")
            if part["cls"]:
                tests.append(("class", "~=", part["cls"]))
            elif part["id"]:
                tests.append(("id", "=", part["id"]))
            else:
                tests.append((part["attr"], part["op"] or "", (part["val"] or "").strip("\"'")))
            at = part.end()
        if not tag and not tests:
            raise UnsupportedSelector(f"Malformed selector: {text}")
        if steps and not combinator:
            combinator = " "
        steps.append(Step(combinator, "" if tag == "*" else tag.lower(), tuple(tests)))
        combinator = ""
    if not steps or combinator:
        raise UnsupportedSelector(f"Malformed selector: {text}")
    return tuple(steps)


def attribute_re(name: str) -> str:
    own = rf"(?i:{re.escape(name)})(?=[\s=/>])"
    other = rf"(?!{own})[^\s=/>]++(?:\s*+=\s*+(?:{ATTR_VALUE}|[^\s>]*+))?+"
    return rf"(?s)^<[A-Za-z][^\s/>]*+(?:[\s/]++{other})*+[\s/]++{own}"


def value_re(name: str) -> str:
    """Pattern whose first group is the attribute's value, quotes included."""
    return attribute_re(name) + rf"\s*+=\s*+({ATTR_VALUE}|[^\s>]*+)"


def presence_re(name: str) -> str:
    return attribute_re(name) + r"[\s=/>]"


def parse_list(text: str) -> tuple[list[tuple[Step, ...]], str | None]:
    """Selectors of a comma list in priority order, up to the first that cannot be compiled, and the reason for that one.

    Such a selector stops its field, as an exception there would; earlier ones still count.
    """
    found = []
    for one in (s.strip() for s in text.split(",")):
        try:
            found.append(parse_selector(one))
        except UnsupportedSelector as problem:
            return found, str(problem)
    return found, None


def compiled(selectors: Mapping[str, str | None]) -> list[dict]:
    """A selector set as rows of ``COMPILED``, fields by name."""
    out = []
    for name, text in sorted(selectors.items()):
        choices, problem = parse_list(text or "")
        steps = [
            [
                {
                    "combinator": step.combinator,
                    "tag": step.tag,
                    "tests": [{"pattern": value_re(a) if op else presence_re(a), "op": op, "wanted": wanted} for a, op, wanted in step.tests],
                }
                for step in chain
            ]
            for chain in choices
        ]
        out.append({"field": name, "choices": steps, "problem": problem and f"Failed to extract {name}: {problem}"})
    return out
