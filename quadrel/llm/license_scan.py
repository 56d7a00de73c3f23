"""Operator 4: licence detection by ordered signature rules.

Every rule is a hand-written regular expression with a priority and the keywords without one of which it can't match.  A
text is searched once for all keywords; only rules of keywords found are run, on the whole text.  Of two detections
one of which contains the other's interval, that of lower priority goes; what remains is reported in order of place.

Defined results: null and empty texts and texts without a keyword have no detections, so no rows.  Null ids are reported as null.  Repeated
rows are reported each.  Ties in priority go to the longer match, then to the earlier rule.  Case doesn't matter.  Offsets
count characters.  Only the id and text columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_slices
from .license_rules import RULES as TABLE

SCHEMA = "doc_id long, license string, rule string, priority int, begin int, end int, matched string"


@dataclass(frozen=True)
class Rule:
    name: str
    license: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str


RULES = [Rule(*r) for r in TABLE]


def roots(rules: list[Rule]) -> list[str]:
    """The longest part of each keyword, without those that contain another."""
    words = sorted({max(k.split("&"), key=lambda p: (len(p), p == "licen")) for r in rules for k in r.keywords}, key=lambda k: (len(k), k))
    out: list[str] = []
    for w in words:
        if not any(o in w for o in out):
            out.append(w)
    return out


def suppress(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """found: (begin, end, priority, rule number).  Drops each that a better one contains or that contains a better one."""
    best: list[tuple[int, int, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[2], x[0] - x[1], x[3], x[0])):
        if not any((b[0] <= x[0] and x[1] <= b[1]) or (x[0] <= b[0] and b[1] <= x[1]) for b in best):
            best.append(x)
    return sorted(best)


class Scanner:
    def __init__(self, rules: list[Rule]) -> None:
        import ahocorasick

        self.rules = rules
        self.regex = [re.compile(r.pattern, re.IGNORECASE) for r in rules]
        self.needs = [[frozenset(k.split("&")) for k in r.keywords] for r in rules]
        self.auto = ahocorasick.Automaton()
        for k in {p for need in self.needs for k in need for p in k}:
            self.auto.add_word(k, k)
        self.auto.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, int, int]]:
        if not text:
            return []
        words = {k for _, k in self.auto.iter(text.lower())}
        on = [i for i, need in enumerate(self.needs) if any(k <= words for k in need)] if words else []
        found = [(m.start(), m.end(), self.rules[i].priority, i) for i in on for m in self.regex[i].finditer(text) if m.end() > m.start()]
        return suppress(found)


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each detection."""
    rules = RULES if rules is None else rules
    holder: list[Scanner] = []
    d = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("t"))
    # one automaton of all roots passes over the text once
    gate = "|".join(re.escape(k) for k in roots(rules))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(Scanner(rules))
        b = b.filter(pc.match_substring_regex(b.column(1), gate, ignore_case=True))
        cols: list[list] = [[] for _ in range(7)]
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for s, e, p, r in holder[0](t):
                for c, v in zip(cols, (i, rules[r].license, rules[r].name, p, s, e, t[s:e])):
                    c.append(v)
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "license", "rule", "priority", "begin", "end", "matched"])

    return map_slices(d.where("t is not null"), run, SCHEMA, 256)
