"""The query language: text to tree, rewriting, tree to DataFrames.

  or   := diff (('|' | 'OR') diff)*        diff := and ('-' and)?
  and  := ord (('&' | 'AND' | nothing) ord)*    ord := aln ('<' aln)*      aln := unary ('^' unary)?
  unary := '!' unary | atom ('~' INT)? ('{' NUMBER '}')?
  atom := FIELD ':' atom | '(' or ')' | '"' word+ '"' | '[' word? '..' word? ']' | word '*' | '#TRUE' | '#FALSE' | '@' INT | word

A bare word is looked for in every field that the alignment gives it, and in the default field; inside a field or a phrase nothing is
rewritten.  Stop words are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..functions.analyze import STOP_WORDS
from ..functions.porter import stem
from ..operators import algebra as A
from ..operators.rank import Leaf
from ..sources.quads import RDF_TYPE

DEFAULT_FIELD = "object"


@dataclass(frozen=True)
class Node:
    kind: str  # term multi prefix range true false and or not diff ordered phrase low align select remap weight
    parts: tuple = ()
    value: object = None


def term(t: str) -> Node:
    return Node("term", (), t)


class QueryError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:(?P<str>\"[^\"]*\")|(?P<range>\[[^\]]*\])|(?P<const>#TRUE|#FALSE)|(?P<ref>@\d+)|(?P<weight>\{[\d.]+\})|(?P<field>\w[\w.#/-]*:(?=[^\s/]))|(?P<word>\w+\*?)|(?P<op>[|&<^!~()-]))")


@dataclass
class Parser:
    """raw: neither analysed nor rewritten (the second query type)."""

    stop: tuple[str, ...] = STOP_WORDS
    stemmed: bool = False
    short: dict[str, str] = field(default_factory=dict)
    raw: bool = False
    processor: Callable[[str], str | None] | None = None  # instead of the steps below: the term of a word, or nothing

    def __call__(self, text: str) -> Node:
        self.tokens, at = [], 0
        text = decode_entities(text)
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                if re.match(r"\s*[^\w\s]", text[at:]) and not self.raw:
                    at += len(re.match(r"\s*[^\w\s]", text[at:])[0])
                    continue
                raise QueryError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        node = self._or()
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.tokens[self.at][1]!r}")
        if node is None:
            raise QueryError("nothing to look for")
        return node

    def _peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in texts and self.tokens[self.at][0] in ("op", "word")

    def _chain(self, kind: str, ops: tuple[str, ...], inner) -> Node | None:
        parts = [inner()]
        while self._peek(*ops):
            self.at += 1
            parts.append(inner())
        parts = [p for p in parts if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else Node(kind, tuple(parts))

    def _or(self) -> Node | None:
        return self._chain("or", ("|", "OR"), self._diff)

    def _diff(self) -> Node | None:
        a = self._and()
        if self._peek("-"):
            self.at += 1
            b = self._and()
            return a if b is None or a is None else Node("diff", (a, b))
        return a

    def _and(self) -> Node | None:
        parts = [self._ordered()]
        while self.at < len(self.tokens):
            if self._peek("&", "AND"):
                self.at += 1
            elif self.tokens[self.at] == ("op", "!") or self.tokens[self.at] == ("op", "("):
                pass
            elif self.tokens[self.at][0] == "op" or self._peek("OR"):
                break
            parts.append(self._ordered())
        parts = [p for p in parts if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def _ordered(self) -> Node | None:
        return self._chain("ordered", ("<",), self._align)

    def _align(self) -> Node | None:
        return self._chain("align", ("^",), self._unary)

    def _unary(self) -> Node | None:
        if self._peek("!"):
            self.at += 1
            n = self._unary()
            return None if n is None else Node("not", (n,))
        n = self._atom()
        if self._peek("~"):
            self.at += 1
            kind, k = self._next()
            if not k.isdigit():
                raise QueryError("a width is needed after ~")
            n = None if n is None else Node("low", n.parts if n.kind == "and" else (n,), int(k))
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "weight":
            w = float(self._next()[1][1:-1])
            n = None if n is None else Node("weight", (n,), w)
        return n

    def _next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise QueryError("the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def _word(self, w: str) -> str | None:
        if self.raw or w.startswith("@"):
            return w
        if self.processor:
            return self.processor(w)
        if not re.fullmatch(r"[a-zA-Z0-9_]+", w) or w.lower() in self.stop:
            return None
        return stem(w.lower()) if self.stemmed else w.lower()

    def _atom(self) -> Node | None:
        kind, s = self._next()
        if kind == "field":
            inner = self._atom()
            return None if inner is None else Node("select", (inner,), self.short.get(s[:-1], s[:-1]))
        if (kind, s) == ("op", "("):
            n = self._or()
            if self._next() != ("op", ")"):
                raise QueryError(") is missing")
            return n
        if kind == "str":
            ws = [w for w in map(self._word, re.findall(r"\w+", s)) if w]
            return None if not ws else term(ws[0]) if len(ws) == 1 else Node("phrase", tuple(term(w) for w in ws))
        if kind == "range":
            m = re.fullmatch(r"\[\s*(\w*)\s*\.\.\s*(\w*)\s*\]", s)
            if not m:
                raise QueryError(f"bad range {s}")
            low = (lambda x: x or None) if self.raw else (lambda x: x.lower() or None)
            return Node("range", (), (low(m[1]), low(m[2])))
        if kind == "const":
            return Node("true" if s == "#TRUE" else "false")
        if kind in ("ref", "word"):
            if s.endswith("*"):
                return Node("prefix", (), s[:-1] if self.raw else s[:-1].lower())
            w = self._word(s)
            return None if w is None else term(w)
        raise QueryError(f"unexpected {s!r}")


def decode_entities(q: str) -> str:
    for a, b in (("&quot;", '"'), ("&#39;", "'"), ("&#92;", "\\"), ("&amp;", "&")):
        q = q.replace(a, b)
    return q


def clean_query(q: str) -> str:
    """For free text: dotted words as phrases, no other marks than quotes and colons, lower case, single spaces."""
    q = re.sub(r"(\w+(?:\.\w+)+)", lambda m: '"' + m[1].replace(".", " ") + '"', q)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s\":]", " ", q)).strip().lower()


_IRI = re.compile(r"\{(https?://[^}]*|_:[^}]*)\}")


def resource_names(q: str) -> list[str]:
    return [m[1][2:] if m[1].startswith("_:") else m[1] for m in _IRI.finditer(q)]


def encode_resources(q: str, ids: dict[str, int]) -> str:
    """{http://...} and {_:label} become @id; a name is tried in lower case too; an unknown one is an error."""
    def one(m: re.Match) -> str:
        name = m[1][2:] if m[1].startswith("_:") else m[1]
        got = ids.get(name, ids.get(name.lower()))
        if got is None:
            raise QueryError(f"unknown resource {m[1]}")
        return f"@{got}"

    return _IRI.sub(one, q)


def rewrite(n: Node, fields: dict[str, list[str]] | None, all_fields: list[str], scoped: bool = False) -> Node:
    """Bare terms get the fields that hold them (by the alignment, or all) and the default field; phrases get all fields; several terms are an Or."""
    if n.kind == "multi" and not scoped:
        return rewrite(Node("or", tuple(term(t) for t in n.value)), fields, all_fields, scoped)
    if n.kind == "term" and not scoped:
        known = all_fields if fields is None else fields.get(n.value, [])
        return Node("in", (n,), tuple(dict.fromkeys([*known, DEFAULT_FIELD])))
    if n.kind == "phrase" and not scoped:
        return Node("in", (n,), tuple(dict.fromkeys([*all_fields, DEFAULT_FIELD])))
    if n.kind in ("prefix", "range") and not scoped:
        return Node("in", (n,), (DEFAULT_FIELD,))
    return replace(n, parts=tuple(rewrite(p, fields, all_fields, scoped or n.kind in ("select", "phrase")) for p in n.parts))


def bare_terms(n: Node, scoped: bool = False) -> set[str]:
    if n.kind == "term":
        return set() if scoped else {n.value}
    if n.kind == "multi":
        return set() if scoped else set(n.value)
    return set().union(*[bare_terms(p, scoped or n.kind in ("select", "phrase")) for p in n.parts])


def positive_leaves(n: Node, fields: tuple | None = None, weight: float = 1.0) -> list[tuple[Leaf, tuple | None]]:
    """(leaf, fields) of what can make a document match: not what is below Not or on the right of a Difference.  Weights multiply down the tree."""
    if n.kind in ("term", "prefix", "range"):
        return [(Leaf(n.kind, n.value, weight), fields)]
    if n.kind == "multi":
        return [(Leaf("term", t, weight), fields) for t in n.value]
    if n.kind == "not":
        return []
    parts = n.parts[:1] if n.kind == "diff" else n.parts
    if n.kind == "weight":
        weight *= n.value
    if n.kind == "select":
        fields = (n.value,)
    if n.kind == "in":
        fields = n.value
    return [x for p in parts for x in positive_leaves(p, fields, weight)]


def type_only(n: Node, type_fields: tuple[str, ...] = ("type", "http_www_w3_org_1999_02_22_rdf_syntax_ns_type", RDF_TYPE)) -> bool:
    """A single choice of a type: no ranking is needed."""
    return n.kind == "select" and n.value in type_fields


def by_class(class_iri: str, values: dict[str, str]) -> str:
    """A query for instances of a class with given property values, property by property."""
    return " ".join([f"type:{{{class_iri}}}", *[f"(predicate:{{{p}}} ^ object:{v})" for p, v in values.items() if v]])


def spans(n: Node, tokens: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Spans of a positional node."""
    k = n.kind
    if k == "term":
        return A.term(tokens, n.value, fields)
    if k == "multi":
        return A.multi_term(tokens, list(n.value), fields)
    if k == "prefix":
        return A.prefix(tokens, n.value, fields)
    if k == "range":
        return A.term_range(tokens, *n.value, fields)
    if k == "phrase":
        return A.consecutive([spans(p, tokens, fields) for p in n.parts])
    if k == "ordered":
        return A.ordered([spans(p, tokens, fields) for p in n.parts])
    if k == "low":
        return A.low_pass([spans(p, tokens, fields) for p in n.parts], n.value)
    if k == "align":
        return A.align(spans(n.parts[0], tokens, fields), spans(n.parts[1], tokens, fields))
    if k == "or":
        return A.or_spans([spans(p, tokens, fields) for p in n.parts])
    if k == "diff":
        return A.span_difference(spans(n.parts[0], tokens, fields), spans(n.parts[1], tokens, fields))
    if k == "select":
        return spans(n.parts[0], tokens, [n.value])
    if k == "in":
        return spans(n.parts[0], tokens, list(n.value))
    if k == "remap":
        return A.remap(spans(n.parts[0], tokens, fields), n.value)
    if k in ("weight", "annotation"):
        return spans(n.parts[0], tokens, fields)
    raise QueryError(f"{k} has no positions")


def matching(n: Node, tokens: DataFrame, ids: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(doc_id) of a tree; ids: (doc_id) of all documents."""
    k = n.kind
    sub = lambda p, f=fields: matching(p, tokens, ids, f)
    if k == "true":
        return A.all_docs(ids)
    if k == "false":
        return A.no_docs(ids)
    if k == "and":
        return A.and_([sub(p) for p in n.parts])
    if k == "or":
        return A.or_([sub(p) for p in n.parts])
    if k == "not":
        return A.not_(ids, sub(n.parts[0]))
    if k == "diff":
        return A.difference(sub(n.parts[0]), sub(n.parts[1]))
    if k == "select":
        return sub(n.parts[0], [n.value])
    if k == "in" and n.parts[0].kind not in ("phrase",):
        return sub(n.parts[0], list(n.value))
    if k in ("weight", "annotation"):
        return sub(n.parts[0])
    return A.docs(spans(n, tokens, fields))
