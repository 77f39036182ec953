"""A Turtle and TriG reader for what is small and read on the driver: shapes and fixtures."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from .terms import BNODE, RDF, TYPE, XSD, Term, iri, literal

_TOKEN = re.compile(
    r'''(?P<space>(?:\s|\#[^\n]*)+)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')'''
    r'''|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[a-z]+)?)|(?P<bnode>_:[\w.-]*[\w-])'''
    r'''|(?P<number>[+-]?(?:\d+\.\d*(?:[eE][+-]?\d+)|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-](?:[\w.:%\\-]*[\w:%-])?)?|[A-Za-z]+)|(?P<mark>\^\^|[][().;,{}])''', re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


class TurtleError(ValueError):
    pass


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text)


class Graph:
    """Quads on the driver, with lookups by subject and predicate and by predicate and object."""

    def __init__(self, quads: Iterable[tuple[str | None, Term, str, Term]] = ()):
        self.quads = list(dict.fromkeys(quads))
        self.by_subject: dict[tuple[Term, str], list[Term]] = defaultdict(list)
        self.by_object: dict[tuple[str, Term], list[Term]] = defaultdict(list)
        self.predicates: dict[Term, dict[str, None]] = defaultdict(dict)
        for s, p, o in dict.fromkeys((s, p, o) for _, s, p, o in self.quads):
            self.by_subject[s, p].append(o)
            self.by_object[p, o].append(s)
            self.predicates[s][p] = None

    def objects(self, s: Term, p: str) -> list[Term]:
        return self.by_subject.get((s, p), [])

    def subjects(self, p: str, o: Term) -> list[Term]:
        return self.by_object.get((p, o), [])

    def one(self, s: Term, p: str) -> Term | None:
        found = self.objects(s, p)
        if len(found) > 1:
            raise ValueError(f"{s} has several values of {p}")
        return found[0] if found else None

    def items(self, head: Term) -> list[Term]:
        """An RDF list, read strictly."""
        out, seen = [], set()
        while head != iri(RDF + "nil"):
            if head in seen:
                raise ValueError("an RDF list runs in a circle")
            seen.add(head)
            first, rest = self.one(head, RDF + "first"), self.one(head, RDF + "rest")
            if first is None or rest is None:
                raise ValueError("an RDF list is broken")
            out.append(first)
            head = rest
        return out

    def is_list(self, node: Term) -> bool:
        return node == iri(RDF + "nil") or bool(self.objects(node, RDF + "first"))

    def __add__(self, other: Graph) -> Graph:
        return Graph([*self.quads, *other.quads])


class _Reader:
    def __init__(self, text: str, base: str, scope: str):
        self.text, self.base, self.scope = text, base, scope
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise TurtleError(f"unexpected text in line {text.count(chr(10), 0, at) + 1}: {text[at : at + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup or "", m[0]))
            at = m.end()
        self.at, self.prefixes, self.quads, self.graph, self.made = 0, {}, [], None, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        found = self.peek()
        if mark is not None and found[1] != mark:
            raise TurtleError(f"expected {mark!r}, found {found[1]!r}")
        self.at += 1
        return found

    def fresh(self) -> Term:
        self.made += 1
        return Term(BNODE, f"_:{self.scope}g{self.made}")

    def resolve(self, text: str) -> str:
        text = unescape(text)
        return text if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text) or not self.base else self.base + text

    def name(self, text: str) -> Term:
        prefix, colon, local = text.partition(":")
        if not colon or prefix not in self.prefixes:
            raise TurtleError(f"unknown prefix or word {text!r}")
        return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))

    def document(self) -> None:
        while self.at < len(self.tokens):
            kind, text = self.peek()
            word = text.lower().lstrip("@")
            if kind in ("at", "name") and word in ("prefix", "base"):
                self.take()
                if word == "prefix":
                    name = self.take()[1].rstrip(":")
                    self.prefixes[name] = self.resolve(self.take()[1][1:-1])
                else:
                    self.base = self.resolve(self.take()[1][1:-1])
                if text.startswith("@"):
                    self.take(".")
            elif text == "{" or word == "graph" or (kind in ("iri", "name", "bnode") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "{"):
                if word == "graph":
                    self.take()
                self.graph = None if text == "{" else self.node().lex
                self.take("{")
                while self.peek()[1] != "}":
                    self.statement()
                    if self.peek()[1] == ".":
                        self.take()
                self.take("}")
                self.graph = None
            else:
                self.statement()
                self.take(".")

    def statement(self) -> None:
        bracket = self.peek()[1] == "["
        subject = self.node()
        if not (bracket and self.peek()[1] in (".", "}")):
            self.properties(subject)

    def properties(self, subject: Term) -> None:
        while True:
            kind, text = self.peek()
            predicate = TYPE if text == "a" else None
            if predicate:
                self.take()
            else:
                found = self.node()
                if not found.is_iri:
                    raise TurtleError("a predicate is an IRI")
                predicate = found.lex
            while True:
                self.quads.append((self.graph, subject, predicate, self.node()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", "}", ""):
                return

    def node(self) -> Term:
        kind, text = self.take()
        if kind == "iri":
            return iri(self.resolve(text[1:-1]))
        if kind == "bnode":
            return Term(BNODE, f"_:{self.scope}{text[2:]}")
        if kind in ("string", "long"):
            value = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "at":
                return literal(value, lang=self.take()[1][1:])
            if self.peek()[1] == "^^":
                self.take()
                return Term(2, value, self.node().lex)
            return literal(value)
        if kind == "number":
            return Term(2, text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "name":
            return literal(text == "true") if text in ("true", "false") else self.name(text)
        if text == "[":
            made = self.fresh()
            if self.peek()[1] != "]":
                self.properties(made)
            self.take("]")
            return made
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take()
            nodes = [self.fresh() for _ in items] + [iri(RDF + "nil")]
            for item, a, b in zip(items, nodes, nodes[1:], strict=False):
                self.quads += [(self.graph, a, RDF + "first", item), (self.graph, a, RDF + "rest", b)]
            return nodes[0]
        raise TurtleError(f"unexpected {text!r}")


_scopes = 0


def parse(text: str, base: str = "") -> Graph:
    """Turtle or TriG. Blank nodes of one call are never those of another."""
    global _scopes
    _scopes += 1
    reader = _Reader(text, base, f"b{_scopes}x")
    reader.document()
    return Graph(reader.quads)
