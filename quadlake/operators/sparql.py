"""The author's query language: group patterns and expressions, evaluated on DataFrames of solutions.

A solution's column holds a term, or null where its variable is unbound. Groups are evaluated from the solutions
that stand outside them, so scope is explicit and nothing is correlated (PAT, EXP, FN; JOIN-3 to JOIN-6, JOIN-10).
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import FUNCTIONS, Value, compare, math, pattern, replaced, total
from ..sources.graphs import GraphSource
from ..sources.terms import DECIMAL, LITERAL, TERM, TYPE, XSD, Term, constant, iri, iri_term, literal, term
from ..sources.turtle import unescape
from .paths import follow, has_zero_step, inverse, pairs

_TOKEN = re.compile(
    r'''(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<string>"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<var>[?$]\w+)|(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:ltr|rtl))?)'''
    r'''|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<name>(?:[A-Za-z][\w.-]*)?:[\w-]*|[A-Za-z_]\w*)|(?P<mark>\^\^|&&|\|\||!=|<=|>=|[][{}().;,=<>!+*/|^?-])''', re.S,
)
_AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")


class SparqlError(ValueError):
    pass


class Parser:
    """Variables are ("var", name), terms Term; the rest is tuples headed by their kind."""

    def __init__(self, text: str, prefixes: dict[str, str]):
        self.prefixes, self.tokens, at = dict(prefixes), [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def word(self, ahead: int = 0) -> str:
        return self.peek(ahead).upper()

    def take(self, text: str | None = None) -> str:
        found = self.peek()
        if not found or text is not None and found.upper() != text:
            raise SparqlError(f"expected {text or 'more'}, found {found!r}")
        self.at += 1
        return found

    def skip(self, text: str) -> bool:
        if self.word() == text:
            self.at += 1
            return True
        return False

    def resolve(self, name: str) -> Term:
        prefix, colon, local = name.partition(":")
        if not colon or prefix not in self.prefixes:
            raise SparqlError(f"unknown prefix or word {name!r}")
        return iri(self.prefixes[prefix] + local)

    def term(self) -> object:
        kind, text = self.kind(), self.take()
        if kind == "var":
            return ("var", text[1:])
        if kind == "iri":
            return iri(text[1:-1])
        if kind == "string":
            value = unescape(text[3:-3] if text.startswith('"""') else text[1:-1])
            if self.kind() == "tag":
                return literal(value, lang=self.take()[1:])
            if self.skip("^^"):
                return Term(LITERAL, value, self.term().lex)
            return literal(value)
        if kind == "number" or text in "+-" and self.kind() == "number":
            text = text if kind == "number" else text + self.take()
            return Term(LITERAL, text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if text in ("true", "false"):
            return literal(text == "true")
        if kind == "name":
            return self.resolve(text)
        raise SparqlError(f"unexpected {text!r}")

    # Paths.

    def path(self) -> tuple:
        parts = [self._sequence()]
        while self.skip("|"):
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("alt", tuple(parts))

    def _sequence(self) -> tuple:
        parts = [self._step()]
        while self.skip("/"):
            parts.append(self._step())
        return parts[0] if len(parts) == 1 else ("seq", tuple(parts))

    def _step(self) -> tuple:
        if self.skip("^"):
            return ("inv", self._step())
        if self.skip("("):
            out = self.path()
            self.take(")")
        elif self.peek() == "a":
            self.take()
            out = ("pred", TYPE)
        else:
            found = self.term()
            if not isinstance(found, Term) or not found.is_iri:
                raise SparqlError("a predicate is an IRI")
            out = ("pred", found.lex)
        for mark, name in (("*", "star"), ("+", "plus"), ("?", "opt")):
            if self.peek() == mark:
                self.take()
                return (name, out)
        return out

    # Groups.

    def group(self) -> tuple:
        self.take("{")
        out: list[tuple] = []
        if self.word() == "SELECT":
            out.append(("select", self.select()))
        while not self.skip("}"):
            word = self.word()
            if word in ("SERVICE", "GRAPH", "MINUS"):
                raise SparqlError(f"{word} is not supported")
            if word == "FILTER":
                self.take()
                out.append(("filter", self._constraint()))
            elif word == "OPTIONAL":
                self.take()
                out.append(("optional", self.group()))
            elif word == "BIND":
                self.take()
                self.take("(")
                e = self.expression()
                self.take("AS")
                out.append(("bind", e, self.term()[1]))
                self.take(")")
            elif word == "VALUES":
                out.append(self._values())
            elif word == "{":
                parts = [self.group()]
                while self.skip("UNION"):
                    parts.append(self.group())
                out.append(("union", parts) if len(parts) > 1 else ("group", parts[0]))
            elif word == ".":
                self.take()
            else:
                self._triples(out)
        return tuple(out)

    def _triples(self, out: list) -> None:
        subject = self.term()
        while True:
            verb = self.term() if self.kind() == "var" else self.path()
            while True:
                out.append(("triple", subject, verb, self.term()))
                if not self.skip(","):
                    break
            if not self.skip(";"):
                return
            while self.skip(";"):
                pass
            if self.peek() in (".", "}", ""):
                return

    def _values(self) -> tuple:
        self.take("VALUES")
        several = self.skip("(")
        names = [self.term()[1]]
        while several and not self.skip(")"):
            names.append(self.term()[1])
        self.take("{")
        rows = []
        while not self.skip("}"):
            if several:
                self.take("(")
            rows.append([None if self.skip("UNDEF") else self.term() for _ in names])
            if several:
                self.take(")")
        return ("values", names, rows)

    def select(self) -> dict:
        self.take("SELECT")
        distinct = self.skip("DISTINCT") or self.skip("REDUCED")
        items: list[tuple[str, object]] | None = []
        if self.skip("*"):
            items = None
        else:
            while self.word() not in ("WHERE", "{"):
                if self.skip("("):
                    e = self.expression()
                    self.take("AS")
                    items.append((self.term()[1], e))
                    self.take(")")
                else:
                    found = self.term()
                    items.append((found[1], found))
        self.skip("WHERE")
        out = {"distinct": distinct, "items": items, "where": self.group(), "by": [], "having": [], "order": [], "limit": None, "offset": 0}
        while self.word() in ("GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET"):
            word = self.take().upper()
            if word == "GROUP":
                self.take("BY")
                while self.kind() == "var":
                    out["by"].append(self.term()[1])
            elif word == "HAVING":
                out["having"].append(self._constraint())
            elif word == "ORDER":
                self.take("BY")
                while self.kind() == "var" or self.word() in ("ASC", "DESC"):
                    down = self.skip("DESC")
                    up = not down and self.skip("ASC")
                    out["order"].append((self._constraint() if down or up else self.term(), down))
            else:
                out[word.lower()] = int(self.take())
        return out

    def _constraint(self) -> object:
        if self.skip("("):
            out = self.expression()
            self.take(")")
            return out
        return self._primary()

    # Expressions.

    def expression(self) -> object:
        out = self._and()
        while self.skip("||"):
            out = ("or", out, self._and())
        return out

    def _and(self) -> object:
        out = self._relation()
        while self.skip("&&"):
            out = ("and", out, self._relation())
        return out

    def _relation(self) -> object:
        out = self._sum()
        if self.peek() in ("=", "!=", "<", "<=", ">", ">="):
            return ("compare", self.take(), out, self._sum())
        no = self.word() == "NOT" and self.word(1) == "IN"
        if no or self.word() == "IN":
            self.at += 1 + no
            return ("not", ("in", out, self._arguments())) if no else ("in", out, self._arguments())
        return out

    def _sum(self) -> object:
        out = self._product()
        while self.peek() in ("+", "-"):
            out = ("math", self.take(), out, self._product())
        return out

    def _product(self) -> object:
        out = self._unary()
        while self.peek() in ("*", "/"):
            out = ("math", self.take(), out, self._unary())
        return out

    def _unary(self) -> object:
        if self.skip("!"):
            return ("not", self._unary())
        if self.peek() == "-":
            self.take()
            return ("math", "-", literal(0), self._unary())
        self.skip("+")
        return self._primary()

    def _arguments(self) -> tuple:
        self.take("(")
        out = []
        while not self.skip(")"):
            out.append(self.expression())
            self.skip(",")
        return tuple(out)

    def _primary(self) -> object:
        word = self.word()
        if word == "(":
            return self._constraint()
        if word == "EXISTS" or word == "NOT" and self.word(1) == "EXISTS":
            self.at += 1 + (word == "NOT")
            found = ("exists", self.group())
            return ("not", found) if word == "NOT" else found
        if word in _AGGREGATES and self.peek(1) == "(":
            self.at += 2
            distinct = self.skip("DISTINCT")
            what = None if self.skip("*") else self.expression()
            separator = " "
            if self.skip(";"):
                self.take("SEPARATOR")
                self.take("=")
                separator = self.term().lex
            self.take(")")
            return ("aggregate", word, what, distinct, separator)
        if self.kind() == "name" and ":" not in word and self.peek(1) == "(":
            self.at += 1
            if word not in FUNCTIONS and word not in ("REGEX", "REPLACE"):
                raise SparqlError(f"unknown function {word}")
            return ("call", word, self._arguments())
        found = self.term()
        if isinstance(found, Term) and found.is_iri and self.peek() == "(":
            if found.lex not in FUNCTIONS:
                raise SparqlError(f"unknown function {found.lex}")
            return ("call", found.lex, self._arguments())
        return found

    def end(self) -> None:
        if self.peek():
            raise SparqlError(f"unexpected {self.peek()!r} at the end")


def parse_expression(text: str, prefixes: dict[str, str]) -> object:
    p = Parser(text, prefixes)
    out = p.expression()
    p.end()
    return out


def parse_node_select(text: str, prefixes: dict[str, str]) -> tuple[str, tuple]:
    """The projected variable and the body of an author's SELECT: one plain variable, nothing after the body."""
    p = Parser(text, prefixes)
    while p.word() == "PREFIX":
        p.take()
        name = p.take().rstrip(":")
        p.prefixes[name] = p.term().lex
    found = p.select()
    p.end()
    if found["distinct"] or found["items"] is None or len(found["items"]) != 1 or not isinstance(found["items"][0][1], tuple) or found["items"][0][1][0] != "var":
        raise SparqlError("a node expression selects one plain variable")
    if found["by"] or found["having"] or found["order"] or found["limit"] is not None or found["offset"]:
        raise SparqlError("nothing may follow the body of a node expression")
    if any(x[0] == "bind" and x[2] == "this" for x in found["where"]):
        raise SparqlError("$this cannot be bound again")
    return found["items"][0][0], found["where"]


def variables(node: object) -> set[str]:
    """All variables in a group or expression."""
    if isinstance(node, Term) or not isinstance(node, (tuple, list, dict)):
        return set()
    if isinstance(node, dict):
        return {n for n, _ in node["items"] or ()} | (variables(node["where"]) if node["items"] is None else set())
    if len(node) == 2 and node[0] == "var":
        return {node[1]}
    if node and node[0] == "bind":
        return variables(node[1]) | {node[2]}
    if node and node[0] == "values":
        return set(node[1])
    return set().union(*map(variables, node)) if node else set()


_numbers = count()


class Evaluator:
    """`loose` holds the variables that may be unbound in a solution; only these take more than an equi-join."""

    def __init__(self, source: GraphSource):
        self.source, self.loose = source, set()

    def _fresh(self) -> str:
        return f"_x{next(_numbers)}"

    def group(self, solutions: DataFrame, elements: tuple, carried: tuple[str, ...] = ()) -> DataFrame:
        """The solutions extended by a group. Filters hold for the whole group. `carried` columns are no variables."""
        filters = [x[1] for x in elements if x[0] == "filter"]
        for x in elements:
            if x[0] == "triple":
                solutions = self._triple(solutions, *x[1:])
            elif x[0] == "optional":
                solutions = self._optional(solutions, x[1], carried)
            elif x[0] == "bind":
                kept = solutions.columns
                solutions, value = self.value(solutions, x[1], carried)
                solutions = solutions.select(*(F.col(f"`{c}`") for c in kept if c != x[2]), value.term.alias(x[2]))
                self.loose.add(x[2])  # an error leaves it unbound
            elif x[0] == "values":
                rows = self.source.spark.createDataFrame([tuple(None if t is None else (t.kind, t.lex, t.dt, t.lang) for t in r) for r in x[2]], ", ".join(f"`{n}` struct<kind:int,lex:string,dt:string,lang:string>" for n in x[1]))
                rows = rows.select(*(F.when(F.col(n).isNotNull(), _retyped(F.col(n))).alias(n) for n in x[1]))
                solutions = self._join(solutions, rows, {n for k, n in enumerate(x[1]) if any(r[k] is None for r in x[2])})
            elif x[0] == "group":
                solutions = self.group(solutions, x[1], carried)
            elif x[0] == "union":
                before, loose, parts = set(self.loose), set(), []
                for g in x[1]:
                    self.loose = set(before)
                    parts.append(self.group(solutions, g, carried))
                    loose |= self.loose
                names = list(dict.fromkeys(n for p in parts for n in p.columns))
                self.loose = loose | {n for n in names if any(n not in p.columns for p in parts)}
                parts = [p.select(*(F.col(n) if n in p.columns else F.lit(None).cast(TERM).alias(n) for n in names)) for p in parts]
                solutions = reduce(DataFrame.unionByName, parts)
            elif x[0] == "select":
                outside, self.loose = self.loose, set()
                found = self.subselect(x[1])
                inside, self.loose = self.loose | {n for n, e in x[1]["items"] or () if e[0] != "var"}, outside
                solutions = self._join(solutions, found, inside & set(found.columns))
        for e in filters:
            kept = solutions.columns
            solutions, value = self.value(solutions, e, carried)
            solutions = solutions.where(value.truth).select(*kept)
        return solutions

    def _join(self, left: DataFrame, right: DataFrame, loose: set[str]) -> DataFrame:
        """Solutions of both that agree where both are bound; `loose` of the right may be unbound. Rows are dealt by
        which of the loose variables they bind, so that each share is an equi-join of what both have."""
        shared = [c for c in right.columns if c in left.columns]
        named = right.select(*(F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns))
        unsure = [c for c in shared if c in self.loose or c in loose]
        shares = [(left, named, [c for c in shared if c not in unsure])]
        for c in unsure:
            here, there = c in self.loose, c in loose
            split = []
            for a, b, keys in shares:
                has_a, has_b = F.col(f"`{c}`").isNotNull(), F.col(f"`_r_{c}`").isNotNull()
                split.append((a.where(has_a) if here else a, b.where(has_b) if there else b, [*keys, c]))
                if here:
                    split.append((a.where(~has_a), b, keys))
                if there:
                    split.append((a.where(has_a) if here else a, b.where(~has_b), keys))
            shares = split
        out = []
        for a, b, keys in shares:
            # Without a variable in common it is the pattern itself that asks for all pairs; Spark broadcasts the smaller side by its size.
            joined = a.join(b, reduce(Column.__and__, (F.col(f"`{c}`").eqNullSafe(F.col(f"`_r_{c}`")) for c in keys))) if keys else a.crossJoin(b)
            out.append(joined.select(*((F.coalesce(F.col(f"`{c}`"), F.col(f"`_r_{c}`")).alias(c) if c in unsure else F.col(f"`{c}`")) for c in left.columns), *(F.col(f"`{c}`") for c in right.columns if c not in shared)))
        self.loose = (self.loose - (set(shared) - loose)) | {c for c in loose if c in self.loose or c not in shared}
        return reduce(DataFrame.unionByName, out)

    def _triple(self, solutions: DataFrame, s: object, verb: object, o: object) -> DataFrame:
        mine = sorted({x[1] for x in (s, verb, o) if isinstance(x, tuple) and x[0] == "var"})
        unsure = [v for v in mine if v in solutions.columns and v in self.loose]
        if unsure:
            # Where a variable is unbound, the pattern binds it.
            v = unsure[0]
            self.loose.discard(v)
            held = self._triple(solutions.where(F.col(f"`{v}`").isNotNull()), s, verb, o)
            self.loose |= set(unsure[1:])
            free = self._triple(solutions.where(F.col(f"`{v}`").isNull()).drop(v), s, verb, o)
            return held.unionByName(free)
        bound = solutions.columns
        zero = verb[0] != "var" and has_zero_step(verb)
        if verb[0] == "var":
            found = self.source.triples().select("s", "o", F.col("p").alias("_p"))
        elif zero:
            if isinstance(s, Term):
                seeds = self.source.spark.createDataFrame([(s.lex, s.lex)], "root string, at string")
            elif s[1] in bound:
                seeds = solutions.where(F.col(f"`{s[1]}`.kind") != LITERAL).select(F.col(f"`{s[1]}`.lex").alias("root")).distinct().withColumn("at", F.col("root"))
            elif isinstance(o, Term) or o[1] in bound:
                return self._triple(solutions, o, inverse(verb), s)
            else:
                raise SparqlError("a zero-length path needs a bound end")
            found = follow(self.source, seeds, verb).select(F.col("root").alias("s"), "o")
        else:
            found = pairs(self.source, verb)
        test = []
        found = found.select(F.col("s").alias("_s"), F.col("o").alias("_o"), *(["_p"] if verb[0] == "var" else []))
        if isinstance(s, Term):
            found = found.where(F.col("_s") == s.lex)
        elif s[1] in bound:
            test.append((solutions[s[1]]["lex"] == F.col("_s")) & (solutions[s[1]]["kind"] != LITERAL))
        if isinstance(o, Term):
            found = found.where((F.col("_o.kind") == o.kind) & (F.col("_o.lex") == o.lex) & F.col("_o.dt").eqNullSafe(F.lit(o.dt)) & F.col("_o.lang").eqNullSafe(F.lit(o.lang)))
        elif o[1] in bound:
            test.append((solutions[o[1]]["lex"] == F.col("_o.lex")) & (solutions[o[1]]["kind"] == F.col("_o.kind")) & solutions[o[1]]["dt"].eqNullSafe(F.col("_o.dt")) & solutions[o[1]]["lang"].eqNullSafe(F.col("_o.lang")))
        if verb[0] == "var" and verb[1] in bound:
            test.append(solutions[verb[1]]["lex"] == F.col("_p"))
        if test:
            joined = solutions.join(found, reduce(Column.__and__, test))
        else:
            joined = solutions.crossJoin(found)
        new = {}
        if not isinstance(s, Term) and s[1] not in bound:
            new[s[1]] = iri_term(F.col("_s"))
        if verb[0] == "var" and verb[1] not in bound:
            new[verb[1]] = iri_term(F.col("_p"))
        if not isinstance(o, Term) and o[1] not in bound and o[1] not in new:
            new[o[1]] = F.col("_o")
        elif not isinstance(o, Term) and o[1] in new:
            joined = joined.where(F.col("_o.lex") == F.col("_s"))
        return joined.select(*(solutions[c] for c in bound), *(v.alias(k) for k, v in new.items()))

    def _seeds(self, solutions: DataFrame, elements: object, carried: tuple[str, ...]) -> tuple[list[str], DataFrame]:
        """The variables that a group shares with the solutions, and their distinct values, each also under _k_<name>:
        the group may bind what was unbound."""
        inside = variables(elements)
        shared = [c for c in solutions.columns if c in inside and c not in carried]
        if not shared:
            return [], self.source.spark.range(1).select(F.lit(True).alias("_unit"))
        return shared, solutions.select(*shared).distinct().select(*shared, *(F.col(f"`{c}`").alias(f"_k_{c}") for c in shared))

    def _optional(self, solutions: DataFrame, elements: tuple, carried: tuple[str, ...]) -> DataFrame:
        before = set(self.loose)
        shared, seeds = self._seeds(solutions, elements, carried)
        found = self.group(seeds, elements, ("_unit", *(f"_k_{c}" for c in shared))).drop("_unit")
        self.loose = before | {c for c in found.columns if c not in solutions.columns and not c.startswith("_k_")}
        if not shared:
            return solutions.join(found, F.lit(True), "left")
        found = found.select(*(F.col(f"`{c}`").alias(f"_r_{c}") if c in shared else F.col(f"`{c}`") for c in found.columns))
        joined = solutions.join(found, reduce(Column.__and__, (F.col(f"`{c}`").eqNullSafe(F.col(f"`_k_{c}`")) for c in shared)), "left")
        return joined.select(*(F.coalesce(F.col(f"`{c}`"), F.col(f"`_r_{c}`")).alias(c) if c in shared and c in before else F.col(f"`{c}`") for c in solutions.columns), *(F.col(f"`{c}`") for c in found.columns if not c.startswith(("_k_", "_r_"))))

    def exists(self, solutions: DataFrame, elements: tuple, carried: tuple[str, ...], name: str) -> DataFrame:
        """A column: whether the group has a solution with this row's variables."""
        before = set(self.loose)
        shared, seeds = self._seeds(solutions, elements, carried)
        found = self.group(seeds, elements, ("_unit", *(f"_k_{c}" for c in shared)))
        self.loose = before
        if not shared:
            # One row.
            there = found.limit(1).agg((F.count("*") > 0).alias(name))
            return solutions.crossJoin(F.broadcast(there))
        marked = found.select(*(F.col(f"`_k_{c}`") for c in shared)).distinct().withColumn(name, F.lit(True))
        joined = solutions.join(marked, reduce(Column.__and__, (F.col(f"`{c}`").eqNullSafe(F.col(f"`_k_{c}`")) for c in shared)), "left")
        return joined.select(*(F.col(f"`{c}`") for c in solutions.columns), F.coalesce(F.col(name), F.lit(False)).alias(name))

    def value(self, solutions: DataFrame, e: object, carried: tuple[str, ...] = ()) -> tuple[DataFrame, Value]:
        """An expression's value; existence tests in it become columns of the solutions first."""
        marks: dict[int, str] = {}

        def mark(node: object) -> None:
            nonlocal solutions
            if isinstance(node, Term) or not isinstance(node, tuple):
                return
            if node and node[0] == "exists":
                marks[id(node)] = self._fresh()
                solutions = self.exists(solutions, node[1], (*carried, *marks.values()), marks[id(node)])
                return
            for x in node:
                mark(x)

        mark(e)

        def flat(node: object, top: bool) -> object:
            """Parts that are computed become columns: what reads one often does not repeat its computation."""
            nonlocal solutions
            if isinstance(node, Term) or not isinstance(node, tuple) or node and node[0] in ("var", "column", "exists", "aggregate"):
                return node
            node = tuple(flat(x, False) for x in node)
            if top or not node or node[0] not in ("math", "call", "compare"):
                return node
            found, name = self._compile(node, solutions.columns, marks), self._fresh()
            solutions = solutions.withColumn(name, found.col)
            return ("column", found.kind, name)

        e = flat(e, True)
        return solutions, self._compile(e, solutions.columns, marks)

    def _compile(self, e: object, bound: list[str], marks: dict[int, str]) -> Value:
        go = lambda x: self._compile(x, bound, marks)
        if isinstance(e, Term):
            if e.kind == LITERAL and e.dt == XSD + "string":
                return Value("str", F.lit(e.lex))
            if e.dt == XSD + "integer":
                return Value("int", F.lit(int(e.lex)).cast("bigint"))
            if e.dt == XSD + "decimal":
                return Value("dec", F.lit(e.lex).try_cast(DECIMAL))
            if e.dt == XSD + "boolean":
                return Value("bool", F.lit(e.lex in ("true", "1")))
            return Value("term", constant(e))
        head = e[0]
        if head == "var":
            return Value("term", F.col(f"`{e[1]}`") if e[1] in bound else F.lit(None).cast(TERM))
        if head == "column":
            return Value(e[1], F.col(e[2]))
        if head == "exists":
            return Value("bool", F.col(marks[id(e)]))
        if head in ("and", "or"):
            a, b = go(e[1]).truth, go(e[2]).truth
            return Value("bool", a & b if head == "and" else a | b)
        if head == "not":
            return Value("bool", ~go(e[1]).truth)
        if head == "compare":
            return Value("bool", compare(e[1], go(e[2]), go(e[3])))
        if head == "in":
            left = go(e[1])
            return Value("bool", reduce(Column.__or__, (compare("=", left, go(x)) for x in e[2])) if e[2] else F.lit(False))
        if head == "math":
            return math(e[1], go(e[2]), go(e[3]))
        if head == "call":
            if e[1] in ("REGEX", "REPLACE"):
                if not all(isinstance(x, Term) for x in e[2][1:]):
                    raise SparqlError("patterns, replacements and flags are constants")
                given = [x.lex for x in e[2][1:]]
                if e[1] == "REGEX":
                    return Value("bool", go(e[2][0]).string.rlike(pattern(given[0], given[1] if len(given) > 1 else "")))
                return replaced(go(e[2][0]), pattern(given[0], given[2] if len(given) > 2 else ""), given[1])
            return FUNCTIONS[e[1]](*map(go, e[2]))
        raise SparqlError(f"{head} has no place here")

    def subselect(self, query: dict) -> DataFrame:
        """A nested SELECT, with its own scope."""
        start = self.source.spark.range(1).select(F.lit(True).alias("_unit"))
        rows = self.group(start, query["where"], ("_unit",)).drop("_unit")
        items = query["items"] if query["items"] is not None else [(c, ("var", c)) for c in rows.columns]
        found: list[tuple] = []

        def aggregates(node: object) -> object:
            if isinstance(node, Term) or not isinstance(node, tuple):
                return node
            if node and node[0] == "aggregate":
                found.append(node)
                return ("column", "int" if node[1] == "COUNT" else "str" if node[1] == "GROUP_CONCAT" else "term", f"_a{len(found) - 1}")
            return tuple(map(aggregates, node))

        items = [(n, aggregates(e)) for n, e in items]
        having, order = [aggregates(e) for e in query["having"]], [(aggregates(e), down) for e, down in query["order"]]
        if found or query["by"]:
            columns, plain = [], rows.columns
            for k, (_, name, what, distinct, separator) in enumerate(found):
                value = None
                if what is not None:
                    rows, value = self.value(rows, what)
                    rows = rows.select(*rows.columns, value.col.alias(f"_v{k}"))
                    value = Value(value.kind, F.col(f"_v{k}"))
                if name == "COUNT":
                    made = F.count("*") if value is None and not distinct else F.count_distinct(*(F.col(c) for c in plain)) if value is None else F.count_distinct(value.term) if distinct else F.count(value.term)
                elif name in ("MIN", "MAX"):
                    made = (F.min_by if name == "MIN" else F.max_by)(value.term, F.struct(value.term["num"], value.term["ts"], value.term["lex"]))
                elif name == "SAMPLE":
                    made = F.min_by(value.term, value.term["lex"])
                elif name == "GROUP_CONCAT":
                    made = F.array_join(F.array_sort((F.collect_set if distinct else F.collect_list)(value.text)), separator)
                else:
                    made = total(value, name == "AVG", distinct)
                columns.append(made.alias(f"_a{k}"))
            rows = rows.groupBy(*query["by"]).agg(*columns) if columns else rows.select(*query["by"]).distinct()
        for e in having:
            rows, value = self.value(rows, e)
            rows = rows.where(value.truth)
        if order:
            keys = []
            for e, down in order:
                rows, v = self.value(rows, e)
                v = v.term
                keys += [c.desc() if down else c.asc() for c in (v["num"], v["ts"], v["lex"])]
            rows = rows.orderBy(*keys)
        out = []
        for n, e in items:
            rows, v = self.value(rows, e)
            out.append(v.term.alias(n))
        out = rows.select(*out)
        if query["distinct"]:
            out = out.distinct()
        if query["offset"]:
            out = out.offset(query["offset"])
        return out if query["limit"] is None else out.limit(query["limit"])


def _retyped(c: Column) -> Column:
    return term(c["kind"], c["lex"], c["dt"], c["lang"])
