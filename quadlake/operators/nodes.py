"""Node expressions, filter shapes and class trees (NX, FS, TGT)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import Value, compare, pattern
from ..plans.shapes import Const, Exists, FilterNodes, If, Instances, PathValues, Sparql
from ..sources.graphs import GraphSource
from ..sources.terms import LITERAL, SUBCLASS, Term, constant, iri_term
from .paths import follow, has_zero_step, pairs
from .sparql import Evaluator, parse_expression, parse_node_select


def subclasses(source: GraphSource, classes: list[str]) -> list[str]:
    """The classes and all below them. A class tree is schema: it is small, and read level by level to the driver."""
    seen, last = dict.fromkeys(classes), list(classes)
    edges = source.pairs(SUBCLASS)
    while last:
        rows = edges.where(F.col("o.lex").isin(*last)).select("s").distinct().collect()
        last = [r[0] for r in rows if r[0] not in seen]
        seen |= dict.fromkeys(last)
    return list(seen)


class Nodes:
    def __init__(self, source: GraphSource):
        self.source, self.sparql = source, Evaluator(source)

    def one(self, value: str) -> DataFrame:
        return self.source.spark.range(1).select(F.lit(value).alias("s"))

    def values(self, seeds: DataFrame, e: object) -> DataFrame:
        """(s, o): the values of an expression at each seed s; of paths perhaps at others too."""
        if isinstance(e, Const):
            return seeds.select("s", F.explode(F.array(*map(constant, e.terms))).alias("o"))
        if isinstance(e, Sparql):
            start = seeds.select(F.col("s").alias("_key"), iri_term(F.col("s")).alias("this"))
            if e.select:
                name, body = parse_node_select(e.text, dict(e.prefixes))
                found = self.sparql.group(start, body, ("_key",))
                return found.where(F.col(f"`{name}`").isNotNull()).select(F.col("_key").alias("s"), F.col(f"`{name}`").alias("o")).distinct()
            found, value = self.sparql.value(start, parse_expression(e.text, dict(e.prefixes)), ("_key",))
            return found.select(F.col("_key").alias("s"), value.term.alias("o")).where("o is not null")
        if isinstance(e, PathValues):
            if e.focus is not None:
                start = self.one(e.focus.lex).select(F.col("s").alias("root"), F.col("s").alias("at"))
                # Every seed has all of these; Spark broadcasts them if they are few.
                return seeds.crossJoin(follow(self.source, start, e.path, True).select("o").distinct())
            if has_zero_step(e.path):
                return follow(self.source, seeds.select(F.col("s").alias("root"), F.col("s").alias("at")), e.path).select(F.col("root").alias("s"), "o")
            return pairs(self.source, e.path)
        if isinstance(e, FilterNodes):
            return self.filtered(self.values(seeds, e.nodes), e.conjuncts)
        if isinstance(e, Exists):
            there = self.values(seeds, e.nodes).select("s").distinct().withColumn("_there", F.lit(True))
            return seeds.join(there, "s", "left").select("s", Value("bool", F.coalesce("_there", F.lit(False))).term.alias("o"))
        if isinstance(e, If):
            test = self.values(seeds, e.test).where((F.col("o.lex").isin("true", "1")) & F.col("o.dt").endswith("#boolean")).select("s").distinct()
            arms = []
            if e.then is not None:
                yes = seeds.join(test, "s", "left_semi")
                arms.append(self.values(yes, e.then).join(yes, "s", "left_semi"))
            if e.other is not None:
                no = seeds.join(test, "s", "left_anti")
                arms.append(self.values(no, e.other).join(no, "s", "left_semi"))
            return reduce(DataFrame.union, arms).select("s", "o")
        if isinstance(e, Instances):
            found = self.source.instances(subclasses(self.source, list(e.classes))).select(iri_term(F.col("s")).alias("o"))
            return seeds.crossJoin(found)
        raise TypeError(e)

    def members(self, e: object, focus: str) -> DataFrame:
        """s: the distinct nodes of a target expression, its shape as focus."""
        if isinstance(e, Instances):
            return self.source.instances(subclasses(self.source, list(e.classes)))
        if isinstance(e, FilterNodes) and isinstance(e.nodes, Instances):
            found = self.members(e.nodes, focus).select(F.lit(focus).alias("s"), iri_term(F.col("s")).alias("o"))
            return self.filtered(found, e.conjuncts).select(F.col("o.lex").alias("s")).distinct()
        found = self.values(self.one(focus), e)
        return found.where((F.col("s") == focus) & (F.col("o.kind") != LITERAL)).select(F.col("o.lex").alias("s")).distinct()

    def filtered(self, rows: DataFrame, conjuncts: tuple) -> DataFrame:
        """The rows (s, o) whose o fulfils all conjuncts."""
        for c in conjuncts:
            if c[0] == "value":
                rows = rows.where(same(F.col("o"), c[1]))
            elif c[0] == "datatype":
                rows = rows.where(F.col("o.dt") == c[1])
            elif c[0] == "pattern":
                rows = rows.where(F.col("o.lex").rlike(pattern(c[1], c[2])))
            elif c[0] == "bound":
                rows = rows.where(compare(c[1], Value("term", F.col("o")), Value("term", constant(c[2]))))
            elif c[0] in ("class", "root"):
                classes = list(c[1]) if c[0] == "class" else subclasses(self.source, [c[1]])
                if not classes:
                    return rows.where(F.lit(False))
                ok = self.source.instances(classes).select(F.col("s").alias("_ok"))
                rows = rows.join(ok, (F.col("o.lex") == F.col("_ok")) & (F.col("o.kind") != LITERAL), "left_semi")
            elif c[0] == "property":
                at = rows.where(F.col("o.kind") != LITERAL).select(F.col("o.lex").alias("at")).distinct()
                found = follow(self.source, at.select(F.col("at").alias("root"), "at"), c[1]).select(F.col("root").alias("s"), "o")
                ok = self.filtered(found, c[2]).select(F.col("s").alias("_ok"))
                rows = rows.join(ok, (F.col("o.lex") == F.col("_ok")) & (F.col("o.kind") != LITERAL), "left_semi")
        return rows


def same(c: Column, t: Term) -> Column:
    return (c["kind"] == t.kind) & (c["lex"] == t.lex) & c["dt"].eqNullSafe(F.lit(t.dt)) & c["lang"].eqNullSafe(F.lit(t.lang))
