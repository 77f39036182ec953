"""Property paths as DataFrames (PATH-1 to PATH-9, JOIN-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graphs import GraphSource
from ..sources.storage import shared_root
from ..sources.terms import LITERAL, iri_term

#: Rounds of a closure; each doubles the length of the paths that it covers.
MOST_ROUNDS = 40


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and kept in the folder that spark.checkpoint.dir names; one of our own only where it is unset and
    there is one machine."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def has_zero_step(path: tuple) -> bool:
    if path[0] == "pred":
        return False
    return path[0] in ("star", "opt") or any(map(has_zero_step, path[1] if path[0] in ("seq", "alt") else (path[1],)))


def is_transitive(path: tuple) -> bool:
    if path[0] == "pred":
        return False
    return path[0] in ("star", "plus") or any(map(is_transitive, path[1] if path[0] in ("seq", "alt") else (path[1],)))


def inverse(path: tuple) -> tuple:
    """The path walked backwards, inversion pushed down to predicates."""
    kind = path[0]
    if kind == "inv":
        return path[1]
    if kind == "pred":
        return ("inv", path)
    if kind == "seq":
        return ("seq", tuple(inverse(p) for p in reversed(path[1])))
    return (kind, tuple(map(inverse, path[1]))) if kind == "alt" else (kind, inverse(path[1]))


def closure(edges: DataFrame) -> DataFrame:
    """s, t of all paths of one edge or more, by doubling; a cycle ends like anything else, when nothing is new."""
    reach = checkpointed(edges.select("s", "t").distinct())
    size = reach.count()
    for _ in range(MOST_ROUNDS):
        step = reach.select(F.col("s").alias("t"), F.col("t").alias("u"))
        longer = checkpointed(reach.union(reach.join(step, "t").select("s", F.col("u").alias("t"))).distinct())
        now = longer.count()
        reach = longer
        if now == size:
            return reach
        size = now
    raise RuntimeError("a transitive path did not settle")


def pairs(source: GraphSource, path: tuple) -> DataFrame:
    """(s, o) of a path without zero-length steps; distinct but for a single mapped predicate, which cannot repeat."""
    kind = path[0]
    if kind == "pred":
        return source.pairs(path[1])
    if kind == "inv":
        if path[1][0] != "pred":
            return pairs(source, inverse(path[1]))
        found = source.pairs(path[1][1]).where(F.col("o.kind") != LITERAL)
        return found.select(F.col("o.lex").alias("s"), iri_term(F.col("s")).alias("o"))
    if kind == "seq":
        out = pairs(source, path[1][0])
        for step in path[1][1:]:
            nxt = pairs(source, step)
            out = out.where(F.col("o.kind") != LITERAL).select(F.col("s").alias("_s"), F.col("o.lex").alias("_m")).join(nxt, F.col("_m") == F.col("s")).select(F.col("_s").alias("s"), "o")
        return out.distinct()
    if kind == "alt":
        out = pairs(source, path[1][0])
        for other in path[1][1:]:
            out = out.union(pairs(source, other))
        return out.distinct()
    if kind == "plus":
        inner = pairs(source, path[1])
        reach = closure(inner.where(F.col("o.kind") != LITERAL).select("s", F.col("o.lex").alias("t")))
        out = reach.select("s", iri_term(F.col("t")).alias("o"))
        ends = inner.where(F.col("o.kind") == LITERAL)
        # A literal can only be the last step.
        last = reach.select(F.col("s").alias("_s"), F.col("t").alias("_t")).join(ends, F.col("_t") == F.col("s")).select(F.col("_s").alias("s"), "o")
        return out.union(ends).union(last).distinct()
    raise ValueError("a zero-length step needs seeds")


def reached(source: GraphSource, seeds: DataFrame, step: tuple) -> DataFrame:
    """(root, o) of all walks of one step or more from seeds (root, at), a step at a time: only what was new in the last
    round is walked on, and nothing that no seed leads to is read twice."""
    seen, frontier = None, seeds
    while True:
        found = follow(source, frontier, step, True).select("root", "o").distinct()
        if seen is not None:
            known = seen.select(F.col("root").alias("_r"), F.col("o.kind").alias("_kind"), F.col("o.lex").alias("_lex"), F.col("o.dt").alias("_dt"), F.col("o.lang").alias("_lang"))
            found = found.join(known, (F.col("root") == F.col("_r")) & (F.col("o.kind") == F.col("_kind")) & (F.col("o.lex") == F.col("_lex")) & F.col("o.dt").eqNullSafe(F.col("_dt")) & F.col("o.lang").eqNullSafe(F.col("_lang")), "left_anti")
        found = checkpointed(found)
        if found.isEmpty():
            return found if seen is None else seen
        seen = found if seen is None else seen.union(found)
        frontier = found.where(F.col("o.kind") != LITERAL).select("root", F.col("o.lex").alias("at"))


def follow(source: GraphSource, seeds: DataFrame, path: tuple, seeded: bool = False) -> DataFrame:
    """(root, o) of a path walked from seeds (root, at); a zero-length step yields the seed itself, in the graph or
    not. seeded: seeds are few, so transitive steps start from them; else all pairs are made once by doubling."""
    kind = path[0]
    if not has_zero_step(path) and not (seeded and is_transitive(path)):
        found = pairs(source, path)
        return seeds.join(found, seeds["at"] == found["s"]).select("root", "o")
    if kind == "inv":
        return follow(source, seeds, inverse(path[1]), seeded)
    if kind == "seq":
        out = follow(source, seeds, path[1][0], seeded)
        for step in path[1][1:]:
            out = follow(source, out.where(F.col("o.kind") != LITERAL).select("root", F.col("o.lex").alias("at")).distinct(), step, seeded)
        return out.distinct()
    if kind == "alt":
        out = follow(source, seeds, path[1][0], seeded)
        for other in path[1][1:]:
            out = out.union(follow(source, seeds, other, seeded))
        return out.distinct()
    inner = path[1][1] if path[1][0] in ("star", "plus", "opt") else path[1]
    if kind == "plus" and not has_zero_step(path[1]):
        return reached(source, seeds, path[1])
    itself = seeds.select("root", iri_term(F.col("at")).alias("o"))
    if kind == "opt" and path[1][0] not in ("star", "plus"):
        return itself.union(follow(source, seeds, path[1], seeded)).distinct()
    if has_zero_step(inner):
        raise ValueError("a transitive path over zero-length steps is not supported")
    return itself.union(follow(source, seeds, ("plus", inner), seeded)).distinct()
