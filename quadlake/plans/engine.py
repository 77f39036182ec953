"""From an operation to DataFrames: entities, filters, pages, fields, nested results (PRJ, FLT, LNG, AGG, ORD)."""

from __future__ import annotations

from contextlib import redirect_stdout
from dataclasses import dataclass
from functools import reduce
from io import StringIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.nodes import Nodes
from ..operators.paths import follow, has_zero_step, is_transitive, pairs
from ..sources.graphs import GraphSource, MappedSource
from ..sources.terms import DECIMAL, LITERAL, ORDERED, TEMPORAL, XSD, constant, order_key
from .graphql import OperationError, Selected, parse_operation, sdl
from .shapes import OPERATORS, Const, Field, Registry, Shape, keeps_rows


#: Entities of a page whose keys are broadcast; larger pages join their fields by shuffle.
PAGE_KEYS = 100_000
#: Integers from here on are not told apart as doubles.
EXACT = 1 << 53


@dataclass(frozen=True)
class Within:
    """The entities (s) that fields are wanted of; small: there are PAGE_KEYS at most."""

    keys: DataFrame
    small: bool

    def of(self, rows: DataFrame, column: str = "s") -> DataFrame:
        keys = self.keys.select(F.col("s").alias("_within"))
        return rows.join(F.broadcast(keys) if self.small else keys, F.col(column) == F.col("_within"), "left_semi")


@dataclass(frozen=True)
class Context:
    """What a request sets: the language chain, and the named graphs that make its default graph."""

    lang_tags: tuple[str, ...] = ()
    read_graphs: tuple[str, ...] = ()
    write_graph: str | None = None


class Engine:
    def __init__(self, registry: Registry, source: GraphSource, strict: bool = False):
        """strict: a value outside its enum, or a null in a required derived field, is an error when met."""
        self.registry, self.source, self.strict = registry, source, strict

    def sdl(self) -> str:
        return sdl(self.registry)

    def execute(self, operation: str, variables: dict | None = None, context: Context = Context(), name: str | None = None) -> dict[str, DataFrame]:
        """A DataFrame for each root selection, under its response name."""
        if context.write_graph is not None:
            raise NotImplementedError("graphs are read, not written")
        source = self.source.scoped(tuple(context.read_graphs)) if context.read_graphs else self.source
        out = {}
        for root in parse_operation(operation, variables, name):
            if root.name not in self.registry.roots:
                raise OperationError(f"unknown root field {root.name}")
            if more := set(root.args) - {"where", "limit", "offset"}:
                raise OperationError(f"unknown argument {', '.join(sorted(more))} of {root.name}")
            if not root.selection:
                raise OperationError(f"{root.name} needs a selection")
            out[root.alias] = Planner(self, source, tuple(t.lower() for t in context.lang_tags)).root(self.registry.roots[root.name], root)
        return out

    def json(self, operation: str, variables: dict | None = None, context: Context = Context(), name: str | None = None) -> dict[str, DataFrame]:
        """As execute, each entity as one JSON string."""
        return {k: df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json")) for k, df in self.execute(operation, variables, context, name).items()}

    def explain(self, operation: str, variables: dict | None = None, context: Context = Context(), name: str | None = None, mode: str = "formatted") -> dict[str, str]:
        """As execute, the text of each plan; nothing but closures and class trees is run."""
        out = {}
        for k, df in self.execute(operation, variables, context, name).items():
            with redirect_stdout(StringIO()) as text:
                df.explain(mode)
            out[k] = text.getvalue()
        return out


class Planner:
    def __init__(self, engine: Engine, source: GraphSource, chain: tuple[str, ...]):
        self.engine, self.registry, self.source, self.chain = engine, engine.registry, source, chain
        self.nodes = Nodes(source)

    # Entities.

    def root(self, shape: Shape, selected: Selected) -> DataFrame:
        where, limit, offset = (selected.args.get(k) for k in ("where", "limit", "offset"))
        for k, v in (("limit", limit), ("offset", offset)):
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
                raise OperationError(f"{k} is no count: {v!r}")
        if where is not None and not isinstance(where, dict):
            raise OperationError("where is an object")
        paged = limit is not None or offset is not None
        base, narrowed, promoted = self.filtered(shape, where or {}, {s.name for s in selected.selection}, None)
        if paged:
            # Whole entities are paged, by IRI; fields join the page later and are not narrowed.
            base = base.orderBy("s")
            if offset:
                base = base.offset(offset)
            if limit is not None:
                base = base.limit(limit)
            narrowed = {}
        # What is listed is listed for the page's or the filter's entities alone.
        within = Within(base.select("s"), limit is not None and limit <= PAGE_KEYS) if paged or self.normal(shape, where or {}) != ("true",) else None
        return self.fields(shape, base, selected.selection, narrowed, promoted, {} if paged else where or {}, within).drop("s")

    def entities(self, shape: Shape, names: set[str], keys: DataFrame | None, promoted: set[str], parent: str | None = None) -> tuple[DataFrame, set[str]]:
        """s and a column for each of the named fields that one table row holds; the names of these. With `parent`, a
        predicate of that row, also what it leads to: _parent."""
        if keys is None and shape.target_class and isinstance(self.source, MappedSource):
            fused = self.source.row(shape.target_class, {n: f.path[1] for n in names if (f := shape.fields.get(n)) and f.derived is None and f.path[0] == "pred"}, {n for n in promoted if shape.fields[n].default is None}, parent)
            if fused is not None:
                base, covered = fused
                for n in sorted(covered):
                    base = base.withColumn(f"f_{n}", self.resolved(shape.fields[n], F.col(f"f_{n}")))
                return base, covered
        if keys is not None:
            return keys, set()
        if shape.target_class:
            return self.source.instances([shape.target_class]), set()
        if shape.target is None:
            raise OperationError(f"{shape.name} has no target")
        return self.nodes.members(shape.target, shape.iri), set()

    # Values.

    def steps(self, f: Field) -> list[str] | None:
        if not self.chain or f.space == "plain" or f.kind != "scalar":
            return None
        return [*self.chain, *([""] if f.space == "union" and "" not in self.chain else [])]

    def rank(self, f: Field, o: Column) -> Column:
        """The first step of the chain that a literal matches; null if none does."""
        lang = F.lower(F.coalesce(o["lang"], F.lit("")))
        tests = []
        for k, step in enumerate(self.steps(f) or ()):
            ok = lang == "" if step == "" else lang != "" if step == "*" else (lang == step.lower()) | lang.startswith(step.lower() + "-")
            tests.append(F.when(ok & (o["kind"] == LITERAL), F.lit(k)))
        return F.coalesce(*tests)

    def resolved(self, f: Field, o: Column) -> Column:
        """The value of a field that has one at most."""
        if self.steps(f) is not None:
            o = F.when(self.rank(f, o).isNotNull(), o)
        if f.default is not None and getattr(f.default, "terms", None):
            o = F.coalesce(o, constant(f.default.terms[0]))
        return o

    def values(self, shape: Shape, f: Field, base: DataFrame, within: Within | None = None) -> DataFrame:
        """(s, o) of a field: one row at most for each s if it is a scalar; with its default, one for each. Of the
        entities within alone, if these are given."""
        seeds = base.select("s")
        single = False
        if f.derived is not None:
            rows = self.nodes.values(seeds, f.derived)
        elif has_zero_step(f.path) or within is not None and is_transitive(f.path):
            rows = follow(self.source, seeds.select(F.col("s").alias("root"), F.col("s").alias("at")), f.path, within is not None).select(F.col("root").alias("s"), "o")
        else:
            rows = pairs(self.source, f.path)
            single = f.path[0] == "pred" and isinstance(self.source, MappedSource) and self.source.functional(f.path[1])
        if within is not None:
            rows = within.of(rows)
        if f.kind == "relationship":
            return rows.where(F.col("o.kind") != LITERAL)
        steps = self.steps(f)
        if steps is not None:
            rows = rows.withColumn("_rank", self.rank(f, F.col("o"))).where("_rank is not null")
        if not f.listed:
            if not single:
                best = F.struct(*(["_rank"] if steps is not None else []), "o.num", "o.ts", "o.lex", "o.lang")
                rows = rows.groupBy("s").agg(F.min_by("o", best).alias("o"))
            if f.default is not None:
                default = self.nodes.values(seeds, f.default).select("s", F.col("o").alias("_default"))
                rows = default.join(rows.select("s", "o"), "s", "full_outer").select("s", F.coalesce("o", "_default").alias("o"))
        return rows.select("s", "o")

    # Filters.

    def normal(self, shape: Shape, where: dict) -> tuple:
        """where as a tree; what says nothing is ("true",)."""
        parts = []
        for key, value in where.items():
            if key in ("AND", "OR"):
                if value is None:
                    continue
                inner = [self.normal(shape, x) for x in (value if isinstance(value, list) else [value]) if x is not None]
                inner = [x for x in inner if x != ("true",)]
                if inner:
                    parts.append((key.lower(), tuple(inner)))
            elif key == "NOT":
                if value is not None and (inner := self.normal(shape, value)) != ("true",):
                    parts.append(("not", inner))
            elif key == "iri":
                parts += [("op", None, op, x) for op, x in (value or {}).items() if self._says(op, x, "Iri")]
            else:
                f = shape.fields.get(key)
                if f is None:
                    raise OperationError(f"{shape.name} has no field {key}")
                if value is None:
                    continue
                if not isinstance(value, dict):
                    raise OperationError(f"the filter of {key} is an object")
                if f.kind == "relationship":
                    if value:
                        self.normal(self.registry.target_of(f), value)
                        parts.append(("rel", key, value))
                else:
                    parts += [("op", key, op, x) for op, x in value.items() if self._says(op, x, f.filter_kind)]
        return ("true",) if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))

    @staticmethod
    def _says(op: str, value: object, kind: str) -> bool:
        if op not in OPERATORS[kind]:
            raise OperationError(f"{op} is no operator of {kind}")
        if isinstance(value, list):
            value = [x for x in value if x is not None]
        return value is not None and not (op in ("in", "notIn") and value == [])

    def named(self, shape: Shape, where: dict) -> set[str]:
        """Fields named at this level, through AND, OR and NOT, even with nothing to say."""
        out = set()
        for key, value in where.items():
            if key in ("AND", "OR", "NOT"):
                for x in value if isinstance(value, list) else [value]:
                    out |= self.named(shape, x or {})
            elif key != "iri":
                if key not in shape.fields:
                    raise OperationError(f"{shape.name} has no field {key}")
                out.add(key)
        return out

    def filtered(self, shape: Shape, where: dict, wanted: set[str], keys: DataFrame | None, parent: str | None = None) -> tuple[DataFrame, dict[str, DataFrame], set[str]]:
        """The entities that a filter leaves (with the wanted fields that their own row holds); values of filtered
        fields in the rows that passed; the promoted fields."""
        tree, promoted = self.normal(shape, where), self.named(shape, where)
        base, covered = self.entities(shape, wanted | promoted, keys, promoted, parent)
        for n in sorted(promoted & covered):
            base = base.where(F.col(f"f_{n}").isNotNull())
        factors = list(tree[1]) if tree[0] == "and" else [] if tree == ("true",) else [tree]
        groups: list[tuple[set[str], list[tuple]]] = [({n}, []) for n in sorted(promoted - covered)]
        own: list[tuple] = []
        for factor in factors:
            used = _fields(factor) - covered
            if not used:
                own.append(factor)
                continue
            names, tests = set(used), [factor]
            for g in [g for g in groups if g[0] & used]:
                groups.remove(g)
                names |= g[0]
                tests = g[1] + tests
            groups.append((names, tests))
        base = self._tested(shape, base, own)
        narrowed: dict[str, DataFrame] = {}
        passed = []
        for names, tests in groups:
            # Fields that no test ties together are filtered apart, so their values never multiply; and from their own
            # pairs, so that each is one scan, whatever the others are.
            rows = self._tested(shape, self._together(shape, base, names, tests, covered), tests)
            for n in names:
                narrowed[n] = rows.select("s", F.col(f"f_{n}").alias("o")).where("o is not null").distinct()
            passed.append(rows.select(F.col("s").alias("_passed")))
        for rows in passed:
            base = base.join(rows, F.col("s") == F.col("_passed"), "left_semi")
        return base, narrowed, promoted

    def _together(self, shape: Shape, base: DataFrame, names: set[str], tests: list[tuple], covered: set[str]) -> DataFrame:
        """s and a column for each of the fields; with the entities' own columns where a test reads these, or where an
        entity may lack a value."""
        loose = {n for n in names if _loose(shape.fields[n])}
        rows = base if loose or any(_fields(t) & covered for t in tests) else None
        for n in sorted(names, key=lambda n: (n in loose, n)):
            found = self.values(shape, shape.fields[n], base).select("s", F.col("o").alias(f"f_{n}"))
            rows = found if rows is None else rows.join(found, "s", "left" if n in loose else "inner")
        return rows

    def _tested(self, shape: Shape, rows: DataFrame, tests: list[tuple]) -> DataFrame:
        """The rows that pass; a test of a relationship alone is a semi-join, one under OR or NOT a marker."""
        kept = rows.columns
        for test in tests:
            if test[0] == "rel":
                ok = self.children(shape.fields[test[1]], test[2], rows.select(F.col(f"f_{test[1]}.lex").alias("s")))
                if ok is not None:
                    rows = rows.join(ok.select(F.col("s").alias("_ok")), F.col(f"f_{test[1]}.lex") == F.col("_ok"), "left_semi")
                continue
            marks: list[tuple[tuple, str]] = []

            def mark(t: tuple) -> None:
                nonlocal rows
                if t[0] == "rel":
                    ok = self.children(shape.fields[t[1]], t[2], rows.select(F.col(f"f_{t[1]}.lex").alias("s")))
                    name = f"_m{len(marks)}"
                    if ok is None:
                        rows = rows.withColumn(name, F.lit(True))
                    else:
                        rows = rows.join(ok.select(F.col("s").alias(f"{name}_ok")).withColumn(name, F.lit(True)), F.col(f"f_{t[1]}.lex") == F.col(f"{name}_ok"), "left").withColumn(name, F.coalesce(name, F.lit(False)))
                    marks.append((t, name))
                elif t[0] in ("and", "or"):
                    for x in t[1]:
                        mark(x)
                elif t[0] == "not":
                    mark(t[1])

            mark(test)
            rows = rows.where(self._test(shape, test, marks)).select(*kept)
        return rows

    def children(self, f: Field, where: dict, targets: DataFrame) -> DataFrame | None:
        """s, distinct: the targets of a relationship that a nested filter admits; None if it admits all."""
        target = self.registry.target_of(f)
        anchored = f.target_class is not None
        if not anchored and not self.named(target, where) and self.normal(target, where) == ("true",):
            return None
        shape = target
        if anchored and shape.target_class != f.target_class:
            keys = self.source.instances([f.target_class])
        elif anchored:
            keys = None
        else:
            keys = targets.where("s is not null").distinct()
        base, _, _ = self.filtered(shape, where, set(), keys)
        return base.select("s").distinct()

    def _test(self, shape: Shape, test: tuple, marks: list[tuple[tuple, str]]) -> Column:
        if test[0] in ("and", "or"):
            return reduce(Column.__and__ if test[0] == "and" else Column.__or__, (self._test(shape, x, marks) for x in test[1]))
        if test[0] == "not":
            return ~self._test(shape, test[1], marks)
        if test[0] == "rel":
            k = next(i for i, (t, _) in enumerate(marks) if t is test)
            return F.col(marks[k][1])
        _, name, op, value = test
        if name is None:
            return self._iri_test(shape, op, value)
        f, o = shape.fields[name], F.col(f"f_{name}")
        if f.kind == "enum":
            names = f.enum_names()
            lookup = lambda x: _enum(names, x, f)
            return operate(op, o["lex"], [lookup(x) for x in value] if isinstance(value, list) else lookup(value))
        kind = f.filter_kind
        if kind in ("Int", "Float"):
            given = [x for x in value if x is not None] if isinstance(value, list) else [value]
            for x in given:
                if isinstance(x, bool) or not isinstance(x, (int, float)):
                    _bad(x, f)
            # Decimals and large integers compare by all their digits.
            if f.datatypes and f.datatypes[0] == XSD + "decimal" or any(isinstance(x, int) and abs(x) >= EXACT for x in given):
                number, to = o["lex"].try_cast(DECIMAL), lambda x: F.lit(str(x)).try_cast(DECIMAL)
            else:
                number, to = o["num"], lambda x: F.lit(float(x))
            return operate(op, number, list(map(to, given)) if isinstance(value, list) else to(value))
        if kind == "Boolean":
            if not isinstance(value, bool):
                _bad(value, f)
            return operate(op, o["lex"].isin("true", "1"), F.lit(value))
        if kind == "DateTime" and f.datatypes and f.datatypes[0] in TEMPORAL:
            to = lambda x: F.lit(str(x)).try_cast("timestamp")
            return operate(op, o["ts"], [to(x) for x in value if x is not None] if isinstance(value, list) else to(value))
        if f.datatypes and f.datatypes[0] in ORDERED and op in ("eq", "neq", "gt", "gte", "lt", "lte", "in", "notIn"):
            to = lambda x: order_key(F.lit(str(x)), F.lit(f.datatypes[0]))
            return operate(op, order_key(o["lex"], o["dt"]), [to(x) for x in value if x is not None] if isinstance(value, list) else to(value))
        return operate(op, o["lex"], value)

    def _iri_test(self, shape: Shape, op: str, value: object) -> Column:
        """A test of an entity's IRI; IRIs of mapped rows are tested by the columns that they are made from, so that the
        test reaches the scan."""
        if op in ("eq", "in") and isinstance(self.source, MappedSource) and shape.target_class:
            found = self.source.by_keys(shape.target_class, [x for x in value if x is not None] if op == "in" else [value])
            if found is not None:
                return found
        return operate(op, F.col("s"), value)

    # Fields.

    def fields(self, shape: Shape, base: DataFrame, selection: tuple[Selected, ...], narrowed: dict[str, DataFrame], promoted: set[str], where: dict, within: Within | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
        """s, the carried columns and a column for each selection. A required or promoted field without a value drops
        its entity."""
        covered = {c[2:] for c in base.columns if c.startswith("f_")}
        out, columns = base, []
        for k, sel in enumerate(selection):
            name = f"o_{k}"
            if sel.name == "__typename":
                columns.append(F.lit(shape.name).alias(sel.alias))
                continue
            if sel.name == "iri":
                columns.append(F.col("s").alias(sel.alias))
                continue
            f = shape.fields.get(sel.name)
            if f is None:
                raise OperationError(f"{shape.name} has no field {sel.name}")
            if (f.kind == "relationship") != bool(sel.selection):
                raise OperationError(f"{sel.name} {'needs' if f.kind == 'relationship' else 'takes no'} selection")
            if sel.args:
                raise OperationError(f"{sel.name} takes no arguments")
            bound = f.required or sel.name in promoted
            loose = _loose(f)
            how = "inner" if bound and not loose else "left"
            if sel.name in covered and f.kind != "relationship":
                value = self.output(shape, f, F.col(f"f_{sel.name}"))
                if how == "inner":
                    out = out.where(F.col(f"f_{sel.name}").isNotNull())
                columns.append((F.when(value.isNull(), F.array()).otherwise(F.array(value)) if f.listed else value).alias(sel.alias))
                continue
            if f.kind == "relationship":
                out = self.relationship(shape, f, sel, out, narrowed, how, name, covered, where, within)
            else:
                rows = narrowed.get(sel.name)
                if rows is None:
                    rows = self.values(shape, f, base, within)
                value = self.output(shape, f, F.col("o"))
                if f.listed:
                    rows = rows.groupBy("s").agg(F.array_sort(F.collect_set(value)).alias(name))
                elif sel.name in narrowed:
                    rows = rows.groupBy("s").agg(F.min_by(value, F.struct("o.num", "o.ts", "o.lex")).alias(name))
                else:
                    rows = rows.select("s", value.alias(name))
                out = out.join(rows, "s", how)
            value = F.coalesce(F.col(name), F.array()) if f.listed else F.col(name)
            if loose and f.required and not f.listed and self.engine.strict:
                value = F.coalesce(value, F.raise_error(F.concat(F.lit(f"{shape.name}.{f.name} is required and has no value: "), F.col("s"))).cast(out.schema[name].dataType))
            columns.append(value.alias(sel.alias))
        return out.select("s", *carried, *columns)

    def relationship(self, shape: Shape, f: Field, sel: Selected, out: DataFrame, narrowed: dict[str, DataFrame], how: str, name: str, covered: set[str], where: dict, within: Within | None) -> DataFrame:
        target = self.registry.target_of(f)
        inner = self._conjunct(where, f.name)
        # Without paging, a nested relationship's filter also narrows the nested selection.
        nested = {k: v for k, v in inner.items() if k in target.fields and target.fields[k].kind == "relationship" and v and any(s.name == k for s in sel.selection)}
        wanted = {s.name for s in sel.selection}
        own = f.target_class is not None and target.target_class == f.target_class
        if own and f.name not in covered and f.name not in narrowed and f.derived is None and f.path[0] == "inv" and f.path[1][0] == "pred" and isinstance(self.source, MappedSource) and self.source.holds(f.target_class, f.path[1][1]):
            # The row of the child holds the link: no other rows are read for it.
            base, inside, promoted = self.filtered(target, nested, wanted, None, f.path[1][1])
            if within is not None:
                base = within.of(base, "_parent")
            child = self.fields(target, base, sel.selection, inside, promoted, nested, Within(base.select("s"), False) if within or nested else None, ("_parent",))
            made = child.select("_parent", F.col("s").alias("_c"), F.struct(*(child[c] for c in child.columns if c not in ("s", "_parent"))).alias("_v"))
            return self._listed(f, out, made.select(F.col("_parent").alias("s"), "_c", "_v"), how, name)
        links = None
        if f.name not in covered:
            links = narrowed.get(f.name)
            if links is None:
                links = self.values(shape, f, out, within)
            links = links.select("s", F.col("o.lex").alias("_child")).distinct()
        targets = (out.select(F.col(f"f_{f.name}.lex").alias("s")).where("s is not null") if links is None else links.select(F.col("_child").alias("s"))).distinct()
        keys = None
        if not own:
            keys = targets if f.target_class is None else targets.join(self.source.instances([f.target_class]), "s", "left_semi")
        base, inside, promoted = self.filtered(target, nested, wanted, keys)
        below = None
        # What a filter narrowed is restricted by it already.
        if within is not None and f.name not in narrowed:
            below = Within(targets, within.small and links is None)
            base = below.of(base) if own else base
        child = self.fields(target, base, sel.selection, inside, promoted, nested, below)
        # A child is whole before it joins: one that lacks a required field is no child.
        made = child.select(F.col("s").alias("_c"), F.struct(*(child[c] for c in child.columns if c != "s")).alias("_v"))
        if links is None:
            joined = out.join(made, F.col(f"f_{f.name}.lex") == F.col("_c"), how)
            value = F.when(F.col("_c").isNotNull(), F.array("_v")) if f.listed else F.col("_v")
            return joined.withColumn(name, value).drop("_c", "_v")
        return self._listed(f, out, links.join(made, F.col("_child") == F.col("_c")).select("s", "_c", "_v"), how, name)

    @staticmethod
    def _listed(f: Field, out: DataFrame, rows: DataFrame, how: str, name: str) -> DataFrame:
        """Children (_c, _v) of each s, in order of their IRIs, or the first."""
        if not f.listed:
            value = F.min_by("_v", "_c")
        elif _sortable(rows):
            value = F.transform(F.sort_array(F.collect_list(F.struct("_c", "_v"))), lambda x: x["_v"])
        else:
            value = F.collect_list("_v")
        return out.join(rows.groupBy("s").agg(value.alias(name)), "s", how)

    @staticmethod
    def _conjunct(where: dict, name: str) -> dict:
        """What a filter demands of one relationship, whatever else holds."""
        out = dict(where.get(name) or {})
        for x in where.get("AND") or ():
            out |= Planner._conjunct(x or {}, name)
        return out

    def output(self, shape: Shape, f: Field, o: Column) -> Column:
        if f.kind == "enum":
            named = F.create_map(*(x for n, t in f.enum_names().items() for x in (F.lit(t.lex), F.lit(n))))
            found = F.try_element_at(named, o["lex"])
            if not self.engine.strict:
                return found
            return F.when(o["lex"].isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"no member of {shape.name}.{f.name}: "), o["lex"])).cast("string"))
        kind = f.output
        if kind == "Int":
            # A mapped column fills num; a literal beyond 64 bits is an error, not a null.
            found = F.coalesce(o["lex"].try_cast("bigint"), F.when(o["num"].between(-(2.0**63), 2.0**63), o["num"].try_cast("bigint")))
            return F.when(found.isNull() & F.coalesce(o["lex"].rlike(r"^[+-]?[0-9]+$"), F.lit(False)), F.raise_error(F.concat(F.lit(f"{shape.name}.{f.name} has an integer beyond 64 bits: "), o["lex"])).cast("bigint")).otherwise(found)
        if kind == "Float":
            return o["num"]
        return F.when(o["lex"].isNotNull(), o["lex"].isin("true", "1")) if kind == "Boolean" else o["lex"]


def _loose(f: Field) -> bool:
    """Whether an entity without a value stays even where the field is required: in strict mode that is an error."""
    if f.default is not None:
        return not isinstance(f.default, Const)
    return f.derived is not None and keeps_rows(f.derived)


def _sortable(made: DataFrame) -> bool:
    return "map<" not in made.schema["_v"].dataType.simpleString()


def _fields(test: tuple) -> set[str]:
    if test[0] in ("and", "or"):
        return set().union(*map(_fields, test[1]))
    if test[0] == "not":
        return _fields(test[1])
    return {test[1]} - {None}


def _bad(value: object, f: Field) -> Column:
    raise OperationError(f"{value!r} is no value of {f.name}")


def _enum(names: dict, name: object, f: Field) -> str:
    if name not in names:
        raise OperationError(f"{name} is no member of {f.name}")
    return names[name].lex


def operate(op: str, c: Column, value: object) -> Column:
    if op in ("in", "notIn"):
        found = c.isin(*(x for x in value if x is not None))
        return found if op == "in" else ~found
    return {
        "eq": lambda: c == value, "neq": lambda: c != value, "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value,
        "contains": lambda: c.contains(value), "startsWith": lambda: c.startswith(value), "endsWith": lambda: c.endswith(value), "regex": lambda: c.rlike(value),
    }[op]()
