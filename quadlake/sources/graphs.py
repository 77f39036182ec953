"""Where triples come from: quads in a DataFrame, or relational tables read as a graph (SRC-4, 5, 8 to 11)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .terms import LITERAL, NUMERIC, TEMPORAL, TERM, TYPE, XSD, iri_term, term
from .turtle import Graph


class GraphSource:
    """`pairs(p)` is the predicate as rows (s string, o term); `triples()` all of them with p."""

    spark: SparkSession

    def pairs(self, predicate: str) -> DataFrame:
        raise NotImplementedError

    def triples(self) -> DataFrame:
        raise NotImplementedError

    def scoped(self, graphs: tuple[str, ...]) -> GraphSource:
        raise NotImplementedError

    def instances(self, classes: list[str]) -> DataFrame:
        """Direct instances of any of the classes: s, distinct."""
        types = self.pairs(TYPE)
        return types.where(types["o"]["lex"].isin(*classes)).select("s").distinct()


QUADS = "g string, s string, p string, o struct<kind:tinyint,lex:string,dt:string,lang:string,num:double,ts:timestamp>"


class QuadSource(GraphSource):
    """quads: g, s, p, o. Without a scope, the default graph is the union of all graphs ("union") or the unnamed one
    ("unnamed"). Predicates are filters on p, which prune a table partitioned by it."""

    def __init__(self, quads: DataFrame, default: str = "union", graphs: tuple[str, ...] | None = None, unique: bool = False):
        """unique: no triple is in quads twice, not even in two graphs; then a merge of graphs needs no shuffle."""
        self.quads, self.default, self.graphs, self.unique, self.spark = quads, default, graphs, unique, quads.sparkSession
        seen = quads
        if graphs is not None:
            seen = quads.where(F.col("g").isin(*graphs))
        elif default == "unnamed":
            seen = quads.where("g is null")
        self.seen = seen.select("s", "p", "o")

    @staticmethod
    def of(spark: SparkSession, graph: Graph, default: str = "union") -> QuadSource:
        rows = [(g, s.lex, p, o.kind, o.lex, o.dt, o.lang) for g, s, p, o in graph.quads]
        flat = spark.createDataFrame(rows, "g string, s string, p string, kind int, lex string, dt string, lang string")
        return QuadSource(flat.select("g", "s", "p", term(F.col("kind"), F.col("lex"), F.col("dt"), F.col("lang")).alias("o")), default)

    def pairs(self, predicate: str) -> DataFrame:
        # A merge of graphs is a set.
        found = self.seen.where(F.col("p") == predicate).select("s", "o")
        return found if self.unique else found.distinct()

    def triples(self) -> DataFrame:
        return self.seen if self.unique else self.seen.distinct()

    def scoped(self, graphs: tuple[str, ...]) -> QuadSource:
        return QuadSource(self.quads, self.default, tuple(graphs), self.unique)

    def instances(self, classes: list[str]) -> DataFrame:
        found = self.pairs(TYPE).where(F.col("o.lex").isin(*classes)).select("s")
        return found if len(classes) == 1 else found.distinct()


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples or N-Quads as quads, read in parallel by line. Lines that are neither are an error when met."""
    line = F.trim("value")
    node, lit = r"(<[^>]*>|_:\S+)", r'"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?'
    pattern = rf"^{node}\s+<([^>]*)>\s+(?:{node}|{lit})\s*{node}?\s*\.$"
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    part = lambda k: F.regexp_extract(line, pattern, k)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    ok = F.when(line.rlike(pattern), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not N-Quads: "), line)).cast("boolean"))
    text = part(4)
    for escape, plain in (("\\\\n", "\n"), ("\\\\t", "\t"), ("\\\\r", "\r"), ('\\\\"', '"'), ("\\\\\\\\", "\\\\")):
        text = F.regexp_replace(text, escape, plain)
    lang = F.when(part(6) != "", F.lower(part(6)))
    dt = F.when(lang.isNotNull(), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).when(part(5) != "", part(5)).otherwise(F.lit(XSD + "string"))
    is_node = part(3) != ""
    none = F.lit(None).cast("string")
    o = F.when(is_node, iri_term(bare(part(3)))).otherwise(term(F.lit(LITERAL), text, dt, lang))
    return rows.where(ok).select(F.when(part(7) != "", bare(part(7))).otherwise(none).alias("g"), bare(part(1)).alias("s"), part(2).alias("p"), o.alias("o"))


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """SPARQL results JSON as rows of terms, a column for each variable; unbound is null (SRC-7)."""
    raw = spark.read.option("multiLine", True).json(path)
    names = [r[0] for r in raw.select(F.explode("head.vars")).collect()]
    rows = raw.select(F.explode("results.bindings").alias("b"))
    fields = {f.name: {x.name for x in f.dataType.fields} for f in rows.schema["b"].dataType.fields}

    def one(name: str) -> Column:
        if name not in fields:
            return F.lit(None).cast(TERM)
        get = lambda k: F.col(f"b.`{name}`.`{k}`") if k in fields[name] else F.lit(None).cast("string")
        value, kind, lang = get("value"), get("type"), F.lower(get("xml:lang"))
        dt = F.coalesce(get("datatype"), F.when(lang.isNotNull(), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).otherwise(F.lit(XSD + "string")))
        return F.when(value.isNull(), F.lit(None).cast(TERM)).when(kind == "uri", iri_term(value)).when(kind == "bnode", iri_term(F.concat(F.lit("_:"), value))).otherwise(term(F.lit(LITERAL), value, dt, lang))

    return rows.select(*(one(n).alias(n) for n in names))


@dataclass(frozen=True)
class Entity:
    """A table whose rows are the subjects `urn:<name>:<key...>`. Columns: predicate to (column, datatype). Links:
    predicate to (columns, target entity name). classes: constant classes, and columns that name one."""

    name: str
    table: str
    key: tuple[str, ...]
    classes: tuple[str, ...]
    columns: dict[str, tuple[str, str]] = field(default_factory=dict)
    links: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)
    class_column: tuple[str, str] | None = None
    language: dict[str, str] = field(default_factory=dict)
    graph: str | None = None


def subject(name: str, columns: tuple[str, ...]) -> Column:
    parts = [F.lit(f"urn:{name}")]
    for c in columns:
        parts += [F.lit(":"), F.col(c).cast("string")]
    return F.concat(*parts)


class MappedSource(GraphSource):
    """Tables as a graph: nothing is copied into triples; a predicate is a projection of a table, so that filters and
    column pruning reach its scan. A null column is no triple. `extra` holds further triples, such as class trees."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], entities: list[Entity], extra: Graph | None = None, graphs: tuple[str, ...] | None = None):
        self.spark, self.tables, self.entities, self.extra, self.graphs = spark, tables, entities, extra, graphs
        self.more = QuadSource.of(spark, extra) if extra and extra.quads else None

    def scoped(self, graphs: tuple[str, ...]) -> MappedSource:
        extra = None if self.extra is None else Graph([q for q in self.extra.quads if q[0] in graphs])
        return MappedSource(self.spark, self.tables, [e for e in self.entities if e.graph in graphs], extra, tuple(graphs))

    def functional(self, predicate: str) -> bool:
        """Whether a subject has one value of a predicate at most, by how it is mapped."""
        holders = [e for e in self.entities if predicate in e.columns or predicate in e.links]
        return len(holders) == 1 and not (predicate in holders[0].columns and predicate in holders[0].links) and not self._extra_has(predicate)

    def _extra_has(self, predicate: str) -> bool:
        return self.extra is not None and any(p == predicate for _, _, p, _ in self.extra.quads)

    def _holder(self, class_: str) -> Entity | None:
        """The one entity whose rows are all instances of a class."""
        holders = [e for e in self.entities if class_ in e.classes]
        if len(holders) != 1 or any(e.class_column and class_.startswith(e.class_column[0]) for e in self.entities):
            return None
        if self.extra is not None and any(p == TYPE and o.lex == class_ for _, _, p, o in self.extra.quads):
            return None
        return holders[0]

    def holds(self, class_: str, predicate: str) -> bool:
        """Whether a link is one of the rows of a class, and of them alone."""
        e = self._holder(class_)
        return e is not None and predicate in e.links and self.functional(predicate)

    def by_keys(self, class_: str, iris: list[str]) -> Column | None:
        """Whether a row of `row(class_)` is one of the IRIs, told by the columns that make its IRI."""
        e = self._holder(class_)
        if e is None:
            return None
        kinds = {f.name: f.dataType for f in self.tables[e.table].schema.fields}
        tests = []
        for text in iris:
            parts = str(text).removeprefix(f"urn:{e.name}:").split(":", len(e.key) - 1)
            if str(text).startswith(f"urn:{e.name}:") and len(parts) == len(e.key):
                # The IRI is tested too: "01" is not what 1 is written as.
                same = F.col("s") == text
                for c, x in zip(e.key, parts, strict=True):
                    same = (F.col(f"_key_{c}") == F.lit(x).try_cast(kinds[c])) & same
                tests.append(same)
        return reduce(Column.__or__, tests) if tests else F.lit(False)

    def row(self, class_: str, predicates: dict[str, str], solid: set[str], parent: str | None = None) -> tuple[DataFrame, set[str]] | None:
        """One scan for the entities of a class and those of their fields (name to predicate) that their row holds:
        s, _key_<column> of what it is made from, and f_<name>, null where there is no triple. Rows without a solid field are left out, so
        that a filter on it reaches the scan as it is. With `parent`, a link of the row, _parent is what it leads to, and rows without one are
        left out. None if the class is not one table's."""
        e = self._holder(class_)
        if e is None:
            return None
        covered = {n for n, p in predicates.items() if (p in e.columns or p in e.links) and self.functional(p)}
        columns = [self._object(e, predicates[n], n in solid).alias(f"f_{n}") for n in sorted(covered)]
        rows = self.tables[e.table]
        for n in sorted(covered & solid):
            for c in e.links[predicates[n]][0] if predicates[n] in e.links else (e.columns[predicates[n]][0],):
                rows = rows.where(F.col(c).isNotNull())
        if parent is not None:
            for c in e.links[parent][0]:
                rows = rows.where(F.col(c).isNotNull())
            columns.append(subject(e.links[parent][1], e.links[parent][0]).alias("_parent"))
        return rows.select(subject(e.name, e.key).alias("s"), *(F.col(c).alias(f"_key_{c}") for c in e.key), *columns), covered

    def _object(self, e: Entity, predicate: str, solid: bool = False) -> Column:
        none = F.lit(None)
        if predicate in e.links:
            columns, target = e.links[predicate]
            if solid:
                return iri_term(subject(target, columns))
            return F.when(F.greatest(*(F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0, iri_term(subject(target, columns)))
        column, dt = e.columns[predicate]
        value = F.col(column)
        if predicate in e.language:
            made = term(F.lit(LITERAL), value.cast("string"), F.lit(dt), F.lower(F.col(e.language[predicate])), none.cast("double"), none.cast("timestamp"))
        else:
            made = term(F.lit(LITERAL), lexical(value, dt), F.lit(dt), none.cast("string"), value.cast("double") if dt in NUMERIC else none.cast("double"), value.cast("timestamp") if dt in TEMPORAL else none.cast("timestamp"))
        return made if solid else F.when(value.isNotNull(), made)

    def _parts(self, predicate: str) -> list[DataFrame]:
        out = []
        for e in self.entities:
            rows, s = self.tables[e.table], subject(e.name, e.key)
            if predicate == TYPE:
                for c in e.classes:
                    out.append(rows.select(s.alias("s"), iri_term(F.lit(c)).alias("o")))
                if e.class_column:
                    prefix, column = e.class_column
                    out.append(rows.where(F.col(column).isNotNull()).select(s.alias("s"), iri_term(F.concat(F.lit(prefix), F.col(column))).alias("o")))
            if predicate in e.columns or predicate in e.links:
                out.append(rows.select(s.alias("s"), self._object(e, predicate).alias("o")).where("o is not null"))
        if self.more is not None:
            out.append(self.more.pairs(predicate))
        return out

    def pairs(self, predicate: str) -> DataFrame:
        parts = self._parts(predicate)
        if not parts:
            return self.spark.createDataFrame([], "s string, o " + TERM.simpleString())
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        # One entity with a key of its own cannot repeat a triple; several sources of one predicate may.
        return out.distinct() if self.graphs is not None and len(parts) > 1 else out

    def instances(self, classes: list[str]) -> DataFrame:
        constant_only = [e for e in self.entities if set(e.classes) & set(classes)]
        others = [e for e in self.entities if e.class_column and any(c.startswith(e.class_column[0]) for c in classes)]
        out = [self.tables[e.table].select(subject(e.name, e.key).alias("s")) for e in constant_only]
        for e in others:
            prefix, column = e.class_column
            out.append(self.tables[e.table].where(F.col(column).isin(*(c.removeprefix(prefix) for c in classes if c.startswith(prefix)))).select(subject(e.name, e.key).alias("s")))
        if self.more is not None:
            out.append(self.more.instances(classes))
        if not out:
            return self.spark.createDataFrame([], "s string")
        every = out[0]
        for p in out[1:]:
            every = every.union(p)
        return every if len(out) == 1 and constant_only else every.distinct()

    def predicates(self) -> list[str]:
        found = {TYPE: None}
        for e in self.entities:
            found |= dict.fromkeys([*e.columns, *e.links])
        if self.extra:
            found |= dict.fromkeys(p for _, _, p, _ in self.extra.quads)
        return list(found)

    def triples(self) -> DataFrame:
        parts = [self.pairs(p).select("s", F.lit(p).alias("p"), "o") for p in self.predicates()]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out


def lexical(value: Column, dt: str) -> Column:
    """The lexical form of a column's value."""
    if dt == XSD + "dateTime":
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    return value.cast("string")
