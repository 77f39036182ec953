"""Five generated graphs that stress one thing each: many values, depth, derived fields, languages, width."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..sources.graphs import QuadSource
from ..sources.load import load_shapes
from ..sources.terms import TYPE, Term, iri, literal
from ..sources.turtle import Graph
from .engine import Context, Engine
from .shapes import parse_shapes

_HEAD = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix n: <http://www.w3.org/ns/shacl-node-expr#> . @prefix e: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . e:p sh:declare [ sh:prefix \"e\" ; sh:namespace \"http://e/\" ] .\n"
_ONE = "sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1"
_TAGS = ("en", "nl", "fr", "de", "es", "it", "pt", "sv")

Triple = tuple[str, str, Term]


def many_values(entities: int, values: int) -> Iterator[Triple]:
    for i in range(entities):
        for who, kind in ((f"http://e/p{i}", "Parent"), (f"http://e/c{i}", "Child")):
            yield who, TYPE, iri("http://e/" + kind)
            for k in range(values):
                yield who, "http://e/tag", literal(f"tag {kind} {i} {k}")
                yield who, "http://e/alt", literal(f"alt {kind} {i} {k}")
        yield f"http://e/p{i}", "http://e/child", iri(f"http://e/c{i}")


def depth(entities: int, levels: int) -> Iterator[Triple]:
    for i in range(entities):
        for k in range(levels + 1):
            yield f"http://e/n{i}-{k}", TYPE, iri("http://e/Node")
            yield f"http://e/n{i}-{k}", "http://e/label", literal(f"label {i} {k}")
            if k < levels:
                yield f"http://e/n{i}-{k}", "http://e/below", iri(f"http://e/n{i}-{k + 1}")


def derived(entities: int) -> Iterator[Triple]:
    for i in range(entities):
        yield f"http://e/t{i}", TYPE, iri("http://e/Thing")
        for name in ("given", "family", "short"):
            yield f"http://e/t{i}", f"http://e/{name}", literal(f"{name} {i}")
        if i % 2 == 0:
            yield f"http://e/t{i}", "http://e/review", literal(f"review {i}")


def languages(entities: int, tags: int) -> Iterator[Triple]:
    for i in range(entities):
        yield f"http://e/d{i}", TYPE, iri("http://e/Doc")
        for tag in _TAGS[:tags]:
            yield f"http://e/d{i}", "http://e/title", literal(f"title {i} {tag}", lang=tag)


def width(entities: int, parts: int) -> Iterator[Triple]:
    for i in range(entities):
        yield f"http://e/r{i}", TYPE, iri("http://e/Row")
        for k in range(4):
            yield f"http://e/r{i}", f"http://e/text{k}", literal(f"text {k} {i}")
            yield f"http://e/r{i}", f"http://e/number{k}", literal(i)
        for k in range(2):
            yield f"http://e/r{i}", "http://e/tag", literal(f"tag {i} {k}")
        for k in range(parts):
            yield f"http://e/r{i}", "http://e/part", iri(f"http://e/r{i}-{k}")
            yield f"http://e/r{i}-{k}", TYPE, iri("http://e/Part")
            for name in ("code", "name"):
                yield f"http://e/r{i}-{k}", f"http://e/{name}", literal(f"{name} {i} {k}")


_EXISTS = "n:exists [ n:pathValues e:review ]"
_BELOW = "below { label } "
for _ in range(2):
    _BELOW = f"below {{ label {_BELOW}}} "

#: Generator, shapes, operation, language chain, and the points of the sweep with their names.
SCENARIOS = {
    "cartesian": (many_values, "e:ParentShape a sh:NodeShape ; sh:codeIdentifier \"Parent\" ; sh:targetClass e:Parent ; sh:property [ sh:path e:tag ; sh:datatype xsd:string ] , [ sh:path e:alt ; sh:datatype xsd:string ] , [ sh:path e:child ; sh:class e:Child ] . e:ChildShape a sh:NodeShape ; sh:codeIdentifier \"Child\" ; sh:targetClass e:Child ; sh:property [ sh:path e:tag ; sh:datatype xsd:string ] , [ sh:path e:alt ; sh:datatype xsd:string ] .",
                  "{ parent { iri tag alt child { iri tag alt } } }", (), {"N10-K2": (10, 2), "N50-K2": (50, 2), "N50-K4": (50, 4), "N100-K4": (100, 4), "N50-K8": (50, 8)}),
    "deep-nesting": (depth, f"e:NodeShape a sh:NodeShape ; sh:codeIdentifier \"Node\" ; sh:targetClass e:Node ; sh:property [ sh:path e:label ; {_ONE} ] , [ sh:path e:below ; sh:class e:Node ] .",
                     f"{{ node {{ iri label {_BELOW}}} }}", (), {"d3-e2": (2, 3), "d6-e2": (2, 6), "d4-e10": (10, 4), "d4-e50": (50, 4), "d4-e100": (100, 4)}),
    "derived-heavy": (derived, f"e:ThingShape a sh:NodeShape ; sh:codeIdentifier \"Thing\" ; sh:targetClass e:Thing ; sh:property [ sh:path e:given ; {_ONE} ] , [ sh:path e:family ; {_ONE} ] , [ sh:path e:short ; {_ONE} ] , [ sh:path e:copy ; {_ONE} ; sh:values [ n:pathValues e:short ] ] , "
                      f"[ sh:path e:full ; {_ONE} ; sh:values [ sh:prefixes e:p ; sh:select \"SELECT ?x WHERE {{ $this e:given ?g ; e:family ?f . BIND(CONCAT(?g, ' ', ?f) AS ?x) }}\" ] ] , [ sh:path e:state ; {_ONE} ; sh:values [ n:if [ {_EXISTS} ] ; n:then \"seen\" ; n:else \"new\" ] ] , "
                      f"[ sh:path e:reviewed ; sh:datatype xsd:boolean ; sh:minCount 1 ; sh:maxCount 1 ; sh:values [ {_EXISTS} ] ] , [ sh:path e:kind ; {_ONE} ; sh:values \"thing\" ] .",
                      "{ thing { iri given family short copy full state reviewed kind } }", (), {"N10": (10,), "N50": (50,), "N100": (100,), "N500": (500,), "N1000": (1000,)}),
    "lang-multiplicity": (languages, "e:DocShape a sh:NodeShape ; sh:codeIdentifier \"Doc\" ; sh:targetClass e:Doc ; sh:property [ sh:path e:title ; sh:datatype rdf:langString ; sh:maxCount 1 ] .",
                          "{ doc { iri title } }", ("en", "nl", ""), {"N100-L2": (100, 2), "N100-L4": (100, 4), "N100-L8": (100, 8), "N500-L4": (500, 4), "N1000-L4": (1000, 4)}),
    "wide-results": (width, "e:RowShape a sh:NodeShape ; sh:codeIdentifier \"Row\" ; sh:targetClass e:Row ; sh:property " + " , ".join(f"[ sh:path e:text{k} ; {_ONE} ] , [ sh:path e:number{k} ; sh:datatype xsd:integer ; sh:minCount 1 ; sh:maxCount 1 ]" for k in range(4))
                     + f" , [ sh:path e:tag ; sh:datatype xsd:string ] , [ sh:path e:part ; sh:class e:Part ] . e:PartShape a sh:NodeShape ; sh:codeIdentifier \"Part\" ; sh:targetClass e:Part ; sh:property [ sh:path e:code ; {_ONE} ] , [ sh:path e:name ; {_ONE} ] .",
                     "{ row { iri " + " ".join(f"text{k} number{k}" for k in range(4)) + " tag part { code name } } }", (), {"N50-P2": (50, 2), "N100-P2": (100, 2), "N250-P2": (250, 2), "N500-P2": (500, 2)}),
}


def prepared(spark: SparkSession, name: str, point: str) -> Engine:
    """An engine over a point's graph, loaded into memory."""
    generate, shapes, _, _, points = SCENARIOS[name]
    graph = Graph([(None, iri(s), p, o) for s, p, o in generate(*points[point])])
    quads = QuadSource.of(spark, graph).quads.coalesce(1).cache()
    quads.count()
    return Engine(parse_shapes(load_shapes(_HEAD + shapes)), QuadSource(quads, unique=True))


def ask(engine: Engine, name: str) -> DataFrame:
    _, _, operation, chain, _ = SCENARIOS[name]
    (df,) = engine.execute(operation, context=Context(chain)).values()
    return df
