"""Values, filters, shapes and schema text on small graphs; and what plans read."""

import json
import re

import pytest

from quadlake.operators import paths
from quadlake.plans.engine import Context, Engine
from quadlake.plans.graphql import OperationError, accept_language
from quadlake.plans.queries import queries
from quadlake.plans.shapes import Const, Exists, If, PathValues, ShapeError, Sparql, keeps_rows, parse_shapes, path_predicates, single_valued
from quadlake.plans.tables import SHAPES as TABLE_SHAPES
from quadlake.plans.tables import engine as tables_engine
from quadlake.sources.graphs import MappedSource, QuadSource
from quadlake.sources.load import load_shapes
from quadlake.sources.terms import literal
from quadlake.sources.turtle import parse

DIR = "/root/testdata/sf0.001"
HEAD = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix n: <http://www.w3.org/ns/shacl-node-expr#> . @prefix e: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
SHAPES = HEAD + """
e:Task a sh:NodeShape ; sh:targetClass e:T ; sh:description "Ein Ding"@de , "A thing"@en ;
  sh:property [ sh:path e:len ; sh:datatype xsd:dayTimeDuration ; sh:maxCount 1 ] , [ sh:path e:at ; sh:datatype xsd:time ; sh:maxCount 1 ] , [ sh:path e:year ; sh:datatype xsd:gYear ; sh:maxCount 1 ] ,
    [ sh:path e:cost ; sh:datatype xsd:decimal ; sh:maxCount 1 ] , [ sh:path e:big ; sh:datatype xsd:integer ; sh:maxCount 1 ] , [ sh:path e:note ; sh:or ( [ sh:datatype xsd:string ] [ sh:datatype rdf:langString ] ) ; sh:maxCount 1 ] ,
    [ sh:path e:label ; sh:datatype rdf:langString ; sh:maxCount 1 ; sh:defaultValue "none"@en ] , [ sh:path e:state ; sh:in ( "on" "off" ) ; sh:maxCount 1 ] ,
    [ sh:path e:flag ; sh:datatype xsd:string ; sh:maxCount 1 ] , [ sh:path e:grade ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ; sh:values [ n:if [ n:exists [ n:pathValues e:flag ] ] ; n:then "flagged" ] ] ,
    [ sh:path e:mark ; sh:datatype xsd:string ; sh:maxCount 1 ; sh:defaultValue [ n:if [ n:exists [ n:pathValues e:flag ] ] ; n:then "flagged" ] ] ,
    [ sh:path e:ints ; sh:codeIdentifier "whole" ; sh:datatype xsd:integer ; sh:values [ n:nodes [ n:pathValues e:some ] ; n:filterShape [ sh:datatype xsd:integer ] ] ] ,
    [ sh:path e:subs ; sh:class e:T ; sh:values [ n:nodes [ n:pathValues e:sub ] ; n:filterShape [ sh:class ( e:T e:U ) ] ] ] , [ sh:path e:roots ; sh:class e:T ; sh:values [ n:nodes [ n:pathValues e:sub ] ; n:filterShape [ sh:rootClass e:Top ] ] ] ,
    [ sh:path e:noted ; sh:class e:T ; sh:values [ n:nodes [ n:pathValues e:sub ] ; n:filterShape [ sh:property [ sh:path e:note ; sh:minCount 1 ] ] ] ] , [ sh:path e:nowhere ; sh:class e:T ; sh:values [ n:nodes [ n:pathValues e:sub ] ; n:filterShape [ sh:class () ] ] ] .
e:Kind a sh:NodeShape , rdfs:Class ; sh:property [ sh:path e:note ; sh:datatype xsd:string ; sh:maxCount 1 ] .
e:Loose a sh:NodeShape ; sh:property [ sh:path e:note ; sh:datatype xsd:string ; sh:maxCount 1 ] .
"""
DATA = HEAD + """
e:a a e:T ; e:len "P9D"^^xsd:dayTimeDuration ; e:at "09:30:00"^^xsd:time ; e:year "0999"^^xsd:gYear ; e:cost 0.1 ; e:big 9007199254740993 ; e:note "plain" , "nl"@nl ; e:flag "y" ; e:sub e:b , e:c , e:u ; e:some 1 , "1" , 2.5 ; e:label "x"@en--ltr .
e:b a e:T ; e:len "P10D"^^xsd:dayTimeDuration ; e:at "10:00:00+02:00"^^xsd:time ; e:year "1000"^^xsd:gYear ; e:cost 0.10000000000000001 ; e:big 9007199254740992 ; e:note "fr"@fr . e:c e:note "c" . e:u a e:U . e:k a e:Sub . e:Sub rdfs:subClassOf e:Kind . e:k e:note "kind" . e:U rdfs:subClassOf e:Top .
"""


@pytest.fixture(scope="module")
def tasks(spark):
    return Engine(parse_shapes(load_shapes(SHAPES)), QuadSource.of(spark, parse(DATA)))


def ask(engine, text, **context):
    (df,) = engine.json(text, None, Context(**context)).values()
    return sorted((json.loads(r[0]) for r in df.collect()), key=lambda x: json.dumps(x, sort_keys=True))


@pytest.mark.parametrize(("where", "iris"), [
    ('len: {gt: "P9D"}', "b"), ('len: {lte: "P9D"}', "a"), ('len: {in: ["PT216H"]}', "a"), ('len: {neq: "P10D"}', "a"), ('at: {lt: "09:00:00"}', "b"), ('at: {eq: "08:00:00Z"}', "b"), ('year: {lt: "1000"}', "a"), ('year: {gte: "0999"}', "ab"),
    ("cost: {eq: 0.1}", "a"), ("cost: {gt: 0.1}", "b"), ("big: {eq: 9007199254740993}", "a"), ("big: {lt: 9007199254740993}", "b"), ("big: {gt: 5}", "ab"),
])
def test_order_of_values(tasks, where, iris):
    assert [x["iri"] for x in ask(tasks, f"{{ t(where: {{{where}}}) {{ iri }} }}".replace("t(", "task("))] == [f"http://e/{k}" for k in iris]


def test_languages_and_defaults(tasks):
    notes = lambda *chain: [x["note"] for x in ask(tasks, "{ task { iri note } }", lang_tags=chain)]
    assert notes("nl", "fr") == ["nl", "fr"] and notes("de") == ["plain", None]  # the untagged value is the last step of both spaces together
    assert [x["label"] for x in ask(tasks, "{ task { iri label } }", lang_tags=("en",))] == ["x", "none"] and [x["label"] for x in ask(tasks, "{ task { iri label } }", lang_tags=("nl",))] == ["none", "none"]
    assert accept_language("nl;q=2, en;q=0.5") == ("nl", "en") and accept_language("en;q=.5, fr;q=0.9") == ("en", "fr") and accept_language("en;q=2;q=0.5, fr;q=0.9") == ("fr", "en") and accept_language("de;q=0, *") == ("*",) and accept_language(" ") == ()


def test_filter_shapes(tasks):
    (a, _) = ask(tasks, "{ task { iri whole subs { iri } roots { iri } noted { iri } nowhere { iri } } }")
    names = lambda k: sorted(x["iri"][-1] for x in a[k])
    assert a["whole"] == [1] and names("subs") == ["b"] and names("roots") == [] and names("noted") == ["b"] and names("nowhere") == []


def test_strict_nulls(spark, tasks):
    # Lenient, an entity stays without its required derived value; strict, that is an error.
    assert [x["grade"] for x in ask(tasks, "{ task { iri grade } }")] == ["flagged", None] and [x["mark"] for x in ask(tasks, "{ task { iri mark } }")] == ["flagged", None]
    strict = Engine(tasks.registry, tasks.source, strict=True)
    for name in ("grade", "mark"):
        with pytest.raises(Exception, match="is required"):
            ask(strict, f"{{ task {{ iri {name} }} }}")
    assert ask(strict, f'{{ task(where: {{flag: {{eq: "y"}}}}) {{ grade }} }}') == [{"grade": "flagged"}]


def test_integers_beyond_64_bits(spark, tasks):
    data = parse(HEAD + "e:a a e:T ; e:big 99999999999999999999 .")
    with pytest.raises(Exception, match="beyond 64 bits"):
        ask(Engine(tasks.registry, QuadSource.of(spark, data)), "{ task { big } }")


def test_targets(tasks):
    assert ask(tasks, "{ kind { iri note } }") == [{"iri": "http://e/k", "note": "kind"}]  # a class that is a shape has all below it
    with pytest.raises(OperationError):
        tasks.execute("{ loose { note } }")


def test_schema_text(tasks):
    text = tasks.sdl()
    for part in ("task(where: TaskFilter, limit: Int, offset: Int): [Task!]!", "  iri: ID!", "  grade: String!", "  whole: [Int!]", "  subs: [Task!]", "  label: String!", "enum TaskState {\n  ON\n  OFF\n}", "  state: TaskState\n", "  state: TaskStateFilter", "  len: DateTimeFilter", "  cost: FloatFilter", "  big: IntFilter", "  subs: TaskFilter", "  AND: [TaskFilter!]", "input DateTimeFilter {\n  eq: String", "  in: [Int!]", '"""A thing"""'):
        assert part in text, part
    assert text.count("enum TaskState {") == 1


@pytest.mark.parametrize("body", [
    'sh:path e:a ; sh:datatype xsd:string ; sh:maxCount 1 ; sh:values [ n:nodes [ n:pathValues e:b ] ; n:filterShape [ sh:maxCount 1 ] ]', 'sh:path e:a ; sh:datatype xsd:string ; sh:values [ n:nodes [ n:pathValues e:b ] ; n:filterShape [ sh:property [ sh:path e:c ; sh:minCount 2 ] ] ]',
    "sh:path e:a ; sh:datatype xsd:string ; sh:values [ n:nodes [ n:pathValues e:b ] ; n:filterShape e:Named ]", "sh:path [ sh:inversePath e:a ] ; sh:codeIdentifier \"z\" ; sh:datatype xsd:string ; sh:values [ n:pathValues e:b ]", "sh:path e:a ; sh:values [ n:pathValues e:b ]", 'sh:path e:a ; sh:datatype xsd:string ; sh:values "one"',
    'sh:path e:a ; sh:datatype xsd:string ; sh:defaultValue "one"', "sh:path e:a ; sh:class e:T ; sh:maxCount 1 ; sh:defaultValue e:x", "sh:path e:a ; sh:datatype xsd:string ; sh:maxCount 1 ; sh:defaultValue [ n:pathValues e:b ]", 'sh:path e:a ; sh:in ( "a" e:b )', 'sh:path e:a ; sh:in ( "a" 1 )',
])
def test_shapes_that_are_refused(body):
    with pytest.raises(ShapeError):
        parse_shapes(parse(HEAD + f"e:S a sh:NodeShape ; sh:targetClass e:C ; sh:property [ {body} ] ."))


def test_expressions_by_kind():
    const, path, text = Const((literal("x"),)), PathValues(("pred", "p")), lambda select: Sparql("", (), select)
    table = [(const, True, True), (Const((literal("x"),), True), False, True), (path, False, False), (Exists(path), True, True), (If(path, const, None), True, True), (If(path, const, path), False, True), (text(True), False, False), (text(False), True, True)]
    assert [(single_valued(x), keeps_rows(x)) for x, _, _ in table] == [(a, b) for _, a, b in table]
    assert sorted(path_predicates(("seq", (("inv", ("pred", "a")), ("alt", (("pred", "b"), ("star", ("pred", "a")))))))) in (["a", "b"], ["a", "a", "b"])


def test_a_filter_over_if_goes_into_its_branches(spark):
    shapes = HEAD + 'e:S a sh:NodeShape ; sh:codeIdentifier "Thing" ; sh:targetClass e:T ; sh:property [ sh:path e:o ; sh:codeIdentifier "out" ; sh:class e:T ; sh:values [ n:nodes [ n:if [ n:exists [ n:pathValues e:flag ] ] ; n:then [ n:pathValues e:x ] ; n:else [ n:pathValues e:y ] ] ; n:filterShape [ sh:property [ sh:path e:ok ; sh:hasValue true ] ] ] ] .'
    data = HEAD + 'e:a a e:T ; e:flag 1 ; e:x e:b , e:c ; e:y e:d . e:b a e:T ; e:ok true ; e:x e:a ; e:y e:d , e:c . e:c a e:T . e:d a e:T ; e:ok true .'
    found = ask(Engine(parse_shapes(parse(shapes)), QuadSource.of(spark, parse(data))), "{ thing { iri out { iri } } }")
    assert {x["iri"][-1]: [y["iri"][-1] for y in x["out"]] for x in found} == {"a": ["b"], "b": ["d"], "c": [], "d": []}


def test_scoped_graphs_keep_their_extra(spark):
    extra = parse(HEAD + "e:g { e:x a e:T } e:h { e:y a e:T }")
    source = MappedSource(spark, {}, [], extra)
    assert [r.s for r in source.scoped(("http://e/g",)).instances(["http://e/T"]).collect()] == ["http://e/x"]


# Plans.


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_a_filter_is_one_scan(spark, k):
    tests = ['status: {eq: F}', "totalprice: {gt: 10}", 'priority: {neq: "x"}', 'orderdate: {gt: "1990-01-01T00:00:00"}'][:k]
    (df,) = tables_engine(spark, DIR, as_quads=True).execute(f"{{ order(where: {{{', '.join(tests)}}}) {{ iri }} }}").values()
    assert planned(df).count("FileScan parquet") <= k + 1


def test_an_iri_reaches_the_scan(spark):
    (df,) = tables_engine(spark, DIR).execute('{ customer(where: {iri: {in: ["urn:customer:3", "urn:customer:03", "urn:other:1"]}}) { iri name } }').values()
    assert "EqualTo(c_custkey,3)" in df._jdf.queryExecution().executedPlan().toString() and [r.iri for r in df.collect()] == ["urn:customer:3"]


def test_a_page_restricts_its_lists(spark):
    (df,) = tables_engine(spark, DIR).execute("{ customer(limit: 2) { iri orders { iri } } }").values()
    text = planned(df)
    assert len(re.findall(r"FileScan parquet \[o_", text)) == 1 and "LeftSemi" in text
    assert text.index("collect_list") < text.index("LeftSemi")  # plans are written from the top: the page comes first


def test_a_node_filter_reads_its_targets(spark):
    shapes = TABLE_SHAPES.replace("[ sh:path q:customer ; sh:class q:Customer ;", "[ sh:path q:customer ; sh:node q:CustomerShape ;")
    assert shapes != TABLE_SHAPES
    given = tables_engine(spark, DIR)
    (df,) = Engine(parse_shapes(load_shapes(shapes)), given.source).execute('{ order(where: {customer: {name: {eq: "Customer#000000001"}}}) { iri } }').values()
    (same,) = given.execute('{ order(where: {customer: {name: {eq: "Customer#000000001"}}}) { iri } }').values()
    assert planned(df).count("FileScan parquet") <= 6 and sorted(df.collect()) == sorted(same.collect())


def test_a_closure_walks_from_what_is_asked_for(spark, monkeypatch):
    rows = []
    keep = paths.checkpointed

    def counted(df):
        out = keep(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(paths, "checkpointed", counted)
    every = {r.iri: {x.iri for x in r.later} for r in tables_engine(spark, DIR).execute("{ turn { iri later { iri } } }")["turn"].collect()}
    all_pairs, one = max(rows), max(every, key=lambda k: len(every[k]))
    rows.clear()
    (found,) = tables_engine(spark, DIR).execute(f'{{ turn(where: {{iri: {{eq: "{one}"}}}}) {{ iri later {{ iri }} }} }}')["turn"].collect()
    assert {x.iri for x in found.later} == every[one] and sum(rows) == len(every[one]) < all_pairs


@pytest.mark.parametrize("name", ["quad_scalar_range", "quad_nested_list", "quad_path_plus", "quad_lang_chain", "quad_read_graphs", "quad_derived_target", "quad_and_or_not", "quad_page"])
def test_quads_say_the_same(spark, name):
    as_rows = lambda n: sorted(map(repr, queries()[n](spark, DIR).collect()))
    assert as_rows(name) == as_rows(name.removeprefix("quad_"))


def test_scenarios(spark):
    from quadlake.plans import scenarios

    sizes = {}
    for name, (_, _, _, _, points) in scenarios.SCENARIOS.items():
        rows = scenarios.ask(scenarios.prepared(spark, name, next(iter(points))), name).collect()
        sizes[name] = (len(rows), rows[0].asDict(True))
    assert {k: n for k, (n, _) in sizes.items()} == {"cartesian": 10, "deep-nesting": 8, "derived-heavy": 10, "lang-multiplicity": 100, "wide-results": 50}
    parent, thing, row = (sizes[k][1] for k in ("cartesian", "derived-heavy", "wide-results"))
    assert len(parent["tag"]) == len(parent["alt"]) == len(parent["child"][0]["tag"]) == 2 and thing["full"].startswith("given ") and thing["kind"] == "thing" and len(row["tag"]) == len(row["part"]) == 2 and sizes["lang-multiplicity"][1]["title"].endswith(" en")
