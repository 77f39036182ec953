"""The graph engine on small graphs, against written-out answers and a naive evaluator."""

import json
import warnings

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quadlake.operators.paths import follow
from quadlake.plans.engine import Context, Engine
from quadlake.plans.envelope import respond
from quadlake.plans.graphql import OperationError, accept_language, parse_operation
from quadlake.plans.shapes import ShapeError, enum_names, parse_shapes
from quadlake.sources.graphs import QuadSource, read_ntriples, read_results_json
from quadlake.sources.load import load_shapes
from quadlake.sources.terms import literal
from quadlake.sources.turtle import Graph, parse

HEAD = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix n: <http://www.w3.org/ns/shacl-node-expr#> . @prefix e: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix g: <http://datashapes.org/graphql#> ."
SHAPES = HEAD + """
e:PersonShape a sh:NodeShape ; sh:codeIdentifier "Person" ; sh:targetClass e:Person ;
  sh:property [ sh:path e:name ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path e:age ; sh:datatype xsd:integer ; sh:maxCount 1 ] , [ sh:path e:tag ; sh:datatype xsd:string ] ,
   [ sh:path e:firm ; sh:class e:Firm ; sh:maxCount 1 ] , [ sh:path e:knows ; sh:class e:Person ] , [ sh:path e:bio ; sh:datatype rdf:langString ; sh:maxCount 1 ] ,
   [ sh:path [ sh:oneOrMorePath e:knows ] ; sh:codeIdentifier "reach" ; sh:class e:Person ] , [ sh:path e:state ; sh:in ( "on" "off-line" ) ; sh:maxCount 1 ] ,
   [ sh:path e:rank ; sh:datatype xsd:string ; sh:maxCount 1 ; sh:defaultValue "none" ] .
e:FirmShape a sh:NodeShape ; sh:codeIdentifier "Firm" ; sh:targetClass e:Firm ; sh:property [ sh:path e:title ; sh:codeIdentifier "name" ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path e:town ; sh:class e:Town ] .
e:TownShape a sh:NodeShape ; sh:codeIdentifier "Town" ; sh:targetClass e:Town ; sh:property [ sh:path e:title ; sh:codeIdentifier "name" ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] .
"""
DATA = HEAD + """
e:a a e:Person ; e:name "Ann" ; e:age 30 ; e:tag "x" , "y" ; e:firm e:f1 ; e:knows e:b ; e:bio "hi"@en , "hoi"@nl ; e:state "off-line" .
e:b a e:Person ; e:name "Bob" ; e:age 41 ; e:knows e:c ; e:firm e:f2 ; e:bio "salut"@fr ; e:rank "top" .
e:c a e:Person ; e:name "Cid" ; e:knows e:a , e:d . e:d a e:Person ; e:age 9 .
e:f1 a e:Firm ; e:title "Acme" ; e:town e:t1 , e:t2 . e:f2 a e:Firm ; e:title "Zed" ; e:town e:t2 . e:f3 a e:Firm .
e:t1 a e:Town ; e:title "Rome" . e:t2 a e:Town ; e:title "Oslo" .
"""


@pytest.fixture(scope="module")
def people(spark):
    return Engine(parse_shapes(load_shapes(SHAPES)), QuadSource.of(spark, parse(DATA)), strict=True)


def ask(engine, text, **context):
    variables = context.pop("variables", None)
    found = {k: [json.loads(r[0]) for r in df.collect()] for k, df in engine.json(text, variables, Context(**context)).items()}
    return {k: sorted(v, key=lambda x: json.dumps(x, sort_keys=True)) for k, v in found.items()}


@pytest.mark.parametrize(("text", "names"), [
    ("{ person { name } }", "Ann Bob Cid"),  # d has no name
    ("{ person(where: {age: {gt: 29}}) { name } }", "Ann Bob"),
    ("{ person(where: {age: {in: []}}) { name } }", "Ann Bob"),  # no filter, but it promotes
    ('{ person(where: {NOT: {firm: {name: {eq: "Acme"}}}}) { name } }', "Bob"),  # Cid has no firm
    ('{ person(where: {OR: [{age: {lt: 35}}, {tag: {eq: "q"}}]}) { name } }', "Ann"),
    ('{ person(where: {firm: {town: {name: {eq: "Oslo"}}}}) { name } }', "Ann Bob"),
    ("{ person(where: {state: {eq: OFF_LINE}}) { name } }", "Ann"),
    ('{ person(where: {iri: {endsWith: "/b"}}) { name } }', "Bob"),
    ("{ person(where: {knows: {}}) { name } }", "Ann Bob Cid"),
    ("{ person(where: null) { name } }", "Ann Bob Cid"),
    ('{ person(where: {rank: {eq: "none"}}) { name } }', "Ann Cid"),
    ("{ person(limit: 0) { name } }", ""),
    ("{ person(limit: 2, offset: 1) { name } }", "Bob Cid"),
    ("{ person(offset: 3) { name } }", ""),  # the page holds d, which lacks its name
    ('query($m: Int) { person(where: {age: {lt: $m}}) { name } }', "Ann"),
])
def test_filters_and_pages(people, text, names):
    found = ask(people, text, variables={"m": 40} if "$m" in text else None)["person"]
    assert sorted(x["name"] for x in found) == names.split()


def test_nesting_and_narrowing(people):
    full = {x["name"]: x for x in ask(people, "{ person { name tag firm { name town { name } } } }")["person"]}
    assert full["Ann"] == {"name": "Ann", "tag": ["x", "y"], "firm": {"name": "Acme", "town": [{"name": "Rome"}, {"name": "Oslo"}]}}
    assert full["Cid"] == {"name": "Cid", "tag": [], "firm": None}
    flat = ask(people, '{ person(where: {tag: {eq: "x"}, firm: {town: {name: {eq: "Oslo"}}}}) { tag firm { town { name } } } }')["person"]
    assert flat == [{"tag": ["x"], "firm": {"town": [{"name": "Oslo"}]}}]
    paged = ask(people, '{ person(where: {tag: {eq: "x"}, firm: {town: {name: {eq: "Oslo"}}}}, limit: 5) { tag firm { town { name } } } }')["person"]
    assert paged == [{"tag": ["x", "y"], "firm": {"town": [{"name": "Rome"}, {"name": "Oslo"}]}}]


def test_languages_cycles_names(people):
    by_name = {x["name"]: x["bio"] for x in ask(people, "{ person { name bio } }", lang_tags=("nl", "fr"))["person"]}
    assert by_name == {"Ann": "hoi", "Bob": "salut", "Cid": None}
    reach = {x["name"]: sorted(y["name"] for y in x["reach"]) for x in ask(people, "{ person { name reach { name } } }")["person"]}
    assert reach == {n: ["Ann", "Bob", "Cid"] for n in ("Ann", "Bob", "Cid")}
    assert ask(people, "{ p: person(limit: 1) { t: __typename i: iri } firm { name } }") == {"p": [{"t": "Person", "i": "http://e/a"}], "firm": [{"name": "Acme"}, {"name": "Zed"}]}


@pytest.mark.parametrize("text", [
    "{ nobody { name } }", "{ person { nothing } }", "{ person { firm } }", "{ person { name { x } } }", "{ person(where: {zip: {eq: 1}}) { name } }", "{ person(where: {age: {contains: \"1\"}}) { name } }",
    "{ person { ...F } }", "{ person(limit: -1) { name } }", "mutation { person { name } }", "{ person(where: {state: {eq: AWAY}}) { name } }", "{ person(where: {age: {eq: \"x\"}}) { name } }",
])
def test_bad_operations(people, text):
    with pytest.raises(OperationError):
        {k: df.collect() for k, df in people.execute(text).items()}
    with pytest.raises(NotImplementedError):
        people.execute("{ person { name } }", context=Context(write_graph="http://w"))


def test_named_graphs(spark):
    graph = parse(HEAD + 'e:x a e:Town ; e:title "Base" . e:g1 { e:y a e:Town ; e:title "One" . e:x a e:Town ; e:title "Base" } e:g2 { e:z a e:Town ; e:title "Two" }')
    registry = parse_shapes(load_shapes(SHAPES))
    names = lambda engine, *graphs: sorted(x["name"] for x in ask(engine, "{ town { name } }", read_graphs=graphs)["town"])
    union = Engine(registry, QuadSource.of(spark, graph))
    assert names(union) == ["Base", "One", "Two"] and names(union, "http://e/g1") == ["Base", "One"] and names(union, "http://e/g1", "http://e/g2") == ["Base", "One", "Two"]
    assert names(Engine(registry, QuadSource.of(spark, graph, "unnamed"))) == ["Base"]


def test_files(spark, tmp_path):
    (tmp_path / "a.nq").write_text('<http://e/s> <http://e/p> "a \\"b\\""@EN <http://e/g> .\n# note\n_:x <http://e/p> <http://e/o> .\n<http://e/s> <http://e/q> "5"^^<http://www.w3.org/2001/XMLSchema#int> .\n')
    rows = {(r.g, r.s, r.o.lex, r.o.lang, r.o.num) for r in read_ntriples(spark, str(tmp_path / "a.nq")).collect()}
    assert rows == {("http://e/g", "http://e/s", 'a "b"', "en", None), (None, "_:x", "http://e/o", None, None), (None, "http://e/s", "5", None, 5.0)}
    assert len(load_shapes(str(tmp_path)).quads) == 3
    (tmp_path / "r.json").write_text('{"head":{"vars":["x","y"]},"results":{"bindings":[{"x":{"type":"uri","value":"http://e/1"}},{"x":{"type":"literal","value":"7","datatype":"http://www.w3.org/2001/XMLSchema#integer"}}]}}')
    assert [(r.x.lex, r.x.num, r.y) for r in read_results_json(spark, str(tmp_path / "r.json")).collect()] == [("http://e/1", None, None), ("7", 7.0, None)]
    with pytest.raises(ValueError):
        load_shapes("http://e/shapes.ttl")


PROP = 'sh:property [ sh:path e:p ; sh:datatype xsd:string ; sh:maxCount 1 ]'


@pytest.mark.parametrize("body", [
    "e:S a sh:NodeShape ; sh:targetSubjectsOf e:p .", "e:S a sh:NodeShape ; sh:targetClass e:A , e:B .", "e:S a sh:NodeShape ; sh:property [ sh:path ( e:a ) ] .", 'e:S a sh:NodeShape ; sh:codeIdentifier "__x" .',
    "e:S a sh:NodeShape ; sh:property [ sh:path ( e:a e:b ) ] .", "e:S a sh:NodeShape ; sh:property [ sh:path e:a ; sh:values [ n:count e:x ] ; sh:datatype xsd:int ; sh:maxCount 1 ] .",
    "e:A a sh:NodeShape ; sh:node e:B . e:B a sh:NodeShape ; sh:node e:A .", "e:S a sh:NodeShape ; sh:targetClass e:A . e:T a sh:NodeShape ; sh:targetClass e:A .",
    "e:S a sh:NodeShape ; sh:property [ sh:path e:a ; sh:minCount 1.5 ] .", "e:S a sh:NodeShape ; sh:property [ sh:path e:a ; sh:datatype ( xsd:int xsd:string ) ] .",
    'e:S a sh:NodeShape ; sh:property [ sh:path e:a ; sh:datatype xsd:string ; sh:maxCount 1 ; sh:values "x" ] , [ sh:path e:b ; sh:datatype xsd:string ; sh:maxCount 1 ; sh:values [ n:if [ n:exists [ n:pathValues e:a ] ] ; n:then "y" ] ] .',
])
def test_bad_shapes(body):
    with pytest.raises(ShapeError):
        parse_shapes(parse(HEAD + body))


def test_inheritance_visibility_names():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        registry = parse_shapes(parse(HEAD + f"""
          e:Base a sh:NodeShape ; {PROP} . e:Sub a sh:NodeShape ; sh:targetClass e:Sub ; sh:node e:Base ; sh:property [ sh:path e:q ; sh:datatype xsd:int ] , [ sh:path e:gone ; sh:maxCount 0 ] , [ sh:path e:off ; sh:deactivated true ] .
          e:Hid a sh:NodeShape ; sh:targetClass e:Hid . e:Kid a sh:NodeShape ; sh:targetClass e:Kid . e:Kid rdfs:subClassOf e:Top . e:Api a g:Schema ; g:publicShape e:Sub , e:Hid , e:Base ; g:privateShape e:Hid ; g:publicClass e:Top ."""))
    assert list(registry.roots) == ["kid", "sub"] and list(registry.by_name["Sub"].fields) == ["p", "q"] and "Base" in registry.by_name and "Hid" not in registry.by_name
    assert list(enum_names(tuple(map(literal, ("<", "<=", "1st", "in-error"))))) == ["_", "_2", "_1ST", "IN_ERROR"]
    assert accept_language("nl;q=0.5, en-US, fr;q=0, *;q=0.1") == ("en-us", "nl", "*")
    assert parse_operation("{ a { b } a { c } }")[0].selection[1].name == "c"


EDGES = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=10)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(EDGES)
def test_paths_against_naive(spark, edges):
    from quadlake.sources.terms import iri

    graph = Graph([(None, iri(f"e:{a}"), "e:p", iri(f"e:{b}")) for a, b in edges] or [(None, iri("e:9"), "e:z", iri("e:9"))])
    source, p = QuadSource.of(spark, graph), ("pred", "e:p")
    seeds = spark.createDataFrame([(f"e:{k}", f"e:{k}") for k in range(6)], "root string, at string")
    step = set(edges)
    plus = set(step)
    while True:
        more = plus | {(a, d) for a, b in plus for c, d in step if b == c}
        if more == plus:
            break
        plus = more
    self_ = {(k, k) for k in range(6)}
    want = {"plus": plus, "star": plus | self_, "opt": step | self_, "inv": {(b, a) for a, b in step}}
    for kind, pairs_ in want.items():
        got = {(int(r.root[2:]), int(r.o.lex[2:])) for r in follow(source, seeds, (kind, p)).collect()}
        assert got == pairs_, kind


def test_envelope(people):
    def post(body, kind="application/json; charset=utf-8", **context):
        status, answer = respond(people, kind, body if isinstance(body, bytes) else json.dumps(body).encode(), Context(**context))
        return status, json.loads(answer)

    def wrong(message):
        return {"errors": [{"message": message}]}

    assert post({}, "text/plain") == (415, wrong("Unsupported Content-Type"))
    for body in (b"{", b"\xff", b'{"query": NaN}'):
        assert post(body) == (400, wrong("Invalid JSON"))
    assert post([1]) == (400, wrong("Request body must be a JSON object"))
    assert post({"query": 3, "variables": 3}) == (400, wrong("Missing or invalid query"))
    assert post({"query": "{ person { name } }", "variables": []}) == (400, wrong("Invalid variables"))
    assert post({"query": "{ person { name } }", "variables": None, "operationName": 1}) == (400, wrong("Invalid operationName"))
    two = "query One($n: Int) { person(limit: $n) { iri bio } town { name } } query Two { firm { name } }"
    status, answer = post({"query": two, "variables": {"n": 1}, "operationName": "One"}, lang_tags=("nl",))
    assert status == 200 and answer["data"]["person"] == [{"iri": "http://e/a", "bio": "hoi"}] and sorted(x["name"] for x in answer["data"]["town"]) == ["Oslo", "Rome"]
    assert post({"query": "{ person(limit: 0) { name } }"}) == (200, {"data": {"person": []}})
    for text in ("{ person { nothing } }", "{ person ", two, "mutation { x }"):
        status, answer = post({"query": text})
        assert status == 200 and answer["data"] is None and len(answer["errors"]) == 1


def test_an_error_when_run_has_no_data(spark):
    out = HEAD + "e:z a e:Person ; e:name \"Zoe\" ; e:state \"elsewhere\" ."
    engine = Engine(parse_shapes(load_shapes(SHAPES)), QuadSource.of(spark, parse(out)), strict=True)
    status, answer = respond(engine, "application/json", b'{"query": "{ person { state } }"}')
    assert status == 200 and json.loads(answer)["data"] is None and json.loads(answer)["errors"]


def test_explain(people):
    assert "Physical Plan" in people.explain("{ person { name } }")["person"]
