"""The driver's tables as a shape-described graph, and a session-independent way to open them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.graphs import Entity, MappedSource, QuadSource
from ..sources.load import load_shapes
from ..sources.storage import new_folder
from ..sources.terms import LANGUAGE, XSD
from ..sources.turtle import Graph
from . import author
from .engine import Engine
from .shapes import Registry, parse_shapes

Q = "http://tables.example/"
_S, _I, _D, _T = XSD + "string", XSD + "long", XSD + "double", XSD + "dateTime"

SHAPES = f"""
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix shnex: <http://www.w3.org/ns/shacl-node-expr#> . @prefix q: <http://tables.example/> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
q:prefixes sh:declare [ sh:prefix "q" ; sh:namespace "http://tables.example/" ] , [ sh:prefix "xsd" ; sh:namespace "http://www.w3.org/2001/XMLSchema#" ] .
q:RegionShape a sh:NodeShape ; sh:codeIdentifier "Region" ; sh:targetClass q:Region ;
  sh:property [ sh:path q:rName ; sh:codeIdentifier "name" ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path [ sh:inversePath q:region ] ; sh:codeIdentifier "nations" ; sh:class q:Nation ] .
q:NationShape a sh:NodeShape ; sh:codeIdentifier "Nation" ; sh:targetClass q:Nation ;
  sh:property [ sh:path q:nName ; sh:codeIdentifier "name" ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:region ; sh:class q:Region ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path ( q:region q:rName ) ; sh:codeIdentifier "regionName" ; sh:datatype xsd:string ; sh:maxCount 1 ] ,
    [ sh:path [ sh:inversePath q:cNation ] ; sh:codeIdentifier "customers" ; sh:class q:Customer ] ,
    [ sh:path [ sh:inversePath q:sNation ] ; sh:codeIdentifier "suppliers" ; sh:class q:Supplier ] .
q:CustomerShape a sh:NodeShape ; sh:codeIdentifier "Customer" ; sh:targetClass q:Customer ;
  sh:property [ sh:path q:cName ; sh:codeIdentifier "name" ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:acctbal ; sh:datatype xsd:double ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:mktsegment ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:cNation ; sh:codeIdentifier "nation" ; sh:class q:Nation ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path ( q:cNation q:region q:rName ) ; sh:codeIdentifier "regionName" ; sh:datatype xsd:string ; sh:maxCount 1 ] ,
    [ sh:path [ sh:inversePath q:customer ] ; sh:codeIdentifier "orders" ; sh:class q:Order ] ,
    [ sh:path q:source ; sh:codeIdentifier "origin" ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ; sh:values "tables" ] ,
    [ sh:path q:badges ; sh:datatype xsd:string ; sh:values ( "known" "mapped" ) ] ,
    [ sh:path q:iriLength ; sh:datatype xsd:integer ; sh:minCount 1 ; sh:maxCount 1 ; sh:values [ sh:sparqlExpr "STRLEN(STR($this))" ] ] ,
    [ sh:path q:hasUrgent ; sh:datatype xsd:boolean ; sh:minCount 1 ; sh:maxCount 1 ; sh:values [ shnex:exists [
        shnex:nodes [ shnex:pathValues [ sh:inversePath q:customer ] ] ; shnex:filterShape [ sh:property [ sh:path q:priority ; sh:hasValue "1-URGENT" ] ] ] ] ] ,
    [ sh:path q:standing ; sh:datatype xsd:string ; sh:in ( "urgent" "calm" ) ; sh:minCount 1 ; sh:maxCount 1 ; sh:values [ shnex:if [ shnex:exists [
        shnex:nodes [ shnex:pathValues [ sh:inversePath q:customer ] ] ; shnex:filterShape [ sh:property [ sh:path q:priority ; sh:hasValue "1-URGENT" ] ] ] ] ;
        shnex:then "urgent" ; shnex:else "calm" ] ] ,
    [ sh:path q:label ; sh:datatype xsd:string ; sh:maxCount 1 ; sh:values [ sh:prefixes q:prefixes ;
        sh:select "SELECT ?l WHERE {{ $this q:cName ?n . $this q:mktsegment ?m . BIND(CONCAT(UCASE(?n), '/', ?m) AS ?l) }}" ] ] ,
    [ sh:path q:calmName ; sh:datatype xsd:string ; sh:maxCount 1 ; sh:values [ sh:prefixes q:prefixes ;
        sh:select "SELECT ?n WHERE {{ $this q:cName ?n . FILTER NOT EXISTS {{ ?o q:customer $this . ?o q:priority '1-URGENT' }} }}" ] ] ,
    [ sh:path q:spent ; sh:datatype xsd:double ; sh:maxCount 1 ; sh:values [ sh:prefixes q:prefixes ;
        sh:select "SELECT ?t WHERE {{ {{ SELECT ?this (SUM(?p) AS ?t) WHERE {{ ?o q:customer ?this . ?o q:totalprice ?p }} GROUP BY ?this }} }}" ] ] ,
    [ sh:path q:openBig ; sh:class q:Order ; sh:values [ shnex:nodes [ shnex:pathValues [ sh:inversePath q:customer ] ] ;
        shnex:filterShape [ sh:property [ sh:path q:status ; sh:hasValue "O" ] , [ sh:path q:totalprice ; sh:minInclusive 200000 ] ] ] ]{author.shapes("Customer")} .
q:SupplierShape a sh:NodeShape ; sh:codeIdentifier "Supplier" ; sh:targetClass q:Supplier ;
  sh:property [ sh:path q:sName ; sh:codeIdentifier "name" ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:sAcctbal ; sh:codeIdentifier "acctbal" ; sh:datatype xsd:double ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:sNation ; sh:codeIdentifier "nation" ; sh:class q:Nation ; sh:minCount 1 ; sh:maxCount 1 ] .
q:PartShape a sh:NodeShape ; sh:codeIdentifier "Part" ; sh:targetClass q:Part ;
  sh:property [ sh:path q:pName ; sh:codeIdentifier "name" ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:brand ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path q:size ; sh:datatype xsd:int ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:retailprice ; sh:datatype xsd:double ; sh:minCount 1 ; sh:maxCount 1 ] .
q:SizedShape a sh:NodeShape ; sh:codeIdentifier "SizedPart" ; sh:targetNode [ shnex:instancesOf q:Sized ] ;
  sh:property [ sh:path q:pName ; sh:codeIdentifier "name" ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] .
q:FewSizedShape a sh:NodeShape ; sh:codeIdentifier "FewSized" ; sh:targetNode [ shnex:nodes [ shnex:instancesOf q:Sized ] ;
    shnex:filterShape [ sh:property [ sh:path q:size ; sh:maxExclusive 10 ] , [ sh:path q:brand ; sh:pattern "brand#1" ; sh:flags "i" ] ] ] ;
  sh:property [ sh:path q:size ; sh:datatype xsd:int ; sh:minCount 1 ; sh:maxCount 1 ] .
q:OrderShape a sh:NodeShape ; sh:codeIdentifier "Order" ; sh:targetClass q:Order ;
  sh:property [ sh:path q:status ; sh:datatype xsd:string ; sh:in ( "F" "O" "P" ) ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:totalprice ; sh:datatype xsd:double ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path q:orderdate ; sh:datatype xsd:dateTime ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:priority ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path q:customer ; sh:class q:Customer ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:nationName ; sh:datatype xsd:string ; sh:maxCount 1 ; sh:values [ shnex:pathValues ( q:customer q:cNation q:nName ) ] ] ,
    [ sh:path [ sh:inversePath q:order ] ; sh:codeIdentifier "lines" ; sh:class q:Lineitem ]{author.shapes("Order")} .
q:ShippedOrderShape a sh:NodeShape ; sh:codeIdentifier "ShippedOrder" ; sh:targetNode [ shnex:pathValues [ sh:inversePath rdf:type ] ; shnex:focusNode q:Order ] ;
  sh:property [ sh:path [ sh:inversePath q:order ] ; sh:codeIdentifier "lines" ; sh:class q:Lineitem ; sh:minCount 1 ] .
q:LineShape a sh:NodeShape ; sh:codeIdentifier "Lineitem" ; sh:targetClass q:Lineitem ;
  sh:property [ sh:path q:quantity ; sh:datatype xsd:double ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path q:extendedprice ; sh:datatype xsd:double ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:returnflag ; sh:datatype xsd:string ; sh:in ( "A" "N" "R" ) ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path q:order ; sh:class q:Order ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:part ; sh:class q:Part ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path q:supplier ; sh:class q:Supplier ; sh:minCount 1 ; sh:maxCount 1 ] .
q:EventShape a sh:NodeShape ; sh:codeIdentifier "Event" ; sh:targetClass q:Event ;
  sh:property [ sh:path q:ts ; sh:datatype xsd:dateTime ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path q:eventType ; sh:codeIdentifier "type" ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path q:value ; sh:datatype xsd:double ; sh:minCount 1 ; sh:maxCount 1 ] .
q:DocumentShape a sh:NodeShape ; sh:codeIdentifier "Document" ; sh:targetClass q:Document ;
  sh:property [ sh:path q:text ; sh:datatype rdf:langString ; sh:maxCount 1 ] , [ sh:path q:nChars ; sh:datatype xsd:long ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path [ sh:inversePath q:document ] ; sh:codeIdentifier "label" ; sh:class q:Label ; sh:maxCount 1 ] ,
    [ sh:path q:quality ; sh:datatype xsd:int ; sh:maxCount 1 ; sh:defaultValue -1 ; sh:values [ shnex:pathValues ( [ sh:inversePath q:document ] q:labelQuality ) ] ]{author.shapes("Document")} .
q:LabelShape a sh:NodeShape ; sh:codeIdentifier "Label" ; sh:targetClass q:Label ;
  sh:property [ sh:path q:labelQuality ; sh:codeIdentifier "quality" ; sh:datatype xsd:int ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path q:toxic ; sh:datatype xsd:int ; sh:minCount 1 ; sh:maxCount 1 ] .
q:SourceShape a sh:NodeShape ; sh:codeIdentifier "Source" ; sh:targetClass q:Source ;
  sh:property [ sh:path ( [ sh:inversePath q:from ] q:text ) ; sh:codeIdentifier "sample" ; sh:datatype rdf:langString ; sh:maxCount 1 ] ,
    [ sh:path ( [ sh:inversePath q:from ] q:text ) ; sh:codeIdentifier "needed" ; sh:datatype rdf:langString ; sh:minCount 1 ; sh:maxCount 1 ] ,
    [ sh:path ( [ sh:inversePath q:from ] q:text ) ; sh:codeIdentifier "texts" ; sh:datatype rdf:langString ] .
q:TurnShape a sh:NodeShape ; sh:codeIdentifier "Turn" ; sh:targetClass q:Turn ;
  sh:property [ sh:path q:role ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path q:next ; sh:class q:Turn ; sh:maxCount 1 ] ,
    [ sh:path [ sh:oneOrMorePath q:next ] ; sh:codeIdentifier "later" ; sh:class q:Turn ] , [ sh:path [ sh:zeroOrMorePath q:next ] ; sh:codeIdentifier "selfAndLater" ; sh:class q:Turn ] ,
    [ sh:path [ sh:zeroOrOnePath q:next ] ; sh:codeIdentifier "selfAndNext" ; sh:class q:Turn ] .
q:PageShape a sh:NodeShape ; sh:codeIdentifier "Page" ; sh:targetClass q:Page ; sh:property [ sh:path q:url ; sh:datatype xsd:anyURI ; sh:minCount 1 ; sh:maxCount 1 ] .
q:AccountShape a sh:NodeShape ; sh:codeIdentifier "Account" ; sh:targetNode [ sh:prefixes q:prefixes ; sh:select "SELECT ?x WHERE {{ {{ ?x a q:Customer }} UNION {{ ?x a q:Supplier }} }}" ] ;
  sh:property [ sh:path [ sh:alternativePath ( q:cNation q:sNation ) ] ; sh:codeIdentifier "nation" ; sh:class q:Nation ; sh:minCount 1 ; sh:maxCount 1 ] .
"""

#: The class tree over part types: a fixed part of the graph view.
TREE = """
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix q: <http://tables.example/> .
<http://tables.example/type:SMALL> rdfs:subClassOf q:Compact . <http://tables.example/type:MEDIUM> rdfs:subClassOf q:Bulky . <http://tables.example/type:LARGE> rdfs:subClassOf q:Bulky .
q:Compact rdfs:subClassOf q:Sized . q:Bulky rdfs:subClassOf q:Sized .
"""


def _columns(**given: tuple[str, str]) -> dict[str, tuple[str, str]]:
    return {Q + k: v for k, v in given.items()}


ENTITIES = [
    Entity("region", "region", ("r_regionkey",), (Q + "Region",), _columns(rName=("r_name", _S)), graph=Q + "g:geo"),
    Entity("nation", "nation", ("n_nationkey",), (Q + "Nation",), _columns(nName=("n_name", _S)), {Q + "region": (("n_regionkey",), "region")}, graph=Q + "g:geo"),
    Entity("customer", "customer", ("c_custkey",), (Q + "Customer",), _columns(cName=("c_name", _S), acctbal=("c_acctbal", _D), mktsegment=("c_mktsegment", _S)), {Q + "cNation": (("c_nationkey",), "nation")}, graph=Q + "g:sales"),
    Entity("supplier", "supplier", ("s_suppkey",), (Q + "Supplier",), _columns(sName=("s_name", _S), sAcctbal=("s_acctbal", _D)), {Q + "sNation": (("s_nationkey",), "nation")}, graph=Q + "g:sales"),
    Entity("part", "part", ("p_partkey",), (Q + "Part",), _columns(pName=("p_name", _S), brand=("p_brand", _S), size=("p_size", XSD + "int"), retailprice=("p_retailprice", _D)), class_column=(Q + "type:", "p_type"), graph=Q + "g:sales"),
    Entity("order", "orders", ("o_orderkey",), (Q + "Order",), _columns(status=("o_orderstatus", _S), totalprice=("o_totalprice", _D), orderdate=("o_orderdate", _T), priority=("o_orderpriority", _S)), {Q + "customer": (("o_custkey",), "customer")}, graph=Q + "g:sales"),
    # Two columns are no key of lineitem; these four are.
    Entity("line", "lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), (Q + "Lineitem",), _columns(quantity=("l_quantity", _D), extendedprice=("l_extendedprice", _D), returnflag=("l_returnflag", _S)),
           {Q + "order": (("l_orderkey",), "order"), Q + "part": (("l_partkey",), "part"), Q + "supplier": (("l_suppkey",), "supplier")}, graph=Q + "g:sales"),
    Entity("event", "events", ("event_id",), (Q + "Event",), _columns(ts=("ts", _T), eventType=("event_type", _S), value=("value", _D))),
    Entity("document", "documents", ("doc_id",), (Q + "Document",), _columns(text=("text", LANGUAGE[0]), nChars=("n_chars", _I)), {Q + "from": (("source",), "source")}, language={Q + "text": "lang"}),
    Entity("label", "labels", ("doc_id",), (Q + "Label",), _columns(labelQuality=("quality", XSD + "int"), toxic=("toxic", XSD + "int")), {Q + "document": (("doc_id",), "document")}),
    Entity("source", "sources", ("source",), (Q + "Source",)),
    Entity("turn", "turns", ("conv_id", "turn"), (Q + "Turn",), _columns(role=("role", _S)), {Q + "next": (("conv_id", "next_turn"), "turn")}),
    Entity("page", "pages", ("page_id",), (Q + "Page",), _columns(url=("url", XSD + "anyURI"))),
]

_registry: list[Registry] = []


def registry() -> Registry:
    if not _registry:
        _registry.append(parse_shapes(load_shapes(SHAPES)))
    return _registry[0]


class Tables(dict):
    """Tables by name, opened when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        read = lambda n: self.spark.read.parquet(f"{self.sf_dir}/{n}.parquet")
        if name == "sources":
            made = read("documents").select("source").where("source is not null").distinct()
        elif name == "turns":
            made = read("conversations").withColumn("next_turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
        else:
            made = read(name)
        self[name] = made
        return made


_loaded: dict[tuple[str, str], str] = {}


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as quads: loaded once a session into a Parquet table of the shared folder, a folder for each predicate,
    each triple once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        tables, out = Tables(spark, sf_dir), []
        for e in ENTITIES:
            one = MappedSource(spark, tables, [e])
            out += [one.pairs(p).select(F.lit(e.graph).cast("string").alias("g"), "s", "o", F.lit(p).alias("p")) for p in one.predicates()]
        every = out[0]
        for x in out[1:]:
            every = every.union(x)
        path = new_folder(spark, "quads")
        # Rows of a key that is repeated say some things twice.
        every.distinct().write.partitionBy("p").parquet(path)
        _loaded[key] = path
    return spark.read.parquet(_loaded[key]).select("g", "s", "p", "o")


def engine(spark: SparkSession, sf_dir: str, tree: bool = False, as_quads: bool = False) -> Engine:
    """An engine over the tables in a folder, mapped or loaded as quads; with the class tree where part types matter."""
    extra: Graph | None = load_shapes(TREE) if tree else None
    if as_quads:
        held = quads(spark, sf_dir)
        if extra is not None:
            held = held.unionByName(QuadSource.of(spark, extra).quads)
        return Engine(registry(), QuadSource(held, unique=True))
    return Engine(registry(), MappedSource(spark, Tables(spark, sf_dir), ENTITIES, extra))
