"""Fields that authors derive over the driver's tables, a family of functions or patterns in each query, and their SQL."""

from __future__ import annotations

from typing import NamedTuple


class Derived(NamedTuple):
    #: The shape that has it, its name, type, what it reads of $this, the expression, and that in SQL.
    shape: str
    name: str
    datatype: str
    reads: str
    text: str
    sql: str


_N, _B, _M = "q:cName ?n", "q:acctbal ?b", "q:mktsegment ?m"
_D, _P, _T = "q:orderdate ?d", "q:totalprice ?p", "q:text ?t"
_STAMP = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"

DERIVED = [
    Derived("Customer", "subLow", "string", _N, "SUBSTR(?n, 0, 5)", "substr(c_name, 1, 4)"),
    Derived("Customer", "subNegative", "string", _N, "SUBSTR(?n, -1)", "c_name"),
    Derived("Customer", "subMiddle", "string", _N, "SUBSTR(?n, 3, 4)", "substr(c_name, 3, 4)"),
    Derived("Customer", "before", "string", _N, "STRBEFORE(?n, '#')", "split_part(c_name, '#', 1)"),
    Derived("Customer", "after", "string", _N, "STRAFTER(?n, '#')", "split_part(c_name, '#', 2)"),
    Derived("Customer", "afterNothing", "string", _N, "STRAFTER(?n, 'none')", "''"),
    Derived("Customer", "joined", "string", f"{_N} ; {_M}", "CONCAT(LCASE(?m), '-', UCASE(?n))", "lower(c_mktsegment) || '-' || upper(c_name)"),
    Derived("Customer", "squeezed", "string", _N, "REPLACE(?n, '0+', '0')", "regexp_replace(c_name, '0+', '0', 'g')"),
    Derived("Customer", "encoded", "string", _N, "ENCODE_FOR_URI(?n)", "replace(c_name, '#', '%23')"),
    Derived("Customer", "nameLength", "integer", _N, "STRLEN(?n)", "CAST(length(c_name) AS BIGINT)"),
    Derived("Customer", "starts", "boolean", _N, "STRSTARTS(?n, 'Customer#00000000')", "starts_with(c_name, 'Customer#00000000')"),
    Derived("Customer", "ends", "boolean", _N, "STRENDS(?n, '7')", "ends_with(c_name, '7')"),
    Derived("Customer", "holds", "boolean", _N, "CONTAINS(?n, '01')", "contains(c_name, '01')"),
    Derived("Customer", "like", "boolean", _N, "REGEX(?n, '^CUSTOMER#0*[1-3]', 'i')", "regexp_matches(c_name, '^CUSTOMER#0*[1-3]', 'i')"),
    Derived("Customer", "among", "boolean", _M, "?m IN ('BUILDING', 'MACHINERY')", "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    Derived("Customer", "notAmong", "boolean", _M, "?m NOT IN ('BUILDING', 'MACHINERY')", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    Derived("Customer", "both", "boolean", f"{_B} ; {_M}", "?b > 0 && ?m = 'BUILDING'", "c_acctbal > 0 AND c_mktsegment = 'BUILDING'"),
    Derived("Customer", "either", "boolean", f"{_B} ; {_M}", "?b < 0 || !(?m != 'BUILDING')", "c_acctbal < 0 OR c_mktsegment = 'BUILDING'"),
    Derived("Customer", "absolute", "double", _B, "ABS(?b)", "abs(c_acctbal)"),
    Derived("Customer", "ceiling", "double", _B, "CEIL(?b)", "ceil(c_acctbal)"),
    Derived("Customer", "floored", "double", _B, "FLOOR(?b)", "floor(c_acctbal)"),
    Derived("Customer", "rounded", "double", _B, "ROUND(?b)", "floor(c_acctbal + 0.5)"),
    Derived("Customer", "computed", "double", _B, "?b * 2 - 1", "c_acctbal * 2 - 1"),
    Derived("Customer", "quarter", "double", _B, "?b / 4", "c_acctbal / 4"),
    Derived("Customer", "whole", "integer", _B, "xsd:integer(?b)", "CAST(trunc(c_acctbal) AS BIGINT)"),
    Derived("Customer", "third", "decimal", _N, "xsd:decimal(STRLEN(?n)) / 8", "CAST(length(c_name) AS DOUBLE) / 8"),
    Derived("Customer", "tenth", "decimal", _N, "0.1 + 0.2", "CAST(0.3 AS DOUBLE)"),
    Derived("Customer", "parsed", "integer", _N, "xsd:integer(STRAFTER(?n, '#')) + 9007199254740993", "CAST(split_part(c_name, '#', 2) AS BIGINT) + 9007199254740993"),
    Derived("Customer", "asDouble", "double", _N, "xsd:double(STRAFTER(?n, '#'))", "CAST(split_part(c_name, '#', 2) AS DOUBLE)"),
    Derived("Customer", "asFloat", "float", _B, "xsd:float('1.5')", "CAST(1.5 AS DOUBLE)"),
    Derived("Customer", "asBoolean", "boolean", _B, "xsd:boolean(?b)", "c_acctbal <> 0"),
    Derived("Customer", "asText", "string", _M, "xsd:string(?m)", "c_mktsegment"),
    Derived("Customer", "noNumber", "integer", _M, "xsd:integer(?m)", "CAST(NULL AS BIGINT)"),
    Derived("Customer", "isNode", "boolean", _N, "ISIRI($this) && ISLITERAL(?n) && !ISBLANK($this) && !ISNUMERIC(?n)", "true"),
    Derived("Customer", "typeOf", "string", _B, "STR(DATATYPE(?b))", "'http://www.w3.org/2001/XMLSchema#double'"),
    Derived("Customer", "made", "string", _M, "STR(IRI(CONCAT('urn:segment:', ?m)))", "'urn:segment:' || c_mktsegment"),
    Derived("Customer", "typed", "string", _M, "STR(DATATYPE(STRDT(?m, xsd:token)))", "'http://www.w3.org/2001/XMLSchema#token'"),
    Derived("Customer", "chosen", "string", f"{_B} ; {_M}", "IF(?b > 5000, ?m, 'poor')", "CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'poor' END"),
    Derived("Customer", "rescued", "string", f"{_B} ; {_M}", "COALESCE(1 / 0, IF(?b / 0 = ?b, 'never', ?m))", "c_mktsegment"),
    Derived("Customer", "same", "boolean", _M, "SAMETERM(?m, 'BUILDING') && BOUND(?m)", "c_mktsegment = 'BUILDING'"),
    Derived("Customer", "uuidLength", "integer", _N, "STRLEN(STRUUID()) + STRLEN(STR(UUID()))", "CAST(81 AS BIGINT)"),
    Derived("Customer", "chance", "boolean", _N, "RAND() >= 0 && RAND() < 1 && ISBLANK(BNODE(?n)) && YEAR(NOW()) > 2000", "true"),
    Derived("Customer", "md5", "string", _N, "MD5(?n)", "md5(c_name)"),
    Derived("Customer", "sha1", "string", _N, "SHA1(?n)", "sha1(c_name)"),
    Derived("Customer", "sha256", "string", _N, "SHA256(?n)", "sha256(c_name)"),
    Derived("Customer", "shaLengths", "integer", _N, "STRLEN(SHA384(?n)) + STRLEN(SHA512(?n))", "CAST(224 AS BIGINT)"),
    Derived("Order", "year", "integer", _D, "YEAR(?d)", "year(o_orderdate)"),
    Derived("Order", "month", "integer", _D, "MONTH(?d)", "month(o_orderdate)"),
    Derived("Order", "day", "integer", _D, "DAY(?d)", "day(o_orderdate)"),
    Derived("Order", "clock", "integer", _D, "HOURS(?d) * 60 + MINUTES(?d)", "hour(o_orderdate) * 60 + minute(o_orderdate)"),
    Derived("Order", "seconds", "decimal", _D, "SECONDS(STRDT(CONCAT(STR(?d), '.25'), xsd:dateTime))", "second(o_orderdate) + CAST(0.25 AS DOUBLE)"),
    Derived("Order", "zone", "string", _D, "CONCAT('[', TZ(?d), ']')", "'[]'"),
    Derived("Order", "offset", "string", _D, "STR(TIMEZONE(STRDT(CONCAT(STR(?d), '-05:30'), xsd:dateTime)))", "'-PT5H30M'"),
    Derived("Order", "localHour", "integer", _D, "HOURS(STRDT(CONCAT(STR(?d), '-05:00'), xsd:dateTime))", "hour(o_orderdate)"),
    Derived("Order", "dayOnly", "string", _D, "STR(xsd:date(?d))", "strftime(o_orderdate, '%Y-%m-%d')"),
    Derived("Order", "midnight", "string", _D, "STR(xsd:dateTime(xsd:date(?d)))", "strftime(o_orderdate, '%Y-%m-%dT00:00:00')"),
    Derived("Order", "late", "boolean", _D, "?d >= '1997-01-01T00:00:00'^^xsd:dateTime", "o_orderdate >= TIMESTAMP '1997-01-01'"),
    Derived("Order", "longer", "boolean", _D, "STRDT(CONCAT('P', STR(DAY(?d)), 'D'), xsd:dayTimeDuration) > 'P9D'^^xsd:dayTimeDuration", "day(o_orderdate) > 9"),
    Derived("Order", "earlier", "boolean", _D, "STRDT(STRAFTER(STR(?d), 'T'), xsd:time) < '12:00:00+02:00'^^xsd:time", "hour(o_orderdate) < 10"),
    Derived("Document", "langOf", "string", _T, "LANG(?t)", "lang"),
    Derived("Document", "tagKept", "string", _T, "LANG(SUBSTR(UCASE(?t), 1, 3))", "lang"),
    Derived("Document", "tagShared", "string", _T, "LANG(CONCAT(?t, ?t))", "lang"),
    Derived("Document", "tagLost", "string", _T, "LANG(CONCAT(?t, '!'))", "''"),
    Derived("Document", "tagBefore", "string", _T, "LANG(STRBEFORE(?t, ''))", "lang"),
    Derived("Document", "tagReplaced", "string", _T, "LANG(REPLACE(?t, 'zz+', 'z'))", "lang"),
    Derived("Document", "tagged", "boolean", _T, "HASLANG(?t) && LANGMATCHES(LANG(?t), '*') && !HASLANGDIR(?t)", "true"),
    Derived("Document", "english", "boolean", _T, "LANGMATCHES(LANG(?t), 'EN')", "lang = 'en'"),
    Derived("Document", "retagged", "string", _T, "CONCAT(LANG(STRLANG(STR(?t), 'NL')), '/', LANGDIR(STRLANGDIR('x', LANG(?t), 'rtl')), '/', LANG(STRLANGDIR('x', LANG(?t), 'rtl')))", "'nl/rtl/' || lang"),
]

#: Whole patterns: shape, name, type, and the body of SELECT ?x.
PATTERNS = [
    ("Customer", "lateBound", "string", "OPTIONAL { $this q:nothing ?x } $this q:cName ?x"),
    ("Customer", "secondChoice", "string", "$this q:cName ?n . OPTIONAL { $this q:nothing ?x } OPTIONAL { $this q:mktsegment ?x }"),
    ("Customer", "listed", "string", "$this q:mktsegment ?x . VALUES (?x ?m) { (UNDEF 'a') ('BUILDING' UNDEF) } FILTER(BOUND(?m))"),
    ("Customer", "unlisted", "string", "VALUES (?m ?x) { ('BUILDING' 'b') (UNDEF 'any') ('MACHINERY' 'm') } $this q:mktsegment ?m . FILTER(?x != 'any')"),
    ("Customer", "frequent", "integer", "{ SELECT $this (COUNT(?o) AS ?x) WHERE { ?o q:customer $this } GROUP BY $this HAVING (COUNT(?o) > 10) }"),
    ("Customer", "priorities", "string", "{ SELECT $this (GROUP_CONCAT(DISTINCT ?p ; SEPARATOR='|') AS ?x) WHERE { ?o q:customer $this ; q:priority ?p } GROUP BY $this }"),
    ("Customer", "mean", "double", "{ SELECT $this (AVG(?p) AS ?x) WHERE { ?o q:customer $this ; q:totalprice ?p } GROUP BY $this }"),
    ("Customer", "largest", "double", "{ SELECT $this (MAX(?p) AS ?x) WHERE { ?o q:customer $this ; q:totalprice ?p } GROUP BY $this }"),
    ("Customer", "smallest", "double", "{ SELECT $this (MIN(?p) AS ?x) WHERE { ?o q:customer $this ; q:totalprice ?p } GROUP BY $this }"),
    ("Customer", "kinds", "integer", "{ SELECT $this (COUNT(DISTINCT ?p) AS ?x) WHERE { ?o q:customer $this ; q:priority ?p } GROUP BY $this }"),
    ("Customer", "topFive", "double", "{ SELECT $this (?b AS ?x) WHERE { $this q:acctbal ?b } ORDER BY DESC(?b) LIMIT 5 }"),
    ("Customer", "nextFive", "double", "{ SELECT $this (?b AS ?x) WHERE { $this q:acctbal ?b } ORDER BY ?b OFFSET 5 LIMIT 5 }"),
    ("Customer", "sumSizes", "integer", "{ SELECT $this (SUM(STRLEN(?p)) AS ?x) WHERE { ?o q:customer $this ; q:priority ?p } GROUP BY $this }"),
]


def shapes(shape: str) -> str:
    """The properties of a shape, as Turtle; empty or begun by a comma."""
    out = ""
    for x in DERIVED:
        if x.shape == shape:
            out += f' , [ sh:path q:{x.name} ; sh:datatype xsd:{x.datatype} ; sh:maxCount 1 ; sh:values [ sh:prefixes q:prefixes ; sh:select """SELECT ?x WHERE {{ $this {x.reads} . BIND({x.text} AS ?x) }}""" ] ]'
    for of, name, datatype, body in PATTERNS:
        if of == shape:
            out += f' , [ sh:path q:{name} ; sh:datatype xsd:{datatype} ; sh:maxCount 1 ; sh:values [ sh:prefixes q:prefixes ; sh:select """SELECT ?x WHERE {{ {body} }}""" ] ]'
    return out


def family(shape: str, table: str, key: str, names: str) -> tuple[str, str]:
    """An operation that asks for these fields, and its SQL."""
    known = {(x.shape, x.name): x.sql for x in DERIVED}
    columns = ", ".join(f"{known[shape, n]} AS {n}" for n in names.split())
    return f"{{ {shape.lower()} {{ iri {names} }} }}", f"SELECT 'urn:{shape.lower()}:' || {key} AS iri, {columns} FROM {table}"


_CUSTOMER, _ORDER, _DOCUMENT = ("Customer", "customer", "c_custkey"), ("Order", "orders", "o_orderkey"), ("Document", "documents WHERE text IS NOT NULL", "doc_id")
_PER = "SELECT 'urn:customer:' || c_custkey AS iri, {} FROM customer LEFT JOIN (SELECT o_custkey, {} FROM orders GROUP BY 1) ON o_custkey = c_custkey"

#: Operations and their SQL, by name.
OPERATIONS: dict[str, tuple[str, str]] = {
    "fn_substrings": family(*_CUSTOMER, "subLow subNegative subMiddle before after afterNothing"),
    "fn_strings": family(*_CUSTOMER, "joined squeezed encoded nameLength"),
    "fn_string_tests": family(*_CUSTOMER, "starts ends holds like"),
    "exp_logic": family(*_CUSTOMER, "among notAmong both either"),
    "fn_numbers": family(*_CUSTOMER, "absolute ceiling floored rounded"),
    "exp_arithmetic": family(*_CUSTOMER, "computed quarter third tenth parsed"),
    "fn_casts": family(*_CUSTOMER, "whole asDouble asFloat asBoolean asText noNumber"),
    "fn_terms": family(*_CUSTOMER, "isNode typeOf made typed same"),
    "fn_control": family(*_CUSTOMER, "chosen rescued uuidLength chance"),
    "fn_hashes": family(*_CUSTOMER, "md5 sha1 sha256 shaLengths"),
    "fn_date_parts": family(*_ORDER, "year month day clock seconds"),
    "fn_zones": family(*_ORDER, "zone offset localHour dayOnly midnight"),
    "exp_temporal_order": family(*_ORDER, "late longer earlier"),
    "fn_languages": family(*_DOCUMENT, "langOf tagged english retagged"),
    "fn_tags_kept": family(*_DOCUMENT, "tagKept tagShared tagLost tagBefore tagReplaced"),
    "pat_unbound": ("{ customer { iri lateBound secondChoice } }", "SELECT 'urn:customer:' || c_custkey AS iri, c_name AS lateBound, c_mktsegment AS secondChoice FROM customer"),
    "pat_undef": ("{ customer { iri listed unlisted } }", "SELECT 'urn:customer:' || c_custkey AS iri, c_mktsegment AS listed, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS unlisted FROM customer"),
    "agg_having": ("{ customer { iri frequent kinds sumSizes } }", _PER.format("CASE WHEN n > 10 THEN n END AS frequent, kinds, sumSizes", "count(*) AS n, count(DISTINCT o_orderpriority) AS kinds, CAST(sum(length(o_orderpriority)) AS BIGINT) AS sumSizes")),
    "agg_functions": ("{ customer { iri mean largest smallest priorities } }", _PER.format("mean, largest, smallest, priorities", "avg(o_totalprice) AS mean, max(o_totalprice) AS largest, min(o_totalprice) AS smallest, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities")),
    "select_modifiers": ("{ customer { iri topFive nextFive } }", "SELECT 'urn:customer:' || c_custkey AS iri, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC LIMIT 5) THEN c_acctbal END AS topFive, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal LIMIT 5 OFFSET 5) THEN c_acctbal END AS nextFive FROM customer"),
}
