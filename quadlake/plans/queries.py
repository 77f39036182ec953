"""Queries over the driver's tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import author
from .engine import Context
from .tables import Q, engine


@dataclass(frozen=True)
class Case:
    operation: str
    sql: str
    #: A list field to unfold: a row for each of its elements; outer keeps entities without any.
    unfold: str | None = None
    outer: bool = False
    context: Context = Context()
    tree: bool = False

    def run(self, spark: SparkSession, sf_dir: str, as_quads: bool = False) -> DataFrame:
        (df,) = engine(spark, sf_dir, self.tree, as_quads).execute(self.operation, context=self.context).values()
        if self.unfold:
            df = df.withColumn("item", (F.explode_outer if self.outer else F.explode)(self.unfold)).drop(self.unfold)
        return flat(df)


def flat(df: DataFrame, prefix: str = "") -> DataFrame:
    """Struct columns as columns named for their path."""
    while any(f.dataType.typeName() == "struct" for f in df.schema.fields):
        columns = []
        for f in df.schema.fields:
            if f.dataType.typeName() == "struct":
                columns += [F.col(f"`{f.name}`.`{x.name}`").alias(f"{f.name}_{x.name}") for x in f.dataType.fields]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(*columns)
    return df


_CUST, _ORD, _DOC = "'urn:customer:' || c_custkey AS iri", "'urn:order:' || o_orderkey AS iri", "'urn:document:' || doc_id AS iri"
_URGENT = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"
_DATE = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"
_RANKED = "SELECT source, arg_min(text, {rank} || text) AS sample FROM documents WHERE {test} GROUP BY source"
_FR_EN = "CASE lang WHEN 'fr' THEN '0' ELSE '1' END"

CASES: dict[str, Case] = {
    "target_scan": Case("{ nation { iri name } }", "SELECT 'urn:nation:' || n_nationkey AS iri, n_name AS name FROM nation"),
    "scalar_eq": Case('{ customer(where: {mktsegment: {eq: "BUILDING"}}) { iri name acctbal } }', f"SELECT {_CUST}, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "scalar_neq": Case('{ customer(where: {mktsegment: {neq: "BUILDING"}}) { iri mktsegment } }', f"SELECT {_CUST}, c_mktsegment AS mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "scalar_range": Case("{ order(where: {totalprice: {gte: 100000, lt: 200000.5}}) { iri totalprice } }", f"SELECT {_ORD}, o_totalprice AS totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000.5"),
    "scalar_bounds": Case("{ part(where: {size: {gt: 10, lte: 20}}) { iri size } }", "SELECT 'urn:part:' || p_partkey AS iri, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size > 10 AND p_size <= 20"),
    "in_not_in": Case('{ order(where: {priority: {in: ["1-URGENT", "2-HIGH", "5-LOW"], notIn: ["2-HIGH"]}}) { iri priority } }', f"SELECT {_ORD}, o_orderpriority AS priority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "empty_in_is_no_filter": Case("{ nation(where: {name: {in: []}}) { iri name } }", "SELECT 'urn:nation:' || n_nationkey AS iri, n_name AS name FROM nation"),
    "string_contains": Case('{ part(where: {name: {contains: "ring"}}) { iri name } }', "SELECT 'urn:part:' || p_partkey AS iri, p_name AS name FROM part WHERE contains(p_name, 'ring')"),
    "string_starts": Case('{ part(where: {brand: {startsWith: "Brand#1"}}) { iri brand } }', "SELECT 'urn:part:' || p_partkey AS iri, p_brand AS brand FROM part WHERE starts_with(p_brand, 'Brand#1')"),
    "string_ends": Case('{ part(where: {brand: {endsWith: "2"}}) { iri brand } }', "SELECT 'urn:part:' || p_partkey AS iri, p_brand AS brand FROM part WHERE ends_with(p_brand, '2')"),
    "string_regex": Case('{ customer(where: {name: {regex: "[02468]$"}}) { iri name } }', f"SELECT {_CUST}, c_name AS name FROM customer WHERE regexp_matches(c_name, '[02468]$')"),
    "iri_filter": Case('{ customer(where: {iri: {startsWith: "urn:customer:1"}}) { iri name } }', "SELECT * FROM (SELECT 'urn:customer:' || c_custkey AS iri, c_name AS name FROM customer) WHERE starts_with(iri, 'urn:customer:1')"),
    "iri_eq_in": Case('{ customer(where: {OR: [{iri: {eq: "urn:customer:3"}}, {iri: {in: ["urn:customer:5", "urn:customer:7"]}}]}) { iri name } }', f"SELECT {_CUST}, c_name AS name FROM customer WHERE c_custkey IN (3, 5, 7)"),
    "enum_filter": Case("{ order(where: {status: {in: [F, P]}}) { iri status } }", f"SELECT {_ORD}, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "temporal_filter": Case('{ order(where: {orderdate: {gte: "1997-01-01T00:00:00"}}) { iri orderdate } }', f"SELECT {_ORD}, {_DATE} AS orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"),
    "boolean_filter": Case("{ customer(where: {hasUrgent: {eq: false}}) { iri hasUrgent } }", f"SELECT {_CUST}, false AS hasUrgent FROM customer WHERE NOT {_URGENT}"),
    "and_or_not": Case('{ order(where: {OR: [{totalprice: {gt: 300000}}, {AND: [{status: {eq: F}}, {NOT: {priority: {eq: "1-URGENT"}}}]}]}) { iri status totalprice } }',
                       f"SELECT {_ORD}, o_orderstatus AS status, o_totalprice AS totalprice FROM orders WHERE o_totalprice > 300000 OR (o_orderstatus = 'F' AND NOT o_orderpriority = '1-URGENT')"),
    "relationship_filter": Case("{ customer(where: {orders: {totalprice: {gt: 250000}}}) { iri name } }", f"SELECT {_CUST}, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)"),
    "not_relationship": Case("{ document(where: {NOT: {label: {toxic: {eq: 1}}}}) { iri nChars } }", f"SELECT 'urn:document:' || d.doc_id AS iri, n_chars AS nChars FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE NOT l.toxic = 1"),
    "or_relationship_promotion": Case("{ document(where: {OR: [{label: {quality: {eq: 1}}}, {nChars: {lt: 100}}]}) { iri nChars } }", "SELECT 'urn:document:' || d.doc_id AS iri, n_chars AS nChars FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 OR n_chars < 100"),
    "nested_relationship_filter": Case('{ customer(where: {nation: {region: {name: {eq: "ASIA"}}}}) { iri name } }', f"SELECT {_CUST}, c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'"),
    "optional_left": Case("{ document { iri label { quality toxic } } }", "SELECT 'urn:document:' || d.doc_id AS iri, CAST(l.quality AS BIGINT) AS label_quality, CAST(l.toxic AS BIGINT) AS label_toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "required_children": Case("{ shippedOrder { iri lines { quantity } } }", "SELECT 'urn:order:' || l_orderkey AS iri, l_quantity AS item_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)", unfold="lines"),
    "nested_struct": Case("{ customer { iri nation { name region { name } } } }", f"SELECT {_CUST}, n_name AS nation_name, r_name AS nation_region_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "nested_list": Case("{ customer { iri orders { iri totalprice } } }", "SELECT 'urn:customer:' || c_custkey AS iri, 'urn:order:' || o_orderkey AS item_iri, o_totalprice AS item_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey", unfold="orders", outer=True),
    "path_sequence": Case("{ customer { iri regionName } }", f"SELECT {_CUST}, r_name AS regionName FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "path_inverse": Case("{ region { name nations { name } } }", "SELECT r_name AS name, n_name AS item_name FROM region JOIN nation ON n_regionkey = r_regionkey", unfold="nations"),
    "path_alternative": Case("{ account { iri nation { name } } }", "SELECT 'urn:customer:' || c_custkey AS iri, n_name AS nation_name FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'urn:supplier:' || s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey"),
    "path_optional": Case("{ turn { iri selfAndNext { iri } } }", "WITH t AS (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) SELECT 'urn:turn:' || conv_id || ':' || turn AS iri, 'urn:turn:' || conv_id || ':' || turn AS item_iri FROM t UNION ALL SELECT 'urn:turn:' || conv_id || ':' || turn, 'urn:turn:' || conv_id || ':' || nxt FROM t WHERE nxt IS NOT NULL", unfold="selfAndNext"),
    "path_plus": Case("{ turn { iri later { iri } } }", "SELECT 'urn:turn:' || a.conv_id || ':' || a.turn AS iri, 'urn:turn:' || b.conv_id || ':' || b.turn AS item_iri FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn", unfold="later"),
    "path_star": Case("{ turn { iri selfAndLater { iri } } }", "SELECT 'urn:turn:' || a.conv_id || ':' || a.turn AS iri, 'urn:turn:' || b.conv_id || ':' || b.turn AS item_iri FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn >= a.turn", unfold="selfAndLater"),
    "page": Case("{ customer(limit: 20) { iri name } }", f"SELECT {_CUST}, c_name AS name FROM customer ORDER BY iri LIMIT 20"),
    "page_offset": Case("{ customer(limit: 15, offset: 30) { iri name } }", f"SELECT {_CUST}, c_name AS name FROM customer ORDER BY iri LIMIT 15 OFFSET 30"),
    "page_filtered": Case('{ customer(where: {mktsegment: {eq: "MACHINERY"}}, limit: 10) { iri acctbal } }', f"SELECT {_CUST}, c_acctbal AS acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY iri LIMIT 10"),
    "flat_narrows": Case("{ customer(where: {orders: {totalprice: {gt: 250000}}}) { iri orders { iri totalprice } } }", "SELECT 'urn:customer:' || o_custkey AS iri, 'urn:order:' || o_orderkey AS item_iri, o_totalprice AS item_totalprice FROM orders WHERE o_totalprice > 250000", unfold="orders"),
    "page_does_not_narrow": Case("{ customer(where: {orders: {totalprice: {gt: 250000}}}, limit: 10) { iri orders { iri totalprice } } }",
                                 "SELECT 'urn:customer:' || o_custkey AS iri, 'urn:order:' || o_orderkey AS item_iri, o_totalprice AS item_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT DISTINCT o_custkey, 'urn:customer:' || o_custkey AS k FROM orders WHERE o_totalprice > 250000) ORDER BY k LIMIT 10)", unfold="orders"),
    "lang_chain": Case("{ source { iri sample } }", "SELECT 'urn:source:' || s.source AS iri, sample FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (" + _RANKED.format(rank=_FR_EN, test="lang IN ('fr', 'en') AND text IS NOT NULL") + ") r ON r.source = s.source", context=Context(("fr", "en"))),
    "lang_required": Case("{ source { iri needed } }", "SELECT 'urn:source:' || source AS iri, sample AS needed FROM (" + _RANKED.format(rank="''", test="lang = 'es' AND text IS NOT NULL") + ")", context=Context(("es",))),
    "lang_list": Case("{ source { iri texts } }", "SELECT DISTINCT 'urn:source:' || source AS iri, text AS item FROM documents WHERE lang IN ('de', 'es') AND text IS NOT NULL", unfold="texts", context=Context(("de", "es"))),
    "lang_filter": Case('{ document(where: {text: {contains: "the"}}) { iri } }', f"SELECT {_DOC} FROM documents WHERE lang = 'en' AND contains(text, 'the')", context=Context(("en",))),
    "default_value": Case("{ document { iri quality } }", "SELECT 'urn:document:' || d.doc_id AS iri, CAST(coalesce(l.quality, -1) AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "default_value_filter": Case("{ document(where: {quality: {eq: -1}}) { iri quality } }", f"SELECT {_DOC}, CAST(-1 AS BIGINT) AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality <> -1)"),
    "derived_constant": Case("{ customer { iri origin } }", f"SELECT {_CUST}, 'tables' AS origin FROM customer"),
    "derived_list": Case("{ customer { iri badges } }", "SELECT 'urn:customer:' || c_custkey AS iri, unnest(['known', 'mapped']) AS item FROM customer", unfold="badges"),
    "derived_exists": Case("{ customer { iri hasUrgent } }", f"SELECT {_CUST}, {_URGENT} AS hasUrgent FROM customer"),
    "derived_if_enum": Case("{ customer { iri standing } }", f"SELECT {_CUST}, CASE WHEN {_URGENT} THEN 'URGENT' ELSE 'CALM' END AS standing FROM customer"),
    "derived_enum_filter": Case("{ customer(where: {standing: {eq: CALM}}) { iri } }", f"SELECT {_CUST} FROM customer WHERE NOT {_URGENT}"),
    "derived_path": Case("{ order { iri nationName } }", f"SELECT {_ORD}, n_name AS nationName FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"),
    "derived_relationship": Case("{ customer { iri openBig { iri totalprice } } }", "SELECT 'urn:customer:' || o_custkey AS iri, 'urn:order:' || o_orderkey AS item_iri, o_totalprice AS item_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 200000", unfold="openBig"),
    "derived_relationship_filter": Case("{ customer(where: {openBig: {totalprice: {gt: 300000}}}) { iri } }", f"SELECT {_CUST} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice > 300000)"),
    "derived_target": Case("{ fewSized { iri size } }", "SELECT 'urn:part:' || p_partkey AS iri, CAST(p_size AS BIGINT) AS size FROM part WHERE p_type IN ('SMALL', 'MEDIUM', 'LARGE') AND p_size < 10 AND regexp_matches(p_brand, 'brand#1', 'i')", tree=True),
    "instances_of": Case("{ sizedPart { iri name } }", "SELECT 'urn:part:' || p_partkey AS iri, p_name AS name FROM part WHERE p_type IN ('SMALL', 'MEDIUM', 'LARGE')", tree=True),
    "author_expr": Case("{ customer { iri iriLength } }", f"SELECT {_CUST}, CAST(length('urn:customer:' || c_custkey) AS BIGINT) AS iriLength FROM customer"),
    "author_select": Case("{ customer { iri label } }", f"SELECT {_CUST}, upper(c_name) || '/' || c_mktsegment AS label FROM customer"),
    "author_not_exists": Case("{ customer { iri calmName } }", f"SELECT {_CUST}, CASE WHEN NOT {_URGENT} THEN c_name END AS calmName FROM customer"),
    "author_aggregate": Case("{ customer { iri spent } }", f"SELECT {_CUST}, sum(o_totalprice) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "read_graphs": Case("{ nation { iri name customers { iri } } }", "SELECT 'urn:nation:' || n_nationkey AS iri, n_name AS name, CAST(NULL AS VARCHAR) AS item_iri FROM nation", unfold="customers", outer=True, context=Context(read_graphs=(Q + "g:geo",))),
    "read_graphs_merged": Case("{ nation { name suppliers { name } } }", "SELECT n_name AS name, s_name AS item_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey", unfold="suppliers", outer=True, context=Context(read_graphs=(Q + "g:geo", Q + "g:sales"))),
    "typename_alias": Case("{ region { kind: __typename id: iri title: name } }", "SELECT 'Region' AS kind, 'urn:region:' || r_regionkey AS id, r_name AS title FROM region"),
}


def multi_branch(spark: SparkSession, sf_dir: str, as_quads: bool = False) -> DataFrame:
    """Two lists of one entity, each aggregated before it joins, so that they do not multiply."""
    (df,) = engine(spark, sf_dir, as_quads=as_quads).execute("{ nation { name customers { acctbal } suppliers { acctbal } } }").values()
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["acctbal"])
    return df.select("name", F.size("customers").cast("bigint").alias("n_customers"), F.size("suppliers").cast("bigint").alias("n_suppliers"), F.round(total("customers"), 2).alias("customers_acctbal"), F.round(total("suppliers"), 2).alias("suppliers_acctbal"))


def json_response(spark: SparkSession, sf_dir: str, as_quads: bool = False) -> DataFrame:
    (df,) = engine(spark, sf_dir, as_quads=as_quads).json("{ region { iri name nations { name } } }").values()
    return df


def nested_three_levels(spark: SparkSession, sf_dir: str, as_quads: bool = False) -> DataFrame:
    (df,) = engine(spark, sf_dir, as_quads=as_quads).execute("{ nation { name customers { name orders { iri } } } }").values()
    return df.select("name", F.explode("customers").alias("c")).select("name", F.col("c.name").alias("customer"), F.explode("c.orders").alias("o")).select("name", "customer", F.col("o.iri").alias("iri"))


EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "multi_branch": (multi_branch, """SELECT n_name AS name, n_customers, n_suppliers, round(ca, 2) AS customers_acctbal, round(sa, 2) AS suppliers_acctbal FROM nation
      JOIN (SELECT n_nationkey AS k, count(c_custkey) AS n_customers, coalesce(sum(c_acctbal), 0.0) AS ca FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) c ON c.k = n_nationkey
      JOIN (SELECT n_nationkey AS k, count(s_suppkey) AS n_suppliers, coalesce(sum(s_acctbal), 0.0) AS sa FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) s ON s.k = n_nationkey"""),
    "nested_three_levels": (nested_three_levels, "SELECT n_name AS name, c_name AS customer, 'urn:order:' || o_orderkey AS iri FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey"),
    "json_response": (json_response, """SELECT '{"iri":"urn:region:' || r_regionkey || '","name":"' || r_name || '","nations":[' || string_agg('{"name":"' || n_name || '"}', ',' ORDER BY 'urn:nation:' || n_nationkey) || ']}' AS json
      FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"""),
}


CASES |= {name: Case(operation, sql) for name, (operation, sql) in author.OPERATIONS.items()}


def _mapped() -> dict[str, tuple[Callable[..., DataFrame], str]]:
    return {name: (case.run, case.sql) for name, case in CASES.items()} | EXTRA


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query over mapped tables, and as quad_<name> over the same tables loaded as quads."""
    found = _mapped()
    return {name: f for name, (f, _) in found.items()} | {f"quad_{name}": partial(f, as_quads=True) for name, (f, _) in found.items()}


def oracles() -> dict[str, str]:
    found = _mapped()
    return {name: sql for name, (_, sql) in found.items()} | {f"quad_{name}": sql for name, (_, sql) in found.items()}
