"""RDF terms on the driver, and the struct that stands for a term in a DataFrame."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IRI, BNODE, LITERAL = 0, 1, 2
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
SHNEX = "http://www.w3.org/ns/shacl-node-expr#"
TYPE, SUBCLASS = RDF + "type", RDFS + "subClassOf"

#: The XSD types by what they compare as.
INTEGERS = tuple(XSD + x for x in ("integer", "int", "short", "byte", "long", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger"))
NUMERIC = (*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double")
TEMPORAL = (XSD + "date", XSD + "dateTime", XSD + "dateTimeStamp")
LANGUAGE = (RDF + "langString", RDF + "dirLangString")
ORDERED = tuple(XSD + x for x in ("time", "duration", "dayTimeDuration", "yearMonthDuration", "gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay"))
#: Exact numbers, as far as Spark has them.
DECIMAL = "decimal(38,18)"


class Term(NamedTuple):
    kind: int
    lex: str
    dt: str | None = None
    lang: str | None = None

    @property
    def is_iri(self) -> bool:
        return self.kind == IRI

    def __str__(self) -> str:
        return self.lex


def iri(lex: str) -> Term:
    return Term(IRI, lex)


def literal(value: object, dt: str | None = None, lang: str | None = None) -> Term:
    if isinstance(value, bool):
        return Term(LITERAL, str(value).lower(), dt or XSD + "boolean")
    if isinstance(value, int):
        return Term(LITERAL, str(value), dt or XSD + "integer")
    if isinstance(value, float):
        return Term(LITERAL, repr(value), dt or XSD + "double")
    # A base direction stands behind the tag, as it is written.
    return Term(LITERAL, str(value), LANGUAGE["--" in lang] if lang else dt or XSD + "string", lang.lower() if lang else None)


#: `num` and `ts` are the literal's value where its type has one. A mapped column fills them as it is, so that a filter
#: on them reaches the Parquet scan.
TERM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("ts", T.TimestampType())])


def term(kind: Column, lex: Column, dt: Column, lang: Column, num: Column | None = None, ts: Column | None = None) -> Column:
    if num is None:
        num = F.when(dt.isin(*NUMERIC), lex.try_cast("double"))
    if ts is None:
        ts = F.when(dt.isin(*TEMPORAL), lex.try_cast("timestamp"))
    return F.struct(kind.cast("tinyint").alias("kind"), lex.alias("lex"), dt.alias("dt"), lang.alias("lang"), num.alias("num"), ts.alias("ts"))


def iri_term(lex: Column) -> Column:
    none = F.lit(None)
    return term(F.when(lex.startswith("_:"), F.lit(BNODE)).otherwise(F.lit(IRI)), lex, none.cast("string"), none.cast("string"), none.cast("double"), none.cast("timestamp"))


def plain_term(lex: Column, dt: str) -> Column:
    return term(F.lit(LITERAL), lex, F.lit(dt), F.lit(None).cast("string"))


def constant(value: Term) -> Column:
    text = lambda x: F.lit(x).cast("string")
    return term(F.lit(value.kind), text(value.lex), text(value.dt), text(value.lang))


_DURATION = r"^(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
_CLOCK = r"^(\d\d):(\d\d):(\d\d(?:\.\d+)?)(?:Z|([+-])(\d\d):(\d\d))?$"
_CALENDAR = r"^(-?\d{4,})?(?:-{1,2}(\d\d))?(?:-{1,3}(\d\d))?(?:Z|[+-]\d\d:\d\d)?$"
#: Seconds of a mean month: durations that mix months and days compare by it.
MONTH_SECONDS = 2629746.0


def order_key(lex: Column, dt: Column) -> Column:
    """What literals of the types in ORDERED compare by: seconds of a duration or a time of day (in UTC), months of a
    duration of these, months or days of a calendar part. Null if the literal is none of its type."""

    def part(pattern: str, k: int) -> Column:
        return F.coalesce(F.regexp_extract(lex, pattern, k).try_cast("double"), F.lit(0.0))

    sign = F.when(lex.startswith("-"), -1.0).otherwise(1.0)
    months = part(_DURATION, 2) * 12 + part(_DURATION, 3)
    seconds = part(_DURATION, 4) * 86400 + part(_DURATION, 5) * 3600 + part(_DURATION, 6) * 60 + part(_DURATION, 7)
    shift = F.when(F.regexp_extract(lex, _CLOCK, 4) == "-", -1.0).otherwise(1.0) * (part(_CLOCK, 5) * 3600 + part(_CLOCK, 6) * 60)
    clock = part(_CLOCK, 1) * 3600 + part(_CLOCK, 2) * 60 + part(_CLOCK, 3) - shift
    calendar = part(_CALENDAR, 1) * 10000 + part(_CALENDAR, 2) * 100 + part(_CALENDAR, 3)
    is_duration = lex.rlike(_DURATION) & lex.rlike(r"\d") & ~lex.endswith("T")
    return (
        F.when(dt.isin(*(XSD + x for x in ("duration", "dayTimeDuration", "yearMonthDuration"))), F.when(is_duration, sign * (months * MONTH_SECONDS + seconds)))
        .when(dt == XSD + "time", F.when(lex.rlike(_CLOCK), clock))
        .when(dt.isin(*(XSD + x for x in ("gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay"))), F.when(lex.rlike(_CALENDAR) & lex.rlike(r"\d"), calendar))
    )
