"""SPARQL's values and functions as columns (EXP, FN). Errors are nulls: nothing here ever throws on data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.terms import BNODE, DECIMAL, INTEGERS, IRI, LANGUAGE, LITERAL, NUMERIC, ORDERED, TEMPORAL, TERM, XSD, iri_term, order_key, plain_term, term


#: Numbers in order of promotion: their kinds and types.
NUMBERS = {"int": XSD + "integer", "dec": XSD + "decimal", "flt": XSD + "float", "num": XSD + "double"}


def shown(exact: Column) -> Column:
    """The lexical form of a decimal, without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(exact.cast(DECIMAL).cast("string"), "0+$", ""), r"\.$", "")


def numeral(kind: str, col: Column) -> Column:
    """The term of a number."""
    none = F.lit(None)
    lex = shown(col) if kind == "dec" else col.cast("string")
    return F.when(col.isNotNull(), term(F.lit(LITERAL), lex, F.lit(NUMBERS[kind]), none.cast("string"), col.cast("double"), none.cast("timestamp")))


def rank(dt: Column) -> Column:
    """The place of a type in NUMBERS; null of other types."""
    return F.when(dt.isin(*INTEGERS), 0).when(dt == XSD + "decimal", 1).when(dt == XSD + "float", 2).when(dt == XSD + "double", 3)


def ranked(place: Column, exact: Column, inexact: Column) -> Column:
    """The term of a number whose type has that place, from its exact value or else its double."""
    return F.when(place == 0, numeral("int", exact.try_cast("bigint"))).when(place == 1, numeral("dec", exact.try_cast(DECIMAL))).when(place == 2, numeral("flt", inexact)).otherwise(numeral("num", inexact))


@dataclass(frozen=True)
class Value:
    """A column and what it is: term, bool, str, or a kind of NUMBERS (dec is DECIMAL, flt and num are doubles)."""

    kind: str
    col: Column

    @property
    def term(self) -> Column:
        if self.kind == "term":
            return self.col
        if self.kind in NUMBERS:
            return numeral(self.kind, self.col)
        made = plain_term(self.col, XSD + "string") if self.kind == "str" else plain_term(self.col.cast("string"), XSD + "boolean")
        return F.when(self.col.isNotNull(), made)

    @property
    def exact(self) -> Column:
        """An integer or decimal by all its digits; null of anything else."""
        if self.kind == "term":
            return F.when(self.col["dt"].isin(*INTEGERS, XSD + "decimal"), self.col["lex"].try_cast(DECIMAL))
        return self.col.cast(DECIMAL) if self.kind in ("int", "dec") else F.lit(None).cast(DECIMAL)

    @property
    def place(self) -> Column:
        return rank(self.col["dt"]) if self.kind == "term" else F.lit(list(NUMBERS).index(self.kind)) if self.kind in NUMBERS else F.lit(None).cast("int")

    @property
    def lang(self) -> Column:
        """The language tag of a string, with its direction; null of others."""
        return self.col["lang"] if self.kind == "term" else F.lit(None).cast("string")

    @property
    def text(self) -> Column:
        """STR of the value."""
        return self.col["lex"] if self.kind == "term" else shown(self.col) if self.kind == "dec" else self.col.cast("string")

    @property
    def string(self) -> Column:
        """The lexical form of a string or tagged string; null of anything else."""
        if self.kind == "term":
            return F.when((self.col["kind"] == LITERAL) & self.col["dt"].isin(XSD + "string", *LANGUAGE), self.col["lex"])
        return self.col if self.kind == "str" else F.lit(None).cast("string")

    @property
    def num(self) -> Column:
        if self.kind == "term":
            return self.col["num"]
        return self.col.cast("double") if self.kind in NUMBERS else F.lit(None).cast("double")

    @property
    def truth(self) -> Column:
        """Effective boolean value; null where there is none."""
        if self.kind == "bool":
            return self.col
        if self.kind in NUMBERS:
            return (self.col != 0) & ~F.isnan(self.col.cast("double"))
        if self.kind == "str":
            return F.length(self.col) > 0
        c = self.col
        return (
            F.when(c["dt"] == XSD + "boolean", c["lex"].isin("true", "1"))
            .when(c["num"].isNotNull(), (c["num"] != 0) & ~F.isnan(c["num"]))
            .when(c["dt"].isin(*NUMERIC), F.lit(False))
            .when(c["dt"].isin(XSD + "string", *LANGUAGE), F.length(c["lex"]) > 0)
        )


def compare(op: str, a: Value, b: Value) -> Column:
    """= and the rest by value where the types compare; = and != of terms that do not are by identity, an order of
    them is an error (null)."""
    apply = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if a.kind in NUMBERS and b.kind in NUMBERS or a.kind == b.kind and a.kind in ("str", "bool"):
        return apply(a.col, b.col)
    x, y = a.term, b.term
    same = F.coalesce(x["dt"], F.lit("")) == F.coalesce(y["dt"], F.lit(""))
    tags = F.coalesce(x["lang"], F.lit("")) == F.coalesce(y["lang"], F.lit(""))
    decimals = (x["dt"] == XSD + "decimal") & y["dt"].isin(*INTEGERS, XSD + "decimal") | (y["dt"] == XSD + "decimal") & x["dt"].isin(*INTEGERS)
    out = F.when(decimals & x["num"].isNotNull() & y["num"].isNotNull(), apply(Value("term", x).exact, Value("term", y).exact))
    out = out.when(x["num"].isNotNull() & y["num"].isNotNull(), apply(x["num"], y["num"])).when(x["ts"].isNotNull() & y["ts"].isNotNull(), apply(x["ts"], y["ts"]))
    if op in ("=", "!="):
        known = x["lex"].isNotNull() & y["lex"].isNotNull()
        out = out.when(same & x["dt"].isin(*ORDERED), apply(order_key(x["lex"], x["dt"]), order_key(y["lex"], y["dt"])))
        equal = (x["kind"] == y["kind"]) & (x["lex"] == y["lex"]) & same & tags
        return out.when(known, equal if op == "=" else ~equal)
    # Times, durations and parts of dates compare by value; other lexical forms only within one type.
    out = out.when(same & x["dt"].isin(*ORDERED), apply(order_key(x["lex"], x["dt"]), order_key(y["lex"], y["dt"])))
    return out.when((x["kind"] == LITERAL) & (y["kind"] == LITERAL) & same & tags & x["num"].isNull() & ~x["dt"].isin(*NUMERIC), apply(x["lex"], y["lex"]))


def lang_matches(tag: Column, rng: Column) -> Column:
    tag, rng = F.lower(tag), F.lower(rng)
    return F.when(rng == "*", tag != "").otherwise((tag == rng) | tag.startswith(F.concat(rng, F.lit("-"))))


def _if(test: Value, a: Value, b: Value) -> Value:
    t = test.truth
    if a.kind == b.kind:
        return Value(a.kind, F.when(t, a.col).when(~t, b.col))
    return Value("term", F.when(t, a.term).when(~t, b.term))


def _coalesce(*args: Value) -> Value:
    if len({a.kind for a in args}) == 1:
        return Value(args[0].kind, F.coalesce(*(a.col for a in args)))
    return Value("term", F.coalesce(*(a.term for a in args)))


def math(op: str, a: Value, b: Value) -> Value:
    """+, -, * and / : integers and decimals by all their digits, with floats and doubles as doubles. The quotient of
    integers is a decimal."""
    apply = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}.get(op)
    if a.kind in NUMBERS and b.kind in NUMBERS:
        kind = max(a.kind, b.kind, key=list(NUMBERS).index)
        if op == "/":
            kind = "dec" if kind == "int" else kind
            return Value(kind, quotient(a.exact, b.exact) if kind == "dec" else ieee(a.num, b.num))
        if kind == "int":
            # Beyond 64 bits is an error, so null.
            return Value(kind, {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col, b.col))
        return Value(kind, apply(a.exact, b.exact).try_cast(DECIMAL) if kind == "dec" else apply(a.num, b.num))
    place = F.when(a.place.isNotNull() & b.place.isNotNull(), F.greatest(a.place, b.place))
    if op == "/":
        return Value("term", F.when(place.isNotNull(), ranked(F.greatest(place, F.lit(1)), quotient(a.exact, b.exact), ieee(a.num, b.num))))
    return Value("term", F.when(place.isNotNull(), ranked(place, apply(a.exact, b.exact), apply(a.num, b.num))))


def quotient(x: Column, y: Column) -> Column:
    """Of decimals, to 18 places; null for a divisor of 0."""
    tries = []
    # Spark gives a quotient as many places as the types of both leave.
    for wide, by in (("decimal(18,6)", "decimal(18,6)"), ("decimal(28,8)", "decimal(10,0)")):
        over, under = x.try_cast(wide), y.try_cast(by)
        tries.append(F.when((over == x) & (under == y), F.try_divide(over, under).try_cast(DECIMAL)))
    return F.when(y != 0, F.coalesce(*tries, F.try_divide(x.cast("double"), y.cast("double")).try_cast(DECIMAL)))


def ieee(x: Column, y: Column) -> Column:
    """Of doubles: a divisor of 0 gives an infinity, or no number."""
    nan = F.lit(float("nan"))
    return F.when(y != 0, F.try_divide(x, y)).when(x > 0, float("inf")).when(x < 0, float("-inf")).when(y.isNotNull() & x.isNotNull(), nan)


def alike(a: Value, b: Value) -> Column:
    """Whether two strings may be compared: the second has no tag, or that of the first."""
    if b.kind != "term":
        return F.lit(True)
    return F.coalesce(b.lang.isNull() | (b.lang == F.coalesce(a.lang, F.lit(""))), F.lit(False))


def total(values: Value, mean: bool = False, distinct: bool = False) -> Column:
    """SUM or AVG as a term: of the type that its values promote to; an error (null) if one is no number; 0 of none."""
    place, bad = F.max(values.place), F.max((values.term["lex"].isNotNull() & values.num.isNull()).cast("int")) == 1
    add = F.sum_distinct if distinct else F.sum
    exact, inexact = add(values.exact), add(values.num)
    if mean:
        n = F.count_distinct(values.num) if distinct else F.count(values.num)
        exact, inexact, place = quotient(exact.cast(DECIMAL), n.cast(DECIMAL)), inexact / n, F.greatest(place, F.lit(1))
    nothing = numeral("int", F.lit(0).cast("bigint"))
    return F.when(bad, F.lit(None).cast(TERM)).when(F.count(values.num) == 0, nothing).otherwise(ranked(place, exact.cast(DECIMAL), inexact))


def _tagged(a: Value, made: Column) -> Value:
    """A string result that keeps the language tag of the argument."""
    if a.kind != "term":
        return Value("str", made)
    none = F.lit(None)
    return Value("term", F.when(made.isNotNull(), term(F.lit(LITERAL), made, a.col["dt"], a.col["lang"], none.cast("double"), none.cast("timestamp"))))


#: The parts of a dateTime, date or time as they are written: year, month, day, hours, minutes, seconds, zone.
_DATE = r"^(?:(-?\d{4,})-(\d\d)-(\d\d))?(?:T?(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$"


def _written(a: Value, k: int) -> Column:
    """A part as it is written, "" where there is none; null of what is no dateTime, date or time."""
    if a.kind != "term":
        return F.lit(None).cast("string")
    ok = a.col["dt"].isin(*TEMPORAL, XSD + "time") & a.col["lex"].rlike(_DATE)
    return F.when(ok, F.regexp_extract(a.col["lex"], _DATE, k))


def _zone(a: Value) -> Column:
    return _written(a, 7)


def _offset(a: Value) -> Value:
    """TIMEZONE: the offset as a duration; an error where none is written."""
    zone = _zone(a)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    length = F.concat(F.when(zone.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.lit("PT"), part(hours, "H"), part(minutes, "M"))
    lex = F.when((zone == "Z") | (hours + minutes == 0), F.lit("PT0S")).when(zone != "", length)
    return Value("term", F.when(lex.isNotNull(), plain_term(lex, XSD + "dayTimeDuration")))


def _substr(a: Value, start: Value, length: Value | None = None) -> Value:
    """Characters from the place `start` on, counted from 1; places before the first are passed but count."""
    first = F.floor(start.num + 0.5)
    begin = F.greatest(first, F.lit(1)).cast("int")
    count = F.lit(1 << 30) if length is None else F.greatest(first + F.floor(length.num + 0.5) - begin, F.lit(0)).cast("int")
    return _tagged(a, F.substring(a.string, begin, count))


def _cut(a: Value, b: Value, made: Column) -> Value:
    """Part of a, with its tag; of what does not hold b, the plain empty string."""
    found = F.when(alike(a, b), a.string.contains(b.string))
    if a.kind != "term":
        return Value("str", F.when(found, made).when(~found, F.lit("")))
    return Value("term", F.when(found, _tagged(a, made).term).when(~found, plain_term(F.lit(""), XSD + "string")))


def _concat(*a: Value) -> Value:
    """With a tag that all of them have."""
    if not a:
        return Value("str", F.lit(""))
    made = F.concat(*(x.string for x in a))
    if any(x.kind != "term" for x in a):
        return Value("str", made)
    same = reduce(Column.__and__, ((x.lang == a[0].lang) for x in a))
    return Value("term", F.when(made.isNotNull(), F.when(same, _tagged(a[0], made).term).otherwise(plain_term(made, XSD + "string"))))


def replaced(a: Value, regex: str, by: str) -> Value:
    return _tagged(a, F.regexp_replace(a.string, regex, by))


def _cast(dt: str) -> Callable[[Value], Value]:
    def run(a: Value) -> Value:
        if dt == "string":
            return Value("str", a.text if a.kind != "term" else F.when(a.col["kind"] != BNODE, a.col["lex"]))
        if dt == "boolean":
            text = a.text
            return Value("bool", F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False).otherwise(F.when(a.num.isNotNull(), (a.num != 0) & ~F.isnan(a.num))))
        if dt in ("dateTime", "date"):
            day, time, zone = F.regexp_extract(a.text, r"^(-?\d{4,}-\d\d-\d\d)", 1), F.regexp_extract(a.text, r"(T\d\d:\d\d:\d\d(?:\.\d+)?)", 1), F.regexp_extract(a.text, r"(Z|[+-]\d\d:\d\d)$", 1)
            lex = F.concat(day, zone) if dt == "date" else F.concat(day, F.when(time != "", time).otherwise(F.lit("T00:00:00")), zone)
            ok = a.text.rlike(_DATE) & (day != "") & day.try_cast("date").isNotNull()
            return Value("term", F.when(ok, term(F.lit(LITERAL), lex, F.lit(XSD + dt), F.lit(None).cast("string"))))
        said = a.term
        truth = F.when(said["dt"] == XSD + "boolean", said["lex"].isin("true", "1").cast("int"))
        text = F.when(said["kind"] == LITERAL, F.trim(said["lex"]))
        number = F.coalesce(a.num, truth.cast("double"), F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")), F.when(text.isin("INF", "+INF"), float("inf")).when(text == "-INF", float("-inf")).when(text == "NaN", float("nan")))
        exact = F.coalesce(a.exact, truth.cast(DECIMAL), F.when(a.num.isNotNull(), a.num.try_cast(DECIMAL)))
        if dt == "decimal":
            return Value("dec", F.coalesce(exact, F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), text.try_cast(DECIMAL))))
        if dt == "integer":
            cut = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact))
            return Value("int", F.coalesce(cut.try_cast("bigint"), F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))))
        return Value("flt" if dt == "float" else "num", number)

    return run


def _number(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    """A function of a number that keeps its type."""

    def run(a: Value) -> Value:
        if a.kind in ("str", "bool"):
            return Value("num", F.lit(None).cast("double"))
        if a.kind != "term":
            return Value(a.kind, f(a.col).cast("bigint" if a.kind == "int" else DECIMAL if a.kind == "dec" else "double"))
        return Value("term", F.when(a.place.isNotNull(), ranked(a.place, f(a.exact).cast(DECIMAL), f(a.num).cast("double"))))

    return run


def _field(a: Value, name: str, other: Column) -> Column:
    return a.col[name] if a.kind == "term" else other


def _lang(a: Value) -> Column:
    return F.when(a.term["kind"] == LITERAL, F.substring_index(F.coalesce(a.lang, F.lit("")), "--", 1))


def _direction(a: Value) -> Column:
    """A string's base direction stands behind its tag: en--ltr."""
    tag = F.coalesce(a.lang, F.lit(""))
    return F.when(a.term["kind"] == LITERAL, F.when(tag.contains("--"), F.substring_index(tag, "--", -1)).otherwise(F.lit("")))


def _strlang(a: Value, tag: Value, direction: Value | None = None) -> Value:
    lang, plain = F.lower(tag.string), a.string if a.kind == "str" else F.when(a.term["dt"] == XSD + "string", a.text)
    ok = plain.isNotNull() & (lang != "")
    if direction is not None:
        lang, ok = F.concat(lang, F.lit("--"), direction.string), ok & direction.string.isin("ltr", "rtl")
    return Value("term", F.when(ok, term(F.lit(LITERAL), plain, F.lit(LANGUAGE[direction is not None]), lang)))


_FLAGS = frozenset("ismx")


def pattern(text: str, flags: str) -> str:
    if set(flags) - _FLAGS:
        raise ValueError(f"regular expression flags {flags!r} are not supported")
    return f"(?{flags}){text}" if flags else text


#: Functions by upper-case name; each takes and gives Values.
FUNCTIONS: dict[str, Callable[..., Value]] = {
    "IF": _if, "COALESCE": _coalesce, "BOUND": lambda a: Value("bool", a.col.isNotNull()),
    "SAMETERM": lambda a, b: Value("bool", (a.term["kind"] == b.term["kind"]) & (a.text == b.text) & a.term["dt"].eqNullSafe(b.term["dt"]) & a.term["lang"].eqNullSafe(b.term["lang"])),
    "SAMEVALUE": lambda a, b: Value("bool", compare("=", a, b)),
    "ISIRI": lambda a: Value("bool", a.term["kind"] == IRI), "ISURI": lambda a: Value("bool", a.term["kind"] == IRI), "ISBLANK": lambda a: Value("bool", a.term["kind"] == BNODE),
    "ISLITERAL": lambda a: Value("bool", a.term["kind"] == LITERAL), "ISNUMERIC": lambda a: Value("bool", F.when(a.col.isNotNull(), a.num.isNotNull())),
    "STR": lambda a: Value("str", a.text), "LANG": lambda a: Value("str", _lang(a)), "LANGMATCHES": lambda a, b: Value("bool", lang_matches(a.text, b.text)),
    "HASLANG": lambda a: Value("bool", F.when(a.col.isNotNull(), F.coalesce(_lang(a) != "", F.lit(False)))), "LANGDIR": lambda a: Value("str", _direction(a)), "HASLANGDIR": lambda a: Value("bool", F.when(a.col.isNotNull(), F.coalesce(_direction(a) != "", F.lit(False)))),
    "DATATYPE": lambda a: Value("term", F.when(a.term["dt"].isNotNull(), iri_term(a.term["dt"]))),
    "IRI": lambda a: Value("term", F.when(a.text.isNotNull(), iri_term(a.text))), "URI": lambda a: Value("term", F.when(a.text.isNotNull(), iri_term(a.text))),
    "BNODE": lambda a=None: Value("term", iri_term(F.concat(F.lit("_:u"), F.replace(F.uuid(), F.lit("-"), F.lit("")) if a is None else F.md5(a.text)))),
    "STRDT": lambda a, b: Value("term", F.when(a.string.isNotNull() & b.text.isNotNull(), term(F.lit(LITERAL), a.string, b.text, F.lit(None).cast("string")))),
    "STRLANG": _strlang, "STRLANGDIR": _strlang,
    "UUID": lambda: Value("term", iri_term(F.concat(F.lit("urn:uuid:"), F.uuid()))), "STRUUID": lambda: Value("str", F.uuid()), "RAND": lambda: Value("num", F.rand()),
    "NOW": lambda: Value("term", term(F.lit(LITERAL), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(XSD + "dateTime"), F.lit(None).cast("string"))),
    "STRLEN": lambda a: Value("int", F.char_length(a.string).cast("bigint")),
    "SUBSTR": _substr,
    "UCASE": lambda a: _tagged(a, F.upper(a.string)), "LCASE": lambda a: _tagged(a, F.lower(a.string)),
    "STRSTARTS": lambda a, b: Value("bool", F.when(alike(a, b), a.string.startswith(b.string))), "STRENDS": lambda a, b: Value("bool", F.when(alike(a, b), a.string.endswith(b.string))), "CONTAINS": lambda a, b: Value("bool", F.when(alike(a, b), a.string.contains(b.string))),
    "STRBEFORE": lambda a, b: _cut(a, b, F.substring(a.string, F.lit(1), _before(a, b))), "STRAFTER": lambda a, b: _cut(a, b, F.substring(a.string, _before(a, b) + F.char_length(b.string) + 1, F.lit(1 << 30))),
    "CONCAT": _concat,
    "ENCODE_FOR_URI": lambda a: Value("str", F.replace(F.replace(F.replace(F.url_encode(a.string), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))),
    "ABS": _number(F.abs), "CEIL": _number(F.ceil), "FLOOR": _number(F.floor), "ROUND": _number(lambda c: F.floor(c + F.lit(Decimal("0.5")))),
    **{name: (lambda k: lambda a: Value("int", _written(a, k).try_cast("bigint")))(k) for k, name in enumerate(("YEAR", "MONTH", "DAY", "HOURS", "MINUTES"), 1)},
    "SECONDS": lambda a: Value("dec", _written(a, 6).try_cast(DECIMAL)), "TZ": lambda a: Value("str", _zone(a)), "TIMEZONE": _offset,
    "MD5": lambda a: Value("str", F.md5(a.string)), "SHA1": lambda a: Value("str", F.sha1(a.string)),
    **{f"SHA{n}": (lambda n: lambda a: Value("str", F.sha2(a.string, n)))(n) for n in (256, 384, 512)},
    **{f"{XSD}{dt}": _cast(dt) for dt in ("string", "boolean", "integer", "decimal", "double", "float", "dateTime", "date")},
}


def _before(a: Value, b: Value) -> Column:
    """Characters before the first occurrence."""
    return F.position(b.string, a.string) - 1
