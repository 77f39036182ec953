"""Shapes: from a shapes graph to entity types, fields, paths and expressions (SCH, TGT, PATH, NX, FS parsing)."""

from __future__ import annotations

import keyword
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import count

from ..sources.terms import LANGUAGE, LITERAL, RDF, RDFS, SH, SHNEX, SUBCLASS, TYPE, XSD, Term, iri
from ..sources.turtle import Graph

GQL = "http://datashapes.org/graphql#"
SYNTHETIC = "urn:quadlake:synthetic:"


class ShapeError(ValueError):
    """The shapes graph says something that is wrong or not supported."""


# A path is ("pred", iri), ("inv" | "star" | "plus" | "opt", path) or ("seq" | "alt", (path, ...)).
Path = tuple


@dataclass(frozen=True)
class Const:
    terms: tuple[Term, ...]
    listed: bool = False


@dataclass(frozen=True)
class Sparql:
    text: str
    prefixes: tuple[tuple[str, str], ...]
    select: bool


@dataclass(frozen=True)
class PathValues:
    path: Path
    focus: Term | None = None


@dataclass(frozen=True)
class FilterNodes:
    nodes: object
    conjuncts: tuple


@dataclass(frozen=True)
class Exists:
    nodes: object


@dataclass(frozen=True)
class If:
    test: object
    then: object | None
    other: object | None


@dataclass(frozen=True)
class Instances:
    classes: tuple[str, ...]


def keeps_rows(expr: object) -> bool:
    """Whether an entity without a value stays even where the field is required."""
    return isinstance(expr, (Const, Exists, If)) or isinstance(expr, Sparql) and not expr.select


def single_valued(expr: object) -> bool:
    if isinstance(expr, Const):
        return not expr.listed
    if isinstance(expr, Sparql):
        return not expr.select
    if isinstance(expr, If):
        return all(x is None or single_valued(x) for x in (expr.then, expr.other))
    return isinstance(expr, Exists)


@dataclass(frozen=True)
class Field:
    name: str
    path: Path
    datatypes: tuple[str, ...] = ()
    min_count: int = 0
    max_count: int | None = None
    target_class: str | None = None
    target_shape: str | None = None
    members: tuple[Term, ...] | None = None
    derived: object = None
    default: object = None
    description: str | None = None

    @property
    def kind(self) -> str:
        return "relationship" if self.target_class or self.target_shape else "enum" if self.members else "scalar"

    @property
    def listed(self) -> bool:
        return self.max_count != 1

    @property
    def required(self) -> bool:
        return self.min_count >= 1 or self.default is not None

    @property
    def space(self) -> str:
        """plain, language or union of both."""
        tagged = [d for d in self.datatypes if d in LANGUAGE]
        return "plain" if not tagged else "language" if len(tagged) == len(self.datatypes) else "union"

    @property
    def output(self) -> str:
        """String, Int, Float or Boolean."""
        if len(self.datatypes) != 1:
            return "String"
        return SCALARS.get(self.datatypes[0], ("String", "String"))[0]

    @property
    def filter_kind(self) -> str:
        if self.kind == "enum":
            return "Enum"
        if len(self.datatypes) != 1:
            return "String"
        return SCALARS.get(self.datatypes[0], ("String", "String"))[1]

    def enum_names(self) -> dict[str, Term]:
        return enum_names(self.members or ())


#: Output type and filter type by datatype.
SCALARS = {
    **{XSD + x: ("String", "String") for x in ("string", "normalizedString", "token", "anyURI")}, RDF + "langString": ("String", "String"),
    XSD + "boolean": ("Boolean", "Boolean"),
    **{XSD + x: ("Int", "Int") for x in ("integer", "int", "short", "byte", "long", "unsignedInt")},
    **{XSD + x: ("Float", "Float") for x in ("decimal", "float", "double")},
    **{XSD + x: ("String", "DateTime") for x in ("date", "dateTime", "time", "dateTimeStamp", "duration", "dayTimeDuration", "yearMonthDuration", "gYear")},
}

#: Operators by filter type.
OPERATORS = {
    "String": ("eq", "neq", "in", "notIn", "contains", "startsWith", "endsWith", "regex"),
    "Iri": ("eq", "neq", "in", "notIn", "contains", "startsWith", "endsWith", "regex"),
    "Int": ("eq", "neq", "gt", "gte", "lt", "lte", "in", "notIn"),
    "Float": ("eq", "neq", "gt", "gte", "lt", "lte", "in", "notIn"),
    "DateTime": ("eq", "neq", "gt", "gte", "lt", "lte", "in", "notIn"),
    "Boolean": ("eq", "neq"),
    "Enum": ("eq", "neq", "in", "notIn"),
}


@dataclass(frozen=True)
class Shape:
    iri: str
    name: str
    target: object = None
    target_class: str | None = None
    fields: dict[str, Field] = field(default_factory=dict)
    parents: tuple[str, ...] = ()
    description: str | None = None
    visibility: str = "public"

    @property
    def targeted(self) -> bool:
        return self.target is not None or self.target_class is not None


class Registry:
    """The shapes by name, IRI and class. `roots` are the public ones, by root field."""

    def __init__(self, shapes: list[Shape]):
        self.shapes = {s.iri: s for s in sorted(shapes, key=lambda s: s.name)}
        self.by_name: dict[str, Shape] = {}
        self.by_class: dict[str, Shape] = {}
        self.roots: dict[str, Shape] = {}
        for s in self.shapes.values():
            if s.visibility == "excluded":
                continue
            if s.name in self.by_name:
                raise ShapeError(f"two shapes have the type name {s.name}")
            self.by_name[s.name] = s
            if s.target_class:
                if s.target_class in self.by_class:
                    raise ShapeError(f"two shapes target the class {s.target_class}")
                self.by_class[s.target_class] = s
            if s.visibility == "public" and s.targeted:
                root = s.name[:1].lower() + s.name[1:]
                if root in self.roots:
                    raise ShapeError(f"two types make the root field {root}")
                self.roots[root] = s

    def target_of(self, f: Field) -> Shape:
        return self.shapes[f.target_shape]


def local_name(text: str) -> str:
    return re.split(r"[#/]", text)[-1]


def enum_names(members: tuple[Term, ...]) -> dict[str, Term]:
    """A name for each member of an enum, in order: its text or local name in upper case with _ for runs of anything but
    letters and digits, and _ before what no name may be. Of members that would share a name the first has it; each later
    one takes the first of the numbered names, from 2 on, that is free."""

    def candidates(term: Term) -> Iterator[str]:
        letters = [x for x in re.split(r"[^0-9A-Za-z]", local_name(term.lex) if term.is_iri else term.lex)]
        plain = "_".join(x for k, x in enumerate(letters) if x or k in (0, len(letters) - 1)).upper()
        plain = plain if re.match("[A-Z_]", plain) and plain not in ("TRUE", "FALSE", "NULL") else f"_{plain}"
        yield plain
        yield from (f"{plain.removesuffix('_')}_{k}" for k in count(2))

    out: dict[str, Term] = {}
    for term in members:
        out[next(x for x in candidates(term) if x not in out)] = term
    return out


def _name(graph: Graph, node: Term, fallback: str | None, what: str) -> str:
    found = graph.one(node, SH + "codeIdentifier")
    if found is not None:
        if found.kind != LITERAL or found.dt != XSD + "string" or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", found.lex):
            raise ShapeError(f"sh:codeIdentifier {found.lex!r} of {node} is no name")
        fallback = found.lex
    if not fallback:
        raise ShapeError(f"{what} {node} needs sh:codeIdentifier")
    if fallback.startswith("__"):
        raise ShapeError(f"{fallback!r} begins with the reserved __")
    return fallback + "_" if keyword.iskeyword(fallback) else fallback


# Paths.


def parse_path(graph: Graph, node: Term, above: tuple = ()) -> Path:
    if node in above:
        raise ShapeError("a path refers to itself")
    if node.is_iri and node.lex != RDF + "nil":
        return ("pred", node.lex)
    above = (*above, node)
    if graph.is_list(node):
        parts = graph.items(node)
        if len(parts) < 2:
            raise ShapeError("a sequence path needs two members")
        return ("seq", tuple(parse_path(graph, x, above) for x in parts))
    kinds = {SH + "inversePath": "inv", SH + "zeroOrMorePath": "star", SH + "oneOrMorePath": "plus", SH + "zeroOrOnePath": "opt", SH + "alternativePath": "alt"}
    found = [p for p in graph.predicates.get(node, {}) if p in kinds]
    if len(found) != 1:
        raise ShapeError(f"{node} is no property path")
    value = graph.one(node, found[0])
    if kinds[found[0]] == "alt":
        parts = graph.items(value)
        if len(parts) < 2:
            raise ShapeError("an alternative path needs two members")
        return ("alt", tuple(parse_path(graph, x, above) for x in parts))
    return (kinds[found[0]], parse_path(graph, value, above))


def path_predicates(path: Path) -> set[str]:
    if path[0] == "pred":
        return {path[1]}
    return set().union(*map(path_predicates, path[1] if path[0] in ("seq", "alt") else (path[1],)))


# Node expressions.

#: Expressions that are known and not supported.
REJECTED = ("var", "distinct", "intersection", "concat", "remove", "limit", "offset", "orderBy", "flatMap", "findFirst", "matchAll", "count", "min", "max", "sum", "nodesMatching", "conformsToShape", "arg")


def _prefixes(graph: Graph, node: Term) -> tuple[tuple[str, str], ...]:
    out: dict[str, str] = {}
    for holder in graph.objects(node, SH + "prefixes"):
        seen, todo = set(), [holder]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            todo += graph.objects(at, "http://www.w3.org/2002/07/owl#imports")
            for d in graph.objects(at, SH + "declare"):
                name, space = graph.one(d, SH + "prefix"), graph.one(d, SH + "namespace")
                if name is None or space is None:
                    raise ShapeError(f"a declaration of {holder} lacks its prefix or namespace")
                if out.setdefault(name.lex, space.lex) != space.lex:
                    raise ShapeError(f"prefix {name.lex!r} stands for two namespaces")
    return tuple(out.items())


def parse_expr(graph: Graph, node: Term) -> object:
    if node.is_iri and node.lex != RDF + "nil" or node.kind == LITERAL:
        return Const((node,))
    if graph.is_list(node):
        items = graph.items(node)
        if not items or any(x.kind == 1 for x in items):
            raise ShapeError("a list expression holds constants")
        return Const(tuple(items), True)
    keys = set(graph.predicates.get(node, {})) - {SH + "prefixes"}
    if not keys:
        raise ShapeError("an empty node expression")
    for word in REJECTED:
        if SHNEX + word in keys:
            raise ShapeError(f"shnex:{word} is not supported")

    def only(*names: str) -> None:
        if more := keys - set(names):
            raise ShapeError(f"unexpected {', '.join(sorted(more))} in a node expression")

    if SH + "sparqlExpr" in keys or SH + "select" in keys:
        select = SH + "select" in keys
        only(SH + ("select" if select else "sparqlExpr"))
        return Sparql(graph.one(node, SH + ("select" if select else "sparqlExpr")).lex, _prefixes(graph, node), select)
    if SHNEX + "pathValues" in keys:
        only(SHNEX + "pathValues", SHNEX + "focusNode")
        focus = graph.one(node, SHNEX + "focusNode")
        if focus is not None and not focus.is_iri:
            raise ShapeError("shnex:focusNode is a constant IRI")
        return PathValues(parse_path(graph, graph.one(node, SHNEX + "pathValues")), focus)
    if SHNEX + "filterShape" in keys:
        only(SHNEX + "filterShape", SHNEX + "nodes")
        if SHNEX + "nodes" not in keys:
            raise ShapeError("shnex:filterShape needs shnex:nodes")
        return _filtered(parse_expr(graph, graph.one(node, SHNEX + "nodes")), parse_conjuncts(graph, graph.one(node, SHNEX + "filterShape")))
    if SHNEX + "exists" in keys:
        only(SHNEX + "exists")
        return Exists(parse_expr(graph, graph.one(node, SHNEX + "exists")))
    if SHNEX + "if" in keys:
        only(SHNEX + "if", SHNEX + "then", SHNEX + "else")
        test = parse_expr(graph, graph.one(node, SHNEX + "if"))
        if not single_valued(test):
            raise ShapeError("shnex:if tests one value")
        arms = [parse_expr(graph, x) if (x := graph.one(node, SHNEX + k)) is not None else None for k in ("then", "else")]
        if arms == [None, None]:
            raise ShapeError("shnex:if needs a branch")
        return If(test, *arms)
    if SHNEX + "instancesOf" in keys:
        only(SHNEX + "instancesOf")
        what = graph.one(node, SHNEX + "instancesOf")
        classes = graph.items(what) if graph.is_list(what) else [what]
        if not classes or not all(x.is_iri for x in classes):
            raise ShapeError("shnex:instancesOf takes classes")
        return Instances(tuple(x.lex for x in classes))
    raise ShapeError(f"unknown node expression with {', '.join(sorted(keys))}")


def _filtered(nodes: object, conjuncts: tuple) -> object:
    if isinstance(nodes, If):
        return If(nodes.test, *(None if x is None else _filtered(x, conjuncts) for x in (nodes.then, nodes.other)))
    return FilterNodes(nodes, conjuncts)


_BOUNDS = {SH + "minInclusive": ">=", SH + "maxInclusive": "<=", SH + "minExclusive": ">", SH + "maxExclusive": "<"}


def parse_conjuncts(graph: Graph, node: Term, nested: bool = False) -> tuple:
    """("value", term), ("class", iris), ("root", iri), ("datatype", iri), ("pattern", regex, flags), ("bound", op,
    term), ("some",), ("property", path, conjuncts)."""
    if node.is_iri:
        raise ShapeError("shnex:filterShape takes an inline shape")
    out: list[tuple] = []
    for p in graph.predicates.get(node, {}):
        for o in graph.objects(node, p):
            if p == SH + "hasValue":
                out.append(("value", o))
            elif p == SH + "class":
                out.append(("class", tuple(x.lex for x in graph.items(o)) if graph.is_list(o) else (o.lex,)))
            elif p == SH + "rootClass":
                out.append(("root", o.lex))
            elif p == SH + "datatype":
                out.append(("datatype", o.lex))
            elif p == SH + "pattern":
                flags = graph.one(node, SH + "flags")
                out.append(("pattern", o.lex, flags.lex if flags else ""))
            elif p in _BOUNDS:
                out.append(("bound", _BOUNDS[p], o))
            elif p == SH + "minCount" and nested and o.lex == "1":
                out.append(("some",))
            elif p == SH + "property":
                path = graph.one(o, SH + "path")
                if path is None:
                    raise ShapeError("a property of a filter shape needs sh:path")
                out.append(("property", parse_path(graph, path), parse_conjuncts(graph, o, True)))
            elif p in (SH + "flags", SH + "path", TYPE) and (p != SH + "path" or nested):
                continue
            else:
                raise ShapeError(f"{p} is not supported in a filter shape")
    if not out:
        raise ShapeError("an empty filter shape")
    return tuple(out)


# Shapes.


def _whole(graph: Graph, node: Term, p: str) -> int | None:
    found = graph.one(node, p)
    if found is None:
        return None
    if found.dt != XSD + "integer" or not re.fullmatch(r"[+-]?\d+", found.lex):
        raise ShapeError(f"{p} of {node} is no integer")
    return int(found.lex)


def _text(graph: Graph, node: Term, p: str, lang: str) -> str | None:
    found = graph.objects(node, p)
    for want in (lambda x: x.lang == lang, lambda x: x.lang is None, lambda x: True):
        for x in found:
            if want(x):
                return x.lex
    return None


def _datatypes(graph: Graph, node: Term) -> tuple[str, ...]:
    found: list[str] = []
    one = graph.one(node, SH + "datatype")
    if one is not None:
        found = [x.lex for x in graph.items(one)] if graph.is_list(one) else [one.lex]
    either = graph.one(node, SH + "or")
    if either is not None:
        for part in graph.items(either):
            if set(graph.predicates.get(part, {})) != {SH + "datatype"}:
                raise ShapeError("sh:or is supported for datatypes only")
            found.append(graph.one(part, SH + "datatype").lex)
    text = {XSD + "string", XSD + "normalizedString", XSD + "token", XSD + "anyURI", *LANGUAGE}
    if len(found) > 1 and not set(found) <= text:
        raise ShapeError("several datatypes are supported for text only")
    return tuple(dict.fromkeys(found))


def _field(graph: Graph, node: Term, lang: str) -> Field | None:
    at = graph.one(node, SH + "path")
    if at is None:
        raise ShapeError(f"property shape {node} has no sh:path")
    path = parse_path(graph, at)
    name = _name(graph, node, local_name(path[1]) if path[0] == "pred" else None, "a property with a composite path")
    low, high = _whole(graph, node, SH + "minCount") or 0, _whole(graph, node, SH + "maxCount")
    if high is not None and high < 1:
        warnings.warn(f"field {name} can have no values and is left out", stacklevel=2)
        return None
    members = None
    if (listed := graph.one(node, SH + "in")) is not None:
        members = tuple(graph.items(listed))
        if not members:
            warnings.warn(f"field {name} has an empty sh:in and is left out", stacklevel=2)
            return None
        if any(x.kind == 1 for x in members) or len({x.kind for x in members}) > 1 or len({x.dt for x in members}) > 1:
            raise ShapeError(f"sh:in of {name} mixes kinds of terms")
    classes, shapes = graph.objects(node, SH + "class"), graph.objects(node, SH + "node")
    if len(classes) > 1 or len(shapes) > 1 or any(graph.is_list(x) or not x.is_iri for x in classes) or any(not x.is_iri for x in shapes):
        raise ShapeError(f"field {name}: one sh:class and one named sh:node are supported")
    datatypes = _datatypes(graph, node)
    derived = graph.objects(node, SH + "values")
    if len(derived) > 1:
        raise ShapeError(f"field {name} has several sh:values")
    expr = parse_expr(graph, derived[0]) if derived else None
    related = bool(classes or shapes)
    if expr is not None:
        if path[0] != "pred":
            raise ShapeError(f"derived field {name} needs a plain path")
        if not related and not datatypes and not members:
            raise ShapeError(f"derived field {name} needs sh:datatype")
        if high != 1 and single_valued(expr):
            raise ShapeError(f"derived field {name} is a list of an expression with one value")
    default = None
    if (given := graph.one(node, SH + "defaultValue")) is not None:
        default = parse_expr(graph, given)
        if related or high != 1 or not datatypes or not single_valued(default):
            raise ShapeError(f"a default needs a scalar field with sh:datatype and sh:maxCount 1: {name}")
    return Field(name, path, datatypes, low, high, classes[0].lex if classes else None, shapes[0].lex if shapes else None, members, expr, default, _text(graph, node, SH + "description", lang))


def _off(graph: Graph, node: Term) -> bool:
    found = graph.one(node, SH + "deactivated")
    return found is not None and found.lex in ("true", "1")


def _target(graph: Graph, node: Term) -> tuple[object, str | None]:
    declared = [(p, o) for p in graph.predicates.get(node, {}) if p.startswith(SH + "target") or p == SH + "shape" for o in graph.objects(node, p)]
    for p, _ in declared:
        if p not in (SH + "targetClass", SH + "targetNode"):
            raise ShapeError(f"{p} is not supported")
    types = {x.lex for x in graph.objects(node, TYPE)}
    implicit = SH + "ShapeClass" in types or {RDFS + "Class", SH + "NodeShape"} <= types
    if len(declared) + implicit > 1:
        raise ShapeError(f"{node} declares several targets")
    if implicit:
        return Instances((node.lex,)), None
    if not declared:
        return None, None
    p, o = declared[0]
    if p == SH + "targetClass":
        if not o.is_iri:
            raise ShapeError("sh:targetClass takes an IRI")
        return None, o.lex
    return parse_expr(graph, o), None


def _shape(graph: Graph, node: Term, lang: str) -> Shape:
    target, target_class = _target(graph, node)
    fields: dict[str, Field] = {}
    for prop in graph.objects(node, SH + "property"):
        if _off(graph, prop) or (found := _field(graph, prop, lang)) is None:
            continue
        if found.name in ("iri", "AND", "OR", "NOT"):
            raise ShapeError(f"{found.name} is reserved")
        if found.name in fields:
            warnings.warn(f"{node} has the field {found.name} twice; the first stays", stacklevel=2)
            continue
        fields[found.name] = found
    parents = tuple(x.lex for x in graph.objects(node, SH + "node") if x.is_iri)
    return Shape(node.lex, _name(graph, node, local_name(node.lex), "a shape"), target, target_class, fields, parents, _text(graph, node, RDFS + "comment", lang) or _text(graph, node, SH + "description", lang))


def _inherit(shapes: dict[str, Shape]) -> dict[str, Shape]:
    done: dict[str, Shape] = {}

    def flat(at: str, above: tuple) -> Shape:
        if at in above:
            raise ShapeError("sh:node inheritance runs in a circle")
        if at in done:
            return done[at]
        shape, fields, origin = shapes[at], {}, {}
        for parent in shape.parents:
            if parent not in shapes:
                raise ShapeError(f"{at} inherits from the unknown shape {parent}")
            for name, f in flat(parent, (*above, at)).fields.items():
                if name in fields and fields[name] != f and name not in shape.fields:
                    raise ShapeError(f"the parents of {at} disagree on the field {name}")
                fields[name], origin[name] = f, parent
        for name in shape.fields:
            if name in fields:
                warnings.warn(f"{at} overrides the field {name} of {origin[name]}", stacklevel=2)
        done[at] = replace(shape, fields={**fields, **shape.fields})
        return done[at]

    for at in shapes:
        flat(at, ())
    return done


def _closure(graph: Graph, roots: list[Term]) -> set[str]:
    seen, todo = set(), list(roots)
    while todo:
        at = todo.pop()
        if at.lex not in seen:
            seen.add(at.lex)
            todo += graph.subjects(SUBCLASS, at)
    return seen


def _visibility(graph: Graph, shapes: dict[str, Shape]) -> dict[str, Shape]:
    schemas = graph.subjects(TYPE, iri(GQL + "Schema"))
    if not schemas:
        return shapes
    if len(schemas) > 1:
        raise ShapeError("several graphql:Schema declarations")
    named = {k: {x.lex for x in graph.objects(schemas[0], GQL + k)} for k in ("publicShape", "protectedShape", "privateShape")}
    classes = {k: _closure(graph, graph.objects(schemas[0], GQL + k)) for k in ("publicClass", "protectedClass")}
    for x in set().union(*named.values()) - set(shapes):
        raise ShapeError(f"the schema names the unknown shape {x}")
    out = {}
    for at, s in shapes.items():
        anchor = s.target_class or (s.target.classes[0] if isinstance(s.target, Instances) and s.target.classes == (s.iri,) else None)
        if at in named["privateShape"]:
            seen = "excluded"
        elif at in named["publicShape"] or anchor in classes["publicClass"]:
            seen = "public"
        elif at in named["protectedShape"] or anchor in classes["protectedClass"] or at.startswith(SYNTHETIC):
            seen = "protected"
        else:
            seen = "excluded"
        if seen == "public" and not s.targeted:
            warnings.warn(f"{at} has no target and is protected, not public", stacklevel=2)
            seen = "protected"
        out[at] = replace(s, visibility=seen)
    for s in out.values():
        for f in s.fields.values() if s.visibility != "excluded" else ():
            if f.target_shape and out[f.target_shape].visibility == "excluded":
                raise ShapeError(f"{s.name}.{f.name} leads to {f.target_shape}, which the schema does not publish")
    return out


def parse_shapes(graph: Graph, description_language: str = "en") -> Registry:
    """Reads all node shapes, resolves classes to shapes, flattens inheritance, applies visibility, in this order."""
    nodes = {x: None for kind in ("NodeShape", "ShapeClass") for x in graph.subjects(TYPE, iri(SH + kind)) if x.is_iri}
    shapes = {x.lex: _shape(graph, x, description_language) for x in nodes if not _off(graph, x)}
    by_class: dict[str, str] = {}
    for s in shapes.values():
        anchor = s.target_class or (s.iri if isinstance(s.target, Instances) and s.target.classes == (s.iri,) else None)
        if anchor and by_class.setdefault(anchor, s.iri) != s.iri:
            raise ShapeError(f"two shapes target the class {anchor}")
    made: dict[str, Shape] = {}
    for at, s in list(shapes.items()):
        fields = {}
        for name, f in s.fields.items():
            if f.kind == "relationship":
                target = f.target_shape or by_class.get(f.target_class)
                if target is None:
                    target = SYNTHETIC + f.target_class
                    made[target] = Shape(target, local_name(f.target_class), visibility="protected")
                elif target not in shapes:
                    raise ShapeError(f"{s.name}.{name} leads to the unknown shape {target}")
                f = replace(f, target_shape=target)
            fields[name] = f
        shapes[at] = replace(s, fields=fields)
    shapes = _visibility(graph, _inherit({**shapes, **made}))
    for s in shapes.values():
        derived = {f.path[1] for f in s.fields.values() if f.derived is not None}
        for f in s.fields.values():
            for e in (f.derived, f.default):
                if e is not None and (both := _predicates(e) & derived):
                    raise ShapeError(f"{s.name}.{f.name} reads the derived {', '.join(sorted(both))}")
    return Registry(list(shapes.values()))


def _predicates(expr: object) -> set[str]:
    """Predicates that an expression reads at the focus node."""
    if isinstance(expr, PathValues):
        if expr.focus is not None:
            return set()
        path = expr.path
        while path[0] != "pred":
            if path[0] == "inv":
                return set()
            if path[0] == "alt":
                return set().union(*(_predicates(PathValues(p)) for p in path[1]))
            path = path[1][0] if path[0] == "seq" else path[1]
        return {path[1]}
    if isinstance(expr, (FilterNodes, Exists)):
        return _predicates(expr.nodes)
    if isinstance(expr, If):
        return set().union(*(_predicates(x) for x in (expr.test, expr.then, expr.other) if x is not None))
    return set()


