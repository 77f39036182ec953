"""Personal data by patterns and a skip-chain conditional random field.

Nodes are the spans that the patterns find (their labels are evidence) and the look-alikes that they don't: tokens
with an @, runs of numbers. Neighbours along the text share a transition potential; all nodes of a key (the same
digits, the same last seven, the same name before the @) are joined to a hub of that key, however far apart they
are. So a repeated token costs one edge and not one for each pair, and any two of them are as near as two alone
would be. Loopy message passing, until no message changes, then carries labels from evidence to look-alikes. The
method adds a look-alike only if a hub reaches it, or it passes a pattern's checks by itself as a part of a run
that failed them, and if its label is nearly certain. All weights are learned from counts over all texts: those of a
span's looks (whether it passes checks is one of them), of neighbours, and of repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

KINDS = ("email", "ip", "card", "phone")
CERTAIN, NEAR = 0.75, 60
#: What is added to the counts of label pairs of repeats, and of equal ones, before any are seen; the chance that a look-alike is personal data
#: when learning starts, how often that is learned anew, and the steps each time.
PRIOR, SAME, UNSURE, TURNS, STEPS = 0.2, 20.0, 0.3, 4, 500
#: Messages of a text are done when none changes by more. One that swings on is damped more after each PATIENCE rounds,
#: until a step is less than LEAST_STEP; its last messages hold then.
TOLERANCE, PATIENCE, LEAST_STEP = 1e-4, 200, 1 / 256

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_DIGITS = re.compile(r"[0-9]+")
#: Where a run of numbers falls into parts: beside nine digits or more in a row, and before a plus.
_PARTS = re.compile(r"\x20(?=[0-9]{9})|(?<=[0-9]{9})\x20|\x20(?=\+)")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (x * 2 if x < 5 else x * 2 - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: the run before it cannot hold another start that would match where this one fails."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, floor
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start."""
    out: list[Span] = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def look_alikes(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Spans that might be personal data and touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    found = []
    at = text.find("@") if "@" in text else -1
    while at >= 0:
        start = at
        while start and not _SPACE.match(text[start - 1]):
            start -= 1
        after = _SPACE.search(text, at)
        end = after.start() if after else len(text)
        if end - start > 3:
            found.append((start, end))
        at = text.find("@", end)
    for m in _NUMBER.finditer(text):
        start = m.start()
        for cut in _PARTS.finditer(m[0]):
            found.append((start, m.start() + cut.start()))
            start = m.start() + cut.end()
        found.append((start, m.end()))
    out, k, floor = [], 0, 0
    for a, b in sorted(found):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= floor and (k == len(taken) or taken[k][0] >= b):
            out.append((a, b))
            floor = b
    return out


def shape(span: str) -> tuple[int, ...]:
    """Features of a span's looks; the last two say whether it passes the checks of a card or of a phone number."""
    digits = sum(map(len, _DIGITS.findall(span)))
    dots, passes = span.count("."), whole(span)
    return (
        1, "@" in span, span[0] == "+", digits == 0, 0 < digits < 7, 7 <= digits < 9, 9 <= digits < 13, 13 <= digits < 20, digits >= 20,
        dots == 0, 0 < dots < 3, dots == 3, "(" in span, "-" in span, " " in span, any(map(str.isalpha, span)), passes == 3, passes == 4,
    )


def whole(span: str) -> int:
    """The label of a span that passes a pattern's checks by itself; else 0."""
    digits = "".join(_DIGITS.findall(span))
    if 13 <= len(digits) <= 19 and _CARD.fullmatch(span) and luhn(digits):
        return 3
    return 4 if 9 <= len(digits) <= 15 and _PHONE.fullmatch(span) else 0


def keys(span: str) -> list[str]:
    if "@" in span:
        return ["@" + span.split("@")[0].lower()]
    digits = "".join(_DIGITS.findall(span))
    return [digits, "~" + digits[-7:]] if len(digits) >= 7 else []


@dataclass
class Potentials:
    unary: np.ndarray
    chain: np.ndarray
    #: Between a node and a hub: two nodes through a hub are as one skip edge between them.
    hub: np.ndarray


#: What is counted: spans by bits of their shape and label, label pairs of neighbours and of repeats.
SEEN, NEIGHBOURS, REPEATS = range(3)


def count(text: str) -> Iterator[tuple[int, int, int]]:
    """All that potentials are estimated from; how many distinct ones there are has a bound."""
    spans, labels, near, names = nodes(text)
    for (a, b), label in zip(spans, labels, strict=True):
        yield SEEN, sum(bool(x) << k for k, x in enumerate(shape(text[a:b]))), label
    for what, pairs in ((NEIGHBOURS, near), (REPEATS, repeats(names))):
        for i, j in pairs:
            yield what, labels[i], labels[j]


def fit(samples: list[str]) -> Potentials:
    return estimate(Counter(x for text in samples for x in count(text)))


def estimate(counts: dict[tuple[int, int, int], int]) -> Potentials:
    """Piecewise: unary weights by logistic regression of labels on shapes. The label of a look-alike is hidden: it counts
    as UNSURE personal data of any kind at first, then as what the weights of the turn before say. Pair potentials by the
    counts of labels across each kind of edge; to those of repeats PRIOR is added, and SAME where labels agree: what the
    method holds of repeats before it sees any."""
    n = len(KINDS) + 1
    seen: Counter = Counter()
    chain, skip = np.full((n, n), 1.0), np.full((n, n), PRIOR) + np.eye(n) * SAME
    for (what, i, j), times in sorted(counts.items()):
        if what == SEEN:
            seen[tuple(i >> k & 1 for k in range(len(shape("0")))), j] = times
        elif what == NEIGHBOURS:
            chain[i, j] += times
            chain[j, i] += times
        elif i and j:
            # Labels of repeats are known where patterns found both; what a look-alike is, evidence shall tell.
            skip[i, j] += times
            skip[j, i] += times
    unary = np.zeros((len(shape("0")), n))
    if seen:
        x = np.array([k[0] for k in seen], float)
        y = np.zeros((len(seen), n))
        y[np.arange(len(seen)), [k[1] for k in seen]] = 1
        hidden = y[:, 0] > 0
        y[hidden] = [1 - UNSURE, *[UNSURE / len(KINDS)] * len(KINDS)]
        share = np.array(list(seen.values()), float)
        share /= share.sum()
        for turn in range(TURNS):
            if turn:
                y[hidden] = _softmax(x[hidden] @ unary)
            for _ in range(STEPS):
                p = _softmax(x @ unary)
                unary -= 2.0 * (x.T @ ((p - y) * share[:, None]) + 1e-4 * unary)
    else:
        unary[0, 0] = 4

    def potential(counts: np.ndarray) -> np.ndarray:
        p = counts / counts.sum()
        return np.log(p) - np.log(np.outer(p.sum(axis=1), p.sum(axis=0)))

    return Potentials(unary, np.clip(potential(chain), -2, 2), half(np.clip(potential(skip), -4, 4)))


def half(skip: np.ndarray) -> np.ndarray:
    """The potential that makes `skip` when it is passed twice. Rows are first scaled to equal sums, which keeps all odds
    ratios: a node that knows nothing then tells its hub nothing, however many there are."""
    table = np.exp(skip)
    while np.abs(table.sum(axis=1) - 1).max() > 1e-9:
        scale = 1 / np.sqrt(table.sum(axis=1))
        table = table * np.outer(scale, scale)
    values, vectors = np.linalg.eigh(table)
    return np.log(np.maximum((vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T, 1e-4))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def nodes(text: str) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int]], list[list[str]]]:
    """Spans in order, their labels (0: a look-alike), pairs of neighbours, and each span's keys."""
    base = base_spans(text)
    found = sorted([(a, b, k + 1) for k, a, b in base] + [(a, b, 0) for a, b in look_alikes(text, base)]) if base or "@" in text or _NUMBER.search(text) else []
    near = [(i - 1, i) for i in range(1, len(found)) if found[i][0] - found[i - 1][1] <= NEAR]
    return [x[:2] for x in found], [x[2] for x in found], near, [keys(text[a:b]) for a, b, _ in found]


def repeats(names: list[list[str]]) -> set[tuple[int, int]]:
    """Pairs of a node and the nearest earlier one of the same key, from all nodes' keys: what skip potentials count."""
    last: dict[str, int] = {}
    out = set()
    for i, found in enumerate(names):
        for key in found:
            if key in last:
                out.add((last[key], i))
            last[key] = i
    return out


def hubs(names: list[list[str]]) -> tuple[int, list[tuple[int, int]]]:
    """How many hubs there are, and edges (node, hub) to them; they count on from the nodes. Nodes of the same digits
    have one, those of the same last seven one above it: no loops."""
    exact, wide = defaultdict(list), defaultdict(list)
    for i, found in enumerate(names):
        if found:
            exact[tuple(found)].append(i)
    size, edges = len(names), []

    def join(members: list[int]) -> int:
        nonlocal size
        edges.extend((i, size) for i in members)
        size += 1
        return size - 1

    for found, members in exact.items():
        wide[found[-1]] += [join(members)] if len(found) > 1 and len(members) > 1 else members
    for members in wide.values():
        if len(members) > 1:
            join(members)
    return size - len(names), edges


def propagate(scores: np.ndarray, edges: np.ndarray, model: Potentials) -> np.ndarray:
    """Marginals of all nodes by damped sum-product messages along all edges (a node, another, 1 if that is a hub, the
    text) at once; a text leaves the rounds when its messages stand still."""
    if not len(edges):
        return _softmax(scores)
    size = len(edges)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    tables, kind, owner = np.exp(np.stack([model.chain, model.hub])), np.tile(edges[:, 2], 2), np.tile(edges[:, 3], 2)
    message = np.zeros((2 * size, scores.shape[1]))
    live, step, rounds = np.arange(size), 0.5, 0
    while len(live) and step >= LEAST_STEP:
        rows, back = np.concatenate([live, live + size]), np.concatenate([live + size, live])
        belief = scores.copy()
        np.add.at(belief, target[rows], message[rows])
        out = belief[source[rows]] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.maximum(np.einsum("ek,ekl->el", out, tables[kind[rows]]), 1e-30))
        change = new - new.max(axis=1, keepdims=True) - message[rows]
        message[rows] += step * change
        most = np.zeros(owner.max() + 1)
        np.maximum.at(most, owner[rows], np.abs(change).max(axis=1))
        live = live[most[owner[live]] > TOLERANCE]
        rounds += 1
        if rounds % PATIENCE == 0:
            step /= 2
    belief = scores.copy()
    np.add.at(belief, target, message)
    return _softmax(belief)


def find(data: list[str], model: Potentials) -> list[tuple[list[Span], list[Span]]]:
    """Of each text: its base spans, and all spans, both by kind, then start."""
    out, graph, linked, at = [], [], set(), 0
    for number, text in enumerate(data):
        spans, labels, near, names = nodes(text) if "@" in text or _DIGITS.search(text) else ([], [], [], [])
        extra, joined = hubs(names)
        out.append((spans, labels, names, at))
        # Neighbours of one key are tied by its hub; a transition is between different things.
        graph += [(i + at, j + at, 0, number) for i, j in near if not names[i] or names[i][-1] not in names[j]] + [(i + at, j + at, 1, number) for i, j in joined]
        linked.update(i + at for i, _ in joined)
        at += len(spans) + extra
    scores, evident = np.zeros((at, len(KINDS) + 1)), set()  # hubs look like nothing
    for text, (spans, labels, names, first) in zip(data, out, strict=True):
        # What a look-alike's looks say is said once for all that share its key, not again by each.
        alike = Counter(found[-1] for found, label in zip(names, labels, strict=True) if found and not label)
        for k, ((a, b), label, found) in enumerate(zip(spans, labels, names, strict=True)):
            if label:
                scores[first + k] = -20
                scores[first + k, label] = 0
            else:
                scores[first + k] = np.array(shape(text[a:b]), float) @ model.unary / (alike[found[-1]] if found else 1)
                if whole(text[a:b]):
                    evident.add(first + k)
    marginal = propagate(scores, np.array(graph, np.int64).reshape(-1, 4), model)
    result = []
    for spans, labels, _, first in out:
        base = sorted((label - 1, a, b) for (a, b), label in zip(spans, labels, strict=True) if label)
        extra = []
        for k, (a, b) in enumerate(spans):
            if not labels[k] and (first + k in linked or first + k in evident) and (best := int(marginal[first + k].argmax())) and marginal[first + k, best] >= CERTAIN:
                extra.append((best - 1, a, b))
        result.append((base, sorted(base + extra)))
    return result


def write(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def learn(docs: DataFrame, text_col: str = "text") -> Potentials:
    """Potentials from all spans of all texts; only sums cross to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in slices(batches, "text"):
            for x in texts(part, "text"):
                held.update(count(x.decode("utf-8", "replace")))
        what, i, j = zip(*held, strict=True) if held else ((), (), ())
        yield pa.RecordBatch.from_pydict({"what": pa.array(what, pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(list(held.values()), pa.int64())})

    found = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "what int, i int, j int, n bigint").groupBy("what", "i", "j").agg(F.sum("n").alias("n")).collect()
    return estimate({(r.what, r.i, r.j): r.n for r in found})


def spans(docs: DataFrame, model: Potentials, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of base spans by kind, base_sha256, spans (all). Null and empty texts have none; a null id stays
    null; repeated rows repeat; an empty table gives none."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    plain = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = find([x.decode("utf-8", "replace") for x in texts(part, "text")], shared.value)
            columns = {f"n_{k}": pa.array([sum(s[0] == i for s in base) for base, _ in found], pa.int64()) for i, k in enumerate(KINDS)}
            yield pa.RecordBatch.from_pydict({id_col: part.column(0)} | columns | {"base_sha256": [hashlib.sha256(write(base).encode()).hexdigest() for base, _ in found], "spans": [write(every) for _, every in found]})

    return plain.mapInArrow(run, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str, every: list[Span]) -> str:
    """The text with [KIND] in place of each span, of the first kind where spans overlap."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in every):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: Potentials, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """docs with personal data masked, all other columns as they were; size_col gets the new length. Null and empty
    texts and null ids stay; repeated rows repeat; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            data = part.column(text_col).to_pylist()
            found = find([x or "" for x in data], shared.value)
            new = [None if x is None else masked(x, every) if every else x for x, (_, every) in zip(data, found, strict=True)]
            at = part.schema.get_field_index(text_col)
            part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
            if size_col:
                at = part.schema.get_field_index(size_col)
                part = part.set_column(at, part.schema.field(at), pa.array([None if x is None else len(x) for x in new], part.schema.field(at).type))
            yield part

    return docs.mapInArrow(run, docs.schema)
