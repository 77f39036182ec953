"""Self-join of documents whose sets of word shingles have a Jaccard similarity of 0.75 or more.

Equal sets become one class first. Two sets that are similar share one of their first shingles, in an order that
puts shingles met often in a sample last (any order is right; this one keeps groups small). The classes that share
such a shingle join the unit of the least of them, so that the many shingles of one family of near copies make one
unit; a large unit is cut into chunks, and later into pairs of chunks.

In a unit, a set is a point: the counts of its shingles by hash group. An R-tree over the points bounds the overlap
of a query and all points below a node by the summed minima of the query's coordinates and the node's largest.
Members without a partner that the bound admits leave. The rest are verified on their sets: first each with its
likeliest partner, which ties most near copies together, then with all partners outside its component. So no
link between components is lost, and of the many links inside one only a spanning few are rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored, texts

SHINGLE = 5
#: Members of a chunk, about; what one task compares at a time holds two chunks at most.
CHUNK = 512
#: One class in SAMPLED is in the sample, with its shingles under SAMPLED_BELOW (others hardly come first); a shingle
#: that OFTEN of them have is put last. At most ORDERED such shingles travel to the workers.
SAMPLED, SAMPLED_BELOW, OFTEN, ORDERED = 8, np.uint64(int(0.4 * 2**64)), 4, 500_000
#: First shingles that one reducer takes, and reducers at least.
TAKEN, REDUCERS = 1_500_000, 48
LEAF, FANOUT, GROUPS = 16, 8, 128
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def similar(shared, a, b):
    """100 * intersection >= 75 * union, in whole numbers."""
    return 7 * shared >= 3 * (a + b)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x if first.all() else x[first]


def shingle_sets(data: list[bytes]) -> list[np.ndarray]:
    """Of each text: its distinct shingles as sorted 64-bit hashes."""
    split = [x.translate(_LOWER).split() for x in data]
    count = np.array([len(x) for x in split], np.int64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, int(count.sum()))
    rolled = words.copy()
    for k in range(1, SHINGLE):
        rolled = rolled[:-1] * _STEP + words[k:]
    rolled = _mix(rolled)
    out, at = [], 0
    for n in count.tolist():
        if n >= SHINGLE:
            out.append(_distinct(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            out.append(np.array([xxhash.xxh64_intdigest(words[at : at + n].tobytes(), seed=n)], np.uint64))
        else:
            out.append(words[:0])
        at += n
    return out


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit digest of a set, signed as Spark's longs are."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def prefix(shingles: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set: those not in `often` (sorted) by hash, then the others by falling rarity."""
    size = prefix_length(len(shingles))
    if not len(often):
        return shingles[:size]
    at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
    known = often[at] == shingles
    rare = shingles[~known]
    if len(rare) >= size:
        return rare[:size]
    late = shingles[known][np.argsort(rank[at[known]], kind="stable")]
    return np.concatenate([rare, late[: size - len(rare)]])


def level_of(n: int) -> int:
    level = 0
    while n >= 512 * 4**level:
        level += 1
    return level


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts by group; the groups grow with the set, so that a count is 4 on average at most and fits a byte."""
    groups = GROUPS * 4 ** level_of(len(shingles))
    counts = np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups)
    if counts.max() > 255:
        raise OverflowError("a group's count exceeds a byte")
    return counts.astype(np.uint8)


class CountTree:
    """An R-tree over count vectors, packed from points in the order of components and sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray):
        self.order = np.lexsort((points[:, 0], sizes, components))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order], components[self.order], components[self.order])]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            top, low, high, first, last = self.levels[-1]
            starts = np.arange(0, len(top), step)
            self.levels.append((np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts)))
            step = FANOUT
        self.steps = [LEAF] + [FANOUT] * len(self.levels)

    def search(self, query: np.ndarray, size: int, component: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the given points) that may be similar and are of other components, and their bounds."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high, first, last = (x[nodes] for x in self.levels[depth])
            bound = np.minimum(top, query).sum(axis=1, dtype=np.int32)
            ok = similar(bound, size, low) & (4 * high >= 3 * size) & (3 * low <= 4 * size) & ((first != component) | (last != component))
            nodes, bound = nodes[ok], bound[ok]
            if not depth:
                return self.order[nodes], bound
            step = self.steps[depth - 1]
            nodes = (nodes[:, None] * step + np.arange(step)).ravel()
            nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        raise AssertionError


def partners(components: np.ndarray, sizes: np.ndarray, points: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Places i, js of a unit that may be similar and are of different components, and bounds of their overlaps;
    of each pair at least one way round."""
    vectors = [np.frombuffer(x, np.uint8) for x in points]
    levels = np.array([level_of(n) for n in sizes.tolist()])
    for level in np.unique(levels).tolist():
        members = np.flatnonzero((levels == level) | (levels == level + 1))
        groups = GROUPS * 4**level
        # Folded, a coordinate sums four; a sum beyond a byte needs a wider kind.
        folded = np.stack([x if len(x) == groups else x.reshape(-1, groups).sum(axis=0, dtype=np.uint16) for x in (vectors[i] for i in members)])
        tree = CountTree(folded, sizes[members], components[members])
        for k in np.flatnonzero(levels[members] == level).tolist():
            hits, bounds = tree.search(folded[k], int(sizes[members[k]]), int(components[members[k]]))
            own = hits != k
            if own.any():
                yield int(members[k]), members[hits[own]], bounds[own]


def links_in(components: np.ndarray, sets: list[bytes]) -> list[tuple[int, int]]:
    """Places of similar sets, enough of them to tie together all that links inside the unit tie together; none
    within a component."""
    values = [unpack(x) for x in sets]
    sizes = np.array([len(x) for x in values])
    points = [point(x).tobytes() for x in values]
    shingles, ids = np.unique(np.concatenate(values), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(shingles), bool)
    parent = list(range(len(sets)))
    first_of: dict[int, int] = {}
    for i, c in enumerate(components.tolist()):
        parent[i] = first_of.setdefault(c, i)
    found: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def verify(i: int, js: list[int]) -> None:
        """Tries js in order, passing over those that have joined i's tree meanwhile."""
        if not js:
            return
        own = slice(starts[i], starts[i] + sizes[i])
        marked[ids[own]] = True
        many = np.add.reduceat(marked[ids], starts) if len(js) * 4 > len(sets) else None
        for j in js:
            a, b = root(i), root(j)
            if a != b:
                shared = int(many[j]) if many is not None else int(marked[ids[starts[j] : starts[j] + sizes[j]]].sum())
                if similar(shared, sizes[i], sizes[j]):
                    parent[max(a, b)] = min(a, b)
                    found.append((i, j))
        marked[ids[own]] = False

    likely: dict[int, tuple[float, int]] = {}
    for i, js, bounds in partners(components, sizes, points):
        share = bounds / (sizes[i] + sizes[js])
        k = int(share.argmax())
        likely[i] = (float(share[k]), int(js[k]))
        for j, x in zip(js.tolist(), share.tolist(), strict=True):
            if j not in likely or likely[j][0] < x:
                likely[j] = (x, i)
    for i, (_, j) in likely.items():
        verify(i, [j])
    now = np.array([root(i) for i in range(len(sets))])
    if likely and len(np.unique(now)) > 1:
        for i, js, _ in partners(now, sizes, points):
            verify(i, js.tolist())
    return found


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of each key, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def signatures(plain: DataFrame) -> DataFrame:
    """id, n, class; once a task for each class its point, and of one class in SAMPLED the shingles."""
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for part in slices(batches, "text"):
            sets = shingle_sets(texts(part, "text"))
            classes = [class_of(x) if len(x) else None for x in sets]
            sample, points = [], []
            for c, x in zip(classes, sets, strict=True):
                new = c is not None and c not in met
                if new:
                    met.add(c)
                points.append(point(x).tobytes() if new else None)
                take = new and c % SAMPLED == 0
                sample.append(x[: np.searchsorted(x, SAMPLED_BELOW)].view(np.int64) if take else None)
            yield pa.RecordBatch.from_pydict({"id": part.column(0), "n": pa.array([len(x) for x in sets], pa.int64()), "class": pa.array(classes, pa.int64()), "point": pa.array(points, pa.binary()), "sample": pa.array(sample, pa.list_(pa.int64()))})

    return plain.mapInArrow(run, f"id {kind}, n bigint, class bigint, point binary, sample array<bigint>")


def often_met(signed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many classes have, sorted, and their ranks: the rarest is 0."""
    sample = signed.where("sample is not null").select(F.explode("sample").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    found = sample.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(ORDERED).toArrow()
    shingles = found.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], (len(order) - 1 - np.arange(len(order)))[order]


def stars(plain: DataFrame, often: tuple[np.ndarray, np.ndarray], reducers: int) -> DataFrame:
    """unit, class: the classes that share a first shingle with others, in the unit of the least of them, which is
    named for it. Distinct."""
    shared = plain.sparkSession.sparkContext.broadcast(often)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens, classes = np.concatenate(held), np.concatenate(owner)
            part = ((tokens >> np.uint64(40)) % np.uint64(reducers)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            tokens, classes = tokens[order], classes[order]
            cuts = np.searchsorted(part[order], np.arange(reducers + 1))
            some = np.flatnonzero(np.diff(cuts))
            # Five bytes of a shingle tell those of one reducer apart well enough: a clash adds a candidate, no link.
            packed = [np.ascontiguousarray(tokens[cuts[i] : cuts[i + 1]].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for i in some]
            return pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int64()), "shingles": pa.array(packed, pa.binary()), "classes": pa.array([classes[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())})

        for part in slices(batches, "text"):
            for x in shingle_sets(texts(part, "text")):
                if not len(x) or (c := class_of(x)) in met:
                    continue
                met.add(c)
                first = prefix(x, *shared.value)
                held.append(first)
                owner.append(np.full(len(first), c, np.int64))
            if sum(map(len, held)) > TAKEN // 2:
                yield flush()
                held.clear()
                owner.clear()
        if held:
            yield flush()

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(rows.column("shingles").to_pylist()), np.uint8).reshape(-1, 5)
        tokens = np.zeros((len(raw), 8), np.uint8)
        tokens[:, :5] = raw
        tokens = tokens.view(np.uint64).ravel()
        classes = np.frombuffer(b"".join(rows.column("classes").to_pylist()), np.int64)
        order = np.lexsort((classes, tokens))
        tokens, classes = tokens[order], classes[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        sizes = np.diff(np.append(starts, len(tokens)))
        least = np.repeat(classes[starts], sizes)
        several = np.repeat(classes[np.append(starts[1:], len(tokens)) - 1] != classes[starts], sizes)
        pairs = np.unique(np.stack([least[several], classes[several]], axis=1), axis=0)
        return pa.table({"unit": pa.array(pairs[:, 0]), "class": pa.array(pairs[:, 1])})

    packed = plain.mapInArrow(emit, "part bigint, shingles binary, classes binary")
    return packed.groupBy("part").applyInArrow(gather, "unit bigint, class bigint").distinct()


def hopeful(rows: DataFrame, points: DataFrame) -> DataFrame:
    """The rows (unit, class, component) that have a partner that the bound admits, in another component."""
    ordered = rows.join(points, "class").select("unit", "class", "component", "n", "point").repartition("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _runs(batches, "unit"):
            if unit.num_rows < 2:
                continue
            sizes = unit.column("n").to_numpy()
            near = np.sort(sizes)
            if not (4 * near[:-1] >= 3 * near[1:]).any():
                continue
            kept = np.zeros(unit.num_rows, bool)
            for i, js, _ in partners(unit.column("component").to_numpy(), sizes, unit.column("point").to_pylist()):
                kept[i] = True
                kept[js] = True
            if kept.any():
                yield from unit.select(["unit", "class", "component"]).filter(pa.array(kept)).combine_chunks().to_batches()

    return ordered.mapInArrow(run, "unit bigint, class bigint, component bigint")


def links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: verified links of rows (unit, class, component), spanning in each unit."""
    ordered = rows.join(sets.select("class", "shingles"), "class").select("unit", "class", "component", "shingles").repartition("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _runs(batches, "unit"):
            if unit.num_rows > 1:
                classes = unit.column("class").to_numpy()
                found = np.array(links_in(unit.column("component").to_numpy(), unit.column("shingles").to_pylist()), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"a": pa.array(classes[found[:, 0]]), "b": pa.array(classes[found[:, 1]])})

    return ordered.mapInArrow(run, "a bigint, b bigint")


def sets_of(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, shingles (40 bits of each, packed) of the wanted (id, class), each class once."""
    wanted = wanted.select(F.col("id").alias("w_id"), F.col("class").alias("w_class")).hint("shuffle_hash")
    rows = plain.join(wanted, plain["id"].eqNullSafe(wanted["w_id"])).select("w_class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for part in slices(batches, "text"):
            out = []
            for c, x in zip(part.column(0).to_pylist(), shingle_sets(texts(part, "text")), strict=True):
                if len(x) and c not in met and class_of(x) == c:
                    met.add(c)
                    out.append((c, pack(x)))
            yield pa.RecordBatch.from_pydict({"class": pa.array([x[0] for x in out], pa.int64()), "shingles": pa.array([x[1] for x in out], pa.binary())})

    return rows.mapInArrow(run, "class bigint, shingles binary")


def pack(shingles: np.ndarray) -> bytes:
    low = np.sort(shingles & np.uint64((1 << 40) - 1))
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """class, component (its least class) of the classes that edges (a, b) touch: least labels of neighbours, then
    labels of labels, until none changes. Each round is a table in the shared folder."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "class"), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("class").alias("b"), "label"), "b").groupBy(F.col("a").alias("class")).agg(F.min("label").alias("near"))
        least = labels.join(near, "class").select("class", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = least.select(F.col("class").alias("label"), F.col("label").alias("further"))
        # Near copies share labels: AQE splits a label that many classes have.
        new = stored(least.join(jump, "label").select("class", "old", F.least("label", "further").alias("label")), "labels")
        labels = new.select("class", "label")
        if not new.where("old != label").limit(1).count():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, class, component_id of every row of docs."""
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    signed = stored(signatures(plain), "signatures")
    narrow = signed.select("id", "n", "class")
    classes = narrow.where("n > 0").groupBy("class").agg(F.min("id").alias("id"))
    total = signed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    reducers = max(REDUCERS, -(-total // 4 // TAKEN))
    members = stored(stars(plain, often_met(signed), reducers), "members")
    points = stored(signed.where("point is not null").groupBy("class").agg(F.max("n").alias("n"), F.max("point").alias("point")), "points")
    # A unit of several chunks: its members go to chunks by hash, and the one that it is named for meets them all.
    large = stored(members.groupBy("unit").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).where("chunks > 1"), "large-units")
    rows = members.join(large, "unit", "left")
    placed = rows.where("chunks is not null").withColumn("chunk", F.pmod(F.xxhash64("class"), "chunks"))
    chunk_unit = F.xxhash64("unit", "chunk")
    named = large.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).select(chunk_unit.alias("unit"), F.col("unit").alias("class"))
    first = rows.where("chunks is null").select("unit", "class").union(placed.where("unit != class").select(chunk_unit.alias("unit"), "class")).union(named)
    hoping = stored(hopeful(first.withColumn("component", F.col("class")), points), "hopeful")
    # Texts move once, for the sets of the classes that may have links in their unit, or in chunks yet to meet.
    wanted = hoping.select("class").union(placed.select("class")).distinct()
    sets = stored(sets_of(plain, classes.join(wanted, "class", "left_semi")), "sets")
    linked = stored(links(hoping, sets), "links")
    final = components(linked)
    if large.limit(1).count():
        # Pairs of chunks, but those whose members are all in one component by now.
        labelled = stored(placed.join(final, "class", "left").select("unit", "chunk", "class", F.coalesce("component", "class").alias("component")), "placed")
        state = stored(labelled.groupBy("unit", "chunk").agg(F.min("component").alias("low"), F.max("component").alias("high")), "chunks")
        other = state.select("unit", *(F.col(c).alias(c + "_2") for c in ("chunk", "low", "high")))
        pairs = state.join(other, "unit").where("chunk < chunk_2 and not (low = high and low = low_2 and low = high_2)")
        pairs = pairs.select("unit", F.xxhash64("unit", "chunk", "chunk_2").alias("pair"), F.explode(F.array("chunk", "chunk_2")).alias("chunk"))
        second = pairs.join(labelled, ["unit", "chunk"]).select(F.col("pair").alias("unit"), "class", "component")
        more = stored(links(stored(hopeful(second, points), "hopeful"), sets), "links")
        final = components(linked.union(more))
    found = classes.join(final, "class", "left").select("class", "id", F.coalesce("component", "class").alias("component"))
    least = stored(found.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    whole = found.join(least, "component").select("class", "component_id")
    # A class may hold a third of all rows: AQE splits this join of narrow rows.
    return narrow.join(whole, "class", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id that links reach) of every row of docs.

    A null or empty text has an empty set and links with nothing: its component is its own id. A null id is
    never a component's least unless all of its ids are null. Repeated rows repeat; an empty table gives none.
    """
    return _joined(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row of its least id, all columns as they were; one row where rows repeat that id with
    the same shingles. Rows with a null id stay only if none of their component has one."""
    found = stored(_joined(docs, id_col, text_col), "components")
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("k_id"), F.coalesce("class", F.lit(0)).alias("k_class"))
    repeated = stored(found.groupBy(F.col("id").alias("r_id")).agg(F.count("*").alias("rows")).where("rows > 1").select("r_id"), "repeated")
    # The rows of ids that stand alone need no second look at their text.
    once = stored(kept.join(repeated, kept["k_id"].eqNullSafe(repeated["r_id"]), "left_anti").select("k_id"), "kept").hint("shuffle_hash")
    single = docs.join(once, docs[id_col].eqNullSafe(once["k_id"]), "left_semi")
    if not repeated.limit(1).count():
        return single

    extra = "_class"
    while extra in docs.columns:
        extra += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            classes = [class_of(x) if len(x) else 0 for x in shingle_sets(texts(part, text_col))]
            yield part.append_column(extra, pa.array(classes, pa.int64()))

    several = docs.join(repeated, docs[id_col].eqNullSafe(repeated["r_id"]), "left_semi").mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(extra, T.LongType())]))
    chosen = kept.distinct()
    several = several.join(chosen, several[id_col].eqNullSafe(chosen["k_id"]) & (several[extra] == chosen["k_class"]), "left_semi").dropDuplicates([id_col, extra])
    return single.unionByName(several.drop(extra))
