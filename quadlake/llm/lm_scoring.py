"""Language-model scoring by a Brown class-based bigram model.

Brown's algorithm. The MERGED most frequent words, the most frequent first: the first CLASSES words are classes of their
own; each further word becomes one more class, and then those two of all classes merge whose merging loses the least
average mutual information of neighbouring classes. Afterwards each of these words moves, one at a time, to the class
under which that information is greatest, until none moves. The words behind them, however many there are, come far
more seldom than any class; each joins the class that its neighbours on both sides share most information with, all
against the table of the merged words: first those of the FREQUENT words, then all others.

A text's probability is the product of its class transitions and of its words' emissions from their classes, both
smoothed. A word has one class, before another word as well as behind one. What travels to every worker is bounded: the
class tables and the counts and classes of FREQUENT words; those of all other words are joined to the texts by the
64-bit hash of the word. Such a word, and one that training lacks, stands before another as its lump (words of one
ending): with the class that most frequent words of that ending have. Every count is of all training rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts

#: Words that merge one by one on the driver, which holds the matrix of their bigrams; classes; sweeps of moves at most.
MERGED, CLASSES, SWEEPS = 2048, 64, 8
#: Lumps of words by ending, the first of which is the end of a text; short words have lumps of their own.
LUMPS, SHORT, SHORT_LUMPS = 768, 4, 256
#: Words whose counts and classes go to every worker at most, 18 bytes each; a bound of the broadcast, whatever the corpus.
FREQUENT = 300_000
#: Distinct words, or pairs of a word and what stands before it, that a task counts before it hands them on.
HELD_WORDS, HELD_PAIRS = 300_000, 1_500_000
EMISSION, TRANSITION = 0.5, 0.1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: What stands for a word in counts: its hash, its lump; then the class before it, or that behind it plus the number of classes, and how often.
_ROW = np.dtype([("word", "<u8"), ("lump", "<u2"), ("before", "<u2"), ("n", "<u4")])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def remainder(id_col) -> F.Column:
    """crc32 of an id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def hash_of(word: bytes) -> int:
    """The end of a text is the empty word."""
    return xxhash.xxh64_intdigest(word)


def lump_of(word: bytes) -> int:
    if len(word) <= SHORT:
        return 1 + zlib.crc32(word) % (SHORT_LUMPS - 1) if word else 0
    return SHORT_LUMPS + zlib.crc32(word[-3:]) % (LUMPS - SHORT_LUMPS)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, but for what no change of classes changes."""
    return float(_f(table).sum() - _f(table.sum(axis=1)).sum() - _f(table.sum(axis=0)).sum())


def merge(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each word by Brown's merging, from the matrix of bigrams of words in order of their frequency. A
    class more than `classes` stands in the table at a time; the pair whose merging loses least ends that."""
    units = len(pairs)
    of = np.arange(units)
    if units <= classes:
        return of
    back, size = np.ascontiguousarray(pairs.T), classes + 1
    table = np.zeros((size, size))
    # Of each two classes: the sum of _f over their rows, or columns, if they were one.
    sums = np.zeros((2, size, size))
    both = [(sums[0], table), (sums[1], table.T)]
    together = lambda x: _f(x[:, None] + x)

    def renew(k: int) -> None:
        for x, t in both:
            x[k] = x[:, k] = _f(t + t[k]).sum(axis=1)

    free = 0
    for w in range(units):
        slot = w if w < size else free
        table[slot] = np.bincount(of[:w], weights=pairs[w, :w], minlength=size)
        table[:, slot] = np.bincount(of[:w], weights=back[w, :w], minlength=size)
        table[slot, slot] = pairs[w, w]
        of[w] = slot
        if w < classes:
            continue
        for x, t in both:
            for m in range(size) if w == classes else [slot]:
                x += together(t[:, m])
        renew(slot)
        value, own = _f(table), np.diag(table)
        gain = -value - value.T
        for x, t in both:
            # Their own two cells are no longer in the sum of a row, or a column; they meet in the corner.
            cell = _f(t + own)
            of_row, total = _f(t).sum(axis=1), t.sum(axis=1)
            gain += x - cell - cell.T + value + value.T - of_row[:, None] - of_row
            gain += np.diag(value)[:, None] + np.diag(value)
            gain -= together(total) - _f(total)[:, None] - _f(total)
        gain += _f(table + table.T + own[:, None] + own) - np.diag(value)[:, None] - np.diag(value)
        np.fill_diagonal(gain, -np.inf)
        k, free = sorted(divmod(int(np.argmax(gain)), size))
        for x, t in both:
            x -= together(t[:, k]) + together(t[:, free])
        table[k] += table[free]
        table[:, k] += table[:, free]
        table[free] = table[:, free] = 0
        for x, t in both:
            x += together(t[:, k])
        renew(k)
        of[of == free] = k
    return np.unique(of, return_inverse=True)[1]


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, start: np.ndarray | None = None) -> np.ndarray:
    """The class of each unit, from the matrix of unit bigrams: one by one, the most frequent first, each moves to the
    class that raises the likelihood most; a sweep without moves is the last."""
    units = len(pairs)
    classes = min(classes, units)
    weight = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    of = np.empty(units, np.int64)
    of[order] = np.arange(units) % classes if start is None else start[order]
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    table = member.T @ pairs @ member
    each = np.arange(classes)
    for _ in range(sweeps):
        moves = 0
        for w in order:
            if not weight[w]:
                continue
            a, same = of[w], pairs[w, w]
            member[w, a] = 0
            right, left = pairs[w] @ member, pairs[:, w] @ member
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= same
            rows, columns, corner = table.sum(axis=1) + left, table.sum(axis=0) + right, table[each, each]
            gain = (_f(table + right) - _f(table)).sum(axis=1) + (_f(table.T + left) - _f(table.T)).sum(axis=1)
            gain += _f(corner + right + left + same) - _f(corner + right) - _f(corner + left) + _f(corner)
            gain -= _f(rows + right.sum() + same) - _f(rows) + _f(columns + left.sum() + same) - _f(columns)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moves += b != a
            of[w] = b
            member[w, b] = 1
            table[b] += right
            table[:, b] += left
            table[b, b] += same
        if not moves:
            break
    return of


@dataclass
class Lexicon:
    """Counts and classes of frequent words, in order of their hashes."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands, and whether it does."""
        if not len(self.hashes):
            return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return at, self.hashes[at] == found


def word_counts(training: DataFrame) -> DataFrame:
    """word (its hash), lump, n of all words of all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            found = {
                "word": pa.array(np.array([hash_of(x) for x in held], np.uint64).view(np.int64)),
                "lump": pa.array(np.array([lump_of(x) for x in held], np.int16)), "n": pa.array(np.array(list(held.values()), np.int64)),
            }
            held.clear()
            return pa.RecordBatch.from_pydict(found)

        for part in slices(batches, "text"):
            for x in texts(part, "text"):
                held.update(words_of(x))
            held[b""] += part.num_rows
            if len(held) > HELD_WORDS:
                yield flush()
        if held:
            yield flush()

    return training.mapInArrow(run, "word bigint, lump smallint, n bigint").groupBy("word").agg(F.min("lump").alias("lump"), F.sum("n").alias("n"))


_PAIR = np.dtype([("pair", "<u4"), ("n", "<u4")])


def bigrams(training: DataFrame, hashes: np.ndarray, parts: int) -> np.ndarray:
    """The matrix of bigrams of these words, in their order; a text ends and begins with the empty word."""
    units = len(hashes)
    order = np.argsort(hashes)
    shared = training.sparkSession.sparkContext.broadcast(Lexicon(hashes[order], order, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        number: dict[bytes, int] = {}
        table = np.zeros(units * units, np.uint32)
        for part in slices(batches, "text"):
            split = [words_of(x) for x in texts(part, "text")]
            if len(number) > HELD_WORDS:
                number.clear()
            names = [b"", *set().union(*split).difference(number)]
            at, known = lexicon.find(np.array([hash_of(x) for x in names], np.uint64))
            number.update(zip(names, np.where(known, lexicon.classes[at], -1).tolist(), strict=True))
            end = number[b""]
            ids = np.array([u for x in split for u in (*map(number.__getitem__, x), end)], np.int64)
            before = np.concatenate([[end], ids[:-1]])
            keys, n = np.unique((before * units + ids)[(before >= 0) & (ids >= 0)], return_counts=True)
            table[keys] += n.astype(np.uint32)
        some = np.flatnonzero(table)
        rows = np.empty(len(some), _PAIR)
        rows["pair"], rows["n"] = some, table[some]
        cuts = np.searchsorted(some, np.arange(parts + 1) * (units * units) // parts)
        full = np.flatnonzero(np.diff(cuts))
        yield pa.RecordBatch.from_pydict({"part": pa.array(full, pa.int32()), "rows": pa.array([rows[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())})

    def one(group: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_buffer(), _PAIR) for x in group.column("rows")])
        least = int(rows["pair"].min())
        table = np.bincount(rows["pair"] - np.uint32(least), weights=rows["n"])
        some = np.flatnonzero(table)
        return pa.table({"pair": pa.array((some + least).astype(np.int32)), "n": pa.array(table[some].astype(np.int64))})

    found = training.mapInArrow(run, "part int, rows binary").groupBy("part").applyInArrow(one, "pair int, n bigint").toArrow()
    shared.unpersist()
    table = np.zeros(units * units)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(units, units)


def contexts(training: DataFrame, shared, parts: int, size: int) -> DataFrame:
    """part, rows: how often each word that is asked for stands behind and before which class, as packed _ROWs dealt by
    hash. The broadcast is (lexicon, class of each lump or None). With None the words of the lexicon without a class
    are asked for, by neighbours that have one. Otherwise those outside it are, by all neighbours; and part -1 holds
    the bigrams of classes whose second word is in the lexicon, its class in place of the lump."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, lump_class = shared.value
        number: dict[bytes, int] = {}
        word = lump = of = asked = np.zeros(0, np.int64)
        table = np.zeros(size * size, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def learn(names: list[bytes]) -> None:
            nonlocal word, lump, of, asked
            number.update(zip(names, range(len(number), len(number) + len(names)), strict=True))
            hashes, lumps = np.array([hash_of(x) for x in names], np.uint64), np.array([lump_of(x) for x in names], np.int64)
            at, known = lexicon.find(hashes)
            mine = np.where(known, lexicon.classes[at], -1).astype(np.int64) if len(lexicon.hashes) else np.full(len(names), -1)
            ask = known & (mine < 0) if lump_class is None else ~known
            if lump_class is not None:
                mine = np.where(known, mine, lump_class[lumps])
            word, lump, of, asked = np.concatenate([word, hashes.view(np.int64)]), np.concatenate([lump, lumps]), np.concatenate([of, mine]), np.concatenate([asked, ask])

        def sum_up() -> None:
            nonlocal held, total
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")  # runs in order, which it merges
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            held, total = [(keys[first], np.add.reduceat(n[order], first) if len(keys) else n)], len(first)

        def flush() -> pa.RecordBatch:
            nonlocal held, total
            sum_up()
            (keys, n), held, total = held[0], [], 0
            rows = np.empty(len(keys), _ROW)
            rows["word"], rows["lump"], rows["before"], rows["n"] = word[keys >> 16].view(np.uint64), lump[keys >> 16], keys & 0xFFFF, n
            part = (rows["word"] % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((rows["word"], part))
            rows, cuts = rows[order], np.searchsorted(part[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cuts))
            out = [rows[cuts[k] : cuts[k + 1]].tobytes() for k in some]
            pairs = np.flatnonzero(table)
            if len(pairs):
                whole = np.zeros(len(pairs), _ROW)
                whole["before"], whole["lump"], whole["n"] = pairs // size, pairs % size, table[pairs]
                table[:] = 0
                some, out = np.append(some, -1), [*out, whole.tobytes()]
            return pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "rows": pa.array(out, pa.binary())})

        learn([b""])
        for part in slices(batches, "text"):
            split = [words_of(x) for x in texts(part, "text")]
            learn(list(set().union(*split).difference(number)))
            # Every text ends; what stands before its first word is an end too.
            ids = np.array([u for x in split for u in (*map(number.__getitem__, x), 0)], np.int64)
            before = np.concatenate([[0], ids[:-1]])
            come, here = of[before], of[ids]
            behind, ahead = asked[ids].astype(bool) & (come >= 0), asked[before].astype(bool) & (here >= 0)
            if lump_class is not None:
                table += np.bincount((come * size + here)[~behind], minlength=size * size)
            keys, n = np.unique(np.concatenate([(ids << 16 | come)[behind], (before << 16 | here + size)[ahead]]), return_counts=True)
            held.append((keys, n))
            total += len(keys)
            if total > HELD_PAIRS:
                sum_up()
            if total > HELD_PAIRS // 2 or len(number) > HELD_WORDS:
                yield flush()
                number.clear()
                word, lump, of, asked = word[:0], lump[:0], of[:0], asked[:0]
                learn([b""])
        if held:
            yield flush()

    return training.mapInArrow(run, "part int, rows binary")


def by_class(counted: DataFrame, size: int) -> np.ndarray:
    """The sum of the tables of contexts: the class before by the class of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                rows = np.frombuffer(x.as_buffer(), _ROW)
                table += np.bincount(rows["before"].astype(np.int64) * size + rows["lump"], weights=rows["n"], minlength=size * size).astype(np.int64)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(some, pa.int32()), "n": pa.array(table[some])})

    found = counted.where("part < 0").select("rows").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(size, size)


def choices(rows: np.ndarray, lump_class: np.ndarray, table: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of rows in order of their hashes, their counts, the class that each joins, and the table of these
    rows: classes before by classes of words. A word joins the class that shares most information with the classes
    before it and, with `both`, behind it: what its merging with a class far larger than itself loses least by."""
    size = len(table)
    rows = rows[np.argsort(rows["word"], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], rows["word"][1:] != rows["word"][:-1]])) if len(rows) else np.zeros(0, np.int64)
    before = rows["before"].astype(np.int64)
    n = np.where(before < size, rows["n"], 0).astype(np.int64)
    counts = np.add.reduceat(n, first) if len(rows) else first
    log = np.log(table + TRANSITION) - np.log(table.sum(axis=0) + TRANSITION * size)
    if both:
        log = np.concatenate([log, np.log(table.T + TRANSITION) - np.log(table.sum(axis=1) + TRANSITION * size)])
    classes = lump_class[rows["lump"][first]].astype(np.int64)
    ends = np.append(first, len(rows))
    at = 0
    while at < len(first):
        # About 64 K rows of contexts together; one word has two for each class a task at most.
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + 65536, side="right")) - 1)
        part = slice(ends[at], ends[to])
        worth = np.add.reduceat(log[before[part]] * rows["n"][part, None], first[at:to] - ends[at], axis=0)
        best = worth.argmax(axis=1)
        mine = classes[at:to]
        moves = worth[np.arange(to - at), best] > worth[np.arange(to - at), mine] + 1e-9
        # The end of a text keeps its class.
        classes[at:to] = np.where(moves & (rows["lump"][first[at:to]] > 0), best, mine)
        at = to
    left = before < size
    new = np.bincount((before * size + np.repeat(classes, np.diff(ends)))[left], weights=n[left], minlength=size * size).reshape(size, size)
    return rows["word"][first], counts, classes, new


def choose(counted: DataFrame, lump_class: np.ndarray, table: np.ndarray) -> DataFrame:
    """word, n, class of each word; and of the new table, with no word: before, class, n."""

    def one(group: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(group.column("rows").to_pylist()), _ROW)
        words, counts, classes, new = choices(rows, lump_class, table, True)
        before, of = np.nonzero(new)
        nothing, dropped = pa.nulls(len(of), pa.int64()), pa.nulls(len(words), pa.int16())
        return pa.table({
            "word": pa.concat_arrays([pa.array(words.view(np.int64)), nothing]), "n": pa.array(np.concatenate([counts, new[before, of].astype(np.int64)])),
            "class": pa.array(np.concatenate([classes, of]).astype(np.int16)), "before": pa.concat_arrays([dropped, pa.array(before.astype(np.int16))]),
        })

    return counted.where("part >= 0").groupBy("part").applyInArrow(one, "word bigint, n bigint, class smallint, before smallint")


def table_of(chosen: DataFrame, size: int) -> np.ndarray:
    table = np.zeros((size, size))
    for r in chosen.where("before is not null").groupBy("before", "class").agg(F.sum("n").alias("n")).collect():
        table[r["before"], r["class"]] = r["n"]
    return table


def frequent(counts: DataFrame, most: int) -> tuple[Lexicon, np.ndarray]:
    """The words above the lowest count that `most` words at most have, yet without classes; and their lumps."""
    top = 1 << 16
    least, seen = None, 0
    for r in sorted(counts.groupBy(F.least("n", F.lit(top)).alias("n")).count().collect(), key=lambda r: -r["n"]):
        seen += r["count"]
        if seen > most:
            break
        least = r["n"]
    found = counts.where(F.lit(False) if least is None else F.col("n") >= least).select("word", "n", "lump").toArrow()
    hashes = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Lexicon(hashes[order], found.column("n").to_numpy()[order], np.full(len(hashes), -1, np.int16)), found.column("lump").to_numpy()[order].astype(np.int64)


def class_of_lumps(lumps: np.ndarray, classes: np.ndarray, size: int) -> np.ndarray:
    """The class that most words of each lump have; of a lump without words, that of most words."""
    lumps, classes = lumps[classes >= 0], classes[classes >= 0]
    votes = np.bincount(lumps * size + classes, minlength=LUMPS * size).reshape(LUMPS, size)
    return np.where(votes.any(axis=1), votes.argmax(axis=1), votes.sum(axis=0).argmax()).astype(np.int16)


@dataclass
class Model:
    #: Of each lump: the class of its words that are in no training text, and before another word of all but frequent ones.
    lump_class: np.ndarray
    #: Frequent words with their class.
    first: Lexicon
    #: All words, and those that are not frequent: word (its hash), n, class.
    words: DataFrame | None
    others: DataFrame | None
    #: Bigrams of classes; log10 of their probabilities; log10 of what emissions from a class are divided by.
    table: np.ndarray
    transition: np.ndarray
    mass: np.ndarray
    tokens: int
    distinct: int
    end_count: int


def train(training: DataFrame, most: int = FREQUENT) -> Model:
    """training: the column text. Without rows every class is alike."""
    spark = training.sparkSession
    parts, context = 4 * max(16, training.rdd.getNumPartitions()), spark.sparkContext
    first, lumps = frequent(stored(word_counts(training), "word-counts"), most)
    top = np.lexsort((first.hashes, -first.counts))[:MERGED]
    size, merged = 1, np.zeros((1, 1))
    if len(top):
        pairs = bigrams(training, first.hashes[top], parts)
        of = np.unique(exchange(pairs, start=merge(pairs)), return_inverse=True)[1]
        size = int(of.max()) + 1
        member = np.eye(size)[of]
        merged, first.classes[top] = member.T @ pairs @ member, of
        del pairs, member
    lump_class = class_of_lumps(lumps, first.classes.astype(np.int64), size)
    if len(top) < len(first.hashes):
        shared = context.broadcast((first, None))
        found = choose(contexts(training, shared, parts, size), lump_class, merged).where("word is not null").select("word", "class").toArrow()
        shared.unpersist()
        at, _ = first.find(found.column("word").to_numpy().view(np.uint64))
        first.classes[at] = found.column("class").to_numpy()
        # A word that never stands beside a merged one joins those of its ending.
        first.classes = np.where(first.classes < 0, lump_class[lumps], first.classes)
        lump_class = class_of_lumps(lumps, first.classes.astype(np.int64), size)
    shared = context.broadcast((first, lump_class))
    counted = stored(contexts(training, shared, parts, size), "class-contexts")
    shared.unpersist()
    others = stored(choose(counted, lump_class, merged), "other-classes")
    table = by_class(counted, size) + table_of(others, size)
    others = others.where("word is not null").select("word", "n", "class")
    end_hash = np.array([hash_of(b"")], np.uint64)
    at, known = first.find(end_hash)
    end = int(first.counts[at[0]]) if known[0] else 0
    mass = np.stack([np.bincount(first.classes, weights=first.counts, minlength=size), np.bincount(first.classes, minlength=size)], axis=1).astype(float)
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types"), F.coalesce(F.max(F.when(F.col("word") == end_hash.view(np.int64)[0].item(), F.col("n"))), F.lit(0)).alias("ends")).collect():
        mass[r["class"]] += r["n"], r["types"]
        end += r["ends"]
    words = spark.createDataFrame(pa.table({"word": first.hashes.view(np.int64), "n": first.counts.astype(np.int64), "class": first.classes.astype(np.int16)})).unionByName(others)
    transition = np.log10((table + TRANSITION) / (table.sum(axis=1, keepdims=True) + TRANSITION * size))
    return Model(lump_class, first, words, others, table, transition, np.log10(mass[:, 0] + EMISSION * (mass[:, 1] + 1)), int(mass[:, 0].sum()), int(mass[:, 1].sum()), end)


_PARTIAL = "row bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<word:bigint,transition:int,times:int>>"
#: Tokens of training for which a partition of the last joins is made, about.
JOINED = 20_000_000


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity of every row of docs.

    A null or empty text is its end alone. A null id stays null and is learned from. Repeated rows are learned from
    and scored as often as they come. Without training rows every token has probability 1 in the base.
    """
    plain = docs.select(docs[id_col].alias("id"), (remainder(docs[id_col]) == 1).alias("held_out"), docs[text_col].cast("string").alias("text"))
    model = train(plain.where(~F.col("held_out")).select("text"), most)
    others, model.words, model.others = model.others, None, None
    shared, size = docs.sparkSession.sparkContext.broadcast(model), len(model.table)
    below = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        end = int(m.lump_class[0])
        row = TaskContext.get().partitionId() << 33
        for part in slices(batches, "text"):
            split = [words_of(x) for x in texts(part, "text")]
            count = np.array([len(x) + 1 for x in split], np.int64)
            names = [b"", *set().union(*split)]
            number = dict(zip(names, range(len(names)), strict=True))
            ids = np.array([u for x in split for u in (*map(number.__getitem__, x), 0)], np.int64)
            hashes = np.array([hash_of(x) for x in names], np.uint64)
            of_lump = m.lump_class[np.array([lump_of(x) for x in names])].astype(np.int64)
            at, common = m.first.find(hashes)
            common[0] = True  # the end's count is in the model
            times, of = np.zeros(len(names)), of_lump
            if len(m.first.hashes):
                times, of = np.where(common, m.first.counts[at], 0).astype(float), np.where(common, m.first.classes[at], of_lump)
            times[0], of[0] = m.end_count, end
            base, emission = np.log10(times + 0.5) - below, np.log10(times + EMISSION) - m.mass[of]
            doc = np.repeat(np.arange(len(split)), count)
            come = of[np.concatenate([[0], ids[:-1]])]
            here = common[ids]
            per_doc = lambda x: np.bincount(doc, weights=np.where(here, x, 0), minlength=len(split))
            # Other words wait for their counts and classes: text, word, and the class before with that of the lump.
            rare = np.flatnonzero(~here)
            both, n = np.unique((doc[rare] * len(names) + ids[rare]) * size**2 + come[rare] * size + of[ids[rare]], return_counts=True)
            place, way = np.divmod(both, size**2)
            waits = pa.StructArray.from_arrays([pa.array(hashes[place % len(names)].view(np.int64)), pa.array(way.astype(np.int32)), pa.array(n.astype(np.int32))], ["word", "transition", "times"])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(split))), part.column(0), part.column(1), pa.array(count),
                pa.array(per_doc(times[ids] > 0).astype(np.int64)), pa.array(per_doc(base[ids])), pa.array(per_doc(emission[ids] + m.transition[come, of[ids]])),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(place // len(names), np.arange(len(split) + 1)).astype(np.int32)), waits),
            ], ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])
            row += len(split)

    kind = plain.schema["id"].dataType.simpleString()
    partial = stored(plain.mapInArrow(run, _PARTIAL.format(kind=kind)), "lm-partial")
    waiting = partial.select("row", F.explode("rare").alias("r")).select("row", "r.*")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            row, transition, times, n, of = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            come, of = transition // size, np.where(of < 0, transition % size, of)
            worth = np.log10(n + EMISSION) - m.mass[of] + m.transition[come, of]
            yield pa.RecordBatch.from_pydict({"row": row, "n_known": pa.array(times * (n > 0), pa.int64()), "base": pa.array(times * (np.log10(n + 0.5) - below)), "score": pa.array(times * worth)})

    # None of these words is frequent, so none gathers many rows; the number of partitions follows the corpus.
    wide = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), model.tokens // JOINED)
    joined = waiting.repartition(wide, "word").join(others.repartition(wide, "word"), "word", "left")
    extra = joined.select("row", "transition", "times", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(-1)).cast("int").alias("class")).mapInArrow(rest, "row bigint, n_known bigint, base double, score double")
    extra = extra.select("row", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("bigint").alias("n_tokens"), "n_known", "base", "score")
    both = partial.drop("rare").unionByName(extra).groupBy("row").agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")))
    return both.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
