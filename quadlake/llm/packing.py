"""Packing documents into sequences by swap-based local search.

Documents become token pieces of at most `capacity`; pieces are dealt at random into groups of about GROUP, each of
which one task packs on its own (a group wastes one sequence at most, in thousands). A group starts from best fit
by falling length. Then underfull sequences, the emptiest first, give their pieces away: one piece or two move, one
changes places with a shorter one or with two that are shorter together, or two of them with one, whenever that
increases the sum of squared fills. The search ends when no piece or pair of pieces of any underfull sequence finds an
exchange, or when no fewer sequences could hold the tokens.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import over_texts, stored
from .tokens import default_path, tokenizer

CAPACITY, GROUP = 2048, 16384

def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in `lengths`, longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        size = lengths[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > size:
            insort(room, (free - size, b))
    return bins


class Search:
    """The bins of one group while pieces change places; `targets` holds what may come back for pieces given away."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.size, self.capacity = np.array(lengths, np.int64), capacity
        self.bins = [list(x) for x in bins]
        self.where = np.empty(len(lengths), np.int64)
        for b, x in enumerate(bins):
            self.where[x] = b
        self.fill = np.bincount(self.where, weights=self.size, minlength=len(bins)).astype(np.int64)
        self.look()

    def look(self) -> None:
        """Bins with room, the emptiest first; their pieces, and all pairs of pieces of one bin."""
        under = np.flatnonzero((self.fill < self.capacity) & (self.fill > 0))
        self.open = under[np.argsort(self.fill[under], kind="stable")]
        self.single = np.array([i for b in self.open for i in self.bins[b]], np.int64)
        both = []
        for b in self.open:
            x = np.array(self.bins[b], np.int64)
            first, second = np.triu_indices(len(x), 1)
            both.append(np.stack([x[first], x[second]], axis=1))
        self.pair = np.concatenate(both) if both else np.zeros((0, 2), np.int64)
        self.pair_size = self.size[self.pair].sum(axis=1)

    def shift(self, i: int, b: int) -> None:
        a = self.where[i]
        self.bins[a].remove(i)
        self.bins[b].append(i)
        self.fill[a] -= self.size[i]
        self.fill[b] += self.size[i]
        self.where[i] = b

    def give(self, given: list[int], a: int) -> bool:
        """Finds the exchange of these pieces of bin a that fills another, no emptier bin most; does it."""
        total = int(self.size[given].sum())
        room = self.capacity - self.fill
        room[a] = -1
        room[(self.fill < self.fill[a]) | (self.fill == 0)] = -1
        left = room[self.open] - total
        if (left >= 0).any():
            b = self.open[np.argmin(np.where(left >= 0, left, self.capacity))]
            for i in given:
                self.shift(i, b)
            return True
        best, back, to = 0, [], -1
        home = self.where[self.single]
        gain = total - self.size[self.single]
        gain[(gain > room[home]) | (home == a)] = 0
        if len(gain) and gain[k := int(np.argmax(gain))] > best:
            best, back, to = int(gain[k]), [int(self.single[k])], int(home[k])
        if len(given) == 1 and len(self.pair):
            gain = total - self.pair_size
            home = self.where[self.pair]
            gain[(home[:, 0] != home[:, 1]) | (gain > room[home[:, 0]])] = 0
            if gain[k := int(np.argmax(gain))] > best:
                best, back, to = int(gain[k]), self.pair[k].tolist(), int(home[k, 0])
        if best <= 0 or self.fill[to] + best <= self.fill[a]:
            return False
        for i in given:
            self.shift(i, to)
        for i in back:
            self.shift(i, a)
        return True

    def empty(self, a: int) -> bool:
        """Gives away what bin a can: pieces, the longest first, then pairs of them; whether any moved."""
        any_moved = False
        while self.bins[a]:
            mine = sorted(self.bins[a], key=self.size.__getitem__, reverse=True)
            # Of pieces of one length, one stands for all.
            tries = [[i] for i in {int(self.size[i]): i for i in mine}.values()]
            tries += sorted({tuple(sorted((int(self.size[i]), int(self.size[j])))): [i, j] for k, i in enumerate(mine) for j in mine[k + 1 :]}.values(), key=lambda x: -int(self.size[x].sum()))
            if not any(self.give(x, a) for x in tries):
                return any_moved
            any_moved = True
        return any_moved


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """The bins after exchanges, without those that emptied. Each exchange increases the sum of squared fills."""
    search, least = Search(lengths, bins, capacity), -(-sum(lengths) // capacity)
    moved = True
    while moved and sum(map(bool, search.bins)) > least:
        moved = False
        for a in search.open.tolist():
            if search.bins[a] and search.empty(a):
                moved = True
                if sum(map(bool, search.bins)) <= least:
                    break
        search.look()
    return [x for x in search.bins if x]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(lengths, best_fit(lengths, capacity), capacity)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids and `end`: the id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = path or default_path()
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    last = end.to_bytes(4, "little")

    def rows(ids: pa.Array, data: list[bytes]) -> dict:
        take, number, start, length, crc, held = [], [], [], [], [], []
        for i, x in enumerate(tokenizer(path).ids(data)):
            x += last
            for k, at in enumerate(range(0, len(x), 4 * capacity)):
                part = x[at : at + 4 * capacity]
                take.append(i)
                number.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    held.append(np.frombuffer(part, "<i4"))
        out = {id_col: ids.take(pa.array(take, pa.int64())), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        return out | ({"ids": pa.array(held, pa.list_(pa.int32()))} if with_ids else {})

    return over_texts(docs, id_col, text_col, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids, rows, remembers=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of pieces (with a `length` up to `capacity`) with sequence_id and offset; sequences have no gaps."""
    names = pieces.columns
    held = stored(pieces.select("*", F.xxhash64(F.monotonically_increasing_id()).alias("_deal")), "pieces")
    groups = -(-held.count() // group) or 1
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_deal")
        lengths = rows.column("length").to_pylist()
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                number[i], offset[i] = (key[0].as_py() << 32) + k, at
                at += lengths[i]
        return rows.select(names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    return held.withColumn("_group", F.pmod("_deal", F.lit(groups))).groupBy("_group").applyInArrow(one, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs every row of docs. A null or empty text is one piece, the end id. Repeated rows are packed as often as
    they come; an empty table gives no rows."""
    return pack(cut(docs, id_col, text_col, path=path, capacity=capacity), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of whole sequences, from packed pieces that carry ids. A sequence is bounded by capacity."""
    whole = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(whole, lambda x: x["ids"])).alias("ids"))
