"""Byte-level BPE by a segment tree over byte positions.

A leaf holds rank * size + position of the pair that begins there, so the root is the leftmost pair of the lowest
rank. A merge changes three leaves (the pair itself, the one that its right half began, the one to its left) and
their ancestors. Short pieces run side by side as rows of numpy arrays, a merge for each row at a time; longer
ones run one by one, in time n log n. Chunks that a worker has met before are not encoded again.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, over_texts

SHORT = 64
NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class SegmentTreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None and (right := ranks.get(token[cut:])) is not None:
                    self.pairs[left, right] = rank
        both = np.array(list(self.pairs), np.int64).reshape(-1, 2)
        keys = both[:, 0] << 32 | both[:, 1]
        order = np.argsort(keys)
        self.keys, self.key_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array(list(self.pairs.values()), np.int64)[order], -1)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.head, self.tail = Memo(50_000, 4 << 20), Memo()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where they make no token."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_ranks[at], -1)

    def _short(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        """Ids of pieces of at most `size` bytes, a power of two."""
        n = len(pieces)
        lengths = np.array([len(x) for x in pieces])
        flat = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(n, size)
        place = np.arange(size)
        ids = np.where(place < lengths[:, None], self.byte_ids[flat], -1)
        after = np.where(place + 1 < lengths[:, None], place + 1, -1) * np.ones((n, 1), np.int64)
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        has = after >= 0
        rank = np.full((n, size), -1, np.int64)
        rank[:, :-1][has[:, :-1]] = self._rank(ids[:, :-1][has[:, :-1]], ids[:, 1:][has[:, :-1]])
        tree[:, size:] = np.where(rank >= 0, rank * size + place, NONE)
        width = size
        while width > 1:
            width //= 2
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
        rows = np.arange(n)
        while len(rows := rows[tree[rows, 1] < NONE]):
            best = tree[rows, 1]
            at, new = best % size, best // size
            right = after[rows, at]
            far, left = after[rows, right], before[rows, at]
            ids[rows, at], ids[rows, right], after[rows, at] = new, -1, far
            more, less = far >= 0, left >= 0
            before[rows[more], far[more]] = at[more]
            here, there = np.full(len(rows), NONE, np.int64), np.full(len(rows), NONE, np.int64)
            got = self._rank(new[more], ids[rows[more], far[more]])
            here[more] = np.where(got >= 0, got * size + at[more], NONE)
            got = self._rank(ids[rows[less], left[less]], new[less])
            there[less] = np.where(got >= 0, got * size + left[less], NONE)
            tree[rows, size + at], tree[rows, size + right] = here, NONE
            tree[rows[less], size + left[less]] = there[less]
            nodes = (size + at, size + right, size + np.where(less, left, at))
            for _ in range(size.bit_length() - 1):
                nodes = tuple(x >> 1 for x in nodes)
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
        return [x[x >= 0] for x in ids]

    def _long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length."""
        n, pairs = len(piece), self.pairs
        size = 1 << (n - 1).bit_length()
        none = 1 << 62
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        leaf = lambda p: none if after[p] < 0 or (r := pairs.get((ids[p], ids[after[p]]))) is None else r * size + p
        tree = [none] * size + [leaf(p) for p in range(n)] + [none] * (size - n)
        for x in range(size - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(p: int, value: int) -> None:
            x = size + p
            tree[x] = value
            while x > 1:
                x >>= 1
                least = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == least:
                    break
                tree[x] = least

        while tree[1] < none:
            new, at = divmod(tree[1], size)
            right = after[at]
            far = after[right]
            ids[at], ids[right], after[at] = new, -1, far
            if far >= 0:
                before[far] = at
            put(right, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, whole pieces that are tokens first."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif piece:
                by_size.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for size, members in by_size.items():
            for at in range(0, len(members), (1 << 18) // size if size <= SHORT else 1):
                part = members[at : at + ((1 << 18) // size if size <= SHORT else 1)]
                found = self._short([pieces[i] for i in part], size) if size <= SHORT else [self._long(pieces[part[0]])]
                for i, ids in zip(part, found, strict=True):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    def _learn(self, chunks: list[str], memo: Memo, lead: str) -> None:
        split = [self.pattern.findall(lead + chunk) for chunk in chunks]
        names = list({x for pieces in split for x in pieces})
        ids = dict(zip(names, self.encode_pieces([x.encode() for x in names]), strict=True))
        for chunk, pieces in zip(chunks, split, strict=True):
            memo.put(chunk, ids[pieces[0]] if len(pieces) == 1 else b"".join(map(ids.__getitem__, pieces)))

    def encode(self, data: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A space between two characters that are not white space always begins a match of the pattern, so a text
        whose white space stands alone is cut there; any other text is cut by the pattern itself.
        """
        cut: list[tuple[list[str], list[str]]] = []
        for text in data:
            parts = text.split(" ")
            alone = not text[:1].isspace() and not text[-1:].isspace() and len(text.split()) == len(parts) + text.count("\n") if text else True
            cut.append((parts[:1], parts[1:]) if alone else (self.pattern.findall(text), []))
        self._learn(self.head.missing({x for first, _ in cut for x in first}), self.head, "")
        self._learn(self.tail.missing(set().union(*(x for _, x in cut))), self.tail, " ")
        head, tail = self.head.young.__getitem__, self.tail.young.__getitem__
        return [b"".join((*map(head, first), *map(tail, rest))) for first, rest in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_made: dict[tuple[str, str], SegmentTreeBpe] = {}


def encoder(path: str, pattern: str) -> SegmentTreeBpe:
    """One per worker process and vocabulary."""
    if (path, pattern) not in _made:
        _made[path, pattern] = SegmentTreeBpe(read_ranks(path), pattern)
    return _made[path, pattern]


def _mapped(docs: DataFrame, id_col: str, text_col: str, path: str | None, pattern: str | None, schema: str, columns) -> DataFrame:
    path, pattern = path or default_path(), pattern or default_pattern()
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def rows(ids, data):
        bpe = encoder(path, pattern)
        return {id_col: ids} | columns(bpe, bpe.encode([x.decode("utf-8", "replace") for x in data]))

    return over_texts(docs, id_col, text_col, f"`{id_col}` {kind}, {schema}", rows, remembers=True)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id and ids of each whole text. Null and empty texts have none; repeated rows repeat; empty tables give none."""
    return _mapped(docs, id_col, text_col, path, pattern, "ids array<int>", lambda bpe, found: {"ids": [np.frombuffer(x, "<i4") for x in found]})


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (of the bytes that the ids decode to)."""

    def columns(bpe: SegmentTreeBpe, found: list[bytes]) -> dict:
        return {"n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()), "ids_sha256": [hashlib.sha256(x).hexdigest() for x in found], "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in found]}

    return _mapped(docs, id_col, text_col, path, pattern, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", columns)
