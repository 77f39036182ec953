"""Repetition coverage: what share of a text's characters stands in n-grams and lines that it repeats.

Words of a slice of texts become integers, a rolling polynomial hash grows by one word for each n, and windows
with the same hash are compared word by word, so that a collision never counts as a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import over_texts, slices, texts

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Largest share of characters in repeated n-grams, by n, and in repeated lines, that the method keeps. A short
#: text that quotes one of its lines once more stays under them.
NGRAM_LIMITS = {5: 0.30, 7: 0.27, 10: 0.24}
LINE_LIMIT = 0.30
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, line_share double, ngram_share double"


def _covered(windows: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words that the windows, given by their first words, cover."""
    step = np.zeros(total + 1, np.int32)
    step[:-1][windows] += 1
    np.subtract.at(step, np.flatnonzero(windows) + n, 1)
    return np.cumsum(step[:-1]) > 0


def _repeated(hashes: np.ndarray, words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window start: whether the same window stands elsewhere in its text; whether it did so before."""
    total = len(words)
    again, before = np.zeros(total, bool), np.zeros(total, bool)
    inside = np.flatnonzero(doc[: total - n + 1] == doc[n - 1 :]) if total >= n else np.zeros(0, np.int64)
    if len(inside) < 2:
        return again, before
    mixed = hashes[inside] ^ (doc[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mixed, kind="stable")
    at, key = inside[order], mixed[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    left, right = at[same], at[same + 1]
    equal = doc[left] == doc[right]
    for k in range(n):
        equal &= words[left + k] == words[right + k]
    again[left[equal]] = True
    again[right[equal]] = True
    before[right[equal]] = True
    return again, before


def measure(data: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text, as arrays."""
    split = [x.split() for x in data]
    n_words = np.array([len(x) for x in split], np.int64)
    total = int(n_words.sum())
    # A word's number is the place where the slice has it first.
    numbers: dict[bytes, int] = {}
    words, at = np.empty(total, np.int64), 0
    for x in split:
        words[at : at + len(x)] = np.fromiter(map(numbers.setdefault, x, count(at)), np.int64, len(x))
        at += len(x)
    chars = np.zeros(total, np.int64)
    chars[np.fromiter(numbers.values(), np.int64, len(numbers))] = np.fromiter((len(x.decode("utf-8", "replace")) for x in numbers), np.int64, len(numbers))
    length = chars[words]
    doc = np.repeat(np.arange(len(data)), n_words)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(data))
    word_chars = per_doc(length).astype(np.int64)
    seed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    seed ^= seed >> np.uint64(29)
    rolling, share = seed.copy(), np.zeros(len(data))
    over = np.zeros(len(data), bool)
    repeat_words = np.zeros(len(data), np.int64)
    safe = np.maximum(word_chars, 1)
    for n in range(2, max(NGRAM_LIMITS) + 1):
        if total < n:
            break
        rolling = rolling[:-1] * MULTIPLIER + seed[n - 1 :]
        if n == 3:
            again, _ = _repeated(rolling, words, doc, 3)
            repeat_words = per_doc(_covered(again, 3, total)).astype(np.int64)
        elif n in NGRAM_LIMITS:
            _, before = _repeated(rolling, words, doc, n)
            part = per_doc(np.where(_covered(before, n, total), length, 0)) / safe
            over |= part > NGRAM_LIMITS[n]
            share = np.maximum(share, part)
    dup_lines, line_share = np.zeros(len(data), np.int64), np.zeros(len(data))
    symbols = np.zeros(len(data), np.int64)
    for i, x in enumerate(data):
        lines = [y for y in x.split(b"\n") if y.strip(SPACE)]
        seen: set[bytes] = set()
        repeated = 0
        if len(set(lines)) < len(lines):
            for y in lines:
                if y in seen:
                    dup_lines[i] += 1
                    repeated += len(y.translate(None, SPACE).decode("utf-8", "replace"))
                seen.add(y)
        line_share[i] = repeated / safe[i]
        symbols[i] = len(x) - len(x.translate(None, SYMBOLS))
    failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    kept = ~failed & ~over & (line_share <= LINE_LIMIT)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": failed, "kept": kept, "line_share": line_share, "ngram_share": share}


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and its measures. Null and empty texts have no words and fail; a null id stays
    null; repeated rows repeat; an empty table gives none."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return over_texts(docs, id_col, text_col, f"`{id_col}` {kind}, {SCHEMA}", lambda ids, data: {id_col: ids} | {k: pa.array(v) for k, v in measure(data).items()})


def keep_clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text passes, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            yield part.filter(pa.array(measure(texts(part, text_col))["kept"]))

    return docs.mapInArrow(run, docs.schema)
