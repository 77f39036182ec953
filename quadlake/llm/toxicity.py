"""A convolutional text classifier in numpy.

A word's embedding is the sum of hashed embeddings of the word, its first four bytes and its last three. Filters
of several widths slide over the words, each keeps its maximum over the text, and a linear layer over their tanh gives
the logit. All starts at random; while it trains, a soft maximum hardens, so that at first every word learns.
Thresholds are calibrated by language on a part of the training rows that training leaves out. The language is
guessed from the text's own common words, so that a score depends on nothing but the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 8
#: Labelled rows of each label that training takes at most, the ones of least hash; the bound of its sample.
SAMPLE = 4000
#: UTF-8 bytes of a training row at most; with SAMPLE it bounds what crosses to the driver (260 MB). Longer rows are scored, not learned from.
SAMPLE_BYTES = 1 << 15
RATE, BATCH = 0.03, 32
#: Each epoch's heat: the pool over a text is the logarithm of the mean exponential at that heat; in the last ones, its maximum.
HEATS = (2.0, 4.0, 8.0, 16.0, None, None, None, None)
THRESHOLD = 0.7
#: Common words by which the language of a text is guessed.
COMMON = {
    "en": "the of and to in is that it for was with this by are from",
    "fr": "le la les des et un une que est dans pour avec sur pas du",
    "de": "der die und den das ist mit von zu im für nicht ein auf dem",
    "es": "el los y del por para con una las se su como más lo al",
}
LANGUAGES = ("", *COMMON)
_SEPARATORS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", b"abcdefghijklmnopqrstuvwxyz" + b" " * 31)


def word_features(word: bytes) -> tuple[int, int, int]:
    return zlib.crc32(word) % BUCKETS, zlib.crc32(b"<" + word[:4]) % BUCKETS, zlib.crc32(b">" + word[-3:]) % BUCKETS


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATORS).split()


class Vocabulary:
    """Numbers the words of a slice of texts: their features and the language that they are common in."""

    def __init__(self):
        self.common = {w.encode(): 1 + k for k, words in enumerate(COMMON.values()) for w in words.split()}

    def read(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features of distinct words, the distinct word at each place, words by text, the language of each text."""
        split = [words_of(x) for x in data]
        count = np.array([len(x) for x in split], np.int64)
        names = list(set().union(*split))
        number = dict(zip(names, range(len(names)), strict=True))
        ids = np.fromiter((i for x in split for i in map(number.__getitem__, x)), np.int64, int(count.sum()))
        features = np.array([word_features(x) for x in names], np.int64).reshape(-1, 3)
        spoken = np.array([self.common.get(x, 0) for x in names], np.int64)
        doc = np.repeat(np.arange(len(data)), count)
        seen = np.bincount(doc * len(LANGUAGES) + (spoken[ids] if len(ids) else ids), minlength=len(data) * len(LANGUAGES)).reshape(len(data), -1)
        seen[:, 0] = 0
        return features, ids, count, np.where(seen.max(axis=1) > 0, seen.argmax(axis=1), 0)


@dataclass
class Model:
    embedding: np.ndarray
    #: By width: a matrix for each place in the window.
    filters: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray
    #: Logit by language at which a text counts as toxic; scores put it at THRESHOLD.
    cut: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.weight, self.offset]

    def responses(self, words: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        """Of each width: what its filters give at each place; words after the end of a text are zeros."""
        out = []
        for k, filters in enumerate(self.filters):
            response = (words @ filters[0])[ids] + self.bias[k]
            for j in range(1, len(filters)):
                inside = np.flatnonzero(doc[: len(doc) - j] == doc[j:])
                response[inside] += (words @ filters[j])[ids[inside + j]]
            out.append(response)
        return out

    def pooled(self, features: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each text; of an empty text those to zeros."""
        out = np.tile(self.bias.ravel(), (len(count), 1))
        some = np.flatnonzero(count)
        if len(some):
            words, doc = self.embedding[features].sum(axis=1), np.repeat(np.arange(len(count)), count)
            for k, response in enumerate(self.responses(words, ids, doc)):
                out[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(response, (np.cumsum(count) - count)[some], axis=0)
        return out

    def logits(self, data: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        features, ids, count, language = vocabulary.read(data)
        return np.tanh(self.pooled(features, ids, count)) @ self.weight + self.offset[0], language

    def scores(self, data: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
        """0 to 1; THRESHOLD at the cut of the text's language."""
        logit, language = self.logits(data, vocabulary)
        return 1 / (1 + np.exp(-np.clip(logit - self.cut[language] + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def start(rng: np.random.Generator, widths: tuple[int, ...] = WIDTHS) -> Model:
    """A model of random parameters, no feature or filter before another."""
    normal = lambda size, *shape: rng.normal(0, size, shape).astype(np.float32)
    return Model(normal(0.1, BUCKETS, DIM), [normal(0.3, w, DIM, FILTERS) for w in widths], np.zeros((len(widths), FILTERS), np.float32), normal(0.3, len(widths) * FILTERS), np.zeros(1, np.float32), np.full(len(LANGUAGES), 1.0))


def gradients(model: Model, features: np.ndarray, ids: np.ndarray, count: np.ndarray, y: np.ndarray, weights: np.ndarray, heat: float | None) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """The weighted logistic loss of texts, the features that they hold, and the loss's gradients by these and by the
    other parameters. A filter's pool over a text is the logarithm of its mean exponential at `heat`, so that all places
    learn; without heat its maximum."""
    n, doc = len(count), np.repeat(np.arange(len(count)), count)
    some, starts = np.flatnonzero(count), (np.cumsum(count) - count)[count > 0]
    words = model.embedding[features].sum(axis=1)
    pool, shares = np.tile(model.bias.ravel(), (n, 1)), []
    for k, response in enumerate(model.responses(words, ids, doc) if len(ids) else ()):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        most = np.zeros((n, FILTERS), response.dtype)
        most[some] = np.maximum.reduceat(response, starts, axis=0)
        share = np.exp(heat * (response - most[doc])) if heat else (response == most[doc]).astype(response.dtype)
        total = np.ones((n, FILTERS), response.dtype)
        total[some] = np.add.reduceat(share, starts, axis=0)
        share /= total[doc]
        pool[some, part] = most[some] + (np.log(total[some] / count[some, None]) / heat if heat else 0)
        shares.append(share)
    bent = np.tanh(pool)
    logit = bent @ model.weight + model.offset[0]
    chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = float((weights * np.where(y > 0, -np.log(chance + 1e-12), -np.log(1 - chance + 1e-12))).sum())
    error = ((chance - y) * weights).astype(np.float32)
    g_pool = error[:, None] * model.weight * (1 - bent**2)
    g_words, g_filters, g_bias = np.zeros_like(words), [np.zeros_like(f) for f in model.filters], g_pool.sum(axis=0).reshape(model.bias.shape)
    if len(ids):
        order = np.argsort(ids, kind="stable")
        firsts = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))
        at = ids[order][firsts]
        for k, share in enumerate(shares):
            g = share * g_pool[doc, k * FILTERS : (k + 1) * FILTERS]
            for j in range(len(model.filters[k])):
                moved = g
                if j:
                    moved = np.zeros_like(g)
                    inside = np.flatnonzero(doc[: len(doc) - j] == doc[j:])
                    moved[inside + j] = g[inside]
                by_word = np.add.reduceat(moved[order], firsts, axis=0)
                g_filters[k][j] = words[at].T @ by_word
                g_words[at] += by_word @ model.filters[k][j].T
    held, inverse = np.unique(features.ravel(), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    firsts = np.flatnonzero(np.concatenate([[True], inverse[order][1:] != inverse[order][:-1]])) if len(held) else np.zeros(0, np.int64)
    g_embedding = np.add.reduceat(np.repeat(g_words, features.shape[1], axis=0)[order], firsts, axis=0) if len(held) else np.zeros((0, DIM), np.float32)
    return loss, held, [g_embedding, *g_filters, g_bias, bent.T @ error, error.sum(keepdims=True)]


def train(data: list[bytes], labels: list[int], seed: int = 7, widths: tuple[int, ...] = WIDTHS) -> Model:
    """Fits a model of random parameters by Adam on four fifths of the rows, the pool over a text growing from a mean to
    the maximum; the rest calibrates the cuts. Rows of one label only (or none) give a model that scores all alike, below
    the threshold."""
    rng = np.random.default_rng(seed)
    model, vocabulary = start(rng, widths), Vocabulary()
    y = np.array(labels, np.float32)
    order = rng.permutation(len(data))
    held, fit = order[: len(data) // 5], order[len(data) // 5 :]
    if not 0 < y[fit].sum() < len(fit):
        model.weight[:], model.offset[:] = 0, -2.0
        return model
    weights = np.where(y > 0, 0.5 / max(y[fit].mean(), 1e-6), 0.5 / max(1 - y[fit].mean(), 1e-6)) / BATCH
    batches = []
    for at in range(0, len(fit), BATCH):
        rows = fit[at : at + BATCH]
        batches.append((*vocabulary.read([data[i] for i in rows])[:3], rows))
    first, second, steps = [np.zeros_like(p) for p in model.parameters()], [np.zeros_like(p) for p in model.parameters()], 0
    for heat in HEATS:
        for b in rng.permutation(len(batches)):
            features, ids, count, rows = batches[b]
            steps += 1
            _, at, found = gradients(model, features, ids, count, y[rows], weights[rows], heat)
            for k, (p, g) in enumerate(zip(model.parameters(), found, strict=True)):
                here = at if k == 0 else slice(None)
                first[k][here] += (1 - 0.9) * (g - first[k][here])
                second[k][here] += (1 - 0.99) * (g * g - second[k][here])
                p[here] -= RATE * (first[k][here] / (1 - 0.9**steps)) / (np.sqrt(second[k][here] / (1 - 0.99**steps)) + 1e-6)
    _calibrate(model, [data[i] for i in held], y[held], vocabulary)
    return model


def _calibrate(model: Model, data: list[bytes], y: np.ndarray, vocabulary: Vocabulary) -> None:
    """The cut of each language: the middle of the gap that separates its labels with the fewest errors; of all
    rows for languages with under 20 rows or one label."""
    if not len(data):
        model.cut[:] = 0
        return
    logit, language = model.logits(data, vocabulary)

    def best(rows: np.ndarray) -> float:
        order = rows[np.argsort(logit[rows], kind="stable")]
        wrong = np.concatenate([[0], np.cumsum(y[order])]) + np.concatenate([[0], np.cumsum((1 - y[order])[::-1])])[::-1]
        ties = np.flatnonzero(wrong == wrong.min())
        k = int(ties[len(ties) // 2])
        value = np.concatenate([[logit[order[0]] - 2], logit[order], [logit[order[-1]] + 2]])
        return float((value[k] + value[k + 1]) / 2)

    everything = np.arange(len(y))
    overall = best(everything) if 0 < y.sum() < len(y) else 0.0
    for k in range(len(LANGUAGES)):
        rows = np.flatnonzero(language == k)
        model.cut[k] = best(rows) if len(rows) >= 20 and 0 < y[rows].sum() < len(rows) else overall


def held_out(id_col) -> F.Column:
    """Whether a row's label is never learned from. A null id hashes as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on at most `sample` labelled rows of each label that are not held out, those of least hash among the ones
    whose texts have `sample_bytes` at most. Only these cross to the driver: 2 * sample * sample_bytes bytes at the
    utmost. Of repeated rows of an id, and of its labels, the greatest counts; null ids and labels are not learned from."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes)
    known = known.join(rows.select("id"), "id", "left_semi")
    # The bound makes this side fit to broadcast: two times `sample` ids.
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (1, 0)]
    found = rows.join(F.broadcast(picked[0].unionByName(picked[1])), "id").groupBy("id").agg(F.max("label").alias("label"), F.max("text").alias("text")).select("id", "label", "text").orderBy("id").toArrow()
    return train([x.encode() for x in found.column("text").to_pylist()], found.column("label").to_pylist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row of docs. Null and empty texts score as texts without words; a
    null id stays null; repeated rows repeat; an empty table gives none."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    plain = docs.select(docs[id_col].alias(id_col), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for part in slices(batches, "text"):
            found = shared.value.scores(texts(part, "text"), vocabulary).astype(np.float64)
            yield pa.RecordBatch.from_pydict({id_col: part.column(0), "held_out": part.column(1), "score": pa.array(found), "predicted": pa.array((found >= THRESHOLD).astype(np.int32))})

    return plain.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, all columns as they were. Null and empty texts score as texts
    without words; null ids and repeated rows stay as they are; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for part in slices(batches, text_col):
            yield part.filter(pa.array(shared.value.scores(texts(part, text_col), vocabulary) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
