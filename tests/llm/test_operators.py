"""The ten operators against brute force, on small tables with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from quadlake.llm import bpe, jaccard, lm_scoring, media, packing, pii, quality, token_counts, tokens, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", ","]) for _ in range(n))


def rows():
    base = [text(k, 60 + k) for k in range(12)]
    near = base[0].split()
    near[3] = "changed"
    out = [(k, x) for k, x in enumerate(base)]
    out += [(20, base[0]), (21, " ".join(near)), (22, base[0].upper()), (23, None), (24, ""), (25, " \n "), (26, "one two"), (27, "one two"), (28, "One two three four"), (29, "x" * 30000), (30, text(99, 4000)), (31, "same line here\n" * 40)]
    out += [(32, "mail bob@example.com or 10.0.0.1 card 4111 1111 1111 1111 call +1 (415) 555-0001 or (415) 555-0001"), (33, "naïve café ÀÉ 日本語 <|endoftext|> it's  two  spaces\t\ttabs")]
    return [*out, (5, base[5]), (None, "no id here at all but some words"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, x, "en", 7, 0.5, "t", 1) for i, x in rows()]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, n_tokens int, score double, id string, class int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def ws(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


def lm_parts():
    """Words of every row, and whether it is held out."""
    low = [(i, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws(x)] + [""]) for i, x in rows()]
    return [(i, x, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1) for i, x in low]


@pytest.mark.parametrize("most", [300_000, 5, 0])
def test_lm(spark, docs, none, most):
    parts = lm_parts()
    training = [x for _, x, held in parts if not held]
    c = Counter(w for x in training for w in x)
    total, distinct = sum(c.values()), len(c)
    # The model by brute force, from the classes of words alone.
    held = docs.select((lm_scoring.remainder(docs["doc_id"]) == 1).alias("h"), "text").where("not h").select("text")
    model = lm_scoring.train(held, most)
    chosen = {r["word"]: r["class"] for r in model.words.collect()}
    known = {int(h): int(k) for h, k in zip(model.first.hashes, model.first.classes, strict=True)}
    key = lambda w: lm_scoring.hash_of(w.encode())
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    lump = lambda w: int(model.lump_class[lm_scoring.lump_of(w.encode())])
    before, of = lambda w: known.get(key(w), lump(w)), lambda w: chosen.get(signed(key(w)), lump(w))
    size, pairs, leaves, mass, types = len(model.table), Counter(), Counter(), Counter(), Counter(map(of, c))
    for x in training:
        for v, w in zip(["", *x], x, strict=False):
            pairs[before(v), of(w)] += 1
            leaves[before(v)] += 1
            mass[of(w)] += 1
    assert len(known) <= most

    def score(x):
        return sum(log10((pairs[before(v), of(w)] + 0.1) / (leaves[before(v)] + 0.1 * size)) + log10((c[w] + 0.5) / (mass[of(w)] + 0.5 * (types[of(w)] + 1))) for v, w in zip(["", *x], x, strict=False))

    want = [(i, h, len(x), sum(c[w] > 0 for w in x), total, round(sum(log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in x), 6), round(score(x), 6), round(10 ** (-score(x) / len(x)), 3)) for i, x, h in parts]
    got = lm_scoring.score(docs, most=most).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6), round(r.perplexity, 3)) for r in got), key=repr) == sorted(want, key=repr)
    assert most < 9 or lm_scoring.score(none).count() == 0


def test_lm_flushes_count_alike(docs, monkeypatch):
    every = by_row(lm_scoring.score(docs), "doc_id", "n_known", "base_score", "score")
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", 10)
    assert [tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in by_row(lm_scoring.score(docs), "doc_id", "n_known", "base_score", "score")] == [tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in every]


def test_lm_words_choose_their_classes(spark):
    # 300 words of each of two sorts, with the same 40 endings: only the words before them tell the sorts apart.
    r = random.Random(1)
    sorts = {x: [f"{k}{x}{k % 40:03}" for k in range(300)] for x in ("ana", "bob")}
    df = spark.createDataFrame([(" ".join(f"{x} {r.choice(sorts[x])}" for x in r.choices(["ana", "bob"], k=200)),) for _ in range(100)], "text string")
    words = {r["word"]: r["class"] for r in lm_scoring.train(df).words.collect()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    one, two = ({words[signed(lm_scoring.hash_of(x.encode()))] for x in s} for s in sorts.values())
    assert not one & two and len(words) == 603


def test_choices_against_brute_force():
    r = np.random.default_rng(3)
    rows = np.zeros(4000, lm_scoring._ROW)
    rows["word"], rows["before"], rows["n"] = r.integers(0, 300, 4000), r.integers(0, 6, 4000), r.integers(1, 9, 4000)
    rows["lump"] = 1 + rows["word"] % 20
    lump_class, table = np.arange(512) % 6, r.integers(1, 500, (6, 6)).astype(float)
    words, counts, classes, new = lm_scoring.choices(rows, lump_class, table, False)
    log = np.log(table + 0.1) - np.log(table.sum(axis=0) + 0.6)
    by_hand = np.zeros((6, 6))
    for w, n, k in zip(words, counts, classes, strict=True):
        mine = rows[rows["word"] == w]
        worth = [sum(int(x["n"]) * log[x["before"], j] for x in mine) for j in range(6)]
        assert n == mine["n"].sum() and np.isclose(worth[k], max(worth))
        for x in mine:
            by_hand[x["before"], k] += x["n"]
    assert (new == by_hand).all()


def test_exchange_leaves_no_better_move():
    r = np.random.default_rng(0)
    pairs = np.zeros((12, 12))
    for _ in range(3000):  # even units are followed by odd ones and the other way round
        a = r.integers(12)
        pairs[a, r.integers(6) * 2 + (a % 2 == 0)] += 1
    of = lm_scoring.exchange(pairs, classes=2)
    assert len(set(of[::2])) == 1 and len(set(of[1::2])) == 1 and of[0] != of[1]
    pairs = r.integers(0, 20, (15, 15)).astype(float)
    table = lambda x: np.eye(4)[x].T @ pairs @ np.eye(4)[x]
    of = lm_scoring.exchange(pairs, classes=4, sweeps=100)
    for w in range(15):
        for k in range(4):
            other = of.copy()
            other[w] = k
            assert lm_scoring.likelihood(table(other)) <= lm_scoring.likelihood(table(of)) + 1e-6


def test_merging_loses_least_information():
    def information(table):
        p = table / max(table.sum(), 1)
        return sum(p[a, b] * np.log(p[a, b] / (p[a].sum() * p[:, b].sum())) for a, b in zip(*np.nonzero(p), strict=True))

    r = np.random.default_rng(7)
    for _ in range(5):
        pairs = np.floor(r.exponential(6, (14, 14))) * (r.random((14, 14)) < 0.7)
        # Brown's algorithm by hand: every merging of two classes is tried.
        groups = [[w] for w in range(4)]
        for w in range(4, 14):
            groups.append([w])
            tried = []
            for a in range(5):
                for b in range(a + 1, 5):
                    one = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
                    tried.append((information(np.array([[pairs[np.ix_(x, y)].sum() for y in one] for x in one])), one))
            groups = max(tried, key=lambda x: x[0])[1]
        of = lm_scoring.merge(pairs, 4)
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(of == k).tolist()) for k in range(4)}
    assert lm_scoring.merge(pairs[:3, :3], 4).tolist() == [0, 1, 2]


def test_bigrams_count_all_neighbours(docs):
    names = ["", *WORDS[:7]]
    got = lm_scoring.bigrams(docs.select("text"), np.array([lm_scoring.hash_of(x.encode()) for x in names], np.uint64), 3)
    pairs = Counter((v, w) for _, x, _ in lm_parts() for v, w in zip(["", *x], x, strict=False))
    assert [[pairs[v, w] for w in names] for v in names] == got.tolist()


def test_lm_has_one_class_a_word_from_both_sides(spark, monkeypatch):
    # Words of one ending, one of each sort frequent; words before them are alike, those behind them tell the sorts apart.
    r = random.Random(2)
    sorts = {x: [f"{x}{k}end" for k in range(60)] for x in ("left", "right")}
    lines = [" ".join(f"{r.choice('pq')} {w} {x}" for x in r.choices(["left", "right"], k=60) for w in [r.choice([sorts[x][0], r.choice(sorts[x])])]) for _ in range(100)]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    signed = lambda w: np.array([lm_scoring.hash_of(w.encode())], np.uint64).view(np.int64)[0]
    # Merged on the driver, joined to the merged as frequent words, or as others.
    for merged, most in ((2048, 300_000), (7, 300_000), (7, 7)):
        monkeypatch.setattr(lm_scoring, "MERGED", merged)
        model = lm_scoring.train(df, most)
        words = {r["word"]: r["class"] for r in model.words.collect()}
        one, two = ({words[signed(w)] for w in s} for s in sorts.values())
        assert not one & two and len(words) == 125
        assert all(words[int(h)] == k for h, k in zip(model.first.hashes.view(np.int64), model.first.classes, strict=True))


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_packing(docs, none):
    lib = library()
    packed = packing.pack(packing.cut(docs, capacity=256, with_ids=True), capacity=256, group=50).collect()
    by_sequence, by_text = {}, Counter()
    for r in packed:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by_sequence.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 256
    for r in packed:
        by_text[r.doc_id, r.piece, r.start, tuple(r.ids)] += 1
    want = Counter()
    for i, x in rows():
        ids = [*lib.encode(x or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            want[i, k // 256, k, tuple(ids[k : k + 256])] += 1
    assert by_text == want and packing.pack_documents(none).count() == 0
    assert len(by_sequence) <= sum(r.length for r in packed) / 256 * 1.1 + 2


def test_local_search_empties_what_best_fit_leaves():
    r = random.Random(4)
    for _ in range(30):
        lengths = [r.randint(1, 100) for _ in range(60)]
        start = packing.best_fit(lengths, 100)
        end = packing.local_search(lengths, start, 100)
        assert sorted(i for b in end for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) <= 100 for b in end)
        fills = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
        assert len(end) <= len(start) and fills(end) >= fills(start)
    # Best fit leaves three bins, a swap makes two.
    assert len(packing.local_search([6, 5, 4, 3, 2], [[0, 3], [1, 2], [4]], 10)) == 2


def fewest_bins(lengths, capacity):
    """By dynamic programming over subsets: bins, and the least fill of the last of them."""
    best = [(0, capacity)] + [(99, 0)] * ((1 << len(lengths)) - 1)
    for done in range(1 << len(lengths)):
        bins, fill = best[done]
        for k, x in enumerate(lengths):
            if not done >> k & 1:
                best[done | 1 << k] = min(best[done | 1 << k], (bins, fill + x) if fill + x <= capacity else (bins + 1, x))
    return best[-1][0]


def test_local_search_against_the_optimum():
    r = random.Random(5)
    over = start = 0
    for _ in range(150):
        lengths = [r.randint(20, 55) for _ in range(11)]
        least = fewest_bins(lengths, 100)
        start += len(packing.best_fit(lengths, 100)) - least
        end = packing.pack_lengths(lengths, 100)
        assert least <= len(end) <= least + 1
        over += len(end) - least
    assert over <= start / 2 and over <= 15
    # Many pieces of a bin, of which those that must move are neither long nor the two shortest.
    lengths = [r.randint(50, 90) for _ in range(3000)]
    before, after = len(packing.best_fit(lengths, 205)), len(packing.pack_lengths(lengths, 205))
    assert after < before * 0.97


def test_packing_keeps_the_name_of_the_id(spark):
    df = spark.createDataFrame([("a", "one two"), (None, None)], "key string, text string")
    got = packing.pack_documents(df, "key").collect()
    assert {(r.key, r.length) for r in got} == {("a", 3), (None, 1)}


def test_warc(spark, tmp_path):
    pages = [(1, "http://b.Example.com/x?q=1#f", "same"), (2, "http://a.example.com/", "same"), (3, None, None), (4, "not a url \t", ""), (None, "http://c.org:8080/é", "same"), (5, "http://a.example.com/", "long " * 9000), (5, "http://a.example.com/", "long " * 9000), (6, "http://z/", "own")]
    df = spark.createDataFrame([(*x, 9) for x in pages], "page_id bigint, url string, html string, length int")
    folder = f"file://{tmp_path}/w"
    got = warc.archive_and_read_back(df, folder)
    want = []
    for i, _, html in pages:
        keeper = max((k for k, _, h in pages if (h or "") == (html or "") and k is not None), default=None)
        payload = (html or "").encode()
        revisit = keeper is not None and i != keeper
        want.append((i, len(payload), warc.digest(payload), "revisit" if revisit else "response", keeper if revisit else None, True))
    assert by_row(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok") == sorted(want, key=repr)
    records = [x for p in (tmp_path / "w" / "warc").iterdir() for x in warc.read_archive(p.read_bytes())]
    assert Counter(f["WARC-Type"] for f, _ in records) == Counter(x[3] for x in want)
    assert warc.surt("http://b.Example.com/x?q=1#f") == "com,example,b)/x?q=1"
    assert warc.archive_and_read_back(df.where("page_id = 99"), f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("directory", [1000, 4])
def test_warc_many_blocks(spark, tmp_path, monkeypatch, directory):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "DIRECTORY", directory)  # with 4 entries on top there are three levels
    df = spark.createDataFrame([(k, f"http://h{k % 7}.org/p{k}", f"page {k % 20}") for k in range(100)], "page_id bigint, url string, html string")
    got = warc.archive_and_read_back(df, f"file://{tmp_path}/w").collect()
    assert sorted(r.page_id for r in got) == list(range(100)) and all((r.record_type == "response") == (r.page_id >= 80) for r in got)
    captures = warc.write_archives(df, f"file://{tmp_path}/x")
    index = warc.build_index(captures, f"file://{tmp_path}/x")
    assert index.depth == (0 if directory == 1000 else 2) and len(index.keys) <= directory
    asked = spark.createDataFrame([(5, "http://h5.org/p5"), (5, "http://h5.org/p5"), (5, "http://aaa.org/"), (5, "http://zzz.org/")], "page_id bigint, url string")
    assert [r.page_id for r in warc.lookup(asked, index).collect()] == [5, 5]
    with pytest.raises(Exception, match="no capture of"):
        warc.lookup(asked, index, once=True).collect()


@pytest.mark.parametrize("directory", [1000, 2])
def test_warc_repeats_straddle_blocks(spark, tmp_path, monkeypatch, directory):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "DIRECTORY", directory)
    # Blocks are [1 1 2] [2 2 2] [2 3 3] [4 n n] [n n]: keys that begin at the end of a block, fill blocks, or repeat a null id.
    ids = [1, 1, *[2] * 5, 3, 3, 4, *[None] * 4]
    df = spark.createDataFrame([(k, "http://a.org/" if k else "http://z.org/", f"page {k}") for k in ids], "page_id bigint, url string, html string")
    got = warc.archive_and_read_back(df.coalesce(1), f"file://{tmp_path}/w").collect()
    assert Counter(r.page_id for r in got) == Counter(ids)
    # URLs of one key: a row for each of the rows, not for each pair of them.
    same = spark.createDataFrame([(1, "http://a.org/", "x"), (1, "https://a.org/#f", "y"), (None, None, "z"), (None, "", "z")], "page_id bigint, url string, html string")
    got = warc.archive_and_read_back(same, f"file://{tmp_path}/s").collect()
    assert Counter((r.page_id, r.payload_digest) for r in got) == Counter((k, warc.digest(x)) for k, x in [(1, b"x"), (1, b"y"), (None, b"z"), (None, b"z")])


def test_token_counts(docs, none, spark, tmp_path):
    lib = library()
    want = sorted(((i, len((x or "").encode()), len(lib.encode(x or "", add_special_tokens=False).ids)) for i, x in rows()), key=repr)
    cache = f"file://{tmp_path}/cache"
    got = token_counts.count_tokens(docs, cache=cache, limit=100)
    assert by_row(got, "doc_id", "n_bytes", "n_tokens") == want and all(r.over_limit == (r.n_tokens > 100) for r in got.collect())
    size = spark.read.parquet(cache).count()
    assert size == len({hashlib.sha256(token_counts.normalised(x).encode()).digest() for _, x in rows()})
    assert by_row(token_counts.count_tokens(docs, cache=cache), "doc_id", "n_bytes", "n_tokens") == want and spark.read.parquet(cache).count() == size
    assert token_counts.count_tokens(none).count() == 0


def naive_quality(x):
    x = x or ""
    w = ws(x)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        if ws(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality(docs, none):
    got = quality.repetition(docs)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_row(got, *columns) == sorted(((i, *naive_quality(x)) for i, x in rows()), key=repr)
    assert quality.repetition(none).count() == 0 and quality.keep_clean(docs).columns == docs.columns
    r = random.Random(1)
    data = ["".join(r.choice("ab c\n# é") for _ in range(r.randint(0, 200))) for _ in range(200)]
    found = quality.measure([x.encode() for x in data])
    assert [tuple(found[c][i].item() for c in columns[1:]) for i in range(200)] == [naive_quality(x) for x in data]


def test_quality_verdict():
    fresh = " ".join(f"word{k}" for k in range(200))
    again = " ".join(f"a{k}" for k in range(30))
    assert quality.measure([fresh.encode(), f"{fresh} {again} {fresh[:1200]}".encode()])["kept"].tolist() == [True, False]


def test_toxicity(spark):
    r = random.Random(2)
    data = []
    for k in range(900):
        words = [r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(r.randint(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            words.insert(r.randint(0, len(words)), r.choice(["nasty", "vile", "rotten"]))
        data.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, x, 3) for i, x, _ in data] + [(None, None, 3), (2000, "", 3), (3, data[3][1], 3)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in data] + [(None, 1, 1), (5000, 1, 1), (7, None, 1)], "doc_id bigint, toxic int, id int")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    truth = {i: y for i, _, y in data}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held) and len(got) == 903
    assert all(x.predicted == (x.score >= 0.7) and 0 <= x.score <= 1 for x in got) and not any(x.predicted for x in got if x.doc_id in (None, 2000))
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got if x.doc_id is not None)
    empty = toxicity.learn(docs, labels.where("doc_id = -1"))
    assert toxicity.score(docs, empty).where("predicted = 1").count() == 0 and toxicity.score(docs.where("doc_id = -1"), empty).count() == 0


def test_toxicity_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 11)
    rng = np.random.default_rng(4)
    model = toxicity.start(rng)
    for k, p in enumerate(model.parameters()):
        wide = p.astype(np.float64) * 3 + 0.1 * (k > 3)
        if k in (1, 2, 3):
            model.filters[k - 1] = wide
        else:
            setattr(model, {0: "embedding", 4: "bias", 5: "weight", 6: "offset"}[k], wide)
    features, count = rng.integers(0, 11, (6, 3)), np.array([5, 0, 1, 2])
    ids, y, weights = rng.integers(0, 6, 8), np.array([1.0, 0, 0, 1]), np.array([0.5, 1, 0.7, 1])
    for heat in (1.0, 4.0, None):
        loss, held, found = toxicity.gradients(model, features, ids, count, y, weights, heat)
        every = [np.zeros_like(model.embedding), *found[1:]]
        every[0][held] = found[0]
        for p, g in zip(model.parameters(), every, strict=True):
            for at in rng.choice(p.size, min(p.size, 12), replace=False):
                kept = p.flat[at]
                change = []
                for step in (1e-4, -1e-4):
                    p.flat[at] = kept + step
                    change.append(toxicity.gradients(model, features, ids, count, y, weights, heat)[0])
                p.flat[at] = kept
                assert abs((change[0] - change[1]) / 2e-4 - g.flat[at]) < 3e-3 * (1 + abs(g.flat[at]))


def test_toxicity_scores_by_brute_force():
    rng = np.random.default_rng(6)
    model = toxicity.start(rng)
    data = [b"one two three one", b"", b"two", ("lang " * 3000 + "end two one").encode(), b"one. TWO,three"]
    got, _ = model.logits(data, toxicity.Vocabulary())
    zero = np.zeros(toxicity.DIM)
    for text_, logit in zip(data, got, strict=True):
        words = [model.embedding[list(toxicity.word_features(w))].sum(axis=0) for w in toxicity.words_of(text_)]
        pool = []
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                windows = [sum(float((words[i + j] if i + j < len(words) else zero) @ model.filters[k][j][:, f]) for j in range(width)) for i in range(len(words))]
                pool.append(model.bias[k, f] + max(windows, default=0.0))
        assert abs(float(np.tanh(pool) @ model.weight + model.offset[0]) - logit) < 1e-3


def test_toxicity_widths_learn_alone():
    # Two words side by side are toxic, either of them alone is not: one word cannot tell, two can.
    r = random.Random(9)
    data, labels = [], []
    for k in range(600):
        words = [r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(r.randint(8, 30))]
        at = r.sample(range(0, len(words) - 1, 3), 2)
        words[at[0]], words[at[1]] = "hot", "dog"
        if k % 2:
            words[at[0] + 1] = "dog"
        data.append(" ".join(words).encode())
        labels.append(k % 2)
    right = lambda widths: float(np.mean((toxicity.train(data[:400], labels[:400], widths=widths).scores(data[400:], toxicity.Vocabulary()) >= 0.7) == np.array(labels[400:])))
    assert right((2,)) >= 0.9 and right((1, 2, 3)) >= 0.85 and right((1,)) < 0.8


def test_toxicity_sample_is_of_rows_that_fit(spark):
    docs = spark.createDataFrame([(k, "word " * (4000 if k % 2 else 5)) for k in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 < 2)) for k in range(400)], "doc_id bigint, toxic int")
    seen = []

    def train(data, labels_):
        seen.append((len(data), sum(labels_), max(map(len, data))))
        return toxicity.start(np.random.default_rng(0))

    old, toxicity.train = toxicity.train, train
    try:
        toxicity.learn(docs, labels, sample=20, sample_bytes=1000)
    finally:
        toxicity.train = old
    assert seen == [(40, 20, 25)]


def area_means(image, height, width):
    """Each new sample from all samples that its area touches, by the share of them that it covers."""
    h, w = image.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            for y in range(h):
                for x in range(w):
                    tall = max(0.0, min((i + 1) * h / height, y + 1) - max(i * h / height, y))
                    wide = max(0.0, min((j + 1) * w / width, x + 1) - max(j * w / width, x))
                    out[i, j] += image[y, x] * tall * wide
    return out / (h * w / (height * width))


def test_media(docs, none):
    got = media.digests(docs).collect()
    want = {}
    for i, x in rows():
        data = (x or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        pgm = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        feature = None
        if len(image) < 20:
            small, square = (np.floor(area_means(image, *shape) * k + (0.5 + 1e-6)) for shape, k in (((8, 9), 256), ((16, 16), 1)))
            bits = "".join(str(int(small[a, b] < small[a, b + 1])) for a in range(8) for b in range(8))
            out = io.BytesIO()
            np.save(out, square.astype(np.uint8))
            feature = f"{int(bits, 2):016x}:{hashlib.sha256(out.getvalue()).hexdigest()[:16]}"
        want.setdefault(i, []).append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(pgm), hashlib.sha256(pgm).hexdigest(), feature))
    for r in got:
        mine = (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256)
        assert any(mine == x[:-1] and x[-1] in (None, r.feature) for x in want[r.doc_id])
    assert len(got) == len(rows()) and media.digests(none).count() == 0


def test_media_features(spark):
    r = np.random.default_rng(1)
    grey, rgb = r.integers(0, 256, (9, 30), np.uint8), r.integers(0, 256, (40, 21, 3), np.uint8)
    rows_ = [(1, media.encode_pgm(grey)), (2, media.encode_bmp(rgb)), (3, None), (None, media.encode_pgm(grey)), (1, media.encode_pgm(grey))]
    df = spark.createDataFrame([(i, x, 0, "t") for i, x in rows_], "doc_id bigint, media binary, width int, tile string")
    got = media.features(df, size=4).collect()
    assert len(got) == 5 and media.features(df.where("doc_id = 9")).count() == 0
    for x in got:
        if x.doc_id == 3:
            assert x.width is None and x.tile is None and x.dhash is None
            continue
        image = rgb if x.doc_id == 2 else grey
        tile = np.load(io.BytesIO(x.tile))
        want = np.stack([area_means(image[:, :, k], 4, 4) for k in range(3)], axis=2) if image.ndim == 3 else area_means(image, 4, 4)
        assert (x.height, x.width) == image.shape[:2] and x.payload_sha256 == hashlib.sha256(image.tobytes()).hexdigest() and np.abs(tile - want).max() <= 0.5 + 1e-9
    for block in (1, 3, 7, 100):
        assert np.allclose(media.resize(grey, 5, 7, block), area_means(grey, 5, 7))


def test_images():
    r = np.random.default_rng(0)
    grey, rgb = r.integers(0, 256, (5, 7), np.uint8), r.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert (media.decode(b"P2 # c\n2 2\n255\n1 2\n3 4\n") == [[1, 2], [3, 4]]).all() and (media.decode(b"P1\n3 2\n101\n010\n") == [[1, 0, 1], [0, 1, 0]]).all()
    assert (media.decode(b"P4\n3 2\n\xa0\x40") == [[1, 0, 1], [0, 1, 0]]).all() and (media.decode(b"P6\n1 1\n255\n\x01\x02\x03") == [[[1, 2, 3]]]).all()
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02")[0, 0] == 258
    big = np.kron(grey, np.ones((4, 3)))
    assert np.allclose(media.resize(big, 5, 7), grey) and np.isclose(media.resize(grey, 3, 4).mean(), grey.mean())
    assert media.difference_hash(np.tile(np.arange(90), (8, 1))) == "ff" * 8
    assert np.load(io.BytesIO(media.tile(grey))).shape == (16, 16)
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


EMAIL, IP, CARD, PHONE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def naive_spans(x):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(x)] + [(1, *m.span()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(x) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(x) if 9 <= len(digits(m)) <= 15]


def test_pii(docs, none):
    got = pii.spans(docs, pii.learn(docs)).collect()
    want = Counter((i, pii.write(naive_spans(x or ""))) for i, x in rows())
    assert Counter((r.doc_id, r.base_sha256) for r in got) == Counter({(i, hashlib.sha256(s.encode()).hexdigest()): n for (i, s), n in want.items()})
    assert pii.spans(none, pii.learn(none)).count() == 0
    # Potentials from more than this one text: there a phone number without its plus is one where it repeats one.
    model = pii.fit([f"call +1 ({200 + k}) 555-{1000 + k} or write to me{k}@example.com about 10.1.2.{k}" for k in range(60)])
    one = next(r for r in pii.spans(docs, model).collect() if r.doc_id == 32)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1) and one.spans.count("phone:") == 2  # the repeat without its plus
    r = random.Random(3)
    for _ in range(4000):
        x = "".join(r.choice("a1@.+- (2)%\né5") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(x) == naive_spans(x)
    assert pii.masked("a bob@x.org b", [(0, 2, 11)]) == "a [EMAIL] b" and pii.base_spans("9" * 200000 + "@" * 1000) == []


def test_marginals_against_enumeration():
    """Sum-product messages are exact on trees: chains of neighbours and hubs that make no loop."""
    import itertools

    r = np.random.default_rng(2)
    n = len(pii.KINDS) + 1
    for trial in range(12):
        size = int(r.integers(2, 7))
        edges = [(int(r.integers(0, k)), k, int(r.integers(0, 2)), 0) for k in range(1, size)]
        chain, hub = r.normal(0, 1, (n, n)), r.normal(0, 1, (n, n))
        model = pii.Potentials(np.zeros((1, n)), chain + chain.T, hub + hub.T)
        scores = r.normal(0, 1, (size, n))
        want = np.zeros((size, n))
        for labels in itertools.product(range(n), repeat=size):
            weight = np.exp(sum(scores[i, x] for i, x in enumerate(labels)) + sum((model.hub if kind else model.chain)[labels[i], labels[j]] for i, j, kind, _ in edges))
            for i, x in enumerate(labels):
                want[i, x] += weight
        want /= want.sum(axis=1, keepdims=True)
        assert np.abs(pii.propagate(scores, np.array(edges), model) - want).max() < 2e-3


def test_pii_recall_of_planted_repeats():
    """Numbers without their plus and names without their domain, in texts where the whole stands too, and where not."""
    r = random.Random(11)
    fill = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(3, 30)))
    texts_, planted = [], []
    for k in range(300):
        number = f"({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
        whole_, part = f"+1 {number}", number
        repeated = k % 3 == 0
        texts_.append(f"{fill()} {whole_ if k % 3 != 2 else fill()} {fill()} {part if k % 3 != 1 else fill()} {fill()}")
        planted.append((repeated, part, k % 3 == 2))
    model = pii.fit(texts_)
    found = wrong = 0
    for text_, (repeated, part, alone), (base, every) in zip(texts_, planted, pii.find(texts_, model), strict=True):
        extra = {text_[a:b] for _, a, b in set(every) - set(base)}
        found += repeated and part in extra
        wrong += bool(extra) and not repeated
        assert set(base) <= set(every)
    assert found >= 95 and wrong == 0


def test_pii_evidence_reaches_all_mentions():
    model = pii.fit([])  # prior pair potentials; looks say nothing
    model.unary[:] = 0
    for fill in (" or ", " word" * 40 + " "):  # neighbours of each other, and none
        for first in ("+1 (415) 555-0001", "+415 555 0001"):  # the last seven digits alike, and all
            ((base, every),) = pii.find([fill.join([first, *["(415) 555-0001"] * 30])], model)
            assert len(base) == 1 and len(every) == 31 and {k for k, _, _ in every} == {3}
        assert pii.find([fill.join(["(415) 555-0001"] * 30)], model) == [([], [])]


def test_pii_learns_from_every_span(spark):
    plain = [(k, f"nothing here {k}") for k in range(4000)]
    some = [(4000 + k, f"call +1 ({200 + k}) 555-{1000 + k} or ({200 + k}) 555-{1000 + k}" + " far away" * 20 + f" me{k}@example.com") for k in range(20)]
    long = [(5000, " ".join(f"10.0.{k // 250}.{k % 250}" for k in range(600))), (None, "me@example.com you@example.com")]
    df = spark.createDataFrame([*plain, *some, *long], "doc_id bigint, text string")
    got, want = pii.learn(df), pii.fit([x for _, x in some + long])
    assert np.allclose(got.unary, want.unary) and np.allclose(got.chain, want.chain) and np.allclose(got.hub, want.hub)
    none = pii.learn(df.where("doc_id = -1"))
    assert np.allclose(none.unary, pii.fit([]).unary) and np.allclose(none.hub, pii.fit([]).hub)


def naive_components(data):
    sets = []
    for _, x in data:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), y) for y in ws(x)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(data)), key=repr)


@pytest.mark.parametrize("chunk", [512, 4])
def test_jaccard(spark, docs, none, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    r = random.Random(5)
    data = list(rows())
    for family in range(4):  # near copies of many degrees, among them some just under and over the bound
        base = [r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(r.choice([8, 40, 120]))]
        for k in range(14):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 15))):
                copy[r.randrange(len(copy))] = f"new{r.randint(0, 99)}"
            data.append((100 + 20 * family + k, " ".join(copy)))
    shared = " ".join(f"passage{k}" for k in range(60))
    data += [(300 + k, f"{text(500 + k, 50)} {shared} {text(600 + k, 60)}") for k in range(25)]
    df = spark.createDataFrame([(*x, 1) for x in data], "doc_id bigint, text string, class int")
    assert by_row(jaccard.join(df), "doc_id", "n_shingles", "component_id") == naive_components(data)
    if chunk == 512:
        assert jaccard.join(none).count() == 0
        kept = jaccard.keep_one(df)
        want = {(d, x) for d, x in data if any(d == c and d == e for e, _, c in naive_components(data))}
        assert kept.columns == df.columns and {r_.doc_id for r_ in kept.collect()} == {d for d, _ in want} | {None} and kept.where("doc_id = 5").count() == 1


def test_tree_bound_loses_nothing():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, n, np.uint64)) for n in (3, 40, 41, 600, 700, 2500)]
    sets += [np.unique(np.concatenate([x[: int(len(x) * f)], r.integers(0, 2**63, 2, np.uint64)])) for x in sets for f in (0.7, 0.8, 0.95)]
    sizes = np.array([len(x) for x in sets])
    got = set()
    for i, js, _ in jaccard.partners(np.arange(len(sets)), sizes, [jaccard.point(x).tobytes() for x in sets]):
        got |= {frozenset((i, j)) for j in js.tolist()}
    for i, a in enumerate(sets):
        for j in range(i):
            if jaccard.similar(len(np.intersect1d(a, sets[j])), len(a), len(sets[j])):
                assert frozenset((i, j)) in got


def test_bpe(docs, none):
    import tiktoken

    made = bpe.encoder(bpe.default_path(), bpe.default_pattern())
    lib = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=made.ranks, special_tokens={})
    want = []
    for i, x in rows():
        ids = lib.encode_ordinary(x or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert by_row(bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.encode(none).count() == 0
    r = random.Random(6)
    data = ["".join(r.choice("ab \n\t'sé1! \x85\x1c") for _ in range(r.randint(0, 40))) for _ in range(500)] + ["ab" * 5000, "!?" * 3000]
    assert [np.frombuffer(x, "<u4").tolist() for x in made.encode(data)] == [lib.encode_ordinary(x) for x in data]


def test_word_tokens():
    lib = library()
    r = random.Random(7)
    data = ["<|endoftext|> a<|endoftext|>b", "ΑΣ İ É́ á ́b", "x y\x1cz \x85", "it's I'll"] + ["".join(r.choice("Ab \n'é1!́,.") for _ in range(40)) for _ in range(200)]
    got = tokens.tokenizer(tokens.default_path()).ids([x.encode() for x in data])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(x, add_special_tokens=False).ids for x in data]


def test_chunks_go_to_the_library_together():
    mine, lib, handed = tokens.ChunkTokenizer(tokens.default_path()), library(), []
    mark = tokens.MARK.decode()
    # The mark stands in chunks and by itself, once, or as often as between all chunks of a text for the library.
    data = ["", mark, f"a{mark}b {mark}c d{mark} {mark}{mark}", " ".join(f"x{k}{mark}" for k in range(70)), " ".join(f"Wörd{k},it's<|endoftext|>{k}" for k in range(3000)), "e\u0301 \u0301 \u00a0 A\u030a\u2003B", " ".join(WORDS)]

    class Counted:
        def encode_batch_fast(self, texts, **how):
            handed.extend(texts)
            return lib.encode_batch_fast(texts, **how)

    mine.library = Counted()
    want = [np.array(lib.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in data]
    assert mine.ids([x.encode() for x in data]) == want
    assert len(handed) < 75 + 4000 / tokens.TOGETHER
    mine.mark = None
    mine.memo.clear()
    assert mine.ids([x.encode() for x in data]) == want
