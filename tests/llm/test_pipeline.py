"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from quadlake.llm.queries import QUERIES


def corpus():
    r = random.Random(8)
    words = [f"w{k}" for k in range(800)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(k, prose(80)) for k in range(300)]
    docs = [(k, x + " vile nasty") if k % 10 == 0 else (k, x) for k, x in docs]
    near = docs[1][1].split()
    near[0] = "other"
    docs += [(400, docs[1][1]), (401, " ".join(near)), (402, "spam " * 100), (403, prose(60) + " write to bob@example.com"), (404, None)]
    return docs


def test_stages(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = now.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        kept.append({r.doc_id: r for r in now.collect()})
    clean = {i for i in range(300) if i % 10}
    assert set(kept[0]) == {i for i, _ in docs} - {402, 404}
    assert clean | {400, 401, 403} <= set(kept[1]) | set() and len(set(kept[1]) & {i for i in range(0, 300, 10)}) <= 2
    assert set(kept[2]) == set(kept[1]) - {400, 401}
    assert kept[3][403].text.endswith("write to [EMAIL]") and kept[3][403].n_chars == len(kept[3][403].text) and set(kept[3]) == set(kept[2])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3])


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "personal data", "packing"]


def test_stages_on_repeats_nulls_and_clashing_names(spark, tmp_path):
    """Rows that repeat an id, null ids and texts, a very long text, columns named as those that operators use."""
    docs = [(i, x) for i, x in corpus() if i < 60 or i > 399]
    docs += [(5, docs[5][1]), (5, "another text of the same id " + docs[7][1]), (None, docs[9][1]), (None, None), (500, " ".join(f"long{k}" for k in range(60000)))]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, _class int, id string, label int, score double, class bigint, unit bigint, n bigint, part int, k_id int"
    spark.createDataFrame([(i, x, "en", "s", len(x or ""), 1, "i", 2, 0.5, 3, 4, 5, 6, 7) for i, x in docs], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = now.count()
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns and now.count() <= before
    rows = now.collect()
    assert {r._class for r in rows} == {1} and {r.k_id for r in rows} == {7} and 500 in {r.doc_id for r in rows}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in packed if r.doc_id == 500) > 60000 and max(r.length for r in packed) == 2048


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
