"""Token counts through a digest cache.

A text's cache key is the SHA-256 of its content, white space runs normalised to one space (the tokenizer drops
white space, so equal keys have equal counts), next to a digest of the tokenizer's vocabulary file. Keys are joined
to the counts stored; of the keys that miss, one document each is encoded; the counts found are appended.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, over_texts, stored
from .tokens import default_path, tokenizer

CACHE_SCHEMA = "digest binary, n_tokens bigint"


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit.

    cache: a folder of Parquet files, one below it for each tokenizer version and first byte of the digest, that grows
    with each call; None takes a new one. Of it a call reads its own version, and of that the folders that its digests
    fall in. Null and empty texts have no tokens. Repeated rows give repeated results; a null id stays null. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    path, cache = path or default_path(), cache or new_folder(spark, "token-cache")
    version = version_of(path)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    plain = docs.select(docs[id_col].alias("id"), text.alias("text"))
    digest = F.unhex(F.sha2(F.trim(F.regexp_replace("text", "[ \\t-\\r]+", " ")), 256))
    keyed = plain.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), digest.alias("digest"), F.xxhash64("id").alias("place"))
    keys = stored(keyed, "token-keys")
    # One place for each distinct key. Texts that miss then move by (place, key): the copies of a text have places of
    # their own, so no group of copies meets in one task.
    asked = keys.groupBy("digest").agg(F.min("place").alias("place"))
    if _exists(spark, cache):
        held = spark.read.schema(CACHE_SCHEMA + ", version string, first int").parquet(cache).where(F.col("version") == version)
        firsts = [r[0] for r in keys.select(_first("digest").alias("f")).distinct().collect()]  # 256 at most
        held = held.where(F.col("first").isin(*firsts)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        known = stored(asked.join(held, "digest", "left"), "token-known")
        misses = known.where("n_tokens is null").select("digest", "place")
    else:
        known, misses = None, asked
    missed = plain.select(F.xxhash64("id").alias("place"), digest.alias("digest"), "text").join(misses.hint("shuffle_hash"), ["place", "digest"], "left_semi")

    met: set[bytes] = set()

    def encode(digests: pa.Array, data: list[bytes]) -> dict:
        # Repeated rows of one id share a place; a task has all of them.
        new = [i for i, x in enumerate(digests.to_pylist()) if x not in met and not met.add(x)]
        digests, data = digests.take(pa.array(new, pa.int64())), [data[i] for i in new]
        return {"digest": digests, "n_tokens": pa.array([len(x) // 4 for x in tokenizer(path).ids(data)], pa.int64())}

    # Tables of their own, so that the join below deals both sides out itself and AQE can split a key that many rows have.
    fresh = stored(over_texts(missed, "digest", "text", CACHE_SCHEMA, encode, remembers=True), "token-counts")
    fresh.select("*", F.lit(version).alias("version"), _first("digest").alias("first")).repartition("first").write.mode("append").partitionBy("version", "first").parquet(cache)
    counts = fresh if known is None else known.where("n_tokens is not null").select("digest", "n_tokens").unionByName(fresh)
    return keys.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _first(column: str) -> F.Column:
    """The first byte of a digest."""
    return F.conv(F.hex(F.substring(column, 1, 1)), 16, 10).cast("int")


def normalised(text: str | None) -> str:
    """The content that a cache key digests, for tests and other writers of the cache."""
    return re.sub("[ \t-\r]+", " ", text or "").strip(" ")
