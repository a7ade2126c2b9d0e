"""Token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from .shared import giving_back, parts, saved, utf8, work_dir
from .tokenizing import counter, vocabulary
from .tokenizing import version as version_of

#: Bytes that are encoded in one go; rows of a partition that is encoded.
AT_ONCE, PER_PART = 1_000_000, 20_000
CACHE = "digest binary, version string, n_tokens long"


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops rows whose digest this task has lately seen, to ship less. That each digest is encoded once rests on ``_runs`` alone."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        if len(seen) > 1_000_000:
            seen.clear()
        if keep:
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the first row of each digest of rows sorted by digest."""
    last = None
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d != last:
                keep.append(i)
                last = d
        if keep:
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The counts that the cache holds for this tokenizer version; None without a cache."""
    try:
        return spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).select("digest", "n_tokens")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def token_counts(docs: DataFrame, cache: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``; counts of contents new to ``cache`` are appended to it.

    The content (null as empty; nothing else may be normalised without changing counts) is known by its SHA-256, the tokenizer by the
    digest of its file and library version. Contents that the cache lacks meet by digest, after each task has dropped repeats
    of its own, and the sorted ones of a partition are each encoded once. The cache holds one row for a digest and version as long as writers take turns.
    A worker remembers counts within a fixed number of bytes and gives freed memory back after each task, as Spark keeps more workers
    than run at a time.

    Null and empty texts count 0; repeated rows are counted alike; a null doc_id is kept; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or vocabulary("byte_bpe_50k.json")
    version = version_of(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    keyed = saved(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")))
    known = stored(spark, cache, version)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = counter(path)
        for batch in _runs(batches):
            counts, some, n, texts = [], [], 0, utf8(batch.column(1))
            for i, x in enumerate(texts, 1):
                some.append(x)
                n += len(x)
                if n > AT_ONCE or i == batch.num_rows:
                    counts += code.counts(some)
                    some, n = [], 0
            yield pa.record_batch([batch.column(0), pa.array([version] * batch.num_rows), pa.array(counts, pa.int64())], names=["digest", "version", "n_tokens"])

    contents = docs.select(digest.alias("digest"), text.alias("text")).mapInArrow(giving_back(_distinct), "digest binary, text string")
    if known is not None:
        contents = contents.join(known.select("digest"), "digest", "left_anti")
    missed = contents.repartition(parts(spark, keyed.count(), PER_PART), "digest").sortWithinPartitions("digest").mapInArrow(giving_back(encode), CACHE)
    missed.write.mode("append").parquet(cache)
    return keyed.join(stored(spark, cache, version), "digest").select("doc_id", "n_bytes", "n_tokens")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: byte-level token counts of all documents, through a cache that starts empty."""
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{work_dir(spark, 'token-cache')}/counts")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
