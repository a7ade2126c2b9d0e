"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velloom.llm.mixing import mix
from velloom.llm.packing import pack
from velloom.llm.pii import KEY, pseudonyms
from velloom.llm.shared import work_dir, written
from velloom.llm.simhash import near_duplicates
from velloom.llm.toxicity import learn, score


#: Words that a worker remembers in packing, beside what the stages before have left in the executors' heaps.
MEMO = 200_000
#: Rows of an Arrow batch where whole rows travel, some with very long texts.
BATCH = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH rows at most, to bound what an executor holds beside its heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))


def inner(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., so that no name can clash with a stage's own, and the new name of each column."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``inner`` with a number for each row in column ``row``. It is written, so that the number stays with its row in every read."""
    plain, at = inner(docs)
    return written(plain.withColumn("row", F.monotonically_increasing_id()), "rows"), at


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the toxicity model, learnt from the labels of these documents, predicts toxic.

    Null and empty texts are judged as texts without words; repeated rows are judged alike; null and repeated ids stay; an empty table
    gives an empty one; other columns pass through, whatever their names.
    """
    small_batches(spark)
    plain, at = inner(docs)
    model = learn(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"), at["doc_id"], at["text"])
    scored = score(plain, model, at["doc_id"], at["text"], keep=plain.columns)
    return scored.where("predicted = 0").select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that with the smallest doc_id (null last), of several texts with it that of the
    least digest, of rows equal in both any one.

    Rows are told apart by doc_id and text, so null and repeated ids with different texts all stay. Null and empty texts form one
    group; an empty table gives an empty one; other columns pass through, whatever their names.
    """
    small_batches(spark)
    plain, at = inner(docs)
    id_, text = F.col(at["doc_id"]), F.col(at["text"])
    mark = F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("+"), id_.cast("string")), F.lit("-")), F.md5(text.cast("binary"))).cast("binary"))
    named = plain.select(F.struct(id_.isNull().alias("none"), id_.alias("doc_id"), mark.alias("mark")).alias("doc_id"), text.alias("text"))
    stay = near_duplicates(named).where("doc_id = component_id").select("doc_id.mark")
    return plain.withColumn("mark", mark).join(stay, "mark", "left_semi").dropDuplicates(["mark"]).select(*at.values()).toDF(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in place of personal data. Row by row: null texts stay null, all else passes through."""
    small_batches(spark)
    return pseudonyms(docs, KEY, spans_col=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents so that sources reach their weights, in the order of training positions.

    A null source is one of its own; texts without words cost nothing and come once if they stand before their source's border;
    repeated rows and ids each have their own place; an empty table gives an empty one; other columns pass through, whatever their names.
    """
    small_batches(spark)
    rows, at = numbered(docs)
    id_ = F.struct(F.col(at["doc_id"]).alias("doc_id"), "row").alias("doc_id")
    mixed = mix(rows.select(id_, F.col(at["text"]).alias("text"), F.col(at["source"]).alias("source")), cut=False)
    copies = mixed.select(F.col("doc_id.row").alias("row"), F.explode("copies.position").alias("position"))
    dealt = rows.join(copies, "row")
    return dealt.repartitionByRange("position", "row").sortWithinPartitions("position", "row").select(*at.values()).toDF(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 4096 tokens; a null or empty text is its end token alone, copies are packed each on their own."""
    small_batches(spark)
    return pack(docs, memo=MEMO)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can express neither the model nor the tokenizer; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
