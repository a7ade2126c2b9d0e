"""Job state, retention, rates and upload checks as batch relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip

#: Accepted content types, engines, correctors, the size limit in bytes, retained jobs.
CONTENT_TYPES = ("image/png", "image/jpeg", "image/jpg", "image/bmp", "image/tiff", "image/webp", "application/pdf")
ENGINES, CORRECTORS = ("tesseract", "trocr", "chandra"), ("none", "spell", "context")
MOST_BYTES, RETAINED = 30 * 1024 * 1024, 50
#: Export formats; those that are written here.
EXPORTS, WRITTEN = ("txt", "md", "docx", "xlsx", "pdf"), ("txt", "md", "docx", "xlsx", "pdf")
#: Polling paths that a log leaves out.
QUIET = ("/api/progress", "/api/metrics")


def upload_status(content_type: Column, engine: Column, corrector: Column, size: Column) -> Column:
    """SRC4: the first check that fails, in this order, as an HTTP status; 200 if none does."""
    return (
        F.when(~F.coalesce(content_type, F.lit("")).isin(*CONTENT_TYPES), 415)
        .when(~F.coalesce(engine, F.lit("")).isin(*ENGINES), 400)
        .when(~F.coalesce(corrector, F.lit("")).isin(*CORRECTORS), 400)
        .when(F.coalesce(size, F.lit(0)) == 0, 400)
        .when(size > MOST_BYTES, 413)
        .otherwise(200)
    )


def loud(message: Column) -> Column:
    """FLT3: whether a log line is kept."""
    return ~(F.contains(message, F.lit(QUIET[0])) | F.contains(message, F.lit(QUIET[1])))


def retained(jobs: DataFrame, created: str, seq: str, most: int = RETAINED) -> DataFrame:
    """ORD1: the latest jobs. A sorted limit keeps each task's own latest, so nothing is gathered beyond ``most`` rows a task."""
    return jobs.orderBy(F.col(created).desc(), F.col(seq).desc()).limit(most)


def fold(changes: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """STR1, STR3: one row a job, each field the last value that a change set; a partial aggregate, whatever the number of changes."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]
    return changes.groupBy(key).agg(*last, F.count("*").alias("changes"))


def rates(samples: DataFrame, key: str, ts: str, counter: str, factor: float = 8 / 1e6, digits: int = 2, tie: str | None = None) -> DataFrame:
    """WIN1, STR4: change of a counter a second since the key's sample before, never below 0; 0 for the first. ``ts`` in seconds.

    Samples of one time follow the order of ``tie``; a missing count or time makes its own and the next rate 0.
    """
    w = Window.partitionBy(key).orderBy(ts, *([tie] if tie else []))
    dt = F.greatest(F.lit(1e-3), F.col(ts) - F.lag(ts).over(w))
    change = F.greatest(F.lit(0.0), (F.col(counter) - F.lag(counter).over(w)) / dt)
    return samples.withColumn("rate", F.coalesce(F.round(change * factor, digits), F.lit(0.0)))


def mean_confidence(words: Column) -> Column:
    """FLT2, AGG1: the mean confidence of words with text and a confidence of 0 or more; 0 without any."""
    kept = F.transform(confident(words), lambda w: w.confidence)
    return let(kept, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, c: a + c) / F.size(k)).otherwise(0.0))


def confident(words: Column) -> Column:
    """FLT2: words (structs of text and confidence) with text, stripped, and a confidence of 0 or more; one that is no number is -1."""
    read = F.transform(words, lambda w: F.struct(strip(w.text).alias("text"), F.coalesce(w.confidence.try_cast("double"), F.lit(-1.0)).alias("confidence")))
    return F.filter(read, lambda w: (F.coalesce(w.text, F.lit("")) != "") & (w.confidence >= 0))


def result(text: Column, engine: Column, confidence: Column, words: Column) -> Column:
    """PRJ1: a recognition as a struct, confidences with two decimals. Spark rounds the decimal value half up; where that is a tie, a
    rounding of the binary value may differ in the last digit."""
    each = F.transform(words, lambda w: F.struct(w.text.alias("text"), F.round(w.confidence, 2).alias("confidence")))
    return F.struct(text.alias("text"), engine.alias("engine"), F.round(confidence, 2).alias("confidence"), F.coalesce(each, F.array().cast("array<struct<text:string,confidence:double>>")).alias("words"))


def response(value: Column) -> Column:
    """SNK9: a struct as JSON; null fields are written."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def snapshot(asked: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """JN7, STR2, API4: for each asked key the job's row, and http_status 200, or 404 where there is none. Catalyst picks the join by size."""
    known = jobs.withColumn("_known", F.lit(True))
    found = asked.join(known, key, "left")
    return found.withColumn("http_status", F.when(F.col("_known"), 200).otherwise(404)).drop("_known")


def elapsed_ms(created: Column, updated: Column) -> Column:
    """STR1: whole milliseconds from a job's creation to its last update, from epoch seconds, truncated."""
    return ((updated - created) * 1000).cast("long")


def export_status(fmt: Column, known: Column, status: Column) -> Column:
    """SNK8: format, then job, then state, then whether this library writes the format."""
    return F.when(~F.coalesce(fmt, F.lit("")).isin(*EXPORTS), 400).when(~known, 404).when(F.coalesce(status, F.lit("")) != "done", 409).when(~fmt.isin(*WRITTEN), 501).otherwise(200)


def export_name(job_id: Column, fmt: Column) -> Column:
    """SNK8: the name of an exported file."""
    return F.concat(F.lit("ocr-"), F.substring(job_id, 1, 8), F.lit("."), fmt)


def timings(began: Column, recognised: Column, ended: Column) -> Column:
    """AGG15: whole milliseconds of the steps of a job from epoch seconds, truncated; correction counts from recognition on."""
    ms = lambda a, b: ((b - a) * 1000).cast("long")
    return F.struct(ms(began, recognised).alias("recognize_ms"), ms(recognised, ended).alias("correct_ms"), ms(began, ended).alias("total_ms"))


def page_confidence(confidence: Column) -> Column:
    """AGG2, an aggregate: a document's confidence if it has one page only, else null."""
    return F.when(F.count("*") == 1, F.max(confidence))
