"""Recognition of uploads around pluggable engines and correctors. No engine is shipped: weights aren't part of this library."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routing import engine_of
from ..functions.similarity import html_to_text, prefer_refined, stitch
from ..functions.text import word_count
from .images import decode_png, gray, row_ink, valleys, word_crops
from .jobs import elapsed_ms, upload_status
from .series import page_bands

#: An engine: a loader, called once a worker, whose result turns an image's bytes and a language into text, confidence and words.
Engine = Callable[[], Callable[[bytes, str], dict[str, Any]]]
#: What opens an upload: content type and bytes to the bytes of its pages.
Opener = Callable[[str, bytes], list[bytes]]
PAGE = "job_id string, page int, pages int, engine string, text string, confidence double, words array<struct<text:string,confidence:double>>, error string, began double, ended double"


#: Rows, and characters of their texts, that leave a worker at once.
MOST_ROWS, MOST_TEXT = 1000, 1 << 20
_WORDS = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64())]))
_TYPES = {"job_id": pa.string(), "page": pa.int32(), "pages": pa.int32(), "engine": pa.string(), "text": pa.string(), "confidence": pa.float64(), "words": _WORDS, "error": pa.string(), "began": pa.float64(), "ended": pa.float64()}


def _page_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, _TYPES.values())], names=list(_TYPES))


class ModelCache:
    """MDL9, CTL6: models of a worker by key, each loaded once. Loading an exclusive key puts the other exclusive ones out first."""

    def __init__(self, exclusive: frozenset[str] = frozenset(), put_out: Callable[[Any], None] = lambda model: None):
        self.exclusive, self.put_out, self.held = exclusive, put_out, {}

    def load(self, key: str, loader: Callable[[], Any]) -> Any:
        if key in self.exclusive:
            for other in [k for k in self.held if k in self.exclusive and k != key]:
                self.unload(other)
        if key not in self.held:
            self.held[key] = loader()
        return self.held[key]

    def unload(self, key: str) -> None:
        if key in self.held:
            self.put_out(self.held.pop(key))


#: This worker's models.
MODELS = ModelCache(frozenset({"chandra", "corrector"}))


def one_page(content_type: str, content: bytes) -> list[bytes]:
    """The upload itself as its only page; documents of several pages need an opener of their own."""
    if content_type == "application/pdf":
        raise ValueError("no opener for documents of several pages")
    return [content]


def by_words(read: Callable[[list[np.ndarray]], list[str]], ink: Callable[[np.ndarray], np.ndarray], batch: int = 8) -> Callable[[bytes, str], dict[str, Any]]:
    """MDL2: an engine around a model that reads pictures of words, ``batch`` at a time. ``ink`` makes writing 255 and paper 0.

    Words of a line are joined by spaces, lines by newlines; blank words and lines without any are left out; there is no confidence.
    """

    def run(content: bytes, lang: str) -> dict[str, Any]:
        page = decode_png(content)
        crops = word_crops(page, ink(page))
        found: list[str] = []
        for i in range(0, len(crops), batch):
            found += read([c for _, c in crops[i : i + batch]])
        words = [(line, w.strip()) for (line, _), w in zip(crops, found) if w.strip()]
        by_line: dict[int, list[str]] = {}
        for line, w in words:
            by_line.setdefault(line, []).append(w)
        return {"text": "\n".join(" ".join(x) for x in by_line.values()), "confidence": None, "words": [{"text": w, "confidence": None} for _, w in words]}

    return run


def by_bands(read: Callable[[np.ndarray, str | None, int], str], strips: int = 3, prompt: str | None = None, refine: Callable[[str], str] | None = None) -> Callable[[bytes, str], dict[str, Any]]:
    """MDL3: an engine around a model that reads a picture with a prompt and a budget of tokens, and answers in markup.

    A tall page is read in overlapping bands cut between its lines; the bands' texts are stitched. ``refine`` makes the prompt of a
    second look at the whole page from the text; its answer counts as far as FLT6 lets it.
    """

    def run(content: bytes, lang: str) -> dict[str, Any]:
        page = decode_png(content)
        bands = page_bands(page.shape[0], valleys(row_ink(gray(page))), max(1, strips))
        budget = 1536 if len(bands) > 1 else 2048
        text = stitch([html_to_text(read(page[a:b], prompt, budget)) for a, b in bands])
        if refine and text.strip():
            text = prefer_refined(text, html_to_text(read(page, refine(text), 2048))) or ""
        return {"text": text, "confidence": None, "words": []}

    return run


def pages_of(uploads: DataFrame, name: str, engine: Engine, opener: Opener = one_page, most: int = 50) -> DataFrame:
    """SRC3, ORD3: (PAGE) for each of the first ``most`` pages of each upload (job_id, content_type, content, lang), by one engine.

    A page that fails has its error and no text; an upload that can't be opened, or has no page, is one row with an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0  # characters of their texts
        for batch in batches:
            read = MODELS.load(name, engine)
            for k in range(batch.num_rows):
                if len(rows) >= MOST_ROWS or held >= MOST_TEXT:
                    yield _page_rows(rows)
                    rows, held = [], 0
                job, kind, content, lang = (batch.column(c)[k].as_py() for c in range(4))
                began = time.time()
                try:
                    pages = opener(kind, content)[:most]
                    if not pages:
                        raise ValueError("no pages found")
                except Exception as failed:  # one upload's failure is its own
                    rows.append((job, 0, 0, name, None, None, None, str(failed), began, time.time()))
                    continue
                for i, page in enumerate(pages):
                    began, found, error = time.time(), {}, None
                    try:
                        found = read(page, lang)
                    except Exception as failed:
                        error = str(failed)
                    rows.append((job, i, len(pages), name, found.get("text"), found.get("confidence"), found.get("words"), error, began, time.time()))
                    held += len(found.get("text") or "") + 50 * len(found.get("words") or ())
            del batch  # before the next one is read
        yield _page_rows(rows)
        pa.default_memory_pool().release_unused()

    return uploads.select("job_id", "content_type", "content", "lang").mapInArrow(run, PAGE)


def recognize(uploads: DataFrame, engines: Mapping[str, Engine], correctors: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, opener: Opener = one_page) -> DataFrame:
    """API3, MDL6, STR3: one job for each upload (job_id, content_type, content, lang, engine, corrector).

    Columns: job_id, http_status, status, phase, progress, engine, corrector, text, text_corrected, words, confidence, pages, error,
    recognize_ms. Uploads that fail a check have its status and nothing else. The others go to their engine, each engine in a
    pass of its own, so that a worker holds one model at a time; pages are joined in order, a blank line between them. A job with a
    page that fails is an error. ``correctors`` map (job_id, text) to (job_id, corrected); a corrector's rows are split off before it
    runs. A null upload is an empty one. An engine that is allowed but not given here is an error of the job.
    """
    correctors = correctors or {}
    size = F.coalesce(F.length("content"), F.lit(0))
    checked = uploads.withColumn("http_status", upload_status(F.col("content_type"), F.col("engine"), F.col("corrector"), size))
    good = checked.where("http_status = 200")
    read = None
    for name, engine in engines.items():
        one = pages_of(good.where(engine_of(F.col("engine")) == name), name, engine, opener)
        read = one if read is None else read.unionByName(one)
    missing = good.where(~engine_of(F.col("engine")).isin(*engines) if engines else F.lit(True))
    missing = missing.select("job_id", F.lit(0).alias("page"), F.lit(0).alias("pages"), F.col("engine"), *[F.lit(None).cast(t).alias(n) for n, t in (("text", "string"), ("confidence", "double"), ("words", "array<struct<text:string,confidence:double>>"))], F.lit("no such engine here").alias("error"), F.lit(0.0).alias("began"), F.lit(0.0).alias("ended"))
    read = missing if read is None else read.unionByName(missing)
    in_order = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    one_page_only: Column = F.max("pages") == 1
    jobs = read.groupBy("job_id").agg(
        F.max_by("engine", "page").alias("ran"),
        F.array_join(F.transform(in_order, lambda p: p.text), "\n\n").alias("text"),
        F.when(one_page_only, F.max("confidence")).alias("confidence"),
        F.max("pages").alias("pages"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("error"),
        F.sum(elapsed_ms(F.col("began"), F.col("ended"))).alias("recognize_ms"),
    )
    fine = jobs.where("error is null").join(good.select("job_id", F.col("corrector")), "job_id")
    corrected = None
    for name, corrector in correctors.items():
        one = corrector(fine.where(F.col("corrector") == name).select("job_id", "text"))
        corrected = one if corrected is None else corrected.unionByName(one)
    out = checked.select("job_id", "http_status", F.col("engine").alias("asked"), "corrector").join(jobs, "job_id", "left")
    out = out.join(corrected, "job_id", "left") if corrected is not None else out.withColumn("corrected", F.lit(None).cast("string"))
    ran, ok = F.col("http_status") == 200, (F.col("http_status") == 200) & F.col("error").isNull()
    state = F.when(ok, "done").when(ran, "error")
    text = F.when(ok, F.col("text"))
    return out.select(
        "job_id", "http_status", state.alias("status"), state.alias("phase"), F.when(ok, F.lit(1.0)).when(ran, F.lit(0.0)).alias("progress"), F.coalesce("ran", "asked").alias("engine"), "corrector",
        text.alias("text"), F.when(ok, F.col("corrected")).alias("text_corrected"), F.when(ok, word_count(F.col("text"))).alias("words"), F.when(ok, F.col("confidence")).alias("confidence"), F.when(ok, F.col("pages")).alias("pages"), "error", F.when(ran, F.col("recognize_ms")).alias("recognize_ms"),
    )
