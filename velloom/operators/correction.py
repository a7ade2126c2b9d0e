"""Correction of texts by a pluggable model: cut into segments, correct those that qualify, put the text together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routing import LONG_PACK, SHORT_PACK, goes_to_model
from ..functions.text import is_blank, let, pack, runs_of, sentence_units

_SEGMENT = "array<struct<text:string,corrects:boolean,after:string>>"


def _segments(texts: Column, corrects: Column | bool, joiner: str) -> Column:
    """Segments of an array of texts, ``joiner`` between them."""
    return let(texts, lambda t: F.transform(t, lambda x, i: F.struct(x.alias("text"), F.lit(corrects).alias("corrects"), F.when(i < F.size(t) - 1, F.lit(joiner)).otherwise("").alias("after"))))


def _units(line: Column) -> Column:
    """SCL10; a line without any sentence is its own unit."""
    return let(sentence_units(line), lambda u: F.when(F.size(u) > 0, u).otherwise(F.array(line)))


def packs(text: Column, limit: int, joiner: str) -> Column:
    """WIN8 over whole texts: the sentence units of all lines in packs."""
    return pack(F.flatten(F.transform(F.split(text, "\n"), _units)), limit, joiner)


def paragraph_parts(text: Column) -> Column:
    """SCL11: runs of newlines and what stands between them, in order."""
    return F.regexp_extract_all(text, F.lit(r"(\n+|[^\n]+)"), F.lit(1))


def text_nodes(text: Column) -> Column:
    """SCL17: (text, is_node) pieces of markup: a node stands between the end of a tag and the start of the next."""
    pieces = F.regexp_extract_all(text, F.lit("([<>]|[^<>]+)"), F.lit(1))
    inside = lambda p, i: F.coalesce((F.get(p, i - 1) == ">") & (F.get(p, i + 1) == "<"), F.lit(False))
    return let(pieces, lambda p: F.transform(p, lambda x, i: F.struct(x.alias("text"), (~x.isin("<", ">") & inside(p, i)).alias("is_node"))))


def has_markup(text: Column) -> Column:
    return F.contains(text, F.lit("<")) & F.contains(text, F.lit(">"))


def markup_segments(text: Column, limit: int) -> Column:
    """Nodes of markup, cut at ``limit`` words; all else stays."""
    cut = lambda n: _segments(runs_of(F.split(n.text, " "), limit), True, " ")
    return F.flatten(F.transform(text_nodes(text), lambda n: F.when(n.is_node, cut(n)).otherwise(_segments(F.array(n.text), False, "")).cast(_SEGMENT)))


def line_segments(text: Column, limit: int = SHORT_PACK) -> Column:
    """SCL11: packs of each line, a space between them; blank lines and newlines stay. Packs never cross a line."""
    cut = lambda x: _segments(packs(x, limit, " "), True, " ")
    return F.flatten(F.transform(paragraph_parts(text), lambda x: F.when(is_blank(x), _segments(F.array(x), False, "")).otherwise(cut(x)).cast(_SEGMENT)))


def text_segments(text: Column, limit: int = LONG_PACK) -> Column:
    """Packs of the whole text, a newline between them; they may cross lines."""
    return _segments(packs(text, limit, "\n"), True, "\n").cast(_SEGMENT)


def total_packs(text: Column, limit: int = SHORT_PACK) -> Column:
    """AGG12: how many packs a text makes, at least 1: what progress is measured against."""
    n = F.aggregate(F.filter(paragraph_parts(text), lambda x: ~is_blank(x)), F.lit(0), lambda a, x: a + F.size(packs(x, limit, " ")))
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(0)))


def correct(df: DataFrame, key: str, text: str, model: Callable[[Column], Column], seq2seq: bool = True, limit: int | None = None, lexical: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """MDL7: (key, corrected) for each row of ``df``, whose ``key`` tells rows apart. ``model`` and ``lexical`` may be Arrow UDFs.

    Markup is corrected node by node; of other texts a sequence model gets packs of each line, a chat model packs of the whole
    text. Blank segments and scraps of forms never reach the model: they are split off before it, as a condition around a
    UDF would not keep it from running. ``lexical`` runs before and after. A null text stays null, an empty one empty.

    Segments are shuffled by key once and put together there; one text's segments meet in one task, as its row did.
    """
    limit = limit or (SHORT_PACK if seq2seq else LONG_PACK)
    source = df.select(F.col(key).alias("key"), lexical(F.col(text)).alias("text"))
    plain = line_segments(F.col("text"), limit) if seq2seq else text_segments(F.col("text"), limit)
    cut = source.select("key", F.posexplode_outer(F.when(has_markup(F.col("text")), markup_segments(F.col("text"), limit)).otherwise(plain)).alias("at", "s"), F.col("text").isNotNull().alias("has"))
    cut = cut.select("key", "at", F.col("s.text").alias("segment"), F.coalesce(F.col("s.corrects") & goes_to_model(F.col("s.text")), F.lit(False)).alias("routed"), F.col("s.after").alias("after"), "has")
    done = cut.where("routed").withColumn("segment", model(F.col("segment"))).unionByName(cut.where("not routed"))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.concat(F.coalesce("segment", F.lit("")), F.coalesce("after", F.lit(""))).alias("x"))))
    whole = done.groupBy("key").agg(F.when(F.max("has"), F.array_join(F.transform(ordered, lambda s: s.x), "")).alias("text"))
    return whole.select(F.col("key").alias(key), lexical(F.col("text")).alias("corrected"))
