"""Line algebra: texts as ordered lines, and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, let


def explode_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line): the lines of each text, numbered from 0. Null texts have none."""
    return df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _numbered(df: DataFrame, keys: list[str], text: str, made: Callable[[Column], Column], names: tuple[str, ...]) -> DataFrame:
    """``keys`` and the structs that ``made`` gives for the lines of each text. Within a row: nothing is shuffled, whatever a text's length."""
    found = df.where(F.col(text).isNotNull()).select(*keys, F.explode(let(F.split(text, "\n"), made)).alias("_x"))
    return found.select(*keys, *[F.col("_x")[n].alias(n) for n in names])


def cap_runs(df: DataFrame, keys: list[str], most: int = 2, text: str = "text") -> DataFrame:
    """WIN2: (keys, line_no, line) without what a run of equal lines has beyond ``most``. Null texts have no lines."""

    def kept(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
        return F.filter(numbered, lambda s: ~_same(lines, s.line, s.line_no, most))

    return _numbered(df, keys, text, kept, ("line_no", "line"))


def cap_runs_in_place(c: Column, most: int = 2) -> Column:
    """WIN2: the lines of one text that stay, as an array."""
    return let(F.split(c, "\n"), lambda lines: F.filter(lines, lambda x, i: ~_same(lines, x, i, most)))


def _same(lines: Column, x: Column, i: Column, most: int) -> Column:
    out = i >= most
    for k in range(most):
        out = out & (F.get(lines, i - F.lit(k + 1)) == x)
    return out


def paragraphs(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """SNK6: (keys, block_no, block, n_lines): maximal runs of lines that aren't blank, lines as they are. Null and blank texts have none."""

    def blocks(lines: Column) -> Column:
        def cut(blank: Column) -> Column:
            edge = lambda step: F.filter(F.sequence(F.lit(0), F.size(blank) - 1), lambda i: ~F.get(blank, i) & F.coalesce(F.get(blank, i + step), F.lit(True)))
            runs = F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            return F.transform(runs, lambda r, i: F.struct(i.cast("long").alias("block_no"), F.array_join(F.slice(lines, r.a + 1, r.b - r.a + 1), "\n").alias("block"), (r.b - r.a + 1).cast("long").alias("n_lines")))

        return let(F.transform(lines, is_blank), cut)

    return _numbered(df, keys, text, blocks, ("block_no", "block", "n_lines"))


def sheet_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """SNK4: (keys, row_no, line): the lines that aren't blank, numbered from 1. Null texts have none."""
    kept = lambda lines: F.transform(F.filter(lines, lambda x: ~is_blank(x)), lambda x, i: F.struct((i + 1).alias("row_no"), x.alias("line")))
    return _numbered(df, keys, text, kept, ("row_no", "line"))


def join_pages(df: DataFrame, doc: str, page: str, text: str = "text", joiner: str = "\n\n") -> DataFrame:
    """AGG2, AGG3, AGG5: (doc, text, pages): pages joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    return df.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda s: s[text]), joiner).alias("text"), F.count("*").alias("pages"))


def regroup(words: DataFrame, doc: str, line: str, at: str, word: str) -> DataFrame:
    """AGG11: (doc, text, n_lines) from recognised words: blanks dropped, a space between words, a newline between lines."""
    kept = words.where(~is_blank(F.col(word)) & F.col(word).isNotNull())
    one = kept.groupBy(doc, line).agg(F.expr(f"listagg({word}, ' ') within group (order by {at})").alias("one"))
    return one.groupBy(doc).agg(F.expr(f"listagg(one, '\\n') within group (order by {line})").alias("text"), F.count("*").alias("n_lines"))


def unknown_words(df: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """JN4: the rows whose word, in lower case, isn't in the lexicon; null words are unknown. Catalyst picks the join by size."""
    known = lexicon.select(F.lower(word).alias("known")).distinct()
    return df.join(known, F.lower(df[word]) == F.col("known"), "left_anti")


def page_limit(df: DataFrame, page: str, most: int = 50) -> DataFrame:
    """ORD3: the first ``most`` pages of each document; ``page`` counts from 0. A filter, so it reaches the scan."""
    return df.where(F.col(page) < most)


def page_count(pages: Column) -> Column:
    """AGG5: the number of pages of a document (an array); none, or no array, is an error."""
    n = F.coalesce(F.size(pages), F.lit(0))
    return F.when(n > 0, n).otherwise(F.raise_error(F.lit("no pages found")).cast("int"))


def zip_shortest(a: Column, b: Column, first: str, second: str) -> Column:
    """JN1: elements of two arrays side by side, as far as both go; null if either is null."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda c: F.slice(c, F.lit(1), n)
    return F.when(a.isNotNull() & b.isNotNull(), F.zip_with(cut(a), cut(b), lambda x, y: F.struct(x.alias(first), y.alias(second))))


def directory_sizes(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """AGG13: (directory, bytes, files): what lies in each directory and below it; '' is the root. Sums are partial before the shuffle."""
    parts = F.split(F.col(path), "/")
    above = let(parts, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: F.array_join(F.slice(p, 1, k), "/")))
    each = files.where(F.col(path).isNotNull()).select(F.explode(above).alias("directory"), F.col(size).alias("n"))
    return each.groupBy("directory").agg(F.sum("n").alias("bytes"), F.count("*").alias("files"))
