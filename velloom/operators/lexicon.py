"""Words against a lexicon as joins: look-alike letters and single edits. The lexicon is a table of any size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ALIKE


def in_lexicon(df: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """SCL16, JN4: the rows whose whole word, in lower case and of two letters or more, is in the lexicon."""
    known = lexicon.select(F.lower(word).alias("known")).distinct()
    return df.join(known, (F.lower(df[word]) == F.col("known")) & (F.length(df[word]) >= 2), "left_semi")


def look_alikes(words: DataFrame, lexicon: DataFrame, pairs: Iterable[str] = ALIKE, least: int = 5, word: str = "word") -> DataFrame:
    """JN5, SCL13, ORD2: (word, pick) for each different lower-case word of ``least`` letters or more that the lexicon lacks and that
    exactly one known word is three look-alike letters away from. ``pairs`` are letters that look alike, both ways.

    Words meet the lexicon by their spelling with one letter for all that are alike, also by way of others; pairs are then
    verified. So no variant is made: what is shuffled are the different words of both sides. Null words have no pick.
    """
    alike: dict[str, set[str]] = {}
    for a, b in pairs:
        alike.setdefault(a, set()).add(b)
        alike.setdefault(b, set()).add(a)
    table = F.create_map(*[x for k, v in sorted(alike.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    first = dict(zip(alike, alike))  # the letter that stands for a letter
    for x, y in ((x, y) for x, ys in alike.items() for y in ys):
        old, new = sorted((first[x], first[y]), reverse=True)
        first = {k: new if v == old else v for k, v in first.items()}
    letters, plain = "".join(first), "".join(first.values())
    key = lambda c: F.translate(c, letters, plain).alias("key")
    enough = lambda c: F.length(F.translate(c, letters, "")) <= F.length(c) - 3

    known = lexicon.select(F.lower(word).alias("known")).where("known is not null").distinct()
    asked = words.select(F.lower(word).alias("word")).where((F.length("word") >= least) & enough(F.col("word"))).distinct()
    unknown = asked.join(known, F.col("word") == F.col("known"), "left_anti")
    letter = lambda c, i: F.substring(F.col(c), i, F.lit(1))
    other = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: letter("word", i) != letter("known", i))
    swaps = lambda i: F.coalesce(F.array_contains(F.try_element_at(table, letter("word", i)), letter("known", i)), F.lit(False))
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as given, since few bytes make many pairs
    pairs = unknown.select("word", key(F.col("word"))).repartition(n, "key").join(known.where(enough(F.col("known"))).select("known", key(F.col("known"))), "key")
    near = F.levenshtein(F.col("word"), F.col("known"), 3) > 0  # cheap; leaves few pairs to look at letter by letter
    met = pairs.where(near).where((F.size(other) == 3) & F.forall(other, swaps)).groupBy("word").agg(F.min("known").alias("pick"), F.max("known").alias("last"))
    return met.where("pick = last").select("word", "pick")


def one_edit(words: DataFrame, lexicon: DataFrame, least: int = 4, word: str = "word", frequency: str = "n") -> DataFrame:
    """SCL15: (word, pick) for each different lower-case word of ``least`` letters or more, without a hyphen, that the lexicon lacks: the
    most frequent known word (the last by name of several) that one letter added, left out, changed or swapped with the next makes of it.

    Words one edit apart share a spelling with at most one letter left out, so both sides meet by these; pairs are then verified.
    """
    known = lexicon.select(F.lower(word).alias("known"), F.col(frequency).alias("n")).groupBy("known").agg(F.sum("n").alias("n")).where(F.length("known") >= least)
    asked = words.select(F.lower(word).alias("word")).where((F.length("word") >= least) & ~F.contains("word", F.lit("-"))).distinct()
    every = lexicon.select(F.lower(word).alias("known")).distinct()
    unknown = asked.join(every, F.col("word") == F.col("known"), "left_anti")

    def shorter(c: Column) -> Column:
        left_out = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return F.explode(F.array_distinct(F.concat(F.array(c), left_out)))

    a, b = F.col("word"), F.col("known")
    swapped = F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    pairs = unknown.select("word", shorter(a).alias("key")).join(known.select("known", "n", shorter(b).alias("key")), "key").where((F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & swapped))
    return pairs.groupBy("word").agg(F.max_by("known", F.struct("n", "known")).alias("pick"))
