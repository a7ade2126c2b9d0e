"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import inf

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
#: Rows of one part of a source that are ordered in one task.
ROWS = 50_000
#: Weight of a source over time, as (time, weight) knots from 0 to 1 with straight lines between; by the source's rank modulo 3.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))


def by_rank(rank: int) -> float:
    """Weights 1, 2, 3, repeating."""
    return rank % 3 + 1.0


def shares(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Targets that share the sum of the sizes by weight; none is above ``cap`` times its size, the excess goes to the others."""
    target = [0.0] * len(sizes)
    free, rest = set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = rest / sum(weights[i] for i in sorted(free))
        over = sorted(i for i in free if weights[i] * unit > cap * sizes[i])
        if not over:
            for i in free:
                target[i] = weights[i] * unit
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            rest -= target[i]
            free.remove(i)
    return target


def demand(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float, float]]:
    """The integral of a schedule, scaled to end at 1, piece by piece: (from, to, time, length, weight at its start, at its end)."""
    whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    pieces, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2 / whole
        pieces.append((done, done + area, t0, t1 - t0, w0 / whole, w1 / whole))
        done += area
    pieces[-1] = (pieces[-1][0], inf, *pieces[-1][2:])
    return pieces


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Callable[[int], float] = by_rank, schedules: Sequence = SCHEDULES, cap: int = CAP, cut: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken, copies[(copy, words, position)].

    Size counts words. Sources rank by code point, null last; ``weight`` gives a rank's weight and ``shares`` the targets in words.
    A source's documents stand in an order that a digest of doc_id and text decides, repeated ``cap`` times; the mix takes what lies
    before the target. With ``cut`` the document on the border gives only the words before it, so each source meets its target
    to a word; without, a copy is taken whole if its middle lies before the border. A copy's training position in 0..1 is where the
    integral of its source's schedule reaches the words before it: cumulative demand, inverted.

    Null and empty texts have size 0 and nothing is taken of them (without ``cut`` an empty document is taken once if it stands
    before the border); repeated rows each have their own place; a null doc_id is kept; an empty table gives an empty result; other
    columns are ignored. A source of any share is ordered in parts of about ROWS rows, whose totals alone meet;
    rows without an id, or with one id, fall apart by their texts, and only rows equal in both meet in one part.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    kept = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"), F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit("order"), F.md5(text.cast("binary"))).cast("binary")).alias("turn")))
    totals = kept.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row a source
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    rows = sum(r["n"] for r in totals)
    targets = shares([r["size"] for r in totals], [weight(i) for i in range(len(totals))], cap)
    curve = "array<struct<f0:double,f1:double,t0:double,dt:double,w0:double,w1:double>>"
    table = [(r["source"], i, r["size"], t, round(t), demand(schedules[i % len(schedules)])) for i, (r, t) in enumerate(zip(totals, targets))]
    sources = spark.createDataFrame(table, f"name string, rank int, source_size long, target double, words long, curve {curve}")
    parts = max(256, -(-rows // ROWS))
    # a range of the order is a part
    part = F.coalesce(F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * parts / 2**32).cast("int"), F.lit(0))
    ranked = kept.join(sources, kept.source.eqNullSafe(sources.name)).withColumn("part", part)
    sums = ranked.groupBy("rank", "part").agg(F.sum("size").alias("of_part"))
    earlier = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "part", F.coalesce(F.sum("of_part").over(earlier), F.lit(0)).alias("before_part"))
    inner = Window.partitionBy("rank", "part").orderBy("turn", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, ["rank", "part"]).withColumn("before", F.col("before") + F.col("before_part"))

    def copy(k):
        at = k.cast("long") * F.col("source_size") + F.col("before")
        if cut:
            words = F.greatest(F.lit(0), F.least(F.col("words") - at, F.col("size"))).cast("long")
            taken = words > 0
        else:
            words = F.col("size")
            taken = F.when(F.col("size") == 0, (k == 0) & (at <= F.col("words"))).otherwise(2 * at + F.col("size") <= 2 * F.col("words"))
        done = at / F.greatest(F.col("words"), F.lit(1))
        piece = F.try_element_at(F.filter("curve", lambda p: (p.f0 <= done) & (done < p.f1)), F.lit(1))
        slope, f = (piece.w1 - piece.w0) / piece.dt, done - piece.f0
        root = F.sqrt(F.greatest(F.lit(0.0), piece.w0 * piece.w0 + 2 * slope * f))
        time = piece.t0 + F.least(piece.dt, 2 * f / F.greatest(piece.w0 + root, F.lit(1e-300)))
        return F.struct(k.cast("int").alias("copy"), words.alias("words"), F.when(taken, time).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), copy), lambda c: c.position.isNotNull())
    done = placed.withColumn("copies", copies)
    return done.select("doc_id", "source", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c.words).alias("taken"), "copies", "text_hash")


def curriculum(mixed: DataFrame) -> DataFrame:
    """The copies that a mix takes, range-sorted by training position: (doc_id, source, copy, words, position).

    Copies at one position follow doc_id and copy; a null doc_id comes first among them; an empty mix gives an empty result.
    """
    copies = mixed.select("doc_id", "source", F.explode("copies").alias("c")).select("doc_id", "source", "c.copy", "c.words", "c.position")
    return copies.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Query: what a mix of all documents' sources at weights 1, 2, 3 takes of each document, range-sorted by its first training position.

    Documents of which nothing is taken come last.
    """
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.try_element_at(F.filter("copies", lambda c: c.copy == 0), F.lit(1))
    done = mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(first.position, 9).alias("first_position"), F.size("copies").alias("n_copies"))
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id")]
    return done.repartitionByRange(*order).sortWithinPartitions(*order)


def oracle_sql() -> str:
    """The query in SQL. Sources ordered by the ratio of cap to weight fill up one after the other; the first that doesn't sets the unit."""
    curve = "case (rank % 3)::int " + " ".join(f"when {i} then {[dict(zip(('f0', 'f1', 't0', 'dt', 'w0', 'w1'), (1e300 if x == inf else x for x in p))) for p in demand(k)]}" for i, k in enumerate(SCHEDULES)) + " end"
    return f"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) size, md5(concat_ws('|', doc_id::varchar, 'order', md5(text))) turn from documents),
    s as (select source, source_size, rank, rank % 3 + 1.0::double weight from (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 rank from d group by source)),
    o as (select *, {CAP} * source_size cap_, {CAP} * source_size / weight ratio, sum(source_size) over () total, sum(weight) over () weights, row_number() over (order by {CAP} * source_size / weight, rank) k from s),
    u as (select *, (total - coalesce(sum(cap_) over before, 0)) / (weights - coalesce(sum(weight) over before, 0)) unit from o window before as (order by k rows between unbounded preceding and 1 preceding)),
    f as (select unit, k from u where weight * unit <= cap_ order by k limit 1),
    t as (select source, source_size, rank, target, round_even(target, 0)::bigint words, {curve} curve from (select u.*, case when f.k is not null and u.k >= f.k then weight * f.unit else cap_ end::double target from u left join f on true)),
    p as (select d.doc_id, d.size, t.*, coalesce(sum(d.size) over (partition by d.source order by turn nulls first, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0)::bigint before from d join t on d.source is not distinct from t.source),
    c as (select *, list_transform(range({CAP}), lambda k: greatest(0, least(words - (k * source_size + before), size))) w, before / greatest(words, 1) done from p),
    x as (select *, list_filter(curve, lambda q: q.f0 <= done and done < q.f1)[1] q from c)
    select doc_id, size, source_size, target, list_sum(w)::bigint taken, case when w[1] > 0 then round(q.t0 + least(q.dt, 2 * (done - q.f0) / greatest(q.w0 + sqrt(greatest(0::double, q.w0 * q.w0 + 2 * ((q.w1 - q.w0) / q.dt) * (done - q.f0))), 1e-300::double)), 9) end first_position, len(list_filter(w, lambda y: y > 0))::int n_copies from x"""
