"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import md5
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .shared import Forest, by_batch, components, parts, saved

#: Hashes concatenated in a pass's order, neighbours that each vector is compared with in it, passes after which recall is estimated.
HASHES, NEIGHBOURS, PASSES = 64, 512, 4
LEAST, RECALL = 0.9, 0.98
#: Rows of a range of the order; rows of a block of a component; links of one component that count in the estimate.
RANGE, BLOCK, WEIGHT = 50_000, 1024, 16


def planes(size: int, pass_: int, hashes: int = HASHES) -> np.ndarray:
    """The random hyperplanes of a pass, the same on every machine."""
    return np.random.default_rng([size, pass_]).standard_normal((size, hashes))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision."""
    vectors = vectors.astype(np.float64)
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def code(x: np.ndarray, pass_: int) -> np.ndarray:
    """The hashes of a pass as one number; numbers sort as the concatenated hashes do."""
    bits = np.packbits(x @ planes(x.shape[1], pass_) > 0, axis=1)
    return (bits.view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def window_links(x: np.ndarray, least: float, neighbours: int, forest: Forest | None = None, cross: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) row numbers: a spanning forest of the pairs at most ``neighbours`` apart whose cosine reaches ``least``.

    Products are taken in single precision first; where its error could decide, in double. ``cross``: only pairs on either side of it.
    """
    forest = forest or Forest(len(x))
    single, doubt = x.astype(np.float32), (x.shape[1] + 4) * 2.0**-23
    for at in range(0, len(x) if cross is None else cross, 256):
        cosine = single[at : at + 256] @ single[at : at + 256 + neighbours].T
        r, c = np.nonzero(cosine >= least - doubt)
        near = (c > r) & (c - r <= neighbours)
        if cross is not None:
            near &= (r + at < cross) & (c + at >= cross)
        r, c = r[near], c[near]
        close = np.flatnonzero(cosine[r, c] < least + doubt)
        if len(close):
            fine = np.ones(len(r), bool)
            for i in range(0, len(close), 65_536):
                some = close[i : i + 65_536]
                fine[some] = (x[r[some] + at] * x[c[some] + at]).sum(axis=1) >= least
            r, c = r[fine], c[fine]
        forest.add(r + at, c + at)
    return forest.edges()


def pass_links(one: DataFrame, passes: range, kind: str, rows: int, least: float, neighbours: int) -> DataFrame:
    """(a, b): links that connect whatever vectors stand at most ``neighbours`` apart in the order of some pass and reach ``least``.

    A task has a range of an order. What stands near a border of ranges is handed on, placed by the ranges' sizes, and compared
    across each border, so the links connect the same vectors however many ranges there are.
    """
    spark = one.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == size))
                x = unit(np.frombuffer(b"".join(some.column("vec").to_pylist()), kind).reshape(-1, size))
                for p in passes:
                    n = some.num_rows
                    yield pa.record_batch([pa.array([p] * n, pa.int32()), some.column("size"), pa.array(code(x, p)), some.column("key"), some.column("vec")], names=["pass", "size", "code", "key", "vec"])

    names = ["a", "b", "pass", "size", "part", "at", "n", "key", "vec"]
    types = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def record(length: int, **given) -> pa.RecordBatch:
        return pa.record_batch([pa.array(given[c], t) if isinstance(given.get(c), list) else pa.array([given.get(c)] * length, t) for c, t in zip(names, types)], names=names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, done, keys, vecs = None, 0, [], []  # done: rows of this pass before those held

        def links(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done, keys, vecs
            p, size = now
            node, root = window_links(unit(np.frombuffer(b"".join(vecs), kind).reshape(-1, size)), least, neighbours)
            if len(node):
                yield record(len(node), a=[keys[i] for i in node], b=[keys[i] for i in root])
            border = lambda lo, hi: record(hi - lo, **{"pass": p}, size=size, part=part, at=list(range(done + lo, done + hi)), key=keys[lo:hi], vec=vecs[lo:hi])
            head = max(0, min(len(keys), neighbours - done))
            if head:
                yield border(0, head)
            if last:
                tail = max(head, len(keys) - neighbours)
                if tail < len(keys):
                    yield border(tail, len(keys))
                yield record(1, **{"pass": p}, size=size, part=part, n=done + len(keys))
                done, keys, vecs = 0, [], []
            else:  # the last rows stay: those after them are their neighbours
                done += len(keys) - neighbours
                keys, vecs = keys[-neighbours:], vecs[-neighbours:]

        for batch in batches:
            for p, size, key, vec in zip(*(batch.column(c).to_pylist() for c in ("pass", "size", "key", "vec"))):
                if (p, size) != now:
                    if now:
                        yield from links(True)
                    now = (p, size)
                keys.append(key)
                vecs.append(vec)
                if len(keys) >= 8192 + neighbours:
                    yield from links(False)
        if now:
            yield from links(True)

    order = ["pass", "size", "code", "key"]
    marked = one.select("key", "size", "vec").mapInArrow(hashed, "pass int, size int, code long, key binary, vec binary")
    ordered = marked.repartitionByRange(parts(spark, rows * len(passes), RANGE), *order).sortWithinPartitions(*order)
    schema = "a binary, b binary, pass int, size int, part long, at long, n long, key binary, vec binary"
    found = saved(ordered.mapInArrow(windows, schema))
    ranges = sorted(map(tuple, found.where("n is not null").select("pass", "size", "part", "n").collect()))  # one row a range and pass
    table, first, before = [], {}, {}
    for p, size, part, n in ranges:
        start = before.get((p, size), 0)
        first.setdefault((p, size), []).append(start)
        table.append((p, size, part, start))
        before[p, size] = start + n
    borders = [(p, size, x) for (p, size), starts in first.items() for x in starts[1:]]
    if not borders:
        return found.where("a is not null").select("a", "b")
    # where ranges are short, a row lies near several borders
    near: dict[tuple, list[int]] = {}
    for p, size, part, start in table:
        starts = first[p, size]
        after = bisect_right(starts, start)
        end = starts[after] if after < len(starts) else before[p, size]
        near[p, size, part] = starts[max(1, bisect_right(starts, start - neighbours)) : bisect_left(starts, end + neighbours)]
    where = spark.createDataFrame([(*t, near[t[:3]]) for t in table], "pass int, size int, part long, start long, near array<long>")
    rows_ = found.where("key is not null").join(F.broadcast(where), ["pass", "size", "part"]).withColumn("at", F.col("at") + F.col("start"))
    rows_ = rows_.select("pass", "size", "at", "key", "vec", F.explode("near").alias("border"))
    rows_ = rows_.where((F.col("at") >= F.col("border") - neighbours) & (F.col("at") < F.col("border") + neighbours))

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        keys, at = table["key"].to_pylist(), table["at"].to_numpy()
        size, border = table["size"][0].as_py(), table["border"][0].as_py()
        node, root = window_links(unit(np.frombuffer(b"".join(table["vec"].to_pylist()), kind).reshape(-1, size)), least, neighbours, cross=int((at < border).sum()))
        return pa.table({"a": pa.array([keys[i] for i in node], pa.binary()), "b": pa.array([keys[i] for i in root], pa.binary())})

    crossed = rows_.groupBy("pass", "size", "border").applyInArrow(across, "a binary, b binary")
    return saved(found.where("a is not null").select("a", "b").unionByName(crossed))


def near_vectors(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", passes: int = PASSES, neighbours: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Equal vectors are first made one row with a count. Each pass orders them by HASHES concatenated random hyperplane hashes (ties by
    a digest of the vector) and compares each with its next ``neighbours``, deciding in double precision; verified pairs of all
    passes are joined to components. How many passes that takes depends on the number of vectors and on how crowded they are, so it is
    measured: after each lot of ``passes`` the share of its links that earlier lots had joined tells what further lots
    would find, and passes go on until the estimated recall is reached. In the estimate a component counts with WEIGHT links at most,
    so that large groups can't hide missed pairs.

    A bounded window can't hold a large group, so all pairs within each component are then compared in blocks, which makes n_links
    whole inside components whatever their size: blocks return counts for their own rows, never pairs.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Vectors of different lengths
    never link. Repeated rows link with each other; a null vec_id counts as a link but never as component_id unless alone; an empty
    table gives an empty result; other columns are ignored.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, FloatType) else "<f8"

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        vecs: list[bytes | None] = []
        for v in batch.column(1):
            x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind) + 0  # no negative zero
            vecs.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
        keys = [None if v is None else md5(v).digest() for v in vecs]
        sizes = [None if v is None else len(v) // int(kind[2]) for v in vecs]
        return pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "size", "vec"])

    v = F.col(vector_col) if kind == "<f4" else F.transform(vector_col, lambda c: c.cast("double"))
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = picked.mapInArrow(by_batch(read), "vec_id long, key binary, size int, vec binary")
    # the vector of a key: any of its copies
    one = saved(rows.where("key is not null").groupBy("key").agg(F.any_value("vec").alias("vec"), F.any_value("size").alias("size"), F.count("*").alias("copies"), F.min("vec_id").alias("first")))
    ids = saved(rows.select("vec_id", "key"))
    n = one.count()
    label = None
    for lot in count(1):
        found = pass_links(one, range((lot - 1) * passes, lot * passes), kind, n, least, neighbours)
        old = label
        label = components(found if old is None else found.unionByName(old.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if old is None:
            continue
        known = F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)).cast("int")
        judged = found.join(old.toDF("a", "ra"), "a", "left").join(old.toDF("b", "rb"), "b", "left").join(label.toDF("a", "now"), "a")
        shares = judged.groupBy("now").agg(F.count("*").alias("n"), F.avg(known).alias("known"))
        weight = F.least("n", F.lit(WEIGHT))
        of, all_ = shares.agg(F.sum(weight * F.col("known")), F.sum(weight)).first()
        if not all_ or 1 - (1 - of / all_) ** (lot / (lot - 1)) >= recall:
            break
    linked = saved(one.join(label, one.key == label.node).select("root", "key", "size", "vec", "copies", F.xxhash64("key").alias("h")))
    sizes = linked.groupBy("root").agg(F.count("*").alias("m")).select("root", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = linked.join(sizes, "root").withColumn("block", F.pmod(F.col("h"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy("root", "block", "blocks").agg(F.collect_list(F.struct("key", "copies", "size", "vec")).alias("members"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = packed.select("root", "block", "members", "blocks", other).select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "members")

    def degrees(group: pd.DataFrame) -> pd.DataFrame:
        sides = {}
        for block, members in zip(group["block"], group["members"]):
            x = unit(np.frombuffer(b"".join(m["vec"] for m in members), kind).reshape(-1, members[0]["size"]))
            sides[block] = ([m["key"] for m in members], np.array([m["copies"] for m in members], np.int64), x)
        lo, hi = sides[group["lo"].iloc[0]], sides.get(group["hi"].iloc[0])
        if hi is None:
            return pd.DataFrame({"key": [], "n": []})
        near = lo[2] @ hi[2].T >= least
        if hi is lo:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"key": lo[0], "n": near @ hi[1]})
        return pd.DataFrame({"key": lo[0] + hi[0], "n": np.concatenate([near @ hi[1], near.T @ lo[1]])})

    degree = pairs.groupBy("root", "lo", "hi").applyInPandas(degrees, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = label.join(one.select("key", "first"), label.node == one.key).groupBy("root").agg(F.min("first").alias("component_id"))
    top = saved(top)  # so that a join with a large component can be split
    counts = one.select("key", "copies", "first")
    whole = counts.join(label, counts.key == label.node, "left").join(top, "root", "left").join(degree, "key", "left")
    whole = saved(whole.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")))
    alone = ids.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = ids.where("key is not null").join(whole, "key").select("vec_id", "n_links", "component_id").unionByName(alone)
    return done.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op6_embeddings(spark, sf_dir: str) -> DataFrame:
    """Query: links and components of all embeddings at cosine 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle_sql() -> str:
    """The query in SQL, by all pairs."""
    return f"""with recursive e as (select vec_id, embedding::double[] v from embeddings where len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding) and len(list_filter(embedding, lambda c: c <> 0)) > 0),
    n as (select *, sqrt(list_dot_product(v, v)) norm from e),
    l as (select a.vec_id a, b.vec_id b from n a join n b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {LEAST}),
    r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
    select vec_id, coalesce(n_links, 0) n_links, least(vec_id, coalesce(m, vec_id)) component_id, vec_id <= coalesce(m, vec_id) kept from embeddings
    left join (select a, count(*) n_links from l group by a) x on x.a = vec_id left join (select a, min(b) m from r group by a) y on y.a = vec_id"""
