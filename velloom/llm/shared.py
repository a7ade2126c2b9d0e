"""What the training-data operators share: shared storage, Arrow helpers, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session on this machine alone may leave it unset."""
    sc = spark.sparkContext
    has = sc._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if has.isEmpty():
        if not path and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="velloom-"))
        has = sc._jsc.sc().getCheckpointDir()
    return path or has.get()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; Hadoop removes it when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, for rows too wide to be checkpointed; reading it again gives the same rows."""
    path = work_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; its lineage ends there, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions for ``rows`` rows, at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def give_back() -> None:
    """Hands the memory that this worker has freed back to the system: workers outlive stages, and what they hold on to adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker's freed memory is given back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that maps each batch on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return giving_back(run)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null counts as empty. Reads Arrow's own buffer, so nothing is decoded."""
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.cast(pa.large_binary())
    for x in column:
        yield x.as_py() or b""


_kept: list = [None, None]


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """What ``make()`` gives, kept by this worker process until another key is asked for.

    A worker outlives tasks and stages; one cache at a time keeps what it holds from adding up over the stages of a job.
    """
    if _kept[0] != key:
        _kept[:] = [None, None]  # the old one goes before the new one is made
        _kept[:] = [key, make()]
    return _kept[1]


class Forest:
    """Union-find over 0..n-1 that takes whole arrays of links; the smallest index of a set is its root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self._u: list[np.ndarray] = []
        self._v: list[np.ndarray] = []
        self._held = 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        new = self.parent[u] != self.parent[v]
        if new.any():
            self._u.append(u[new])
            self._v.append(v[new])
            self._held += int(new.sum())
            if self._held > 500_000:
                self.flush()

    def flush(self) -> None:
        if not self._held:
            return
        u, v = np.concatenate(self._u), np.concatenate(self._v)
        self._u, self._v, self._held = [], [], 0
        p = self.parent
        while True:
            a, b = p[u], p[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while (q := p[p]).tobytes() != p.tobytes():
                p = q
            self.parent = p

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) for every node that isn't its own root."""
        self.flush()
        node = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return node, self.parent[node]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), one row per node that has a link.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a partial aggregate and an equi-join, until nothing
    changes; every round is checkpointed. ``root`` is the smallest node. Links with a null end and loops are ignored; repeated
    links count once; no links give an empty frame. No step gathers a component in one place.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo and hi is not null and lo is not null")
    e = saved(e.distinct())
    mark = _mark(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.select("hi", "lo").union(e.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), F.least("hi", "m").alias("m"))
        large = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        both = large.join(low, "hi")
        small = both.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo").union(low.select("hi", F.col("m").alias("lo")))
        e = saved(small.distinct())
        before, mark = mark, _mark(e)
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("lo", "hi"))).first())
