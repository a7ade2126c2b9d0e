"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts, saved

#: Blocks that a shard is made of, about; groups for one local packing; rows of one group that are numbered in one task.
BLOCKS, GROUPS, ROWS = 1024, 20_000, 100_000
LEAF = 256


class Tree:
    """Open bins by remaining room: a balanced tree of two levels, leaves of at most 2 * LEAF sorted (room, bin) pairs."""

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.last: list[tuple[int, int]] = []

    def add(self, room: int, bin_: int) -> None:
        x = (room, bin_)
        if not self.leaves:
            self.leaves, self.last = [[x]], [x]
            return
        k = min(bisect_left(self.last, x), len(self.leaves) - 1)
        leaf = self.leaves[k]
        insort(leaf, x)
        if len(leaf) > 2 * LEAF:
            self.leaves[k : k + 1] = [leaf[:LEAF], leaf[LEAF:]]
            self.last[k : k + 1] = [leaf[LEAF - 1], leaf[-1]]
        else:
            self.last[k] = leaf[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest bin that has room for ``size``."""
        k = bisect_left(self.last, (size, -1))
        if k == len(self.leaves):
            return None
        leaf = self.leaves[k]
        x = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.last[k] = leaf[-1]
        else:
            del self.leaves[k], self.last[k]
        return x


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each size and the number of bins; ``sizes`` descend. A size beyond the capacity gets a bin of its own."""
    tree, bins, n = Tree(), [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            room, bin_ = max(capacity - size, 0), n
            n += 1
        else:
            room, bin_ = found[0] - size, found[1]
        if room:
            tree.add(room, bin_)
        bins.append(bin_)
    return bins, n


def fewest(sizes: list[int], bins: int) -> tuple[list[int], int]:
    """Best fit into at most ``bins`` bins at the least capacity that bisection finds, so that the bins come out near equal."""
    low = max(-(-sum(sizes) // bins), max(sizes, default=0))
    high = low + max(sizes, default=0)
    while best_fit(sizes, high)[1] > bins:
        high += max(1, high // 64)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if best_fit(sizes, mid)[1] > bins else (low, mid)
    return best_fit(sizes, high)[0], high


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, group_rows): all rows of ``docs`` in ``shards`` shards near equal in bytes.

    Rows of equal text form a group that stays together. Groups, sorted by size, enter the tightest block of a local packing; the
    blocks, at most about 2 * BLOCKS * shards and one a partition, are packed the same way into the shards on the driver. ``slot``
    counts from 0 without gaps in each shard. A row's size is its UTF-8 bytes plus 1.

    Null texts are one group of size 1 and CRC 0, apart from empty texts; repeated rows each get a slot; an empty table gives an
    empty result; other columns are ignored. A group beyond a shard's share makes its shard that large: groups are indivisible. The
    rows of a group are numbered by parts salted by row number, so a group of any share of the rows, of one id or none, is spread over many
    tasks.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    kept = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    rows, total = kept.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(max(64, -(-rows // ROWS)))))
    per_salt = salted.groupBy("key", "salt").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    groups = per_salt.groupBy("key").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    capacity = max(1, total // (shards * BLOCKS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(bytes=pdf["n"] * pdf["size"]).sort_values(["bytes", "key"], ascending=[False, True])
        pdf["block"] = best_fit(pdf["bytes"].tolist(), capacity)[0]
        pdf["first"] = pdf.groupby("block")["n"].cumsum() - pdf["n"]
        return pdf[["key", "bucket", "block", "first", "n", "bytes"]]

    buckets = parts(spark, rows, GROUPS)
    local = groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(pack, "key string, bucket long, block long, first long, n long, bytes long")
    local = saved(local)
    blocks = sorted(map(tuple, local.groupBy("bucket", "block").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()), key=lambda b: (-b[2], b[0], b[1]))
    bins, _ = fewest([b[2] for b in blocks], shards)
    filled, table = [0] * shards, []
    for (bucket, block, _, n), bin_ in zip(blocks, bins):
        table.append((bucket, block, bin_, filled[bin_]))
        filled[bin_] += n
    where = spark.createDataFrame(pd.DataFrame(table, columns=["bucket", "block", "shard", "base"]).astype("int64"), "bucket long, block long, shard long, base long")
    placed = local.join(where, ["bucket", "block"]).select("key", "shard", (F.col("base") + F.col("first")).alias("base"), F.col("n").alias("group_rows"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_salt.select("key", "salt", F.coalesce(before, F.lit(0)).alias("before")).join(placed, "key")
    numbered = salted.withColumn("at", F.row_number().over(Window.partitionBy("key", "salt").orderBy("doc_id", "row")) - 1)
    return numbered.join(starts, ["key", "salt"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("before") + F.col("at")).cast("long").alias("slot"), "group_rows")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Query: all documents in eight shards near equal in bytes, equal texts together."""
    done = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_rows")
