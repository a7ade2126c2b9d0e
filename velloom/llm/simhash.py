"""SimHash near-duplicates: 64-bit fingerprints, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Forest, by_batch, components, parts, saved, utf8

WORDS, SEED, BITS = 4, 42, 64
#: Rows of a tile: a 32nd of the fingerprints, between these bounds.
TILE_LEAST, TILE_MOST = 4096, 65_536
RUN = 256
#: Tile pairs of a task, counted from both sides.
PAIRS = 16


def fingerprint(data: bytes) -> int:
    """The fingerprint of one text: majority bits of the XXH64 of its shingles, repeats included; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return h(text, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - WORDS]]
    n, ones = len(starts), np.zeros(BITS, np.int64)
    for i in range(0, n, 65_536):
        hashes = np.fromiter((h(text[s : e - 1], SEED) for s, e in zip(starts[i : i + 65_536], ends[i + WORDS - 1 : i + 65_536 + WORDS - 1])), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text, as a signed 64-bit integer. A struct may stand for an id, else it is a long.

    One row for each row; null and empty texts have fingerprint 0, null ids are kept, an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(x) for x in utf8(batch.column(1))), np.uint64, batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    id_type = id_type if id_type.startswith("struct") else "long"
    picked = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(by_batch(run), f"doc_id {id_type}, fp long")


def _quarters(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts, the highest first."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)[:, ::-1]).astype(np.int16)


def link_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of two tiles (or within one, b None) as a spanning forest: (node, root) fingerprints.

    Both sides are cut into runs ordered by the population counts of their quarters. Runs whose counts differ by more than the
    radius in all can hold no link and are skipped; the rest are compared in full by exclusive-or and bit count.
    """

    def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q = _quarters(x)
        order = np.lexsort(q.T[::-1])
        x, q = x[order], q[order]
        at = np.arange(0, len(x), RUN)
        return x, at, np.minimum.reduceat(q, at, axis=0), np.maximum.reduceat(q, at, axis=0)

    x, ax, lo_x, hi_x = runs(a)
    y, ay, lo_y, hi_y = (x, ax, lo_x, hi_x) if b is None else runs(b)
    shift = 0 if b is None else len(x)
    forest = Forest(shift + len(y))
    for k, i in enumerate(ax):
        gap = np.maximum(0, np.maximum(lo_y - hi_x[k], lo_x[k] - hi_y)).sum(axis=1)
        left = x[i : i + RUN, None]
        for j in ay[(gap <= radius) & ((ay >= i) | (b is not None))]:
            r, c = np.nonzero(np.bitwise_count(left ^ y[None, j : j + RUN]) <= radius)
            if len(r) > (len(left) if b is None and i == j else 0):
                forest.add(r + i, c + (j + shift))
    values = x if b is None else np.concatenate([x, y])
    node, root = forest.edges()
    return values[node], values[root]


def _tiling(hist: list, tile: int) -> tuple[list[tuple], np.ndarray]:
    """Cells (p, p1, p2 -> first tile, chunks), and each tile's bounds (p, p1, p2 least and most)."""
    cells, boxes, held = [], [], 0
    for p, p1, p2, n in sorted(tuple(r) for r in hist):
        if n > tile:
            k = -(-n // tile)
            cells.append((p, p1, p2, len(boxes), k))
            boxes += [[p, p, p1, p1, p2, p2] for _ in range(k)]
            held = tile
        else:
            if not boxes or held + n > tile or boxes[-1][0] != p:
                boxes.append([p, p, p1, p1, p2, p2])
                held = 0
            box = boxes[-1]
            box[:] = [box[0], p, min(box[2], p1), max(box[3], p1), min(box[4], p2), max(box[5], p2)]
            held += n
            cells.append((p, p1, p2, len(boxes) - 1, 1))
    return cells, np.array(boxes, np.int16).reshape(-1, 6)


def _partners(boxes: np.ndarray, i: int, radius: int) -> np.ndarray:
    """Tiles that can hold a fingerprint within the radius of one in tile ``i``."""
    away = lambda k: np.maximum(0, np.maximum(boxes[:, k] - boxes[i, k + 1], boxes[i, k] - boxes[:, k + 1]))
    return np.flatnonzero((away(0) <= radius) & (away(2) + away(4) <= radius))


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links that connect whatever distinct fingerprints (column fp) lie within ``radius`` bits, directly or through others.

    Each tile holds fingerprints of one population count and, as far as needed, of a range of counts in the first two quarters.
    Each pair of tiles whose counts are no further apart than the radius is one task of bounded size; it returns a spanning forest
    of its links, so a dense group of n fingerprints gives at most n rows a task and never its pairs. The cost is quadratic in the
    number of distinct fingerprints, less what the counts let skip. ``fps`` holds no nulls and no repeats; an empty one gives no links.
    """
    spark = fps.sparkSession
    pop = lambda c: F.bit_count(c).cast("int")
    cut = fps.select("fp", pop(F.col("fp")).alias("p"), pop(F.shiftrightunsigned("fp", 48)).alias("p1"), pop(F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(0xFFFF))).alias("p2"))
    hist = cut.groupBy("p", "p1", "p2").count().collect()  # at most 65 * 17 * 17 rows
    total = sum(r["count"] for r in hist)
    tile = min(TILE_MOST, max(TILE_LEAST, total // 32))
    cells, boxes = _tiling(hist, tile)
    if not cells:
        return spark.createDataFrame([], "a long, b long")
    table = spark.createDataFrame(pd.DataFrame(cells, columns=["p", "p1", "p2", "first", "chunks"]).astype("int32"))
    tiles = cut.join(F.broadcast(table), ["p", "p1", "p2"]).groupBy((F.col("first") + F.pmod(F.xxhash64("fp"), F.col("chunks"))).cast("long").alias("tile")).agg(F.collect_list("fp").alias("fps"))

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, x in zip(batch["tile"], batch["fps"]):
                near = _partners(boxes, i, radius)
                for at in range(0, len(near), 16):
                    some = near[at : at + 16]
                    yield pd.DataFrame({"lo": np.minimum(i, some), "hi": np.maximum(i, some), "tile": i, "fps": [x] * len(some)})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sides = {t: np.asarray(f, np.int64).view(np.uint64) for t, f in zip(group["tile"], group["fps"])}
        lo, hi = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])
        if lo not in sides or hi not in sides:
            return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
        node, root = link_tiles(sides[lo], None if lo == hi else sides[hi], radius)
        return pd.DataFrame({"a": node.view(np.int64), "b": root.view(np.int64)})

    # a pair's cost is its comparisons, not its bytes, so the number of tasks follows the pairs
    number = sum(len(_partners(boxes, i, radius)) for i in range(len(boxes)))
    pairs = tiles.mapInPandas(pair, "lo long, hi long, tile long, fps array<long>").repartition(parts(spark, number, PAIRS), "lo", "hi")
    return pairs.groupBy("lo", "hi").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Texts are linked when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest doc_id that links
    reach. Null and empty texts have fingerprint 0 and are linked like others; equal fingerprints are one node, so copies never
    meet in pairs; repeated rows stay; a null doc_id never becomes a component_id unless its component has no other; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    marked = saved(fingerprints(docs, id_col, text_col))
    nodes = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(label, nodes.fp == label.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    top = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # so that a join with a large component can be split
    known = saved(rooted.select("fp", "root").join(top, "root").select("fp", "component_id"))
    return marked.join(known, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Query: near-duplicate components of all documents by 64-bit SimHash within 4 bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
