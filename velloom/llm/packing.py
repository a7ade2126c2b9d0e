"""Bounded-space online packing of token ids into fixed windows."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, utf8
from .sharding import best_fit
from .tokenizing import MEMO, encoder, vocabulary

WINDOW, OPEN, END = 4096, 32, 2
#: Partitions whose leftover windows are merged together; ids in one go of the encoder, in bytes of text.
FAN_IN, AT_ONCE = 8, 4_000_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


class Packer:
    """A fixed number of open windows. A piece enters the one it fills best; when none has room the fullest one is emitted."""

    def __init__(self, first_id: int, window: int, open_: int):
        self.next, self.window, self.most = first_id, window, open_
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.held: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def place(self, piece: tuple, length: int) -> None:
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, w = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.most:
                self.emit(self.rooms.pop(0)[1])
            room, w = self.window, self.next
            self.next += 1
            self.held[w] = []
        self.held[w].append((*piece, w, self.window - room))
        if room > length:
            insort(self.rooms, (room - length, w))
        else:
            self.emit(w)

    def emit(self, w: int) -> None:
        self.out += self.held.pop(w)


def _rows(pieces: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    """pieces: (doc_id, start, ids, doc_tokens, sequence, offset)."""
    rows = [(d, s, len(i) // 4, zlib.crc32(i), t, w, o, i if keep_ids else None) for d, s, i, t, w, o in pieces]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN, end_id: int = END, path: str | None = None, memo: int = MEMO) -> DataFrame:
    """Pieces of ``docs`` in sequences of at most ``window`` ids: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids and ``end_id``; whole windows are cut off its front and the rest stays in one piece. Each partition keeps
    ``open_windows`` windows open and puts a piece where the least room is left; when no window has room it emits the fullest. What
    is left open at a partition's end is packed again, largest piece first, together with FAN_IN - 1 other partitions' leftovers, so
    a task's memory depends on these parameters alone. ``memo`` is how many words a worker remembers the ids of: it saves time only.

    A null text is an empty one: its only id is ``end_id``. Repeated rows are packed each on their own; a null doc_id is kept; an
    empty table gives an empty result; other columns are ignored.
    """
    path = path or vocabulary("word_bpe_49k.json")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, code, end = Packer(part << 32, window, open_windows), encoder(path, True, memo), end_id.to_bytes(4, "little")
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            at = 0
            while at < len(names):
                some, n = [], 0
                while at + len(some) < len(names) and n < AT_ONCE:
                    some.append(next(texts))
                    n += len(some[-1])
                for name, ids in zip(names[at:], code.ids(some)):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        packer.place((name, start, piece, total), len(piece) // 4)
                at += len(some)
                if packer.out:
                    yield _rows(packer.out, False)
                    packer.out = []
        left = [x for w in packer.held.values() for x in w]
        for i in range(0, len(left), 1000):
            yield _rows(left[i : i + 1000], True)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
        bins, _ = best_fit(pdf["length"].tolist(), window)
        pdf["sequence_id"] = pd.Series(bins, pdf.index, dtype="int64") + (1 << 62) + (int(pdf["lot"].iloc[0]) << 32)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[[x.split()[0] for x in PIECE.split(", ")]]

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = saved(picked.mapInArrow(local, PIECE + ", ids binary"))
    lots = first.where("ids is not null").withColumn("lot", F.shiftright("sequence_id", 32 + FAN_IN.bit_length() - 1))
    merged = lots.drop("ids").groupBy("lot").applyInPandas(merge, PIECE)
    return first.where("ids is null").drop("ids").unionByName(merged)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Query: all documents packed into sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
