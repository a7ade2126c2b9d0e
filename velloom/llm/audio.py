"""Audio features: polyphase resampling, log-mel filterbanks and energy segments, as fixed-shape tensors with time spans."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import utf8

BLOCK, PAD = 576, 255
RATE, UP, DOWN, TAPS = 24_000, 2, 3, 16
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, FFT, MELS = 400, 160, 512, 40
#: Frames of a tensor; frames of one go; decibels above a recording's mean that open a segment, and that keep it open.
STEPS, AT_ONCE, OPEN_DB, KEEP_DB = 64, 4096, 1.0, -0.5
AT_MOST = 8_000_000
SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, frames long, tensors binary, spans array<struct<start:double,stop:double>>, segments array<struct<start:double,stop:double>>"


def write_wav(samples: bytes) -> bytes:
    """8-bit unsigned mono PCM in a RIFF container; every byte is kept."""
    odd = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def read_wav(media: bytes) -> bytes:
    """The samples of a RIFF file with 8-bit mono PCM."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and struct.unpack_from("<HH", media, at + 8) + struct.unpack_from("<H", media, at + 22) != (1, 1, 8):
            raise ValueError("not 8-bit mono PCM")
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def payload(text: bytes) -> bytes:
    """The text's bytes, filled up to a positive multiple of 576 with bytes 255."""
    return text + bytes([PAD]) * (-len(text) % BLOCK or (BLOCK if not text else 0))


@cache
def phases() -> np.ndarray:
    """The low-pass prototype (Hann-windowed sinc) split into UP phases of TAPS taps, newest sample last."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hanning(n + 2)[1:-1]
    return np.ascontiguousarray((h / h.sum() * UP).reshape(TAPS, UP).T[:, ::-1], np.float32)


def resample(x: np.ndarray, first: int, n: int) -> np.ndarray:
    """Outputs ``first`` .. ``first + n`` (``first`` a multiple of UP) of the samples ``x`` at UP/DOWN of their rate; zeros beyond the ends."""
    out = np.empty(n, np.float32)
    for q in range(UP):
        m = len(range(q, n, UP))
        start = (first + q) * DOWN // UP - TAPS + 1
        stop = start + (m - 1) * DOWN + TAPS if m else start
        part = x[max(0, start) : max(0, stop)].astype(np.float32)
        part = np.pad(part, (max(0, -start) if stop > 0 else 0, 0))
        part = np.pad(part, (0, max(0, stop - start - len(part))))
        if m:
            out[q::UP] = np.lib.stride_tricks.sliding_window_view(part, TAPS)[::DOWN][:m] @ phases()[(first + q) * DOWN % UP]
    return out


@cache
def filterbank() -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as (FFT // 2 + 1, MELS)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, OUT_RATE / 2, FFT // 2 + 1)[:, None]
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1]))).astype(np.float32)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) natural logarithms of mel energies, and each frame's energy in decibels. Memory beyond the result is bounded."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) / np.float32(128) - np.float32(1)
    n = -(-len(x) * UP // DOWN)
    frames = max(1, 1 + -(-(n - FRAME) // HOP))
    mel, level, window = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32), np.hanning(FRAME).astype(np.float32)
    for at in range(0, frames, AT_ONCE):
        k = min(AT_ONCE, frames - at)
        y = resample(x, at * HOP, (k - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * window
        spectrum = np.fft.rfft(cut, FFT)
        mel[at : at + k] = np.log(np.maximum((spectrum.real**2 + spectrum.imag**2) @ filterbank(), np.float32(1e-10)))
        level[at : at + k] = 10 * np.log10(np.maximum((cut * cut).mean(axis=1), np.float32(1e-10)))
    return mel, level


def segments(level: np.ndarray) -> list[tuple[int, int]]:
    """Half-open frame ranges: one opens OPEN_DB above the mean level and lasts while the level stays above KEEP_DB of it."""
    mean = float(level.mean())
    mark = np.where(level > mean + OPEN_DB, 1, np.where(level < mean + KEEP_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[0], ((last >= 0) & (mark[last] == 1)).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(on))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def features(samples: bytes) -> tuple[int, np.ndarray, list[dict], list[dict]]:
    """Frames, the tensors (windows, STEPS, MELS; the last one filled with zeros), their time spans and the segments in seconds."""
    mel, level = log_mel(samples)
    windows = -(-len(mel) // STEPS)
    tensors = np.zeros((windows * STEPS, MELS), np.float32)
    tensors[: len(mel)] = mel
    second = HOP / OUT_RATE
    spans = [{"start": i * STEPS * second, "stop": min(len(mel), (i + 1) * STEPS) * second} for i in range(windows)]
    return len(mel), tensors.reshape(windows, STEPS, MELS), spans, [{"start": a * second, "stop": b * second} for a, b in segments(level)]


@cache
def tensor_schema() -> pa.Schema:
    return pa.schema([("mel", pa.fixed_shape_tensor(pa.float32(), (STEPS, MELS))), ("start", pa.float64()), ("stop", pa.float64())])


def write_tensors(tensors: np.ndarray, spans: list[dict]) -> bytes:
    """Windows and their time spans as an Arrow stream of fixed-shape tensors."""
    schema = tensor_schema()
    values = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), STEPS * MELS)
    columns = [pa.ExtensionArray.from_storage(schema.field("mel").type, values), *(pa.array([x[k] for x in spans], pa.float64()) for k in ("start", "stop"))]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as stream:
        stream.write_batch(pa.record_batch(columns, schema=schema))
    return out.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """The windows of a recording: mel (fixed-shape tensors), start, stop."""
    return pa.ipc.open_stream(stored).read_all()


def audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One recording for each row: the text's bytes as 8-bit samples in ``media``, the samples read back from it in ``payload``.

    ``tensors`` is an Arrow stream whose rows are a recording's windows: log-mel values of shape (STEPS, MELS) in Arrow's fixed-shape
    tensor type, and their time spans in seconds, which ``spans`` repeats; ``read_tensors`` opens it, as any Arrow reader does.
    ``segments`` are the stretches of high energy.
    Null and empty texts are one block of fill; repeated rows are repeated; a null doc_id is kept; an empty table gives an empty
    result; other columns are ignored. Results go out in lots of about AT_MOST bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()] + [pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))] * 2
        names = ["doc_id", "n_bytes", "media", "payload", "frames", "tensors", "spans", "segments"]
        out, held = [], 0
        done = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                media = write_wav(payload(text))
                back = read_wav(media)
                frames, tensors, spans, parts = features(back)
                out.append((name, len(text), media, back, frames, write_tensors(tensors, spans), spans, parts))
                held += 4 * len(media)
                if held > AT_MOST:
                    yield done()
                    out, held = [], 0
        if out:
            yield done()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op8_audio(spark, sf_dir: str) -> DataFrame:
    """Query: digests of the stored recording and features of every document."""
    made = audio(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("payload")
    return made.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.concat(F.col("frames").cast("string"), F.lit(f"x{MELS}")), F.size("spans").cast("string"), F.size("segments").cast("string"), F.md5("tensors")).alias("feature"),
    )
