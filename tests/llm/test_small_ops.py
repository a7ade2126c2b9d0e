"""Sharding, packing, token counts, mixing and audio against plain restatements of their contracts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from velloom.llm import audio, mixing, packing, sharding, token_counts, tokenizing

DDL = "doc_id long, text string, source string, size string, key string, rank string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "Straße", "l'été", "don't", "WE'RE", "x1y22", " nb", "日本語", "…", "<|endoftext|>", "á", "\x1c", "ΑΣ", "İ", "!!", "3.14", "İ.", "end.", "\u00e9t\u00e9!?", "e\u0301,", "<|x.", "a<|endoftext|>."]
    seps = [" ", "  ", "\n", " \n ", "\t", " ", "\r\n"]
    out = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.choice([1, 5, 40, 400]))) for _ in range(60)]
    return [*out, None, "", " ", "\n\n", "  lead", "trail  ", "b" * 5000, "word " * 9000, out[0], out[0], out[1]]


@pytest.fixture
def rows(texts):
    out = [(i, t, f"s{i % 5}" if i % 7 else None, "s", "k", "r") for i, t in enumerate(texts)]
    return [*out, out[3], (None, "no id here", "s1", "s", "k", "r")]


def test_sharding(spark, table, rows):
    rows = rows + [(1000 + i, "same text everywhere", "s0", "s", "k", "r") for i in range(300)]
    got = sharding.op3_sharding(spark, table(rows, DDL)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots, home, size = defaultdict(list), defaultdict(set), defaultdict(int)
    text = {i: t for i, t, *_ in rows}
    for r in got:
        slots[r.shard].append(r.slot)
        home[text[r.doc_id]].add(r.shard)
        size[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in home.values())
    assert sharding.op3_sharding(spark, table([], DDL)).collect() == []


def test_shards_are_near_equal(spark, table):
    rng = random.Random(4)
    got = sharding.op3_sharding(spark, table([(i, "y" * rng.randint(0, 800) + str(i)) for i in range(4000)], "doc_id long, text string")).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    assert len(size) == 8 and max(size.values()) < 1.01 * min(size.values())


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(5)
    sizes = sorted((rng.randint(1, 90) for _ in range(3000)), reverse=True)
    rooms, want = [], []
    for s in sizes:
        k = min((i for i, r in enumerate(rooms) if r >= s), key=lambda i: (rooms[i], i), default=None)
        if k is None:
            k = len(rooms)
            rooms.append(100)
        rooms[k] -= s
        want.append(k)
    assert sharding.best_fit(sizes, 100) == (want, len(rooms))


@pytest.mark.parametrize("name,words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_stretches_give_the_library_s_ids(texts, name, words):
    t = Tokenizer.from_file(tokenizing.vocabulary(name))
    code = tokenizing.Encoder(tokenizing.vocabulary(name), words)
    data = [(x or "").encode() for x in texts]
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in code.ids(data)] == want
    assert [np.frombuffer(code.ids([x])[0], "<u4").tolist() for x in data] == want


def test_packing(spark, table, rows):
    t = Tokenizer.from_file(tokenizing.vocabulary("word_bpe_49k.json"))
    got = packing.op4_packing(spark, table(rows, DDL)).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, *_ in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = defaultdict(int)
    for i, *_ in rows:
        copies[i] += 1
    for i, own in ids.items():
        want = [(s, len(own[s : s + 4096]), zlib.crc32(np.array(own[s : s + 4096], "<u4").tobytes()), len(own)) for s in range(0, len(own), 4096)]
        assert sorted(pieces[i]) == sorted(want * copies[i])
    assert set(pieces) == set(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) * 4096 < total + 2 * 4096
    assert packing.op4_packing(spark, table([], DDL)).collect() == []


def test_packer_bounds_and_choice():
    p = packing.Packer(0, 10, 2)
    for name, n in [("a", 6), ("b", 7), ("c", 3), ("d", 4), ("e", 8), ("f", 9)]:
        p.place((name, 0, b"", n), n)
        assert len(p.rooms) <= 2
    assert [x[0] for x in p.out] == ["b", "c", "a", "d"] and {x[0] for w in p.held.values() for x in w} == {"e", "f"}
    p.place(("g", 0, b"", 5), 5)
    assert p.out[-1][0] == "f"


def test_token_counts(spark, table, rows, tmp_path):
    t = Tokenizer.from_file(tokenizing.vocabulary("byte_bpe_50k.json"))
    want = sorted(((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x, *_ in rows), key=str)
    d = table(rows, DDL)
    assert sorted(map(tuple, token_counts.op7_token_counts(spark, d).collect()), key=str) == want
    docs, cache = spark.read.parquet(f"{d}/documents.parquet"), f"{tmp_path}/cache"
    token_counts.token_counts(docs.where("doc_id < 20"), cache)
    n = spark.read.parquet(cache).count()
    assert n == len({x or "" for i, x, *_ in rows if i is not None and i < 20})
    got = token_counts.token_counts(docs, cache).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted((x[:3] for x in want), key=str)
    assert spark.read.parquet(cache).count() == len({x or "" for _, x, *_ in rows})
    token_counts.token_counts(docs, cache)
    assert spark.read.parquet(cache).count() == len({x or "" for _, x, *_ in rows})
    assert token_counts.op7_token_counts(spark, table([], DDL)).collect() == []


def plain_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    of = defaultdict(int)
    for _, t, s, *_ in rows:
        of[s] += size(t)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = {s: weight[s] * sum(of.values()) / sum(weight.values()) for s in names}
    capped = set()
    while over := [s for s in names if s not in capped and target[s] > 3 * of[s]]:
        capped |= set(over)
        rest = sum(of.values()) - sum(3 * of[s] for s in capped)
        for s in names:
            target[s] = 3.0 * of[s] if s in capped else weight[s] * rest / sum(weight[x] for x in names if x not in capped)
    return size, of, target


def test_mixing(spark, table, rows):
    got = mixing.op9_mixing(spark, table(rows, DDL)).collect()
    size, of, target = plain_mix(rows)
    src = {i: s for i, t, s, *_ in rows}
    taken = defaultdict(int)
    assert sorted((str(r.doc_id), r.size, r.source_size) for r in got) == sorted((str(i), size(t), of[s]) for i, t, s, *_ in rows)
    for r in got:
        taken[src[r.doc_id]] += r.taken
        assert abs(r.target - target[src[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        assert r.first_position is None or 0 <= r.first_position <= 1
    assert all(abs(taken[s] - target[s]) <= 1 for s in of)
    again = mixing.op9_mixing(spark, table(rows[::-1], DDL)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert mixing.op9_mixing(spark, table([], DDL)).collect() == []


def test_mixing_against_its_sql(spark, table, rows):
    import duckdb

    rows = [(2000 + i, "w " * (i % 11), f"s{i % 9}", "s", "k", "r") for i in range(200)]
    d = table(rows, DDL)
    got = mixing.op9_mixing(spark, d)
    db = duckdb.connect()
    db.sql(f"create view documents as from '{d}/documents.parquet/*.parquet'")
    want = db.sql(mixing.oracle_sql())
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.select(*got.columns).fetchall(), key=str)


def test_curriculum_follows_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, cut=False)
    got = mixing.curriculum(mixed).collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r.position)
    for i, s in enumerate(sorted(by)):
        knots = mixing.SCHEDULES[i]
        n, t = len(by[s]), np.linspace(0, 1, 100_001)
        w = np.interp(t, *zip(*knots))
        done = np.cumsum(w) / w.sum()
        assert max(abs(np.interp(p, t, done) - k / n) for k, p in enumerate(sorted(by[s]))) < 2 / n
    assert {s: len(x) for s, x in by.items()} == {"s0": 150, "s1": 300, "s2": 450}


def test_audio(spark, table, rows):
    got = audio.op8_audio(spark, table(rows, DDL)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        p = (t or "").encode()
        q = p + b"\xff" * ((-len(p)) % 576 or (0 if p else 576))
        want.append((str(i), len(p), len(q), hashlib.sha256(q).hexdigest(), zlib.crc32(q[-32:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    by = defaultdict(set)
    for r in got:
        by[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values())
    assert audio.op8_audio(spark, table([], DDL)).collect() == []


def test_audio_parts():
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(48_000) / audio.RATE)).astype(np.uint8)
    tone[:12_000] = tone[36_000:] = 128
    mel, level = audio.log_mel(tone.tobytes())
    (a, b), *more = audio.segments(level)
    assert not more and abs(a * audio.HOP / audio.OUT_RATE - 0.5) < 0.03 and abs(b * audio.HOP / audio.OUT_RATE - 1.5) < 0.03
    centres = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 42)[1:-1] / 2595) - 1)
    assert abs(centres[mel[100].argmax()] - 1000) < 120
    x = np.random.default_rng(0).normal(size=3001).astype(np.float32)
    up = np.zeros(3001 * 2)
    up[::2] = x
    full = np.convolve(up, audio.phases()[:, ::-1].T.reshape(-1))[::3]
    assert np.abs(audio.resample(x, 0, 2000) - full[:2000]).max() < 1e-4
    assert np.abs(audio.resample(x, 500, 700) - full[500:1200]).max() < 1e-4
    frames, tensors, spans, _ = audio.features(tone.tobytes())
    assert tensors.shape == (len(spans), audio.STEPS, audio.MELS) and (tensors.reshape(-1, audio.MELS)[:frames] == mel).all()
    stored = audio.read_tensors(audio.write_tensors(tensors, spans))
    assert stored.schema.field("mel").type.shape == [audio.STEPS, audio.MELS] and stored.select(["start", "stop"]).to_pylist() == spans
    assert (stored["mel"].combine_chunks().to_numpy_ndarray() == tensors).all()


def slow_audio(data):
    """Features by their definitions, one value at a time in double precision: frames, log-mel rows, levels."""
    x = [b / 128 - 1 for b in data]
    n = 32
    taps = [np.sinc((t - 15.5) / 3) * (0.5 - 0.5 * np.cos(2 * np.pi * (t + 1) / (n + 1))) for t in range(n)]
    taps = [2 * t / sum(taps) for t in taps]
    # two samples for each three: zeros between, filtered, every third kept
    y, frames = [], max(1, 1 + -(-(-(-len(x) * 2 // 3) - 400) // 160))
    for m in range((frames - 1) * 160 + 400):  # the filter rings on after the last sample
        at = 3 * m
        y.append(sum(taps[k] * x[(at - k) // 2] for k in range(n) if (at - k) % 2 == 0 and 0 <= (at - k) // 2 < len(x)))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(8000) * i / 41 / 2595) - 1) for i in range(42)]
    rows, levels = [], []
    for a in range(0, frames * 160, 160):
        cut = [y[a + k] * (0.5 - 0.5 * np.cos(2 * np.pi * k / 399)) for k in range(400)]
        power = [abs(sum(c * np.exp(-2j * np.pi * f * k / 512) for k, c in enumerate(cut))) ** 2 for f in range(257)]
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
            tri = [max(0, min((f * 8000 / 256 - lo) / (mid - lo), (hi - f * 8000 / 256) / (hi - mid))) for f in range(257)]
            row.append(np.log(max(1e-10, sum(p * t for p, t in zip(power, tri)))))
        rows.append(row)
        levels.append(10 * np.log10(max(1e-10, sum(c * c for c in cut) / 400)))
    return rows, levels


def slow_segments(levels):
    mean, on, out = sum(levels) / len(levels), False, []
    for i, v in enumerate(levels):
        if not on and v > mean + audio.OPEN_DB:
            on = True
            out.append([i, len(levels)])
        elif on and v < mean + audio.KEEP_DB:
            on = False
            out[-1][1] = i
    return [tuple(x) for x in out]


def test_features_by_their_definitions(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh .\nüß") * rng.randint(1, 60) for _ in range(60))[:1100]
    row = audio.audio(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    rows, levels = slow_audio(bytes(row.payload))
    stored = audio.read_tensors(bytes(row.tensors))
    got = stored["mel"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
    assert row.frames == len(rows) and np.abs(got[: len(rows)] - np.array(rows)).max() < 2e-2 and not got[len(rows) :].any()
    second = audio.HOP / audio.OUT_RATE
    assert [(round(s.start / second), round(s.stop / second)) for s in row.segments] == slow_segments(levels)
    assert [(s.start, s.stop) for s in row.spans] == [tuple(x.values()) for x in stored.select(["start", "stop"]).to_pylist()]
