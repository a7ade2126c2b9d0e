import random
from collections import Counter, defaultdict

import corpus_pipeline
from test_toxicity import corpus

from velloom.llm import mixing, pii, simhash


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus(900, 7)
    rng = random.Random(8)
    card = "4111111111111111"
    docs = [(i, t + (f" {card}" if i % 9 == 0 else ""), "en", f"s{rng.randrange(4)}" if i % 50 else None, len(t)) for i, t, *_ in rows]
    docs += [(2000 + i, docs[i][1], "en", "s0", 1) for i in range(0, 300, 3)] + [docs[5], docs[5], (3000, None, None, "s1", None), (3001, "", "en", "s2", 0)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = [sorted(map(tuple, now.collect()), key=str)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(sorted(map(tuple, now.collect()), key=str))
    assert all(spark.read.parquet(f"{tmp_path}/{n}").columns == ["doc_id", "text", "lang", "source", "n_chars"] for n, _ in corpus_pipeline.STAGES[:-1])
    y = dict((i, t) for i, _, t in labels)
    kept = {r[0] for r in out[1]}
    assert not Counter(out[1]) - Counter(out[0])
    assert sum(i in kept for i, t in y.items() if not t) > 0.97 * sum(not t for t in y.values()) and sum(i in kept for i, t in y.items() if t) < 0.2 * sum(y.values())
    fp = {r[0]: simhash.fingerprint((r[1] or "").encode()) for r in out[1]}
    comp = {i: i for i in fp}
    for _ in range(5):
        for i in fp:
            comp[i] = min(comp[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4)
    assert [r[0] for r in sorted(out[2])] == sorted({c for i, c in comp.items() if i == c}) and not set(out[2]) - set(out[1])
    cipher = pii.Cipher(pii.KEY)
    assert out[3] == sorted(((i, t if t is None else pii.pseudonymise(t, cipher)[0], a, b, n) for i, t, a, b, n in out[2]), key=str) and card not in str(out[3])
    copies, size, words = Counter(r[0] for r in out[4]), defaultdict(int), defaultdict(int)
    assert set(out[4]) <= set(out[3]) and max(copies.values()) <= 3
    for r in out[3]:
        size[r[3]] += len((r[1] or "").encode().split())
    for r in out[4]:
        words[r[3]] += len((r[1] or "").encode().split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for s, target in zip(names, mixing.shares([size[s] for s in names], [mixing.by_rank(i) for i in range(len(names))])):
        assert abs(words[s] - target) <= 121
    assert sum(r[2] == r[4] for r in out[5]) == sum(copies.values())


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_duplicates_by_row(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    t = [" ".join(word() for _ in range(60)) for _ in range(8)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (7, t[4]), (1, t[5]), (9, t[5]), (9, t[6]), (None, t[7]), (4, t[7]), (4, t[7])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/rows")
    got = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/rows"), str(tmp_path))
    want = [(None, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (7, t[4]), (1, t[5]), (9, t[6]), (4, t[7])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_clashing_columns_and_repeated_ids(spark, tmp_path):
    rows, labels = corpus(300, 11)
    names = ["doc_id", "text", "source", "position", "mix_row", "stays", "row_of_id", "spans", "row", "score", "predicted", "c0", "dup_row"]
    docs = [(i % 120 if i % 7 else None, t, f"s{i % 3}", i, str(i), i / 2, i, [i], i, 0.0, i, "c", i) for i, t, *_ in rows]
    docs += [(1, None, None, None, None, None, None, None, None, None, None, None, None)] * 2
    ddl = "doc_id long, text string, source string, position long, mix_row string, stays double, row_of_id long, spans array<long>, row long, score double, predicted long, c0 string, dup_row long"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.createDataFrame(docs, ddl).repartition(5)
    before = Counter(map(str, now.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == names, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        after = Counter(map(str, now.collect()))
        if name != "mixing":
            assert not after - before, name
        assert set(after) <= set(before) and after, name
        before = after
    assert corpus_pipeline.pack_windows(spark, now, str(tmp_path)).select("doc_id").count() == sum(before.values())
