import random

import numpy as np

from velloom.llm import embeddings

DDL = "vec_id long, embedding array<float>, label int, key string, v string"


def brute(rows):
    ok = [i for i, r in enumerate(rows) if r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])]
    comp, links, n_pairs = list(range(len(rows))), [0] * len(rows), 0
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[a] += 1
                n_pairs += 1
    done = False
    near = {a: [b for b in ok if b != a and len(rows[a][1]) == len(rows[b][1]) and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= 0.9] for a in ok}
    while not done:
        done = True
        for a in ok:
            for b in near[a]:
                m = min(comp[a], comp[b])
                if comp[a] != m or comp[b] != m:
                    comp[a] = comp[b] = m
                    done = False
    least = {}
    for i, c in enumerate(comp):
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted((r[0], n, least[c], r[0] == least[c]) for r, n, c in zip(rows, links, comp))


def test_against_brute_force(spark, table):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((centre + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])).astype(np.float32).tolist())
    rows += [rows[0]] * 5 + [[2 * c for c in rows[3]], [0.0] * 16, [], None, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 0.0], [1.0, 0.01], [1e30] * 16, [-1e-30] * 16]
    ids = list(range(len(rows)))
    random.Random(2).shuffle(ids)
    rows = [(i, v, 0, "k", "v") for i, v in zip(ids, rows)]
    got = sorted(map(tuple, embeddings.op6_embeddings(spark, table(rows, DDL, "embeddings")).collect()))
    assert got == brute(rows)
    assert embeddings.op6_embeddings(spark, table([], DDL, "embeddings")).collect() == []


def test_large_group_and_recall(spark):
    rng = np.random.default_rng(3)
    far = rng.normal(size=(3000, 64))
    centre = rng.normal(size=64)
    group = centre + rng.normal(size=(1300, 64)) * 0.12
    pairs = rng.normal(size=(500, 64))
    twins = pairs + rng.normal(size=pairs.shape) * 0.43
    x = np.concatenate([far, group, pairs, twins]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all()
    assert (found[3000:4300] == want[3000:4300]).all() and want[3000:4300].min() > 1000
    near = want[4300:] > 0
    assert near.sum() > 300 and (found[4300:][near] > 0).mean() >= 0.9


def test_any_number_of_ranges_gives_the_same(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(700, 12)), rng.normal(size=12) + rng.normal(size=(300, 12)) * 0.35]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    # few neighbours and one lot of passes, so that what is found depends on the order alone
    found = []
    for n, rows in ((1, 100_000), (5, 100_000), (60, 20), (8, 300)):
        monkeypatch.setattr(embeddings, "RANGE", rows)
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = embeddings.near_vectors(df.repartition(n), passes=2, neighbours=30, recall=0.0)
            found.append(sorted(map(tuple, got.collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert found[0] == found[1] == found[2] == found[3] and sum(r[1] > 0 for r in found[0]) > 50


def test_passes_go_on_in_a_crowd(spark):
    """A third of the rows in one cone without links but for planted pairs: the estimate asks for more passes there."""
    rng = np.random.default_rng(9)
    near = lambda v: v + rng.normal(size=v.shape) * 0.42 * np.linalg.norm(v, axis=1, keepdims=True) / 8
    far, axis = rng.normal(size=(6000, 64)), rng.normal(size=64) * 1.25
    cone = axis + rng.normal(size=(3000, 64))
    x = np.concatenate([far, cone, near(far[:300]), near(cone[:300])]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df, neighbours=48).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and want[9300:].sum() > 100
    assert found[:6000].sum() >= 0.95 * want[:6000].sum() and found[6000:].sum() >= 0.9 * want[6000:].sum()


def test_against_its_sql(spark, table):
    import duckdb

    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(size=(6, 16)) * 0.2 for c in rng.normal(size=(30, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), 0, "k", "v") for i, v in enumerate(x)] + [(500, None, 0, "k", "v"), (501, [0.0] * 16, 0, "k", "v"), (502, x[0].tolist(), 0, "k", "v")]
    d = table(rows, DDL, "embeddings")
    got = embeddings.op6_embeddings(spark, d)
    db = duckdb.connect()
    db.sql(f"create view embeddings as from '{d}/embeddings.parquet/*.parquet'")
    want = db.sql(embeddings.oracle_sql())
    assert sorted(map(tuple, got.collect())) == sorted(want.select(*got.columns).fetchall())
