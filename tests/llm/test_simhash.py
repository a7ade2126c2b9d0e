import random

import numpy as np
import xxhash

from velloom.llm import simhash

DDL = "doc_id long, text string, fp string, root string"


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    ids, comp = [i for i, _ in rows], list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {}
    for c, i in zip(comp, ids):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, format(f, "016x"), least.get(c)) for i, f, c in zip(ids, fps, comp)), key=str)


def test_against_brute_force(spark, table):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 30, 200]))]
        rows.append((i * 3, " ".join(w)))
        if len(w) == 200:
            w[5] = "changed"
            rows.append((1000 - i, "\n".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \t"), (0, rows[0][1]), (None, rows[1][1]), (None, "lonely one"), (7, "\x85nbsp\xa0 WORD" + "y" * 70_000)]
    d = table([(i, t, "x", "y") for i, t in rows], DDL)
    got = sorted(map(tuple, simhash.op10_simhash(spark, d).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark, table):
    assert simhash.op10_simhash(spark, table([], DDL)).collect() == []


def test_tiles_keep_every_link_and_stay_small(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(60)]
    fps = np.unique(np.array([*near, *rng.integers(0, 2**63, 3000, dtype=np.uint64).tolist()], np.uint64))
    node, root = simhash.link_tiles(fps, None, 4)
    assert len(node) < len(fps)

    def classes(pairs):
        up = {int(f): int(f) for f in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = find(int(a)), find(int(b))
            up[max(a, b)] = min(a, b)
        return [find(int(f)) for f in fps]

    every = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)]
    assert classes(zip(node, root)) == classes(every)
    half = len(fps) // 2
    cut = [simhash.link_tiles(fps[:half], None, 4), simhash.link_tiles(fps[half:], None, 4), simhash.link_tiles(fps[:half], fps[half:], 4)]
    assert classes((a, b) for n, r in cut for a, b in zip(n, r)) == classes(every)
