"""Clusters, repeated bytes and the prefix trie against brute force, with edge cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import convtrie, kmeans, phrases

SCHEMA = "doc_id long, text string, key long, at long, doc string, spans string"


def documents(spark, rows):
    """Rows with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, 1, 2, "d", "s") for i, t in rows], SCHEMA).repartition(5)


def brute_bytes(rows, depth=100):
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            s = b[p : p + depth]
            if s in seen:
                gone[p : p + depth] = b"\1" * depth
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéfghüijk") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            x = rng.random()
            if x < 0.4:
                q = rng.choice(passages)
                parts.append(q[rng.randint(0, 30) : len(q) - rng.randint(0, 30)])
            elif x < 0.5:
                parts.append("ab" * rng.randint(30, 200))
            elif x < 0.55:
                parts.append("x" * rng.randint(90, 400))
            else:
                parts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 50))))
        rows.append((i, " ".join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 150, 7)]
    return [*rows, (5000, None), (5001, ""), (5002, "short"), (5003, " ".join(passages) * 40)]


@pytest.mark.parametrize("most, batch", [(2048, 4096), (5, 16)])
def test_repeated_bytes(spark, texts, monkeypatch, most, batch):
    """Parts of all sizes, split by bands and single windows where ``most`` is small."""
    monkeypatch.setattr(phrases, "BATCH", batch)
    got = phrases.repeated_bytes_digest(documents(spark, texts), max_segments=most).collect()
    assert sorted(map(tuple, got)) == brute_bytes(texts)


def test_repeated_bytes_of_clashing_ids(spark, texts):
    """A null id neither loses nor takes; one id with two texts is two documents; repeated rows are one, returned each."""
    long = texts[0][1] + texts[1][1] + "y" * 150
    rows = [(None, long), (None, long), (7, long), (7, long), (7, long + "z"), (8, long)]
    df = documents(spark, rows)
    marks = {r.text: r.m for r in df.select("text", F.xxhash64("text").alias("m")).collect()}
    first, second = sorted({long, long + "z"}, key=marks.get)
    want = {t: d[1:] for t, d in zip((first, second, "8"), brute_bytes([(0, first), (1, second), (2, long)]), strict=True)}
    alone = brute_bytes([(0, long)])[0][1:]
    got = sorted(map(tuple, phrases.repeated_bytes_digest(df).collect()), key=repr)
    assert got == sorted([(None, len(long.encode()), 0, 0, hashlib.sha256(long.encode()).hexdigest())] * 2 + [(7, *want[long])] * 2 + [(7, *want[long + "z"]), (8, *want["8"])], key=repr)
    assert alone[1] > 0
    out = phrases.remove_repeated_bytes(df)
    assert out.columns == ["doc_id", "key", "at", "doc", "spans", "n_bytes", "n_removed", "n_spans", "kept"] and out.count() == 6
    assert phrases.remove_repeated_bytes(df.where("false")).count() == 0


def test_every_window_has_a_trigger():
    """Segments cover each window once, and windows that are equal belong to triggers at equal distances."""
    rng = random.Random(1)
    a = bytes(rng.choice(b"abc") for _ in range(3000))
    data = np.frombuffer(a + a[500:900] + b"q" * 500, np.uint8)
    offsets = np.array([0, 3000, 3400, 3900])
    _, first, number, back = phrases.parse(data, offsets, 100)
    at = np.concatenate([np.arange(f, f + n) for f, n in zip(first, number, strict=True)])
    assert at.tolist() == [p for lo, hi in zip(offsets, offsets[1:], strict=False) for p in range(lo, hi - 99)]
    distance = dict(zip(at.tolist(), np.concatenate([np.arange(b, b - n, -1) for b, n in zip(back, number, strict=True)]).tolist(), strict=True))
    assert all(distance[3000 + i] == distance[500 + i] for i in range(301)) and max(distance.values()) <= 84 and min(distance.values()) >= 1


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    x = np.array([v for _, v in kept], dtype=object)
    c = [v for _, v in order[:k]]
    for r in range(rounds + 1):
        d = np.array([[sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c] for v in x.tolist()], dtype=object)
        own = d.argmin(axis=1)
        if r < rounds:
            c = [[s // int((own == j).sum()) for s in x[own == j].sum(axis=0)] if (own == j).any() else m for j, m in enumerate(c)]
    return [
        (i, int(own[n]), d[n, own[n]], sum(d[own == own[n], own[n]]), sum(d[range(len(own)), own]), hashlib.sha256(",".join(map(str, c[own[n]])).encode()).hexdigest())
        for n, (i, _) in enumerate(kept)
    ]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, x string").repartition(3)


@pytest.mark.parametrize("scale", [0.3, 900.0, 1e5])
def test_clusters(spark, scale):
    """Small, middling and 64-bit products; ties, repeated rows, null ids and vectors that take no part."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(220, 64)) * scale / 5 + rng.normal(size=(5, 64))[rng.integers(0, 5, 220)] * scale
    x = np.clip(x, -1.3e5, 1.3e5)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), *((500 + i, rows[9][1]) for i in range(90))]
    bad = [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [])]
    got = sorted(map(tuple, kmeans.cluster(vectors(spark, rows + bad), leaf=8).collect()), key=repr)
    assert got == sorted(brute_clusters(rows), key=repr)


def test_few_vectors(spark):
    one = [(3, [0.5] * 64), (4, [0.5] * 64)]
    assert sorted(map(tuple, kmeans.cluster(vectors(spark, one)).collect())) == brute_clusters(one)
    assert kmeans.cluster(vectors(spark, one).where("false")).count() == 0
    assert kmeans.cluster(vectors(spark, [(1, [3e5] * 64)])).count() == 0  # beyond 2**27 after scaling


def test_filtering_assigns_nodes_whole():
    """Far apart clusters: most vectors are never met one by one."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-4000, 4000, (6, 64))
    x = middle[rng.integers(0, 6, 5000)] + rng.integers(-60, 60, (5000, 64))
    tree, order = kmeans.Tree.of(x)
    owner, point_owner = tree.assign(middle)
    assert tree.counts[owner >= 0].sum() > 4000
    assert (point_owner == ((x[order][:, None, :] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def brute_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(k))))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    said = [f"tüxt {i}" * (i % 5) for i in range(12)]
    rows = []
    for c in range(-10, 90):
        if rng.random() < 0.2:
            continue
        for t in range(rng.choice([1, 2, 3, 8, 12, 40])):
            role = rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else "user"
            rows.append((c, rng.choice([t, t, t, None, t // 2]), role, rng.choice(said[:3]) if t < 6 else rng.choice([*said, None])))
    long = [(t, "u", rng.choice(said)) for t in range(60)]
    rows += [(c, *x) for c in range(1000, 1040) for x in long]
    rows += [(c, *x) for c in range(1060, 1070) for x in long[:50]]
    return [*rows, (None, 1, "a", "b"), (77777, None, None, None), *rows[:20]]


@pytest.mark.parametrize("most, batch", [(4096, 16384), (800, 300)])
def test_trie(spark, turns, monkeypatch, most, batch):
    """Classes refined in one task, and in rounds over all tasks; copies, ties, nulls, repeated rows."""
    monkeypatch.setattr(convtrie, "BATCH", batch)
    df = spark.createDataFrame([(*r, "m", 1) for r in turns], "conv_id long, turn long, role string, text string, m string, pos int").repartition(4)
    assert sorted(map(tuple, convtrie.prefix_trie(df, most=most).collect()), key=repr) == brute_trie(turns)


def test_trie_of_nothing_and_of_one(spark):
    kinds = "conv_id long, turn long, role string, text string"
    assert convtrie.prefix_trie(spark.createDataFrame([], kinds)).collect() == []
    one = [(5, 0, "u", "long " * 50_000), (5, 1, "a", "")]
    assert sorted(map(tuple, convtrie.prefix_trie(spark.createDataFrame(one, kinds)).collect()), key=repr) == brute_trie(one)
