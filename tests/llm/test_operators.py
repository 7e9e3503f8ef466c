"""Pipeline operators against brute force, exact round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmill.llm import decontam, jaccard, langid, licenses, neighbours, packing, quality, shards, substrings, toxicity
from quillmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, key string"


def table(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, "m", "k") for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 6, 40, 120, 300]))] for _ in range(40)]
    passage = [rng.choice(words) for _ in range(70)]
    texts = []
    for w in base:
        texts.append(" ".join(w))
        for _ in range(rng.randrange(3)):
            copy = w.copy()
            for _ in range(rng.randrange(len(w) // 20 + 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("\n".join(copy))
    texts += [" ".join(base[0] + passage + base[1]), " ".join(base[2] + passage), None, "", " \t\n", "One", "one", texts[0], texts[0]]
    return texts


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles_of(text):
    w = [x.lower() for x in words_of(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts, num=80, den=100):
    """(set size, smallest place of the component) of each text."""
    sets = [shingles_of(t) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_jaccard_groups_stream_over_batches():
    """First and previous members do not depend on where batches end; salted groups are returned whole."""
    rng = np.random.default_rng(4)
    rows = sorted({(int(k), int(k % 3 == 0) * int(s), int(c)) for k, s, c in zip(rng.integers(0, 30, 200), rng.integers(1, 4, 200), rng.integers(0, 50, 200), strict=True)})
    rows = sorted(rows + rows[:20])
    expected = []
    for key, salt in sorted({r[:2] for r in rows}):
        members = sorted({r[2] for r in rows if r[:2] == (key, salt)})
        if salt or len(members) > 1:
            expected += [(key, salt, c, members[0], members[max(0, i - 1)]) for i, c in enumerate(members)]
    for size in (1, 2, 7, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a : a + size]], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["key", "salt", "cls"]) for a in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in jaccard._groups(iter(batches)) for x in b.to_pylist()]
        assert got == expected


def test_jaccard_join_of_a_common_group(spark):
    """Near copies of one text, whose shingles are all frequent, and whose pieces are salted."""
    rng = random.Random(17)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = base.copy()
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(60)] = f"x{rng.randrange(20)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, texts)).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("num", [80, 20, 55, 100])
def test_jaccard_join_is_exact(spark, corpus, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, corpus), threshold=(num, 100)).collect()}
    assert got == brute_components(corpus, num)


def test_jaccard_pieces_lose_no_link():
    """Linked sets share a piece at any threshold, whatever shingles count as frequent."""
    rng = np.random.default_rng(5)
    for num in (20, 50, 80, 95):
        for _ in range(40):
            n = int(rng.integers(1, 300))
            found = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            apart = int(rng.integers(0, jaccard._links_bound(n, n, num, 100) + 1))
            keep = found[rng.permutation(n)[: max(1, n - apart // 2)]]
            other = np.unique(np.append(keep, rng.integers(0, 2**63, apart // 2, dtype=np.uint64)))
            both = len(np.intersect1d(found, other))
            if 100 * both < num * (n + len(other) - both):
                continue
            hot = np.sort(rng.permutation(found)[: n // 2])
            (a, common), (b, _) = (jaccard.piece_keys(x, hot, jaccard._bands(1 << 20), num, 100) for x in (found, other))
            assert len(np.intersect1d(a, b)) and len(common) == len(a)


def test_jaccard_defined_cases(spark, monkeypatch):
    """Empty tables, null ids, repeated rows, very long texts; sets that fall on one class id stay apart."""
    assert jaccard.jaccard_components(table(spark, [])).count() == 0
    assert jaccard.jaccard_components(table(spark, [None, "", " "])).where("component_id = doc_id and n_shingles = 0").count() == 3
    long = " ".join(f"x{i % 50_021}" for i in range(60_000))
    texts = ["a b c d e f", "a b c d e f", "A B c d e f", long, long + " end", "a b c d e f"]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, texts, [4, 4, 2, 7, 9, None])).collect())
    assert got == sorted([("4", 2, 2), ("4", 2, 2), ("2", 2, 2), ("None", 2, 2), ("7", 50_021, 7), ("9", 50_022, 7)])
    assert jaccard._told_apart(5, np.arange(3, dtype=np.uint64), frozenset()) == 5
    one, two = (jaccard._told_apart(5, np.arange(n, dtype=np.uint64), frozenset({5})) for n in (3, 4))
    assert one != two and one == jaccard._mixed(5, jaccard._second_id(np.arange(3, dtype=np.uint64)))


def test_jaccard_open_blocks_do_not_change_pairs(spark):
    """A home is compared as one block or as many, with the same pairs."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 90, dtype=np.uint64)
    rows, members = [], []
    for i in range(60):
        found = np.unique(np.concatenate([base[rng.random(90) > 0.12], rng.integers(0, 2**63, 6, dtype=np.uint64)]))
        rows.append((i, bytearray(found.tobytes()), len(found), bytearray(jaccard.parity_sketch(found).tobytes())))
        members.append((7, i, i))
    sets = spark.createDataFrame(rows, "cls long, found binary, n long, sketch binary")
    homes = spark.createDataFrame(members, "home long, cls long, label long")
    one, many = ({(r.a, r.b) for r in jaccard.open_pairs(homes, sets, 80, 100, block).collect()} for block in (1000, 7))
    assert one == many and one
    full = [np.frombuffer(r[1], np.uint64) for r in rows]
    linked = {(i, j) for j in range(60) for i in range(j) if 100 * (x := len(np.intersect1d(full[i], full[j]))) >= 80 * (len(full[i]) + len(full[j]) - x)}
    assert linked <= one


def test_components_of_chains(spark):
    rng = random.Random(2)
    names = rng.sample(range(10_000), 120)
    edges = [(names[i], names[i + 1]) for i in range(79)] + [(names[i], names[80]) for i in range(81, 120)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(names[:80]) for x in names[:80]} | {x: min(names[80:]) for x in names[80:]}


@pytest.mark.parametrize("max_segments", [4096, 1, 3])
def test_substring_dedup_is_exact(spark, corpus, max_segments):
    lists, first = [words_of(t) for t in corpus], {}
    for i, w in enumerate(lists):
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    expected = {}
    for i, w in enumerate(lists):
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        expected[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeat_digest(table(spark, corpus), max_segments=max_segments).collect()}
    assert got == expected and any(n for _, n, _ in expected.values())
    whole = substrings.remove_repeats(table(spark, corpus))
    assert {"lang", "mark", "key", "kept"} <= set(whole.columns) and whole.count() == len(corpus)
    assert substrings.repeat_digest(table(spark, [texts := corpus[0]], [None])).first().n_removed == 0 and texts


def test_suffix_ranks_sort_suffixes_by_words():
    rng = random.Random(12)
    for depth in (1, 2, 5, 8, 50):
        sizes = [rng.randrange(1, 90) for _ in range(12)]
        ids = np.array([rng.randrange(3) for _ in range(sum(sizes))])
        ends = np.repeat(np.cumsum(sizes), sizes)
        ranks = substrings.suffix_ranks(ids, ends, depth)
        plain = [tuple(ids[p : min(p + depth, ends[p])]) for p in range(len(ids))]
        places = {x: i for i, x in enumerate(sorted(set(plain)))}
        dense = np.unique(ranks, return_inverse=True)[1]
        assert [places[x] for x in plain] == dense.tolist()


def test_substring_dedup_defined_cases(spark):
    """Repeated rows, null and clashing columns, very long and empty texts, empty tables."""
    rng = random.Random(14)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(60))
    long = " ".join(f"x{i % 70_001}" for i in range(120_000))
    rows = [(1, passage + " a", "k"), (1, passage + " a", "k"), (1, "b " + passage, "k"), (2, "c " + passage + " d", None), (None, passage, "k"), (3, None, "k"), (4, "", "k"), (5, long, "k"), (6, long + " " + passage, "k")]
    schema = "doc_id long, text string, kept string"
    frame = spark.createDataFrame(rows, schema)
    for name in ("spans", "_id", "_mark", "at_id", "mark", "n_words", "n_removed", "c0", "text_mark"):
        frame = frame.withColumn(name, F.lit(1))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame).collect())
    whole = lambda i, t: (str(i), len(t.split()), 0, t)
    assert got == sorted([
        whole(1, passage + " a"), whole(1, passage + " a"), whole(1, "b " + passage), ("2", 62, 60, "c d"), whole(None, passage), ("3", 0, 0, ""), ("4", 0, 0, ""),
        whole(5, long), ("6", 120_060, 120_060, ""),
    ])
    assert set(substrings.remove_repeats(frame).columns) == (set(frame.columns) - {"text"})
    assert substrings.repeat_digest(frame.limit(0)).count() == 0 and substrings.repeat_digest(spark.createDataFrame([(1, "few words")], "doc_id int, text string")).first().n_removed == 0


def naive_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


def test_packing_plan_equals_piecewise_best_fit():
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([8, 30, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(90))]
        rooms, taken = defaultdict(lambda: capacity), Counter()
        for length, _, number, first, offset in packing.plan(dict(Counter(lengths)), capacity):
            taken[length] += number
            for s in range(first, first + number):
                assert offset == capacity - rooms[s]
                rooms[s] -= length
        assert taken == Counter(lengths) and sorted(rooms.values()) == naive_best_fit(lengths, capacity)


def test_packing_round_trip(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    odd = ["It's DON'T 'S q'", "A<|endoftext|>b <|STARTOFTEXT|>", "a\x01b \x01", "é, ½ a≠b x y İ", "###a_b-c...d 12,34", "日本語,です。👍🏽!", "a" * 3000 + "!" * 2000, None]
    texts = corpus + odd
    plain = tokenizers.Tokenizer.from_file(path)
    expected = {}
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for n, a in enumerate(range(0, len(ids), 64)):
            expected[i, n] = (a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes()))
    rows = packing.pack_documents(table(spark, texts), path, capacity=64).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) == len(naive_best_fit([r.length for r in rows], 64))
    assert packing.pack_documents(table(spark, []), path).count() == 0


def test_schedule_equals_a_plain_heap():
    for seed in range(200):
        rng = random.Random(seed)
        shards_, sizes = rng.choice([1, 2, 5, 16]), sorted({rng.randint(1, 5000) for _ in range(rng.randrange(12))}, reverse=True)
        histogram = [(s, rng.choice([1, 3, 70, 400])) for s in sizes]
        loads, plain = [0] * shards_, Counter()
        for size, number in histogram:
            for _ in range(number):
                shard = loads.index(min(loads))
                loads[shard] += size
                plain[size, shard] += 1
        got, ranks = Counter(), Counter()
        runs = list(shards.schedule(histogram, shards_))
        for (size, rank, shard), after in zip(runs, [*runs[1:], None][: len(runs)], strict=True):
            n = (after[1] if after and after[0] == size else dict(histogram)[size]) - rank
            assert rank == ranks[size]
            ranks[size] += n
            got[size, shard] += n
        assert got == plain


def test_shards(spark, corpus):
    rows = shards.shard_documents(table(spark, corpus), shards=4).collect()
    body = [(t or "").encode() for t in corpus]
    groups, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        assert (r.size, r.text_crc32) == (len(body[r.doc_id]) + 1, zlib.crc32(body[r.doc_id]))
        groups[body[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert len(rows) == len(corpus) and all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter(b for b in body)
    naive = [0] * 4
    for x in sorted((n * (len(b) + 1) for b, n in sizes.items()), reverse=True):
        naive[naive.index(min(naive))] += x
    assert sorted(loads.values()) == sorted(naive)
    assert shards.shard_documents(table(spark, [])).count() == 0


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:140] = x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9020, [1.0, None] + [0.0] * 14), (9040, [1.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    rows = neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), k=10, block=700, query_block=64).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    recall = []
    for q, found in got.items():
        score = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(3000), -score))[:10]
        assert all(abs(s - score[i]) < 1e-12 for i, s in found) and q not in dict(found)
        recall.append(len(set(best.tolist()) & {i for i, _ in found}) / 10)
    assert np.mean(recall) >= 0.95
    assert [i for i, _ in got[0]] == list(range(100, 110))
    assert neighbours.nearest(frame.where("vec_id > 8000 and vec_id < 9030"), frame).count() == 0


def test_neighbours_of_near_copies_at_the_production_block(spark):
    """A third of a full block are near copies, whose codes hardly differ: recall stays whole."""
    rng = np.random.default_rng(11)
    n, d = neighbours.BLOCK, 32
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[0] + 0.02 * rng.normal(size=(n // 3, d))
    x = x.astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = defaultdict(dict)
    for r in neighbours.nearest(frame, frame.where("vec_id % 100 = 0"), k=20).collect():
        got[r.query_id][r["rank"]] = r.vec_id
    for q in range(0, n, 100):
        score = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(n), -score))[:20]
        assert [got[q][i + 1] for i in range(20)] == best.tolist()


def test_neighbours_by_cells(spark):
    """Beyond ``whole`` vectors a query meets some cells only: recall is kept, each has its k, near copies too."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 12_000)] + 0.6 * rng.normal(size=(12_000, 16))
    x[:2000] = x[0] + 0.01 * rng.normal(size=(2000, 16))
    x[5000] = -10 * centres.sum(axis=0)  # far from all others: its own cells may hold fewer than k
    x = x.astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(12_000), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got, met = defaultdict(list), []
    measured = neighbours._measured
    neighbours._measured = lambda coded, scan, model, *a: met.append((measured(coded, scan, model, *a)[0], len(model[1].centroids))) or measured(coded, scan, model, *a)
    try:
        rows = neighbours.nearest(frame, frame.where("vec_id % 40 = 0"), k=10, query_block=200, whole=5000, cell=60).collect()
    finally:
        neighbours._measured = measured
    assert met[0][0] * 2 <= met[0][1] == 200
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 12_000, 40)) and {len({i for i, _ in found}) for found in got.values()} == {10}
    recall = []
    for q, found in got.items():
        score = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        score[q] = -np.inf
        assert all(score[i] == s for i, s in found) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        recall.append(len({i for i, _ in found} & set(np.argsort(-score)[:10].tolist())) / 10)
    assert np.mean(recall) >= 0.93


def test_neighbours_thin_pairs_before_exact_products(monkeypatch):
    """Of 3e7 pairs less than one in a hundred is multiplied exactly, with codes and without, and the best are found."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(30_000, 64)).astype(np.float32)
    quantiser = neighbours.Quantiser(x[:2000])
    asked = neighbours.Asked(np.arange(1000), x[:1000])
    score = x[:20] @ x.T
    score[np.arange(20), np.arange(20)] = -np.inf
    take, exact = neighbours._Best._take, []
    monkeypatch.setattr(neighbours._Best, "_take", lambda self, some, i, *a: exact.append(len(i)) or take(self, some, i, *a))
    for coded in (True, False):
        exact.clear()
        best = neighbours._Best(asked, 20)
        for at in range(0, 30_000, 10_000):
            part = x[at : at + 10_000]
            best.meet(np.arange(1000), np.arange(at, at + 10_000), part, quantiser.decode(quantiser.encode(part).T)[:, :64] if coded else None)
        assert 20_000 <= sum(exact) < 1000 * 30_000 / 100
        assert [set(r.tolist()) for r in best.own[:20]] == [set(r.tolist()) for r in np.argsort(-score, axis=1)[:, :20]]


def test_quantiser_ranks_by_its_tables():
    """Of 8192 vectors the 250 best table scores hold nearly all of the 20 largest products."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8192, 64))
    quantiser = neighbours.Quantiser(x[:4000])
    codes, found = quantiser.encode(x), []
    tables = quantiser.tables(x[:60])
    for q in range(60):
        score = sum(tables[m][q][codes[:, m]] for m in range(tables.shape[0]))
        found.append(len(np.intersect1d(np.argsort(-score)[:250], np.argsort(-(x @ x[q]))[:20])) / 20)
    assert np.mean(found) >= 0.97


def test_neighbours_defined_cases(spark):
    """Other lengths, doubles, repeated ids, extra columns with clashing names, an empty table."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + 20 * i, [0.05 + i, 1.0, 2.0], 1) for i in range(5)] + [(1000, [0.05, 1.0, 2.0], 1), (None, [1.0] * 8, 1), (5000, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, d int").withColumn("score", F.lit(1)).withColumn("codes", F.lit("x"))
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), k=4).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert [(i, round(s, 12)) for i, s in got[1000]] == [(1080, 5.2025), (1060, 5.1525), (1040, 5.1025), (1020, 5.0525)] and set(got) == {*range(0, 300, 20), *range(1000, 1100, 20)}
    best = np.argsort(-(x @ x[20]))
    assert [i for i, _ in got[20]] == [i for i in best if i != 20][:4]
    assert neighbours.nearest(frame.limit(0), frame).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(8)
    item = [f"b{i}" for i in range(30)]
    changed = [w if i % 7 else f"x{i}" for i, w in enumerate(item)]
    filler = [f"f{rng.randrange(500)}" for _ in range(60)]
    texts = [" ".join(filler + item + filler), " ".join(filler + changed), " ".join(filler), " ".join(filler + item[:8] + filler), "", None, ". ".join(item).upper()]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (None, " ".join(filler))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(table(spark, texts), bench).collect()}
    assert got == {(0, 1), (1, 1), (6, 1)}
    assert decontam.contaminated(table(spark, []), bench).count() == 0
    plan = decontam.contaminated(table(spark, texts), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination_of_short_items_with_a_fifth_substituted(spark):
    """Wherever the substitutions stand, at the ends and evenly spaced among them."""
    rng = random.Random(5)
    texts, items, expected = [], [], set()
    for n in [6, 7, 9, *range(10, 21)]:
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        least = -(-4 * n // 5)
        for cut in {1, 2, 3, 4} if n > 14 else {n - least, n - least + 1}:
            for spots in [{1, n - 2}, {4, 8, 12}, {3, 7, 11, 15}, {2, 5, 9, 13}, *(set(rng.sample(range(n), cut)) for _ in range(12))]:
                if len(spots) != cut or max(spots) >= n:
                    continue
                filler = [f"f{rng.randrange(500)}" for _ in range(20)]
                if n - cut >= least:
                    expected.add((len(texts), n))
                elif n > 14:
                    continue  # longer items may count by their best run
                texts.append(" ".join(filler + [w if k not in spots else f"s{k}" for k, w in enumerate(item)] + filler))
    items += [(103, "short whole thing"), (104, "one other")]
    expected |= {(len(texts), 103)}
    texts += ["before Short, whole thing after", "short whole other thing", "one more other"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(table(spark, texts), bench).collect()} == expected


def test_decontamination_equals_brute_force(spark):
    """Every alignment of every pair, scored plainly; items of one id with two texts, repeated rows, null ids."""
    rng = random.Random(31)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 9, 15, 22, 40]))]) for i in range(14)]
    items += [(3, [rng.choice(vocabulary) for _ in range(18)]), items[5]]
    texts = []
    for _ in range(90):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
        if rng.random() < 0.8:
            _, item = rng.choice(items)
            a = rng.randrange(len(item)) if rng.random() < 0.3 else 0
            part = [w if rng.random() > rng.choice([0, 0.1, 0.25]) else rng.choice(vocabulary) for w in item[a:]]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        texts.append(" ".join(words))
    ids = [None if i == 40 else i // 2 for i in range(90)]

    def matched(doc, item):
        best = None
        part = len(item) if len(item) < 6 else -(-len(item) * 8 // 10)
        for diagonal in range(-len(item) + 1, len(doc)):
            score = equal = top = words = whole = 0
            for i in range(max(0, -diagonal), min(len(item), len(doc) - diagonal)):
                same = doc[i + diagonal] == item[i]
                score, whole = max(0, score + (1 if same else -2)), whole + same
                equal = 0 if score == 0 else equal + same
                if score > top:
                    top, words = score, equal
            found = words if words >= min(12, part) else whole if whole >= part else None
            best = max(filter(None, (best, found)), default=None)
        return best

    expected = {}
    for i, text in zip(ids, texts, strict=True):
        for item_id, item in items:
            if found := matched(text.split(), item):
                key = (i, text, item_id)
                expected[key] = max(expected.get(key, (0, -99)), (found, -len(item)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(None, texts[0]), (99, None), (98, "")], "item_id long, text string")
    docs = table(spark, texts + texts[:3], ids + ids[:3])
    marks = {(r.doc_id, r.m): r.text for r in docs.select("doc_id", "text", F.xxhash64("text").alias("m")).collect()}
    rows = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, marks[r.doc_id, r.mark], r.item_id): (r.matched_words, -r.item_words) for r in rows} == expected and len(rows) == len(expected)
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_licenses(spark):
    texts = ["text here\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License.", "He has a fishing license for the lake.", None, "", "This work is licensed under the GNU General Public License, version 3.\r\nLicensed under CC BY-NC 4.0.", "Permission was granted to build the house."]
    got = {(r.doc_id, r.paragraph, r.family, r.confirmed) for r in licenses.scan_licenses(table(spark, texts)).collect()}
    assert got == {(0, 1, "apache", True), (1, 0, "mit", True), (5, 0, "gpl", True), (5, 1, "cc-by-nc", True)}
    assert licenses.scan_licenses(table(spark, [])).count() == 0
    plan = licenses.scan_licenses(table(spark, texts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses_defined_cases(spark):
    """Two notices on one line, wrapped notices, very long texts, repeated rows, null ids."""
    prose = "The boat left the harbour early and came back late in the evening with a few fish. " * 2000
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction."
    texts = [
        "Some words first. Licensed under the Apache License, Version 2.0. Then more of them. Licensed under CC BY 4.0. The end.",
        wrapped, prose + "All rights reserved. " + prose, "All rights reserved.", "All rights reserved.", "Released under the ISC License.", "This program is made available under the terms of the Eclipse Public License, v. 2.0.",
    ]
    rows = licenses.scan_licenses(table(spark, texts, [0, 1, 2, 3, 3, None, 6])).collect()
    got = Counter((r.doc_id, r.family) for r in rows if r.confirmed)
    assert set(got) == {(0, "apache"), (0, "cc-by"), (1, "mit"), (2, "proprietary"), (3, "proprietary"), (None, "isc"), (6, "epl")}
    assert got[3, "proprietary"] == got[2, "proprietary"] == 1 and all(r.paragraph == 0 for r in rows if r.doc_id != 1)


def test_licenses_find_every_template_and_sentence(spark):
    """No word list in front of the classifier: what a template says is found, alone too."""
    asked = [(f, x) for f, texts in licenses.TEMPLATES.items() for t in texts for x in {t, *licenses.sentences_of(t)}]
    asked += [("proprietary", "All rights reserved."), ("mit", "Released under MIT"), ("cc-by", "Available under CC BY 4.0"), ("cc-by", "Creative Commons Attribution 4.0"), ("bsd", "BSD 3-Clause")]
    prose = [*licenses.OTHERS, "Mit.", "Mit und.", "Ungte mit.", "Of the.", "All of the work was done in version 3.", "He reserved a table for two.", "1. 2. 3. 4. 0."]
    got = defaultdict(set)
    for r in licenses.scan_licenses(table(spark, [x for _, x in asked] + prose)).collect():
        got[r.doc_id].add((r.family, r.confirmed))
    assert [x for i, x in enumerate(asked) if (x[0], True) not in got[i]] == []
    assert [prose[i - len(asked)] for i in got if i >= len(asked) and got[i]] == []


def test_licenses_equal_a_plain_recomputation(spark):
    """Units, features and decisions of mixed texts, recomputed word by word."""
    rng = random.Random(21)
    classes, weights, biases, anchors = licenses.trained()
    pool = [t for texts in licenses.TEMPLATES.values() for t in texts] + list(licenses.OTHERS)
    texts = []
    for _ in range(60):
        parts = [" ".join(w for w in rng.choice(pool).split() if rng.random() > 0.15) for _ in range(rng.randrange(1, 5))]
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(parts))

    def judged(unit):
        words = licenses.words_of(unit)
        grams = {g for g in licenses.grams_of(words) if g in weights} if anchors & set(words) else set()
        if not grams:
            return None
        z = np.array(biases) + sum(np.array(weights[g]) for g in grams)
        p = np.exp(z) / np.exp(z).sum()
        return (classes[int(p.argmax())], float(p.max())) if classes[int(p.argmax())] != licenses.UNKNOWN and p.max() >= 0.5 else None

    expected = {}
    for i, text in enumerate(texts):
        for n, line in enumerate(text.split("\n")):
            for unit in {line, *re.split(r"(?<=[.;!?])\s+", line)}:
                if found := judged(unit):
                    key = (i, n, found[0])
                    expected[key] = max(expected.get(key, 0), round(found[1], 6))
    got = {(r.doc_id, r.paragraph, r.family): r.probability for r in licenses.scan_licenses(table(spark, texts), wrap=None).collect()}
    assert set(got) == set(expected) and all(abs(got[k] - expected[k]) < 2e-6 for k in got)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    good, bad = [f"g{i}a" for i in range(60)], ["idiot", "scum", "trash"]
    texts, rows = [], []
    for i in range(300):
        w = [rng.choice(good) for _ in range(40)]
        q, t = int(i % 3 > 0), int(i % 4 == 0)
        if not q:
            w = [x.upper() + "!!" for x in w]
        if t:
            w[5:5] = rng.sample(bad, rng.choice([1, 3]))
        texts.append(" ".join(w))
        rows.append((i, q, t))
    return table(spark, [*texts, None, ""]), spark.createDataFrame([*rows, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"), rows


def test_quality_and_toxicity_held_out(spark, labelled):
    docs, labels, truth = labelled
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(q, got[i].predicted) for i, q, _ in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300)) and np.mean([a == b for a, b in held]) > 0.95
    tox = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert np.mean([t == tox[i].toxic for i, _, t in truth if tox[i].held_out]) > 0.95
    assert tox[300].toxic == 0 and tox[301].toxic == 0 and max(r.grade for r in tox.values()) == 2
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert {r.severity for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}


def test_language(spark):
    rng = random.Random(9)
    stock = {"en": "the and of thing with tion", "de": "der und schön ung ich keit", "fr": "le et où être eau tion", "es": "el y año ción que mente"}
    rows = [(i, " ".join(rng.choices(stock[x].split(), k=20)), x) for i, x in enumerate(sorted(stock) * 40)]
    rows += [(900, None, "en"), (901, "12 34 !!", "en"), (902, "", None)]
    got = {r.doc_id: r for r in langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert np.mean([got[i].lang_pred == x for i, _, x in rows[:160]]) > 0.98
    assert {r.lang_pred for r in langid.identify_language(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_neighbours_are_exact_at_any_size(spark, tmp_path):
    """Whether a table has more than 500,000 vectors makes no difference to what is found."""
    n, d = 500_400, 8
    x = np.random.default_rng(31).normal(size=(n, d)).astype(np.float32)
    vectors = pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), x.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": vectors}), tmp_path / "vectors.parquet", row_group_size=50_000)
    frame = spark.read.parquet(str(tmp_path / "vectors.parquet"))
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(frame, frame.where("vec_id % 2000 = 0"), k=10).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(range(0, n, 2000))
    for q, found in got.items():
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        near = np.argpartition(-score, 20)[:20]
        assert found == near[np.lexsort((near, -score[near]))][:10].tolist()
