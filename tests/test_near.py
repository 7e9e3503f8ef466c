"""Near-duplicates where groups are hot, chains long, and components larger than a task."""

import numpy as np
import pyarrow as pa
import pytest

from quillmill.operators import graph, near
from quillmill.tables import cut


def heads(spark, sig):
    made = pa.table({"num": pa.array(np.arange(len(sig))), "sig": pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, sig.shape[1], np.int32)), pa.array(sig.ravel()))})
    return cut(spark.createDataFrame(made).repartition(4), "heads")


def plain(sig, rule):
    kept, lost = [], []
    for i in range(len(sig)):
        (lost if kept and rule.arrays(sig[i], sig[kept]).any() else kept).append(i)
    return lost


def chain(n):
    """Neighbours differ in four places, all others in more than six: every second one is kept."""
    sig = np.zeros((n, 64), dtype=np.int32)
    sig[0] = np.arange(64)
    for i in range(1, n):
        sig[i] = sig[i - 1]
        sig[i, np.arange(4 * i, 4 * i + 4) % 64] = 1000 + i
    return sig


def found(spark, sig, rule):
    return sorted(r.num for r in near.lost_in_order(heads(spark, sig), rule).collect())


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_a_chain_is_settled_in_order(spark):
    """The number of jobs follows the logarithm of a chain's length, and the order is kept."""
    rule = near.Near(64, 16, 0.9)
    for n in (300, 3000):
        before = jobs(spark)
        assert found(spark, chain(n), rule) == list(range(1, n, 2))
        assert jobs(spark) - before < 60 * np.log2(n)


def test_a_hot_band_that_is_not_near(spark):
    """100,000 rows that share one band, and 300 near ones in it, are no list of pairs."""
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 30, (100_000, 64)).astype(np.int32)
    sig[:, :4] = 7
    sig[50_000:50_300] = sig[10]
    sig[50_000:50_300, 20] = np.arange(300)
    assert found(spark, sig, near.Near(64, 16, 0.9)) == list(range(50_000, 50_300))


@pytest.mark.parametrize("threshold, bands", [(0.9, 16), (0.5, 16), (0.95, 64)])
def test_groups_of_all_sizes(spark, monkeypatch, threshold, bands):
    """Clusters of unlike density: a plain greedy pass agrees, also where components pass a task's bound."""
    rng = np.random.default_rng(7)
    parts = []
    for spread in (1, 3, 8, 20, 40):
        base = rng.integers(0, 1 << 30, 64).astype(np.int32)
        rows = np.repeat(base[None], 90, axis=0)
        for row in rows:
            at = rng.choice(64, rng.integers(0, spread + 1), replace=False)
            row[at] = rng.integers(0, 5, len(at))
        parts.append(rows)
    sig = np.unique(np.concatenate(parts), axis=0)
    rng.shuffle(sig)
    rule = near.Near(64, bands, threshold)
    want = plain(sig, rule)
    assert 20 < len(want) < len(sig)
    assert found(spark, sig, rule) == want
    monkeypatch.setattr(near, "DENSE", 5)
    monkeypatch.setattr(near, "COMPONENT", 20)
    monkeypatch.setattr(near, "BLOCK", 60)
    assert found(spark, sig, rule) == want


def test_no_rows(spark):
    assert near.lost_in_order(heads(spark, chain(3)).where("false"), near.Near(64, 16, 0.9)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)] + [(500, 501), (7, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 400), 100), 500: 500, 501: 500}
