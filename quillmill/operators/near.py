"""Near-duplicates by MinHash: greedy in order, an example goes if an earlier kept one is near.

A shingle's number is the first 32 bits of its MD5; permutation ``i`` of it is
``(a * h + b) mod (2**31 - 1)``, with ``a`` and ``b`` the first 32 bits of the MD5 of ``a<i>`` and
``b<i>``, so that any engine can state the signatures.

Candidates come from keys that lose no pair. Two signatures that may differ in ``d`` places agree on
one of any ``d + 1`` disjoint groups of places, so each group is a key: seven keys of nine places at the
usual threshold of 0.9 of 64. Pairs of small groups are compared; a large group is only tied together.
What hangs together then is settled in one task, in order, against what is kept there: n rows
of which k stay take n * k comparisons of bytes, whatever the pairs. A component too large for a
task is settled block by block in order: a block in one task, then all later rows against what the block keeps.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..heavy import join_unique
from ..tables import cut, discard
from . import messages as M
from .graph import components

PRIME = (1 << 31) - 1
#: Members of a group up to which its pairs are compared before components are looked for.
DENSE = 40
#: Rows of a component that one task settles, and of a block of a larger one.
COMPONENT = 100_000
BLOCK = 5_000
#: Characters of text that are hashed together.
CHUNK = 1 << 20

_EDGE = "\x1e"  # no word character, so a text's own ones part words as before
_WORDS = re.compile(rf"\w+|{_EDGE}")


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def permutation(i: int) -> tuple[int, int]:
    return 1 + _number(f"a{i}") % (PRIME - 1), _number(f"b{i}") % PRIME


def _below_prime(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for ``x`` below 2**63."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``CHUNK`` characters; a longer one is alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if texts:
        yield begin, len(texts)


def _runs_of_words(texts: list[str], shingle: int) -> tuple[list[str], np.ndarray]:
    """All runs of ``shingle`` words of some texts, and each one's text; none reaches over a text's end."""
    joined = unicodedata.normalize("NFC", _EDGE.join(x.replace(_EDGE, " ") for x in texts)).casefold()
    words = _WORDS.findall(joined)
    edge = np.fromiter((w == _EDGE for w in words), dtype=bool, count=len(words))
    row = np.cumsum(edge)
    edges = np.concatenate([[0], np.cumsum(edge)])
    whole = np.flatnonzero(edges[shingle:] == edges[: len(edges) - shingle]) if len(words) >= shingle else np.zeros(0, np.int64)
    return [" ".join(words[i : i + shingle]) for i in whole.tolist()], row[whole]


def signatures(shingle: int, permutations: int):
    """Arrow function from texts to MinHash signatures of their distinct word runs; null for short texts.

    Texts are folded, split and hashed by the megabyte, and least values are taken for all of them at once.
    """
    by, plus = zip(*map(permutation, range(permutations)), strict=True)

    def signed_piece(texts: list[str]) -> list:
        runs, row = _runs_of_words(texts, shingle)
        if not runs:
            return [None] * len(texts)
        heads = b"".join([hashlib.md5(r.encode()).digest()[:4] for r in runs])
        numbers = _below_prime(np.frombuffer(heads, dtype=">u4").astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.empty((len(first), permutations), dtype=np.int32)
        for i, (a, b) in enumerate(zip(by, plus, strict=True)):
            least[:, i] = np.minimum.reduceat(_below_prime(numbers * np.uint64(a) + np.uint64(b)), first)
        out: list = [None] * len(texts)
        for at, values in zip(row[first].tolist(), least, strict=True):
            out[at] = values
        return out

    @F.pandas_udf("array<int>")
    def signed(texts: pd.Series) -> pd.Series:
        plain = [x or "" for x in texts]
        return pd.Series([s for a, b in _pieces(plain) for s in signed_piece(plain[a:b])], index=texts.index, dtype=object)

    return signed.asNondeterministic()  # else a filter on signatures takes a call of its own, and each is made twice


class Near:
    """When two signatures are near: they agree in ``least`` places, and on a whole band."""

    def __init__(self, permutations: int, bands: int, threshold: float):
        self.permutations, self.bands, self.width = permutations, bands, permutations // bands
        self.least = next(n for n in range(permutations + 1) if n / permutations >= threshold)
        #: Places that may differ; where these are too few to touch every band, a band is shared anyway.
        self.differ = permutations - self.least
        self.free = self.differ < bands

    def columns(self, a: Column, b: Column) -> Column:
        met = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) >= self.least
        if self.free:
            return met
        return met & F.exists(F.sequence(F.lit(0), F.lit(self.bands - 1)), lambda i: F.slice(a, i * self.width + 1, self.width) == F.slice(b, i * self.width + 1, self.width))

    def arrays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For signatures that can be broadcast against each other."""
        same = a == b
        met = same.sum(axis=-1, dtype=np.int16) >= self.least
        return met if self.free else met & same.reshape(*same.shape[:-1], self.bands, self.width).all(axis=-1).any(axis=-1)

    def to_any(self, sig: np.ndarray, kept: np.ndarray, step: int = 256) -> np.ndarray:
        """Which of ``sig`` are near to one of ``kept``: lowest bytes are compared first."""
        out = np.zeros(len(sig), dtype=bool)
        low, low_kept = sig.astype(np.uint8), kept.astype(np.uint8)
        for lo in range(0, len(sig), step):
            part = low[lo : lo + step]
            for at in range(0, len(kept), 1024):
                agree = (part[:, None, :] == low_kept[None, at : at + 1024, :]).sum(axis=-1, dtype=np.int16)
                i, j = np.nonzero(agree >= self.least)
                out[lo + i[self.arrays(sig[lo + i], kept[at + j])]] = True
        return out

    def dropped(self, sig: np.ndarray, step: int = 256) -> np.ndarray:
        """Which of some signatures a pass in order drops."""
        gone = np.zeros(len(sig), dtype=bool)
        kept = np.zeros((0, self.permutations), dtype=sig.dtype)
        for lo in range(0, len(sig), step):
            part = sig[lo : lo + step]
            gone[lo : lo + step] = self.to_any(part, kept, step)
            left = np.flatnonzero(~gone[lo : lo + step])
            met = self.arrays(part[left][:, None, :], part[left][None])
            for i in range(len(left)):
                if not gone[lo + left[i]]:
                    later = left[i + 1 :][met[i, i + 1 :]]
                    gone[lo + later] = True
            kept = np.concatenate([kept, part[~gone[lo : lo + step]]])
        return gone


def _signature_rows(column: pa.Array, permutations: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, permutations)


def _settled(rule: Near):
    """(num, gone) of whole components, from rows (label, num, sig) sorted by (label, num)."""

    def built(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        label, num = (rows.column(c).to_numpy() for c in ("label", "num"))
        sig = _signature_rows(rows.column("sig").combine_chunks(), rule.permutations)
        edge = np.append(np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])), len(label))
        gone = np.concatenate([rule.dropped(sig[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(num), pa.array(gone)], names=["num", "gone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            label = held.column("label").to_numpy()
            new = np.flatnonzero(label[1:] != label[:-1]) + 1
            if len(new):  # the last component may go on
                yield built(held.slice(0, int(new[-1])))
                held = held.slice(int(new[-1]))
        if held is not None and held.num_rows:
            yield built(held)

    return run


def _met(rule: Near):
    """(num) of later rows that are near to one of a block's kept ones, of one component and salt."""

    def run(later: pa.Table, kept: pa.Table) -> pa.Table:
        if not later.num_rows or not kept.num_rows:
            return pa.table({"num": pa.array([], pa.int64())})
        a, b = (_signature_rows(t.column("sig").combine_chunks(), rule.permutations) for t in (later, kept))
        return pa.table({"num": later.column("num").filter(pa.array(rule.to_any(a, b)))})

    return run


def _dropped(rows: DataFrame, rule: Near) -> DataFrame:
    """(num) of what a pass in order drops, of rows (label, num, sig), a written table."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > COMPONENT), "large")
    whole = rows
    if large.limit(1).count():
        whole = join_unique(rows, cut(sizes.where(F.col("n") <= COMPONENT), "fitting"), ["label"], "n").select("label", "num", "sig")
    ordered = whole.repartition("label").sortWithinPartitions("label", "num")
    out = cut(ordered.mapInArrow(_settled(rule), "num long, gone boolean"), "settled").where("gone").select("num")
    rest = join_unique(rows, large, ["label"], "n").select("label", "num", "sig") if large.limit(1).count() else None
    while rest is not None:
        rest = cut(rest, "rest")
        number = rest.count()
        if not number:
            break
        block = cut(rest.orderBy("num").limit(BLOCK), "block")
        settled = cut(block.repartition(1).sortWithinPartitions("label", "num").mapInArrow(_settled(rule), "num long, gone boolean"), "settled")
        edge = block.agg(F.max("num")).first()[0]
        kept = block.join(settled.where("not gone").select("num"), "num")
        salts = -(-number // 50_000)
        later = rest.where(F.col("num") > edge).withColumn("salt", F.pmod(F.xxhash64("num"), F.lit(salts)))
        kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
        found = cut(later.groupBy("label", "salt").cogroup(kept.groupBy("label", "salt")).applyInArrow(_met(rule), "num long"), "met")
        out = out.union(settled.where("gone").select("num")).union(found)
        rest = rest.where(F.col("num") > edge).join(found, "num", "left_anti")
    return out


def _tied(heads: DataFrame, rule: Near) -> DataFrame:
    """(a, b): near pairs of small groups, and what ties the members of large ones."""
    groups = rule.differ + 1 if rule.free else rule.bands
    bounds = [round(g * rule.permutations / groups) for g in range(groups + 1)]
    keys = F.array(*(F.xxhash64(F.lit(g), F.slice("sig", lo + 1, hi - lo)) for g, (lo, hi) in enumerate(zip(bounds, bounds[1:]))))
    keyed = cut(heads.select("num", F.explode(keys).alias("key")), "keyed")
    sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("num").alias("first")).where("n > 1"), "groups")
    met = cut(join_unique(keyed, sizes, ["key"], "n"), "grouped")
    few = met.where(F.col("n") <= DENSE).select("key", "num")
    pairs = few.withColumnRenamed("num", "a").join(few.withColumnRenamed("num", "b"), "key").where("a < b").select("a", "b").distinct()
    sigs = heads.select("num", "sig")
    for side in ("a", "b"):
        pairs = pairs.join(sigs.withColumnsRenamed({"num": side, "sig": f"{side}_sig"}), side)
    near = pairs.where(rule.columns(F.col("a_sig"), F.col("b_sig"))).select("a", "b")
    tied = cut(near.union(met.where((F.col("n") > DENSE) & (F.col("num") > F.col("first"))).select(F.col("first").alias("a"), F.col("num").alias("b"))), "tied")
    for table in (keyed, sizes, met):
        discard(table)
    return tied


def lost_in_order(heads: DataFrame, rule: Near) -> DataFrame:
    """(num) of the rows (num, sig) that have an earlier kept one near; a written table with different signatures."""
    labels = components(_tied(heads, rule))
    rows = cut(heads.join(labels.withColumnRenamed("node", "num"), "num").select("label", "num", "sig"), "components")
    return _dropped(rows, rule)


def near_duplicate(
    examples: DataFrame, threshold: float = 0.9, shingle: int = 5, permutations: int = 64, bands: int = 16, roles: tuple[str, ...] = M.ROLES
) -> DataFrame:
    """``examples`` without those near an earlier kept one; texts below the shingle size stay.

    Two examples are near if they share a band and agree in ``threshold`` of all permutations.
    Equal signatures decide alike, so only the first of each takes part. (seq, sub) must be unique.
    """
    if not 0 < threshold <= 1:
        raise ConfigError("threshold must lie in (0, 1]")
    if permutations % bands:
        raise ConfigError("permutations must be a multiple of bands")
    rule = Near(permutations, bands, threshold)
    body = F.array_join(F.transform(F.filter("messages", lambda m: m["role"].isin(*roles)), lambda m: m["content"]), " ")
    signed = cut(examples.select(F.struct("seq", "sub").alias("id"), signatures(shingle, permutations)(body).alias("sig")).where("sig is not null"), "signed")
    heads = signed.groupBy("sig").agg(F.min("id").alias("id"))
    heads = cut(heads.orderBy("id").select("id", "sig", F.monotonically_increasing_id().alias("num")), "heads")
    stay = heads.join(lost_in_order(heads, rule), "num", "left_anti").select("id")
    lost = signed.select("id").join(stay, "id", "left_anti").select("id.seq", "id.sub")
    return examples.join(lost, ["seq", "sub"], "left_anti")
