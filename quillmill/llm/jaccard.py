"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Two documents link when
``den * intersection >= num * union`` in exact integers. The join loses no link:

1. Equal sets share a class id (a hash of the set); classes, not documents, are joined. A
   second hash of the set tells apart sets that fall on one id: 128 bits decide.
2. Sizes fall into geometric bands. In a band whose largest size is ``hi`` a sketch has
   ``P`` pieces; every shingle flips one bit of one piece by XOR. A piece's 2**64 bits are
   kept sparsely, as the XOR of its set bits' hashes. Every shingle in which two sets differ
   changes one bit, so the number of unequal pieces is at most the size ``k`` of their
   symmetric difference, which a link bounds; ``P > k``, so by the pigeonhole principle
   linked sets agree in some piece.
3. A piece is *cold* if it holds a shingle that is not among the corpus's most frequent
   ones. A class with more than ``k`` cold pieces emits these alone: one of them must agree.
   Other classes emit every piece, empty ones included. The list of frequent shingles is
   bounded and steers cost only; results do not depend on it.
   Only a piece without a cold shingle can be common to very many classes; its group is
   salted by class, and the first members of the parts meet in a second step.
4. Within a piece's group, neighbours and the first member are verified on whole sets, and
   verified links give components. Members of groups that still span components then meet
   in blocks: a dense sketch of each set gives a Hamming distance that cannot exceed the
   symmetric difference, and pairs of different components within the bound are verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .components import components
from .scratch import cut, discard

#: Most frequent shingles that may be told apart; only cost depends on it.
FREQUENT = 1 << 18
#: Shingles counted at once in a worker's search for frequent ones (8 bytes each).
WINDOW = 1 << 20
#: Classes that a worker remembers so as not to send them twice; then it begins anew.
MEMORY = 1 << 16
#: Class ids that differing sets fall on: n * n / 2**65 of n sets, some 300 of 1e11. More is an error.
CONFLICTS = 1 << 20
#: Members of a block of an open group; pairs of blocks are compared by sketches.
BLOCK = 2048
#: Parts of the group of a piece that may be common.
SALTS = 64
#: Candidate classes up to this number are broadcast to fetch their texts (16 bytes each).
BROADCAST_ROWS = 500_000


def _bands(limit: int) -> np.ndarray:
    """Smallest size of each band, up to the band that holds ``limit``."""
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, int(edges[-1] * 1.5)))
    return np.array(edges, dtype=np.int64)


def _pieces(hi: int, num: int, den: int) -> int:
    """More pieces than linked sets of a band can differ in shingles; a few more spare rehashed ties."""
    return _links_bound(hi, hi * den // num, num, den) + -(-hi * 3 // 100) + 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a shorter row is one shingle, an empty one none."""
    starts, ends, first = bw.words(data, offsets)
    hashes = bw.word_hashes(data, starts, ends, lower)
    at, grams = bw.gram_hashes(hashes, first, k)
    bounds = np.searchsorted(at, first)
    out = []
    for row in range(len(offsets) - 1):
        a, b = first[row], first[row + 1]
        if b - a >= k:
            out.append(np.unique(grams[bounds[row] : bounds[row + 1]]))
        elif b > a:
            out.append(bw.gram_hashes(hashes[a:b], np.array([0, b - a]), int(b - a))[1])
        else:
            out.append(grams[:0])
    return out


def _class_id(found: np.ndarray, add: int = 0x5851F42D4C957F2D) -> int:
    return int(bw.mix(np.array([bw.mix(found + np.uint64(add)).sum(dtype=np.uint64) ^ np.uint64(len(found))], dtype=np.uint64)).view(np.int64)[0])


def _second_id(found: np.ndarray) -> int:
    return _class_id(found, 0x14057B7EF767814F)


def _told_apart(cls: int, found: np.ndarray, conflicts: frozenset[int]) -> int:
    """The class id, or for one that differing sets share, a mix of both ids."""
    return cls if cls not in conflicts else _mixed(cls, _second_id(found))


def _mixed(cls: int, second: int) -> int:
    return int(bw.mix(np.array([cls], np.int64).view(np.uint64) ^ bw.mix(np.array([second], np.int64).view(np.uint64))).view(np.int64)[0])


def _profile(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document its set size and both class ids; per window of classes the shingles of at least four."""
    names = ["doc_id", "mark", "n", "cls", "second", "often"]

    def counted(tokens: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        tokens.clear()
        flat.sort()
        edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(flat)))
        keep = count >= 4
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(count[keep], pa.int64()), none, none, pa.array(flat[edge[keep]].view(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, size, done = [], 0, set()
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            for row, data, offsets in bw.chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, k)
                n, classes = len(sets), [_class_id(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, n), marks.slice(row, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()),
                        pa.array([_second_id(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(n, pa.int64()),
                    ],
                    names=names,
                )
                for cls, found in zip(classes, sets, strict=True):
                    if cls is not None and cls not in done:
                        done.add(cls)
                        tokens.append(found)
                        size += len(found)
                if size > WINDOW:
                    yield counted(tokens)
                    tokens, size, done = [], 0, set()
        yield counted(tokens)

    return run


def _links_bound(n: int, other: int, num: int, den: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (den - num) * (n + other) // (den + num)


def piece_keys(found: np.ndarray, hot: np.ndarray, edges: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketch pieces that a set emits, over its own and lower bands, and which may be common."""
    n = len(found)
    low = -(-n * num // den)
    top = int(np.searchsorted(edges, n, side="right")) - 1
    bottom = int(np.searchsorted(edges, max(low, 1), side="right")) - 1
    cold_token = ~np.isin(found, hot, assume_unique=True) if len(hot) else np.ones(n, dtype=bool)
    place, bit = bw.mix(found ^ np.uint64(0xA0761D6478BD642F)), bw.mix(found ^ np.uint64(0xE7037ED1A0B428DB))
    out, common = [], []
    for band in range(bottom, top + 1):
        hi = int(edges[band + 1]) - 1
        size = _pieces(hi, num, den)
        piece = (place % np.uint64(size)).astype(np.int64)
        order = np.argsort(piece, kind="stable")
        sorted_pieces = piece[order]
        used, at = np.unique(sorted_pieces, return_index=True)
        value = np.bitwise_xor.reduceat(bit[order], at)
        cold = np.bitwise_or.reduceat(cold_token[order], at)
        other = min(n * den // num, hi if band < top else n * den // num)
        if int(cold.sum()) > _links_bound(n, other, num, den):
            used, value = used[cold], value[cold]
            common.append(np.zeros(len(used), dtype=bool))
        else:
            full, rare = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=bool)
            full[used], rare[used] = value, cold
            used, value = np.arange(size), full
            common.append(~rare)
        out.append(bw.mix(value ^ bw.mix(used.astype(np.uint64) + np.uint64((band + 1) << 40))))
    return np.concatenate(out), np.concatenate(common)


def _emit(k: int, hot, conflicts, num: int, den: int):
    """(key, salt, class) rows of every class that a chunk holds; the salt is 0 but for common pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, edges, shared = hot.value, _bands(1 << 20), conflicts.value
        for batch in batches:
            for _, data, offsets in bw.chunks(batch.column(0)):
                keys, salts, classes, done = [], [], [], set()
                for found in shingle_sets(data, offsets, k):
                    if not len(found) or (cls := _told_apart(_class_id(found), found, shared)) in done:
                        continue
                    done.add(cls)
                    if len(found) >= edges[-2]:
                        edges = _bands(2 * len(found))
                    made, common = piece_keys(found, often, edges, num, den)
                    keys.append(made)
                    salts.append(np.where(common, 1 + cls % SALTS, 0).astype(np.int32))
                    classes.append(np.full(len(keys[-1]), cls, dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keys).view(np.int64), np.concatenate(salts), np.concatenate(classes))], names=["key", "salt", "cls"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of groups of two or more, from rows sorted by (key, salt, class), with first and previous member.

    Salted groups are parts of larger ones, so all their members are returned. Streams: the last
    row is held back until it is known whether its group goes on.
    """
    held: tuple | None = None  # key, salt, class, first, previous, not the group's first
    names = ["key", "salt", "cls", "first", "prev"]

    def flush(key, salt, cls, first, prev, later, goes_on):
        keep = later | goes_on | (salt > 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, salt, cls, first, prev)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt, cls = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held:
            key, salt, cls = np.append(np.int64(held[0]), key), np.append(np.int32(held[1]), salt), np.append(np.int64(held[2]), cls)
        group = np.ones(len(key), dtype=bool)
        group[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        new = group.copy()
        new[1:] |= cls[1:] != cls[:-1]
        key, salt, cls, same = key[new], salt[new], cls[new], ~group[new]
        same[0] = False
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
        first, prev, later = cls[begin], np.where(same, np.roll(cls, 1), cls), same.copy()
        if held:
            first[begin == 0] = held[3]
            prev[0], later[0] = held[4], held[5]
        if len(key) > 1:
            yield flush(key[:-1], salt[:-1], cls[:-1], first[:-1], prev[:-1], later[:-1], same[1:])
        held = key[-1], salt[-1], cls[-1], first[-1], prev[-1], later[-1]
    if held:
        yield flush(*(np.array([x]) for x in held[:5]), np.array([held[5]]), np.array([False]))


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """Bits (as bytes) flipped once by each shingle; eight bits a shingle, a power of two."""
    bits = 64
    while bits < 8 * len(found):
        bits *= 2
    odd = np.bincount((bw.mix(found ^ np.uint64(0x8EBC6AF09C88C6E3)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bits: the positions are taken modulo ``size``."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def _sets(k: int, conflicts):
    """(class, set, size, sketch) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, shared = set(), conflicts.value
        for batch in batches:
            for _, data, offsets in bw.chunks(batch.column(0)):
                rows = []
                if len(done) > MEMORY:
                    done.clear()
                for found in shingle_sets(data, offsets, k):
                    if len(found) and (cls := _told_apart(_class_id(found), found, shared)) not in done:
                        done.add(cls)
                        rows.append((cls, found.tobytes(), len(found), parity_sketch(found).tobytes()))
                if rows:
                    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["cls", "found", "n", "sketch"])

    return run


def _tile(num: int, den: int):
    """Pairs of one tile whose sketches do not rule out a link; within components none."""

    reach = 1  # largest ratio of linked sets' sketch lengths
    while reach * num < den:
        reach *= 2

    def run(table: pa.Table) -> pa.Table:
        cls, label, side, n = (table.column(c).to_numpy() for c in ("cls", "label", "side", "n"))
        raw = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table.column("sketch").combine_chunks()]
        length = np.array([len(x) for x in raw])
        levels = {}  # by sketch length, the rows that can link with one of it, and their folded sketches
        for size in np.unique(length):
            rows = np.flatnonzero((length >= size) & (length <= size * reach))
            levels[size] = rows, np.stack([_fold(raw[r], size) for r in rows])
        left = np.flatnonzero(side != 1)  # 0: first block, 1: second block, 2: both at once
        right = np.flatnonzero(side != 0)
        out = []
        for i in left:
            bound = (den - num) * (n[right] + n[i]) // (den + num)
            meet = right > i if side[i] == 2 else np.ones(len(right), dtype=bool)
            may = right[meet & (np.abs(n[right] - n[i]) <= bound) & (label[right] != label[i])]
            for size in np.unique(np.minimum(length[may], length[i])):
                near = may[np.minimum(length[may], length[i]) == size]
                if len(near):
                    rows, bits = levels[size]
                    own, others = bits[np.searchsorted(rows, i)], bits[np.searchsorted(rows, near)]
                    apart = np.bitwise_count(others ^ own).sum(axis=1, dtype=np.int64)
                    near = near[apart <= (den - num) * (n[near] + n[i]) // (den + num)]
                    out.append((np.minimum(cls[i], cls[near]), np.maximum(cls[i], cls[near])))
        a, b = (np.concatenate([x[j] for x in out]) if out else np.zeros(0, np.int64) for j in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, last, left = [], None, None
            lefts, rights = batch.column(2), batch.column(3)
            a = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if last != a[i]:
                    last, left = a[i], np.frombuffer(lefts[i].as_buffer(), dtype=np.uint64)
                right = np.frombuffer(rights[i].as_buffer(), dtype=np.uint64)
                small, large = (left, right) if len(left) <= len(right) else (right, left)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                ok.append(den * both >= num * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    return run


def open_pairs(members: DataFrame, sets: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """(a, b) of different components within a home, by tiles of two blocks of its members.

    A home of one block is one tile; a larger one has a tile for each pair of blocks, so that
    no task holds more than two blocks, however large the home.
    """
    counts = members.groupBy("home").agg(F.count(F.lit(1)).alias("size"))
    dealt = members.join(counts, "home").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("cls", "home"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select(
        "home", "cls", "label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    tiles = tiles.join(sets.select("cls", "n", "sketch"), "cls").select("home", "i", "j", "cls", "label", "side", "n", "sketch")
    return tiles.groupBy("home", "i", "j").applyInArrow(_tile(num, den), "a long, b long")


def jaccard_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)
) -> DataFrame:
    """(doc_id, mark, n_shingles, label, component_id) for every row of ``docs``.

    ``mark`` is the text's xxhash64 and ``label`` tells components apart, which ids shared by
    rows of different texts do not; it is null for rows without words. ``component_id`` is the smallest id reachable by links, a row's own included. Rows
    without words (null text too) have an empty set and link with nothing. Rows of equal
    sets link whatever their ids; a null id counts as larger than all. Repeated rows are
    returned each. Other columns of ``docs`` are ignored, so their names cannot clash.
    """
    spark, (num, den) = docs.sparkSession, threshold
    if not 0 < num <= den:
        raise ValueError("threshold must lie in (0, 1]")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = base.withColumn("mark", F.xxhash64("text"))
    seen = cut(base.mapInArrow(_profile(shingle), "doc_id long, mark long, n long, cls long, second long, often long"), "profile")
    profile = seen.where("often is null").select("doc_id", "mark", "n", "cls", "second")
    twice = profile.groupBy("cls").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo <> hi").select("cls")
    shared = frozenset(twice.limit(CONFLICTS + 1).toArrow()["cls"].to_pylist())
    if len(shared) > CONFLICTS:
        raise RuntimeError("more class ids are shared than chance allows")
    conflicts = spark.sparkContext.broadcast(shared)
    if shared:
        apart = F.udf(_mixed, "long")
        profile = profile.withColumn("cls", F.when(F.col("cls").isin(*shared), apart("cls", "second")).otherwise(F.col("cls")))
    profile = profile.drop("second")
    top = seen.where("often is not null").groupBy("often").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "often").limit(FREQUENT)
    often = np.sort(top.select("often").toArrow()["often"].to_numpy().view(np.uint64))  # as Arrow: rows as objects take some 100 MB
    hot = spark.sparkContext.broadcast(often)

    rows = base.select("text").mapInArrow(_emit(shingle, hot, conflicts, num, den), "key long, salt int, cls long")
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "cls")
    parts = cut(rows.mapInArrow(_groups, "key long, salt int, cls long, first long, prev long"), "groups")
    salted = parts.where("salt > 0")
    shared = salted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    some = parts.count()  # of written tables, counts are read from the files' ends
    salted = cut(salted.join(shared, "key", "left_semi"), "salted", some)
    groups = parts.where("salt = 0").union(salted.select(parts.columns))
    # First members of a common piece's parts, a row a salt at most, meet like members of a group.
    heads = Window.partitionBy("key").orderBy("cls")
    joint = salted.where("cls = first").select("key", "cls", F.first("cls").over(heads).alias("first"), F.lag("cls", 1).over(heads).alias("prev"))

    near = groups.select(F.col("first").alias("a"), F.col("cls").alias("b")).union(groups.select("prev", "cls"))
    near = near.union(joint.select("first", "cls")).union(joint.where("prev is not null").select("prev", "cls"))
    pairs = cut(near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs", 2 * (some + salted.count()))

    needed = groups.select("cls").distinct()
    heads = profile.join(needed, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "doc_id", "mark")).alias("m"))
    heads = cut(heads.select(F.col("m.doc_id").alias("doc_id"), F.col("m.mark").alias("mark")).distinct(), "heads", some)
    wanted = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads
    texts = base.join(wanted, base["doc_id"].eqNullSafe(heads["doc_id"]) & (base["mark"] == heads["mark"]), "left_semi")
    sets = cut(texts.select("text").mapInArrow(_sets(shingle, conflicts), "cls long, found binary, n long, sketch binary"), "sets")

    def verified(candidates: DataFrame) -> DataFrame:
        """Linked ones of a written table of pairs."""
        left = candidates.join(sets.select(F.col("cls").alias("a"), F.col("found").alias("left")), "a")
        full = left.join(sets.select(F.col("cls").alias("b"), F.col("found").alias("right")), "b")
        return cut(full.select("a", "b", "left", "right").mapInArrow(_verify(num, den), "a long, b long"), "links", candidates.count(), each=50_000)

    links = verified(pairs)
    labels = components(links)
    # Groups that still span components: their members meet in blocks, and pairs of different
    # components that the sketches cannot rule out are verified too.
    members = groups.select("key", "cls").join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("label", "cls").alias("label"))
    open_keys = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi and size > 2")
    members = cut(members.join(open_keys.select("key", "lo"), "key").select(F.col("lo").alias("home"), "cls", "label").distinct(), "open", some)
    spent = []
    if members.count():
        more = cut(open_pairs(members, sets, num, den).distinct().join(pairs, ["a", "b"], "left_anti"), "more")
        extra = verified(more)
        if extra.count():
            labels = components(links.union(extra))
        spent = [more, extra]
    ids = profile.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    ids = ids.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    ids = cut(ids, "ids", seen.count())
    for table in (parts, salted, pairs, heads, sets, links, members, *spent):  # nothing below reads them
        discard(table)
    whole = ids.groupBy("label").agg(F.min("least").alias("component_id"))
    found = ids.join(whole, "label").select("cls", "label", "component_id")
    out = profile.join(found, "cls").select("doc_id", "mark", "n", "label", F.coalesce("component_id", "doc_id").alias("component_id"))
    empty = profile.where("cls is null").select("doc_id", "mark", "n", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return out.union(empty).withColumnRenamed("n", "n_shingles")


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; see ``jaccard_rows``."""
    return jaccard_rows(docs, doc_id, text, shingle, threshold).select("doc_id", "n_shingles", "component_id")
