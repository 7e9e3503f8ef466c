"""Substring dedup by prefix-partitioned suffix trees over words.

The suffixes of all documents, cut at ``depth`` words, form one conceptual tree; a repeat of
``depth`` words is an internal node at that depth. The tree is never built whole:

* Suffixes are split by a *variable-length prefix*: the words from a suffix's start to the end
  of the smallest-hashed ``anchor``-gram of its first ``depth`` words. Equal suffixes choose the
  same anchor, so a deep node lies in one part only, and neighbouring suffixes mostly share an
  anchor: they travel as one *segment*, the words that they cover together.
* Equal segments are one path of the tree, known by the 128-bit BLAKE2b digest of their words
  (for 1e13 segments the chance that any two differing ones meet is below 1e-12). A part whose
  segments all come from one document has no deep node to report; one with a single segment is
  that path alone. Only the distinct segments of other parts fetch their words, each from one
  document.
* The subtree of such a part is built from words, not from hashes: words get their place in the
  part's sorted dictionary, suffixes are sorted by prefix doubling, and neighbours in suffix
  order that share ``depth`` words form a deep node, whose smallest document is kept.
* A part of more than ``max_segments`` distinct segments does not fit a task: its suffixes are
  split by their longest prefix, all ``depth`` words (as digests), whose nodes are plain groups.

Deep nodes chain along suffix links (position p to p + 1), so merging their spans yields the
maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .scratch import cut, discard

#: Words of the anchor that ends a prefix.
ANCHOR = 8
#: Distinct segments of a subtree (up to 2 * depth words each, some 7 KB at work).
MAX_SEGMENTS = 1024
#: Segments that fetch words: up to this number their places (60 bytes each) are broadcast.
BROADCAST_SEGMENTS = 10_000

_RUNS = "key long, seg binary, doc_id long, mark long, at int, n int"
_WORDS = "key long, seg binary, doc_id long, last long, n int, words binary, hot boolean"
_FOUND = "key long, seg binary, lo int, hi int, least long"


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (leftmost of equals) of each run of ``width``."""
    best = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best


def _digests(raw: bytes, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    view = memoryview(raw)
    return [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _runs(depth: int, anchor: int):
    """One row per document and anchor: the segment of the ``n`` suffixes from word ``at`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for row, data, offsets in bw.chunks(batch.column(2)):
                starts, ends, first = bw.words(data, offsets)
                at = np.flatnonzero(np.arange(len(starts)) + depth <= np.repeat(first[1:], np.diff(first)))
                if not len(at):
                    continue
                places, grams = bw.gram_hashes(bw.word_hashes(data, starts, ends), first, anchor)
                every = np.full(len(starts), np.iinfo(np.uint64).max, dtype=np.uint64)
                every[places] = grams
                # Grams that reach over a row's end are never inside a suffix of full depth.
                chosen = _window_minima(every, depth - anchor + 1)[at]
                begin = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)]))
                number = np.diff(np.append(begin, len(at)))
                where = bw.rows_of(first, at[begin])
                raw, a, b = bw.single_spaced(data, starts, ends)
                picked = pa.array(where + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(every[chosen[begin]].view(np.int64)), pa.array(_digests(raw, a[at[begin]], b[at[begin] + number + depth - 2]), pa.binary()),
                        ids.take(picked), marks.take(picked), pa.array((at[begin] - first[where]).astype(np.int32)), pa.array(number.astype(np.int32)),
                    ],
                    names=["key", "seg", "doc_id", "mark", "at", "n"],
                )

    return run


def _fetched(depth: int):
    """The words of asked segments; of parts too large, the digest of each suffix's ``depth`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2)
            bounds, flat = asked.offsets.to_numpy() - asked.offsets[0].as_py(), asked.flatten()
            at, n, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "hot"))
            for row, data, offsets in bw.chunks(batch.column(1)):
                starts, ends, first = bw.words(data, offsets)
                raw, a, b = bw.single_spaced(data, starts, ends)
                some = np.arange(bounds[row], bounds[row + len(offsets) - 1])
                owner = np.searchsorted(bounds, some, side="right") - 1
                begin = first[owner - row] + at[some]
                whole = ~hot[some]
                segments = [raw[x:y] for x, y in zip(a[begin[whole]].tolist(), b[begin[whole] + n[some[whole]] + depth - 2].tolist(), strict=True)]
                size = n[some[~whole]]
                offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                suffix = np.repeat(begin[~whole], size) + offset
                rows = np.concatenate([some[whole], np.repeat(some[~whole], size)])
                number = np.concatenate([n[some[whole]], offset]).astype(np.int32)
                of, docs = flat.take(pa.array(rows)), batch.column(0).take(pa.array(np.concatenate([owner[whole], np.repeat(owner[~whole], size)])))
                yield pa.RecordBatch.from_arrays(
                    [of.field("key"), of.field("seg"), docs, of.field("last"), pa.array(number), pa.array(segments + _digests(raw, a[suffix], b[suffix + depth - 1]), pa.binary()), of.field("hot")],
                    names=["key", "seg", "doc_id", "last", "n", "words", "hot"],
                )

    return run


def suffix_ranks(ids: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each position's suffix among all, cut at ``depth`` words, by prefix doubling.

    ``ids`` are words by their place in a sorted dictionary, ``ends`` the end of each position's
    segment. Ranks order suffixes, and are equal where the first ``depth`` words are.
    """
    rank, known, every = ids.astype(np.int64) + 1, 1, np.arange(len(ids))
    while known < depth:
        step = min(known, depth - known)
        after = every + step
        rest = np.where(after < ends, rank[np.minimum(after, len(ids) - 1)], 0)
        rank = np.unique(rank * (int(rank.max()) + 2) + rest, return_inverse=True)[1] + 1
        known += step
    return rank


def _deep_nodes(segments: pa.Array, docs: np.ndarray, last: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, lo, hi, least): runs of a segment's suffixes whose deep node has the smallest document ``least``.

    Runs that no document of the segment can lose are left out.
    """
    _, offsets, data = segments.buffers()
    offsets = np.frombuffer(offsets, np.int32)[segments.offset : segments.offset + len(segments) + 1].astype(np.int64)
    data, offsets = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts, ends, first = bw.words(data, offsets)
    sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    solid = data[data != 0x20].tobytes()
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(solid)]).dictionary_encode()
    place = np.empty(len(coded.dictionary), np.int64)
    place[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
    stop = np.repeat(first[1:], np.diff(first))
    rank = suffix_ranks(place[coded.indices.to_numpy()], stop, depth)
    full = np.flatnonzero(np.arange(len(starts)) + depth <= stop)
    of = bw.rows_of(first, full)
    order = np.argsort(rank[full], kind="stable")  # suffixes of full depth in suffix order
    sorted_rank = rank[full][order]
    node = np.flatnonzero(np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]]))
    least = np.empty(len(full), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(docs[of[order]], node), np.diff(np.append(node, len(order))))
    begin = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (least[1:] != least[:-1])]))
    finish = np.append(begin[1:], len(full))
    begin, finish = (x[least[begin] < last[of[begin]]] for x in (begin, finish))
    lo = full[begin] - first[of[begin]]
    return of[begin], lo, lo + finish - begin, least[begin]


def _subtrees(depth: int, max_segments: int):
    """Deep nodes of the parts in a task, from rows sorted by key and segment; whole parts are built together."""

    def once(rows: pa.Table) -> pa.Table:
        """Repeated rows of a document have sent their segments more than once."""
        if rows.num_rows < 2:
            return rows
        rows = rows.combine_chunks()
        key, seg = (rows.column(c).combine_chunks() for c in ("key", "seg"))
        new = pc.or_(pc.not_equal(key[1:], key[:-1]), pc.not_equal(seg[1:], seg[:-1]))
        return rows if pc.all(new).as_py() else rows.filter(pa.array(np.append(True, new.to_numpy(zero_copy_only=False))))

    def built(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        docs, last = (rows.column(c).to_numpy() for c in ("doc_id", "last"))
        of, lo, hi, least = _deep_nodes(rows.column("words").combine_chunks(), docs, last, depth)
        picked = pa.array(of)
        cols = [rows.column(c).combine_chunks().take(picked) for c in ("key", "seg")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(least)], names=["key", "seg", "lo", "hi", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = once(part if held is None else pa.concat_tables([held, part]))
            while held.num_rows > max_segments:
                keys = held.column("key").to_numpy()
                edge = int(np.searchsorted(keys, keys[max_segments], side="left"))
                edge = edge or int(np.searchsorted(keys, keys[0], side="right"))
                if edge == held.num_rows:
                    break  # the part may go on
                yield built(held.slice(0, edge))
                held = held.slice(edge)
        if held is not None and held.num_rows:
            yield built(held)

    return run


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 50, max_segments: int = MAX_SEGMENTS, broadcast_segments: int = BROADCAST_SEGMENTS
) -> DataFrame:
    """(doc_id, mark, start, stop): word ranges that repeat a window of a smaller document.

    ``mark`` is the xxhash64 of the whole text, so that rows of one id with different texts
    stay apart; windows of one id never repeat each other. Rows with a null id or text, or
    fewer than ``depth`` words, take no part. A table without repeats, or without rows, has none.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    base = base.where("doc_id is not null and text is not null")
    runs = cut(base.mapInArrow(_runs(depth, min(ANCHOR, depth)), _RUNS), "runs")
    # Equal segments meet with partial aggregation, so a hot one costs a row a task; so do prefixes.
    segments = runs.groupBy("key", "seg").agg(F.min(F.struct("doc_id", "mark", "at", "n")).alias("one"), F.max("doc_id").alias("last"))
    segments = cut(segments.select("key", "seg", "one.*", "last"), "segments", runs.count())
    parts = segments.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
    shared = cut(segments.join(parts.select("key", "size"), "key"), "shared", segments.count())

    alone = shared.where("size = 1").select("key", "seg", F.lit(0).alias("lo"), F.col("n").alias("hi"), F.col("doc_id").alias("least"))
    asked = shared.where("size > 1").withColumn("hot", F.col("size") > max_segments)
    places = asked.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("at", "n", "key", "seg", "last", "hot")).alias("asked"))
    places = places.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    number = asked.count()
    places = F.broadcast(places) if number <= broadcast_segments else places
    bodies = base.join(places, (F.col("doc_id") == F.col("_id")) & (F.col("mark") == F.col("_mark")))
    words = cut(bodies.select("doc_id", "text", "asked").mapInArrow(_fetched(depth), _WORDS), "words")

    trees = words.where("not hot").repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_subtrees(depth, max_segments), _FOUND)
    hot = words.where("hot")
    nodes = hot.groupBy("words").agg(F.min("doc_id").alias("least"))
    deep = hot.join(nodes, "words").where("least < last").select("key", "seg", F.col("n").alias("lo"), (F.col("n") + 1).alias("hi"), "least")
    found = cut(alone.union(trees).union(deep), "found", words.count() + shared.count(), each=100_000)
    for table in (segments, shared, words):  # nothing below reads them
        discard(table)
    spans = runs.join(found, ["key", "seg"]).where("least < doc_id")
    return spans.select("doc_id", "mark", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi") - 1 + depth).alias("stop"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept words of each text, joined by one space."""
    for batch in batches:
        spans = batch.column(1)
        pairs = spans.flatten()
        begin, stop = (pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        valid = spans.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(valid, np.diff(spans.offsets.to_numpy()), 0)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        for row, data, offsets in bw.chunks(batch.column(0)):
            counts, removed, kept = [], [], []
            starts, ends, first = bw.words(data, offsets)
            raw, a, b = bw.single_spaced(data, starts, ends)
            for i in range(len(offsets) - 1):
                x, y = int(first[i]), int(first[i + 1])
                lo, hi = bounds[row + i], bounds[row + i + 1]
                gone = 0
                if x == y:
                    kept.append(b"")
                elif lo == hi:
                    kept.append(raw[a[x] : b[y - 1]])
                else:
                    cover = np.zeros(y - x + 1, dtype=np.int64)
                    np.add.at(cover, np.minimum(begin[lo:hi], y - x), 1)
                    np.add.at(cover, np.minimum(stop[lo:hi], y - x), -1)
                    stays = np.cumsum(cover)[:-1] == 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], stays, [False]]).astype(np.int8))) + x
                    kept.append(b" ".join([raw[a[p] : b[q - 1]] for p, q in zip(edge[::2], edge[1::2], strict=True)]))
                    gone = y - x - int(stays.sum())
                counts.append(y - x)
                removed.append(gone)
            rest = [batch.column(i).slice(row, len(offsets) - 1) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *rest],
                names=["n_words", "n_removed", "kept", *(f"c{i}" for i in range(len(rest)))],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _strip(batches):
        shas = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), batch.column(1), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _spread(docs: DataFrame, doc_id: str, text: str, kept: list[str], **options) -> DataFrame:
    """(text, spans, c0, c1, ...): the columns ``kept`` under numbers, so that no name can clash."""
    spans = repeated_spans(docs, doc_id, text, **options)
    lists = spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    body = F.col(text).cast("string")
    made = docs.select(body.alias("text"), F.xxhash64(body).alias("at_mark"), F.col(doc_id).cast("long").alias("at_id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)))
    joined = made.join(lists, (F.col("at_id") == F.col("doc_id")) & (F.col("at_mark") == F.col("mark")), "left")
    return joined.select("text", "spans", *(f"c{i}" for i in range(len(kept))))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without ``text``, but with ``n_words``, ``n_removed`` and ``kept`` (kept words joined by one space).

    A word goes if some window of ``depth`` words that covers it also starts in a document
    with a smaller id. Windows are judged on the input. Null and empty texts have no words
    and keep an empty text; rows with a null id lose nothing; repeated rows are returned each.
    Other columns are returned as given; input columns named like the three new ones give way.
    """
    kept = [f.name for f in docs.schema if f.name not in (text, "n_words", "n_removed", "kept")]
    kinds = "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    out = _spread(docs, doc_id, text, kept, **options).mapInArrow(_strip, f"n_words long, n_removed long, kept string{kinds}")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "n_words", "n_removed", "kept")


def repeat_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of ``remove_repeats``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _spread(rows, "doc_id", "text", ["doc_id"], **options).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
