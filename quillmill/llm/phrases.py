"""Dedup of repeated byte strings by prefix-free parsing.

A *trigger* is a place whose next ``WINDOW`` bytes have a rolling hash that is a multiple of
2**6. Triggers cut texts into phrases; a phrase ends with the trigger that begins the next one, so
no phrase's suffix that is longer than a trigger is a prefix of another. A window of ``depth``
bytes belongs to the first trigger after its start; where none lies inside the window, phrases are
parsed again with multiples of 2**5, 2**4, ..., 1, until one does. The choice depends on the
window's own bytes only, so equal windows belong to equal triggers at equal distances.

* Neighbouring windows of one trigger travel as one *segment*. All segments of one trigger string
  are one part of the corpus' suffix order. A trigger string that occurs once has no repeat and
  ends there.
* Equal segments are one piece of the parse, known by 96 bits of BLAKE2b beside the 64 bits of the
  trigger's hash. All but the first of equal segments are repeats as a whole.
* First segments of a part that has several fetch their bytes. The part's dictionary (what stands
  before the trigger, up to the window's start) is sorted by its suffixes, its parse (what follows
  the trigger) by what follows; a place in corpus order is a dictionary suffix's place, then the
  parse's. Places that share ``depth`` bytes are neighbours in that order, and all of them but the
  first in (document, place) are repeats.
* A part of more than ``max_segments`` first segments does not fit a task: its segments are cut to
  bands of 12 starts, whose parts are keyed by all bytes that the band's windows share, and where
  that does not do, to single windows.

No part is dropped or capped, and no task holds more than a text or a bounded batch of parts.
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
from .heavy import join_unique
from .scratch import cut

#: Bytes of a trigger, and the power of two that its hash is a multiple of.
WINDOW = 16
TRIGGER_BITS = 6
#: Starts of windows that travel together: all of a trigger's, then in bands of parts that are too large.
BANDS = (None, 12, 1)
#: First segments of a part that one task may hold, and of parts that it builds together.
MAX_SEGMENTS = 2048
BATCH = 4096

_ROWS = "key long, s1 long, s2 int, doc long, at long"
_PIECES = "key long, doc long, at long, piece binary"
_SPANS = "doc long, start long, stop long"


def _packed(start: np.ndarray, number: np.ndarray, back: np.ndarray) -> np.ndarray:
    """First start, number of starts and distance of the first one to its trigger, in one long."""
    return (start.astype(np.int64) << 14) | (number.astype(np.int64) << 7) | back.astype(np.int64)


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 14, (at >> 7) & 127, at & 127


def _digests(raw: memoryview, begin: np.ndarray, stop: np.ndarray, salt: bytes = b"") -> np.ndarray:
    """Two uint64 for each slice."""
    pieces = [hashlib.blake2b(raw[a:b], digest_size=16, salt=salt).digest() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
    return np.frombuffer(b"".join(pieces), "<u8").reshape(-1, 2)


def parse(data: np.ndarray, offsets: np.ndarray, depth: int, window: int = WINDOW, bits: int = TRIGGER_BITS):
    """(trigger hash, first start, starts, distance to the trigger) of the segments of concatenated texts."""
    n = len(data)
    starts = np.ones(n + 1, dtype=bool)  # places where a window of ``depth`` bytes begins
    trigger = np.ones(max(n - window + 1, 0), dtype=bool)
    for row_end in offsets[1:].tolist():
        starts[max(row_end - depth + 1, 0) : row_end] = False
        trigger[max(row_end - window + 1, 0) : row_end] = False
    lengths = np.diff(offsets)
    for row in np.flatnonzero(lengths < depth):
        starts[offsets[row] : offsets[row + 1]] = False
    open_ = np.flatnonzero(starts[:n])
    none = np.zeros(0, dtype=np.int64)
    if not len(open_):
        return none.astype(np.uint64), none, none, none
    up, down = bw.powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(bw._TABLE[data] * up[:n], out=sums[1:])
    hashes = bw.mix((sums[window:] - sums[:-window]) * down[: n - window + 1])
    chosen = np.full(n, -1, dtype=np.int64)
    every = open_
    for power in range(bits, -1, -1):
        places = np.flatnonzero(trigger & ((hashes & np.uint64((1 << power) - 1)) == 0))
        if not len(places):
            continue
        if power == bits:
            after = np.full(n, n + depth, dtype=np.int64)
            after[: places[-1]] = np.repeat(places, np.diff(places, prepend=0))
            after = after[open_]
        else:
            at = np.searchsorted(places, open_, side="right")
            after = np.where(at < len(places), places[np.minimum(at, len(places) - 1)], n + depth)
        near = after - open_ <= depth - window
        chosen[open_[near]] = after[near]
        open_ = open_[~near]
        if not len(open_):
            break
    own = chosen[every]
    begin = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (every[1:] != every[:-1] + 1)]))
    first, at = every[begin], own[begin]
    return hashes[at], first, np.diff(np.append(begin, len(every))), at - first


def _segments(depth: int):
    """Segments of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in bw.chunks(batch.column(1)):
                hashes, first, number, back = parse(data, offsets, depth)
                where = bw.rows_of(offsets, first)
                seg = _digests(memoryview(np.ascontiguousarray(data)), first, first + number - 1 + depth)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)), pa.array(seg[:, 0].view(np.int64)), pa.array((seg[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        batch.column(0).take(pa.array(where + row)), pa.array(_packed(first - offsets[where], number, back)),
                    ],
                    names=["key", "s1", "s2", "doc", "at"],
                )

    return run


def _asked(batch: pa.RecordBatch):
    """For runs of texts: bytes, first bytes in the run, and what is asked of each."""
    asked = batch.column(1)
    bounds, flat = asked.offsets.to_numpy() - asked.offsets[0].as_py(), asked.flatten()
    at, key = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "key"))
    for row, data, offsets in bw.chunks(batch.column(2)):
        some = np.arange(bounds[row], bounds[row + len(offsets) - 1])
        owner = np.searchsorted(bounds, some, side="right") - 1
        yield memoryview(np.ascontiguousarray(data)), offsets[owner - row], batch.column(0).take(pa.array(owner)), key[some], at[some]


def _pieces(depth: int):
    """The bytes of asked segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, base, doc, key, at in _asked(batch):
                first, number, _ = _unpacked(at)
                begin = base + first
                pieces = [bytes(raw[a:b]) for a, b in zip(begin.tolist(), (begin + number - 1 + depth).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key), doc, pa.array(at), pa.array(pieces, pa.binary())], names=["key", "doc", "at", "piece"])

    return run


def _banded(depth: int, width: int):
    """Asked segments cut to bands of ``width`` distances, keyed by the bytes that all windows of the band share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, base, doc, key, at in _asked(batch):
                first, number, back = _unpacked(at)
                least = back - number + 1
                low, high = (least - 1) // width, (back - 1) // width
                times = high - low + 1
                of = np.repeat(np.arange(len(at)), times)
                band = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                far, close = np.minimum(back[of], (band + 1) * width), np.maximum(least[of], band * width + 1)
                trigger = first[of] + back[of]
                # The core may be longer than these windows, never than their text: it ends where the band's last one does.
                lo, hi = base[of] + trigger - band * width - 1, base[of] + trigger - (band + 1) * width + depth
                core = _digests(raw, lo, hi)[:, 0] ^ bw.mix(band.astype(np.uint64) + np.uint64(1))
                seg = _digests(raw, base[of] + trigger - far, base[of] + trigger - close + depth)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(core.view(np.int64)), pa.array(seg[:, 0].view(np.int64)), pa.array((seg[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        doc.take(pa.array(of)), pa.array(_packed(trigger - far, far - close + 1, far)),
                    ],
                    names=["key", "s1", "s2", "doc", "at"],
                )

    return run


def _order(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows by (key, bytes), and the bytes that each shares with the one before (-1: another key)."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([*words.T[::-1], key])
    sorted_rows, sorted_key = rows[order], key[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    shared[sorted_key[1:] != sorted_key[:-1]] = -1
    return order, np.concatenate([[-1], shared])


def repeats(key: np.ndarray, doc: np.ndarray, at: np.ndarray, pieces: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, stop) of windows whose bytes are also an earlier segment's; spans cover whole windows."""
    first, number, back = _unpacked(at)
    least, trigger, m = back - number + 1, first + back, len(at)
    _, offsets, data = pieces.buffers()
    begin = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + m].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    before, after = int(back.max()), depth - int(least.min())
    step = np.arange(before)
    left = np.where(step < back[:, None], data[np.maximum((begin + back - 1)[:, None] - step, 0)], 0)
    step = np.arange(after)
    right = np.where(step < (depth - least)[:, None], data[np.minimum((begin + back)[:, None] + step, len(data) - 1)], 0)
    phrase, phrase_shares = _order(key, left)
    tail, tail_shares = _order(key, right)
    earliest = np.empty(m, dtype=np.int64)
    earliest[np.lexsort((trigger, doc))] = np.arange(m)
    # All (segment, distance) places; classes of dictionary suffixes and of what follows, by distance.
    of = np.repeat(np.arange(m), number)
    distance = back[of] - (np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number))
    suffix, follow = (np.empty((before + 1, m), dtype=np.int64) for _ in range(2))
    for d in range(int(least.min()), before + 1):
        suffix[d, phrase] = np.cumsum(phrase_shares < d)
        follow[d, tail] = np.cumsum(tail_shares < depth - d)
    place = (distance * (m + 1) + suffix[distance, of]) * (m + 1) + follow[distance, of]
    order = np.lexsort((earliest[of], place))
    again = np.concatenate([[False], place[order][1:] == place[order][:-1]])
    hit = np.zeros(len(of), dtype=bool)
    hit[order[again]] = True
    run = np.where(hit, of, -1)
    lo = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    hi = np.append(lo[1:], len(of))
    lo, hi = lo[hit[lo]], hi[hit[lo]]
    seg = of[lo]
    return seg, trigger[seg] - distance[lo], trigger[seg] - distance[hi - 1] + depth


def _ordered(depth: int, batch_rows: int):
    """Repeats in the parts of a task, from rows sorted by key; whole parts are built together."""

    def built(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        key, doc, at = (rows.column(c).to_numpy() for c in ("key", "doc", "at"))
        seg, start, stop = repeats(key, doc, at, rows.column("piece").combine_chunks(), depth)
        return pa.RecordBatch.from_arrays([pa.array(doc[seg]), pa.array(start), pa.array(stop)], names=["doc", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows > batch_rows:
                keys = held.column("key").to_numpy()
                edge = int(np.searchsorted(keys, keys[batch_rows], side="left"))
                edge = edge or int(np.searchsorted(keys, keys[0], side="right"))
                if edge == held.num_rows:
                    break  # the part may go on
                yield built(held.slice(0, edge))
                held = held.slice(edge)
        if held is not None and held.num_rows:
            yield built(held)
        bw.give_back()

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (key, s1, s2, doc, at), those whose key is also a neighbour's; ``copy``: the row before is an equal segment.

    What lies beyond a task's first and last row is not known here: these two are always returned, as
    ``edge`` 1 and 2 (3: both), and with their segments, which other rows no longer need.
    """
    names = ["key", "s1", "s2", "doc", "at"]

    def told(rows: pa.Table, begins: bool, ends: bool, last_key: int | None, last_seg: tuple | None) -> pa.RecordBatch:
        """``rows`` without the last one, which is known only when the next comes, unless it ``ends`` the task."""
        key, s1, s2 = (rows.column(c).to_numpy() for c in names[:3])
        same_key, same = key[1:] == key[:-1], (key[1:] == key[:-1]) & (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
        before = np.concatenate([[not begins and last_key == key[0]], same_key])
        copy = np.concatenate([[not begins and last_seg == (key[0], s1[0], s2[0])], same])
        edge = np.zeros(len(key), dtype=np.int32)
        edge[0] += begins
        edge[-1] += 2 * ends
        kept = before | np.append(same_key, False) | (edge > 0)
        if not ends:
            kept[-1] = False
        at = pa.array(np.flatnonzero(kept))
        plain = pa.array(edge[kept] == 0)
        cols = [rows.column(c).combine_chunks().take(at) for c in names]
        cols[1:3] = [pc.if_else(plain, pa.scalar(None, c.type), c) for c in cols[1:3]]
        return pa.RecordBatch.from_arrays([*cols, pa.array(copy[kept]), pa.array(edge[kept])], names=[*names, "copy", "edge"])

    held: pa.Table | None = None
    begins, last_key, last_seg = True, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        if held is not None:
            part = pa.concat_tables([held, part])
        if part.num_rows > 1:
            yield told(part, begins, False, last_key, last_seg)
            begins = False
            last_key, *rest = (part.column(c)[part.num_rows - 2].as_py() for c in names[:3])
            last_seg = (last_key, *rest)
        held = part.slice(part.num_rows - 1)
    if held is not None:
        yield told(held, begins, True, last_key, last_seg)


def _known(rows: DataFrame) -> DataFrame:
    """(key, doc, at, copy) of segments whose key occurs more than once; ``copy``: an equal segment comes before.

    Segments are put in order over all tasks, so a segment or key of any number of rows fills none. The
    first row of a task may be a copy of the last one of a task before; both are edges.
    """
    order = ["key", "s1", "s2", "doc", "at"]
    known = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compared, f"{_ROWS}, copy boolean, edge int"), "known")
    edges = known.where("edge > 0")
    first = edges.groupBy("key", "s1", "s2").agg(F.min(F.struct("doc", "at")).alias("one"))
    begun = edges.where("edge in (1, 3)").join(first, ["key", "s1", "s2"]).select("key", "doc", "at", (F.struct("doc", "at") > F.col("one")).alias("copy"))
    return known.where("edge in (0, 2)").select("key", "doc", "at", "copy").unionByName(begun)


def repeated_bytes(base: DataFrame, depth: int = 100, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(doc, start, stop): byte ranges of ``base`` (doc long, text) that repeat ``depth`` earlier bytes.

    ``doc`` must be unique and not null; earlier is a smaller ``doc``, or the same one and a smaller
    start. Texts that are null or shorter than ``depth`` have none; nor has an empty table.
    """
    base = base.select("doc", "text").where("text is not null")
    rows = base.mapInArrow(_segments(depth), _ROWS)
    found = []
    for level, width in enumerate(BANDS):
        known = _known(rows)
        first, number = F.shiftright("at", 14), F.shiftright("at", 7).bitwiseAND(127)
        found.append(known.where("copy").select("doc", first.alias("start"), (first + number - 1 + depth).alias("stop")))
        if width == 1:
            break
        once = known.where("not copy").select("key", "doc", "at")
        parts = cut(once.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "parts")
        asked = cut(join_unique(once, parts, ["key"], "n"), "asked")

        def bodies(some: DataFrame) -> DataFrame:
            lists = some.groupBy("doc").agg(F.collect_list(F.struct("key", "at")).alias("asked"))
            return lists.join(base, "doc").select("doc", "asked", "text")

        pieces = bodies(asked.where(F.col("n") <= max_segments)).mapInArrow(_pieces(depth), _PIECES)
        places = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_ordered(depth, BATCH), _SPANS)
        found.append(cut(places, "found"))
        large = asked.where(F.col("n") > max_segments)
        if not large.limit(1).count():
            break
        rows = cut(bodies(large).mapInArrow(_banded(depth, BANDS[level + 1]), _ROWS), "banded")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes, bytes removed, removed runs and bytes kept of each text."""
    for batch in batches:
        spans = batch.column(1)
        pairs = spans.flatten()
        begin, stop = (pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        valid = spans.is_valid().to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(np.where(valid, np.diff(spans.offsets.to_numpy()), 0))])
        for row, data, offsets in bw.chunks(batch.column(0)):
            raw = data.tobytes()
            gone, runs, kept = [], [], []
            for i in range(len(offsets) - 1):
                x, y = int(offsets[i]), int(offsets[i + 1])
                lo, hi = bounds[row + i], bounds[row + i + 1]
                if lo == hi:
                    gone.append(0), runs.append(0), kept.append(raw[x:y])
                    continue
                order = np.argsort(begin[lo:hi], kind="stable")
                a, b = begin[lo:hi][order], np.maximum.accumulate(stop[lo:hi][order])
                new = np.concatenate([[True], a[1:] > b[:-1]])  # ranges that touch are one run
                a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                gone.append(int((b - a).sum())), runs.append(len(a))
                kept.append(b"".join([raw[p:q] for p, q in zip([x, *(x + b).tolist()], [*(x + a).tolist(), y], strict=True)]))
            rest = [batch.column(i).slice(row, len(offsets) - 1) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), *rest],
                names=["n_bytes", "n_removed", "n_spans", "kept", *(f"c{i}" for i in range(len(rest)))],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _strip(batches):
        shas = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([batch.column(4), *batch.columns[:3], pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _spread(docs: DataFrame, doc_id: str, text: str, kept: list[str], **options) -> DataFrame:
    """(text, spans, c0, c1, ...): the columns ``kept`` under numbers, so that no name can clash."""
    body, ident = F.col(text).cast("string"), F.col(doc_id).cast("long")
    made = docs.select(body.alias("text"), ident.alias("doc"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)))
    base = made.where("doc is not null").select("doc", "text")
    if base.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        # Ids do not tell texts apart: numbers in order of id and text's hash do; a repeated row is one text.
        marked = made.withColumn("mark", F.xxhash64("text"))
        slim = marked.where("doc is not null").select("doc", "mark").distinct().orderBy("doc", "mark")
        ranks = cut(slim.select(F.col("doc").alias("_id"), F.col("mark").alias("_mark"), F.monotonically_increasing_id().alias("rank")), "ranks")
        made = marked.join(ranks, (F.col("doc") == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").withColumn("doc", F.col("rank"))
        base = made.where("doc is not null").groupBy("doc").agg(F.min("text").alias("text"))
    spans = repeated_bytes(base, **options)
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return made.join(lists, "doc", "left").select("text", "spans", *(f"c{i}" for i in range(len(kept))))


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without ``text``, but with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary).

    A byte goes if some string of ``depth`` bytes that covers it also starts earlier: in a document
    with a smaller id, or in the same one before. Strings are judged on the input and never reach over
    documents. Null and empty texts have no bytes. Rows with a null id lose nothing and no other row
    loses bytes to them; rows of one id with different texts are documents of their own, in order of
    their texts' xxhash64; repeated rows (one id, one text) are one document and are returned each.
    Very long texts are handled alone, by one task each. An empty table gives no rows. Other columns
    are returned as given; input columns named like the four new ones give way.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    kept = [f.name for f in docs.schema if f.name not in (text, *new)]
    kinds = "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    out = _spread(docs, doc_id, text, kept, **options).mapInArrow(_strip, f"n_bytes long, n_removed long, n_spans long, kept binary{kinds}")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *new)


def repeated_bytes_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``remove_repeated_bytes``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _spread(rows, "doc_id", "text", ["doc_id"], **options).mapInArrow(_digest, kinds)
