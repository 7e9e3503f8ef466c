"""Best-fit packing of token sequences.

Documents are cut into pieces of at most ``capacity`` tokens, and the pieces are packed by
best-fit decreasing: each goes to the tightest open sequence that still holds it. Lengths
are integers from 1 to ``capacity``, so sequences with equal room are interchangeable and the
plan is made on counts: a segment tree over remaining room (one leaf for each value) finds the
tightest open class in logarithmic time, and a whole run of equal pieces moves at once. The
outcome is the one of best-fit decreasing, piece by piece; the driver holds a histogram and
a plan whose sizes follow ``capacity``, not the data. Pieces then take their places from
their rank among pieces of equal length, in parallel.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .ranks import with_rank
from .scratch import cut

#: Parts whose ids a worker remembers (some 40 bytes each); beyond it starts anew. It never
#: changes results.
REMEMBERED = 2_000_000


class RoomTree:
    """Segment tree over remaining room: leaf r holds the number of open sequences with room r."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, count: int) -> None:
        at = self.size + room
        while at:
            self.tree[at] += count
            at >>= 1

    def tightest(self, need: int) -> int:
        """Smallest room >= need with an open sequence, or -1."""
        at = self.size + need
        if self.tree[at]:
            return need
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset) of runs of equal pieces.

    Ranks count pieces of one length from 0; a run's pieces go to consecutive sequences.
    """
    tree, open_runs, out, sequences = RoomTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            fresh = room < 0
            if fresh:
                room, first, number = capacity, sequences, left
            else:
                first, number = open_runs[room].pop()
            # Once it has taken a piece, a sequence is tighter than its like, so it takes all of
            # these pieces that it can hold before the next one takes any.
            each = min(room // length, left)
            take = min(left // each, number)
            for j in range(each):
                out.append((length, rank, take, first, capacity - room + j * length))
                rank, left = rank + take, left - take
            rest = room - each * length
            open_runs.setdefault(rest, []).append((first, take))
            tree.add(rest, take)
            if fresh:
                sequences += take
            else:
                tree.add(room, -take)
                if take < number:
                    open_runs[room].append((first + take, number - take))
    return out


class _Encoder:
    """Token ids of whole texts from remembered ids of their parts.

    The tokenizer folds case, drops white space, and never joins what white space parts; nor
    does it join an ASCII letter with ASCII punctuation other than an apostrophe. A text's ids
    are therefore its parts' ids one after another. Unknown parts go through the tokenizer
    together, with a control character between them. A chunk that holds "<|", as the special
    tokens do, is split at white space alone and keeps its case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, dtype=np.int64)
        #: Sorted keys with where their ids begin and how many: a large table and a recent one.
        self.known = [(np.zeros(0, dtype=np.uint64), none, none), (np.zeros(0, dtype=np.uint64), none, none)]
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _tokenized(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part."""
        if self.mark is None or any("\x01" in p for p in parts):
            return [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode(" \x01 ".join(parts), add_special_tokens=False).ids, dtype=np.uint32)
        return np.split(ids, np.flatnonzero(ids == self.mark))

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        raw = data.tobytes()
        fresh, count = [], []
        for at in range(0, len(starts), 512):
            texts = [raw[a:b].decode("utf-8") for a, b in zip(starts[at : at + 512].tolist(), ends[at : at + 512].tolist(), strict=True)]
            made = self._tokenized(texts)
            if isinstance(made[0], np.ndarray):  # all but the first begin with the mark
                made = [made[0], *(x[1:] for x in made[1:])]
            fresh += [np.asarray(x, dtype=np.uint32) for x in made]
            count += [len(x) for x in made]
        fresh, count = np.concatenate(fresh), np.array(count, dtype=np.int64)
        begin = self.used + np.cumsum(count) - count
        if self.used + len(fresh) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(fresh), dtype=np.uint32)])
        self.ids[self.used : self.used + len(fresh)] = fresh
        self.used += len(fresh)
        self.known[1] = self._merged(self.known[1], (keys, begin, count))
        if len(self.known[1][0]) > 200_000:
            self.known = [self._merged(*self.known), tuple(x[:0] for x in self.known[1])]

    @staticmethod
    def _merged(into: tuple, new: tuple) -> tuple:
        order = np.argsort(new[0])
        at = np.searchsorted(into[0], new[0][order])
        return tuple(np.insert(a, at, b[order]) for a, b in zip(into, new, strict=True))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each key begin, and how many; -1 if unknown."""
        begin, count = np.full(len(keys), -1), np.zeros(len(keys), dtype=np.int64)
        for table, b, c in self.known:
            if len(table):
                at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                hit = table[at] == keys
                begin[hit], count[hit] = b[at[hit]], c[at[hit]]
        return begin, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each row's first one (one entry more than rows)."""
        starts, ends, first = bw.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        special = bool(((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any())
        if not special:
            kind = _KIND[data]
            apart = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1  # a letter (1) beside a sign (2)
            row = np.searchsorted(offsets, apart)
            apart = apart[offsets[row] != apart]
            starts, ends = np.sort(np.concatenate([starts, apart])), np.sort(np.concatenate([ends, apart]))
            first = np.searchsorted(starts, offsets)
        keys, index, inverse = np.unique(bw.word_hashes(data, starts, ends, lower=not special), return_index=True, return_inverse=True)
        if special:
            keys ^= np.uint64(0x2545F4914F6CDD1D)
        if sum(len(t[0]) for t in self.known) > REMEMBERED:
            self.forget()
        begin, count = self._find(keys)
        new = begin < 0
        if new.any():
            self._learn(data, starts[index[new]], ends[index[new]], keys[new])
            begin, count = self._find(keys)
        begin, count = begin[inverse], count[inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        spread = np.repeat(begin - total[:-1], count) + np.arange(total[-1])
        return self.ids[spread], total[first]


_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = 2

_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    """One encoder in a worker process, whatever its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        stop = np.array([end_id], dtype="<u4")
        for batch in batches:
            for row, data, offsets in bw.chunks(batch.column(1)):
                ids, first = encoder.encode(data, offsets)
                rows, piece, start, length, crc = [], [], [], [], []
                for i in range(len(offsets) - 1):
                    own = np.concatenate([ids[first[i] : first[i + 1]], stop]).astype("<u4")
                    for number, a in enumerate(range(0, len(own), capacity)):
                        part = own[a : a + capacity]
                        rows.append(row + i)
                        piece.append(number)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.data))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def tokenize_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row; a null or empty text is the end id alone."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _place(runs):
    """Sequence and offset of ranked pieces, by the plan's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rank0, sequence, offset = runs.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(key, (length.astype(np.uint64) << np.uint64(44)) | rank.astype(np.uint64), side="right") - 1
            cols = [batch.column(i) for i in range(5)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence[at] + rank - rank0[at]), pa.array(offset[at])], names=names)

    return run


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, packed by best-fit decreasing.

    ``pieces`` is read more than once, so it should be a written table. Equal pieces keep
    the order of (doc_id, piece); repeated rows get places of their own. An empty table
    packs into no sequence. Fewer than 2**44 pieces may share one length.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = sorted(plan(counts, capacity))
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    key = (table[:, 0].astype(np.uint64) << np.uint64(44)) | table[:, 1].astype(np.uint64)
    sent = spark.sparkContext.broadcast((key, table[:, 1], table[:, 3], table[:, 4]))
    ranked = with_rank(pieces, "length", ["doc_id", "piece", "ids_crc32"], "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_place(sent), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize, cut and pack all rows of ``docs``; see ``tokenize_pieces`` and ``pack``."""
    return pack(cut(tokenize_pieces(docs, tokenizer, doc_id, text, capacity, end_id), "pieces"), capacity)
