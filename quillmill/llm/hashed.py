"""Hashed text features over Arrow columns, for whole texts."""

from __future__ import annotations

import numpy as np

from . import bytewords as bw

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")

_BARE = np.full(256, 0x20, dtype=np.uint8)  # what is not a letter or digit parts words
for _lo, _hi in (("a", "z"), ("0", "9")):
    _BARE[ord(_lo) : ord(_hi) + 1] = np.arange(ord(_lo), ord(_hi) + 1)
_BARE[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BARE[0x80:] = np.arange(0x80, 0x100)

_LETTERS = _BARE.copy()
_LETTERS[ord("0") : ord("9") + 1] = 0x20


def distinct(rows: np.ndarray, hashes: np.ndarray, bits: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct feature numbers, and where each row's begin (one entry more)."""
    keys = (rows.astype(np.uint64) << np.uint64(bits)) | (hashes & np.uint64((1 << bits) - 1))
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    start = np.searchsorted(keys, np.arange(count + 1, dtype=np.uint64) << np.uint64(bits))
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), start


def style_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indicators of words (A-Z folded) and of runs of one to three word shapes.

    A shape keeps the kinds of a word's characters: letter case, digits, and each sign itself,
    without repeats.
    """
    starts, ends, first = bw.words(data, offsets)
    hashes = [bw.word_hashes(data, starts, ends, lower=True)]
    at = [np.arange(len(starts))]
    shape = _SHAPE[data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    index = np.flatnonzero(keep)
    short, cut = shape[index], np.searchsorted(index, offsets)
    a, b, begin = bw.words(short, cut)
    shapes = bw.word_hashes(short, a, b)
    for k in (1, 2, 3):
        where, grams = bw.gram_hashes(shapes, begin, k)
        at.append(where)
        hashes.append(bw.mix(grams ^ np.uint64(0x5F00 + k)))
    return distinct(bw.rows_of(first, np.concatenate(at)), np.concatenate(hashes), bits, len(offsets) - 1)


def term_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indicators of bare lower-case words and pairs of neighbours; signs part words."""
    bare = _BARE[data]
    starts, ends, first = bw.words(bare, offsets)
    words = bw.word_hashes(bare, starts, ends)
    where, pairs = bw.gram_hashes(words, first, 2)
    rows = bw.rows_of(first, np.concatenate([np.arange(len(starts)), where]))
    return distinct(rows, np.concatenate([words, pairs]), bits, len(offsets) - 1)


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-case letters, the rest as spaces; Latin-1 capitals are folded as well."""
    plain = _LETTERS[data]
    if len(plain) > 1:
        after = np.zeros(len(plain), dtype=bool)
        after[1:] = data[:-1] == 0xC3
        plain[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return plain


def letter_grams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature number of the three- and four-byte gram at each place: two numbers a byte, and bytes a row.

    Grams that would reach over a row's end, or hold spaces alone, get number 0.
    """
    plain = letter_bytes(data).astype(np.uint64)
    n = len(plain)
    out = np.zeros((2, n), dtype=np.int64)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    code = plain.copy()
    for size in (2, 3, 4):
        code[: n - size + 1] = code[: n - size + 1] << np.uint64(8) | plain[size - 1 :]
        if size > 2:
            hashed = (bw.mix(code + np.uint64(size << 40)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            hashed[(room < size) | (plain == 0x20)] = 0
            out[size - 3] = hashed
    return out, np.diff(offsets)
