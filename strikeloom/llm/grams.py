"""Hashes of words and of runs of words over whole Arrow batches, by numpy alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values: a published 64-bit finaliser


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each text begins (one more for the end)."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
        kind = np.int64
    else:
        column = column.cast(pa.binary())
        kind = np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


def _blank(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _hashed(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word; ``begins`` are places where a word ends even without a blank."""
    inside = ~_blank(raw)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), at
    # a word's hash: its bytes times powers of BASE counted from the word's start, summed
    group = np.maximum(np.cumsum(first, dtype=np.int32) - 1, 0)
    offset = np.where(inside, np.arange(len(raw)) - at[group], 0).astype(np.int32)
    powers = np.ones(int(offset.max()) + 1, np.uint64)
    powers[1:] = np.cumprod(np.full(len(powers) - 1, BASE, np.uint64))
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    value = powers[offset]
    value *= low.astype(np.uint64) + np.uint64(1)
    value[~inside] = 0
    return mixed(np.add.reduceat(value, at)), at


def words(column: pa.Array, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (lower-case ASCII, split at ASCII blanks) of the texts, and where each text's words begin.

    Works through the bytes in blocks that end at blanks, so that memory follows
    the block and not the longest text.
    """
    raw, starts = utf8(column)
    begins = np.unique(starts[:-1][starts[:-1] < len(raw)])
    hashes, places, at = [], [], 0
    while at < len(raw):
        stop = min(at + block, len(raw))
        while stop < len(raw):
            blanks = np.flatnonzero(_blank(raw[at:stop]))
            if len(blanks):
                stop = at + int(blanks[-1]) + 1
                break
            stop = min(stop + block, len(raw))
        inner = begins[np.searchsorted(begins, at) : np.searchsorted(begins, stop)] - at
        h, p = _hashed(raw[at:stop], inner)
        hashes.append(h)
        places.append(p + at)
        at = stop
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return found, np.searchsorted(np.concatenate(places) if places else np.zeros(0, np.int64), starts)


def runs(hashes: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, and where each text's runs begin; a shorter text with words is one run."""
    counts = np.diff(begins)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_begins = np.concatenate([[0], np.cumsum(n)])
    if not out_begins[-1]:
        return np.zeros(0, np.uint64), out_begins
    text = np.repeat(np.arange(len(counts)), n)
    at = begins[:-1][text] + np.arange(out_begins[-1]) - out_begins[:-1][text]
    end = begins[1:][text]
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        there = at + k < end
        part = np.where(there, hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(k + 1))
        value = mixed(value * BASE + part)
    return value, out_begins
