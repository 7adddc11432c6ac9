"""Simple-8b: whole numbers packed into 64-bit words.

The top four bits of a word are its selector, which says how many values of how many bits the other sixty hold, the
first value lowest. Two selectors stand for long runs of zeros. Values are coded in blocks of `block` values; every
block begins a word, and its word offset is kept, so a block is decoded without those before it and all blocks of a
stream at once. A block's last word may promise more values than the block has: those are not read.

A value that does not fit, or that is so rare and wide in its block that it costs less apart, is an escape: the words
hold a zero in its place, and a list beside them its position and its value. Any unsigned 64-bit value can be coded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: How many values a selector packs, and their bits.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
#: Bytes of an escape: its position and its value.
ESCAPE_BYTES = 12
WIDTHS = BITS[2:]


@dataclass
class Stream:
    """words: uint64; offsets: the word at which each block begins; escape_at, escaped: positions in the stream and values."""

    n: int
    words: np.ndarray
    offsets: np.ndarray
    escape_at: np.ndarray
    escaped: np.ndarray
    block: int = BLOCK


def bits_of(values: np.ndarray) -> np.ndarray:
    """Binary digits of unsigned values."""
    out = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    wide = np.flatnonzero(values >> np.uint64(53))  # a float may round these up to the next power of two
    out[wide] = 53 + np.frexp((values[wide] >> np.uint64(53)).astype(np.float64))[1]
    return out


def _escape_widths(bits: np.ndarray, block: int) -> np.ndarray:
    """For each block the widest value that it packs: what lies above costs less as escapes than the words that it would widen.

    The packer mixes widths, so escapes pay only where they are few; any other block packs whatever fits into a word.
    """
    blocks = -(-len(bits) // block)
    held = np.bincount(np.arange(len(bits)) // block * 65 + bits, minlength=65 * blocks).reshape(blocks, 65)
    sizes = held.sum(axis=1, keepdims=True)
    outside = sizes - np.cumsum(held, axis=1)[:, WIDTHS]
    cost = sizes * WIDTHS / 7.5 + ESCAPE_BYTES * outside  # sixty of 64 bits hold values
    pick = cost.shape[1] - 1 - np.argmin(cost[:, ::-1], axis=1)
    few = np.take_along_axis(outside, pick[:, None], 1)[:, 0] * 64 <= sizes[:, 0]
    return np.where(few | (held[:, 61:].sum(axis=1) > 0), WIDTHS[pick], 60)


def _choices(bits: np.ndarray) -> np.ndarray:
    """For each position the selector that packs the most values from there on. bits: with zeros for COUNTS[0] beyond the end."""
    n = len(bits) - int(COUNTS[0])
    choice = np.full(n, len(COUNTS) - 1, np.uint8)
    most, reach = bits, 1  # most[i]: the widest of bits[i : i + reach]
    for selector in range(len(COUNTS) - 2, -1, -1):
        count = int(COUNTS[selector])
        while reach < count:
            step = min(reach, count - reach)
            most = np.maximum(most[: len(most) - step], most[step:])
            reach += step
        choice[most[:n] <= BITS[selector]] = selector
    return choice


def encode(values: np.ndarray, block: int = BLOCK) -> Stream:
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    bits = bits_of(values)
    starts = np.arange(0, n, block)
    escape_at = np.flatnonzero(bits > np.repeat(_escape_widths(bits, block), np.diff(np.append(starts, n))))
    escaped = values[escape_at]
    if len(escape_at):
        values, bits = values.copy(), bits.copy()
        values[escape_at] = bits[escape_at] = 0
    padded = np.concatenate([bits, np.zeros(int(COUNTS[0]), np.uint8)])
    choice = _choices(padded)
    jump, picks, offsets = COUNTS[choice].tolist(), [], []
    for a in starts.tolist():
        offsets.append(len(picks))
        at, end = a, min(a + block, n)
        while at < end:
            picks.append(at)
            at += jump[at]
    at = np.array(picks, np.int64)
    ends = np.minimum(at // block * block + block, n) if n else at
    words = np.zeros(len(at), np.uint64)
    selectors = choice[at] if n else np.zeros(0, np.uint8)
    longer = np.concatenate([values, np.zeros(int(COUNTS[0]), np.uint64)])
    for selector in np.unique(selectors).tolist():
        count, width = int(COUNTS[selector]), int(BITS[selector])
        mine = np.flatnonzero(selectors == selector)
        first, end = at[mine], ends[mine]
        packed = np.full(len(mine), selector << 60, np.uint64)
        for i in range(count if width else 0):
            value = longer[first + i] << np.uint64(i * width)
            if i:
                value[first + i >= end] = 0
            packed |= value
        words[mine] = packed
    return Stream(n, words, np.array(offsets, np.uint32), escape_at.astype(np.uint32), escaped, block)


def decode(stream: Stream, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of the blocks first to last (not included), all blocks at once."""
    blocks = len(stream.offsets)
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, np.uint64)
    offsets = np.append(stream.offsets, len(stream.words)).astype(np.int64)
    words = stream.words[offsets[first] : offsets[last]]
    per_block = np.diff(offsets[first : last + 1])
    start, end = first * stream.block, min(last * stream.block, stream.n)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    before = np.cumsum(counts) - counts
    heads = np.repeat(offsets[first:last] - offsets[first], per_block)
    block = np.repeat(np.arange(first, last), per_block)
    at = block * stream.block + before - before[heads] - start
    ends = np.minimum((block + 1) * stream.block, stream.n) - start
    out = np.zeros(end - start, np.uint64)
    for selector in np.unique(selectors).tolist():
        count, width = int(COUNTS[selector]), int(BITS[selector])
        if not width:
            continue
        mine = np.flatnonzero(selectors == selector)
        mask = np.uint64((1 << width) - 1)
        first, left, packed = at[mine], ends[mine] - at[mine], words[mine]
        for i in range(count):
            inside = left > i
            out[first[inside] + i] = packed[inside] >> np.uint64(i * width) & mask
    mine = (stream.escape_at >= start) & (stream.escape_at < end)
    out[stream.escape_at[mine].astype(np.int64) - start] = stream.escaped[mine]
    return out
