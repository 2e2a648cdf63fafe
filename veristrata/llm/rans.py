"""Static range asymmetric numeral system (rANS) over token ids, vectorized over interleaved lanes.

A frame of ids has one frequency table, which all of its blocks share. Every block holds ``BLOCK`` ids in ``LANES``
interleaved lanes (id i goes to lane i mod LANES) and can be decoded alone: its checkpoint gives the place of its
first word, its number of ids, the final lane states and the crc32 of its ids. States are 64-bit, renormalized by
32-bit words, with frequencies that sum to 2**BITS.

Layout (little endian): header ``<4sHHIIII`` (magic, version, lanes, block, ids, symbols, blocks), symbols uint32,
frequencies uint32, then per block word offset uint32 and crc32 uint32, lane states uint64 (blocks x lanes), words
uint32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"VRAN", 1
BITS, LANES, BLOCK = 18, 32, 16_384
LOW = np.uint64(1 << 31)
_HEAD = "<4sHHIIII"


def quantize(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**bits, close to the counts (all above 0)."""
    n = len(counts)
    if n > 1 << bits:
        raise ValueError(f"{n} symbols do not fit {bits} bits")
    freq = 1 + (counts.astype(np.float64) * ((1 << bits) - n) / max(1, counts.sum())).astype(np.int64)
    freq[int(np.argmax(counts))] += (1 << bits) - int(freq.sum())
    return freq


def encode(ids: np.ndarray) -> bytes:
    """One frame. Empty input gives a frame without blocks."""
    n = len(ids)
    if not n:
        return struct.pack(_HEAD, MAGIC, VERSION, LANES, BLOCK, 0, 0, 0)
    counts = np.bincount(ids)  # ids come from a vocabulary, so the table of counts is short
    symbols = np.flatnonzero(counts)
    rank = np.zeros(len(counts), dtype=np.int32)
    rank[symbols] = np.arange(len(symbols), dtype=np.int32)
    counts, dense = counts[symbols], rank[ids]
    freq = quantize(counts)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    freq = freq.astype(np.uint64)
    blocks, steps = -(-n // BLOCK), BLOCK // LANES
    padded = np.full(blocks * BLOCK, -1, dtype=np.int32)
    padded[:n] = dense
    table = padded.reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), LOW, dtype=np.uint64)
    words = np.zeros((steps, blocks, LANES), dtype=np.uint32)
    used = np.zeros((steps, blocks, LANES), dtype=bool)
    limit = np.uint64(((1 << 31) >> BITS) << 32)
    whole = n == blocks * BLOCK
    for t in range(steps - 1, -1, -1):
        s = table[:, t, :]
        live = None if whole else s >= 0
        f, c = freq[s], cum[s]
        over = state >= limit * f
        if live is not None:
            over &= live
        used[t] = over
        words[t] = state & np.uint64(0xFFFFFFFF)
        x = np.where(over, state >> np.uint64(32), state)
        q = x // f
        new = (q << np.uint64(BITS)) + (x - q * f) + c
        state = new if live is None else np.where(live, new, state)
    per_block = used.sum(axis=(0, 2))
    flat = [words[:, b, :][used[:, b, :]] for b in range(blocks)]
    places = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4")
    ids32 = np.ascontiguousarray(ids, dtype="<u4")
    crc = np.array([zlib.crc32(ids32[b * BLOCK : (b + 1) * BLOCK]) for b in range(blocks)], dtype="<u4")
    head = struct.pack(_HEAD, MAGIC, VERSION, LANES, BLOCK, n, len(symbols), blocks)
    return b"".join([head, symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), places.tobytes(), crc.tobytes(), state.astype("<u8").tobytes(), *(x.astype("<u4").tobytes() for x in flat)])


def decode(frame: bytes, only: list[int] | None = None) -> np.ndarray:
    """Ids of a frame, or of some of its blocks in the order given; every block is held against its checksum."""
    magic, version, lanes, block, n, n_symbols, blocks = struct.unpack_from(_HEAD, frame)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a frame of token ids")
    if not n:
        return np.zeros(0, dtype=np.uint32)
    at = struct.calcsize(_HEAD)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(frame, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    symbols, freq32 = take("<u4", n_symbols), take("<u4", n_symbols)
    places, crc = take("<u4", blocks).astype(np.int64), take("<u4", blocks)
    state = take("<u8", blocks * lanes).reshape(blocks, lanes)
    words = np.frombuffer(frame, dtype="<u4", offset=at).astype(np.uint64)
    chosen = np.arange(blocks) if only is None else np.array(only, dtype=np.int64)
    sizes = np.minimum(block, n - chosen * block)
    steps = block // lanes
    freq = freq32.astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slot_symbol = np.repeat(np.arange(n_symbols, dtype=np.int32), freq32)
    x, pointer = state[chosen].copy(), places[chosen]
    out = np.zeros((len(chosen), steps, lanes), dtype=np.int32)
    lane = np.arange(lanes)
    mask = np.uint64((1 << BITS) - 1)
    whole = bool((sizes == block).all())
    words = np.concatenate([words, np.zeros(lanes + 1, dtype=np.uint64)])
    for t in range(steps):
        slot = x & mask
        s = slot_symbol[slot.astype(np.int64)]
        new = freq[s] * (x >> np.uint64(BITS)) + slot - cum[s]
        low = new < LOW
        if not whole:
            live = t * lanes + lane[None, :] < sizes[:, None]
            low &= live
        order = np.cumsum(low, axis=1)
        read = words[np.minimum(pointer[:, None] + order - 1, len(words) - 1)]
        new = np.where(low, (new << np.uint64(32)) | read, new)
        x = new if whole else np.where(live, new, x)
        out[:, t, :] = s
        pointer = pointer + order[:, -1]
    ids = symbols[out.reshape(len(chosen), block)]
    parts = [ids[i, : sizes[i]] for i in range(len(chosen))]
    for i, b in enumerate(chosen):
        if zlib.crc32(np.ascontiguousarray(parts[i], dtype="<u4")) != crc[b]:
            raise ValueError(f"block {b} fails its checksum")
    return np.concatenate(parts)


def n_blocks(frame: bytes) -> int:
    return struct.unpack_from(_HEAD, frame)[6]
