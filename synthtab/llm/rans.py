"""A static range coder for blocks of token ids: interleaved lanes, one shared table, checkpoints and checksums.

Step ``t`` codes the ids ``t * lanes .. (t + 1) * lanes`` of a block, one in
each lane.  A lane's state lies in [2^31, 2^63) and moves 32 bits at a time
through one word stream that all lanes share.  A checkpoint keeps all states
and the stream position every ``STRIDE`` steps, so parts of a block can be
decoded at the same time; here they are, side by side in one array.

Block layout, little-endian: ``magic u32, lanes u32, ids u64, stride u32,
checkpoints u32, crc32 of the ids u32, crc32 of the rest u32``, then states
``u64[checkpoints][lanes]``, positions ``u64[checkpoints]``, words ``u32[]``.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = 0x31534E52
SCALE = 20
LANES = 512
STRIDE = 256
LOW = np.uint64(1 << 31)
HEADER = struct.Struct("<IIQIIII")


@dataclass
class Table:
    """Frequencies that sum to 2^SCALE; ids never seen have none and cannot be coded."""

    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray

    @classmethod
    def of(cls, freq: np.ndarray) -> Table:
        freq = np.asarray(freq, np.uint64)
        start = (np.cumsum(freq) - freq).astype(np.uint64)
        return cls(freq, start, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^SCALE with at least 1 for every id that occurs."""
    counts, total = np.asarray(counts, np.float64), 1 << SCALE
    seen = counts > 0
    if not seen.any():
        counts, seen = counts + (np.arange(len(counts)) == 0), np.arange(len(counts)) == 0
    if seen.sum() > total:
        raise ValueError("more different ids than the table has places")
    freq = np.where(seen, 1, 0).astype(np.int64)
    share = counts / counts.sum() * (total - freq.sum())
    freq += np.floor(share).astype(np.int64)
    order = np.argsort(np.floor(share) - share, kind="stable")
    freq[order[: total - freq.sum()]] += 1
    return freq


def encode(ids: np.ndarray, table: Table) -> bytes:
    ids = np.asarray(ids, np.int64)
    checksum = zlib.crc32(ids.astype("<u4").tobytes())
    steps = -(-len(ids) // LANES)
    grid = np.full(steps * LANES, int(np.argmax(table.freq)), np.int64)
    grid[: len(ids)] = ids
    freq, start = table.freq[grid].reshape(steps, LANES), table.start[grid].reshape(steps, LANES)
    if len(ids) and not freq.all():
        raise ValueError("an id is missing from the table")
    limit = freq << np.uint64(63 - SCALE)
    state = np.full(LANES, LOW, np.uint64)
    words, sizes = [], np.zeros(steps, np.int64)
    checkpoints = -(-steps // STRIDE)
    states = np.empty((checkpoints, LANES), "<u8")
    shift, scale = np.uint64(32), np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        full = state >= limit[t]
        if full.any():
            out = state[full].astype(np.uint32)
            words.append(out)
            sizes[t] = len(out)
            state = np.where(full, state >> shift, state)
        times, left = np.divmod(state, freq[t])
        state = (times << scale) + left + start[t]
        if t % STRIDE == 0:
            states[t // STRIDE] = state
    before = np.cumsum(sizes) - sizes
    body = states.tobytes() + before[::STRIDE].astype("<u8").tobytes()
    body += np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    return HEADER.pack(MAGIC, LANES, len(ids), STRIDE, checkpoints, checksum, zlib.crc32(body)) + body


def decode(block: bytes, table: Table) -> np.ndarray:
    """The ids of a block; a damaged block is an error."""
    magic, lanes, count, stride, checkpoints, checksum, body_sum = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size :]
    if magic != MAGIC or zlib.crc32(body) != body_sum:
        raise ValueError("damaged token block")
    states = np.frombuffer(body, "<u8", checkpoints * lanes).reshape(checkpoints, lanes).astype(np.uint64)
    place = np.frombuffer(body, "<u8", checkpoints, checkpoints * lanes * 8).astype(np.int64)
    stream = np.frombuffer(body, "<u4", offset=checkpoints * (lanes + 1) * 8).astype(np.uint64)
    stream = np.append(stream, np.uint64(0))
    steps = -(-count // lanes)
    out = np.zeros((checkpoints, stride, lanes), np.uint32)
    mask, scale, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for t in range(min(stride, steps)):
        # Only the last part can be shorter than the stride.
        n = checkpoints if (checkpoints - 1) * stride + t < steps else checkpoints - 1
        state = states[:n]
        slot = state & mask
        symbol = table.symbol[slot]
        out[:n, t] = symbol
        state = table.freq[symbol] * (state >> scale) + slot - table.start[symbol]
        need = state < LOW
        taken = np.cumsum(need, axis=1)
        at = np.where(need, place[:n, None] + taken - 1, 0)
        states[:n] = np.where(need, (state << shift) | stream[at], state)
        place[:n] += taken[:, -1]
    ids = out.reshape(-1)[:count]
    if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
        raise ValueError("damaged token block")
    return ids
