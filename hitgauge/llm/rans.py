"""Static range asymmetric numeral system over whole numbers, in interleaved blocks.

A block is ``LANES`` independent coders: number i of the block belongs to lane i mod LANES, so one step
codes a row of LANES numbers at once. Every ``CHECK_ROWS`` rows a checkpoint keeps all lanes' states and the
place in the words, so that each stretch between checkpoints can be decoded alone; a stretch must end in
the state of the next checkpoint, and the block ends with a CRC-32.

Block, little endian: magic, bits of the table's total, lanes, rows between checkpoints, number of coded
numbers, checkpoints, words, CRC-32 of the table; then per checkpoint its place in the words (u32) and its
states (u64 each); the words (u32); the CRC-32 of all that (u32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format.
MAGIC = b"RNS1"
HEADER = struct.Struct("<4sIIIQIII")
LANES, CHECK_ROWS = 1024, 256
LOW = np.uint64(1 << 31)
WORD, MASK = np.uint64(32), np.uint64((1 << 32) - 1)


class Table:
    """Frequencies that sum to 2**bits, with at least 1 for every number that was counted."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._symbols: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_symbols": None}

    @property
    def symbols(self) -> np.ndarray:
        """The number at each of the 2**bits places."""
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbols


def table_from_counts(counts: np.ndarray) -> Table:
    """Scale counts to frequencies; what rounding adds or leaves goes to the most frequent numbers."""
    bits = max(20, int(len(counts) - 1).bit_length() + 3)
    total = 1 << bits
    counts = counts.astype(np.float64)
    if not counts.sum():
        counts = np.ones(len(counts))
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (total / counts.sum()))), 0).astype(np.int64)
    by = np.argsort(-freq, kind="stable")
    left = total - int(freq.sum())
    if left >= 0:
        freq[by[0]] += left
    else:  # take from the largest, each keeping half of what it has
        room = np.cumsum(freq[by] // 2)
        cut = int(np.searchsorted(room, -left))
        freq[by[:cut]] -= freq[by[:cut]] // 2
        freq[by[cut]] -= -left - (int(room[cut - 1]) if cut else 0)
    return Table(freq, bits)


def encode(numbers: np.ndarray, table: Table) -> bytes:
    """One block."""
    n = len(numbers)
    rows = -(-n // LANES)
    freq, start = table.freq[numbers], table.start[numbers]
    limit = freq << np.uint64(63 - table.bits)
    bits = np.uint64(table.bits)
    states = np.full(LANES, LOW, np.uint64)
    chunks: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for row in range(rows - 1, -1, -1):
        a, b = row * LANES, min(n, (row + 1) * LANES)
        x = states[: b - a]
        full = x >= limit[a:b]
        chunk = (x[full] & MASK).astype("<u4")
        x = np.where(full, x >> WORD, x)
        quotient, rest = np.divmod(x, freq[a:b])
        states[: b - a] = (quotient << bits) + rest + start[a:b]
        chunks.append(chunk)
        written += len(chunk)
        if row % CHECK_ROWS == 0:
            marks.append((written, states.copy()))
    marks.reverse()
    parts = [HEADER.pack(MAGIC, table.bits, LANES, CHECK_ROWS, n, len(marks), written, table.crc)]
    for upto, state in marks:
        parts += [struct.pack("<I", written - upto), state.astype("<u8").tobytes()]
    parts += [c.tobytes() for c in reversed(chunks)]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def checkpoints(block: bytes) -> tuple[int, int, list[tuple[int, np.ndarray]], np.ndarray]:
    """(numbers, rows between checkpoints, checkpoints, words) of a block whose checksum holds."""
    body, crc = block[:-4], struct.unpack("<I", block[-4:])[0]
    if zlib.crc32(body) != crc:
        raise ValueError("a block's checksum does not hold")
    magic, _, lanes, step, n, marks, words, _ = HEADER.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at, out = HEADER.size, []
    for _ in range(marks):
        place = struct.unpack_from("<I", body, at)[0]
        out.append((place, np.frombuffer(body, "<u8", lanes, at + 4).astype(np.uint64)))
        at += 4 + 8 * lanes
    return n, step, out, np.frombuffer(body, "<u4", words, at)


def decode_stretch(block: bytes, number: int, table: Table) -> np.ndarray:
    """The numbers between one checkpoint and the next; needs nothing before the checkpoint."""
    n, step, marks, words = checkpoints(block)
    return _stretch(n, step, marks, words, number, table)


def _stretch(n: int, step: int, marks: list, words: np.ndarray, number: int, table: Table) -> np.ndarray:
    at, state = marks[number]
    x, lanes = state.copy(), len(state)
    first, stop = number * step * lanes, min(n, (number + 1) * step * lanes)
    out = np.empty(stop - first, np.uint32)
    symbols, bits, mask = table.symbols, np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    for a in range(first, stop, lanes):
        b = min(stop, a + lanes)
        now = x[: b - a]
        slot = now & mask
        found = symbols[slot]
        out[a - first : b - first] = found
        now = table.freq[found] * (now >> bits) + slot - table.start[found]
        low = np.flatnonzero(now < LOW)
        now[low] = (now[low] << WORD) | words[at : at + len(low)].astype(np.uint64)
        at += len(low)
        x[: b - a] = now
    end = marks[number + 1] if number + 1 < len(marks) else (len(words), np.full(lanes, LOW, np.uint64))
    if at != end[0] or not np.array_equal(x, end[1]):
        raise ValueError("a stretch does not end in the state of its next checkpoint")
    return out


def decode(block: bytes, table: Table) -> np.ndarray:
    """All numbers of a block."""
    if HEADER.unpack_from(block)[7] != table.crc or HEADER.unpack_from(block)[1] != table.bits:
        raise ValueError("the block was written with another table")
    n, step, marks, words = checkpoints(block)
    return np.concatenate(
        [_stretch(n, step, marks, words, i, table) for i in range(len(marks))] or [np.zeros(0, np.uint32)]
    )
