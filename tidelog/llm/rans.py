"""A static range asymmetric numeral system coder over many interleaved lanes, in numpy.

A block holds up to BLOCK ids. Id i belongs to lane i mod lanes; all lanes share the block's stream of 32-bit words and the
corpus-wide frequency table. Every CHECKPOINT steps the lanes' states and the place in the stream are noted, so decoders
can start there side by side. Header and body carry checksums; a block is decoded without any other.

Block, little-endian: magic "TRN1", ids u32, lanes u32, step between checkpoints u32, words u32, checkpoints u32,
crc32 of the ids as u32 each, crc32 of what follows; lane states u64 each; checkpoints (place u32, states u64 each); words u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
LOW = 1 << 31
BLOCK = 1 << 20
CHECKPOINT = 128
_HEAD = struct.Struct("<4s7I")
_U = np.uint64


class Frequencies:
    """Counts scaled to 2**BITS; every id that occurs has at least one part."""

    def __init__(self, counts: np.ndarray):
        total = int(counts.sum())
        if np.count_nonzero(counts) > 1 << (BITS - 1):
            raise ValueError("more distinct ids than half the parts")
        self.freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * (1 << BITS) // max(total, 1)), 0).astype(np.int64)
        spare = (1 << BITS) - int(self.freq.sum())
        if total:
            if spare >= 0:
                self.freq[self.freq.argmax()] += spare
            while spare < 0:  # each part above the first can give one
                order = np.argsort(-self.freq, kind="stable")[: -spare]
                give = order[self.freq[order] > 1]
                self.freq[give] -= 1
                spare += len(give)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]])
        self.slot = np.repeat(np.arange(len(counts), dtype=np.uint32), self.freq)
        self.freq, self.start = self.freq.astype(_U), self.start.astype(_U)


def _lanes(n: int) -> int:
    return 1 << max(0, min(12, (n // 256).bit_length() - 1)) if n >= 256 else 1


def encode_block(ids: np.ndarray, table: Frequencies) -> bytes:
    n, lanes = len(ids), _lanes(len(ids))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, dtype=_U)
    words: list[np.ndarray] = []
    noted: list[tuple[int, np.ndarray]] = []
    count = 0
    freq, start = table.freq[ids], table.start[ids]
    for step in range(steps - 1, -1, -1):
        f, c = freq[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= f << _U(63 - BITS)
        out = x[full]
        if len(out):
            words.append((out & _U(0xFFFFFFFF)).astype(np.uint32))
            count += len(out)
            x[full] = out >> _U(32)
        q = x // f
        state[: len(f)] = (q << _U(BITS)) + (x - q * f) + c
        if step and step % CHECKPOINT == 0:  # a decoder that starts with this step
            noted.append((count, state.copy()))
    words.reverse()
    stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
    body = [state.tobytes()]
    for place, states in reversed(noted):
        body += [struct.pack("<I", count - place), states.tobytes()]
    body = b"".join([*body, stream.astype("<u4").tobytes()])
    head = (b"TRN1", n, lanes, CHECKPOINT, count, len(noted), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body))
    return _HEAD.pack(*head) + body


class Block:
    """An encoded block at an offset of a buffer."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.n, self.lanes, self.every, self.words, marks, self.crc, body_crc = _HEAD.unpack_from(data, at)
        if magic != b"TRN1":
            raise ValueError("not a block")
        at += _HEAD.size
        self.end = at + 8 * self.lanes * (1 + marks) + 4 * marks + 4 * self.words
        if zlib.crc32(data[at : self.end]) != body_crc:
            raise ValueError("the block's body doesn't match its checksum")
        self.marks = [(0, np.frombuffer(data, "<u8", self.lanes, at).astype(_U))]
        at += 8 * self.lanes
        for _ in range(marks):
            self.marks.append((struct.unpack_from("<I", data, at)[0], np.frombuffer(data, "<u8", self.lanes, at + 4).astype(_U)))
            at += 4 + 8 * self.lanes
        self.stream = np.frombuffer(data, "<u4", self.words, at)

    def decode(self, table: Frequencies, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids from checkpoint first up to checkpoint last (None: the end)."""
        place, state = self.marks[first]
        state = state.copy()
        begin = first * self.every * self.lanes
        end = self.n if last is None or last >= len(self.marks) else last * self.every * self.lanes
        out = np.empty(end - begin, dtype=np.uint32)
        mask = _U((1 << BITS) - 1)
        for at in range(0, end - begin, self.lanes):
            x = state[: min(self.lanes, end - begin - at)]
            part = x & mask
            ids = table.slot[part]
            out[at : at + len(x)] = ids
            x = table.freq[ids] * (x >> _U(BITS)) + part - table.start[ids]
            low = np.flatnonzero(x < _U(LOW))
            if len(low):
                x[low] = (x[low] << _U(32)) | self.stream[place : place + len(low)]
                place += len(low)
            state[: len(x)] = x
        return out


def encode(ids: np.ndarray, table: Frequencies) -> bytes:
    return b"".join(encode_block(ids[a : a + BLOCK], table) for a in range(0, len(ids), BLOCK))


def decode(data: bytes, table: Frequencies) -> np.ndarray:
    """All ids of concatenated blocks; raises ValueError if a checksum fails."""
    at, parts = 0, []
    while at < len(data):
        block = Block(data, at)
        ids = block.decode(table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != block.crc:
            raise ValueError("the ids don't match their checksum")
        parts.append(ids)
        at = block.end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
