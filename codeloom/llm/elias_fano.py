"""Elias-Fano sequences over memory-mapped arrays, queried in numpy batches."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from urllib.parse import urlsplit

import numpy as np
import pyarrow.fs as pafs


_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
# place of the r-th (from 0) set bit of each byte; 8 where it has fewer
_PLACES = np.sort(np.where((np.arange(256)[:, None] >> np.arange(8)) & 1, np.arange(8), 8), axis=1).ravel()


def _select(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th (from 0) set bit of each 64-bit word: the byte from
    the counts up to each byte, the bit in it from a table."""
    r = r.astype(np.uint64)
    two = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
    four = (two & np.uint64(0x3333333333333333)) + ((two >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((four + (four >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
    place = np.bitwise_count((((r * _BYTES) | _TOPS) - upto) & _TOPS).astype(np.uint64) << np.uint64(3)
    r -= ((upto << np.uint64(8)) >> place) & np.uint64(255)
    inside = (((word >> place) & np.uint64(255)) << np.uint64(3)) + r
    return place.astype(np.int64) + _PLACES[inside.astype(np.int64)]


class Monotone:
    """A non-decreasing sequence of n values: low bits packed, high bits in
    unary, with the zeros before each word of the unary part."""

    def __init__(self, n: int, low_bits: int, low, high, zeros):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @staticmethod
    def packed(values: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays of the sequence of ``values`` (sorted uint64)."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = np.zeros(n * width + 128, np.uint8)
        for b in range(width):
            bits[b : n * width : width] = (values >> np.uint64(b)) & np.uint64(1)
        bits = bits[: (len(bits) + 63) // 64 * 64]
        bits = np.concatenate((bits, np.zeros(-len(bits) % 64, np.uint8)))
        low = np.packbits(bits, bitorder="little").view(np.uint64)
        high_of = (values >> np.uint64(width)).astype(np.int64)
        size = n + (int(high_of[-1]) if n else 0) + 2 + 64  # the last word is empty
        unary = np.zeros((size + 63) // 64 * 64, np.uint8)
        unary[high_of + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.cumsum(np.bitwise_count(high).astype(np.int64))
        zeros = 64 * np.arange(len(high) + 1) - np.concatenate(([0], ones))
        return {"meta": np.array([n, width], np.int64), "low": low, "high": high, "zeros": zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Monotone:
        n, width = (int(x) for x in arrays["meta"])
        return cls(n, width, arrays["low"], arrays["high"], arrays["zeros"])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | rest) & np.uint64((1 << self.low_bits) - 1)

    def _start(self, bucket: np.ndarray) -> np.ndarray:
        """Bit after the zero that opens each bucket: select0."""
        out = np.zeros(len(bucket), np.int64)
        ask = np.flatnonzero(bucket > 0)
        k = bucket[ask] - 1
        word = np.searchsorted(self.zeros, k, "right") - 1
        out[ask] = 64 * word + _select(~self.high[word], k - self.zeros[word]) + 1
        return out

    def _bounds(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices between which the values of each bucket lie; a bucket ends
        at the first zero, which is mostly in the next 64 bits."""
        bit = self._start(bucket)
        low, word, shift = bit - bucket, bit >> 6, (bit & 63).astype(np.uint64)
        left = (np.uint64(64) - shift) & np.uint64(63)
        ahead = (self.high[word] >> shift) | np.where(shift > 0, self.high[word + 1] << left, np.uint64(0))
        run = np.bitwise_count(ahead ^ (ahead + np.uint64(1))).astype(np.int64) - 1
        long = np.flatnonzero(run >= 63)
        run[long] = self._start(bucket[long] + 1) - 1 - bit[long]
        return low, low + run

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, of any of equal ones, -1 where it is absent."""
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        # beyond the last bucket there is nothing
        wide = values >> np.uint64(self.low_bits)
        held = np.flatnonzero(wide <= np.uint64(64 * (len(self.high) - 1) - self.n - 1))
        low, high = self._bounds(wide[held].astype(np.int64))
        full = np.flatnonzero(low < high)
        held, low, high = held[full], low[full], high[full]
        want = values[held] & np.uint64((1 << self.low_bits) - 1)
        self._narrow(low, high, want)
        same = np.flatnonzero(self.lows(low) == want)
        out[held[same]] = low[same]
        return out

    def _narrow(self, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> None:
        """Moves ``low`` to the last index below ``high`` whose low bits are not
        above the wanted ones. Word numbers come from hashes and so lie evenly:
        two steps of three go by proportion, the third halves."""
        at, turn = np.flatnonzero(high - low > 1), 0
        a, b, aim = low[at], high[at], want[at].astype(np.float64)
        least, above = np.zeros(len(at)), np.full(len(at), float(1 << self.low_bits))
        while len(at):
            turn += 1
            step = (b - a) >> 1 if turn % 3 == 0 else ((aim - least) / (above - least) * (b - a)).astype(np.int64)
            middle = a + np.clip(step, 1, b - a - 1)
            value = self.lows(middle).astype(np.float64)
            over = value > aim
            b, above = np.where(over, middle, b), np.where(over, value, above)
            a, least = np.where(over, a, middle), np.where(over, least, value)
            done = (b - a <= 1) | (least == aim)
            low[at[done]] = a[done]
            left = ~done
            at, a, b, aim, least, above = (x[left] for x in (at, a, b, aim, least, above))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the indices: select1 over the unary part."""
        i = np.asarray(i, np.int64)
        ones = 64 * np.arange(len(self.zeros), dtype=np.int64) - self.zeros
        word = np.searchsorted(ones, i, "right") - 1
        at = 64 * word + _select(self.high[word], i - ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(i)


def bytewise(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of ``values`` as bytes; those of 255 or more are listed apart."""
    wide = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}_at": wide, f"{name}_wide": values[wide].astype(np.int64)}


def taken(arrays: dict[str, np.ndarray], name: str, i: np.ndarray) -> np.ndarray:
    """Values of ``bytewise`` arrays at the indices."""
    out = arrays[name][i].astype(np.int64)
    wide = np.flatnonzero(out == 255)
    out[wide] = arrays[f"{name}_wide"][np.searchsorted(arrays[f"{name}_at"], i[wide])]
    return out


def _store(folder: str):
    return pafs.FileSystem.from_uri(folder if urlsplit(folder).scheme else f"file://{folder}")


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes a file of aligned arrays under a new name and returns its path.

    Each attempt of a task writes its own file; only the one whose name the
    successful attempt reports is read.
    """
    store, base = _store(folder)
    index, at = {}, 0
    for key, a in arrays.items():
        index[key] = (str(a.dtype), len(a), at)
        at += (a.nbytes + 63) // 64 * 64
    head = json.dumps(index).encode()
    first = (len(head) + 8 + 63) // 64 * 64
    path = f"{base}/{name}-{uuid.uuid4().hex}.level"
    store.create_dir(base, recursive=True)
    with store.open_output_stream(path) as out:
        out.write(len(head).to_bytes(8, "little") + head + b"\0" * (first - 8 - len(head)))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))
    return path


def load(folder: str, path: str) -> dict[str, np.ndarray]:
    """The arrays of a file as memory maps; a file of a remote store is first
    fetched to the worker's temporary folder."""
    store, _ = _store(folder)
    if store.type_name != "local":
        kept = os.path.join(tempfile.gettempdir(), os.path.basename(path))
        if not os.path.exists(kept):
            with store.open_input_stream(path) as source, open(f"{kept}.{os.getpid()}", "wb") as out:
                while piece := source.read(1 << 22):
                    out.write(piece)
            os.replace(f"{kept}.{os.getpid()}", kept)
        path = kept
    with open(path, "rb") as f:
        n = int.from_bytes(f.read(8), "little")
        index = json.loads(f.read(n))
    first = (n + 8 + 63) // 64 * 64
    whole = np.memmap(path, np.uint8, "r")
    return {
        key: np.asarray(whole[first + at : first + at + size * np.dtype(kind).itemsize]).view(kind)
        for key, (kind, size, at) in index.items()
    }


def prefixed(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}


def part(arrays: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    return {k.split(".", 1)[1]: v for k, v in arrays.items() if k.startswith(f"{name}.")}
