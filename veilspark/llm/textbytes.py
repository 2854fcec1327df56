"""Words, shingles and XXH64 over whole Arrow batches with numpy.

A batch's texts stay one byte buffer; words are (start, length) pairs in it, so
the cost of a word is a few vector operations and no Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

P1, P2, P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
P4, P5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)
SEED = 42
LONG = 1024
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most about `most` bytes of text, one row at least."""
    col = batch.column(column)
    size = np.asarray(pc.binary_length(col).fill_null(0).cast(pa.int64()))
    at, upto = 0, np.cumsum(size)
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def buffer(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts of a column end to end (null: empty), and n + 1 offsets."""
    col = column.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64, count=col.offset + n + 1)[col.offset :]
    data = col.buffers()[2]
    raw = data.slice(int(offs[0]), int(offs[-1] - offs[0])).to_pybytes() if data is not None and n else b""
    return raw, offs - offs[0]


def words(raw: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each text the index of its first word (n + 1 values)."""
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ws = SPACE[np.frombuffer(raw, np.uint8)]
    first = np.zeros(len(raw) + 1, bool)
    first[offs] = True
    before = np.empty(len(raw), bool)
    before[0] = True
    np.logical_or(ws[:-1], first[1:-1], out=before[1:])
    after = np.empty(len(raw), bool)
    after[-1] = True
    np.logical_or(ws[1:], first[1:-1], out=after[:-1])
    starts = np.flatnonzero(before & ~ws)
    ends = np.flatnonzero(after & ~ws) + 1
    return starts, ends, np.searchsorted(starts, offs)


def joined(raw: bytes, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words joined by one space: the new buffer, word starts, word ends and first words."""
    s, e, f = words(raw, offs)
    if not len(s):
        return b"", s, e, f
    a = np.frombuffer(raw, np.uint8)
    keep = ~SPACE[a]
    last = np.zeros(len(s), bool)
    last[np.unique(f[1:][f[1:] > f[:-1]]) - 1] = True  # no space behind a text's last word
    gap = e[:-1][~last[:-1]]
    keep[gap] = True
    out = a[keep].copy()
    n = e - s
    step = n + ~last
    starts = np.cumsum(step) - step
    out[(starts + n)[:-1][~last[:-1]]] = 32
    return out.tobytes(), starts, starts + n, f


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64(raw: bytes, starts: np.ndarray, lens: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span of the buffer, as unsigned 64-bit values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    buf = raw + b"\0" * 8
    b8 = np.frombuffer(buf, np.uint8)
    b64 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    b32 = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    with np.errstate(over="ignore"):
        s0 = np.uint64(seed)
        h = np.full(len(starts), s0 + P5, np.uint64)
        at = starts.astype(np.int64).copy()
        big = np.flatnonzero((lens >= 32) & (lens <= LONG))
        if len(big):
            v = [np.full(len(big), x, np.uint64) for x in (s0 + P1 + P2, s0 + P2, s0, s0 - P1)]
            stripes, p = lens[big] // 32, at[big].copy()
            live = np.arange(len(big))
            for k in range(int(stripes.max())):
                live = live[stripes[live] > k]
                for i in range(4):
                    v[i][live] = _round(v[i][live], b64[p[live] + 8 * i])
                p[live] += 32
            acc = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            zero = np.uint64(0)
            for x in v:
                acc = (acc ^ _round(np.full(len(big), zero), x)) * P1 + P4
            h[big], at[big] = acc, p
        h += lens.astype(np.uint64)
        rest = lens % 32
        for k in range(3):
            i = np.flatnonzero(rest >= 8 * (k + 1))
            if len(i):
                lane = _rot(b64[at[i]] * P2, 31) * P1
                h[i] = _rot(h[i] ^ lane, 27) * P1 + P4
                at[i] += 8
        rest = rest % 8
        i = np.flatnonzero(rest >= 4)
        if len(i):
            h[i] = _rot(h[i] ^ (b32[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
            at[i] += 4
        rest = rest % 4
        for k in range(3):
            i = np.flatnonzero(rest > k)
            if len(i):
                h[i] = _rot(h[i] ^ (b8[at[i]].astype(np.uint64) * P5), 11) * P1
                at[i] += 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(lens > LONG):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + lens[i]], seed)
    return h
