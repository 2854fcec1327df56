"""Telephony audio in media columns.

mu-law and A-law expand by lookup tables computed from their segment rule; ADPCM (the
four-bit IMA form) decodes with numpy across blocks, one step for the n-th sample of all
blocks at once. Media are RIFF/WAVE files; decoded PCM is resampled and stored as 16-bit
samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import written
from .textbytes import slices

BLOCK = 192
RATE, TARGET = 8000, 16000
CODECS = ("mulaw", "alaw", "adpcm")
#: Format tags of RIFF/WAVE: fixed values of the file format.
TAG = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 0x11}
#: Step index changes for the three magnitude bits of an IMA ADPCM code: fixed values of the codec.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Step sizes of IMA ADPCM: fixed values of the codec.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """PCM values of the 256 mu-law codes: complemented sign, three bits of segment, four of step, bias 132."""
    c = ~np.arange(256) & 0xFF
    size = (((c & 0x0F) << 3) + 132 << (c >> 4 & 7)) - 132
    return np.where(c & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM values of the 256 A-law codes: even bits inverted, the lowest segment linear."""
    c = np.arange(256) ^ 0x55
    seg, step = c >> 4 & 7, (c & 0x0F) << 4
    size = np.where(seg == 0, step + 8, step + 264 << np.maximum(seg - 1, 0))
    return np.where(c & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_adpcm(data: bytes, block: int = BLOCK) -> np.ndarray:
    """Mono IMA ADPCM: (blocks, samples) of 16-bit PCM. Incomplete last blocks are an error; a step index past the table is held to its end."""
    if block < 5 or len(data) % block:
        raise ValueError("not a whole number of blocks")
    raw = np.frombuffer(data, np.uint8).reshape(-1, block)
    value = np.ascontiguousarray(raw[:, :2]).view("<i2").astype(np.int32).ravel()
    index = np.minimum(raw[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((2 * (block - 4), len(raw)), np.uint8)
    codes[0::2], codes[1::2] = (raw[:, 4:] & 0x0F).T, (raw[:, 4:] >> 4).T
    out = np.empty((1 + len(codes), len(raw)), np.int16)
    out[0] = value
    for i, c in enumerate(codes):
        step = STEPS[index]
        diff = (step >> 3) + (step >> 2) * (c & 1) + (step >> 1) * (c >> 1 & 1) + step * (c >> 2 & 1)
        value = np.clip(np.where(c & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + INDEX_STEP[c & 7], 0, len(STEPS) - 1)
        out[i + 1] = value
    return out.T


def wave(codec: str, payload: bytes, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono RIFF/WAVE file that holds the payload byte for byte."""
    if codec == "adpcm":
        per = 2 * (block - 4) + 1
        fmt = struct.pack("<HHIIHHHH", TAG[codec], 1, rate, rate * block // per, block, 4, 2, per)
        fact = len(payload) // block * per
    elif codec == "pcm":
        fmt, fact = struct.pack("<HHIIHHH", TAG[codec], 1, rate, 2 * rate, 2, 16, 0), len(payload) // 2
    else:
        fmt, fact = struct.pack("<HHIIHHH", TAG[codec], 1, rate, rate, 1, 8, 0), len(payload)
    chunks = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", fmt), (b"fact", struct.pack("<I", fact)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, sample rate, block size and data of a RIFF/WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt, data = 12, None, None
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif media[at : at + 4] == b"data":
            data = media[at + 8 : at + 8 + size]
            if len(data) < size:
                raise ValueError("the data chunk is cut off")
        at += 8 + size + size % 2
    if fmt is None or data is None:
        raise ValueError("no format or no data")
    return fmt[0], fmt[2], fmt[4], data


def decode(media: list[bytes]) -> list[tuple[str, int, bytes, np.ndarray]]:
    """(codec, rate, data, PCM samples) of many files; the ADPCM blocks of all of them decode together."""
    names = {v: k for k, v in TAG.items()}
    read = [read_wave(m) for m in media]
    blocks: dict[int, list[bytes]] = {}
    for tag, _, block, data in read:
        if tag == TAG["adpcm"]:
            blocks.setdefault(block, []).append(data)
    pcm = {b: decode_adpcm(b"".join(x), b) for b, x in blocks.items()}
    used = dict.fromkeys(blocks, 0)
    out = []
    for tag, rate, block, data in read:
        if tag == TAG["adpcm"]:
            n = len(data) // block
            x = pcm[block][used[block] : used[block] + n].reshape(-1)
            used[block] += n
        elif tag in (TAG["mulaw"], TAG["alaw"]):
            x = (MULAW if tag == TAG["mulaw"] else ALAW)[np.frombuffer(data, np.uint8)]
        elif tag == TAG["pcm"]:
            x = np.frombuffer(data, "<i2")
        else:
            raise ValueError(f"format tag {tag}")
        out.append((names[tag], rate, data, x))
    return out


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation on exact integer positions; the last sample is held."""
    if rate == to or not len(x):
        return x
    r = Fraction(rate, to)
    n = -(-len(x) * r.denominator // r.numerator)
    at = np.arange(n) * r.numerator
    i, frac = at // r.denominator, (at % r.denominator).astype(np.int32)
    a = x[i].astype(np.int32)
    b = x[np.minimum(i + 1, len(x) - 1)].astype(np.int32)
    return (a + (b - a) * frac // r.denominator).astype(np.int16)


def payload_of(text: str | bytes | None, block: int = BLOCK) -> tuple[int, bytes]:
    """The number of bytes of a text, and these bytes with spaces up to a positive multiple of the block."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    return len(raw), raw + b" " * (max(block, -(-len(raw) // block) * block) - len(raw))


def codec_of(payload: bytes) -> str:
    """The codec under which a payload is stored: a function of its bytes alone."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def features(codec: str, rate: int, pcm: np.ndarray, to: int = TARGET) -> tuple[str, bytes]:
    """Loudness, peak, zero crossings and a digest of the resampled PCM, and that PCM."""
    x = pcm.astype(np.int64)
    again = resample(pcm, rate, to).astype("<i2").tobytes()
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    energy = int((x * x).sum())
    return f"codec={codec};samples={len(x)};peak={int(np.abs(x).max(initial=0))};energy={energy};dc={int(x.sum())};crossings={crossings};rate={to};pcm_bytes={len(again)};pcm_crc32={zlib.crc32(again)}", again


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text", 2 << 20):
            made = [payload_of(t) for t in rows.column("text").cast(pa.binary()).to_pylist()]
            media = [wave(codec_of(p), p) for _, p in made]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as a WAVE file. Null and empty texts give one block of spaces; rows that repeat are kept; extra columns are left alone."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _decode(batches: Iterator[pa.RecordBatch], to: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "media", 2 << 20):
            media = rows.column("media").to_pylist()
            read = decode(media)
            made = [features(codec, rate, pcm, to) for codec, rate, _, pcm in read]
            data = [d for _, _, d, _ in read]
            cols = {"doc_id": rows.column("doc_id"), "n_bytes": rows.column("n_bytes")}
            if digest:
                cols |= {
                    "payload_bytes": pa.array(map(len, data), pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in data]),
                    "tail_crc32": pa.array([zlib.crc32(d[-16:]) for d in data], pa.int64()),
                    "media_bytes": pa.array(map(len, media), pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                }
            else:
                cols |= {"payload": pa.array(data, pa.binary()), "pcm": pa.array([p for _, p in made], pa.binary())}
            cols["feature"] = pa.array([f for f, _ in made], pa.string())
            yield pa.RecordBatch.from_pydict(cols)


def decoded(media: DataFrame, to: int = TARGET) -> DataFrame:
    """(doc_id, n_bytes, payload, pcm, feature): what the media column holds, and its PCM resampled to `to` Hz."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lambda it: _decode(it, to, False), "doc_id long, n_bytes long, payload binary, pcm binary, feature string")


def result(docs: DataFrame) -> DataFrame:
    """The query's columns: digests of the media that are written to the shared folder and read back from there. Their PCM is resampled and digested in `feature`; decoded() gives it as a column."""
    return written(encode(docs), "media").mapInArrow(
        lambda it: _decode(it, TARGET, True),
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
