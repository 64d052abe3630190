"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers.

Companded samples are expanded by 256-entry tables built from the published segment rules.
ADPCM is sequential within a block, so blocks of all clips of a batch are decoded together,
one sample position at a time. Decoded audio is resampled by linear interpolation with
integer arithmetic, which is the same on every machine.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import bounded_batches, claim, slices, tidy

#: WAV format tags (fixed values).
PCM, ALAW, MULAW, IMA = 0x0001, 0x0006, 0x0007, 0x0011
UNIT = 64
HEADER = 4
RATE_IN, RATE_OUT = 8000, 16000
#: IMA step-index changes by code magnitude (fixed values).
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law code: inverted bits, sign, 3-bit segment, 4-bit step, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each A-law code: even bits inverted, sign set for positive values."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, step = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, step + 8, step + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


#: The published IMA step sizes (fixed values).
IMA_STEPS = """
7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230
253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749
3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350
22385 24623 27086 29794 32767
"""


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples [block, position] of mono blocks: a 4-byte header (first sample, step index), then nibbles, low first."""
    steps = np.array(IMA_STEPS.split(), np.int32)
    n = len(blocks)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    nibbles = np.empty((2 * (blocks.shape[1] - HEADER), n), np.int32)
    nibbles[0::2], nibbles[1::2] = (blocks[:, HEADER:] & 15).T, (blocks[:, HEADER:] >> 4).T
    out = np.empty((len(nibbles) + 1, n), np.int16)
    out[0] = value
    for k, code in enumerate(nibbles, 1):
        step = steps[index]
        size = code & 7
        change = (step >> 3) + (step >> 2) * (size & 1) + (step >> 1) * (size >> 1 & 1) + step * (size >> 2)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[size], 0, 88)
        out[k] = value
    return out.T


def wav(tag: int, data: bytes, block: int, bits: int, rate: int = RATE_IN, extra: bytes = b"") -> bytes:
    """A mono WAV file around ``data``."""
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * bits // 8, block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, sample rate, block size, data) of a mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        found.setdefault(name, media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if channels != 1:
        raise ValueError("mono only")
    return tag, rate, block, found[b"data"]


def encode_payload(payload: bytes, tag: int) -> bytes:
    """A WAV file that holds the payload as samples of the format; a block of 64 bytes each for ADPCM."""
    if tag != IMA:
        return wav(tag, payload, 1, 8)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    blocks = np.concatenate((np.zeros((len(rows), HEADER), np.uint8), rows), 1)
    return wav(IMA, blocks.tobytes(), HEADER + UNIT, 4, extra=struct.pack("<HH", 2, 2 * UNIT + 1))


def payload_of(media: bytes) -> bytes:
    """The payload that ``encode_payload`` stored."""
    tag, _, block, data = read_wav(media)
    return np.frombuffer(data, np.uint8).reshape(-1, block)[:, HEADER:].tobytes() if tag == IMA else data


def decode(media: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    """16-bit samples and sample rate of each WAV file; ADPCM blocks of equal size go together."""
    read = [read_wav(x) for x in media]
    tables = {MULAW: mulaw_table(), ALAW: alaw_table()}
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(media)
    sizes: dict[int, list[int]] = {}
    for k, (tag, _, block, data) in enumerate(read):
        if tag == PCM:
            out[k] = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
        elif tag == IMA:
            sizes.setdefault(block, []).append(k)
        else:
            out[k] = tables[tag][np.frombuffer(data, np.uint8)]
    for block, which in sizes.items():
        rows = [np.frombuffer(read[k][3], np.uint8)[: len(read[k][3]) // block * block].reshape(-1, block) for k in which]
        samples = decode_ima(np.concatenate(rows))
        at = 0
        for k, x in zip(which, rows):
            out[k] = samples[at : at + len(x)].ravel()
            at += len(x)
    return out, [x[1] for x in read]


def resample(samples: np.ndarray, rate: int, target: int = RATE_OUT) -> np.ndarray:
    """Linear interpolation at integer positions, rounded down."""
    if rate == target or not len(samples):
        return samples
    if target == 2 * rate:
        wide = samples.astype(np.int32)
        out = np.empty(2 * len(wide), np.int16)
        out[0::2] = wide
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = wide[-1]
        return out
    at = np.arange(len(samples) * target // rate, dtype=np.int64) * rate
    low, part = at // target, at % target
    high = np.minimum(low + 1, len(samples) - 1)
    wide = samples.astype(np.int64)
    return ((wide[low] * (target - part) + wide[high] * part) // target).astype(np.int16)


def feature(samples: np.ndarray, tag: int) -> str:
    """Format, length, peak, mean square, zero crossings and checksum of decoded audio."""
    wide = samples.astype(np.int64)
    n = max(1, len(wide))
    crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"{tag}:{len(wide)}:{int(np.abs(wide).max(initial=0))}:{int((wide * wide).sum()) // n}:{crossings}:{zlib.crc32(samples.astype('<i2').tobytes()):08x}"


def audio_columns(media: DataFrame, media_col: str = "media", target_rate: int = RATE_OUT, then: Callable | None = None, then_schema: str = "") -> DataFrame:
    """``media`` plus ``pcm`` (16-bit little-endian at ``target_rate``), ``pcm_rate`` and ``feature``.

    Null media give null columns; a file that is not mono WAV of a known format is an error.
    The other columns are passed on, but for those named like the new ones. Long files are
    decoded whole, repeated rows each, and a table without rows gives none.

    ``then`` (with the schema of what it gives) takes each frame of these columns in the worker
    that made it: PCM is some six times the media and need not leave it to be reduced.
    """
    kept = [c for c in media.columns if c not in ("pcm", "pcm_rate", "feature")]

    def body(frames):
        claim("telephony")
        for frame in frames:
            blobs = frame[media_col].tolist()
            for a, b in slices(np.array([len(x or b"") for x in blobs], np.int64), 1 << 20):
                some = [k for k in range(a, b) if blobs[k] is not None]
                samples, rates = decode([blobs[k] for k in some])
                pcm = [resample(x, r, target_rate) for x, r in zip(samples, rates)]
                part = frame.iloc[a:b].copy()
                by = dict(zip(some, range(len(some))))
                part["feature"] = [feature(pcm[by[k]], read_wav(blobs[k])[0]) if k in by else None for k in range(a, b)]
                part["pcm"] = [pcm[by[k]].astype("<i2").tobytes() if k in by else None for k in range(a, b)]
                part["pcm_rate"] = pd.array([target_rate if k in by else None for k in range(a, b)], "Int32")
                yield part if then is None else then(part)

    schema = media.select(*kept).schema.add("feature", "string").add("pcm", "binary").add("pcm_rate", "integer")
    return media.select(*kept).mapInPandas(tidy(body), schema if then is None else then_schema)


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as the payload of a telephony file.

    Null counts as empty. The bytes are padded with zeros to a positive multiple of 64, and the
    payload's checksum picks mu-law, A-law or ADPCM, so equal texts give equal files.
    """

    def body(frames):
        claim("telephony")
        for frame in frames:
            texts = [x.encode() for x in frame["text"].tolist()]
            for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 22):
                payloads = [x + b"\0" * (max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x)) for x in texts[a:b]]
                media = [encode_payload(x, (MULAW, ALAW, IMA)[zlib.crc32(x) % 3]) for x in payloads]
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b], "n_bytes": [len(x) for x in texts[a:b]], "media": media})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(tidy(body), "doc_id long, n_bytes long, media binary")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the payloads read back from the stored files, of the files and of their stored PCM.

    All is computed from the columns of the operators: the payload read back from ``media``, the
    feature from ``pcm``. One row per row of ``docs``: null texts count as empty, long ones are
    taken whole, equal texts give equal values, other columns are ignored and no rows give no
    rows. The digests are taken of the frames of ``audio_columns`` where those are made, so the
    PCM, some six times the text, is neither sent to the JVM nor written to disk here.
    """

    def digests(frame: pd.DataFrame) -> pd.DataFrame:
        blobs = frame["media"].tolist()
        payloads = [payload_of(x) for x in blobs]
        return pd.DataFrame({
            "doc_id": frame["doc_id"], "n_bytes": frame["n_bytes"], "payload_bytes": [len(x) for x in payloads],
            "payload_sha256": [hashlib.sha256(x).hexdigest() for x in payloads], "tail_crc32": [zlib.crc32(x[-UNIT:]) for x in payloads],
            "media_bytes": [len(x) for x in blobs], "media_sha256": [hashlib.sha256(x).hexdigest() for x in blobs],
            "feature": [feature(np.frombuffer(p, "<i2"), read_wav(x)[0]) for p, x in zip(frame["pcm"], blobs)],
        })

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return audio_columns(stored_texts(docs, id_col, text_col), then=digests, then_schema=schema)
