"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM blocks, WAV files in, resampled PCM out.

ADPCM is sequential within a block, so numpy steps through the samples of a block with the blocks of many files side by side.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokens import few_rows, in_slices

ALAW, MULAW, ADPCM = 6, 7, 17  # format tags of WAV files
NAMES = {ALAW: "alaw", MULAW: "mulaw", ADPCM: "ima_adpcm"}
RATE, OUT_RATE = 8000, 16000
BLOCK = 36  # bytes of an ADPCM block: 4 of header, 64 samples of 4 bits
PAD = 576  # a multiple of BLOCK
SLICE = 4_000_000  # bytes of files that a task decodes together, or one longer file


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: 256 codes to 16-bit samples."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: 256 codes to 16-bit samples."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    size = np.where(part == 0, low, (low + 0x100) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()

# Step sizes and index changes of the IMA ADPCM standard.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)

#: (step index, code) to the change of the sample and to the next step index.
_CODES = np.arange(16)
DELTAS = ((STEPS[:, None] >> 3) + (STEPS[:, None] >> 2) * (_CODES & 1) + (STEPS[:, None] >> 1) * (_CODES >> 1 & 1) + STEPS[:, None] * (_CODES >> 2 & 1)) * np.where(_CODES & 8, -1, 1)
DELTAS = DELTAS.astype(np.int32).ravel()
NEXT = np.clip(np.arange(89)[:, None] + CHANGES, 0, 88).astype(np.int32).ravel()


def decode_adpcm(data: bytes, block: int = BLOCK) -> np.ndarray:
    """IMA ADPCM blocks (mono) to samples; a step index beyond 88 counts as 88, a last part of a block is ignored."""
    b = np.frombuffer(data, np.uint8)[: len(data) // block * block].reshape(-1, block)
    sample = b[:, 0].astype(np.int32) | b[:, 1].view(np.int8).astype(np.int32) << 8
    index = np.minimum(b[:, 2], 88).astype(np.int32)
    codes = np.empty((2 * (block - 4), len(b)), np.uint8)
    codes[0::2], codes[1::2] = (b[:, 4:] & 15).T, (b[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(b)), np.int16)
    out[0] = sample
    for k, code in enumerate(codes, 1):
        at = (index << 4) | code
        sample = np.clip(sample + DELTAS[at], -32768, 32767)
        index = NEXT[at]
        out[k] = sample
    return out.T.ravel()


def wav(tag: int, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file around encoded telephony samples."""
    if tag == ADPCM:
        per_block = 2 * (BLOCK - 4) + 1
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(data) // BLOCK * per_block
    else:
        form, samples = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0), len(data)
    parts = b"".join(struct.pack("<4sI", name, len(x)) + x + b"\0" * (len(x) % 2) for name, x in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, sample rate and data of a WAV file; ValueError if it is none."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, tag, rate, data = 12, None, 0, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if tag is None or data is None:
        raise ValueError("a chunk is missing")
    return tag, rate, data


def expand(tag: int, data: bytes) -> np.ndarray:
    """16-bit samples of encoded data."""
    if tag == ADPCM:
        return decode_adpcm(data)
    if tag not in (MULAW, ALAW):
        raise ValueError(f"no telephony format: {tag}")
    return (MULAW_TABLE if tag == MULAW else ALAW_TABLE)[np.frombuffer(data, np.uint8)]


def expand_all(files: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """``expand`` of many files: ADPCM steps through whole blocks of all of them at once."""
    adpcm = [data[: len(data) // BLOCK * BLOCK] for tag, data in files if tag == ADPCM]
    samples = decode_adpcm(b"".join(adpcm))
    parts = iter(np.split(samples, np.cumsum([len(x) // BLOCK * (2 * (BLOCK - 4) + 1) for x in adpcm])))
    return [next(parts) if tag == ADPCM else expand(tag, data) for tag, data in files]


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation between samples; twice the rate, the usual case, needs no positions."""
    if rate == to or not len(samples):
        return samples
    if to == 2 * rate:
        out = np.empty(2 * len(samples), np.int16)
        out[0::2] = samples
        out[1:-1:2] = (samples[:-1].astype(np.int32) + samples[1:]) >> 1
        out[-1] = samples[-1]
        return out
    at = np.arange(int(len(samples) * to / rate)) * (rate / to)
    return np.floor(np.interp(at, np.arange(len(samples)), samples)).astype(np.int16)


def decoded(files: list[bytes | None], rate: int) -> list[tuple[int, bytes, np.ndarray] | None]:
    """Format tag, data and resampled PCM of each WAV file; None for what is no readable telephony file."""
    found: list = []
    for x in files:
        try:
            tag, own, data = read_wav(x)
            if tag not in NAMES or not own:
                raise ValueError("no telephony format")
            found.append((tag, own, data))
        except (TypeError, ValueError, struct.error):
            found.append(None)
    pcm = iter(expand_all([(x[0], x[2]) for x in found if x]))
    return [x and (x[0], x[2], resample(next(pcm), x[1], rate)) for x in found]


def pcm_column(df: DataFrame, media: str = "media", rate: int = OUT_RATE) -> DataFrame:
    """``df`` with ``pcm`` (binary, little-endian 16 bit at ``rate``) and ``samples`` (long) from WAV files.

    Both are null where the file is null or no readable telephony WAV file.  Rows come back once each; columns of those
    names are replaced.  An empty table stays empty; a task holds SLICE bytes of files, or one longer file, decoded.
    """

    @F.pandas_udf("struct<pcm:binary,samples:long>")
    def decode(files):
        import pandas as pd

        out = []
        for _, some in in_slices([bytes(x) if x is not None else b"" for x in files], SLICE):
            out += [(x[2].astype("<i2").tobytes(), len(x[2])) if x else (None, None) for x in decoded(some, rate)]
        return pd.DataFrame(out, columns=["pcm", "samples"])

    return df.withColumn("__a", decode(F.col(media))).withColumns({"pcm": F.col("__a.pcm"), "samples": F.col("__a.samples")}).drop("__a")


def payload(text: bytes) -> bytes:
    """The bytes, padded with 255 up to a positive multiple of PAD."""
    return text + b"\xff" * (-len(text) % PAD or PAD * (not text))


def loudness(pcm: np.ndarray) -> int:
    """Root of the mean square, rounded down; sums of squares stay below 2**53 and so are exact in any order."""
    total = sum(int(x @ x) for x in (pcm[k : k + (1 << 22)].astype(np.float64) for k in range(0, len(pcm), 1 << 22)))
    return math.isqrt(total // max(1, len(pcm)))


def feature(tag: int, pcm: np.ndarray, rate: int = OUT_RATE) -> str:
    """What a sound is like: codec, length, loudness, zero crossings, checksum of the resampled PCM; whole numbers only."""
    below = pcm < 0
    peak = max(int(pcm.max()), -int(pcm.min())) if len(pcm) else 0
    return f"codec={NAMES[tag]};rate={rate};samples={len(pcm)};peak={peak};rms={loudness(pcm)};crossings={int(np.count_nonzero(below[1:] != below[:-1]))};pcm_crc32={zlib.crc32(pcm.astype('<i2').tobytes())}"


def encode_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: texts as UTF-8 in telephony WAV files.

    The codec (mu-law, A-law or ADPCM) follows from the text alone, so equal texts give equal files.
    """

    def encode(batches):
        for batch in few_rows(batches):
            padded = [payload(x.as_buffer().to_pybytes()) for x in batch.column(1)]
            media = pa.array([wav((MULAW, ALAW, ADPCM)[zlib.crc32(x) % 3], x) for x in padded], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), media], names=[key, "n_bytes", "media"])

    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, raw.cast("binary").alias("__text"), F.octet_length(raw).cast("long").alias("n_bytes"))
    return rows.mapInArrow(encode, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def store_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_media: bool = True, keep_pcm: bool = False) -> DataFrame:
    """One row a document: its text stored in a telephony WAV file, read back from the stored table and decoded.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; media itself if
    ``keep_media``, and resampled PCM (little-endian 16 bit, OUT_RATE) if ``keep_pcm``; other columns of ``docs`` are left out.  A null
    text is empty; repeated rows come back each; no documents give no rows.  A task holds SLICE bytes of files at a time, or one longer file.
    """
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    fields += [("media", pa.binary())] * keep_media + [("pcm", pa.binary())] * keep_pcm
    stored = written(encode_texts(docs, text, key), "media")

    def read(batches):
        for batch in few_rows(batches, 256):
            files = [x.as_buffer().to_pybytes() for x in batch.column(2)]
            for at, some in in_slices(files, SLICE):
                rows: list[list] = [[] for _ in fields[1:]]
                for media, (tag, back, pcm) in zip(some, decoded(some, OUT_RATE), strict=True):
                    row = [len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(tag, pcm)]
                    for column, value in zip(rows, row + [media] * keep_media + [pcm.astype("<i2").tobytes() if keep_pcm else b""] * keep_pcm, strict=True):
                        column.append(value)
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(r, t) for r, (_, t) in zip(rows, fields[1:], strict=True))], names=[key, *(n for n, _ in fields)])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {kinds[t]}" for n, t in fields)
    return stored.mapInArrow(read, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"), keep_media=False)
