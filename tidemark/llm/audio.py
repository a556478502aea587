"""Media columns: telephony audio.

Mu-law and A-law samples expand through 256-entry lookup tables that a rule builds; IMA ADPCM
blocks, each with its own predictor, are decoded side by side with numpy, one nibble step for all
blocks at a time.  Decoded sound is mixed to one channel, resampled and stored as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import arrow_schema, byte_slices, map_arrow

#: Format tags of RIFF/WAVE files.
PCM, ALAW, ULAW, IMA_ADPCM = 1, 6, 7, 17

# Step sizes and index changes of IMA ADPCM.
IMA_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def ulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    magnitude = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, magnitude, -magnitude).astype(np.int16)


ULAW_PCM, ALAW_PCM = ulaw_table(), alaw_table()


def decode_ima_blocks(codes: np.ndarray, predictor: np.ndarray | None = None, index: np.ndarray | None = None) -> np.ndarray:
    """Samples (blocks, 2 * bytes) of the code bytes (blocks, bytes), low nibble first."""
    blocks, width = codes.shape
    value = np.zeros(blocks, np.int32) if predictor is None else predictor.astype(np.int32)
    place = np.zeros(blocks, np.int32) if index is None else np.clip(index.astype(np.int32), 0, 88)
    out = np.empty((2 * width, blocks), np.int16)
    columns = np.ascontiguousarray(codes.T)
    for at in range(2 * width):
        nibble = columns[at // 2] >> 4 if at % 2 else columns[at // 2] & 15
        step = IMA_STEPS[place]
        size = nibble & 7
        change = (step * (2 * size.astype(np.int32) + 1)) >> 3
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        place = np.clip(place + IMA_INDEX[size], 0, 88)
        out[at] = value
    return np.ascontiguousarray(out.T)


def wav(tag: int, data: bytes, rate: int = 8000) -> bytes:
    """A mono RIFF/WAVE file; companded samples have 8 bits, PCM 16, ADPCM blocks 68 bytes (129 samples)."""
    bits, align, samples, more = {PCM: (16, 2, len(data) // 2, b""), IMA_ADPCM: (4, 68, len(data) // 68 * 129, struct.pack("<HH", 2, 129))}.get(tag, (8, 1, len(data), b"\0\0"))
    speed = rate * align if tag != IMA_ADPCM else rate * 68 // 129
    head = struct.pack("<HHIIHH", tag, 1, rate, speed, align, bits) + more
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Wave(NamedTuple):
    """What the header of a RIFF/WAVE file says, and the bytes of its data chunk."""

    tag: int
    channels: int
    rate: int
    align: int
    bits: int
    data: bytes


def read_wav(media: bytes) -> Wave:
    """A file's header and data.  ValueError: no such file, or a header without format, channels or rate."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, head, data = 12, None, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(media):
            tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            head = (tag, channels, rate, align, bits)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if head is None or not head[1] or not head[2]:
        raise ValueError("the header has no format, no channels or no rate")
    return Wave(*head, data)


def _ima_channel(blocks: np.ndarray, channels: int, channel: int) -> np.ndarray:
    """Samples (blocks, samples) of one channel: a predictor and an index each, then groups of four code bytes by turns."""
    head = np.ascontiguousarray(blocks[:, 4 * channel : 4 * channel + 4])
    first = head[:, :2].copy().view("<i2")[:, 0]
    groups = (blocks.shape[1] - 4 * channels) // (4 * channels)
    codes = blocks[:, 4 * channels :][:, : groups * 4 * channels].reshape(len(blocks), groups, channels, 4)[:, :, channel].reshape(len(blocks), -1)
    return np.concatenate([first[:, None], decode_ima_blocks(codes, first, head[:, 2])], axis=1)


def _ima_samples(wave: Wave) -> np.ndarray:
    """(samples, channels) of IMA ADPCM blocks as long as the header says; a last, shorter block counts as well."""
    if wave.bits != 4 or wave.align <= 4 * wave.channels:
        raise ValueError(f"ADPCM of {wave.bits} bits in blocks of {wave.align} bytes is not known")
    codes = np.frombuffer(wave.data, np.uint8)
    whole = len(codes) // wave.align * wave.align
    parts = [codes[:whole].reshape(-1, wave.align)] if whole else []
    if len(codes) - whole > 4 * wave.channels:
        parts.append(codes[whole:][None, :])
    out = [np.stack([_ima_channel(x, wave.channels, c).ravel() for c in range(wave.channels)], axis=1) for x in parts]
    return np.concatenate(out) if out else np.zeros((0, wave.channels), np.int16)


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and 16-bit samples of a mu-law, A-law, IMA ADPCM or PCM file; channels are averaged.

    ValueError: another format, other bits than 8 (companded), 8 or 16 (PCM) or 4 (ADPCM), or a
    broken header.  Bytes behind the last whole sample are left out.
    """
    wave = read_wav(media)
    if wave.tag in (ULAW, ALAW) and wave.bits == 8:
        samples = (ULAW_PCM if wave.tag == ULAW else ALAW_PCM)[np.frombuffer(wave.data, np.uint8)]
    elif wave.tag == PCM and wave.bits == 16:
        samples = np.frombuffer(wave.data[: len(wave.data) // 2 * 2], "<i2")
    elif wave.tag == PCM and wave.bits == 8:
        samples = ((np.frombuffer(wave.data, np.uint8).astype(np.int16) - 128) << 8).astype(np.int16)
    elif wave.tag == IMA_ADPCM:
        samples = _ima_samples(wave).ravel()
    else:
        raise ValueError(f"format {wave.tag} of {wave.bits} bits is not known")
    if wave.channels > 1:
        samples = samples[: len(samples) // wave.channels * wave.channels].reshape(-1, wave.channels)
        samples = np.floor_divide(samples.sum(axis=1, dtype=np.int64), wave.channels).astype(np.int16)
    return wave.rate, samples


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate; doubling takes an integer path."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    if to == 2 * rate:
        wide = samples.astype(np.int32)
        out = np.empty(2 * len(samples), np.int16)
        out[::2] = samples
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = samples[-1]
        return out
    n = max(1, round(len(samples) * to / rate))
    return np.rint(np.interp(np.arange(n) * (rate / to), np.arange(len(samples)), samples)).astype(np.int16)


def to_pcm(media: DataFrame, column: str = "media", rate: int = 16000) -> DataFrame:
    """``media`` with a column pcm: its sound as a mono 16-bit PCM file at ``rate``.  Null or unreadable media: null."""

    @F.pandas_udf("binary")
    def convert(files):  # noqa: ANN001, ANN202
        def one(x: bytes | None) -> bytes | None:
            if x is None:
                return None
            try:
                own, samples = decode(bytes(x))
            except (ValueError, struct.error):
                return None
            return wav(PCM, resample(samples, own, rate).astype("<i2").tobytes(), rate)

        return files.map(one)

    return media.withColumn("pcm", convert(F.col(column)))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as mu-law samples of a telephone recording.

    Zero bytes fill it up to a positive multiple of 64 samples.  Null text: as an empty one.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column("text")):
                raw, media = data.tobytes(), []
                for k in range(hi - lo):
                    one = raw[offsets[k] : offsets[k + 1]]
                    media.append(wav(ULAW, one + b"\0" * (-len(one) % 64 or (0 if one else 64))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], schema=target)

    return map_arrow(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, schema)


def telephony_features(stored: DataFrame, rate: int = 16000) -> DataFrame:
    """Digests and features of stored recordings, from the bytes that are read back, and their sound as PCM.

    payload_* speak of the 8-bit samples, media_* of the file.  feature: loudness (root mean
    square) of the samples under mu-law, A-law and ADPCM (blocks of 64 bytes that start at zero),
    the mu-law peak and sign changes, and the CRC of the mu-law sound resampled to ``rate``.  pcm:
    that sound as a 16-bit PCM file, to be stored.  A null doc_id stays null.
    """
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            ids, counts = batch.column("doc_id"), batch.column("n_bytes")
            for lo, hi, data, offsets in byte_slices(batch.column("media")):
                raw = data.tobytes()
                files = [raw[offsets[k] : offsets[k + 1]] for k in range(hi - lo)]
                read = [read_wav(x) for x in files]
                samples = np.frombuffer(b"".join(x.data for x in read), np.uint8)
                nibbles = decode_ima_blocks(samples.reshape(-1, 64)).reshape(-1)
                ends = np.cumsum([len(x.data) for x in read])
                columns: list[list] = [[] for _ in range(7)]
                for wave, media, end in zip(read, files, ends, strict=True):
                    payload = wave.data
                    codes = samples[end - len(payload) : end]
                    loud, other = ULAW_PCM[codes], ALAW_PCM[codes]
                    adpcm = nibbles[2 * (end - len(payload)) : 2 * end]
                    power = [np.sqrt(np.mean(np.square(x, dtype=np.float64))) for x in (loud, other, adpcm)]
                    turns = int(np.count_nonzero((loud[1:] < 0) != (loud[:-1] < 0)))
                    sound = resample(loud, wave.rate, rate).astype("<i2").tobytes()
                    feature = f"rms={power[0]:.3f};alaw_rms={power[1]:.3f};adpcm_rms={power[2]:.3f};peak={int(np.abs(loud.astype(np.int32)).max())};turns={turns};pcm_crc32={zlib.crc32(sound)}"
                    for column, value in zip(columns, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, wav(PCM, sound, rate)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), counts.slice(lo, hi - lo), *[pa.array(c, f.type) for c, f in zip(columns, list(target)[2:], strict=True)]], schema=target)

    return map_arrow(stored.select("doc_id", "n_bytes", "media"), run, schema)
