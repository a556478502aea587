from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np

from tests.llm.tables import by_id, documents, prose
from tidemark.llm import audio


def scalar_ima(codes: bytes) -> list[int]:
    value, place, out = 0, 0, []
    for byte in codes:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.IMA_STEPS[place])
            change = (step * (2 * (nibble & 7) + 1)) >> 3
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            place = max(0, min(88, place + int(audio.IMA_INDEX[nibble & 7])))
            out.append(value)
    return out


def test_tables():
    assert audio.ULAW_PCM[[0x00, 0x80, 0x7F, 0xFF]].tolist() == [-32124, 32124, 0, 0]
    assert audio.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(set(audio.ULAW_PCM.tolist())) == 255 and len(set(audio.ALAW_PCM.tolist())) == 256


def test_adpcm_blocks_equal_scalar_decoding():
    codes = np.random.default_rng(2).integers(0, 256, (5, 64), dtype=np.uint8)
    assert audio.decode_ima_blocks(codes).tolist() == [scalar_ima(c.tobytes()) for c in codes]


def scalar_sound(payload: bytes) -> tuple[list[int], list[int]]:
    """Mu-law and A-law samples by the bits of each byte."""
    mu, a = [], []
    for byte in payload:
        c = 255 - byte
        size = ((2 * (c % 16) + 33) << (c // 16 % 8)) - 33
        mu.append(4 * (-size if c >= 128 else size))
        c = byte ^ 0x55
        segment, low = c // 16 % 8, c % 16
        size = 2 * low + 1 if segment == 0 else (2 * low + 33) << (segment - 1)
        a.append(8 * (size if c >= 128 else -size))
    return mu, a


def scalar_feature(payload: bytes) -> tuple[str, bytes]:
    mu, a = scalar_sound(payload)
    adpcm = [x for k in range(0, len(payload), 64) for x in scalar_ima(payload[k : k + 64])]
    rms = [math.sqrt(sum(x * x for x in own) / len(own)) for own in (mu, a, adpcm)]
    turns = sum((x < 0) != (y < 0) for x, y in zip(mu, mu[1:], strict=False))
    sound = [x for k, y in enumerate(mu) for x in (y, (y + mu[k + 1]) >> 1 if k + 1 < len(mu) else y)]
    pcm = struct.pack(f"<{len(sound)}h", *sound)
    return f"rms={rms[0]:.3f};alaw_rms={rms[1]:.3f};adpcm_rms={rms[2]:.3f};peak={max(map(abs, mu))};turns={turns};pcm_crc32={zlib.crc32(pcm)}", pcm


def test_round_trip(spark):
    texts = [None, "", "a", "x" * 64, "x" * 65, "né\0", prose(1, 6_000), "a", "".join(map(chr, range(0x250)))]
    docs = documents(spark, texts, more="media n_bytes feature")
    got = by_id(audio.telephony_features(audio.store_texts(docs)))
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        media = audio.wav(audio.ULAW, payload)
        assert audio.read_wav(media).data == payload
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(media))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        feature, pcm = scalar_feature(payload)
        assert r["feature"] == feature and audio.read_wav(bytes(r["pcm"])) == (audio.PCM, 1, 16000, 2, 16, pcm)
    assert got[2]["feature"] == got[7]["feature"]
    assert audio.telephony_features(audio.store_texts(docs.limit(0))).collect() == []


def test_stored_pcm(spark):
    sound = bytes(range(256))
    rows = [(1, audio.wav(audio.ULAW, sound)), (2, audio.wav(audio.ALAW, sound)), (3, audio.wav(audio.IMA_ADPCM, bytes(136))), (4, None), (5, b"junk")]
    got = by_id(audio.to_pcm(spark.createDataFrame(rows, "doc_id long, media binary")))
    for k, table in ((1, audio.ULAW_PCM), (2, audio.ALAW_PCM)):
        wave = audio.read_wav(got[k]["pcm"])
        samples = np.frombuffer(wave.data, "<i2")
        assert (wave.tag, wave.rate, len(samples)) == (audio.PCM, 16000, 512) and samples[::2].tolist() == table.tolist()
    assert len(audio.read_wav(got[3]["pcm"]).data) == 2 * 2 * 258 and got[4]["pcm"] is None and got[5]["pcm"] is None


def file(tag: int, channels: int, rate: int, align: int, bits: int, data: bytes) -> bytes:
    head = struct.pack("<HHIIHH", tag, channels, rate, rate * align, align, bits)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_headers_are_heeded(spark):
    """Stereo, eight-bit and short ADPCM files decode to their sound; broken or unknown headers give null."""
    left, right = [100, -200, 300], [0, 100, -301]
    stereo = struct.pack("<6h", *[x for pair in zip(left, right, strict=True) for x in pair])
    assert audio.decode(file(audio.PCM, 2, 8000, 4, 16, stereo))[1].tolist() == [50, -50, -1]
    assert audio.decode(file(audio.PCM, 1, 8000, 1, 8, bytes([128, 0, 255])))[1].tolist() == [0, -32768, 32512]
    assert audio.decode(file(audio.ULAW, 2, 8000, 2, 8, bytes([0, 0x80, 1])))[1].tolist() == [0]
    codes = [bytes(np.random.default_rng(k).integers(0, 256, 8, dtype=np.uint8)) for k in range(2)]
    block = bytes(8) + b"".join(codes[c][g : g + 4] for g in (0, 4) for c in (0, 1))
    want = [(x + y) // 2 for x, y in zip([0, *scalar_ima(codes[0])], [0, *scalar_ima(codes[1])], strict=True)]
    assert audio.decode(file(audio.IMA_ADPCM, 2, 8000, 24, 4, block))[1].tolist() == want
    whole, rest = bytes(4) + codes[0], bytes(4) + codes[1][:4]
    assert audio.decode(file(audio.IMA_ADPCM, 1, 8000, 12, 4, whole + rest))[1].tolist() == [0, *scalar_ima(codes[0]), 0, *scalar_ima(codes[1][:4])]
    bad = [(audio.PCM, 1, 0, 2, 16), (audio.PCM, 0, 8000, 2, 16), (audio.PCM, 1, 8000, 3, 24), (audio.IMA_ADPCM, 1, 8000, 4, 4), (85, 1, 8000, 1, 8)]
    rows = [(k, file(*x, b"12345678")) for k, x in enumerate(bad)] + [(9, file(audio.PCM, 1, 16000, 2, 16, b"")), (10, b"RIFF1234WAVE")]
    got = by_id(audio.to_pcm(spark.createDataFrame(rows, "doc_id long, media binary")))
    assert [k for k, r in got.items() if r["pcm"] is not None] == [9]


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (2, "a"), (2, "a")], "doc_id long, text string")
    rows = audio.telephony_features(audio.store_texts(docs)).collect()
    assert len(rows) == 4 and len({(r["feature"], bytes(r["pcm"])) for r in rows}) == 1 and sum(r["doc_id"] is None for r in rows) == 2
