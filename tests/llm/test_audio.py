import hashlib
import zlib

import numpy as np
import pytest

from allelica.llm import audio


def test_laws_by_formula():
    # decoding by the definition: sign, exponent and mantissa bits
    for b in range(256):
        u = ~b & 0xFF
        want = ((2 * (u & 15) + 33) << ((u >> 4) & 7)) - 33
        assert audio.MU_LAW_TABLE[b] == (-want if u & 0x80 else want) * 4
        a = b ^ 0x55
        e, m = (a >> 4) & 7, a & 15
        size = (2 * m + 1) if e == 0 else (2 * m + 33) << (e - 1)
        assert audio.A_LAW_TABLE[b] == (size if a & 0x80 else -size) * 8


def scalar_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            diff = step >> 3
            for bit, k in ((4, 0), (2, 1), (1, 2)):
                diff += (step >> k) if code & bit else 0
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(audio.INDEX_CHANGE[code])))
            out.append(value)
    return out


def test_adpcm():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 5 * 36, dtype=np.uint8)
    got = audio.decode_adpcm(raw.tobytes(), 36).tolist()
    assert got == [v for k in range(5) for v in scalar_adpcm(raw[k * 36 : (k + 1) * 36].tobytes())]
    x = (np.sin(np.arange(4000) / 20) * 8000).astype(np.int16)
    back = audio.decode_adpcm(audio.encode_adpcm(x, 256), 256)[: len(x)].astype(int)
    steady = np.abs(back - x).reshape(-1, 500)[:, 60:]
    assert np.median(steady) < 200
    with pytest.raises(ValueError):
        audio.decode_adpcm(b"123", 36)


def test_resample():
    x = np.array([0, 100, -100], np.int16)
    assert audio.resample(x, 1, 2).tolist() == [0, 50, 100, 0, -100, -100]
    assert audio.resample(x, 2, 2).tolist() == x.tolist() and audio.resample(x[:0], 1, 2).tolist() == []
    assert audio.resample(x, 2, 1).tolist() == [0]


def test_texts_round_trip(spark, monkeypatch):
    monkeypatch.setattr(audio, "CHUNK", 1001)
    monkeypatch.setattr(audio, "SLICE_BYTES", 40 * 576)
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 576), (5, "y" * 577), (6, "héllo"), (None, "z"), (7, "w" * 100_000), (8, "long and varied " * 20_000 + "z")]
    df = spark.createDataFrame([(i, t, b"m") for i, t in rows], "doc_id long, text string, media binary")
    stored = audio.store(df)
    got = {r.id: r for r in audio.digests(stored).collect()}
    files = {r.id: bytes(r.media) for r in stored.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        size = max(1, -(-len(raw) // 576)) * 576
        payload = raw + b"\xff" * (size - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), size, hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes == len(files[i]) and r.media_sha256 == hashlib.sha256(files[i]).hexdigest()
        assert audio.parse_wave(files[i])[3] == payload
        pcm = audio.MU_LAW_TABLE[np.frombuffer(payload, np.uint8)]
        twice = audio.resample(pcm, 8000, 16000)
        a_law = zlib.crc32(audio.A_LAW_TABLE[np.frombuffer(payload, np.uint8)].tobytes())
        samples = [v for k in range(0, min(size, 5760), 576) for v in scalar_adpcm(payload[k : k + 576])]
        assert audio.decode_adpcm(payload, 576)[: len(samples)].tolist() == samples
        adpcm = zlib.crc32(audio.decode_adpcm(payload, 576).tobytes())
        file = audio.wave(audio.PCM, twice.tobytes(), 16000, 16, 2)
        assert r.feature == f"{audio.feature(twice)};pcm={hashlib.sha256(file).hexdigest()};alaw={a_law};adpcm={adpcm}"
        p = twice.astype(int)
        signs = [v < 0 for v in p.tolist()]
        assert audio.feature(twice) == f"n={len(p)};peak={abs(p).max()};energy={(p * p).sum()};crossings={sum(x != y for x, y in zip(signs, signs[1:]))}"
    assert got[1].feature == got[6].feature and got[2].feature == got[3].feature
    assert audio.digests(audio.store(df.limit(0))).count() == 0


def test_formats_to_pcm(spark):
    x = (np.sin(np.arange(1000) / 9) * 5000).astype(np.int16)
    rows = [
        (1, audio.wave(audio.MU_LAW, bytes(range(256)))), (2, audio.wave(audio.A_LAW, bytes(range(255)))), (3, audio.wave(audio.IMA_ADPCM, audio.encode_adpcm(x, 64), bits=4, block=64)),
        (4, audio.wave(audio.PCM, x.astype("<i2").tobytes(), bits=16, block=2)), (5, None), (6, b"nonsense"), (7, audio.wave(audio.MU_LAW, b"abc")[:-2]),
    ]
    got = {r.id: r for r in audio.to_pcm(spark.createDataFrame([(i, m) for i, m in rows], "id long, media binary"), 8000).collect()}
    pcm = lambda i: np.frombuffer(audio.parse_wave(bytes(got[i].pcm))[3], "<i2").tolist()
    assert pcm(1) == audio.MU_LAW_TABLE.tolist() and pcm(2) == audio.A_LAW_TABLE[:255].tolist() and pcm(4) == x.tolist()
    assert len(pcm(3)) >= 1000 and all(got[i].pcm is None and got[i].error for i in (5, 6, 7))
