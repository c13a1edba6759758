"""Telephony audio columns: mu-law and A-law, IMA ADPCM blocks, resampled PCM.

Containers are WAVE files.  mu-law and A-law samples are expanded by lookup
tables; ADPCM blocks are decoded step by step along the block but across all
blocks at once; PCM is resampled linearly with exact integer arithmetic and
stored as 16-bit WAVE.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
#: Bytes of padding and the unit that payloads are padded to.
PAD, UNIT = 255, 576
RATE = 8000


def _mu_law_table() -> np.ndarray:
    """ITU-T G.711 mu-law: complemented sign, exponent and mantissa; bias 132."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 132) << ((u >> 4) & 7)
    return np.where(u & 0x80, 132 - size, size - 132).astype(np.int16)


def _a_law_table() -> np.ndarray:
    """ITU-T G.711 A-law: even bits inverted."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent = (a >> 4) & 7
    size = ((a & 0x0F) << 4) + 8
    size = np.where(exponent > 0, (size + 0x100) << np.maximum(exponent - 1, 0), size)
    return np.where(a & 0x80, size, -size).astype(np.int16)


MU_LAW_TABLE, A_LAW_TABLE = _mu_law_table(), _a_law_table()

#: Fixed values of the IMA ADPCM format: step sizes, and the change of the step index for each code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


#: Rows that a worker holds the bytes of at once, about, and samples that are resampled at once.
SLICE_BYTES, CHUNK = 8 << 20, 1 << 20


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By 16 times the step index plus the code: the change of the sample, and 16 times the next index."""
    step, code = STEPS[:, None], np.arange(16, dtype=np.int32)[None, :]
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    after = np.clip(np.arange(len(STEPS), dtype=np.int32)[:, None] + INDEX_CHANGE[None, :], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


_CHANGE, _NEXT = _adpcm_tables()


def decode_adpcm(data: bytes | np.ndarray, block: int) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks of ``block`` bytes, step by step across all blocks; an incomplete last block is refused."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
    if block < 5 or len(raw) % block:
        raise ValueError("ADPCM data must be whole blocks of at least 5 bytes")
    b = raw.reshape(-1, block)
    value = b[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(b[:, 2].astype(np.int32), len(STEPS) - 1) * 16
    body = np.ascontiguousarray(b[:, 4:].T)
    out = np.empty((2 * len(body) + 1, len(b)), np.int16)
    out[0] = value
    for k in range(2 * len(body)):
        place = at + (body[k >> 1] >> 4 if k & 1 else body[k >> 1] & 15)
        value += _CHANGE[place]
        np.clip(value, -32768, 32767, out=value)
        at = _NEXT[place]
        out[k + 1] = value
    return np.ascontiguousarray(out.T).ravel()


def encode_adpcm(pcm: np.ndarray, block: int = 256) -> bytes:
    """Mono IMA ADPCM blocks of PCM, the last one padded by its last sample; across blocks."""
    per = 2 * (block - 4) + 1
    count = max(1, -(-len(pcm) // per))
    p = np.full(count * per, pcm[-1] if len(pcm) else 0, np.int32)
    p[: len(pcm)] = pcm
    p = p.reshape(count, per)
    value, index = p[:, 0].copy(), np.zeros(count, np.int32)
    out = np.zeros((count, block), np.uint8)
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(-1, 2)
    for k in range(per - 1):
        step = STEPS[index]
        diff = p[:, k + 1] - value
        code = np.where(diff < 0, 8, 0).astype(np.int32)
        left, got = np.abs(diff), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = left >= part
            code |= np.where(take, bit, 0)
            left = left - np.where(take, part, 0)
            got = got + np.where(take, part, 0)
        value = np.clip(value + np.where(code & 8, -got, got), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEPS) - 1)
        out[:, 4 + k // 2] |= (code << (4 * (k % 2))).astype(np.uint8)
    return out.tobytes()


def wave(kind: int, data: bytes, rate: int = RATE, bits: int = 8, block: int = 1) -> bytes:
    """A mono WAVE file."""
    extra = b"" if kind == PCM else struct.pack("<H", 0) if kind != IMA_ADPCM else struct.pack("<HH", 2, 2 * (block - 4) + 1)
    per_second = rate * block if kind != IMA_ADPCM else rate * block // (2 * (block - 4) + 1)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, per_second, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(blob: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, block size and data of a mono WAVE file."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, kind, rate, block = 12, None, 0, 0
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", blob, at + 8)
            if channels != 1:
                raise ValueError("only mono is read")
        elif name == b"data":
            if kind is None or at + 8 + size > len(blob):
                raise ValueError("no format before the data, or data cut short")
            return kind, rate, block, blob[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def decode_wave(blob: bytes) -> tuple[np.ndarray, int]:
    """16-bit PCM and sample rate of a WAVE file of any of the four formats."""
    kind, rate, block, data = parse_wave(blob)
    if kind in (MU_LAW, A_LAW):
        return (MU_LAW_TABLE if kind == MU_LAW else A_LAW_TABLE)[np.frombuffer(data, np.uint8)], rate
    if kind == IMA_ADPCM:
        return decode_adpcm(data, block), rate
    if kind == PCM and block == 2:
        return np.frombuffer(data, "<i2"), rate
    raise ValueError(f"format {kind} isn't read")


def resample(pcm: np.ndarray, rate: int, to: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Linear interpolation at ``to`` samples a second, rounded down; the last sample is held. Samples ``first`` to ``last``, or all."""
    n = len(pcm) * to // rate
    last = n if last is None else min(last, n)
    if rate == to:
        return pcm[first:last].astype(np.int16)
    at = np.arange(first, max(first, last), dtype=np.int64) * rate
    k, rest = at // to, at % to
    here, after = (pcm[np.minimum(k + d, len(pcm) - 1)].astype(np.int64) for d in (0, 1)) if len(at) else (at, at)
    return ((here * (to - rest) + after * rest) // to).astype(np.int16)


class Feature:
    """Samples, peak, energy and sign changes of PCM that comes in chunks; exact integers."""

    def __init__(self) -> None:
        self.n = self.peak = self.energy = self.crossings = 0
        self.below: bool | None = None

    def add(self, pcm: np.ndarray) -> None:
        if not len(pcm):
            return
        p, below = pcm.astype(np.int64), pcm < 0
        self.n, self.peak, self.energy = self.n + len(p), max(self.peak, int(np.abs(p).max())), self.energy + int((p * p).sum())
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + (self.below is not None and bool(below[0]) != self.below)
        self.below = bool(below[-1])

    def __str__(self) -> str:
        return f"n={self.n};peak={self.peak};energy={self.energy};crossings={self.crossings}"


def feature(pcm: np.ndarray) -> str:
    f = Feature()
    f.add(pcm)
    return str(f)


def wave_header(kind: int, size: int, rate: int, bits: int, block: int) -> bytes:
    """What :func:`wave` puts before ``size`` bytes of data."""
    head = wave(kind, b"", rate, bits, block)
    return head[:4] + struct.pack("<I", len(head) - 8 + size + size % 2) + head[8:-4] + struct.pack("<I", size)


def _by_bytes(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes (one longer row is one run)."""
    n = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy().astype(np.int64) + 64)
    i = 0
    while i < len(n):
        j = int(np.searchsorted(n, (n[i - 1] if i else 0) + size, side="right"))
        yield i, (i := max(j, i + 1))


def _pad(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * ((-len(raw)) % UNIT if raw else UNIT)


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in _by_bytes(batch["raw"]):
            part = batch.slice(i, j - i)
            raw = [(t or b"") for t in part["raw"].to_pylist()]
            media = [wave(MU_LAW, _pad(r)) for r in raw]
            yield pa.record_batch([part["id"], pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text's UTF-8 bytes, padded, as the samples of a mu-law WAVE file.

    One row for each input row: ``id``, ``n_bytes`` (without padding) and
    ``media``.  Null texts are empty; an empty payload is one unit of padding.
    Ids may be null or repeat.  Workers hold ``SLICE_BYTES`` of texts at once, or
    one longer text.  An empty table gives no rows.  Other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return d.mapInArrow(_store, "id long, n_bytes long, media binary")


def _decode(rate: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _by_bytes(batch["media"]):
                part = batch.slice(i, j - i)
                out = []
                for blob in part["media"].to_pylist():
                    try:
                        if blob is None:
                            raise ValueError("null")
                        pcm, own = decode_wave(blob)
                        out.append((wave(PCM, resample(pcm, own, rate).astype("<i2").tobytes(), rate, 16, 2), None))
                    except (ValueError, struct.error) as e:
                        out.append((None, str(e)))
                yield pa.record_batch([part["id"], pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["id", "pcm", "error"])

    return decode


def to_pcm(media: DataFrame, rate: int = 16000, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """Decodes mu-law, A-law, ADPCM or PCM WAVE files and stores them as 16-bit PCM WAVE at ``rate``.

    One row for each input row: ``id``, ``pcm``, ``error``; what can't be read,
    nulls included, has a null ``pcm`` and says why.
    """
    d = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return d.mapInArrow(_decode(rate), "id long, pcm binary, error string")


def _read_back(rate: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _by_bytes(batch["media"]):
                part = batch.slice(i, j - i)
                blobs = part["media"].to_pylist()
                files = [parse_wave(b) for b in blobs]
                data = [f[3] for f in files]
                rows = [
                    (len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-32:]), len(b), hashlib.sha256(b).hexdigest(), f"{_stored_pcm(*f[:2], d, rate)};alaw={a};adpcm={c}")
                    for b, f, d, a, c in zip(blobs, files, data, _a_law_crcs(data), _adpcm_crcs(data), strict=True)
                ]
                yield pa.record_batch([part["id"], part["n_bytes"], *[pa.array([r[k] for r in rows], kinds[k + 2]) for k in range(6)]], names=names)

    return read


def _stored_pcm(kind: int, own: int, data: bytes, rate: int) -> str:
    """The feature of a telephony payload's PCM at ``rate``, and the digest of the WAVE file that stores it."""
    pcm, f = (MU_LAW_TABLE if kind == MU_LAW else A_LAW_TABLE)[np.frombuffer(data, np.uint8)], Feature()
    n = len(pcm) * rate // own
    sha = hashlib.sha256(wave_header(PCM, 2 * n, rate, 16, 2))
    for k in range(0, n, CHUNK):
        part = resample(pcm, own, rate, k, k + CHUNK)
        f.add(part)
        sha.update(part.astype("<i2").tobytes())
    return f"{f};pcm={sha.hexdigest()}"


def _a_law_crcs(data: list[bytes]) -> list[int]:
    """Checksums of the payloads expanded as A-law."""
    return [zlib.crc32(A_LAW_TABLE[np.frombuffer(d, np.uint8)].astype("<i2").tobytes()) for d in data]


def _adpcm_crcs(data: list[bytes]) -> list[int]:
    """Checksums of the payloads decoded as ADPCM blocks of ``UNIT`` bytes, all payloads' blocks at once."""
    owner = np.repeat(np.arange(len(data)), [len(d) // UNIT for d in data])
    crc, raw = [0] * len(data), np.frombuffer(b"".join(data), np.uint8).reshape(-1, UNIT)
    step = SLICE_BYTES // UNIT
    for k in range(0, len(raw), step):
        pcm = decode_adpcm(raw[k : k + step].ravel(), UNIT).reshape(-1, 2 * (UNIT - 4) + 1)
        who = owner[k : k + step]
        edge = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1], [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            crc[who[a]] = zlib.crc32(pcm[a:b].astype("<i2").tobytes(), crc[who[a]])
    return crc


def digests(media: DataFrame, rate: int = 16000) -> DataFrame:
    """Reads what :func:`store` made back, and returns digests and a feature.

    The payload is decoded three times: expanded as mu-law, resampled and stored
    as a PCM WAVE file at ``rate`` (the feature's ``n``, ``peak``, ``energy``,
    ``crossings``, and ``pcm``, the file's SHA-256), expanded as A-law, and
    decoded as ADPCM blocks of ``UNIT`` bytes (``alaw`` and ``adpcm``, checksums of
    the samples).  Columns: ``id``, ``n_bytes``, ``payload_bytes``,
    ``payload_sha256``, ``tail_crc32``, ``media_bytes``, ``media_sha256``, ``feature``.
    """
    return media.mapInArrow(
        _read_back(rate),
        "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
