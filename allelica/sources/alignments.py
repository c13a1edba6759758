"""Aligned reads from and to BAM files, and their pileup.

A BAM file is a row of compressed members, each of which starts with the same
four bytes.  Spark's text source splits it there, wherever the file lies, so a large file is read
by many tasks.  A task finds the first record of its share by what records look
like; a record that two shares have a part of is put together afterwards.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelica.plans.lineage import cut, shared_folder

#: Fixed values of the format: letters of CIGAR operations and of packed bases, what a member starts with, and the last one.
CIGAR, PACKED = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
MAGIC, LAST = b"\x1f\x8b\x08\x04", bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of a member before compression.
MEMBER = 0xFF00
MIN_QUALITY = 30
READS = "scaffold string, read_name string, nm int, mapq int, length long, ref_start long, ref_end long, flag int, cigar string, sequence string, quality string, file_order long"
_NAMES = [c.split()[0] for c in READS.split(", ")]
_SHARE = READS + ", file string, share long, head boolean, rest binary"


def member(data: bytes) -> bytes:
    """One compressed member."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bgzf(data: bytes) -> bytes:
    return b"".join(member(data[k : k + MEMBER]) for k in range(0, len(data), MEMBER)) + LAST


def _size(piece: bytes) -> int:
    """The bytes of a member without its first four, by its header."""
    if len(piece) < 14:
        raise ValueError("not a BAM file, or cut short")
    end, at = 8 + struct.unpack_from("<H", piece, 6)[0], 8
    while at + 4 <= min(end, len(piece)):
        kind, n = piece[at : at + 2], struct.unpack_from("<H", piece, at + 2)[0]
        if kind == b"BC":
            return struct.unpack_from("<H", piece, at + 4)[0] + 1 - len(MAGIC)
        at += 4 + n
    raise ValueError("not a BAM file: a member doesn't tell its size")


def inflate(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The contents of members; a piece that ends where a member only holds the four bytes goes on with the next one."""
    held = b""
    for piece in pieces:
        held = held + MAGIC + piece if held else piece
        if not held:
            continue  # before the first member
        need = _size(held)
        if len(held) < need:
            continue
        start = 8 + struct.unpack_from("<H", held, 6)[0]
        yield zlib.decompress(held[start : need - 8], -15)
        held = b""
    if held:
        raise ValueError("a member of the BAM file isn't whole")


def parse_header(b: bytes) -> tuple[list[str], int] | None:
    """Names of the references and the header's size; None if ``b`` is too short to tell."""
    if len(b) >= 4 and b[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", b, 4)[0]
        n, at, names = struct.unpack_from("<i", b, at)[0], at + 4, []
        for _ in range(n):
            size = struct.unpack_from("<i", b, at)[0]
            if at + 8 + size > len(b):
                return None
            names.append(b[at + 4 : at + 3 + size].decode())
            at += 8 + size
        return names, at
    except struct.error:
        return None


def _row(b: bytes, at: int, names: list[str], order: int) -> tuple | None:
    """The mapped read at a place; None for others."""
    size, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiiBBHHHi", b, at)
    if flag & 4 or ref < 0 or not n_cigar:
        return None
    p = at + 36
    name = b[p : p + l_name - 1].decode()
    p += l_name
    ops = [(v >> 4, CIGAR[v & 15]) for v in struct.unpack_from(f"<{n_cigar}I", b, p)]
    p += 4 * n_cigar
    seq = b[p : p + (l_seq + 1) // 2].hex().translate(_LETTERS)[:l_seq]
    p += (l_seq + 1) // 2
    qual = b[p : p + l_seq].translate(_QUALITY).decode("ascii")
    span = sum(n for n, o in ops if o in "MDN=X")
    length = sum(n for n, o in ops if o in "MIS=X")
    tags = b[p + l_seq : at + 4 + size]
    return names[ref], name, _mismatches(tags), mapq, length, pos, pos + span - 1, flag, "".join(f"{n}{o}" for n, o in ops), seq, qual, order


_LETTERS = str.maketrans("0123456789abcdef", PACKED)
_QUALITY = bytes(min(q, 93) + 33 for q in range(256))


def _whole(b: bytes, at: int) -> int:
    """Where the record at a place ends, if it is whole; else -1."""
    if at + 4 > len(b):
        return -1
    end = at + 4 + struct.unpack_from("<i", b, at)[0]
    return end if end <= len(b) else -1


def _looks_right(b: bytes, at: int, refs: int, more: int = 3) -> bool:
    """Whether records start at a place, as far as ``b`` tells."""
    for _ in range(more):
        if at + 36 > len(b):
            return True
        size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", b, at)
        if not (32 <= size < 1 << 26 and -1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and l_name >= 1 and l_seq >= 0):
            return False
        if 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
            return False
        name = b[at + 36 : at + 36 + l_name]
        if len(name) == l_name and (name[-1:] != b"\0" or any(c < 33 or c > 126 for c in name[:-1])):
            return False
        at += 4 + size
    return True


def _mismatches(tags: bytes) -> int:
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    codes = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
    at = 0
    while at + 3 <= len(tags):
        tag, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            at = tags.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + sizes[chr(tags[at])] * struct.unpack_from("<i", tags, at + 1)[0]
        else:
            if tag == b"NM" and kind in codes:
                return struct.unpack_from(codes[kind], tags, at)[0]
            at += sizes[kind]
    return 0


def _share_rows(pieces: Iterable[bytes], file: str, share: int, names: list[str], header: int) -> Iterator[tuple]:
    """Rows of one share of a file, and what it has of records that other shares have the rest of."""
    order, blank = share * 32, (None,) * len(_NAMES)
    data, found = bytearray(), share == 0
    skip = header if found else 0
    for part in _with_end(inflate(pieces)):
        data += part or b""
        if skip:
            if len(data) < skip:
                if part is None:
                    raise ValueError("the header of the BAM file is longer than its first share")
                continue
            del data[:skip]
            skip = 0
        b = bytes(data)
        at = 0
        if not found:
            if part is not None and len(b) < 1 << 18:
                continue
            at = next((k for k in range(len(b)) if _looks_right(b, k, len(names))), len(b))
            if at:
                yield (*blank, file, share, True, b[:at])
            found = True
        while (end := _whole(b, at)) >= 0:
            row = _row(b, at, names, order)
            order += 1
            at = end
            if row is not None:
                yield (*row, file, share, False, None)
        del data[:at]
    if data:
        yield (*blank, file, share, False, bytes(data))


def _with_end(parts: Iterator[bytes]) -> Iterator[bytes | None]:
    yield from parts
    yield None


def headers(spark: SparkSession, path: str) -> dict[str, tuple[list[str], int]]:
    """Of each file: names of the references and the header's size. Only the start of a file is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    out = {}
    for status in fs.globStatus(at) or []:
        for one in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if one.getPath().getName().startswith(("_", ".")):
                continue
            stream, raw, got = fs.open(one.getPath()), b"", None
            try:
                while got is None:
                    more = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, 1 << 18)))
                    raw += more
                    pieces = raw.split(MAGIC)
                    got = parse_header(b"".join(_as_far_as_whole(pieces)))
                    if got is None and not more:
                        raise ValueError(f"the header of {path} isn't whole")
            finally:
                stream.close()
            out[_plain(one.getPath().toString())] = got
    return out


def _as_far_as_whole(pieces: list[bytes]) -> Iterator[bytes]:
    try:
        yield from inflate(pieces)
    except (ValueError, zlib.error):
        return


def _plain(url: str) -> str:
    """A file's name without the number of slashes after its scheme, which differs."""
    return re.sub(r"^([a-z0-9]+):/+", r"\1:/", unquote(url))


def bam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped reads of BAM files, read by as many tasks as Spark's ``maxPartitionBytes`` asks for.

    ``file_order`` ascends as a file lists its reads.
    """
    known = headers(spark, path)
    d = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    d = d.select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"), F.input_file_block_start().alias("share"))

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _SHARE.split(", ")]
        rows: list[tuple] = []
        for (file, share), pieces in _shares(batches):
            names, header = known[_plain(file)]
            for row in _share_rows(pieces, file, share, names, header):
                rows.append(row)
                if len(rows) == 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        yield pd.DataFrame(rows, columns=columns)

    def join(p: pd.DataFrame) -> pd.DataFrame:
        names, out, held = known[_plain(p["file"].iloc[0])][0], [], b""
        for r in p.sort_values(["share", "head"], ascending=[True, False]).itertuples():
            held = held + bytes(r.rest) if r.head else bytes(r.rest)
            order, at = r.share * 32 - 16, 0
            while r.head and (end := _whole(held, at)) >= 0:
                row = _row(held, at, names, order)
                order, at = order + 1, end
                if row is not None:
                    out.append(row)
        return pd.DataFrame(out, columns=_NAMES)

    whole = cut(d.mapInPandas(read, _SHARE))
    split = whole.where("rest is not null").select("file", "share", "head", "rest").groupBy("file").applyInPandas(join, READS)
    return whole.where("rest is null").select(*_NAMES).unionByName(split)


def _shares(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """The pieces of each share, in order."""
    from itertools import groupby

    rows = (r for batch in batches for r in zip(batch["file"], batch["share"], batch["value"]))
    for key, group in groupby(rows, key=lambda r: (r[0], int(r[1]))):
        yield key, (bytes(r[2]) for r in group)


def _encode(row, refs: dict[str, int]) -> bytes:
    ops = [(int(n), CIGAR.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row.cigar)]
    seq, name = row.sequence, row.read_name.encode() + b"\0"
    codes = [PACKED.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(codes), 2))
    body = struct.pack("<iiBBHHHiiii", refs[row.scaffold], row.ref_start, len(name), row.mapq, 0, len(ops), row.flag, len(seq), -1, -1, 0)
    body += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + bytes(ord(q) - 33 for q in row.quality) + b"NMi" + struct.pack("<i", row.nm)
    return struct.pack("<i", len(body)) + body


def write_bam(reads: DataFrame, lengths: DataFrame, path: str) -> None:
    """Writes reads as one BAM file, sorted by reference and position.

    Tasks sort and compress into parts in the shared folder; no member is a task's result. The driver
    appends parts to the file, by a buffer of 1 MB.
    Reads have the columns of ``READS``; references are ordered by name.
    """
    spark = reads.sparkSession
    refs = [(r.scaffold, r.length) for r in lengths.orderBy("scaffold").collect()]  # a header lists all references
    number = {name: k for k, (name, _) in enumerate(refs)}
    top = b"BAM\1" + struct.pack("<ii", 0, len(refs)) + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = b""
        for batch in batches:
            out = []
            for row in batch.itertuples():
                one = _encode(row, number)
                # a record starts a member rather than cross its end
                if held and len(held) + len(one) > MEMBER:
                    out.append(member(held))
                    held = b""
                held += one
                while len(held) > MEMBER:
                    out.append(member(held[:MEMBER]))
                    held = held[MEMBER:]
            yield pd.DataFrame({"member": out})
        yield pd.DataFrame({"member": [member(held)] if held else []})

    order = ["scaffold", "ref_start", "file_order"]
    members = reads.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(encode, "member binary")
    # what follows a member's first four bytes, which stand in for the end of a line: a part starts after them and ends with the next member's
    parts = f"{shared_folder(spark)}/bam-{uuid.uuid4().hex}"
    rest = F.expr(f"cast(substring(member, {len(MAGIC) + 1}) as string)")
    members.select(rest.alias("value")).write.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, folder = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, parts))
    source = folder.getFileSystem(conf)
    stream = at.getFileSystem(conf).create(at, True)
    try:
        stream.write(bytearray(b"".join(member(top[k : k + MEMBER]) for k in range(0, len(top), MEMBER)) + MAGIC))
        for part in sorted((f.getPath() for f in source.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: _part(p.getName())):
            piece = source.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, stream, 1 << 20, False)
            finally:
                piece.close()
        stream.write(bytearray(LAST[len(MAGIC) :]))
    finally:
        stream.close()
    source.delete(folder, True)


def _part(name: str) -> int:
    """The number of a part file."""
    return int(name.split("-")[1])


def pileup(reads: DataFrame, min_quality: int = MIN_QUALITY) -> DataFrame:
    """``scaffold, position, pair, base``: every aligned base of enough quality, once for each pair and position.

    CIGAR strings are walked by expressions, not by a Python function. Reads of
    pairs that aren't mapped properly are left out.  Where mates overlap, equal
    bases count once with the sum of their qualities (200 at most); of different
    ones the better counts, the first if they tie, with four fifths of its quality.
    Deletions, skips and insertions have no base.  No depth is too great.
    """
    reads = reads.where((F.col("flag").bitwiseAND(1) == 0) | (F.col("flag").bitwiseAND(2) != 0)) if "flag" in reads.columns else reads
    n = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("long"))
    op = F.regexp_extract_all("cigar", F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    ops = F.zip_with(n, op, lambda a, b: F.struct(a.alias("n"), b.alias("op")))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("ref"), zero.alias("read"), F.array().cast("array<struct<ref:bigint,read:bigint,n:bigint>>").alias("runs"))

    def step(acc, o):
        aligned = o["op"].isin("M", "=", "X")
        ref = acc["ref"] + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["n"]).otherwise(zero)
        read = acc["read"] + F.when(o["op"].isin("M", "I", "S", "=", "X"), o["n"]).otherwise(zero)
        run = F.struct(acc["ref"].alias("ref"), acc["read"].alias("read"), o["n"].alias("n"))
        return F.struct(ref.alias("ref"), read.alias("read"), F.when(aligned, F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"]).alias("runs"))

    # mates meet as reads, not as bases
    mates = F.count("*").over(Window.partitionBy("scaffold", "read_name"))
    d = reads.select("scaffold", "read_name", "ref_start", "cigar", "sequence", "quality", "file_order").withColumn("mates", mates)
    # a byte is found at once, a character by counting from the start
    raw = [F.col(c).cast("binary").alias(c) for c in ("sequence", "quality")]
    d = d.select("scaffold", F.col("read_name").alias("pair"), "ref_start", *raw, "file_order", "mates", F.aggregate(ops, start, step)["runs"].alias("runs"))
    d = d.withColumn("run", F.explode("runs")).withColumn("k", F.explode(F.sequence(zero, F.col("run.n") - 1)))
    at = (F.col("run.read") + F.col("k") + 1).cast("int")
    here = (F.col("ref_start") + F.col("run.ref") + F.col("k")).alias("position")
    letter = lambda c: F.substring(c, at, F.lit(1)).cast("string")
    d = d.select("scaffold", "pair", "file_order", "mates", here, letter("sequence").alias("base"), (F.ascii(letter("quality")) - 33).alias("q"))
    # only bases of reads with mates are dealt by position, so that overlaps are found
    alone = d.where("mates = 1").select("scaffold", "position", "pair", "base", "q")
    both = F.struct("base", "q")
    d = d.where("mates > 1").groupBy("scaffold", "position", "pair").agg(F.count("*").alias("n"), F.min_by(both, "file_order").alias("x"), F.max_by(both, "file_order").alias("y"))
    one, same, first = F.col("n") == 1, F.col("x.base") == F.col("y.base"), F.col("x.q") >= F.col("y.q")
    q = F.when(one, F.col("x.q")).when(same, F.least(F.col("x.q") + F.col("y.q"), F.lit(200))).otherwise(F.floor(F.greatest("x.q", "y.q") * 0.8))
    base = F.when(one | same | first, F.col("x.base")).otherwise(F.col("y.base"))
    d = d.select("scaffold", "position", "pair", base.alias("base"), q.alias("q")).unionByName(alone)
    return d.where(F.col("q") >= min_quality).select("scaffold", "position", "pair", "base").where(F.col("base").isin("A", "C", "T", "G"))
