"""Binary alignment files, read in ranges of blocks, in Python and without native libraries.

Such a file is a row of gzip members whose headers all begin with the same 16
bytes. Spark's text source splits at those bytes, so a file of any size is cut
into ranges of blocks, and a task inflates its blocks one after another. Where
the first record of a range starts is found from the fields of the records that
follow; the bytes before it and after the last whole record are stitched
together with those of the neighbouring ranges, which must give whole records,
so a wrong start cannot go unseen.
"""

from __future__ import annotations

import functools
import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import reads as R
from spanloom.session import checkpointed

# The codes of bases and of cigar operations, and the start of a block's header.
BASES = "=ACMGRSVTWYHKDBN"
KINDS = "MIDNSHP=X"
BLOCK_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
BATCH = 10_000
#: Records that must follow each other for a start to be taken as one.
CHAIN = 8
FIXED = struct.Struct("<iiBBHHHiiii")
RECORD = struct.Struct("<iiiBBHHHiiii")


def inflate(data: bytes) -> Iterator[bytes]:
    """The contents of consecutive gzip members."""
    view = memoryview(data)
    while len(view):
        member = zlib.decompressobj(31)
        out = member.decompress(view)
        yield out
        if not member.eof:
            raise ValueError("the file ends within a block")
        view = view[len(view) - len(member.unused_data) :]


def _block(rest: bytes) -> bytes:
    """The contents of one block, given without the start of its header."""
    member = zlib.decompressobj(-15)
    out = member.decompress(rest[2:])
    if not member.eof or len(member.unused_data) < 8 or struct.unpack_from("<I", member.unused_data)[0] != zlib.crc32(out):
        raise ValueError("a block is cut short or damaged")
    return out


def header(data: bytes) -> tuple[list[str], int] | None:
    """The names of the reference sequences and where the records start; None if the bytes end before."""
    if data[:4] != b"BAM\x01"[: len(data[:4])]:
        raise ValueError("not a binary alignment file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        (many,) = struct.unpack_from("<i", data, at)
        at, names = at + 4, []
        for _ in range(many):
            (n,) = struct.unpack_from("<i", data, at)
            if at + 8 + n > len(data):
                return None
            names.append(data[at + 4 : at + 4 + n].rstrip(b"\0").decode())
            at += 8 + n
    except struct.error:
        return None
    return names, at


def _plausible(data: bytes, at: int) -> int:
    """Where the record that may start here ends; -1 if none can, 0 if the bytes end before."""
    if at + 36 > len(data):
        return 0
    (size,) = struct.unpack_from("<i", data, at)
    ref, pos, l_name, _, _, n_ops, _, l_seq, ref2, pos2, _ = FIXED.unpack_from(data, at + 4)
    least = 32 + l_name + 4 * n_ops + (max(l_seq, 0) + 1) // 2 + max(l_seq, 0)
    if min(ref, pos, ref2, pos2) < -1 or l_seq < 0 or l_name < 2 or size < least:
        return -1
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] != 0 or not all(33 <= b <= 126 for b in name[:-1])):
        return -1
    ops = data[at + 36 + l_name : at + 36 + l_name + 4 * n_ops : 4]
    if any(b & 15 > 8 for b in ops):
        return -1
    return at + 4 + size if at + 4 + size <= len(data) else 0


def first_record(data: bytes) -> int | None:
    """The first place from which plausible records follow each other; None if the bytes do not tell."""
    for start in range(len(data) - 36):
        at, chain = start, 0
        while chain < CHAIN and (end := _plausible(data, at)) > 0:
            at, chain = end, chain + 1
            if at == len(data):
                break
        # A chain counts if it is long enough, or if it runs, unbroken, to the end of the bytes.
        if chain == CHAIN or chain and (at == len(data) or _plausible(data, at) == 0):
            return start
    return None


def whole_records(data: bytes, at: int) -> int:
    """The end of the last whole record."""
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<i", data, at)
        if size < 32:
            raise ValueError("damaged alignment record")
        if at + 4 + size > len(data):
            break
        at += 4 + size
    return at


#: The two bases of each byte, as its two hexadecimal digits name them.
_LETTERS = str.maketrans("0123456789abcdef", BASES)


@functools.lru_cache(1 << 16)
def _cigar(ops: bytes) -> str:
    return "".join(f"{op >> 4}{KINDS[op & 15]}" for op in struct.unpack(f"<{len(ops) // 4}I", ops)) or "*"


@functools.lru_cache(1 << 16)
def _ops(cigar: str) -> bytes:
    ops, length = [], 0
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            length = 10 * length + int(c)
        else:
            ops.append(length << 4 | KINDS.index(c))
            length = 0
    return struct.pack(f"<{len(ops)}I", *ops)


def decoded(data: bytes, at: int, end: int) -> Iterator[tuple]:
    """(qname, flag, ref, pos, mapq, cigar, ref_next, pos_next, seq) of each alignment; references are numbers."""
    fixed = RECORD.unpack_from
    while at < end:
        size, ref, pos, l_name, mapq, _, n_ops, flag, l_seq, ref2, pos2, _ = fixed(data, at)
        spot = at + 36 + l_name
        bases = spot + 4 * n_ops
        seq = data[bases : bases + (l_seq + 1) // 2].hex().translate(_LETTERS)[:l_seq] or "*"
        yield data[at + 36 : spot - 1].decode(), flag, ref, pos + 1, mapq, _cigar(data[spot:bases]), ref2, pos2 + 1, seq
        at += 4 + size


def records(data: bytes) -> Iterator[tuple]:
    """(qname, flag, chr, pos, mapq, cigar, chr_next, pos_next, seq) of each alignment of a whole file."""
    plain = b"".join(inflate(data))
    found = header(plain)
    if found is None or whole_records(plain, found[1]) != len(plain):
        raise ValueError("the file ends within its header or a record")
    names, at = found
    for name, flag, ref, pos, mapq, cigar, ref2, pos2, seq in decoded(plain, at, len(plain)):
        yield name, flag, names[ref] if ref >= 0 else "*", pos, mapq, cigar, names[ref2] if ref2 >= 0 else "*", pos2, seq


@functools.lru_cache(1 << 12)
def _bases(seq: str) -> tuple[int, bytes]:
    """The number of bases, and them and their missing qualities as bytes."""
    bases = "" if seq == "*" else seq
    codes = [BASES.index(b) for b in bases] + [0] * (len(bases) % 2)
    return len(bases), bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + b"\xff" * len(bases)


def encoded(rows: Iterable[tuple], names: list[str], block: int = 60_000) -> bytes:
    """A whole file of rows like those of ``records``."""
    number = {name: k for k, name in enumerate(names)} | {"*": -1}
    out = [b"BAM\x01" + struct.pack("<ii", 0, len(names))]
    out += [struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", (1 << 31) - 1) for n in names]
    for name, flag, ref, pos, mapq, cigar, ref2, pos2, seq in rows:
        raw, ops, (n, bases) = name.encode() + b"\0", _ops(cigar), _bases(seq)
        size = 32 + len(raw) + len(ops) + len(bases)
        out.append(RECORD.pack(size, number[ref], pos - 1, len(raw), mapq, 0, len(ops) // 4, flag, n, number[ref2], pos2 - 1, 0) + raw + ops + bases)
    plain, packed = b"".join(out), []
    for at in [*range(0, len(plain), block), len(plain)]:
        chunk = plain[at : at + block]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(chunk) + packer.flush()
        packed.append(BLOCK_HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(chunk), len(chunk)))
    return b"".join(packed)


COLUMNS = "qname string, flag int, chr string, pos long, mapq int, cigar string, chr_next string, pos_next long, seq string"


FIELDS = ("qname", "flag", "ref", "pos", "mapq", "cigar", "ref_next", "pos_next", "seq")
RANGE = "path string, qname string, flag int, ref int, pos long, mapq int, cigar string, ref_next int, pos_next long, seq string"


def _frames(path: str, rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append((path, *row))
        if len(held) == BATCH:
            yield pd.DataFrame(held, columns=["path", *FIELDS])
            held = []
    yield pd.DataFrame(held, columns=["path", *FIELDS])


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, bytes]]:
    """(path, start, contents) of each range of blocks; its rows follow each other."""
    key, held = None, []
    for batch in batches:
        for path, start, rest in zip(batch["path"], batch["start"], batch["rest"], strict=True):
            if (path, start) != key:
                if key:
                    yield *key, b"".join(held)
                key, held = (path, start), []
            # A file starts with a header, so what stands before the first one is empty.
            if len(rest):
                held.append(_block(bytes(rest)))
    if key:
        yield *key, b"".join(held)


def _inner(start: int, data: bytes) -> tuple[int, int] | None:
    """Where the range's own whole records start and end."""
    if start:
        at = first_record(data)
    else:
        at = (header(data) or (None, None))[1]
    return None if at is None else (at, whole_records(data, at))


def _rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for path, start, data in _ranges(batches):
        if found := _inner(start, data):
            yield from _frames(path, decoded(data, *found))


def _edges_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each range cannot decode by itself: its names, the bytes before its records and those after."""
    for path, start, data in _ranges(batches):
        found = _inner(start, data)
        at, end = found or (len(data), len(data))
        names = header(data)[0] if found and not start else None
        yield pd.DataFrame([(path, start, names, found is not None, b"" if names is not None else data[:at], data[end:])], columns=["path", "start", "names", "known", "before", "after"])


def _stitched(edges: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    """The names of a file, and the records that span ranges."""
    edges = edges.sort_values("start")
    names, rows, open_bytes = None, [], b""
    for own, known, before, after in zip(edges["names"], edges["known"], edges["before"], edges["after"], strict=True):
        open_bytes += bytes(before)
        if own is not None:
            names = list(own)
        if not known:
            continue
        if names is None:
            found = header(open_bytes)
            if found is None:
                raise ValueError("the file ends within its header")
            names, open_bytes = found[0], open_bytes[found[1] :]
        if whole_records(open_bytes, 0) != len(open_bytes):
            raise ValueError("the records of two ranges of blocks do not meet")
        rows += decoded(open_bytes, 0, len(open_bytes))
        open_bytes = bytes(after)
    if names is None:
        found = header(open_bytes)
        if found is None:
            raise ValueError("the file ends within its header")
        names, open_bytes = found[0], open_bytes[found[1] :]
    if whole_records(open_bytes, 0) != len(open_bytes):
        raise ValueError("the file ends within a record")
    return names, rows + list(decoded(open_bytes, 0, len(open_bytes)))


def _names_of(edges: pd.DataFrame) -> pd.DataFrame:
    names, _ = _stitched(edges)
    return pd.DataFrame([(edges["path"].iloc[0], k, name) for k, name in enumerate(names)], columns=["path", "ref", "name"])


def _spanning(edges: pd.DataFrame) -> pd.DataFrame:
    _, rows = _stitched(edges)
    return pd.DataFrame([(edges["path"].iloc[0], *r) for r in rows], columns=["path", *FIELDS])


def read_bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments like those of ``read_sam``; a file is as many tasks as it has splits.

    The blocks are inflated twice: once for the edges of their ranges, a record
    or so each, which are written, and once for the records.
    """
    paths = [path] if isinstance(path, str) else path
    cut = spark.read.option("lineSep", BLOCK_HEAD.decode("latin-1")).option("encoding", "ISO-8859-1").text(paths)
    blocks = cut.select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("rest"))
    edges = checkpointed(blocks.mapInPandas(_edges_of, "path string, start long, names array<string>, known boolean, before binary, after binary"))
    names = edges.groupBy("path").applyInPandas(_names_of, "path string, ref int, name string")
    rows = blocks.mapInPandas(_rows_of, RANGE).unionByName(edges.groupBy("path").applyInPandas(_spanning, RANGE))
    own = names.select(F.col("path").alias("_p"), F.col("ref").alias("_r"), F.col("name").alias("chr"))
    mate = names.select(F.col("path").alias("_p2"), F.col("ref").alias("_r2"), F.col("name").alias("chr_next"))
    named = rows.join(own, (F.col("path") == F.col("_p")) & (F.col("ref") == F.col("_r")), "left").join(mate, (F.col("path") == F.col("_p2")) & (F.col("ref_next") == F.col("_r2")), "left")
    return _standard(named.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("chr", "chr_next")}), "path")


def parse_bam(files: DataFrame, keep: str = "path") -> DataFrame:
    """The alignments of whole files that are values of the column ``content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch[keep], batch["content"], strict=True):
                rows = records(bytes(content))
                while held := list(itertools.islice(rows, BATCH)):
                    frame = pd.DataFrame(dict(zip(names, zip(*held, strict=True), strict=True)))
                    frame.insert(0, keep, name)
                    yield frame

    kind = files.schema[keep].dataType.simpleString()
    names = ["qname", "flag", "chr", "pos", "mapq", "cigar", "chr_next", "pos_next", "seq"]
    return _standard(files.select(keep, "content").mapInPandas(run, f"{keep} {kind}, {COLUMNS}"), keep)


def _standard(rows: DataFrame, keep: str) -> DataFrame:
    return rows.select(
        keep, "qname", "flag", R.standard_chromosome("chr").alias("chr"), "pos", "mapq", "cigar", R.query_length().cast("int").alias("qlen"), R.reference_length().cast("int").alias("rlen"),
        R.standard_chromosome("chr_next").alias("chr_next"), "pos_next", "seq",
    )


def write_columnar(alignments: DataFrame, path: str) -> None:
    """Alignments as Parquet, by chromosome and sorted by position, with their ends, so that windows prune files and row groups."""
    binned = alignments.withColumn("end_pos", R.end_position()).withColumn("_bin", F.floor(F.col("pos") / 10_000_000))
    binned.repartition("chr", "_bin").sortWithinPartitions("chr", "pos").drop("_bin").write.mode("overwrite").partitionBy("chr").parquet(path)


def read_window(spark: SparkSession, path: str, chromosome: str, low: int, high: int) -> DataFrame:
    """The alignments of a columnar store that touch [low, high], however long they are; all three predicates reach the scan."""
    rows = spark.read.parquet(path)
    return rows.filter((F.col("chr") == chromosome) & (F.col("pos") <= high) & (F.col("end_pos") >= low)).select(*(c for c in rows.columns if c != "end_pos"))
