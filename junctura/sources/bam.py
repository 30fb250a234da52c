"""Alignments in BAM files as a Spark data source, read and written.

``read`` makes a partition for each stretch of a file between two places of its index, so large files are read by many tasks; chromosomes, regions, samples and
mapping qualities that are asked for decide which stretches are planned and which records leave a task. Filters on seqname, sample_id and
mapq of the DataFrame do the same where Spark pushes them (``spark.sql.python.filterPushdown.enabled``). Files without an index are one partition each.

``write`` deals the rows by ranges of sample and place, so a large sample becomes several files, each with its index. Only the files that the manifest
of a folder names are read, so what failed or repeated tasks leave behind does no harm.

Paths are those of pyarrow's file systems: local ones or URIs. Sequences of reads and their qualities are not kept: counting needs neither.
"""

from __future__ import annotations

import bisect
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, WriterCommitMessage

SCHEMA = "read_id string, sample_id string, seqname string, pos int, cigar string, strand string, mate int, mapq int, flag int"
#: Fixed values of the format: CIGAR operations in order, those that use up reference bases, the block that ends a file, flags.
OPERATIONS = "MIDNSHP=X"
ON_REFERENCE = frozenset("MDN=X")
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
PAIRED, UNMAPPED, REVERSE, FIRST, SECOND = 0x1, 0x4, 0x10, 0x40, 0x80
#: Bytes of one block before compression, at most; bases of a window of the index.
BLOCK, WINDOW_BITS = 0xFF00, 14
MANIFEST = "manifest.json"
#: Compressed bytes of a partition, about, and decompressed bytes that a task holds at a time.
SPLIT, SLICE = 32 << 20, 8 << 20
_FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("span", "<i4")])


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def bin_of(start: int, end: int) -> int:
    """The index bin of 0-based [start, end): the smallest of the nested bins of 2^14 to 2^29 bases that holds all of it."""
    for bits in range(WINDOW_BITS, 29, 3):
        if start >> bits == (end - 1) >> bits:
            return ((1 << (29 - bits)) - 1) // 7 + (start >> bits)
    return 0


# --- writing ------------------------------------------------------------------------------------------


class _File:
    """One BAM file of rows in order, block by block, and its index."""

    def __init__(self, store: pafs.FileSystem, path: str, sample: str, references: list[tuple[str, int]]) -> None:
        self.store, self.path, self.references = store, path, references
        self.out = store.open_output_stream(path)
        self.at, self.buffer = 0, bytearray()
        self.known = {name: i for i, (name, _) in enumerate(references)}
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in references]
        self.windows: list[list[int]] = [[] for _ in references]
        self.cigars: dict[str, tuple[bytes, int, int]] = {}
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references) + f"@RG\tID:1\tSM:{sample}\n"
        head = b"BAM\1" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(references))
        for name, size in references:
            head += struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
        self.buffer += head
        self._flush(True)

    def _flush(self, all_: bool = False) -> None:
        while len(self.buffer) > BLOCK or (all_ and self.buffer):
            data, self.buffer = bytes(self.buffer[:BLOCK]), self.buffer[BLOCK:]
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = packer.compress(data) + packer.flush()
            block = struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))
            self.out.write(block)
            self.at += len(block)

    def _packed_cigar(self, cigar: str) -> tuple[bytes, int, int]:
        """Packed operations, their number, and the bases of the reference that they span."""
        if (found := self.cigars.get(cigar)) is None:
            ops, n, span = [], 0, 0
            for c in cigar:
                if c.isdigit():
                    n = 10 * n + int(c)
                else:
                    ops.append(n << 4 | OPERATIONS.index(c))
                    span += n if c in ON_REFERENCE else 0
                    n = 0
            found = self.cigars[cigar] = (struct.pack(f"<{len(ops)}I", *ops), len(ops), span)
        return found

    def add(self, row) -> None:
        ref, pos = self.known[row.seqname], row.pos - 1
        cigar, n_ops, span = self._packed_cigar(row.cigar)
        end = pos + max(span, 1)
        name = str(row.read_id).encode() + b"\0"
        flag = (REVERSE if row.strand == "-" else 0) | {1: PAIRED | FIRST, 2: PAIRED | SECOND}.get(row.mate, 0)
        body = struct.pack("<2i2B3H4i", ref, pos, len(name), 255 if row.mapq is None else row.mapq, bin_of(pos, end), n_ops, flag, 0, -1, -1, 0) + name + cigar + b"RGZ1\0"
        begin = self._place()
        self.buffer += struct.pack("<i", len(body)) + body
        done = self._place()
        chunks = self.bins[ref].setdefault(bin_of(pos, end), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = done
        else:
            chunks.append([begin, done])
        windows = self.windows[ref]
        last = (end - 1) >> WINDOW_BITS
        windows += [0] * (last + 1 - len(windows))
        for w in range(pos >> WINDOW_BITS, last + 1):
            windows[w] = windows[w] or begin

    def _place(self) -> int:
        """The virtual offset of the next byte: where its block begins, and how far behind it is there."""
        while len(self.buffer) >= BLOCK:
            self._flush(len(self.buffer) == BLOCK)
        return self.at << 16 | len(self.buffer)

    def close(self) -> None:
        self._flush(True)
        self.out.write(LAST_BLOCK)
        self.out.close()
        index = [b"BAI\1", struct.pack("<i", len(self.references))]
        for bins, windows in zip(self.bins, self.windows, strict=True):
            index.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                index.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<2Q", *c) for c in chunks))
            index.append(struct.pack("<i", len(windows)) + struct.pack(f"<{len(windows)}Q", *windows))
        with self.store.open_output_stream(f"{self.path}.bai") as out:
            out.write(b"".join(index))


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class BamWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.references = [(n, int(size)) for n, size in json.loads(options["references"])]

    def write(self, rows: Iterator) -> _Written:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        files: list[str] = []
        current, sample = None, None
        try:
            for row in rows:
                if current is None or row.sample_id != sample:
                    if current is not None:
                        current.close()
                    sample = row.sample_id
                    files.append(f"{uuid.uuid4().hex}.bam")
                    current = _File(store, f"{path}/{files[-1]}", str(sample), self.references)
                current.add(row)
        finally:
            if current is not None:
                current.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, path = _store(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if not self.overwrite:
            files = _listed(self.path) + files
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(set(files))).encode())

    def abort(self, messages: list) -> None:
        store, path = _store(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            for name in (f, f"{f}.bai"):
                if store.get_file_info(f"{path}/{name}").type != pafs.FileType.NotFound:
                    store.delete_file(f"{path}/{name}")


def _listed(path: str) -> list[str]:
    """The files of a folder: those of its manifest, or all BAM files where it has none."""
    store, at = _store(path.rstrip("/"))
    info = store.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [posixpath.basename(at)]
    if info.type == pafs.FileType.NotFound:
        return []
    if store.get_file_info(f"{at}/{MANIFEST}").type == pafs.FileType.File:
        with store.open_input_stream(f"{at}/{MANIFEST}") as src:
            return json.loads(src.read())
    return sorted(posixpath.basename(f.path) for f in store.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".bam"))


# --- reading ------------------------------------------------------------------------------------------


def _blocks(src: pa.NativeFile, at: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """Place and data of the blocks from ``at`` to the one at ``end``."""
    src.seek(at)
    while end is None or at <= end:
        head = src.read(12)
        if len(head) < 12:
            return
        extra = src.read(struct.unpack_from("<H", head, 10)[0])
        i = 0
        while extra[i : i + 2] != b"BC":
            i += 4 + struct.unpack_from("<H", extra, i + 2)[0]
        size = struct.unpack_from("<H", extra, i + 4)[0] + 1
        body = src.read(size - 12 - len(extra))
        yield at, zlib.decompress(body[:-8], -15)
        at += size


def read_header(store: pafs.FileSystem, path: str) -> tuple[str | None, list[tuple[str, int]], int]:
    """Sample, references and the virtual offset of the first record."""
    data, places = b"", []
    with store.open_input_file(path) as src:
        for at, block in _blocks(src, 0, None):
            places.append((len(data), at))
            data += block
            if (found := _parsed_header(data)) is not None:
                sample, references, size = found
                first, at = max(p for p in places if p[0] <= size)
                if size == len(data):  # the first record begins the next block
                    return sample, references, (src.tell() << 16)
                return sample, references, at << 16 | (size - first)
    raise ValueError(f"{path} is no BAM file, or is cut off")


def _parsed_header(data: bytes) -> tuple[str | None, list[tuple[str, int]], int] | None:
    if data[:4] != b"BAM\1"[: len(data[:4])]:
        raise ValueError("not a BAM file")
    try:
        (n,) = struct.unpack_from("<i", data, 4)
        text = data[8 : 8 + n].rstrip(b"\0").decode()
        at = 8 + n
        (n_refs,) = struct.unpack_from("<i", data, at)
        at += 4
        references = []
        for _ in range(n_refs):
            (size,) = struct.unpack_from("<i", data, at)
            name = data[at + 4 : at + 3 + size].decode()
            (length,) = struct.unpack_from("<i", data, at + 4 + size)
            references.append((name, length))
            at += 8 + size
    except struct.error:
        return None
    samples = [f[3:] for line in text.split("\n") if line.startswith("@RG") for f in line.split("\t") if f.startswith("SM:")]
    return (samples[0] if samples else None), references, at


#: Of a reference: the chunks of each bin as pairs of virtual offsets, and the first offset of each window, 0 for windows without records.
Index = tuple[dict[int, list[tuple[int, int]]], list[int]]


def read_index(store: pafs.FileSystem, path: str) -> list[Index]:
    with store.open_input_stream(path) as src:
        data = src.read()
    (n,) = struct.unpack_from("<i", data, 4)
    at, out = 8, []
    for _ in range(n):
        (n_bins,) = struct.unpack_from("<i", data, at)
        at, bins = at + 4, {}
        for _ in range(n_bins):
            number, n_chunks = struct.unpack_from("<Ii", data, at)
            if number < 37450:  # higher numbers hold statistics
                v = struct.unpack_from(f"<{2 * n_chunks}Q", data, at + 8)
                bins[number] = list(zip(v[::2], v[1::2], strict=True))
            at += 8 + 16 * n_chunks
        (n_windows,) = struct.unpack_from("<i", data, at)
        out.append((bins, list(struct.unpack_from(f"<{n_windows}Q", data, at + 4))))
        at += 4 + 8 * n_windows
    return out


@dataclass
class Stretch(InputPartition):
    """Records of a file from one virtual offset up to another, of ranges of 0-based places by reference (None: all of it)."""

    path: str
    sample: str | None
    begin: int
    end: int | None
    wanted: dict[int, list[tuple[int, int]] | None] | None


def bins_over(low: int, high: int) -> Iterator[int]:
    """The bins whose records may overlap 0-based [low, high)."""
    for bits in range(WINDOW_BITS, 30, 3):
        first = ((1 << (29 - bits)) - 1) // 7
        yield from range(first + (low >> bits), first + (min(high - 1, (1 << 29) - 1) >> bits) + 1)


def planned(index: Index, ranges: list[tuple[int, int]] | None, split: int) -> list[tuple[int, int]]:
    """Disjoint stretches of virtual offsets with the records of a reference that overlap the ranges, cut where about ``split`` compressed bytes have come together.

    They begin and end with records: chunks of the bins do, and so do the first offsets of windows.
    """
    bins, windows = index
    if ranges is None:
        chunks = [c for own in bins.values() for c in own]
    else:
        chunks = []
        for low, high in ranges:
            # no record before this offset reaches the range
            least = next((w for w in windows[low >> WINDOW_BITS :] if w), 1 << 63)
            chunks += [(max(a, least), b) for k in bins_over(low, high) for a, b in bins.get(k, ()) if b > least]
    merged: list[list[int]] = []
    for a, b in sorted(chunks):
        # a gap of less than a block is read along
        if merged and (a >> 16) - (merged[-1][1] >> 16) <= BLOCK:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, starts = [], sorted({w for w in windows if w})
    for a, b in merged:
        for w in starts[bisect.bisect_right(starts, a) : bisect.bisect_left(starts, b)]:
            if (w >> 16) - (a >> 16) >= split:
                out.append((a, w))
                a = w
        out.append((a, b))
    return out


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of so many bytes from so many places."""
    bounds = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=bounds[1:])
    at = np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(bounds), pa.py_buffer(data[at]))


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"].rstrip("/"), int(options.get("splitbytes", SPLIT))
        self.regions = json.loads(options["regions"]) if "regions" in options else None  # [seqname, first, last], 1-based, both ends in
        self.min_mapq = int(options.get("minmapq", 0))
        self.chromosomes = set(json.loads(options["chromosomes"])) if "chromosomes" in options else None
        self.samples = set(json.loads(options["samples"])) if "samples" in options else None

    def _wanted(self, references: list[tuple[str, int]]) -> dict[int, list[tuple[int, int]] | None] | None:
        """The references that are asked for, with their ranges; None for all of them."""
        if self.regions is None and self.chromosomes is None:
            return None
        out: dict[int, list[tuple[int, int]] | None] = {}
        for i, (name, _) in enumerate(references):
            if self.chromosomes is not None and name not in self.chromosomes:
                continue
            if self.regions is None:
                out[i] = None
            elif own := [(a - 1, b) for n, a, b in self.regions if n == name and b >= a]:
                out[i] = own
        return out

    def partitions(self) -> list[Stretch]:
        store, at = _store(self.path)
        whole = store.get_file_info(at).type == pafs.FileType.File
        out: list[Stretch] = []
        for name in _listed(self.path):
            path = self.path if whole else f"{self.path}/{name}"
            own = at if whole else f"{at}/{name}"
            sample, references, first = read_header(store, own)
            if self.samples is not None and sample not in self.samples:
                continue
            wanted = self._wanted(references)
            if store.get_file_info(f"{own}.bai").type == pafs.FileType.NotFound:
                out.append(Stretch(path, sample, first, None, wanted))
                continue
            for i, index in enumerate(read_index(store, f"{own}.bai")):
                if wanted is None or i in wanted:
                    ranges = None if wanted is None else wanted[i]
                    out += [Stretch(path, sample, a, b, {i: ranges}) for a, b in planned(index, ranges, self.split)]
        return out

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        store, path = _store(part.path)
        _, references, _ = read_header(store, path)
        names = pa.array([n for n, _ in references], pa.string())
        cigars: dict[bytes, tuple[str, int]] = {}
        with store.open_input_file(path) as src:
            held, skip = b"", part.begin & 0xFFFF
            parts: list[bytes] = []
            size = 0
            for at, block in _blocks(src, part.begin >> 16, None if part.end is None else part.end >> 16):
                if part.end is not None and at == part.end >> 16:
                    block = block[: part.end & 0xFFFF]
                parts.append(block[skip:])
                size += len(block) - skip
                skip = 0
                if size >= SLICE:
                    held = yield from self._records(held + b"".join(parts), part, names, cigars)
                    parts, size = [], 0
            held = yield from self._records(held + b"".join(parts), part, names, cigars)
            if held:
                raise ValueError(f"{path} is cut off")

    def _records(self, data: bytes, part: Stretch, names: pa.Array, cigars: dict) -> Iterator[pa.RecordBatch]:
        """A batch of the whole records; the bytes of the last one that is not whole go back."""
        at, offsets = 0, []
        while at + 4 <= len(data):
            nxt = at + 4 + int.from_bytes(data[at : at + 4], "little")
            if nxt > len(data):
                break
            offsets.append(at)
            at = nxt
        rest = data[at:]
        if not offsets:
            return rest
        raw = np.frombuffer(data, np.uint8)
        where = np.array(offsets)
        f = np.ascontiguousarray(raw[where[:, None] + np.arange(_FIXED.itemsize)]).view(_FIXED)[:, 0]
        keep = (f["flag"] & UNMAPPED == 0) & (f["ref"] >= 0) & (f["mapq"] >= self.min_mapq)
        if part.wanted is not None:
            keep &= np.isin(f["ref"], list(part.wanted))
        where, f = where[keep], f[keep]
        name_at = where + _FIXED.itemsize
        ops_at = name_at + f["name"]
        found = []
        for a, n in zip(ops_at.tolist(), f["ops"].tolist(), strict=True):
            packed = data[a : a + 4 * n]
            if (known := cigars.get(packed)) is None:
                ops = [(x >> 4, OPERATIONS[x & 15]) for x in struct.unpack(f"<{n}I", packed)]
                known = cigars[packed] = ("".join(f"{k}{c}" for k, c in ops), sum(k for k, c in ops if c in ON_REFERENCE))
            found.append(known)
        if part.wanted is not None and any(part.wanted.values()):
            spans = np.array([s for _, s in found], np.int64)
            inside = np.zeros(len(f), bool)
            for ref, ranges in part.wanted.items():
                for low, high in ranges or [(0, 1 << 40)]:
                    inside |= (f["ref"] == ref) & (f["pos"] < high) & (f["pos"] + np.maximum(spans, 1) > low)
            where, f, name_at = where[inside], f[inside], name_at[inside]
            found = [x for x, ok in zip(found, inside.tolist(), strict=True) if ok]
        flag = f["flag"].astype(np.int32)
        mate = np.where(flag & PAIRED == 0, 0, np.where(flag & FIRST > 0, 1, np.where(flag & SECOND > 0, 2, 0)))
        columns = [
            _gathered(raw, name_at, f["name"].astype(np.int64) - 1),
            pa.array([part.sample] * len(f), pa.string()),
            names.take(pa.array(f["ref"])),
            pa.array(f["pos"] + 1, pa.int32()),
            pa.array([c for c, _ in found], pa.string()),
            pa.array(np.where(flag & REVERSE > 0, "-", "+").tolist(), pa.string()),
            pa.array(mate, pa.int32(), mask=mate == 0),
            pa.array(f["mapq"].astype(np.int32), pa.int32(), mask=f["mapq"] == 255),
            pa.array(flag, pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["read_id", "sample_id", "seqname", "pos", "cigar", "strand", "mate", "mapq", "flag"])
        return rest


class FilteringReader(BamReader):
    """Takes over filters; Spark refuses such readers where it does not push any."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and name in ("seqname", "sample_id"):
                field = "chromosomes" if name == "seqname" else "samples"
                before = getattr(self, field)
                setattr(self, field, values if before is None else before & values)
            elif name == "mapq" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.min_mapq = max(self.min_mapq, f.value + isinstance(f, GreaterThan))
            else:
                yield f


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else BamReader)(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, overwrite)


# --- for users ----------------------------------------------------------------------------------------


def read_alignments(spark: SparkSession, path: str, chromosomes: list[str] | None = None, regions: list[tuple[str, int, int]] | None = None, samples: list[str] | None = None, min_mapq: int | None = None, split: int = SPLIT) -> DataFrame:
    """Mapped alignments of a BAM file or a folder of them (``SCHEMA``); sample_id is the sample of a file's read group.

    ``regions``: sequence, first and last base; only records that overlap one of them are read.
    """
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("splitBytes", split).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, value in (("chromosomes", chromosomes), ("regions", regions), ("samples", samples)):
        if value is not None:
            reader = reader.option(name, json.dumps(list(value)))
    return (reader if min_mapq is None else reader.option("minMapq", min_mapq)).load(path)


def write_alignments(alignments: DataFrame, path: str, references: list[tuple[str, int]], mode: str = "overwrite") -> None:
    """Alignments (read_id, sample_id, seqname, pos, cigar, strand, and mate and mapq where there are such) as indexed BAM files.

    ``references``: name and length of every sequence, in the order of the files; alignments elsewhere are an error.
    """
    spark = alignments.sparkSession
    spark.dataSource.register(BamSource)
    has = set(alignments.columns)
    optional = [F.col(c).cast("int").alias(c) if c in has else F.lit(None).cast("int").alias(c) for c in ("mate", "mapq")]
    rows = alignments.select(F.col("read_id").cast("string"), F.col("sample_id").cast("string"), "seqname", F.col("pos").cast("int"), "cigar", "strand", *optional)
    order = F.array_position(F.array(*[F.lit(n) for n, _ in references]), F.col("seqname"))
    ranged = rows.withColumn("_ref", order).repartitionByRange("sample_id", "_ref", "pos").sortWithinPartitions("sample_id", "_ref", "pos").drop("_ref")
    ranged.write.format("bam").option("references", json.dumps(references)).mode(mode).save(path)
