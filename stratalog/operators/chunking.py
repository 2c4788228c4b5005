"""Content-defined chunking of file bytes, and dedup analytics over chunks.

A rolling hash of the last 48 bytes (base 31, 32 bits) cuts where its low bits are zero, not before the least
and not after the greatest chunk size. The hash of every position is computed at once with numpy: weighted by
powers of the inverse of 31, sums of windows are differences of one running sum, modulo 2^32; small files of a batch
are hashed together. A file is one row (2 GB at most).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension

KB, MB = 1 << 10, 1 << 20
BASE, WINDOW = 31, 48
#: Least and greatest chunk, hash bits, and the extensions they are for.
PROFILES = [
    (32 * KB, 256 * KB, 17, ".docx .xlsx .pptx .doc .xls .ppt .odt .ods"),
    (64 * KB, 512 * KB, 18, ".pdf"),
    (16 * KB, 128 * KB, 16, ".txt .md .cs .js .ts .py .java .cpp .h .json .xml .yaml .yml .html .css"),
    (1 * MB, 64 * MB, 22, ".mp4 .mkv .avi .mov .wmv .webm .flv .m4v"),
    (512 * KB, 8 * MB, 21, ".mp3 .flac .wav .aac .ogg .wma .m4a .raw .cr2 .nef .arw"),
    (256 * KB, 4 * MB, 20, ".jpg .jpeg .png .gif .bmp .tiff .tif .webp .heic .heif .zip .7z .rar .tar .gz .xz"),
    (2 * MB, 64 * MB, 23, ".iso .img"),
    (1 * MB, 16 * MB, 22, ".vhd .vhdx .vmdk"),
    (128 * KB, 1 * MB, 18, ".db .sqlite"),
    (256 * KB, 2 * MB, 18, ".mdf .ldf"),
]
DEFAULT = (64 * KB, 1 * MB, 18)
LARGE_FROM, LARGE = 500 * MB, (16 * MB, 128 * MB, 26)


def profile(path: Column, size: Column) -> Column:
    """Struct (least, most, bits): above 500 MB by size, else by extension."""
    s = lambda p: F.struct(F.lit(p[0]).alias("least"), F.lit(p[1]).alias("most"), F.lit(p[2]).alias("bits"))
    out = s(DEFAULT)
    ext = extension(path)
    for *p, exts in PROFILES:
        out = F.when(ext.isin(exts.split()), s(p)).otherwise(out)
    return F.when(size > LARGE_FROM, s(LARGE)).otherwise(out)


BLOCK = 1 << 18  # bytes that are hashed at once; the arrays stay in a core's cache
#: Powers of the inverse of 31, modulo 2^32.
_DOWN = np.multiply.accumulate(np.concatenate(([1], np.full(BLOCK + WINDOW, pow(BASE, -1, 1 << 32)))).astype(np.uint32), dtype=np.uint32)


def _zeros(raw: np.ndarray, mask: np.uint32) -> np.ndarray:
    """Places whose hash has zeros in ``mask``, from the first one with a whole window on."""
    places: list[np.ndarray] = [np.empty(0, np.int64)]
    for a in range(0, len(raw), BLOCK):
        lo = max(0, a - WINDOW + 1)
        piece = raw[lo : a + BLOCK]
        sums = np.zeros(len(piece) + 1, np.uint32)
        np.cumsum(piece * _DOWN[: len(piece)], dtype=np.uint32, out=sums[1:])
        # the hash is this times an odd power: its low bits are zero exactly if these are
        places.append(np.flatnonzero((sums[WINDOW:] - sums[:-WINDOW]) & mask == 0) + (lo + WINDOW - 1))
    return np.concatenate(places)


def _ends(zeros: list[int], start: int, stop: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of the file from ``start`` to ``stop``; a cut is a window behind its chunk's begin at least, so zeros of files before don't count."""
    if stop - start <= least:
        return [stop]
    if least < WINDOW:
        raise ValueError("chunks are not shorter than the window")
    ends, k = [], 0
    while start < stop:
        k = bisect_left(zeros, start + least - 1, k)
        start = min(zeros[k] + 1 if k < len(zeros) else stop, start + most, stop)
        ends.append(start)
    return ends


def cut_points(data: bytes, least: int, most: int, bits: int) -> list[int]:
    """Ends of the chunks of ``data``; ``least`` is not below the window."""
    zeros = _zeros(np.frombuffer(data, np.uint8), np.uint32((1 << bits) - 1)).tolist() if len(data) > least else []
    return _ends(zeros, 0, len(data), least, most)


def chunk_bytes(data: bytes, least: int, most: int, bits: int) -> list[tuple[int, int, int, str]]:
    out, start = [], 0
    for i, end in enumerate(cut_points(data, least, most, bits)):
        out.append((i, start, end - start, hashlib.sha256(data[start:end]).hexdigest().upper()))
        start = end
    return out


TOGETHER = 1 << 20  # bytes of small files that are hashed in one go


def _groups(offsets: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of files of one number of bits and about ``TOGETHER`` bytes at most, or one file."""
    first = 0
    for k in range(1, len(bits) + 1):
        if k == len(bits) or bits[k] != bits[first] or offsets[k + 1] - offsets[first] > TOGETHER:
            yield first, k
            first = k


def chunk_files(files: DataFrame, least: int | None = None, most: int | None = None, bits: int | None = None, file_hash: bool = True) -> DataFrame:
    """``files``: (path, content). Rows path, chunk_index, offset, length, hash and, on demand, file_hash; an empty file has one chunk of length 0. The profile is that of the path unless given."""
    sized = files.select("path", F.coalesce("content", F.lit(b"")).cast("binary").alias("content"))
    p = profile(F.col("path"), F.octet_length("content"))
    sized = sized.select("path", "content", F.coalesce(F.lit(least), p["least"]).alias("least"), F.coalesce(F.lit(most), p["most"]).alias("most"), F.coalesce(F.lit(bits), p["bits"]).alias("bits"))
    fields = [("path", pa.string()), ("chunk_index", pa.int32()), ("offset", pa.int64()), ("length", pa.int32()), ("hash", pa.string())] + [("file_hash", pa.string())] * file_hash
    schema = pa.schema(fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha256 = hashlib.sha256
        for batch in it:
            if not batch.num_rows:
                continue
            content = batch.column("content").cast(pa.large_binary())
            _, at, values = content.buffers()
            offsets = np.frombuffer(at, np.int64)[content.offset : content.offset + len(content) + 1]
            data = memoryview(values) if values is not None else memoryview(b"")
            raw = np.frombuffer(data, np.uint8)
            own_least, own_most, own_bits = (batch.column(c).to_numpy() for c in ("least", "most", "bits"))
            index, starts, lengths, hashes, rows, wholes = [], [], [], [], [], []
            for a, b in _groups(offsets, own_bits):
                base, stop = int(offsets[a]), int(offsets[b])
                zeros = _zeros(raw[base:stop], np.uint32((1 << int(own_bits[a])) - 1)).tolist()
                for k in range(a, b):
                    begin, end = int(offsets[k]) - base, int(offsets[k + 1]) - base
                    ends = _ends(zeros, begin, end, int(own_least[k]), int(own_most[k]))
                    if file_hash:
                        wholes.append(sha256(data[base + begin : base + end]).hexdigest().upper())
                    start = begin
                    for i, e in enumerate(ends):
                        index.append(i)
                        starts.append(start - begin)
                        lengths.append(e - start)
                        hashes.append(sha256(data[base + start : base + e]).hexdigest().upper())
                        rows.append(k)
                        start = e
            of = pa.array(rows, pa.int64())
            columns = [batch.column("path").cast(pa.string()).take(of), pa.array(index, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(wholes, pa.string()).take(of)] if file_hash else []), schema=schema)

    return sized.mapInArrow(run, "path string, chunk_index int, offset long, length int, hash string" + ", file_hash string" * file_hash)


def new_chunks(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks to store: hashes that nobody stored yet, once each."""
    return chunks.join(known.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def dedup_savings(chunks: DataFrame) -> DataFrame:
    per = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    return per.agg(F.sum("n").cast("long").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum(F.col("n") * F.col("length")).cast("long").alias("bytes"), F.sum((F.col("n") - 1) * F.col("length")).cast("long").alias("saved"))


def version_reuse(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of each file's new version, how many chunk rows are new and how many reuse the old one's hashes."""
    before = old.select("file_id", "hash").distinct().withColumn("known", F.lit(True))
    j = new.join(before, ["file_id", "hash"], "left")
    return j.groupBy("file_id").agg(F.count_if(F.col("known").isNull()).alias("new_chunks"), F.count_if(F.col("known")).alias("reused_chunks"))


def poor_dedup(reuse: DataFrame, above: float = 0.5) -> DataFrame:
    ratio = F.col("new_chunks") / (F.col("new_chunks") + F.col("reused_chunks"))
    return reuse.withColumn("ratio", ratio).where(F.col("ratio") > above)


def first_uploaders(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """First path of each chunk, by path."""
    return files.select("file_id", "local_path").join(chunks, "file_id").groupBy("hash").agg(F.min("local_path").alias("first_path"))
