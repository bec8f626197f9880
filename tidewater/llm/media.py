"""Media columns: a Spark data source over directories of archives.

An archive directory holds ZIP files of WAV members and a manifest. `MediaArchive` is the data source: writing
streams Arrow batches into archives, rolled over at a size, and commits by writing a manifest of its own, so files of a
failed or lost task are never read and an append adds to what is there; an overwrite takes the older manifests and
their archives away once its own is written. Reading plans byte ranges of the archives from the manifests alone (nothing
per member reaches the driver), larger ones where there would be more than RANGES of them; a task reads the central
directories of its archives, takes the members whose local header lies in its range, and streams them out as Arrow
batches of bounded bytes. A member that can't be read (an I/O
error, a wrong checksum) is read again by its offset through a new handle, without touching the others; if it still
fails, it is an error, or with on_error=keep a row with null media and the message.

Paths are URIs of any file system that pyarrow opens (file, hdfs, s3, gs), so the shared folder may be remote.

Payloads are 8-bit mono samples: the bytes of a text in UTF-8 with zeros appended to a multiple of 64, at least
64. Cases: a null text is an empty one (64 zeros); null and repeated ids are members like any other (members are
told apart by number); an empty table makes an empty archive directory; other columns are not read; a long text
is one member, streamed in a batch of its own.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import shared_path, text_of

UNIT = 64
RATE = 8000
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
#: Partitions that a read plans at most, but for archives that are smaller than their share: those are put together.
RANGES = 200_000
MANIFEST = "manifest-"
BATCH_BYTES = 8 << 20
ATTEMPTS = 3
SCHEMA = "doc_id bigint, n_bytes bigint, media binary, archive string, offset bigint, error string"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def wav(samples: bytes) -> bytes:
    """8-bit unsigned mono PCM."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def opened(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    archives: list  # (name, bytes, members)


@dataclass
class Range(InputPartition):
    """Bytes of archives: (name, from, to)."""

    parts: list[tuple[str, int, int]]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int, overwrite: bool):
        self.path, self.archive_bytes, self.overwrite = path, archive_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        done, out, archive, members, name = [], None, None, 0, ""

        def close() -> None:
            archive.close()
            size = out.tell()
            out.close()
            done.append((name, size, members))

        for batch in iterator:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                if archive is None:
                    name, members = f"{uuid.uuid4().hex}.zip", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                doc_id, text = ids[i].as_py(), texts[i].as_py()
                info = zipfile.ZipInfo(f"{members:09d}.wav")
                info.compress_type = zipfile.ZIP_DEFLATED
                info.comment = json.dumps([doc_id, len((text or "").encode())]).encode()
                archive.writestr(info, wav(payload_of(text)), compresslevel=1)
                members += 1
                if out.tell() >= self.archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        old = manifests(fs, root) if self.overwrite else {}
        archives = [a for m in messages if m is not None for a in m.archives]
        part, name = f"{root}/{uuid.uuid4().hex}.part", f"{root}/{MANIFEST}{uuid.uuid4().hex}.json"
        with fs.open_output_stream(part, compression=None) as f:
            f.write(json.dumps(archives).encode())
        fs.move(part, name)  # seen whole or not at all
        for at in old:
            fs.delete_file(at)
        for at in [a for of in old.values() for a, *_ in of]:
            fs.delete_file(f"{root}/{at}")

    def abort(self, messages) -> None:
        fs, root = opened(self.path)
        for m in messages:
            for name, *_ in m.archives if m is not None else []:
                fs.delete_file(f"{root}/{name}")


def manifests(fs, root: str) -> dict[str, list]:
    """Of each manifest its archives: (name, bytes, members)."""
    from pyarrow.fs import FileSelector

    out = {}
    for info in sorted(fs.get_file_info(FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
        if info.base_name.startswith(MANIFEST):
            with fs.open_input_stream(info.path, compression=None) as f:
                out[info.path] = json.loads(f.read())
    return out


def ranges_of(archives: list, range_bytes: int, most: int) -> list[Range]:
    """Byte ranges of range_bytes or, where that would be more than `most`, of what makes as many; archives that are
    smaller than that share a range."""
    range_bytes = max(range_bytes, -(-sum(size for _, size, _ in archives) // most))
    out, held, left = [], [], range_bytes
    for name, size, _ in archives:
        low = 0
        while low < size:
            high = min(size, low + left)
            held.append((name, low, high))
            left -= high - low
            low = high
            if not left:
                out.append(Range(held))
                held, left = [], range_bytes
    return [*out, Range(held)] if held or not out else out


def read_member(file, info: zipfile.ZipInfo) -> bytes:
    """One member by its offset, checked."""
    file.seek(info.header_offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise OSError(f"no member at {info.header_offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    file.seek(info.header_offset + 30 + name + extra)
    raw = file.read(info.compress_size)
    data = zlib.decompress(raw, -15) if info.compress_type == zipfile.ZIP_DEFLATED else raw
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise OSError(f"member at {info.header_offset} is damaged")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, attempts: int, keep: bool):
        self.path, self.range_bytes, self.attempts, self.keep = path, range_bytes, attempts, keep

    def partitions(self) -> list[Range]:
        archives = [a for of in manifests(*opened(self.path)).values() for a in of]
        return ranges_of(archives, self.range_bytes, RANGES)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        rows, held = [], 0
        for archive, low, high in partition.parts:
            for row in self.members(fs, root, archive, low, high):
                rows.append(row)
                held += len(row[2] or b"")
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def members(self, fs, root: str, archive: str, low: int, high: int) -> Iterator[tuple]:
        """Rows of the members whose local header lies in the bytes low to high."""
        at = f"{root}/{archive}"
        with fs.open_input_file(at) as file, zipfile.ZipFile(file) as z:
            members = [i for i in z.infolist() if low <= i.header_offset < high]
        file = fs.open_input_file(at)
        for info in members:
            doc_id, n_bytes = json.loads(info.comment)
            data = error = None
            for attempt in range(self.attempts):
                try:
                    data, error = read_member(file, info), None
                    break
                except (OSError, zlib.error, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"
                    if attempt + 1 < self.attempts:
                        file = fs.open_input_file(at)
            if error and not self.keep:
                raise OSError(f"{at}: {error}")
            yield doc_id, n_bytes, data, archive, info.header_offset, error


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary(), "archive": pa.string(), "offset": pa.int64(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class MediaArchive(DataSource):
    """Options: path, rangeBytes, archiveBytes, attempts, on_error (raise or keep)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        o = self.options
        return ArchiveReader(o["path"], int(o.get("rangebytes", o.get("rangeBytes", RANGE_BYTES))), int(o.get("attempts", ATTEMPTS)), o.get("on_error", "raise") == "keep")

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        o = self.options
        return ArchiveWriter(o["path"], int(o.get("archivebytes", o.get("archiveBytes", ARCHIVE_BYTES))), overwrite)


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "append") -> None:
    """Writes the texts as media into an archive directory; mode: append or overwrite."""
    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs[text_col]).alias("text"))
    rows.write.format("media_archive").mode(mode).save(path)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """The media of an archive directory: SCHEMA."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


def feature(samples: bytes) -> str:
    """Exact integer features: sum, energy about the middle, crossings of the middle, least, largest, histogram."""
    x = np.frombuffer(samples, np.uint8)
    y = x.astype(np.int64) - 128
    above = y >= 0
    hist = np.bincount(x >> 4, minlength=16)
    return f"sum={int(x.sum(dtype=np.int64))};energy={int((y * y).sum())};crossings={int((above[1:] != above[:-1]).sum())};min={int(x.min())};max={int(x.max())};hist={','.join(map(str, hist.tolist()))}"


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                m = value.as_buffer().to_pybytes() if hasattr(value, "as_buffer") else value.as_py()
                p = samples_of(m)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op2_media(spark, sf_dir: str) -> DataFrame:
    """All documents stored as media in the shared folder, read back and described."""
    path = shared_path(spark, "media")
    store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return features(load(spark, path))
