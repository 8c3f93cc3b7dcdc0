"""Tar shards of samples as a Spark data source: read by byte ranges, written by tasks and committed whole.

A sample is a run of members with one key: `key.npy` is an array (shape and flat values), `key.json` a record (text). Files are reached through Arrow's file systems
(a mounted folder, or the URI of a store that Arrow knows), so that a task seeks to what it needs and never holds a shard. `readers.read_tar_shards` takes whole files through Spark for other stores.

Reading: `spark.read.format("tar_shards").schema(...).load(folder)`. A file is cut into ranges of `split_bytes`, and a task takes successive ranges up to `task_bytes`, so that small shards don't make a task each; the ranges of
one file in one task are read as one. A sample belongs to the range in which its first member begins. Where that is, an index of
member offsets says (`name.tar.index`, written with each shard), or else the chain of headers, of which a task reads 512 bytes a member. Only members of the kinds that the schema's columns need are read. Columns: path, key, shape, values,
meta, corrupt. A shard that can't be read to its end gives one row with corrupt set beside the samples before; an empty one gives none.

Writing: `samples.write.format("tar_shards").option("per_shard", n).mode("append" or "overwrite").save(folder)`. Tasks write shards to a folder of the job; the commit moves them to `shard-000000.tar` and on, numbered in
the order of tasks, behind those that are there, and writes `_SUCCESS`. A failed task or job leaves no shard.
"""

from __future__ import annotations

import io
import json
import math
import posixpath
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, key string, shape array<int>, values array<float>, meta string, corrupt boolean"
SPLIT_BYTES, TASK_BYTES, PER_SHARD = 64 << 20, 64 << 20, 5000
BLOCK = tarfile.BLOCKSIZE
KINDS = {"shape": "npy", "values": "npy", "meta": "json"}  # which members a column needs


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_below(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a name, in order; what begins with `_` or a dot is left out, as Spark does."""
    fs, at = store(path)
    info = fs.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p.removeprefix(at).split("/"))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and fnmatch(f.base_name, pattern) and not hidden(f.path))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


@dataclass
class Ranges(InputPartition):
    """What a task reads."""

    ranges: list[Range]


def members(file: pa.NativeFile, size: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, place of the header, place of the data, bytes) along the chain of headers; tarfile.TarError where the chain breaks."""
    at = 0
    while at + BLOCK <= size:
        file.seek(at)
        head = file.read(BLOCK)
        if not any(head):
            return
        begins, name = at, None
        member = tarfile.TarInfo.frombuf(head, "utf-8", "surrogateescape")
        while member.type in (tarfile.GNUTYPE_LONGNAME, tarfile.XHDTYPE, tarfile.XGLTYPE):  # a long name goes before its member
            extra = file.read(member.size + -member.size % BLOCK)[: member.size]
            if member.type == tarfile.GNUTYPE_LONGNAME:
                name = extra.rstrip(b"\0").decode("utf-8", "surrogateescape")
            elif member.type == tarfile.XHDTYPE:
                for line in _pax(extra):
                    name = line[1] if line[0] == "path" else name
            at += BLOCK + member.size + -member.size % BLOCK
            member = tarfile.TarInfo.frombuf(file.read(BLOCK), "utf-8", "surrogateescape")
        data = at + BLOCK
        if data + member.size > size:
            raise tarfile.ReadError("a member goes beyond the end")
        if member.isreg():
            yield name or member.name, begins, data, member.size
        at = data + member.size + -member.size % BLOCK
    if at < size:
        raise tarfile.ReadError("the end is no header")


@lru_cache(maxsize=4096)
def _head(data: bytes) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, order and type that the head of an array file of version 1 gives; those of samples repeat."""
    return np.lib.format.read_array_header_1_0(io.BytesIO(data))


def _array(data: bytes) -> np.ndarray:
    if data[:8] != b"\x93NUMPY\x01\x00":
        return np.load(io.BytesIO(data), allow_pickle=False)
    begins = 10 + int.from_bytes(data[8:10], "little")
    shape, fortran, kind = _head(data[8:begins])
    if kind.hasobject or len(data) - begins < kind.itemsize * math.prod(shape):
        return np.load(io.BytesIO(data), allow_pickle=False)  # which tells what is wrong
    return np.frombuffer(data, kind, math.prod(shape), begins).reshape(shape, order="F" if fortran else "C")


@lru_cache(maxsize=4096)
def _array_head(shape: tuple[int, ...]) -> bytes:
    data = io.BytesIO()
    np.save(data, np.zeros(shape, np.float32))
    return data.getvalue()[: data.tell() - 4 * math.prod(shape)]


_EMPTY_HEAD = tarfile.TarInfo("").tobuf(tarfile.GNU_FORMAT)


def header(name: str, size: int) -> bytes:
    """The header of a member, as tarfile writes it: that of an empty name with name, size and checksum filled in."""
    own = name.encode("utf-8", "surrogateescape")
    if len(own) > tarfile.LENGTH_NAME or size >= 8**11:
        member = tarfile.TarInfo(name)
        member.size = size
        return member.tobuf(tarfile.GNU_FORMAT)
    head = b"".join([own.ljust(100, b"\0"), _EMPTY_HEAD[100:124], b"%011o\0" % size, _EMPTY_HEAD[136:148], b"        ", _EMPTY_HEAD[156:]])
    return b"".join([head[:148], b"%06o\0 " % sum(head), head[156:]])


def _pax(records: bytes) -> Iterator[tuple[str, str]]:
    while records:
        length = int(records.split(b" ", 1)[0])
        key, _, value = records[len(str(length)) + 1 : length - 1].decode("utf-8", "surrogateescape").partition("=")
        yield key, value
        records = records[length:]


class TarReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.kinds = {KINDS[f.name] for f in schema.fields if f.name in KINDS}

    def partitions(self) -> list[Ranges]:
        step, most = int(self.options.get("split_bytes", SPLIT_BYTES)), int(self.options.get("task_bytes", TASK_BYTES))
        tasks, held = [Ranges([])], 0
        for path, size in files_below(self.options["path"], self.options.get("pattern", "*.tar")):
            for at in range(0, size, step):
                end = min(at + step, size)
                if held and held + end - at > most:
                    tasks.append(Ranges([]))
                    held = 0
                own, held = tasks[-1].ranges, held + end - at
                if own and own[-1].path == path:
                    own[-1].end = end
                else:
                    own.append(Range(path, at, end, size))
        return tasks

    def _indexed(self, part: Range, file: pa.NativeFile) -> Iterator[tuple[str, int, int, int]]:
        fs, at = store(self.options["path"])
        index = f"{part.path}.index"
        if fs.get_file_info(index).type != pafs.FileType.File:
            yield from members(file, part.size)
            return
        with fs.open_input_stream(index) as lines:
            for line in lines.read().decode().splitlines():
                yield tuple(json.loads(line))

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for part in partition.ranges:
            yield from self._samples(part)

    def _samples(self, partition: Range) -> Iterator[tuple]:
        fs, _ = store(self.options["path"])
        with fs.open_input_file(partition.path) as file:
            key, sample, mine = None, None, False
            try:
                for name, begins, data, size in self._indexed(partition, file):
                    folder, _, base = name.rpartition("/")
                    own, _, kind = base.partition(".")
                    own = posixpath.join(folder, own)
                    if own != key:
                        if mine:
                            yield self._row(partition.path, key, sample, False)
                        if begins >= partition.end:
                            return
                        key, sample, mine = own, {}, begins >= partition.start
                    if mine and kind.rpartition(".")[2] in self.kinds:
                        self._take(sample, kind.rpartition(".")[2], self._bytes(file, data, size))
                if mine:
                    yield self._row(partition.path, key, sample, False)
            except (tarfile.TarError, ValueError, EOFError, UnicodeDecodeError):
                # one range tells of it: the one in which the broken sample began, or else the file's first
                if mine or (key is None and partition.start == 0):
                    yield self._row(partition.path, None, {}, True)

    @staticmethod
    def _bytes(file: pa.NativeFile, at: int, size: int) -> bytes:
        file.seek(at)
        found = file.read(size)
        if len(found) < size:
            raise EOFError("a member is cut")
        return found

    @staticmethod
    def _take(sample: dict, kind: str, data: bytes) -> None:
        if kind == "npy":
            array = _array(data)
            sample["shape"], sample["values"] = list(array.shape), array.astype(np.float32).ravel().tolist()
        else:
            sample["meta"] = json.dumps(json.loads(data))

    def _row(self, path: str, key: str | None, sample: dict, corrupt: bool) -> tuple:
        row = {"path": path, "key": key, "corrupt": corrupt} | sample
        return tuple(row.get(f.name) for f in self.schema.fields)


@dataclass
class Written(WriterCommitMessage):
    task: int
    shards: list[tuple[str, int]]  # name in the job's folder, samples


class TarWriter(DataSourceArrowWriter):
    """Rows of key, shape, values and meta."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.options, self.overwrite = schema.fieldNames(), options, overwrite
        self.job = f"_job-{uuid.uuid4().hex}"

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return store(self.options["path"].rstrip("/"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, folder = self._folder()
        task, per_shard, shards, out = TaskContext.get().partitionId(), int(self.options.get("per_shard", PER_SHARD)), [], None
        fs.create_dir(f"{folder}/{self.job}")
        try:
            for batch in iterator:
                column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("key", "shape", "values", "meta")}
                ends = np.cumsum(pc.fill_null(pc.list_value_length(column["values"]), 0).to_numpy(zero_copy_only=False))
                flat = np.asarray(column["values"].flatten().to_numpy(zero_copy_only=False), np.float32)
                for key, shape, begin, end, meta in zip(column["key"].to_pylist(), column["shape"].to_pylist(), [0, *ends[:-1]], ends, column["meta"].to_pylist()):
                    if out is None or shards[-1][1] >= per_shard:
                        if out is not None:
                            out.close()
                        name = f"{task:06d}-{len(shards):06d}-{uuid.uuid4().hex}.tar"  # another attempt of the task writes other files
                        shards.append((name, 0))
                        out = _Shard(fs, f"{folder}/{self.job}/{name}")
                    out.add(key, flat[begin:end].reshape(shape), meta)
                    shards[-1] = (shards[-1][0], shards[-1][1] + 1)
        finally:
            if out is not None:
                out.close()
        return Written(task, shards)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = self._folder()
        fs.create_dir(folder)
        old = files_below(folder, "shard-*.tar")
        new = [name for m in sorted((m for m in messages if m), key=lambda m: m.task) for name, _ in m.shards]
        first = 0 if self.overwrite or not old else 1 + max(int(posixpath.basename(p).removeprefix("shard-").removesuffix(".tar")) for p, _ in old)
        if self.overwrite:
            for path, _ in old:
                for gone in (path, f"{path}.index"):
                    if fs.get_file_info(gone).type == pafs.FileType.File:
                        fs.delete_file(gone)
        for i, name in enumerate(new, first):
            for ending in (".index", ""):  # the index first: a shard that is seen has one
                fs.move(f"{folder}/{self.job}/{name}{ending}", f"{folder}/shard-{i:06d}.tar{ending}")
        self._clear(fs, folder)
        with fs.open_output_stream(f"{folder}/_SUCCESS") as done:
            done.write(json.dumps({"shards": first + len(new), "samples": sum(n for m in messages if m for _, n in m.shards)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._folder())

    def _clear(self, fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(f"{folder}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/{self.job}")


class _Shard:
    """A tar that is written as a stream, and its index."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.out, self.index = fs.open_output_stream(path), fs.open_output_stream(f"{path}.index")
        self.at = 0

    def add(self, key: str, array: np.ndarray, meta: str | None) -> None:
        for name, content in ((f"{key}.npy", _array_head(array.shape) + array.tobytes()), (f"{key}.json", (meta or "{}").encode())):
            head = header(name, len(content))
            self.index.write((json.dumps([name, self.at, self.at + len(head), len(content)]) + "\n").encode())
            for part in (head, content, b"\0" * (-len(content) % BLOCK)):
                self.out.write(part)
                self.at += len(part)

    def close(self) -> None:
        if not self.out.closed:
            self.out.write(b"\0" * (2 * BLOCK))
            self.out.close()
            self.index.close()


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TarWriter:
        return TarWriter(schema, dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session, in which `tar_shards` is a format."""
    spark.dataSource.register(TarShards)
    return spark
