"""Numbered tar shards as a Spark data source, format ``tar_shards``.

A shard ``<prefix>-<number>.tar`` holds per sample ``<key>.json`` (document id,
domain, fragment number), ``<key>.input.json`` (token ids) and, if there is a
mask, ``<key>.mask.json``. The Python side only packs and unpacks the container,
streaming, so memory does not grow with the shard; JSON is made and parsed by
Spark. Files are reached through Arrow's file systems: local paths and the URIs
Arrow knows (``hdfs``, ``s3``, ...).

Shards are written in place, under names that carry the job and the task attempt:
``<prefix>-<number>.<job>-<attempt>.tar``, with the offset of every sample in
``....index`` beside each. What belongs to a prefix is said by its newest whole manifest,
``_<prefix>-<version>.manifest``, which the commit writes as one new file: nothing is
moved, a torn manifest does not count, and files of attempts that failed, or came too late,
are never seen. Plain ``<prefix>-<number>.tar`` files of other writers are shards as well.
The offsets let several tasks read one shard, each from its first sample on.
"""

from __future__ import annotations

import io
import json
import re
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from millrace.functions.binding import computed_once
from millrace.session import ship_package, shuffles_dropped

FORMAT = "tar_shards"
ABOUT_SCHEMA = "original_id string, domain string, fragment_idx int"
IDS_SCHEMA = "array<int>"
MODES = ("DROPMALFORMED", "PERMISSIVE", "FAILFAST")
ROWS_PER_BATCH = 1000
COMMIT_REQUESTS = 64
SPLIT_BYTES = 64 << 20
READ_TASKS = 128
WRITE_BUFFER = 1 << 20
READ_BUFFER = 1 << 16

# Member name endings and the column each one fills.
MEMBERS = {"json": "about", "input.json": "input", "mask.json": "mask"}
RAW_COLUMNS = ("sample_key", *MEMBERS.values(), "shard", "error")
_RAW_SCHEMA = pa.schema([(c, pa.string()) for c in RAW_COLUMNS])


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path or URI, and the path within it."""
    local = re.fullmatch(r"file:/+(.*)", path)
    return pafs.FileSystem.from_uri("/" + local.group(1) if local else path)


@dataclass(frozen=True)
class Shard:
    """``name`` is the plain name, ``file`` the one it is stored under; ``size`` is None for
    shards of other writers, which have no offsets."""

    name: str
    file: str
    size: int | None = None

    @property
    def number(self) -> int:
        return int(self.name.rpartition("-")[2].partition(".")[0])


def _manifest(fs: pafs.FileSystem, root: str, names: Iterable[str], prefix: str) -> tuple[list[Shard], list[str], int]:
    """Shards of the newest whole manifest, plain names it declares gone, and the highest version."""
    versions = {}
    for name in names:
        if found := re.fullmatch(rf"_{re.escape(prefix)}-(\d+)\.manifest", name):
            versions[int(found.group(1))] = name
    for version in sorted(versions, reverse=True):
        with fs.open_input_stream(f"{root}/{versions[version]}") as f:
            lines = f.read().decode(errors="replace").splitlines()
        try:
            *shards, last = map(json.loads, lines)
        except ValueError:
            continue
        if last.get("shards") == len(shards):
            return [Shard(**s) for s in shards], last["gone"], max(versions)
    return [], [], max(versions, default=0)


def _listed(path: str) -> tuple[pafs.FileSystem, str, list[str]]:
    fs, root = open_fs(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return fs, root, [f.base_name for f in found]


def _sizes(path: str) -> dict[str, int | None]:
    fs, root = open_fs(path)
    return {f.base_name: f.size for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))}


def list_shards(path: str, prefix: str) -> list[Shard]:
    """Shards of a prefix by number; an error if there are none."""
    fs, root, names = _listed(path)
    written, gone, _ = _manifest(fs, root, names, prefix)
    known = {s.name for s in written} | set(gone)
    plain = [Shard(n, n) for n in names if n not in known and re.fullmatch(rf"{re.escape(prefix)}-\d+\.tar", n)]
    if not written and not plain:
        raise FileNotFoundError(f"no shards match {path}/{prefix}-*.tar")
    return sorted([*written, *plain], key=lambda s: s.number)


def list_prefixes(path: str) -> list[str]:
    """Prefixes that have shards, or a manifest, in a folder."""
    # An attempt's name may be digits only, and its file look like another writer's.
    names = [n for n in _listed(path)[2] if not re.fullmatch(r".+-\d+\.[0-9a-f]{12}-[0-9a-f]{12}\.tar", n)]
    found = [re.fullmatch(r"_(.+)-\d+\.manifest|(.+)-\d+\.tar", n) for n in names]
    return sorted({m.group(1) or m.group(2) for m in found if m})


@dataclass
class Piece:
    """The samples of a shard that begin at these bytes; ``end`` None: all of them."""

    shard: Shard
    begin: int = 0
    end: int | None = None


@dataclass
class ShardPartition(InputPartition):
    """What one task reads, piece by piece."""

    pieces: list[Piece]


@dataclass
class ShardsWritten(WriterCommitMessage):
    shards: list[Shard]


# The header of a regular file as ``tarfile`` writes it, but for name, size and checksum.
_HEADER = tarfile.TarInfo("").tobuf(tarfile.USTAR_FORMAT)
_NAME, _SIZE, _SUM = slice(0, 100), slice(124, 136), slice(148, 156)
_HEADER_SUM = sum(_HEADER) - sum(_HEADER[_SIZE]) - sum(_HEADER[_SUM]) + 8 * ord(" ")
_EMPTY = bytes(tarfile.BLOCKSIZE)


def _plain_size(header: bytes) -> int | None:
    """Bytes of content under the plain header of a regular file; None for all else."""
    size, check = header[_SIZE], header[_SUM]
    if (
        len(header) < tarfile.BLOCKSIZE
        or header[156:157] != tarfile.REGTYPE
        or header[257:265] != tarfile.POSIX_MAGIC
        or header[345:500].strip(b"\0")
        or not re.fullmatch(rb"[0-7]{11}\0", size)
        or not re.fullmatch(rb"[0-7]{6}\0 ", check)
        or sum(header) - sum(check) + 8 * ord(" ") != int(check[:6], 8)
    ):
        return None
    return int(size[:11], 8)


def _plain_members(
    stream: io.BufferedIOBase, at: int, stop: int | None
) -> Iterator[tuple[int, str | None, bytes | None]]:
    """``(offset, name, content)`` of regular files under plain headers, which ``tarfile`` takes
    several times as long to parse. Ends where the archive does; at anything else, or anything
    missing, with a name of None: that is left to ``tarfile``."""
    first = at
    while stop is None or at < stop:
        header = stream.read(tarfile.BLOCKSIZE)
        if header == _EMPTY or (not header and at > first):
            return
        n = _plain_size(header)
        if n is None:
            yield at, None, None
            return
        padded = n + -n % tarfile.BLOCKSIZE
        content = stream.read(padded)
        if len(content) < padded:
            yield at, None, None
            return
        name = header[_NAME].partition(b"\0")[0].decode("utf-8", "surrogateescape")
        yield at, name, content[:n]
        at += tarfile.BLOCKSIZE + padded


class TarShardReader(DataSourceReader):
    """One row per sample, members as JSON text; a shard larger than ``split_bytes`` is read
    in pieces. Up to about ``READ_TASKS`` pieces have a task each; more of them share tasks, of
    ``SPLIT_BYTES`` at most, so that tasks grow with the bytes and not with the shards. A shard
    that ends badly yields its good samples and a row with ``error`` from each of its pieces."""

    def __init__(self, path: str, prefix: str, split_bytes: int = SPLIT_BYTES) -> None:
        self.path, self.prefix, self.split_bytes = path, prefix, split_bytes

    def partitions(self) -> list[ShardPartition]:
        pieces: list[tuple[int, Piece]] = []
        shards = list_shards(self.path, self.prefix)
        stored = _sizes(self.path) if any(s.size is None for s in shards) else {}
        for shard in shards:
            parts = -(-(shard.size or 0) // self.split_bytes)
            if parts <= 1:
                pieces.append((shard.size or stored.get(shard.file) or 0, Piece(shard)))
            else:
                cuts = [k * shard.size // parts for k in range(parts + 1)]
                pieces += [(b - a, Piece(shard, a, b)) for a, b in zip(cuts, cuts[1:])]
        share = min(sum(size for size, _ in pieces) // READ_TASKS, SPLIT_BYTES)
        out: list[ShardPartition] = []
        room = 0
        for size, piece in pieces:
            if not out or size > room:
                out.append(ShardPartition([]))
                room = share
            out[-1].pieces.append(piece)
            room -= size
        return out

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for row in self._rows(partition):
            rows.append(row)
            if len(rows) == ROWS_PER_BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=_RAW_SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_RAW_SCHEMA)

    def _range(self, fs: pafs.FileSystem, root: str, part: Piece) -> tuple[int, int | None] | None:
        """Offsets of the first sample to read and of the first one not to."""
        if part.end is None:
            return 0, None
        try:
            with fs.open_input_stream(f"{root}/{part.shard.file}.index") as f:
                offsets = np.frombuffer(f.read(), "<i8")
        except (OSError, ValueError):
            return None if part.begin else (0, None)  # without offsets one task reads all
        first, last = np.searchsorted(offsets, [part.begin, part.end])
        if first == last:
            return None
        return int(offsets[first]), int(offsets[last]) if last < len(offsets) else None

    def _rows(self, partition: ShardPartition) -> Iterator[dict]:
        fs, root = open_fs(self.path)
        for piece in partition.pieces:
            yield from self._samples(fs, root, piece)

    def _samples(self, fs: pafs.FileSystem, root: str, part: Piece) -> Iterator[dict]:
        span, shard = self._range(fs, root, part), part.shard.name
        if span is None:
            return
        start, stop = span
        row: dict = {}
        whole = start  # where the sample in ``row`` begins
        with fs.open_input_file(f"{root}/{part.shard.file}") as stream:
            stream.seek(start)
            for at, name, content in _plain_members(io.BufferedReader(stream, READ_BUFFER), start, stop):
                if name is None:
                    break
                key, _, kind = name.partition(".")
                if row and row["sample_key"] != key:
                    yield row
                    row = {}
                if not row:
                    whole = at
                if kind in MEMBERS:
                    row |= self._filled(shard, key, kind, name, content)
            else:
                if row:
                    yield row
                return
        yield from self._other_samples(fs, root, part, start, stop, whole)

    @staticmethod
    def _filled(shard: str, key: str, kind: str, name: str, content: bytes) -> dict:
        found = {"sample_key": key, "shard": shard}
        try:
            found[MEMBERS[kind]] = content.decode()
        except UnicodeDecodeError as problem:
            found["error"] = f"{type(problem).__name__}: {name}: {problem}"
        return found

    def _other_samples(
        self, fs: pafs.FileSystem, root: str, part: Piece, start: int, stop: int | None, whole: int
    ) -> Iterator[dict]:
        """The samples from offset ``whole`` on, of archives that hold more than plain members, or
        end badly."""
        shard = part.shard.name
        row: dict = {}
        with fs.open_input_file(f"{root}/{part.shard.file}") as stream:
            try:
                stream.seek(start)
                with tarfile.open(fileobj=stream, mode="r|") as tar:
                    # Members of a sample follow each other and share the name
                    # before the first dot.
                    for member in tar:
                        if stop is not None and start + member.offset >= stop:
                            break
                        if start + member.offset < whole:
                            continue
                        key, _, kind = member.name.partition(".")
                        if row and row["sample_key"] != key:
                            yield row
                            row = {}
                        if kind in MEMBERS:
                            content = tar.extractfile(member).read()
                            row |= self._filled(shard, key, kind, member.name, content)
                if row:
                    yield row
            except (tarfile.TarError, EOFError) as problem:
                if row:
                    yield row
                yield {"shard": shard, "error": f"{type(problem).__name__}: {problem}"}


def _member(name: str, content: bytes) -> bytes:
    """A regular file of a tar archive, as ``tarfile`` would add it."""
    encoded = name.encode()
    if not name.isascii() or len(encoded) > 100 or len(content) >= 8**11:
        info = tarfile.TarInfo(name)
        info.size = len(content)
        header = info.tobuf(tarfile.USTAR_FORMAT)
    else:
        size = b"%011o\0" % len(content)
        check = b"%06o\0 " % (_HEADER_SUM + sum(encoded) + sum(size))
        header = b"".join(
            (encoded.ljust(100, b"\0"), _HEADER[_NAME.stop : _SIZE.start], size, _HEADER[_SIZE.stop : _SUM.start], check, _HEADER[_SUM.stop :])
        )
    return b"".join((header, content, bytes(-len(content) % tarfile.BLOCKSIZE)))


class _OpenShard:
    """A shard that is being written, and the offset of each of its samples."""

    def __init__(self, fs: pafs.FileSystem, root: str, shard: Shard) -> None:
        self.fs, self.path, self.shard = fs, f"{root}/{shard.file}", shard
        self.offsets: list[int] = []
        self.stream = fs.open_output_stream(self.path, buffer_size=WRITE_BUFFER)
        self.size = 0

    def _write(self, content: bytes) -> None:
        self.stream.write(content)
        self.size += len(content)

    def add(self, row: dict) -> None:
        self.offsets.append(self.size)
        for ending, column in MEMBERS.items():
            if row[column] is not None:
                self._write(_member(f"{row['sample_key']}.{ending}", row[column].encode()))

    def close(self) -> Shard:
        # Two empty blocks, and whole records, as tarfile ends an archive.
        self._write(bytes(2 * tarfile.BLOCKSIZE))
        self.stream.write(bytes(-self.size % tarfile.RECORDSIZE))
        self.stream.close()
        with self.fs.open_output_stream(f"{self.path}.index") as f:
            f.write(np.array(self.offsets, "<i8").tobytes())
        return Shard(self.shard.name, self.shard.file, self.size)


class TarShardWriter(DataSourceArrowWriter):
    """Each task attempt writes under names of its own; the commit says in a manifest which
    of them count, so retries and lost executors leave nothing that is seen."""

    def __init__(self, path: str, prefix: str, overwrite: bool) -> None:
        self.path, self.prefix, self.overwrite = path, prefix, overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ShardsWritten:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex[:12]
        done: list[Shard] = []
        seen: set[int] = set()
        shard, now = None, None
        for batch in iterator:
            for row in batch.to_pylist():
                if row["shard_idx"] != shard:
                    if now is not None:
                        done.append(now.close())
                    shard = row["shard_idx"]
                    if shard in seen:
                        raise ValueError("rows must be sorted by shard_idx, shard_pos")
                    seen.add(shard)
                    stem = f"{self.prefix}-{shard:05d}"
                    now = _OpenShard(fs, root, Shard(f"{stem}.tar", f"{stem}.{self.job}-{attempt}.tar"))
                if row["shard_pos"] != len(now.offsets):
                    raise ValueError(f"shard {shard}: expected position {len(now.offsets)}")
                now.add(row)
        if now is not None:
            done.append(now.close())
        return ShardsWritten(done)

    def commit(self, messages: list[ShardsWritten | None]) -> None:
        written = sorted((s for m in messages if m for s in m.shards), key=lambda s: s.number)
        if len({s.name for s in written}) != len(written):
            self.abort(messages)
            raise ValueError("a shard was written by several tasks")
        fs, root, names = _listed(self.path)
        before, gone, version = _manifest(fs, root, names, self.prefix)
        new = {s.name for s in written}
        plain = [n for n in names if re.fullmatch(rf"{re.escape(self.prefix)}-\d+\.tar", n)]
        if self.overwrite:
            shards, gone = written, sorted(set(gone) | set(plain))
        else:
            shards = [s for s in before if s.name not in new] + written
        lines = [asdict(s) for s in shards] + [{"shards": len(shards), "gone": gone}]
        # One new file: there for readers when its last line is.
        with fs.open_output_stream(f"{root}/_{self.prefix}-{version + 1:08d}.manifest") as f:
            f.write("\n".join(map(json.dumps, lines)).encode())
        kept = {s.file for s in shards}
        stale = [s.file for s in before if s.file not in kept]
        stale += [n for n in names if f".{self.job}-" in n and n.removesuffix(".index") not in kept]
        there = set(names)
        stale += [f"{f}.index" for f in stale if f"{f}.index" in there]
        stale += [n for n in names if re.fullmatch(rf"_{re.escape(self.prefix)}-\d+\.manifest", n)]
        self._delete(fs, root, [*stale, *(plain if self.overwrite else [])])

    def abort(self, messages: list[ShardsWritten | None]) -> None:
        fs, root, names = _listed(self.path)
        self._delete(fs, root, [n for n in names if f".{self.job}-" in n])

    @staticmethod
    def _delete(fs: pafs.FileSystem, root: str, names: list[str]) -> None:
        # Requests to the store, not data; a store answers many at a time.
        with ThreadPoolExecutor(COMMIT_REQUESTS) as pool:
            list(pool.map(fs.delete_file, [f"{root}/{n}" for n in dict.fromkeys(names)]))


class TarShards(DataSource):
    """Options: ``path``, ``prefix`` and, for reading, ``split_bytes``. Rows are samples as
    JSON text; see ``read_shards`` and ``write_shards`` for typed ones."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in RAW_COLUMNS)

    def reader(self, schema) -> TarShardReader:
        split = int(self.options.get("split_bytes", SPLIT_BYTES))
        return TarShardReader(self.options["path"], self.options["prefix"], split)

    def writer(self, schema, overwrite: bool) -> TarShardWriter:
        return TarShardWriter(self.options["path"], self.options["prefix"], overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TarShards)


def write_shards(sharded: DataFrame, path: str, prefix: str, tasks: int | None = None) -> None:
    """Write fragments with ``shard_idx`` and ``shard_pos`` as tar shards,
    replacing those of the same prefix.

    One exchange by shard number, into ``tasks`` partitions or what the adaptive
    planner makes of the shuffle partitions; every shard has a fixed size, so no
    task is heavier than its number of shards. The arrays become JSON text
    after the exchange.
    """
    register(sharded.sparkSession)
    has_mask = "attention_mask" in sharded.columns
    mask = F.to_json("attention_mask") if has_mask else F.lit(None).cast("string")
    rows = (
        sharded.repartition(*([tasks] if tasks else []), "shard_idx")
        .sortWithinPartitions("shard_idx", "shard_pos")
        .select(
            "shard_idx",
            "shard_pos",
            "sample_key",
            F.to_json(F.struct("original_id", "domain", "fragment_idx")).alias("about"),
            F.to_json("input_ids").alias("input"),
            mask.alias("mask"),
        )
    )
    with shuffles_dropped(sharded.sparkSession):
        rows.write.format(FORMAT).option("prefix", prefix).mode("overwrite").save(path)


def read_shards(
    spark: SparkSession, path: str, prefix: str, mode: str = "PERMISSIVE", split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """``(sample_key, original_id, domain, fragment_idx, text, attention_mask,
    shard)``; a shard above ``split_bytes`` is read in pieces by several tasks, and many small
    shards or pieces by one. What cannot be decoded is kept as a row with ``error`` set (PERMISSIVE,
    so that nothing goes unseen), left out (DROPMALFORMED), or ends the query
    (FAILFAST)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    register(spark)
    raw = spark.read.format(FORMAT).option("prefix", prefix).option("split_bytes", split_bytes).load(path)
    decoded = raw.select(
        "sample_key",
        "shard",
        "error",
        F.col("mask").isNotNull().alias("_has_mask"),
        computed_once(
            F.struct(
                F.from_json("about", ABOUT_SCHEMA).alias("about"),
                F.from_json("input", IDS_SCHEMA).alias("text"),
                F.from_json("mask", IDS_SCHEMA).alias("mask"),
            )
        ).alias("_s"),
    )

    def unusable(ids: str):
        return F.col(ids).isNull() | F.exists(ids, lambda t: t.isNull())

    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_s.about.original_id").isNull(), F.lit("bad metadata"))
        .when(unusable("_s.text"), F.lit("bad token ids"))
        .when(F.col("_has_mask") & unusable("_s.mask"), F.lit("bad mask"))
    )
    columns = [
        F.col("sample_key"),
        F.col("_s.about.original_id").alias("original_id"),
        F.col("_s.about.domain").alias("domain"),
        F.col("_s.about.fragment_idx").alias("fragment_idx"),
        F.col("_s.text").alias("text"),
        F.col("_s.mask").alias("attention_mask"),
        F.col("shard"),
    ]
    if mode == "PERMISSIVE":
        return decoded.select(*columns, problem.alias("error"))
    if mode == "FAILFAST":
        where = F.concat_ws(" ", F.lit("bad sample"), "sample_key", F.lit("of"), "shard")
        stop = F.raise_error(F.concat_ws(": ", where, problem)).cast("boolean")
        return decoded.filter(F.when(problem.isNull(), F.lit(True)).otherwise(stop)).select(*columns)
    return decoded.filter(problem.isNull()).select(*columns)


def bad_samples(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Report of what a tolerant read leaves out."""
    rows = read_shards(spark, path, prefix, "PERMISSIVE")
    return rows.filter(F.col("error").isNotNull()).select("shard", "sample_key", "error")


def verify_shards(
    spark: SparkSession, path: str, prefix: str = "*", every_n: int = 10, max_members: int | None = 5
) -> DataFrame:
    """``(shard, ok, error, members)``: every n-th shard is opened and its first members are
    listed; with ``max_members`` None all members are, and every byte of the shard is read, to
    its end. Problems are reported, nothing is changed."""
    ship_package(spark)
    prefixes = list_prefixes(path) if prefix == "*" else [prefix]
    shards = [s for p in prefixes for s in list_shards(path, p) if s.number % every_n == 0]
    files = spark.createDataFrame([(s.name, s.file) for s in shards], "shard string, file string")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [_check(path, r["shard"], r["file"], max_members) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(results, schema=_CHECK_SCHEMA)

    return files.mapInArrow(check, "shard string, ok boolean, error string, members int")


_CHECK_SCHEMA = pa.schema(
    [("shard", pa.string()), ("ok", pa.bool_()), ("error", pa.string()), ("members", pa.int32())]
)


def _passed(stream: io.BufferedIOBase, n: int) -> bool:
    """Read the next ``n`` bytes, a piece at a time; are they all there?"""
    while n and (piece := stream.read(min(n, WRITE_BUFFER))):
        n -= len(piece)
    return not n


def _at_end(stream: io.BufferedIOBase) -> None:
    """An error unless an empty block follows, and nothing but zeros after it. ``tarfile`` takes a
    bad header past the first, or a missing one, for the end."""
    block = stream.read(tarfile.BLOCKSIZE)
    if len(block) < tarfile.BLOCKSIZE:
        raise tarfile.ReadError("unexpected end of data")
    if block != _EMPTY:
        raise tarfile.ReadError("bad header")
    while piece := stream.read(WRITE_BUFFER):
        if piece.strip(b"\0"):
            raise tarfile.ReadError("data after the end of the archive")


def _listed_members(fs: pafs.FileSystem, file: str) -> Iterator[None]:
    """One item per member of an archive, of which every byte is read; an error where it is not whole."""
    at = 0
    with fs.open_input_stream(file) as raw:
        stream = io.BufferedReader(raw, READ_BUFFER)
        while (n := _plain_size(header := stream.read(tarfile.BLOCKSIZE))) is not None:
            yield
            n += -n % tarfile.BLOCKSIZE
            if not _passed(stream, n):
                raise tarfile.ReadError("unexpected end of data")
            at += tarfile.BLOCKSIZE + n
    if header != _EMPTY:
        # Other headers than plain ones, or bad ones.
        with fs.open_input_stream(file) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
            for member in tar:
                if member.offset >= at:
                    yield
            at = tar.offset
    with fs.open_input_file(file) as raw:
        raw.seek(at)
        _at_end(io.BufferedReader(raw, READ_BUFFER))


def _check(path: str, shard: str, file: str, max_members: int | None) -> dict:
    listed, error = 0, None
    try:
        fs, root = open_fs(path)
        for _ in _listed_members(fs, f"{root}/{file}"):
            listed += 1
            if listed == max_members:
                break
    except (tarfile.TarError, EOFError, OSError, ValueError) as problem:
        error = f"{type(problem).__name__}: {problem}"
    return {"shard": shard, "ok": error is None, "error": error, "members": listed}
