"""Token-ID files with bit-plane shuffling.

Documents are encoded in ascending id order, each followed by an end id. The ids are
cut into segments of whole documents, a segment into blocks of ``BLOCK_IDS`` ids; a
block is transposed into its byte planes (or bit planes), and each plane is compressed
with zstandard. High planes are nearly constant and shrink to a few bytes.

A file is a Parquet table, which Spark writes and commits (to any store), so that a lost
executor's part is written again; its row is a segment:

    shard, segment      its place; shards follow the ids' order
    first, n            place of its first id within the shard, number of ids
    doc_ids, lengths    its documents and the number of ids of each
    sizes, planes       per block its number of ids, and its planes, low plane first

``first``, ``n`` of all segments (without the planes) are the chunk index: Parquet reads
them alone, and with the sums of the shards before they give the place of every id. A
segment is decoded on its own.

Shards are ranges of (id, hash of the text), so one exchange moves the texts, and rows of
one id can be split like others; the range bounds are sampled by one more scan. Texts are cut at
single spaces and line feeds between non-blank characters, where the tokenizer's own cut
always lies, and each different piece is encoded once per worker (about ``CACHE_PIECES``
are remembered).

Defined results: a null text is an empty one; a document without tokens has the end id
alone; null ids come first; rows with equal ids are in the order of their texts' hashes; an
empty table gives an empty file. Special tokens' names in a text are ordinary text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import words
from millrace.llm.words import slices
from millrace.session import pin, scratch_path

END_ID = 0
BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20
CACHE_PIECES = 500_000
SHARD_BYTES = 64 << 20  # of text
LEVEL = 3

# Blanks in ASCII (with the separators some engines count), and beyond.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE_BLANKS = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# Marks, and letters: of ASCII, and after 0xC3.
_MARK, _LETTER, _LATIN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
_WIDE_FIRST, _MAYBE_BLANK = np.zeros(256, bool), np.zeros(256, bool)
for _b in _WIDE_BLANKS:
    _WIDE_FIRST[_b[0]] = _MAYBE_BLANK[_b[0]] = _MAYBE_BLANK[_b[-1]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of texts: at each text that isn't empty; at a
    space, and at and after a line feed, if no other blank is beside it; and at a mark
    between a letter and such a blank."""
    n = len(data)
    blank = _BLANK[data]
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    inner = (at > 0) & (at < n - 1)
    at = at[inner]
    at = at[~blank[at - 1] & ~blank[at + 1]]
    # Blanks beyond ASCII have two or three bytes.
    for side in (-1, 1):
        near = np.flatnonzero(_MAYBE_BLANK[data[at + side]])
        odd = [_blank_beside(data, int(at[k]), side) for k in near]
        at = np.delete(at, near[np.array(odd, bool)]) if len(near) else at
    text = np.zeros(n + 1, bool)
    text[offsets] = True
    at = at[~text[at] & ~text[at + 1]]  # not first or last in its text
    starts = text[:n].copy()
    starts[at] = True
    mark = at[_MARK[data[at - 1]] & (at > 2)] - 1
    before = data[mark - 1]
    starts[mark[(_LETTER[before] | (_LATIN[before] & (data[mark - 2] == 0xC3))) & ~text[mark]]] = True
    starts[at[data[at] == 0x0A] + 1] = True
    return np.flatnonzero(starts)


def _blank_beside(data: np.ndarray, at: int, side: int) -> bool:
    around = bytes(data[max(0, at - 3) : at] if side < 0 else data[at + 1 : at + 4])
    return around.endswith(_WIDE_BLANKS) if side < 0 else around.startswith(_WIDE_BLANKS)


class PieceEncoder:
    """A byte-level tokenizer behind a memory of pieces.

    Pieces are found by a 64-bit hash and then compared byte by byte, whole columns at a
    time. When more than ``cache`` are remembered, the half that has not been used for the
    longest time is forgotten."""

    def __init__(self, tokenizer_json: str, cache: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cache, self.clock = cache, 0
        self.keys = np.zeros(0, np.uint64)  # sorted hashes, and the piece of each
        self.piece = np.zeros(0, np.int64)
        self.ids, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.first, self.size, self.raw_first, self.raw_size, self.used = (np.zeros(0, np.int64) for _ in range(5))

    def _forget(self) -> None:
        kept = np.flatnonzero(self.used > np.median(self.used))
        number = np.full(len(self.size), -1, np.int64)
        number[kept] = np.arange(len(kept))
        self.ids, self.raw = self.ids[_spread(self.first[kept], self.size[kept])], self.raw[_spread(self.raw_first[kept], self.raw_size[kept])]
        self.size, self.raw_size, self.used = self.size[kept], self.raw_size[kept], self.used[kept]
        self.first, self.raw_first = np.cumsum(self.size) - self.size, np.cumsum(self.raw_size) - self.raw_size
        new = number[self.piece]
        self.keys, self.piece = self.keys[new >= 0], new[new >= 0]

    def _encoded(self, pieces: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' order, all their ids one piece after another in it, and how many
        each has. ``plain`` ones hold no blank but one space before; they are encoded as
        one text with line feeds between, each of which stands alone for the tokenizer."""
        order, ids, size, single = [], [], [], np.flatnonzero(~plain).tolist()
        joined = np.flatnonzero(plain).tolist()
        for k in range(0, len(joined), 20_000):
            some = joined[k : k + 20_000]
            text = b"\n".join([pieces[i] for i in some]).decode()
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            feeds = got == self.feed[0]
            ends = np.append(np.flatnonzero(feeds), len(got))
            if len(self.feed) > 1 or len(ends) != len(some):
                single += some
                continue
            order.append(np.array(some, np.int64))
            ids.append(got[~feeds])
            size.append(np.diff(ends, prepend=-1) - 1)
        many = self.tokenizer.encode_batch_fast([pieces[i].decode() for i in single], add_special_tokens=False)
        lists = [e.ids for e in many]
        order.append(np.array(single, np.int64))
        ids.append(np.array([i for x in lists for i in x], np.uint32))
        size.append(np.array([len(x) for x in lists], np.int64))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(size)

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        blanks = np.concatenate(([0], np.cumsum(_BLANK[data] | _WIDE_FIRST[data])))
        order, ids, size = self._encoded(pieces, blanks[ends] - blanks[starts] == (data[starts] == 0x20))
        starts, length = starts[order], (ends - starts)[order]
        number = np.empty(len(order), np.int64)
        number[order] = len(self.size) + np.arange(len(order))
        self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
        self.raw_first = np.append(self.raw_first, len(self.raw) + np.cumsum(length) - length)
        self.size, self.raw_size = np.append(self.size, size), np.append(self.raw_size, length)
        self.used = np.append(self.used, np.full(len(pieces), self.clock))
        self.ids = np.append(self.ids, ids)
        self.raw = np.append(self.raw, data[_spread(starts, length)])
        place = np.searchsorted(self.keys, hashes)
        self.keys, self.piece = np.insert(self.keys, place, hashes), np.insert(self.piece, place, number)

    def _found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, text borders, and of every piece its beginning, end and number."""
        data, offsets = words.flat(texts)
        starts = piece_starts(data, offsets) if len(data) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        self.clock += 1
        if len(self.size) > self.cache:
            self._forget()
        hashes, one, back = np.unique(words.hashes(data, starts, ends), return_index=True, return_inverse=True)
        new = one[words.look_up(hashes, self.keys) < 0]
        if len(new):
            order = np.sort(new)
            fresh = words.hashes(data, starts[order], ends[order])
            by = np.argsort(fresh)
            self._learn(data, fresh[by], starts[order][by], ends[order][by])
        number = self.piece[words.look_up(hashes, self.keys)]
        self.used[number] = self.clock
        number = number[back]
        length = ends - starts
        same = length == self.raw_size[number]
        if same.all():
            where = _spread(self.raw_first[number], length)
            same = np.ones(len(starts), bool)
            different = np.flatnonzero(self.raw[where] != data)
            same[np.searchsorted(starts, different, "right") - 1] = False
        if not same.all():  # two pieces of one hash
            raise _Collision
        return data, offsets, starts, ends, number

    def _each(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        try:
            _, offsets, starts, _, number = self._found(texts)
        except _Collision:
            return self._each(texts)
        size = self.size[number]
        totals = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, offsets)]
        return self.ids[_spread(self.first[number], size)], np.diff(totals)

    def pieces(self, texts: list[str | None] | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Characters and number of ids of each piece, by text; a line feed and what
        follows it count as one, for the cut between them depends on what is before."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        try:
            data, offsets, starts, ends, number = self._found(texts)
        except _Collision:  # every text is one piece
            chars = [len(t or "") for t in texts.to_pylist()]
            return [(np.array([c]), np.array([n])) if c else (np.zeros(0, np.int64),) * 2 for c, n in zip(chars, self._each(texts)[1].tolist())]
        if not len(starts):
            return [(starts, starts)] * len(texts)
        text = np.zeros(len(data) + 1, bool)
        text[offsets] = True
        first = np.flatnonzero(text[starts] | (data[starts - 1] != 0x0A))
        letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        chars = np.add.reduceat(letters[ends] - letters[starts], first)
        sizes = np.add.reduceat(self.size[number], first)
        cuts = np.searchsorted(starts[first], offsets)[1:-1]
        return list(zip(np.split(chars, cuts), np.split(sizes, cuts)))


class _Collision(Exception):
    pass


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``first``, one run after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


_ENCODERS: dict[int, PieceEncoder] = {}


def encoder(tokenizer_json: str) -> PieceEncoder:
    """One per worker process, kept over its tasks."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(tokenizer_json)
    return _ENCODERS[key]


def to_planes(ids: np.ndarray, unit: str = "byte") -> list[bytes]:
    """Compressed planes of a block of ids, lowest first."""
    parts = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if unit == "bit":
        parts = np.packbits(np.unpackbits(parts, axis=1, bitorder="little"), axis=0, bitorder="little")
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    return [squeeze(np.ascontiguousarray(p).tobytes()) for p in parts.T]


def from_planes(planes: list[bytes], n: int, unit: str = "byte") -> np.ndarray:
    open_ = zstandard.ZstdDecompressor().decompress
    parts = np.stack([np.frombuffer(open_(p), np.uint8) for p in planes], axis=1) if n else np.zeros((0, 4), np.uint8)
    if unit == "bit" and n:
        parts = np.packbits(np.unpackbits(parts, axis=0, count=n, bitorder="little"), axis=1, bitorder="little")
    return np.ascontiguousarray(parts).view("<u4").ravel()


def _schema(id_type: str) -> str:
    return (
        f"shard int, segment int, first long, n long, doc_ids array<{id_type}>, lengths array<long>, "
        "unit string, sizes array<int>, planes array<array<binary>>"
    )


_ARROW = [
    ("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n", pa.int64()),
    ("doc_ids", None), ("lengths", pa.list_(pa.int64())), ("unit", pa.string()),
    ("sizes", pa.list_(pa.int32())), ("planes", pa.list_(pa.list_(pa.binary()))),
]


def _write_segments(shared, end_id: int, block: int, segment: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        number = first = held = 0
        shard = None
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, first, held, ids, lengths, names
            flat = np.concatenate(ids)
            cut = [flat[i : i + block] for i in range(0, len(flat), block)]
            row = [
                [shard], [number], [first], [len(flat)], [pa.concat_arrays(names).to_pylist()],
                [np.concatenate(lengths).tolist()], [unit], [[len(c) for c in cut]], [[to_planes(c, unit) for c in cut]],
            ]
            kinds = [pa.list_(names[0].type) if t is None else t for _, t in _ARROW]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=[n for n, _ in _ARROW])
            number, first, held = number + 1, first + len(flat), 0
            ids, lengths, names = [], [], []
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                shard = part.column(2)[0].as_py()
                got, size = encode(part.column(1))
                ends = np.cumsum(size)
                with_end = np.insert(got, ends, np.uint32(end_id))
                size += 1
                begin = 0
                while begin < len(size):  # documents until the segment is full
                    total = held + np.cumsum(size[begin:])
                    stop = begin + int(np.searchsorted(total, segment)) + 1
                    stop = min(stop, len(size))
                    a, b = int(size[:begin].sum()), int(size[:stop].sum())
                    ids.append(with_end[a:b])
                    lengths.append(size[begin:stop])
                    names.append(part.column(0).slice(begin, stop - begin))
                    held += b - a
                    begin = stop
                    if held >= segment:
                        yield flush()
        if ids:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end_id: int = END_ID, unit: str = "byte", block: int = BLOCK_IDS, segment: int = SEGMENT_IDS,
) -> None:
    """Write the file ``path`` with the ids of all documents in ascending id order."""
    words.bound_batches(docs.sparkSession)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    ordered = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(F.col("id"), F.xxhash64("text"))
        .sortWithinPartitions(F.col("id"), F.xxhash64("text"), F.col("text"))
        .withColumn("shard", F.spark_partition_id())
    )
    kind = docs.schema[id_col].dataType.simpleString()
    rows = ordered.mapInArrow(_write_segments(shared, end_id, block, segment, unit), _schema(kind))
    rows.write.option("compression", "none").parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index: place of every segment and its first id's place in the whole."""
    parts = spark.read.parquet(path).select("shard", "segment", "first", "n")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = parts.groupBy("shard").agg(F.sum("n").alias("_n"))  # one row per written file
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(shards), "shard").select(
        "shard", "segment", "n", (F.col("first") + F.col("_before")).alias("start")
    )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of a file: doc_id, start, n_tokens, ids_crc32, and the
    ids themselves."""
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    index = pin(token_index(spark, path).select("shard", "segment", "start"), "token-index")
    placed = table.join(index, ["shard", "segment"]).select("start", "doc_ids", "lengths", "unit", "sizes", "planes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, names, lengths, unit, sizes, planes = (c[k] for c in batch.columns)
                blocks = [from_planes(p, n, unit.as_py()) for p, n in zip(planes.as_py(), sizes.as_py())]
                flat = np.concatenate(blocks)
                size = lengths.values.to_numpy()
                ends = np.cumsum(size)
                crc = [zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(ends.tolist(), size.tolist())]
                columns = [names.values, pa.array(start.as_py() + ends - size), pa.array(size), pa.array(crc, pa.int64())]
                labels = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cuts = pa.array(np.concatenate(([0], ends)), pa.int32())
                    columns.append(pa.ListArray.from_arrays(cuts, pa.array(flat.astype(np.int32))))
                    labels.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=labels)

    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return placed.mapInArrow(run, schema)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **options) -> DataFrame:
    """Write a token file and report every document from it."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-file")
    write_tokens(docs, path, id_col, text_col, **options)
    return read_tokens(spark, path, with_ids=False).withColumnRenamed("doc_id", id_col)
