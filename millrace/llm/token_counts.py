"""Token counts that follow edits.

A text is cut where the tokenizer's own cut always lies (at a space or line feed between
characters that are no blanks, or at a mark after a letter) into leaves of about ``LEAF_CHARS`` characters, which can be encoded
independently. Over the leaves stands a tree of sums, an array in which node k has the
children 2k and 2k+1: characters and tokens of each subtree.

An edit descends the tree to the leaves it touches, takes in neighbours whose border lies
within its boundary context (one character on each side of a cut decides that it is one),
encodes that region alone and updates the sums above. A region that grew beyond
``SPLIT_CHARS`` is cut into leaves again.

Defined results: null and empty texts have no tokens and one empty leaf; edits apply in
their order, each to the text that the ones before left; a position beyond the text is its
end, a negative one its beginning; an edit without position, and a null list, changes
nothing; missing parts of an edit are 0 and empty; an empty table gives an empty table.
Columns of the input named like a result column are replaced. Special tokens' names in a
text are ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import words as W
from millrace.llm.token_files import PieceEncoder, default_tokenizer, encoder

LEAF_CHARS = 512
SPLIT_CHARS = 4 * LEAF_CHARS

LONGS = T.ArrayType(T.LongType())
TREE = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("tree_chars", LONGS),
    T.StructField("tree_tokens", LONGS),
]
RECOUNTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoded_chars", T.LongType()), *TREE])


class SumTree:
    """Characters and tokens of a text by leaf and subtree."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def of_leaves(cls, chars: list[int], tokens: list[int]) -> SumTree:
        width = 1 << max(0, len(chars) - 1).bit_length()
        both = np.zeros((2, 2 * width), np.int64)
        both[0, width : width + len(chars)] = chars
        both[1, width : width + len(tokens)] = tokens
        while width > 1:
            half = width // 2
            both[:, half:width] = both[:, width : 2 * width].reshape(2, half, 2).sum(axis=2)
            width = half
        return cls(both[0], both[1])

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    def total(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place`` (the last filled one for the end of
        the text), and where it begins."""
        place = min(place, int(self.chars[1]) - 1)
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if place - begin >= self.chars[node] and self.chars[node + 1]:
                begin += int(self.chars[node])
                node += 1
        return node - self.width, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        return self.chars[self.width :], self.tokens[self.width :]


def leaf_counts(text: str, encode: PieceEncoder) -> tuple[list[int], list[int]]:
    """Characters and tokens of a text's leaves."""
    return _leaves(*encode.pieces([text])[0])


def _leaves(chars: np.ndarray, sizes: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(chars):
        return [0], [0]
    leaf = (np.cumsum(chars) - 1) // LEAF_CHARS
    first = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
    return np.add.reduceat(chars, first).tolist(), np.add.reduceat(sizes, first).tolist()


@dataclass
class Region:
    """What one edit touches: leaves ``low`` to ``high``, the text they hold afterwards,
    and the whole text afterwards."""

    low: int
    high: int
    text: str
    after: str


def locate(text: str, tree: SumTree, pos: int, removed: int, inserted: str) -> Region:
    a = min(max(pos, 0), len(text))
    b = min(a + max(removed, 0), len(text))
    after = text[:a] + inserted + text[b:]
    if not text:
        return Region(0, tree.width - 1, after, after)
    low, begin = tree.leaf_at(a)
    chars, _ = tree.leaves()
    while low and begin >= a - 1:  # the border may be a cut no longer
        low -= 1
        begin -= int(chars[low])
    high, end = low, begin + int(chars[low])
    while end < len(text) and end <= b:
        high += 1
        end += int(chars[high])
    return Region(low, high, text[begin:a] + inserted + text[b:end], after)


def replace(tree: SumTree, region: Region, chars: list[int], tokens: list[int]) -> SumTree:
    """The tree with the region's leaves counted anew."""
    low, high = region.low, region.high
    if len(region.text) <= SPLIT_CHARS:
        tree.put(low, len(region.text), sum(tokens))
        for k in range(low + 1, high + 1):
            tree.put(k, 0, 0)
        return tree
    old_chars, old_tokens = (x.tolist() for x in tree.leaves())
    rest = [(c, t) for c, t in zip(old_chars[high + 1 :], old_tokens[high + 1 :]) if c]
    return SumTree.of_leaves(
        old_chars[:low] + chars + [c for c, _ in rest], old_tokens[:low] + tokens + [t for _, t in rest]
    )


def edit(text: str, tree: SumTree, pos: int, removed: int, inserted: str, encode: PieceEncoder) -> tuple[str, SumTree, int]:
    """The text after one edit, its tree, and how many characters were encoded."""
    region = locate(text, tree, pos, removed, inserted)
    return region.after, replace(tree, region, *leaf_counts(region.text, encode)), len(region.text)


def apply_edits(
    texts: list[str], trees: list[SumTree], edits: list[list], encode: PieceEncoder
) -> tuple[list[str], list[SumTree], list[int]]:
    """All texts after their edits. The first edits of all texts are encoded together,
    then the second ones, and so on."""
    texts, trees, costs = list(texts), list(trees), [0] * len(texts)
    for turn in range(max(map(len, edits), default=0)):
        at = [i for i, e in enumerate(edits) if turn < len(e)]
        regions = [
            locate(texts[i], trees[i], e["pos"], e["removed"] or 0, e["inserted"] or "")
            for i, e in ((i, edits[i][turn]) for i in at)
        ]
        for i, region, counts in zip(at, regions, encode.pieces([r.text for r in regions])):
            trees[i] = replace(trees[i], region, *_leaves(*counts))
            texts[i] = region.after
            costs[i] += len(region.text)
    return texts, trees, costs


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    cuts = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int64()))


def _shared_tokenizer(df: DataFrame, tokenizer: str | None):
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def count_tokens(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with n_tokens and the tree; write it to keep the trees."""
    shared = _shared_tokenizer(docs, tokenizer)

    def make():
        encode = encoder(shared.value)

        def work(texts: pa.Array) -> list:
            trees = [SumTree.of_leaves(*_leaves(*p)) for p in encode.pieces(texts)]
            return [
                pa.array([t.total() for t in trees], pa.int64()),
                _lists([t.chars for t in trees]),
                _lists([t.tokens for t in trees]),
            ]

        return work

    return W.with_text_columns(docs, text_col, TREE, make)


def recount(
    counted: DataFrame, text_col: str = "text", edits_col: str = "edits", tokenizer: str | None = None
) -> DataFrame:
    """``counted`` (of ``count_tokens``) with ``recounted``: the text after its edits, an
    array of (pos, removed, inserted), with its count and tree."""
    shared = _shared_tokenizer(counted, tokenizer)
    df = counted.drop("recounted")
    schema = T.StructType([*df.schema.fields, T.StructField("recounted", RECOUNTED)])
    places = [schema.fieldNames().index(c) for c in (text_col, "tree_chars", "tree_tokens", edits_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for batch in batches:
            for part in W.slices(batch, text_col):
                text, chars, tokens, edits = (part.column(k) for k in places)
                texts, trees, costs = apply_edits(
                    [t or "" for t in text.to_pylist()],
                    [SumTree(c.values.to_numpy().copy(), t.values.to_numpy().copy()) for c, t in zip(chars, tokens)],
                    [[e for e in x or () if e is not None and e["pos"] is not None] for x in edits.to_pylist()],
                    encode,
                )
                new = pa.StructArray.from_arrays(
                    [
                        pa.array(texts, pa.string()),
                        pa.array(costs, pa.int64()),
                        pa.array([t.total() for t in trees], pa.int64()),
                        _lists([t.chars for t in trees]),
                        _lists([t.tokens for t in trees]),
                    ],
                    names=RECOUNTED.names,
                )
                yield pa.RecordBatch.from_arrays([*part.columns, new], names=schema.names)

    return df.mapInArrow(run, schema)
