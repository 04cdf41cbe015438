"""Dense statistics of whole texts, computed on Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from millrace.llm import words as W

BLANK, NEWLINE, LOWER, UPPER, DIGIT, SENTENCE, SHOUT, ASK, BAR, STAR, SYMBOL, CONTROL, FOREIGN = range(13)
KINDS = 13


def _kinds() -> np.ndarray:
    kind = np.full(256, CONTROL, np.int64)
    kind[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = BLANK
    kind[0x0A] = NEWLINE
    kind[97:123] = LOWER
    kind[65:91] = UPPER
    kind[48:58] = DIGIT
    for chars, k in ((".,;:'\"-()", SENTENCE), ("!", SHOUT), ("?", ASK), ("|", BAR), ("*", STAR), ("#%&$@^~<>=+_\\/{}[]`", SYMBOL)):
        kind[list(chars.encode())] = k
    kind[128:] = FOREIGN
    return kind


KIND = _kinds()
NAMES = (
    "words", "word_length", "blank", "newline", "upper", "digit", "sentence", "shout", "ask", "bar", "star",
    "symbol", "control", "foreign", "distinct", "top_share", "echo", "repeated_triples", "short_words", "long_words", "odd_ends",
)


def _repeats(doc: np.ndarray, keys: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct keys, and how often the most frequent one occurs."""
    packed = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    at = np.flatnonzero(new)
    owner = (packed[at] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(owner, minlength=docs)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, owner, np.diff(np.append(at, len(packed))))
    return distinct, most


def text_stats(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text; an empty or null text has zeros only."""
    data, offsets = W.flat(texts)
    docs = len(texts)
    lengths = np.diff(offsets)
    kinds = np.zeros((docs, KINDS))
    owner = np.repeat(np.arange(docs) * KINDS, lengths)
    kinds = np.bincount(owner + KIND[data], minlength=docs * KINDS).reshape(docs, KINDS).astype(float)
    lower = W.LOWER[data]
    starts, ends, bounds = W.places(lower, offsets, W.BLANK_WORD)
    size = ends - starts
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    h = W.hashes(lower, starts, ends)
    n = np.maximum(np.diff(bounds), 1).astype(float)
    chars = np.maximum(lengths, 1).astype(float)

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, minlength=docs)

    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct, most = _repeats(doc, h, docs)
    triple = W.combined(W.combined(h[:-2], h[1:-1]), h[2:]) if len(h) > 2 else np.zeros(0, np.uint64)
    whole = doc[2:] == doc[:-2]
    n_triples = np.bincount(doc[2:][whole], minlength=docs)
    distinct_triples, _ = _repeats(doc[2:][whole], triple[whole], docs)
    ending = KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    odd = np.isin(ending, (SHOUT, BAR, STAR, SYMBOL)).astype(float)
    out = np.column_stack(
        [
            np.log1p(np.diff(bounds)),
            total(size.astype(float)) / n,
            *[kinds[:, k] / chars for k in (BLANK, NEWLINE, UPPER, DIGIT, SENTENCE, SHOUT, ASK, BAR, STAR, SYMBOL, CONTROL, FOREIGN)],
            distinct / n,
            most / n,
            total(same) / n,
            1 - distinct_triples / np.maximum(n_triples, 1),
            total((size <= 3).astype(float)) / n,
            total((size >= 14).astype(float)) / n,
            total(odd) / n,
        ]
    )
    out[:, NAMES.index("repeated_triples")] *= n_triples > 0
    return out
