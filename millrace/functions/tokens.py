"""Token arrays: ids, overlapping windows, padding, masks, shifts, stops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import let
from millrace.functions.hashing import hash_number

# Fixed value: the pad id used when a tokenizer has none.
FALLBACK_PAD_ID = 100349


def words(cleaned: Column) -> Column:
    """Blank-separated tokens of a cleaned text; none for '' and for null."""
    return F.filter(F.split(F.coalesce(cleaned, F.lit("")), " "), lambda w: w != "")


def hash_token_ids(cleaned: Column, vocab_size: int) -> Column:
    """Ids from a stateless hash vocabulary of ``vocab_size`` entries."""
    return F.transform(
        words(cleaned),
        lambda w: (hash_number(F.md5(w)) % F.lit(vocab_size)).cast("int"),
    )


def check_window(length: int, stride: int) -> None:
    if not 0 <= stride < length:
        raise ValueError(f"need 0 <= stride < length, got stride={stride}, length={length}")


def fragment_count(n_tokens: Column, length: int, stride: int) -> Column:
    """Number of windows over ``n_tokens`` tokens (at least one)."""
    check_window(length, stride)
    step = length - stride
    extra = F.ceil((n_tokens - F.lit(length)) / F.lit(step)).cast("int")
    return F.when(n_tokens <= length, F.lit(1)).otherwise(F.lit(1) + extra)


def token_windows(ids: Column, length: int, stride: int) -> Column:
    """All windows of ``length`` tokens, consecutive ones sharing ``stride``."""
    check_window(length, stride)
    step = length - stride
    return let(
        ids,
        lambda t: F.transform(
            F.sequence(F.lit(0), fragment_count(F.size(t), length, stride) - 1),
            lambda j: F.slice(t, j * F.lit(step) + 1, length),
        ),
    )


def pad_right(window: Column, length: int, pad_id: int) -> Column:
    return F.concat(window, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(window)))


def attention_mask(window: Column, length: int) -> Column:
    n = F.size(window)
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def shift_inputs(ids: Column) -> Column:
    """All tokens but the last."""
    return F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))


def shift_targets(ids: Column) -> Column:
    """All tokens but the first."""
    return F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))


def sample_key(shard_idx: Column, shard_pos: Column) -> Column:
    return F.format_string("%05d_%05d", shard_idx, shard_pos)


def truncate_at_eos(
    tokens: Column, prompt_len: Column, eos_id: int, min_length: int, max_length: int
) -> Column:
    """Generated tokens up to and including the first end token at which prompt
    plus generated length exceeds ``min_length``; at most ``max_length``."""
    stops = F.transform(
        tokens,
        lambda t, i: F.when((t == eos_id) & (prompt_len + i + 1 > min_length), i + 1),
    )
    cut = F.coalesce(F.array_min(stops), F.lit(max_length))
    return F.slice(tokens, F.lit(1), F.least(cut, F.lit(max_length)))
