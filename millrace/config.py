"""Configuration of a corpus preparation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from millrace.functions.tokens import FALLBACK_PAD_ID, check_window


LAYOUT = 2  # of the stored stages


@dataclass(frozen=True)
class SourceSpec:
    """One text source: where it lies, how it is cleaned, what it is called."""

    domain: str
    path: str
    format: str = "parquet"
    cleaner: str = "web"
    order: Sequence[str] = ("ord",)
    text: str = "text"
    label: str = ""
    key_types: Sequence[str] = ()
    """SQL types of ``order`` in JSON records, which carry none; ``bigint`` each if
    not given. Other formats bring their own."""


@dataclass(frozen=True)
class CorpusConfig:
    """Everything that decides the prepared tables."""

    sources: Sequence[SourceSpec]
    base_path: str
    max_examples: int = 300_000
    ratios: Sequence[float] = (0.9,)
    """Share of each source but the last, which takes the rest."""
    min_words_exclusive: int = 10
    val_ratio: float = 0.1
    seed: int = 42
    window: int = 1024
    stride: int = 16
    shard_size: int = 40_000
    tokenizer: str = "hash"
    """Name of what turns texts into ids; anything but ``hash`` is supplied by
    the caller, whose name for it keeps its stages apart from others."""
    vocab_size: int = 50_000
    pad_id: int = FALLBACK_PAD_ID
    batch_size: int = 64
    shuffle_buffer: int = 1000
    attribution: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_window(self.window, self.stride)
        if len(self.ratios) != len(self.sources) - 1:
            raise ValueError("give one ratio per source but the last")
        if not 0 < self.val_ratio < 1:
            raise ValueError("val_ratio must lie between 0 and 1")
        if self.tokenizer == "hash" and 0 <= self.pad_id < self.vocab_size:
            raise ValueError("pad_id must not be an id of the hash vocabulary")

    def quotas(self) -> list[int]:
        return source_quotas(self.max_examples, self.ratios)

    def fingerprint(self, inputs: Sequence[str] = ()) -> str:
        """Short digest of every setting that changes results and of the snapshots of the
        ``inputs``, so that stored stages are reused only by an identical configuration
        over the same files."""
        settings = asdict(self) | {"inputs": list(inputs), "layout": LAYOUT}
        settings.pop("base_path")
        text = json.dumps(settings, sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()[:12]


def source_quotas(max_examples: int, ratios: Sequence[float]) -> list[int]:
    """Truncated share per ratio; the last source takes what is left."""
    leading = [int(max_examples * r) for r in ratios]
    rest = max_examples - sum(leading)
    if rest < 0:
        raise ValueError("ratios add up to more than 1")
    return [*leading, rest]
