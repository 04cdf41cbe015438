"""Corpus preparation and token evaluation on Spark."""

from importlib import import_module

_HOMES = {
    "CorpusConfig": "millrace.config",
    "SourceSpec": "millrace.config",
    "source_quotas": "millrace.config",
    "PreparedCorpus": "millrace.plans.prepare",
    "prepare_corpus": "millrace.plans.prepare",
    "Evaluation": "millrace.plans.evaluate",
    "evaluate": "millrace.plans.evaluate",
}

__all__ = sorted(_HOMES)


def __getattr__(name: str):
    """Load the public names on first use: Python workers import this package
    for one small module and should not pay for the rest."""
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOMES[name]), name)
