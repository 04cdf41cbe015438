"""Name an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Writing ``body(value)`` directly copies the expression into every place
    that mentions it; inside a lambda over an array it would then run once per
    element. A one-element array keeps the value as a lambda variable instead.
    """
    return F.transform(F.array(value), body)[0]


def computed_once(value: Column) -> Column:
    """``value`` behind a generator, for a ``select`` followed by a filter on it.

    The optimizer pushes a filter below a projection and thereby runs the
    projected expression twice; it does not push one below a generator.
    """
    return F.explode(F.array(value))
