"""Finding a value's range among sorted cut points, by two short searches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blocks(cuts: Column) -> Column:
    """Sorted cut points as consecutive blocks, each about as long as there are blocks."""
    n = F.size(cuts)
    width = F.ceil(F.sqrt(n.cast("double"))).cast("int")
    starts = F.sequence(F.lit(1), n, width)
    return F.when(n > 0, F.transform(starts, lambda i: F.slice(cuts, i, width))).otherwise(F.slice(F.array(cuts), 1, 0))


def place(value: Column, cut_blocks: Column, upto: bool = False) -> Column:
    """How many cut points lie below the value (with `upto`, not above it): the block first, then within the block."""
    ahead = (lambda c: c <= value) if upto else (lambda c: c < value)
    begun = F.size(F.filter(cut_blocks, lambda b: ahead(F.get(b, F.lit(0)))))
    last = F.get(cut_blocks, begun - 1)
    return F.when(begun > 0, (begun - 1) * F.size(F.get(cut_blocks, F.lit(0))) + F.size(F.filter(last, ahead))).otherwise(0)
