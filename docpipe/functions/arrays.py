"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    A lambda variable is evaluated a single time per row, whereas a column that the optimizer inlines into a
    lambda would be evaluated again for every array element. ``element_at`` rather than an index, which would
    look up the type of the whole expression again in every row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ordered_concat(order: Column, value: Column, separator: str = "") -> Column:
    """Aggregate: concatenate ``value`` in the order of ``order``."""
    # sort_array compares natively; array_sort would call a lambda for every comparison.
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def running_sums(values: Column, group: int = 32, levels: int = 3) -> Column:
    """Sums of the integers up to each position.

    An array that grows is copied for every element, so groups are summed by themselves and then moved by the sums of
    the groups before, which are found in the same way: the work stays close to the length.
    """
    zero = F.array(F.lit(0))

    def grown(v: Column) -> Column:
        return F.aggregate(v, zero, lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def grouped(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(group))
        return F.transform(starts, lambda s: F.slice(grown(F.slice(v, s, group)), 2, group))

    def moved(groups: Column) -> Column:
        before = F.concat(zero, running_sums(F.transform(groups, lambda g: F.element_at(g, -1)), group, levels - 1))
        return F.flatten(F.zip_with(groups, F.slice(before, 1, F.size(groups)), lambda g, b: F.transform(g, lambda x: x + b)))

    def sums(v: Column) -> Column:
        flat = F.slice(grown(v), 2, F.greatest(F.size(v), F.lit(1)))
        return flat if levels == 1 else F.when(F.size(v) <= group, flat).otherwise(let(grouped(v), moved))

    return let(values, sums)
