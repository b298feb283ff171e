"""Array expressions whose cost stays near the length of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions.text import let


def running(values: Column, join: Callable[[Column, Column], Column], first: Column) -> Column:
    """Running results of a fold. Blocks of about the root of the length keep the copying small."""

    def fold(items: Column, start: Column) -> Column:
        grown = F.aggregate(items, F.array(start), lambda done, x: F.concat(done, F.array(join(F.element_at(done, -1), x))))
        return F.slice(grown, 2, F.size(items))

    def blocked(all_values: Column, size: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_values) - 1) / size).cast("int")),
            lambda b: F.slice(all_values, b * size + 1, size),
        )
        inside = F.transform(parts, lambda part: fold(part, first))

        def shifted(done: Column) -> Column:
            ends = fold(F.transform(done, lambda d: F.element_at(d, -1)), first)
            return let(
                ends,
                lambda end: F.flatten(
                    F.transform(
                        done,
                        lambda d, n: F.transform(d, lambda x: F.when(n == 0, x).otherwise(join(F.get(end, n - 1), x))),
                    )
                ),
            )

        return let(inside, shifted)

    def whole(all_values: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_values))).cast("int")
        none = F.slice(F.array(first), 1, 0)
        return F.when(F.size(all_values) > 0, let(size, lambda n: blocked(all_values, n))).otherwise(none)

    return let(values, whole)


def groups(arr: Column, key: Callable[[Column], Column]) -> Column:
    """(k, xs) for each key in the order in which keys first occur, with their items in order; by sorting."""
    indexed = F.transform(arr, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))

    def cut(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: i),
            lambda h: (h == 0) | ~F.get(s, h)["k"].eqNullSafe(F.get(s, h - 1)["k"]),
        )

        def parts(heads: Column) -> Column:
            def one(h: Column, j: Column) -> Column:
                end = F.coalesce(F.get(heads, j + 1), F.size(s))
                own = F.transform(F.slice(s, h + 1, end - h), lambda y: y["x"])
                return F.struct(F.get(s, h)["i"].alias("i"), F.get(s, h)["k"].alias("k"), own.alias("xs"))

            return F.transform(heads, one)

        in_order = F.sort_array(let(starts, parts))
        return F.transform(in_order, lambda g: F.struct(g["k"].alias("k"), g["xs"].alias("xs")))

    return let(F.sort_array(indexed), cut)


def first_of_each(arr: Column, key: Callable[[Column], Column]) -> Column:
    """First-wins dedupe by a key.

    Distinct hashes tell distinct keys; distinct structs would be found by comparing all pairs.
    """
    return let(
        arr,
        lambda a: F.when(F.size(F.array_distinct(F.transform(a, lambda x: F.xxhash64(key(x))))) == F.size(a), a).otherwise(
            F.transform(groups(a, key), lambda g: F.get(g["xs"], F.lit(0)))
        ),
    )
