"""Running values along arrays, in time close to the length of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Items of a block, until there are so many that a longer one takes less time.
BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def cut(items: Column, size: Column) -> Column:
    """An array as an array of blocks of ``size`` items; an empty one is an empty block."""
    last = F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * size + 1, size))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The accumulator before each item of an array, and at last that after all.

    ``zero`` must have the type that ``step`` returns. Appending to an array copies it,
    so no array that is appended to may get long. The items are cut into groups, and
    those into blocks. First the accumulators before all groups are gathered, then those
    before the blocks of each group, then those inside each block. So an item is stepped
    over three times, twice if there is one group only, and copied some ``BLOCK`` / 2
    times; up to ``BLOCK`` ** 5 items, 33 million, the time grows as their number does.
    """

    def before_parts(begin: Column, parts: Column) -> Column:
        """The accumulator before each of some arrays of items, and that after all."""
        return F.aggregate(
            parts,
            F.array(begin),
            lambda out, part: F.array_append(out, F.aggregate(part, F.element_at(out, -1), step)),
        )

    def inside(begin: Column, block: Column) -> Column:
        nothing = F.slice(F.array(zero), F.lit(1), F.lit(0))
        return F.aggregate(
            block,
            F.struct(begin.alias("acc"), nothing.alias("out")),
            lambda state, x: F.struct(
                step(state["acc"], x).alias("acc"),
                F.array_append(state["out"], state["acc"]).alias("out"),
            ),
            lambda state: state["out"],
        )

    def in_group(begin: Column, blocks: Column) -> Column:
        return let(
            before_parts(begin, blocks),
            lambda before: F.struct(
                F.flatten(
                    F.zip_with(F.slice(before, F.lit(1), F.size(blocks)), blocks, inside)
                ).alias("inside"),
                F.element_at(before, -1).alias("after"),
            ),
        )

    def joined(groups: Column) -> Column:
        return F.concat(
            F.flatten(F.transform(groups, lambda group: group["inside"])),
            F.array(F.element_at(groups, -1)["after"]),
        )

    def in_groups(s: Column, size: Column) -> Column:
        def each(groups: Column) -> Column:
            # What comes out of the last group is found inside it.
            earlier = F.slice(groups, F.lit(1), F.size(groups) - 1)
            return F.zip_with(
                before_parts(zero, earlier),
                groups,
                lambda begin, group: let(cut(group, size), lambda blocks: in_group(begin, blocks)),
            )

        return let(let(cut(s, size * size), each), joined)

    def sized(s: Column) -> Column:
        root = F.ceil(F.pow(F.size(s), F.lit(0.2))).cast("int")
        return let(F.greatest(F.lit(BLOCK), root), lambda size: in_groups(s, size))

    return let(items, sized)
