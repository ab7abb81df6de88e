"""Small helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    Lambda bodies are evaluated per element, so an expensive expression used
    inside one must be bound outside of it; Catalyst has no let expression.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def substr(col: Column, start: Column | int, length: Column | int) -> Column:
    """``substring`` with integer or column positions (1-based)."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return F.substr(col, start, length)


def byte_slice(binary: Column, start: Column, end: Column) -> Column:
    """Text of the half-open byte range ``[start, end)`` of a UTF-8 binary.

    Slicing bytes costs the length of the slice; slicing a string by code
    point walks it from the beginning each time.
    """
    return F.substr(binary, start + F.lit(1), end - start).cast("string")


def explode_once(df: DataFrame, array: str, *columns, out: str = "s") -> DataFrame:
    """``columns`` and the elements of ``array`` as column ``out``.

    A plain ``explode`` makes the optimizer test the array for emptiness
    below, which evaluates the expression behind it once more for each test.
    """
    rows = df.select(*columns, F.explode_outer(array).alias(out))
    return rows.where(F.col(out).isNotNull())


def where_filled(df: DataFrame, array: str) -> DataFrame:
    """Rows whose ``array`` has elements, the expression behind it evaluated once.

    A plain filter would be pushed below and evaluate it a second time.
    """
    boxed = F.when(F.size(array) > 0, F.array(array))
    rows = df.withColumn("_box", F.explode_outer(boxed)).where(F.col("_box").isNotNull())
    return rows.withColumn(array, F.col("_box")).drop("_box")


# Elements per block when a running value is taken over a long array.
BLOCK = 128


def block_numbers(array: Column) -> Column:
    """Numbers of the blocks of a non-empty array."""
    last = F.call_function("div", F.size(array) - 1, F.lit(BLOCK)).cast("int")
    return F.sequence(F.lit(0), last)


def block_range(array: Column, k: Column) -> Column:
    """0-based positions of block ``k``."""
    return F.sequence(k * BLOCK, F.least(k * BLOCK + BLOCK, F.size(array)) - 1)


def running(array: Column, first: Column, after: Callable[[Column, Column], Column]) -> Column:
    """``array<struct<before:string,after:string>>`` of a running string over a non-empty array.

    ``after`` makes an element's string of the string before it and the element.
    Strings are kept in blocks, so that the cost follows the elements and not their square.
    """

    def block(acc: Column, k: Column) -> Column:
        return F.aggregate(
            F.transform(block_range(array, k), lambda i: F.get(array, i)),
            F.array(acc["last"]),
            lambda done, x: F.concat(done, F.array(after(F.element_at(done, -1), x))),
            lambda done: F.struct(
                F.element_at(done, -1).alias("last"), F.concat(acc["blocks"], F.array(done)).alias("blocks")
            ),
        )

    zero = F.struct(first.alias("last"), F.array().cast("array<array<string>>").alias("blocks"))
    blocks = F.aggregate(block_numbers(array), zero, block, lambda acc: acc["blocks"])
    pair = lambda a, b: F.struct(a.alias("before"), b.alias("after"))
    return F.flatten(
        F.transform(blocks, lambda b: F.zip_with(F.slice(b, 1, F.size(b) - 1), F.slice(b, 2, F.size(b) - 1), pair))
    )
