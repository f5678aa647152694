"""Layouts compiled to Columns: whatever has its place known beforehand is read JVM-side.

``compiled`` turns a type node into (value, conditions on the values, bytes). Numbers of up
to 8 bytes, booleans, keys, bytes of a fixed size, padded options, lists of a fixed length,
scalar enums and structs of all these can be compiled; an option may end a layout. Keys
stay binary here: base58 is for display. Others raise ``NotFixed`` and are read in Arrow
batches (``Program.instruction_outcome``).

Values refer to the data many times, so it should be a column by itself, not an expression.
A filter on a value would be pushed below that column and repeat what made it: ``held`` keeps
the rows that have a value and is not pushed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.decode import ir
from slotweave.functions.encoding import integer, unsigned


class NotFixed(ValueError):
    """A layout whose places depend on its values."""


def _number(node: ir.Num, data: Column, at: int) -> Column:
    """The number at a place that is known to be there: u64 as DECIMAL(20, 0), all others as BIGINT."""
    size, n = node.width, integer(F.substring(data, at + 1, node.width), node.big)
    if node.format == "u64":
        return unsigned(n)
    return F.when(n >= 1 << (8 * size - 1), n - (1 << (8 * size))).otherwise(n) if node.format[0] == "i" and size < 8 else n


def compiled(node: ir.Node, data: Column, at: int, types: dict[str, ir.Node], last: bool = False) -> tuple[Column, list[Column], int]:
    """(value, conditions, bytes at least) of the node at a fixed place; ``last``: nothing follows it.

    The conditions presuppose that the data has all bytes that are sure to be needed.
    """
    if isinstance(node, ir.Link):
        return compiled(types[node.name], data, at, types, last)
    if isinstance(node, ir.Num):
        if node.format not in ("u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64"):
            raise NotFixed(node.format)
        return _number(node, data, at), [], node.width
    if isinstance(node, ir.Bool):
        n, ok, size = compiled(node.num, data, at, types)
        return n == 1, [*ok, n <= 1], size
    if isinstance(node, ir.Key):
        return F.substring(data, at + 1, 32), [], 32
    if isinstance(node, ir.Sized):
        if isinstance(node.item, ir.Bytes):
            return F.lower(F.hex(F.substring(data, at + 1, node.bytes_))), [], node.bytes_
        value, ok, _ = compiled(node.item, data, at, types)
        return value, ok, node.bytes_
    if isinstance(node, ir.Pad):
        value, ok, n = compiled(node.item, data, at + node.before, types)
        return value, ok, node.before + n + node.after
    if isinstance(node, ir.Hidden) and not node.behind:
        n = len(node.constant)
        value, ok, size = compiled(node.item, data, at + n, types, last)
        return value, [*ok, F.substring(data, at + 1, n) == F.lit(node.constant)], n + size
    if isinstance(node, ir.ZeroOption) and node.item.size(types) is not None:
        value, ok, n = compiled(node.item, data, at, types)
        absent = F.substring(data, at + 1, n) == F.lit(bytes(n))
        return F.when(~absent, value), [absent | c for c in ok], n
    if isinstance(node, ir.Option) and node.prefix is not None and (node.fixed or last):
        flag, _, width = compiled(node.prefix, data, at, types)
        value, ok, n = compiled(node.item, data, at + width, types)
        there = [] if node.fixed else [(flag == 0) | (F.octet_length(data) >= at + width + n)]
        return F.when(flag == 1, value), [flag <= 1, *there, *[(flag == 0) | c for c in ok]], width + (n if node.fixed else 0)
    if isinstance(node, ir.Items) and isinstance(node.count, int):
        values, oks, size = [], [], 0
        for _ in range(node.count):
            value, ok, n = compiled(node.item, data, at + size, types)
            values.append(value)
            oks += ok
            size += n
        return F.array(*values), oks, size
    if isinstance(node, ir.Struct):
        values, oks, size = [], [], 0
        for i, (name, item) in enumerate(node.fields):
            value, ok, n = compiled(item, data, at + size, types, last and i == len(node.fields) - 1)
            values.append(value.alias(name))
            oks += ok
            size += n
        return (F.struct(*values) if values else F.lit(None).cast("struct<>")), oks, size
    if isinstance(node, ir.Enum) and node.scalar:
        tag, _, size = compiled(node.tag, data, at, types)
        names = F.array(*[F.lit(n) for n, _ in node.variants])
        return F.get(names, tag.cast("int")), [tag < len(node.variants)], size
    raise NotFixed(type(node).__name__)


def fields(layout: ir.Struct, data: Column, skip: int, types: dict[str, ir.Node]) -> tuple[Column, Column]:
    """(the layout's struct, whether the data holds it)."""
    value, ok, size = compiled(layout, data, skip, types, last=True)
    return value, reduce(lambda a, b: a & b, ok, F.octet_length(data) >= skip + size)


def held(df: DataFrame, name: str, wanted: Callable[[Column], Column] = Column.isNotNull) -> DataFrame:
    """Rows whose struct column ``name`` is wanted, there as it is: what made it is evaluated once a row."""
    kept = F.explode(F.filter(F.array(name), wanted)).alias(name)
    return df.select(*[kept if c == name else c for c in df.columns])
