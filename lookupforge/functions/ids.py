"""Id arithmetic on Columns. The number of shards ``g`` is a power of two."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _power(g: int) -> int:
    if g < 1 or g & (g - 1):
        raise ValueError(f"{g} isn't a power of two")
    return g


def div(a: Column, b: Column | int) -> Column:
    """Whole-number quotient as a long."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def shard_id(id_: Column, g: int) -> Column:
    return F.pmod(id_, F.lit(_power(g)))


def local_id(id_: Column, g: int) -> Column:
    return div(id_, _power(g))


def shift_offset(id_: Column, shift: int, offset: int, g: int) -> Column:
    """Rotate an id among the shards of its group of ``g`` and move it by ``offset``, a multiple of ``g``."""
    if offset % _power(g):
        raise ValueError("the offset must be a multiple of the number of shards")
    return F.pmod(id_ + F.lit(shift), F.lit(g)) + div(id_, g) * F.lit(g) + F.lit(offset)


def bucket(id_: Column, hash_: Callable[[Column], Column] = F.xxhash64, buckets: int = 64) -> Column:
    return F.pmod(hash_(id_), F.lit(buckets))


def round_up(value: Column, multiple: int) -> Column:
    return div(value + F.lit(multiple - 1), multiple) * F.lit(multiple)


def rotate_right(id_: Column, bits: int, width: int = 32) -> Column:
    """Rotate the low ``width`` bits of a non-negative id."""
    mask = (1 << width) - 1
    low = id_.bitwiseAND(F.lit(mask))
    return F.shiftrightunsigned(low, bits).bitwiseOR(F.shiftleft(low, width - bits).bitwiseAND(F.lit(mask))) if bits else low


def pack_key(bucket_: Column, id_: Column, row: Column, g: int) -> Column:
    """One long that sorts (as unsigned) by bucket, shard, local id, row: 6, 32 and 26 bits."""
    k = _power(g).bit_length() - 1
    turned = rotate_right(id_.cast("long"), k)
    return F.shiftleft(bucket_.cast("long"), 58).bitwiseOR(F.shiftleft(turned, 26)).bitwiseOR(row.cast("long").bitwiseAND(F.lit((1 << 26) - 1)))


def unpack_key(key: Column, g: int) -> tuple[Column, Column, Column]:
    """(bucket, id, row) of a packed key."""
    k = _power(g).bit_length() - 1
    turned = F.shiftrightunsigned(key, 26).bitwiseAND(F.lit((1 << 32) - 1))
    return F.shiftrightunsigned(key, 58), rotate_right(turned, (32 - k) % 32), key.bitwiseAND(F.lit((1 << 26) - 1))


def local_sc(row: Column, batch_per_sc: int | Column) -> Column:
    return div(row, batch_per_sc)


def stacked_row(sample: Column, samples: int, slices: int, batch_per_slice: int, row_offset: int) -> Column:
    """Row of a sample when each of ``slices`` shards holds a slice of every stacked feature, ``batch_per_slice`` rows in all."""
    if samples % slices or row_offset % slices:
        raise ValueError("samples and row offset must divide into the slices")
    per = samples // slices
    return div(sample, per) * F.lit(batch_per_slice) + F.lit(row_offset // slices) + F.pmod(sample, F.lit(per))


def unstacked_sample(row: Column, samples: int, slices: int, batch_per_slice: int, row_offset: int) -> Column:
    """The inverse of ``stacked_row``; null for rows of other features."""
    per, first = samples // slices, row_offset // slices
    at = F.pmod(row, F.lit(batch_per_slice)) - F.lit(first)
    return F.when((at >= 0) & (at < per), div(row, batch_per_slice) * F.lit(per) + at)


def within(row: Column, vocabulary: int) -> Column:
    """``row``, or an error where it lies outside the vocabulary."""
    bad = F.raise_error(F.concat(F.lit(f"row outside a vocabulary of {vocabulary}: "), row.cast("string"))).cast("long")
    return F.when((row >= 0) & (row < vocabulary), row).otherwise(bad)


def physical_row(row: Column, g: int, stack_vocab: int, row_offset_in_shard: int, rotation: int, vocabulary: int | None = None) -> Column:
    """Place of a table's row in its stack's shards laid one after the other; with ``vocabulary``, a query over a row beyond it
    fails."""
    if vocabulary is not None:
        row = within(row, vocabulary)
    return F.pmod(F.pmod(row, F.lit(g)) + F.lit(rotation), F.lit(g)) * F.lit(stack_vocab // g) + div(row, g) + F.lit(row_offset_in_shard)


def logical_row(physical: Column, g: int, stack_vocab: int, row_offset_in_shard: int, rotation: int) -> Column:
    """The inverse of ``physical_row``, for rows of the same table."""
    size = stack_vocab // g
    shard, at = div(physical, size), F.pmod(physical, F.lit(size))
    return (at - F.lit(row_offset_in_shard)) * F.lit(g) + F.pmod(shard - F.lit(rotation), F.lit(g))
