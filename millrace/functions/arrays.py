"""Row-local array expressions over token ids and masks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IGNORED = -100  # fixed value: a position without a label


def truncate(ids: Column, limit: int, side: str = "right") -> Column:
    """Keep at most ``limit`` ids: the head for "right", the tail for "left"."""
    if side == "right":
        return F.slice(ids, 1, limit)
    if side == "left":
        size = F.size(ids)
        return F.slice(ids, F.greatest(size - F.lit(limit), F.lit(0)) + 1, F.lit(limit))
    raise ValueError(f"unknown side {side!r}")


def append_once(ids: Column, value: int) -> Column:
    """Append ``value`` unless it is already last; an empty array becomes [value]."""
    last = F.try_element_at(ids, F.lit(-1))
    return F.when(last == F.lit(value), ids).otherwise(F.array_append(ids, F.lit(value)))


def pad(values: Column, target: Column | int, value: Column, side: str = "right") -> Column:
    """Fill up to ``target`` elements; longer arrays are left alone."""
    target = F.lit(target) if isinstance(target, int) else target
    fill = F.array_repeat(value, F.greatest(target - F.size(values), F.lit(0)).cast("int"))
    return F.concat(fill, values) if side == "left" else F.concat(values, fill)


def count_true(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m)).cast("bigint")


def attention(ids: Column, pad_id: int | None) -> Column:
    """1 except where the id equals the pad id. A pad id of 0 is allowed here."""
    if pad_id is None:
        raise ValueError("a pad id is needed for an attention mask")
    return F.transform(ids, lambda x: (x != F.lit(pad_id)).cast("int"))


def shifted_labels(
    ids: Column,
    label_mask: Column | None = None,
    attention_mask: Column | None = None,
    instance_mask: Column | None = None,
) -> Column:
    """Ids with every masked position ignored, first position dropped."""
    ignored = F.lit(IGNORED)
    out = ids
    if label_mask is not None:
        out = F.zip_with(out, label_mask, lambda x, m: F.when(m, x).otherwise(ignored))
    if attention_mask is not None:
        out = F.zip_with(out, attention_mask, lambda x, a: F.when(a != 0, x).otherwise(ignored))
    if instance_mask is not None:
        out = F.when(instance_mask, out).otherwise(F.transform(out, lambda x: ignored))
    return F.slice(out, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def leading_run_end(flags: Column) -> Column:
    """Number of leading trues (all of them when there is no false)."""
    first_false = F.array_position(flags, F.lit(False))
    return F.when(first_false == 0, F.size(flags)).otherwise(first_false - 1).cast("bigint")


def trailing_run_start(flags: Column) -> Column:
    """Start of the trailing run of trues, -1 when the last flag is false."""
    run = leading_run_end(F.reverse(flags))
    return F.when(run > 0, F.size(flags) - run).otherwise(F.lit(-1)).cast("bigint")
