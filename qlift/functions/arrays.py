"""Token-id array columns (C4, C7, C8, C10, C11): slicing, padding, masks.

``array_repeat`` with a negative count gives ``[]``, so padding never fails on rows that
are already longer than the target; ``slice`` lengths are clamped at 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# Fixed value: label id ignored by the loss.
IGNORE_INDEX = -100


def _n(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def truncate_ids(ids, max_len, side: str = "head") -> Column:
    """C4: keep the first (``head``) or last (``tail``) ``max_len`` ids."""
    a, m = _c(ids), _n(max_len)
    if side == "head":
        return F.slice(a, F.lit(1), m)
    start = F.greatest(F.size(a) - m + 1, F.lit(1))
    return F.slice(a, start, m)


def is_trimmed(ids, max_len) -> Column:
    return F.size(_c(ids)) > _n(max_len)


def pad_ids(ids, target_len, pad_id, side: str = "right") -> Column:
    """Pad to ``target_len`` with ``pad_id`` on the right or left."""
    a = _c(ids)
    fill = F.array_repeat(_n(pad_id).cast("int"), (_n(target_len) - F.size(a)).cast("int"))
    return F.concat(a, fill) if side == "right" else F.concat(fill, a)


def attention_mask(ids, target_len, side: str = "right") -> Column:
    """1 for real ids, 0 for padding, on the same side as ``pad_ids``."""
    a = _c(ids)
    ones = F.array_repeat(F.lit(1), F.size(a))
    zeros = F.array_repeat(F.lit(0), (_n(target_len) - F.size(a)).cast("int"))
    return F.concat(ones, zeros) if side == "right" else F.concat(zeros, ones)


def pad_fixed(ids, length: int, pad_id: int) -> Column:
    """Cut or pad to exactly ``length`` ids."""
    return pad_ids(F.slice(_c(ids), 1, length), length, pad_id, "right")


def strip_prompt_ids(ids, input_len) -> Column:
    """Drop the first ``input_len`` ids of a generated sequence."""
    a, n = _c(ids), _n(input_len)
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def generated_tokens(ids, eos_id) -> Column:
    """C11: ids that differ from ``eos_id``."""
    return F.size(F.filter(_c(ids), lambda x: x != _n(eos_id)))


def ids_to_text(ids, sep: str = ",") -> Column:
    """Report form of an id array (used where results are compared as text)."""
    return F.array_join(_c(ids).cast("array<string>"), sep)
