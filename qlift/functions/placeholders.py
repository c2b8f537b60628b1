"""Placeholder columns (E1-E3): ``<body>`` slots inside drafts, ``a/b/c`` option lists.

A body holds no ``<`` or ``>``, so ``<a <b>>`` yields ``b`` (a nested ``<`` restarts) and
``<>`` yields nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, strip_ws

BODY_RE = r"<([^<>]+)>"
# The first option of every (non-empty) slot replaces the slot; "<>" is not a slot.
FILL_FIRST_RE = r"<([^<>/]+)(?:/[^<>]*)?>|<(?:/[^<>]*)>"


def placeholders(c) -> Column:
    """Array of placeholder bodies in text order."""
    return F.regexp_extract_all(_c(c), F.lit(BODY_RE), 1)


def options(body) -> Column:
    """Options of one body, split on ``/`` and stripped; the first is the most probable."""
    return F.transform(F.split(_c(body), "/", -1), lambda o: strip_ws(o))


def fill_first(c) -> Column:
    """Every placeholder replaced by its first option (deterministic simulated user)."""
    return F.regexp_replace(_c(c), FILL_FIRST_RE, "$1")


def has_placeholder(c) -> Column:
    return _c(c).rlike(BODY_RE)
