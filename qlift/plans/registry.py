"""Registry of named queries: the Spark plan and its DuckDB oracle side by side.

``@query(key, fixtures=[...], sql=...)`` registers ``fn(spark, sf_dir) -> DataFrame``.
The oracle is the fixture ``WITH`` prefix plus ``sql``; ``sql=None`` means the operator is
checked by row count only (and by pytest against a brute-force re-statement).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..fixtures import duckdb_prefix


@dataclass
class Spec:
    key: str
    fn: Callable
    sql: str | None
    fixtures: list[str] = field(default_factory=list)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return duckdb_prefix(self.fixtures) + self.sql.strip()


REGISTRY: dict[str, Spec] = {}

# DuckDB (RE2) class equal to Java's (?U)[\s\x1c-\x1f] used by the Spark side.
DWS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def dnorm(x: str, lower: bool = True, strip: bool = True) -> str:
    """DuckDB text of ``functions.text.normalize``."""
    if lower:
        x = f"lower({x})"
    x = f"regexp_replace({x}, '{DWS}+', ' ', 'g')"
    if strip:
        x = f"regexp_replace({x}, '^ | $', '', 'g')"
    return x


def dtrunc(x: str, n: int) -> str:
    """DuckDB text of ``functions.text.truncate_tail``."""
    w = f"string_split({x}, ' ')"
    return (f"right(array_to_string(list_slice({w}, greatest(len({w}) - {n} + 1, 1), len({w})), ' '), {5 * n})")


def query(key: str, fixtures: list[str] | None = None, sql: str | None = None):
    def deco(fn):
        REGISTRY[key] = Spec(key, fn, sql, list(fixtures or []))
        return fn
    return deco


def load_all() -> dict[str, Spec]:
    from . import (conversations_q, flagship, inference_q, judging_q, placeholders_q,  # noqa: F401
                   runlogs_q, sources_q, streaming_q, tables_q, text_q, tokens_q)
    return dict(sorted(REGISTRY.items()))


def dstrip(x: str) -> str:
    """DuckDB text of Python ``str.strip()``."""
    return f"regexp_replace({x}, '^{DWS}+|{DWS}+$', '', 'g')"


def sqlstr(s: str) -> str:
    """A Python string as a DuckDB literal expression (quotes doubled, newlines via chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)
