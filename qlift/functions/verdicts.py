"""Judge verdict parsing (F2-F5) as columns.

A verdict is either JSON (effort, binary) or review text with one ``- <criterion>: <label>``
line per criterion.  Malformed input gives nulls, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, json_object, let, strip_ws, variant_string

# Ordinal labels, lowest first; effort labels may carry the " effort" suffix.
ORDINAL = {"very low": 1, "low": 2, "high": 3, "very high": 4}
EFFORT_SUFFIX = " effort"
NA_LABEL = "na"
# Binary verdict labels.
BINARY = {"Highly Likely": True, "Highly Unlikely": False}

EFFORT_FIELDS = ("explanation", "comprehension_score", "modification_score")
BINARY_FIELDS = ("Score", "Explanation")

# One review line: "- <criterion>: <label>"; "- Review <criterion>: ..." lines are prose.
REVIEW_LINE_RE = r"^- (?!Review )([^:]+):(.*)$"


def parse_json_object(c, fields: tuple[str, ...]) -> Column:
    """One strict JSON parse: a struct of the named string fields (null where missing or no string), or null when the
    whole text is not one JSON object."""
    return let(json_object(c), lambda obj: F.when(obj.isNotNull(), F.struct(*[variant_string(obj, f).alias(f) for f in fields])))


def parse_effort(c) -> Column:
    """F2: struct(explanation, comprehension_score, modification_score); null when malformed."""
    return parse_json_object(c, EFFORT_FIELDS)


def binary_verdict(score) -> Column:
    """True for 'Highly Likely', False for 'Highly Unlikely', else null."""
    out = F.lit(None).cast("boolean")
    for label, value in BINARY.items():
        out = F.when(_c(score) == label, F.lit(value)).otherwise(out)
    return out


def parse_binary(c) -> Column:
    return binary_verdict(parse_json_object(c, BINARY_FIELDS)["Score"])


def binary_explanation(c) -> Column:
    return parse_json_object(c, BINARY_FIELDS)["Explanation"]


def review_lines(c) -> Column:
    """F3 helper: array of review lines (Windows line ends accepted)."""
    return F.split(_c(c), "\r?\n", -1)


def review_criterion(line) -> Column:
    return strip_ws(F.regexp_extract(_c(line), REVIEW_LINE_RE, 1))


def review_label(line) -> Column:
    return strip_ws(F.regexp_extract(_c(line), REVIEW_LINE_RE, 2))


def is_review_line(line) -> Column:
    return _c(line).rlike(REVIEW_LINE_RE)


def bare_label(c) -> Column:
    """Lower-cased, stripped label without the effort suffix."""
    return F.regexp_replace(F.lower(strip_ws(_c(c))), EFFORT_SUFFIX + r"\z", "")


def ordinal(c, bare: bool = False) -> Column:
    """label -> 1..4; ``NA`` and unknown labels -> null (see ``label_status``)."""
    x = _c(c) if bare else bare_label(c)
    out = F.lit(None).cast("bigint")
    for label, value in ORDINAL.items():
        out = F.when(x == label, F.lit(value).cast("bigint")).otherwise(out)
    return out


def label_status(c, bare: bool = False) -> Column:
    """'ok', 'na' or 'invalid'."""
    x = _c(c) if bare else bare_label(c)
    return (F.when(x.isin(*ORDINAL.keys()), F.lit("ok"))
            .when(x == NA_LABEL, F.lit("na")).otherwise(F.lit("invalid")))
