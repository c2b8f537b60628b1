"""Text columns (B1-B10, B14): pure ``Column -> Column`` builders, all JVM-side.

Whitespace follows Python's ``str.split()``/``\\s`` (Java ``(?U)\\s`` misses U+001C..U+001F,
so they are added).  ``split`` takes a regex, so literal separators are quoted.
``$`` in Java also matches before a final newline, so end anchors use ``\\z``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python-compatible whitespace class for Java regexes.
WS = r"[\s\x1c-\x1f]"
_U = "(?U)"

# Text formats a trained model depends on.
START_MARK = "<|startoftext|>"
SEP_MARK = " ###> "
END_MARK = "<|endoftext|>"
QUERY_MARK = "##query##:"
CONTEXT_LABELS = ("### Related Searches: ", ", ### Previous Query: ", ", ### Prefix: ", " ### Completion: ")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_ws(c) -> Column:
    """Every whitespace run becomes one space (leading/trailing runs included)."""
    return F.regexp_replace(_c(c), _U + WS + "+", " ")


def strip_ws(c) -> Column:
    """Python ``str.strip()``: all Unicode whitespace at both ends."""
    return F.regexp_replace(_c(c), _U + "^" + WS + "+|" + WS + "+\\z", "")


def rstrip_ws(c) -> Column:
    return F.regexp_replace(_c(c), _U + WS + "+\\z", "")


def normalize(c, lower: bool = True, strip: bool = True) -> Column:
    """B1: collapse whitespace runs to one space, optionally lower-case and strip."""
    x = _c(c)
    if lower:
        x = F.lower(x)
    x = collapse_ws(x)
    if strip:
        x = F.regexp_replace(x, "^ | \\z", "")
    return x


def truncate_tail(c, n: int) -> Column:
    """B2: keep the last ``n`` space-separated words, then the last ``5 * n`` characters."""
    words = F.split(_c(c), " ", -1)
    start = F.greatest(F.size(words) - F.lit(n) + 1, F.lit(1))
    tail = F.array_join(F.slice(words, start, F.lit(n)), " ")
    return F.right(tail, F.lit(5 * n))


def is_blank(c) -> Column:
    """True when null or empty after Python-style strip."""
    x = _c(c)
    return x.isNull() | x.rlike(_U + "^" + WS + "*\\z")


# Per-model cleaning chains (profile -> (lower, strip, collapse, words) steps).
PROFILES = {
    "gpt2": {"query": [("lower", 400)]},
    "phi_mini_infer": {"query": [("lower", 400), ("norm_lower", 200)]},
    "phi_mini_train": {"query": [("norm_lower", 200)], "enhanced": [("norm_lower", 400)]},
    "llama": {"query": [("norm_keep", 40)], "enhanced": [("norm_keep", 80)]},
    "phi_medium": {"query": [("norm_keep", 40)]},
    "t5": {"query": [("collapse", None)]},
}


def clean(c, profile: str, side: str = "query") -> Column:
    """Apply a model profile's cleaning chain to a query (or enhanced) column."""
    steps = PROFILES[profile].get(side) or PROFILES[profile]["query"]
    x = _c(c)
    for kind, words in steps:
        if kind == "lower":
            x = F.lower(x)
        elif kind == "norm_lower":
            x = normalize(x, lower=True, strip=True)
        elif kind == "norm_keep":
            x = normalize(x, lower=False, strip=True)
        elif kind == "collapse":
            x = collapse_ws(x)
        if words:
            x = truncate_tail(x, words)
    return x


def completion_context(prefix, context_json, suggestions_json, completion, words: int = 40,
                       completion_words: int = 3) -> Column:
    """One labelled training string from JSON-array context/suggestion strings."""
    def joined(js):
        items = F.from_json(_c(js), "array<string>")
        return truncate_tail(F.array_join(F.transform(items, lambda t: normalize(t)), " | "), words)

    head = F.array_join(F.slice(F.split(_c(completion), " ", -1), 1, completion_words), " ")
    a, b, p, d = CONTEXT_LABELS
    return F.concat(F.lit(a), joined(suggestions_json), F.lit(b), joined(context_json),
                    F.lit(p), truncate_tail(F.lower(_c(prefix)), words), F.lit(d), head)


def merge_prefix_suffix(prefix, suffix) -> Column:
    """Replace the trailing partial word of ``prefix`` by ``suffix`` (empty prefix -> suffix)."""
    return F.concat(F.regexp_replace(_c(prefix), "[^ ]*\\z", ""), _c(suffix))


def split_lang(line) -> Column:
    """``prefix\\tlang`` with exactly one tab; otherwise the whole line and ``en``."""
    parts = F.split(_c(line), "\t", -1)
    two = F.size(parts) == 2
    return F.struct(F.when(two, parts[0]).otherwise(_c(line)).alias("prefix"),
                    F.when(two, parts[1]).otherwise(F.lit("en")).alias("lang"))


def training_text(query, enhanced) -> Column:
    """Start marker + query + separator + enhanced + end marker."""
    return F.concat(F.lit(START_MARK), _c(query), F.lit(SEP_MARK), _c(enhanced), F.lit(END_MARK))


def extract_after_marker(text, sep: str = SEP_MARK) -> Column:
    """Exactly two parts around ``sep``: the right-stripped second part, else ''."""
    parts = F.split(_c(text), re.escape(sep), -1)
    return F.when(F.size(parts) == 2, rstrip_ws(parts[1])).otherwise(F.lit(""))


def extract_by_offset(text, query_len, marker: str = QUERY_MARK) -> Column:
    """Text after the last ``marker`` (whole text if absent), minus ``query_len + 2`` characters."""
    tail = F.substring_index(_c(text), marker, -1)
    start = _c(query_len).cast("int") + F.lit(3)
    return F.when(start > F.length(tail), F.lit("")).otherwise(tail.substr(start, F.length(tail)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


# A number that stands behind the text in an array: Spark's parser stops after the first value, so the number is reached
# only if the text is exactly one JSON value.
_STOP = 918273645


def json_object(c) -> Column:
    """The text as a variant if the whole of it is one JSON object, else null."""
    def checked(v):
        whole = F.try_variant_get(v, "$[1]", "bigint") == _STOP
        return let(F.try_variant_get(v, "$[0]", "variant"),
                   lambda obj: F.when(whole & F.startswith(F.schema_of_variant(obj), F.lit("OBJECT")), obj))

    return let(F.try_parse_json(F.concat(F.lit("["), _c(c), F.lit(f",{_STOP}]"))), checked)


def variant_string(v, field: str) -> Column:
    """A top-level field of a variant object, null unless it is a string."""
    return let(F.try_variant_get(v, f"$.{field}", "variant"),
               lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))


def json_field(c, field: str) -> Column:
    """A top-level JSON string field; null when the whole text is not a JSON object, lacks it or holds no string there."""
    return variant_string(json_object(c), field)


def json_quote(c) -> Column:
    """A value as a quoted, escaped JSON string (``<``, ``>`` and accents kept)."""
    j = F.to_json(F.struct(_c(c).alias("v")))
    return j.substr(F.lit(6), F.length(j) - F.lit(6))
