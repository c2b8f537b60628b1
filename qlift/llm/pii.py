r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions.  A pattern's matches and the pieces between them (``regexp_extract_all`` and ``split``
walk the text alike) give every span's position in code points; nothing leaves its row, so there is no exchange.
The work grows in proportion to the text and its matches: positions are running sums over blocks, the context of a match
comes from the pieces beside it, and a redacted text is joined once from its pieces and marks.

Base kinds, leftmost and non-overlapping per kind: ``email``, ``ip`` (parts up to 255), ``card`` (14 to 19 digits
that pass Luhn), ``phone`` (10 to 15 digits).  These stay whatever their score.  The method adds ``iban`` (mod 97
must be 1) and ``ssn`` (``ddd-dd-dddd``, which has no checksum); an added span stays when its score reaches
``threshold``.  A score starts at the kind's prior and rises when a context word of the kind stands within
``reach`` code points before the span or after it.

The patterns are written so that Java's matcher neither recurses nor rescans: possessive repeats, and a match may
only begin where a run of its characters begins (or where the last match ended).  They find what the plain forms find.

Edge cases: a null or empty text has no spans; very long texts are read whole; repeated rows give repeated rows; an
empty table gives an empty result; other columns of the caller are carried along in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_column

# Fixed values of the contract, in its order.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
# A text without this character has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write|reach", "ip": "ip|address|host|server", "card": "card|visa|credit|pay",
    "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|transfer", "ssn": "ssn|social|security|insurance",
}
CONTEXT_GAIN = 0.4
LEAST = 5  # code points of the shortest match of any kind
STEP = 256  # elements of a block of running sums
BLOCK = 4096  # code points of a block of a text
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _luhn(digits: Column) -> Column:
    """True if the digit string passes Luhn (the last digit counts once, the one before it twice, ...)."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _mod97(iban: Column) -> Column:
    """True if the IBAN, its first four characters moved to the end and letters read as 10..35, is 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def add(acc, c):
        v = F.instr(F.lit(LETTERS), c)
        return F.when(v > 0, (acc * 100 + v + 9) % 97).otherwise((acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97)

    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), add) == 1


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        def small(p):
            p = F.regexp_replace(p, "^0+", "")
            return F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(F.lit(False))
        return F.forall(F.split(v, "[.]"), small)
    if kind == "card":
        d = F.translate(v, " -", "")
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.translate(v, "+ ().-", "")).between(10, 15)
    if kind == "iban":
        return _mod97(F.translate(v, " ", ""))
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body(value)``, the value worked out once (a column named twice, or inside a lambda, may be worked out again)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, zero: Column, merge) -> Column:
    """For each element what ``merge`` makes of all earlier ones.  Blocks of ``STEP`` and the totals of the blocks before: no
    array grows element by element, which would copy it each time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / STEP).cast("int")), lambda b: F.slice(values, b * STEP + 1, STEP))

    def offsets(bl):
        return _let(F.transform(bl, lambda block: F.aggregate(block, zero, merge)), lambda totals: F.flatten(F.transform(
            bl, lambda block, b: _let(F.aggregate(F.slice(totals, F.lit(1), b), zero, merge), lambda off: F.transform(
                block, lambda x, i: F.aggregate(F.slice(block, F.lit(1), i), off, merge))))))

    return _let(blocks, offsets)


def _near(pieces: Column, found: Column, i: Column, reach: int) -> Column:
    """Up to ``reach`` code points before match i and after it, from the pieces and matches beside it (a match has 5 code
    points at least, so ``reach`` of them lie in ``reach / 5 + 1`` matches and the pieces around)."""
    k = reach // LEAST + 1
    lo = F.greatest(i - k, F.lit(0))
    earlier = F.zip_with(F.slice(pieces, lo + 1, i - lo), F.slice(found, lo + 1, i - lo), lambda p, m: F.concat(F.right(p, F.lit(reach)), F.right(m, F.lit(reach))))
    later = F.zip_with(F.slice(found, i + 2, F.lit(k)), F.slice(pieces, i + 3, F.lit(k)), lambda m, p: F.concat(F.left(F.coalesce(m, F.lit("")), F.lit(reach)),
                                                                                                           F.left(F.coalesce(p, F.lit("")), F.lit(reach))))
    before = F.right(F.concat(F.array_join(earlier, ""), F.right(F.get(pieces, i), F.lit(reach))), F.lit(reach))
    after = F.left(F.concat(F.left(F.get(pieces, i + 1), F.lit(reach)), F.array_join(later, "")), F.lit(reach))
    return F.concat_ws(" ", before, after)


def _score(kind: str, around: Column) -> Column:
    near = F.lower(around).rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})")
    return F.least(F.lit(PRIOR[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0), F.lit(1.0))


def _spans(kind: str, rank: int, found: Column, valid: Column, pieces: Column, reach: int) -> Column:
    """The spans of the valid matches: a match starts behind all pieces and matches before it."""
    def of(p):
        widths = F.zip_with(F.slice(p, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n")))

        def placed(w):
            ends = _before(F.transform(w, lambda x: x["gap"] + x["n"]), F.lit(0), lambda acc, x: acc + x)
            spans = F.transform(F.arrays_zip(ends.alias("at"), w.alias("w"), valid.alias("ok")), lambda x, i: F.when(x["ok"], _let(
                x["at"] + x["w"]["gap"], lambda start: F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                                                                (start + x["w"]["n"]).alias("end"), _score(kind, _near(p, found, i, reach)).alias("score")))))
            return F.filter(spans, lambda x: x.isNotNull())

        return _let(widths, placed)

    return _let(pieces, of)


def _check(kind: str):
    return lambda v: _valid(kind, v)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def find_spans(docs: DataFrame, reach: int = 40, threshold: float = 0.6) -> DataFrame:
    """``row`` (the whole input row), ``body`` (its text, null as empty) and ``spans``: an array of
    ``(start, rank, kind, end, score)`` in code points, end exclusive, sorted by start, then kind."""
    kinds = (*BASE_KINDS, *ADDED_KINDS)
    d = docs.select(F.struct(F.col("*")).alias("row"), text_column("`text`").alias("body"))
    none = F.expr("cast(array() as array<string>)")
    for k in kinds:
        found = F.regexp_extract_all(F.col("body"), F.lit(PATTERNS[k]), F.lit(0))
        d = d.withColumn(f"m_{k}", F.when(F.instr(F.col("body"), NEEDS[k]) > 0, found).otherwise(none) if k in NEEDS else found)
    # verdicts of the matches; the pieces between them are cut only where a match holds
    for k in kinds:
        d = d.withColumn(f"v_{k}", F.transform(f"m_{k}", _check(k)))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,score:double>>)")
    for rank, k in enumerate(kinds):
        spans = _spans(k, rank, F.col(f"m_{k}"), F.col(f"v_{k}"), F.split("body", PATTERNS[k], -1), reach)
        if k in ADDED_KINDS:
            spans = F.filter(spans, lambda s: s["score"] >= threshold)
        d = d.withColumn(f"s_{k}", F.when(F.exists(f"v_{k}", lambda ok: ok), spans).otherwise(empty))
    return d.select("row", "body", F.array_sort(F.concat(*[F.col(f"s_{k}") for k in kinds])).alias("spans"))


def span_string(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` (code points) out of its blocks of ``BLOCK``: only the blocks it meets are touched."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    met = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(met, start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))


def _marked(blocks: Column, spans: Column, length: Column) -> Column:
    """The text with marks for its spans (sorted): a span that begins behind all earlier ones starts a cut, which reaches to
    the furthest end of the spans before the next cut."""
    def joined(reached):
        cuts = F.filter(F.zip_with(spans, reached, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), lambda x: x["s"]["start"] >= x["r"])
        parts = F.transform(cuts, lambda x: F.concat(_between(blocks, x["r"], x["s"]["start"]), F.lit("["), F.upper(x["s"]["kind"]), F.lit("]")))
        furthest = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), _between(blocks, furthest, length))

    return _let(_before(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda acc, x: F.greatest(acc, x)), joined)


def redact(docs: DataFrame, reach: int = 40, threshold: float = 0.6) -> DataFrame:
    """The rows of ``docs`` with every span of personal data replaced by ``[KIND]`` in ``text`` (overlapping spans:
    the one that begins first, and at the same start the first kind, names the cut, which reaches to the furthest
    end).  ``n_chars`` follows the new text where the column exists.  A null text stays null."""
    d = find_spans(docs, reach, threshold)
    marked = _let(F.regexp_extract_all(F.col("body"), F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: _marked(blocks, F.col("spans"), F.length("body")))
    cut = F.when(F.size("spans") > 0, marked)
    text = F.when(F.size("spans") > 0, cut).otherwise(F.col("row.text"))
    d = d.select("row", text.alias("new_text"))
    names = docs.columns
    out = []
    for n in names:
        if n == "text":
            out.append(F.col("new_text").alias(n))
        elif n == "n_chars":
            out.append(F.when(F.col("new_text").eqNullSafe(F.col("row.text")), F.col("row.n_chars"))
                       .otherwise(F.length("new_text").cast(docs.schema[n].dataType)).alias(n))
        else:
            out.append(F.col("row").getField(n).alias(n))
    return d.select(*out)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = find_spans(docs).select(F.col("row.doc_id").alias("doc_id"), "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in (*BASE_KINDS, *ADDED_KINDS)]
    return d.select("doc_id", *counts, F.sha2(span_string(base), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """DuckDB: plain forms of the patterns (its matcher is linear); ``\b`` is ASCII there, as the look-arounds here."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN substr({digits}, length({digits}) - i, 1)::INT "
            f"WHEN substr({digits}, length({digits}) - i, 1)::INT > 4 THEN 2 * substr({digits}, length({digits}) - i, 1)::INT - 9 "
            f"ELSE 2 * substr({digits}, length({digits}) - i, 1)::INT END)) % 10 = 0")
    moved = "(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4))"
    mod97 = (f"list_reduce(list_transform(range(1, length({moved}) + 1), lambda i: CASE WHEN regexp_matches(substr({moved}, i, 1), '[0-9]') "
             f"THEN substr({moved}, i, 1)::BIGINT ELSE (ascii(substr({moved}, i, 1)) - 55)::BIGINT END), "
             "lambda x, y: CASE WHEN y > 9 THEN (x * 100 + y) % 97 ELSE (x * 10 + y) % 97 END) = 1")
    near = ("regexp_matches(lower(substr(t, greatest(a - 39, 1), least(a, 40)) || ' ' || substr(t, a + length(v) + 1, 40)), "
            "'(^|[^a-z])(ssn|social|security|insurance)')")
    checks = {
        "email": "true", "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR lpad(ltrim(x, '0'), 3, '0') > '255')) = 0",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 10 AND 15", "iban": mod97, "ssn": near,
    }
    ctes, parts = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"], []
    for rank, (k, p) in enumerate(patterns.items()):
        ctes.append(f"""m_{k} AS (SELECT doc_id, t, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS m FROM d WHERE regexp_matches(t, '{p}')),
s_{k} AS (SELECT doc_id, t, m[i] AS v, (list_sum(list_transform(p[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM m_{k}, unnest(range(1, len(m) + 1)) AS u(i))""")
        parts.append(f"SELECT doc_id, '{k}' AS kind, {rank} AS rank, a, a + length(v) AS e FROM s_{k} WHERE {checks[k]}")
    ctes.append("spans AS (" + "\nUNION ALL ".join(parts) + ")")
    said = "kind || ':' || a || ':' || e"
    counts = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in patterns)
    grouped = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in patterns)
    return "WITH " + ",\n".join(ctes) + f"""
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN (SELECT doc_id, {grouped}, string_agg({said}, ',' ORDER BY a, rank) FILTER (WHERE rank < 4) AS base,
  string_agg({said}, ',' ORDER BY a, rank) AS spans FROM spans GROUP BY doc_id) AS g USING (doc_id)"""


OP7_SQL = _oracle()
