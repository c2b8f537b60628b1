r"""Secrets: patterns with a shape of their own, and weak parts that count only together.

Base kinds, leftmost and non-overlapping per kind: ``assign`` (a name of a secret, ``=`` or ``:``, 6 characters or more),
``access`` (access key id of 20 characters or more), ``hex`` (24 hexadecimal characters or more).  These always stay.

The method adds weak parts: ``ident`` (a user, login, account or client id that is assigned), ``opaque`` (20 characters or
more of one run with lower case, upper case and a digit) and ``endpoint`` (an URL, a host that is assigned).  Alone they
are ordinary text, so a weak part is reported only if parts that complete it stand in its scope (lines without a blank
line between them) and begin within ``reach`` code points of it:

* ``ident`` with a secret (``opaque``, ``assign``, ``hex``),
* ``opaque`` with an identifier (``ident``, ``access``) or an ``endpoint``,
* ``endpoint`` with an identifier and a secret.

Plan: one pass over the texts finds the parts (texts go no further; a text whose weak parts find no partner anywhere in
it sends none).  The parts meet in an interval join: the starts are cut into buckets of ``reach``, each bucket is
reduced to its first and last start per role, and a weak part looks into its own bucket (always near enough) and the two beside
it (by the last, or first, start there).  So no pairs are made, and a text with a million parts is spread over its
buckets.  Equal texts share a key, the digest of the text, and are joined once.  Only rows with parts are joined back.

Edge cases: a null or empty text has no spans; very long texts are read whole; repeated rows are answered one by one; an
empty table gives an empty result; all columns but ``text`` are carried along in ``row``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import prepare, saved, text_column

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("ident", "opaque", "endpoint")
KINDS = (*BASE_KINDS, *ADDED_KINDS)
ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
# Fixed values of the contract (base kinds); letters of names in either case.
PATTERNS = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)" + ASSIGNED + r"([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "ident": re.compile(r"(?:username|user|login|account|client_?id|key_?id)" + ASSIGNED + r"[A-Za-z0-9._@+-]{3,}", re.I | re.A),
    "opaque": re.compile(r"[A-Za-z0-9+/_-]{20,}"),
    "endpoint": re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"'<>]+|(?:host|server|endpoint)""" + ASSIGNED + r"[A-Za-z0-9.-]{3,}", re.I | re.A),
}
MIXED = tuple(re.compile(c) for c in ("[a-z]", "[A-Z]", "[0-9]"))
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # what stays of the runs [0-9a-f]+
SCOPE_END = re.compile(r"\n[ \t\r]*\n")
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
ROLE = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "ident": IDENTIFIER, "opaque": SECRET, "endpoint": ENDPOINT}
REACH = 400

_SPAN = StructType([StructField(n, IntegerType()) for n in ("start", "rank", "end")])
_PART = StructType([StructField(n, IntegerType()) for n in ("start", "rank", "end", "scope")])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, rank of the kind, end`` of the base kinds."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in PATTERNS["assign"].finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in PATTERNS["access"].finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same of the weak kinds; an ``opaque`` run that touches a base span or an endpoint is no part of its own."""
    out = []
    if ":" in text or "=" in text:
        for k in ("ident", "endpoint"):
            out += [(m.start(), KINDS.index(k), m.end()) for m in PATTERNS[k].finditer(text)]
    runs = [m for m in PATTERNS["opaque"].finditer(text) if all(c.search(m.group()) for c in MIXED)]
    if runs:
        taken = sorted([(s, e) for s, _, e in base] + [(s, e) for s, r, e in out if r == KINDS.index("endpoint")])
        starts, reach = [s for s, _ in taken], []
        for _, e in taken:
            reach.append(max(e, reach[-1] if reach else 0))  # furthest end of the spans so far
        for m in runs:
            i = bisect_right(starts, m.end() - 1)
            if not i or reach[i - 1] <= m.start():
                out.append((m.start(), KINDS.index("opaque"), m.end()))
    return sorted(out)


def parts_of(text: str, base: list, weak: list) -> list[tuple[int, int, int, int]]:
    """All parts with their scope, if a weak one can have a partner in this text at all."""
    if not weak or len({ROLE[KINDS[r]] for _, r, _ in (*base, *weak)}) < 2:
        return []
    ends = [m.end() for m in SCOPE_END.finditer(text)]
    return [(s, r, e, bisect_right(ends, s)) for s, r, e in (*base, *weak)]


def _scanned(docs: DataFrame) -> DataFrame:
    """``row, base, key, parts`` per row."""
    prepare(docs.sparkSession)
    others = [F.col(f"`{n}`") for n in docs.columns if n != "text"]
    d = docs.select((F.struct(*others) if others else F.lit(None).cast("struct<none:string>")).alias("row"), text_column("`text`").alias("text"))
    schema = StructType([d.schema["row"], StructField("base", ArrayType(_SPAN)), StructField("key", BinaryType()), StructField("parts", ArrayType(_PART))])
    span, part = (pa.list_(pa.struct([(f.name, pa.int32()) for f in t.fields])) for t in (_SPAN, _PART))

    def scan(batches):
        for b in batches:
            bases, keys, parts = [], [], []
            for t in b.column("text"):
                text = t.as_py()
                base = base_spans(text)
                found = parts_of(text, base, weak_spans(text, base))
                bases.append([dict(zip(("start", "rank", "end"), s)) for s in base])
                parts.append([dict(zip(("start", "rank", "end", "scope"), p)) for p in found])
                keys.append(hashlib.blake2b(text.encode(), digest_size=16).digest() if found else None)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(bases, span), pa.array(keys, pa.binary()), pa.array(parts, part)],
                                             names=["row", "base", "key", "parts"])

    return d.mapInArrow(scan, schema)


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts of ``key, start, rank, end, scope`` whose partners stand near, with the roles found (``roles``).

    An interval join over buckets of ``reach`` starts; one row per part, whatever the number of partners."""
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("rank") + 1)
    p = parts.select("key", "scope", "start", "rank", "end", role.alias("role"), F.floor(F.col("start") / reach).cast("int").alias("bucket"))
    near = p.groupBy("key", "scope", "bucket", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = p.where(F.col("rank") >= len(BASE_KINDS)).distinct().withColumnsRenamed({"role": "own", "bucket": "home"})
    weak = weak.withColumn("bucket", F.explode(F.array(*[F.col("home") + i for i in (-1, 0, 1)])))
    met = weak.join(near, ["key", "scope", "bucket"]).where("role <> own").where(
        (F.col("bucket") == F.col("home"))
        | ((F.col("bucket") < F.col("home")) & (F.col("last") >= F.col("start") - reach))
        | ((F.col("bucket") > F.col("home")) & (F.col("first") <= F.col("start") + reach)))
    linked = met.groupBy("key", "start", "rank", "end").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    ident, opaque, endpoint = (KINDS.index(k) for k in ADDED_KINDS)
    return linked.where(((F.col("rank") == ident) & F.array_contains("roles", SECRET)) | (F.col("rank") == opaque)
                        | ((F.col("rank") == endpoint) & F.array_contains("roles", IDENTIFIER) & F.array_contains("roles", SECRET)))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``row`` (the input row but ``text``) and ``spans``: an array of ``(start, rank, end, kind)`` in code points, end
    exclusive, sorted by start, then kind; the ranks follow ``KINDS``."""
    found = saved(_scanned(docs))
    parts = found.where(F.size("parts") > 0).select("key", F.explode("parts").alias("p")).select("key", "p.*")
    added = (link_parts(parts, reach).groupBy("key")
             .agg(F.collect_list(F.struct("start", "rank", "end")).alias("added")))  # the spans of one text
    alone = found.where(F.size("parts") == 0).select("row", F.col("base").alias("all"))
    joined = (found.where(F.size("parts") > 0).drop("parts").join(added, "key", "left")
              .select("row", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")).alias("all")))
    kind = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort("all"), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
                                                               F.element_at(kind, s["rank"] + 1).alias("kind")))
    return alone.unionByName(joined).select("row", spans.alias("spans"))


def _of_rank(r: int):
    return lambda s: s["rank"] == r


def _said(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = [F.size(F.filter("spans", _of_rank(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    return find_secrets(docs).select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _oracle() -> str:
    """DuckDB: positions from the pieces between the matches, partners by an inequality join."""
    def names(*words):
        return "(?:" + "|".join(_either_case(w).replace("_", "_?") for w in words) + ")"

    assigned = ASSIGNED.replace("'", "''")
    patterns = {
        "assign": names("password", "passwd", "secret", "token", "api_key") + assigned + "[A-Za-z0-9+/_.=-]+",
        "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
        "ident": names("username", "user", "login", "account", "client_id", "key_id") + assigned + "[A-Za-z0-9._@+-]{3,}",
        "opaque": "[A-Za-z0-9+/_-]{20,}",
        "endpoint": r"[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20""''<>]+".replace('""', '"') + "|" + names("host", "server", "endpoint") + assigned + "[A-Za-z0-9.-]{3,}",
    }
    keep = {
        "assign": f"length(regexp_replace(v, '^{names('password', 'passwd', 'secret', 'token', 'api_key')}{assigned}', '')) >= 6",
        "access": "length(v) >= 20", "hex": "length(v) >= 24", "ident": "true", "endpoint": "true",
        "opaque": "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')",
    }
    ctes, parts = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"], []
    for rank, (k, p) in enumerate(patterns.items()):
        ctes.append(f"""m_{k} AS (SELECT doc_id, t, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS m FROM d WHERE regexp_matches(t, '{p}')),
s_{k} AS (SELECT doc_id, t, m[i] AS v, (list_sum(list_transform(p[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM m_{k}, unnest(range(1, len(m) + 1)) AS u(i))""")
        parts.append(f"SELECT doc_id, '{k}' AS kind, {rank} AS rank, {ROLE[k]} AS role, a, a + length(v) AS e, "
                     f"len(regexp_extract_all(substr(t, 1, a), '\\n[ \\t\\r]*\\n')) AS scope FROM s_{k} WHERE {keep[k]}")
    ctes.append("found AS (" + "\nUNION ALL ".join(parts) + ")")
    ctes.append("""p AS (SELECT * FROM found AS o WHERE kind <> 'opaque' OR NOT EXISTS (SELECT 1 FROM found AS b WHERE b.doc_id = o.doc_id
  AND (b.rank < 3 OR b.kind = 'endpoint') AND b.a < o.e AND b.e > o.a))""")
    ctes.append(f"""roles AS (SELECT w.doc_id, w.rank, w.a, w.e, bool_or(n.role = 0) AS ident, bool_or(n.role = 1) AS secret, bool_or(n.role = 2) AS endpoint
  FROM p AS w JOIN p AS n ON n.doc_id = w.doc_id AND n.scope = w.scope AND n.role <> w.role AND abs(n.a - w.a) <= {REACH} WHERE w.rank >= 3 GROUP BY ALL)""")
    ctes.append("""spans AS (SELECT doc_id, kind, rank, a, e FROM p WHERE rank < 3 UNION ALL
  SELECT p.doc_id, p.kind, p.rank, p.a, p.e FROM p JOIN roles AS r ON r.doc_id = p.doc_id AND r.rank = p.rank AND r.a = p.a
  WHERE (p.kind = 'ident' AND r.secret) OR (p.kind = 'opaque' AND (r.ident OR r.endpoint)) OR (p.kind = 'endpoint' AND r.ident AND r.secret))""")
    said = "kind || ':' || a || ':' || e"
    counts = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)
    grouped = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)
    return "WITH " + ",\n".join(ctes) + f"""
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN (SELECT doc_id, {grouped}, string_agg({said}, ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS base,
  string_agg({said}, ',' ORDER BY a, rank) AS spans FROM spans GROUP BY doc_id) AS g USING (doc_id)"""


OP13_SQL = _oracle()
