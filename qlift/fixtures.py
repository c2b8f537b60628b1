"""Derived fixture views over the driver's base tables.

One list of SQL blocks feeds both engines: Spark builds them as temporary views,
the DuckDB oracle inlines them as a ``WITH`` prefix.  Four macros differ per dialect
and are expanded here.  Spark never runs a cross join: the 7-model / 4-level
expansion is a ``LATERAL VIEW explode(sequence(..))`` (a projection, no join),
DuckDB's oracle may use a plain cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Label ladder used by the fixtures (lowest to highest).
LABELS = ["very low", "low", "high", "very high"]

_BLOCKS: list[tuple[str, list[str], str]] = [
    ("fx_queries", ["conversations"], """
SELECT conv_id * 101 + turn AS query_id, conv_id, turn, text AS query
FROM conversations WHERE role = 'user'
"""),
    ("fx_drafts", ["fx_queries"], """
SELECT query_id, model_id, level,
  CASE WHEN (query_id + model_id + level) % 11 = 0 THEN ''
       WHEN shape = 1 THEN concat('Explain ', lead)
       WHEN shape = 2 THEN concat('Explain ', lead, ' for <Audience> within <Time>')
       WHEN shape = 3 THEN concat('Explain ', lead, ' for <', w1, '> within <two hours>')
       ELSE concat('Explain ', lead, ' for <', w1, '/', w2, '/experts> within <one day/', w3, '>') END AS draft
FROM (
  SELECT query_id, CAST(model_id AS BIGINT) AS model_id, CAST(level AS BIGINT) AS level,
    CASE WHEN (query_id + model_id) % 5 = 0 AND level > 1 THEN level - 1 ELSE level END AS shape,
    concat(split_part(q, ' ', 1), ' ', split_part(q, ' ', 2), ' ', split_part(q, ' ', 3)) AS lead,
    split_part(q, ' ', 1) AS w1, split_part(q, ' ', 2) AS w2, split_part(q, ' ', 3) AS w3
  FROM (SELECT query_id, replace(lower(query), chr(10), ' ') AS q FROM fx_queries) AS a
  XJOIN(m, model_id, 0, 6) XJOIN(l, level, 1, 4)
) AS b
"""),
    ("fx_finals", ["fx_drafts"], """
SELECT query_id, model_id, level,
  CASE WHEN (query_id + level) % 3 = 0 THEN draft ELSE FILLFIRST(draft) END AS final_query
FROM fx_drafts
"""),
    ("fx_tsv", ["fx_queries"], """
SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'val' ELSE 'train' END AS split,
  CASE query_id % 10 WHEN 0 THEN '   ' WHEN 3 THEN query
    WHEN 4 THEN concat(' ', chr(9), 'improve') WHEN 5 THEN concat(query, chr(9), ' ')
    ELSE concat(query, chr(9), 'improve ', query) END AS line
FROM (SELECT query_id, replace(query, chr(10), ' ') AS query FROM fx_queries) AS a
"""),
    ("fx_lrqi", ["fx_queries"], """
SELECT query_id, CAST(model_id AS BIGINT) AS model_id, CAST(level AS BIGINT) AS level,
  CASE WHEN (query_id + model_id + level) % 17 = 0 THEN 'cannot rate' ELSE concat(
    '- Review Relevance: on topic: yes', chr(10), '- Relevance: ', LABEL(query_id * 3 + model_id * 5 + level * 7), chr(10),
    '- Review Engagement: fine', chr(10), '- Engagement: ', LABEL(query_id * 3 + model_id * 5 + level * 7 + 11), chr(10),
    '- Detail: ', LABEL(query_id + model_id + level * 2), chr(10),
    CASE WHEN (query_id + model_id + level) % 13 = 0 THEN '' ELSE concat('- Clarity: ', LABEL(query_id + level), chr(10)) END,
    '- Perceived Intelligence: ', LABEL(query_id * 7 + model_id), chr(10),
    '- Overall score: ', LABEL(query_id * 5 + model_id * 3 + level)) END AS raw
FROM fx_queries
XJOIN(m, model_id, 0, 6) XJOIN(l, level, 0, 4)
"""),
    ("fx_eqdq", ["fx_drafts"], """
SELECT query_id, model_id, level, concat(
    '- Relevance: ', LABEL(query_id + model_id), chr(10), '- Engagement: ', LABEL(query_id + level), chr(10),
    '- Detail: ', LABEL(query_id * 3 + level), chr(10), '- Clarity: ', LABEL(model_id + level), chr(10),
    '- Placeholder Quality: ', LABEL(query_id + model_id * 3 + level), chr(10),
    '- Placeholder Choices Quality: ',
    CASE WHEN (draft LIKE '%<%') = ((query_id + model_id) % 7 = 0) THEN 'NA' ELSE LABEL(query_id + level * 3) END, chr(10),
    '- Overall score: ', LABEL(query_id + model_id + level)) AS raw
FROM fx_drafts
"""),
    ("fx_aue", ["fx_drafts"], """
SELECT query_id, model_id, level,
  CASE WHEN (query_id + model_id + level) % 13 = 0 THEN '{bad'
    WHEN (query_id + model_id + level) % 29 = 1 THEN '{"explanation":"x","comprehension_score":"low"} trailing'
    WHEN (query_id + model_id + level) % 29 = 2 THEN concat(chr(96), chr(96), chr(96), 'json', chr(10), '{"explanation":"x"}', chr(10), chr(96), chr(96), chr(96))
    WHEN (query_id + model_id + level) % 29 = 3 THEN '{"explanation":5,"comprehension_score":null,"modification_score":["low"]}'
    WHEN (query_id + model_id + level) % 29 = 4 THEN '{"explanation":"cut off, "comprehension'
    WHEN (query_id + model_id + level) % 29 = 5 THEN concat(' {"enhanced_query":"', replace(replace(draft, chr(92), ''), '"', ''),
      '","final_enhanced_query":"final ', CAST(level AS VARCHAR(9)), '"}', chr(10))
    ELSE concat(
    '{"explanation":"', repeat('word ', CAST((query_id + level) % 25 AS INT)), 'end", "comprehension_score":"', LABEL(query_id + level),
    ' effort","modification_score":"', LABEL(query_id + model_id * 3 + level), ' effort"}') END AS raw
FROM fx_drafts
"""),
    ("fx_binary", ["fx_drafts"], """
SELECT query_id, model_id, level,
  CASE WHEN (query_id + model_id + level) % 19 = 0 THEN 'n/a'
    WHEN (query_id + model_id + level) % 29 = 1 THEN '{"Score":"Highly Likely","Explanation":"x"} but see note'
    WHEN (query_id + model_id + level) % 29 = 2 THEN '{"Score":true,"Explanation":7}'
    WHEN (query_id + model_id + level) % 29 = 3 THEN '[{"Score":"Highly Likely"}]'
    ELSE concat('{"Score":"Highly ',
    CASE WHEN (query_id * 3 + model_id + level) % 8 = 0 THEN 'Unlikely' ELSE 'Likely' END,
    '", "Explanation": "', repeat('word ', CAST((query_id + model_id) % 35 AS INT)), 'end"}') END AS raw
FROM fx_drafts
"""),
    ("fx_log", ["events"], """
SELECT event_id, concat(CASE WHEN event_id % 23 = 0 THEN '' WHEN event_id % 29 = 0 THEN '13/45/2024 10:00:00 AM ' ELSE concat(LOGTS(ts), ' ') END,
  CASE WHEN event_id % 31 = 0 THEN 'no level here' ELSE concat('[',
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'CRITICAL' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE 'WARN' END,
  '] epoch : ', CAST(event_id % 50 AS VARCHAR(9)), ' - average_val_loss : ', CAST(CAST(floor(round(value * 100) / 100) AS BIGINT) AS VARCHAR(19)), '.',
  lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR(9)), 2, '0')) END) AS line
FROM events
"""),
]

FIXTURES = {name: (deps, sql) for name, deps, sql in _BLOCKS}
ORDER = [name for name, _, _ in _BLOCKS]


def _split_args(body: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in body:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    out.append(cur.strip())
    return out


def _expand_macro(sql: str, name: str, render) -> str:
    token = name + "("
    while True:
        i = sql.find(token)
        if i < 0:
            return sql
        j, depth = i + len(token), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        sql = sql[:i] + render(*_split_args(sql[i + len(token): j - 1])) + sql[j:]


def expand(sql: str, dialect: str) -> str:
    """Expand the fixture macros for ``dialect`` in {"spark", "duckdb"}."""
    duck = dialect == "duckdb"
    sql = _expand_macro(sql, "LABEL", lambda x: (
        f"CASE ({x}) % 4 WHEN 0 THEN 'very low' WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'very high' END"))
    if duck:
        sql = _expand_macro(sql, "FILLFIRST", lambda x: f"regexp_replace({x}, '<([^<>/]*)[^<>]*>', '\\1', 'g')")
        sql = _expand_macro(sql, "LOGTS", lambda x: f"strftime({x}, '%m/%d/%Y %I:%M:%S %p')")
        sql = _expand_macro(sql, "XJOIN", lambda a, c, lo, hi: (
            f" CROSS JOIN (SELECT CAST(range AS INTEGER) AS {c} FROM range({lo}, {int(hi) + 1})) AS {a}"))
    else:
        sql = _expand_macro(sql, "FILLFIRST", lambda x: f"regexp_replace({x}, '<([^<>/]*)[^<>]*>', '$1')")
        sql = _expand_macro(sql, "LOGTS", lambda x: f"date_format({x}, 'MM/dd/yyyy hh:mm:ss a')")
        sql = _expand_macro(sql, "XJOIN", lambda a, c, lo, hi: (
            f" LATERAL VIEW explode(sequence({lo}, {hi})) {a} AS {c}"))
    return sql


def closure(names: list[str]) -> list[str]:
    """Fixture names needed (dependencies first, in file order)."""
    need: set[str] = set()

    def visit(n: str) -> None:
        if n in FIXTURES and n not in need:
            need.add(n)
            for d in FIXTURES[n][0]:
                visit(d)

    for n in names:
        visit(n)
    return [n for n in ORDER if n in need]


def duckdb_prefix(names: list[str]) -> str:
    """``WITH a AS (...), b AS (...)`` for the fixtures in ``names`` (and their dependencies)."""
    blocks = [f"{n} AS ({expand(FIXTURES[n][1], 'duckdb').strip()})" for n in closure(names)]
    return ("WITH " + ",\n".join(blocks) + "\n") if blocks else ""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Base tables of one scale-factor folder plus lazily-built fixture views.

    Each fixture is an analysed DataFrame; its temporary view name carries a per-instance
    suffix so two folders (or two users) in one session never clash.
    """

    _seq = 0

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        Tables._seq += 1
        self._tag = f"q{Tables._seq}"
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in FIXTURES:
                deps, sql = FIXTURES[name]
                sql = expand(sql, "spark")
                for d in deps:
                    self.get(d)
                    sql = _rename(sql, d, f"{d}_{self._tag}")
                df = self.spark.sql(sql)
            elif name in BASE_TABLES:
                df = read_table(self.spark, self.sf_dir, name)
            else:
                raise KeyError(name)
            df.createOrReplaceTempView(f"{name}_{self._tag}")
            self._cache[name] = df
        return self._cache[name]


def _rename(sql: str, old: str, new: str) -> str:
    import re

    return re.sub(rf"\b{re.escape(old)}\b", new, sql)
