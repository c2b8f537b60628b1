"""Vocabulary, id arrays, padding, labels, step plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions import arrays as AR
from ..functions import templates as TP
from ..functions import text as TX
from ..operators import subwords as SW
from ..operators import tokens as TK
from ..operators.ordering import dense_index
from .registry import dnorm, dtrunc, query
from .text_q import _d_msgs

CK = ["conv_id", "turn"]

# The oracles state their own constants (special tokens in id order, ids, lengths), not the library's.
_SPECIALS = ["<s>", "</s>", "<pad>", "<unk>", "<"]
_BOS, _EOS, _PAD, _UNK, _IGNORE = 0, 1, 2, 3, -100


def _vocab(t: Tables):
    return TK.build_vocab(t.documents, "text")


def _toks(x: str) -> str:
    return f"list_filter(string_split({dnorm(x)}, ' '), lambda t: t <> '')"


_SPECIALS_SQL = ", ".join(f"('{s}', {i})" for i, s in enumerate(_SPECIALS))

_VOCAB_CTE = f"""vocab AS (
  SELECT token, CAST(id AS BIGINT) AS id, CAST(NULL AS BIGINT) AS n FROM (VALUES {_SPECIALS_SQL}) AS s(token, id)
  UNION ALL
  SELECT token, CAST(rank + {len(_SPECIALS)} AS BIGINT) AS id, n FROM (
    SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS rank FROM (
      SELECT token, count(*) AS n FROM (SELECT unnest({_toks('text')}) AS token FROM documents) AS u
      WHERE token NOT IN ({", ".join(f"'{s}'" for s in _SPECIALS)}) GROUP BY token) AS c) AS r)"""


def _enc_cte(name: str, table: str, keys: list[str], text: str) -> str:
    k = ", ".join(keys)
    return f"""{name} AS (
  SELECT {k}, coalesce(e.ids, []::BIGINT[]) AS ids FROM {table} AS base LEFT JOIN (
    SELECT {k}, list(coalesce(v.id, {_UNK}) ORDER BY pos) AS ids FROM (
      SELECT {k}, unnest(tk) AS token, unnest(range(1, len(tk) + 1)) AS pos
      FROM (SELECT {k}, {_toks(text)} AS tk FROM {table}) AS a) AS t
    LEFT JOIN vocab AS v USING (token) GROUP BY {k}) AS e USING ({k}))"""


def _with(*ctes: str) -> str:
    # appended after the fixture prefix (which may already have opened a WITH)
    return ",\n".join(ctes)


def _s(x: str) -> str:
    return f"array_to_string({x}, ',')"


@query("c01_build_vocab", [], f"WITH {_VOCAB_CTE} SELECT token, id, n FROM vocab")
def c01(spark, sf):
    return _vocab(Tables(spark, sf))


@query("c02_encode", [], f"""WITH {_with(_VOCAB_CTE, _enc_cte('enc', 'conversations', ['conv_id', 'turn'], 'text'))}
SELECT conv_id, turn, {_s('ids')} AS ids, CAST(len(ids) AS BIGINT) AS n_ids FROM enc""")
def c02(spark, sf):
    t = Tables(spark, sf)
    enc = TK.encode(t.conversations, "text", _vocab(t), keys=CK)
    return enc.select("conv_id", "turn", AR.ids_to_text("ids").alias("ids"), F.size("ids").cast("bigint").alias("n_ids"))


@query("c03_decode", [], f"""WITH {_with(_VOCAB_CTE, _enc_cte('enc', 'conversations', ['conv_id', 'turn'], 'text'))}
SELECT conv_id, turn, trim(coalesce((SELECT string_agg(v.token, ' ' ORDER BY x.pos) FROM
   (SELECT unnest(list_filter(ids, lambda i: i >= {len(_SPECIALS)})) AS id,
           unnest(range(1, len(list_filter(ids, lambda i: i >= {len(_SPECIALS)})) + 1)) AS pos) AS x
   JOIN vocab AS v ON v.id = x.id), '')) AS text
FROM enc""")
def c03(spark, sf):
    t = Tables(spark, sf)
    vocab = _vocab(t)
    enc = TK.encode(t.conversations.select(*CK, "text"), "text", vocab, keys=CK)
    return TK.decode(enc.drop("text"), "ids", vocab, keys=CK).select("conv_id", "turn", "text")


_ENC_CONV = _with(_VOCAB_CTE, _enc_cte("enc", "conversations", ["conv_id", "turn"], "text"))


@query("c04_truncate_ids", [], f"""WITH {_ENC_CONV}
SELECT conv_id, turn, {_s('list_slice(ids, 1, 16)')} AS head_ids,
       {_s('list_slice(ids, greatest(len(ids) - 16 + 1, 1), len(ids))')} AS tail_ids, len(ids) > 16 AS is_trimmed
FROM enc""")
def c04(spark, sf):
    t = Tables(spark, sf)
    enc = TK.encode(t.conversations, "text", _vocab(t), keys=CK)
    return enc.select("conv_id", "turn", AR.ids_to_text(AR.truncate_ids("ids", 16, "head")).alias("head_ids"),
                      AR.ids_to_text(AR.truncate_ids("ids", 16, "tail")).alias("tail_ids"),
                      AR.is_trimmed("ids", 16).alias("is_trimmed"))


BUDGETS = (0, 1, 20, 60, 110, 150)
_CHAT = _d_msgs("phi_mini", dtrunc(dnorm("query", lower=False), 40), "CAST(query_id % 4 + 1 AS BIGINT)", None)


def _sum(parts: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform({parts}, lambda p: len({_toks('p')}))), 0) AS BIGINT)"


@query("c04b_chat_budget", ["fx_queries"], f""",
{_VOCAB_CTE},
parts AS (SELECT query_id, list_concat(list_transform({_CHAT}, lambda m: '<|' || m.role || '|>' || chr(10) || m.content || '<|end|>' || chr(10)),
    ['<|assistant|>' || chr(10)]) AS parts FROM fx_queries),
chat AS (SELECT query_id, parts, array_to_string(parts, '') AS text, CAST(b AS BIGINT) AS budget FROM parts, (VALUES {", ".join(f"({b})" for b in BUDGETS)}) AS v(b)),
fit AS (SELECT *, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(least(len(toks), budget) AS BIGINT) AS n_kept,
    CAST(len(list_filter(range(1, len(parts) + 1), lambda i: {_sum("list_slice(parts, i, len(parts))")} <= budget)) AS BIGINT) AS whole
  FROM (SELECT *, {_toks('text')} AS toks FROM chat) AS x),
spent AS (SELECT *, n_kept - {_sum("list_slice(parts, len(parts) - whole + 1, len(parts))")} AS cut_kept FROM fit),
said AS (SELECT query_id, budget, string_agg(token, ' ' ORDER BY pos) AS words FROM (
    SELECT query_id, budget, unnest(list_slice(toks, len(toks) - budget + 1, len(toks))) AS token, unnest(range(1, n_kept + 1)) AS pos FROM spent WHERE n_tokens > budget) AS k
  JOIN vocab USING (token) WHERE id >= {len(_SPECIALS)} GROUP BY query_id, budget)
SELECT query_id, budget, n_tokens, n_kept, whole, CASE WHEN cut_kept > 0 THEN CAST(len(parts) - whole - 1 AS BIGINT) END AS cut, cut_kept,
  CASE WHEN n_tokens <= budget THEN text ELSE coalesce(words, '') END AS trimmed_text, n_tokens > budget AS is_trimmed
FROM spent LEFT JOIN said USING (query_id, budget)""")
def c04b(spark, sf):
    t = Tables(spark, sf)
    chats = t.fx_queries.select("query_id", TP.chat_messages(TX.clean("query", "phi_medium"), F.col("query_id") % 4 + 1, "phi_mini").alias("chat"))
    chats = chats.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("bigint") for b in BUDGETS])))
    fitted = TK.chat_budget(chats, "chat", F.col("budget"), _vocab(t), ["query_id", "budget"])
    return fitted.drop("text")


@query("c05_trim_report", [], f"""WITH {_ENC_CONV}
SELECT worker, count(*) AS processed, count(*) FILTER (WHERE len(ids) > 64) AS trimmed,
       round(CAST(count(*) FILTER (WHERE len(ids) > 64) AS DOUBLE) / count(*), 6) AS ratio
FROM (SELECT CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // sz AS BIGINT) AS worker, ids
      FROM enc, (SELECT CAST(greatest(1, ceil(count(*) / 8.0)) AS BIGINT) AS sz FROM conversations) AS s) AS w
GROUP BY worker""")
def c05(spark, sf):
    t = Tables(spark, sf)
    # the index is made of the keys alone, so that texts are tokenised once
    place = dense_index(t.conversations.select(*CK), CK, "i")
    enc = TK.encode(t.conversations.select(*CK, "text"), "text", _vocab(t), keys=CK)
    rows = enc.select(*CK, AR.is_trimmed("ids", 64).alias("trim")).join(place, CK)
    share = F.greatest(F.lit(1), F.ceil(t.conversations.select(F.count(F.lit(1))).scalar() / 8))  # a scalar subquery
    rep = TK.trim_report(rows.withColumn("worker", F.floor(F.col("i") / share).cast("bigint")), "worker", "trim")
    return rep.select("worker", "processed", "trimmed", F.round("ratio", 6).alias("ratio"))


@query("c06_assign_batches", [], """
SELECT batch_id, count(*) AS n_rows FROM (
  SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) // 16 AS BIGINT) AS batch_id FROM documents) AS b
GROUP BY batch_id""")
def c06(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id")
    return TK.assign_batches(d, "doc_id", 16).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"))


_ENC_DOCS = _with(_VOCAB_CTE, _enc_cte("enc", "documents", ["doc_id"], "text"))


@query("c07_pad_batch", [], f"""WITH {_ENC_DOCS}
SELECT doc_id, batch_id, {_s(f'list_concat(ids, list_resize([]::BIGINT[], m - len(ids), {_PAD}))')} AS input_ids,
       {_s('list_concat(list_resize([]::BIGINT[], len(ids), 1), list_resize([]::BIGINT[], m - len(ids), 0))')} AS attention_mask
FROM (SELECT doc_id, batch_id, ids, max(len(ids)) OVER (PARTITION BY batch_id) AS m FROM (
        SELECT doc_id, ids,
               CAST((row_number() OVER (ORDER BY doc_id) - 1) // 16 AS BIGINT) AS batch_id FROM enc) AS a) AS b""")
def c07(spark, sf):
    t = Tables(spark, sf)
    # keys and numbers of tokens alone are sorted into batches; each text is exchanged once, and its ids not at all
    place = TK.assign_batches(t.documents.select("doc_id"), "doc_id", 16).select("doc_id", "batch_id")
    sizes = t.documents.groupBy("doc_id").agg(F.sum(F.coalesce(F.size(TK.tokenize("text")), F.lit(0))).alias("n"))
    place = TK.batch_longest(place.join(sizes, "doc_id"), "n").drop("n")
    enc = TK.encode(t.documents.select("doc_id", "text"), "text", _vocab(t), keys=["doc_id"], carry=[], beside=place)
    padded = TK.pad_batch(enc, "ids", longest="longest")
    return padded.select("doc_id", "batch_id", AR.ids_to_text("ids").alias("input_ids"),
                         AR.ids_to_text("attention_mask").alias("attention_mask"))


@query("c08_pad_fixed", [], f"""WITH {_ENC_CONV}
SELECT conv_id, turn, {_s(f'list_concat(list_slice(ids, 1, 512), list_resize([]::BIGINT[], 512 - len(list_slice(ids, 1, 512)), {_PAD}))')} AS ids
FROM enc""")
def c08(spark, sf):
    t = Tables(spark, sf)
    enc = TK.encode(t.conversations, "text", _vocab(t), keys=CK)
    return enc.select("conv_id", "turn", AR.ids_to_text(AR.pad_fixed("ids", 512, TK.PAD_ID)).alias("ids"))


def _pairs_enc(t: Tables):
    vocab = _vocab(t)
    # each query is encoded once, then attached to its drafts by id
    q = TK.encode(t.fx_queries.select("query_id", "query"), "query", vocab, "p", keys=["query_id"])
    d = TK.encode(t.fx_drafts, "draft", vocab, "t", keys=["query_id", "model_id", "level"])
    return d.join(q.select("query_id", "p"), "query_id")


def _pairs_sql(select: str) -> str:
    enc_q = _enc_cte("encq", "fx_queries", ["query_id"], "query")
    enc_d = _enc_cte("encd", "fx_drafts", ["query_id", "model_id", "level"], "draft")
    return f""", {_with(_VOCAB_CTE, enc_q, enc_d)},
pairs AS (SELECT d.query_id, d.model_id, d.level, q.ids AS p, d.ids AS t FROM encd d JOIN encq q USING (query_id))
{select}"""


def _tail(a: str, n: int) -> str:
    return f"list_slice({a}, greatest(len({a}) - {n} + 1, 1), len({a}))"


_C9_IDS = f"list_concat(list_concat([{_BOS}::BIGINT], p), list_concat(t, [{_EOS}::BIGINT]))"
_C9_LAB = (f"list_concat(list_concat([{_BOS}::BIGINT], list_resize([]::BIGINT[], len(p), {_IGNORE})), "
           f"list_concat(t, [{_EOS}::BIGINT]))")


def _fit(a: str, n: int, fill: int) -> str:
    return f"list_concat({_tail(a, n)}, list_resize([]::BIGINT[], greatest({n} - len({a}), 0), {fill}))"


@query("c09_mask_labels", ["fx_queries", "fx_drafts"], _pairs_sql(f"""
SELECT query_id, model_id, level, {_s(_fit(_C9_IDS, 48, _PAD))} AS input_ids, {_s(_fit(_C9_LAB, 48, _IGNORE))} AS labels,
       {_s(_fit(f'list_resize([]::BIGINT[], len({_C9_IDS}), 1)', 48, 0))} AS attention_mask
FROM pairs"""))
def c09(spark, sf):
    p = _pairs_enc(Tables(spark, sf))
    ex = TK.mask_labels("p", "t", 48)
    return p.select("query_id", "model_id", "level", ex.alias("ex")).select(
        "query_id", "model_id", "level", AR.ids_to_text("ex.input_ids").alias("input_ids"),
        AR.ids_to_text("ex.labels").alias("labels"), AR.ids_to_text("ex.attention_mask").alias("attention_mask"))


# A generated sequence as a model returns it: the prompt, padded on the left to a length of 12 (longer prompts keep their
# last 12 ids), then the draft, whose first four ids are followed by an end mark and the rest (which C11 counts, too).
_PROMPT = f"list_concat(list_resize([]::BIGINT[], greatest(12 - len(p), 0), {_PAD}), {_tail('p', 12)})"
_REPLY = f"list_concat(list_concat(list_slice(t, 1, 4), [{_EOS}::BIGINT]), list_slice(t, 5, len(t)))"
_SEQ = f"list_concat({_PROMPT}, {_REPLY})"


def _generated(t: Tables):
    p = _pairs_enc(t)
    prompt = AR.pad_ids(AR.truncate_ids("p", 12, "tail"), 12, TK.PAD_ID, "left")
    eos = F.array(F.lit(TK.EOS_ID).cast("bigint"))
    reply = F.concat(AR.truncate_ids("t", 4, "head"), eos, F.slice("t", 5, F.greatest(F.size("t"), F.lit(0))))
    return p.select("query_id", "model_id", "level", F.concat(prompt, reply).alias("seq"))


@query("c10_strip_prompt_ids", ["fx_queries", "fx_drafts"], _pairs_sql(f"""
SELECT query_id, model_id, level, {_s(f'list_slice({_SEQ}, 13, len({_SEQ}))')} AS generated
FROM pairs"""))
def c10(spark, sf):
    g = _generated(Tables(spark, sf))
    return g.select("query_id", "model_id", "level", AR.ids_to_text(AR.strip_prompt_ids("seq", 12)).alias("generated"))


@query("c11_generated_tokens", ["fx_queries", "fx_drafts"], _pairs_sql(f"""
SELECT query_id, model_id, level, CAST(len(t) AS BIGINT) AS gen_tokens
FROM pairs"""))
def c11(spark, sf):
    g = _generated(Tables(spark, sf))
    return g.select("query_id", "model_id", "level",
                    AR.generated_tokens(AR.strip_prompt_ids("seq", 12), TK.EOS_ID).cast("bigint").alias("gen_tokens"))


_C12_ROWS = ", ".join(f"('{p}', {b}, {a}, {e}, {s}, {lg})" for p, b, a, e, s, lg in TK.STEP_PROFILES)


def _every(div: str) -> str:
    return f"CAST(CASE WHEN {div} = 0 THEN steps ELSE steps // {div} END AS BIGINT)"


@query("c12_plan_steps", [], f"""
SELECT profile, rows, steps AS steps_per_epoch, greatest({_every('eval_div')}, 1) AS eval_steps,
       {_every('save_div')} AS save_steps, {_every('log_div')} AS logging_steps
FROM (SELECT profile, eval_div, save_div, log_div, rows,
        CAST(CASE WHEN profile = 't5' THEN rows // (batch * 8) + 1 ELSE ceil(rows / (batch * accum * 8.0)) END AS BIGINT) AS steps
      FROM (VALUES {_C12_ROWS}) AS p(profile, batch, accum, eval_div, save_div, log_div),
           (SELECT count(*) AS rows FROM documents) AS r) AS x""")
def c12(spark, sf):
    return TK.plan_steps(Tables(spark, sf).documents)


MERGES = 12


def _merge_steps() -> str:
    """The oracle's rounds one after the other, every pair counted anew in each."""
    out = [f"""w1 AS MATERIALIZED (SELECT n, ' ' || array_to_string(list_concat(string_split(word, ''), ['</w>']), '  ') || ' ' AS seg
  FROM (SELECT word, count(*) AS n FROM (SELECT unnest({_toks('text')}) AS word FROM conversations) AS u GROUP BY word) AS c)"""]
    for i in range(1, MERGES + 1):
        out.append(f"""m{i} AS MATERIALIZED (SELECT CAST({i} AS BIGINT) AS rank, x.a AS "left", x.b AS "right", CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, unnest(list_transform(range(1, len(s)), lambda j: {{'a': s[j], 'b': s[j + 1]}})) AS x FROM (SELECT n, string_split(trim(seg), '  ') AS s FROM w{i}) AS q) AS r
  GROUP BY x.a, x.b ORDER BY 4 DESC, 2, 3 LIMIT 1)""")
        out.append(f"""w{i + 1} AS MATERIALIZED (SELECT w.n, replace(seg, ' ' || m."left" || '  ' || m."right" || ' ', ' ' || m."left" || m."right" || ' ') AS seg FROM w{i} AS w, m{i} AS m)""")
    return "WITH " + ",\n".join(out) + "\n" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(1, MERGES + 1))


@query("c13_learn_merges", [], _merge_steps())
def c13(spark, sf):
    return SW.learn_merges(Tables(spark, sf).conversations, "text", MERGES)
