"""Text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions import templates as TP
from ..functions import text as TX
from .registry import DWS, dnorm, dstrip, dtrunc, query, sqlstr


@query("b01_normalize", [], f"""
SELECT conv_id, turn, {dnorm('text')} AS norm_lower_strip, {dnorm('text', lower=False)} AS norm_strip,
       {dnorm('text', lower=False, strip=False)} AS norm_plain
FROM conversations
""")
def b01(spark, sf):
    c = Tables(spark, sf).conversations
    return c.select("conv_id", "turn", TX.normalize("text").alias("norm_lower_strip"),
                    TX.normalize("text", lower=False).alias("norm_strip"),
                    TX.normalize("text", lower=False, strip=False).alias("norm_plain"))


@query("b02_truncate_tail", [], f"""
SELECT doc_id, {dtrunc('text', 40)} AS tail40, {dtrunc('text', 400)} AS tail400 FROM documents
""")
def b02(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", TX.truncate_tail("text", 40).alias("tail40"), TX.truncate_tail("text", 400).alias("tail400"))


@query("b03_drop_empty", ["fx_tsv"], f"""
SELECT query_id, split, line FROM fx_tsv WHERE line IS NOT NULL AND {dstrip('line')} <> ''
""")
def b03(spark, sf):
    t = Tables(spark, sf).fx_tsv
    return t.filter(~TX.is_blank("line"))


_B4 = {
    "gpt2": dtrunc("lower(query)", 400),
    "phi_mini_infer": dtrunc(dnorm(dtrunc("lower(query)", 400)), 200),
    "phi_mini_train": dtrunc(dnorm("query"), 200),
    "llama": dtrunc(dnorm("query", lower=False), 40),
    "phi_medium": dtrunc(dnorm("query", lower=False), 40),
    "t5": f"regexp_replace(query, '{DWS}+', ' ', 'g')",
}


@query("b04_clean_profiles", ["fx_queries"],
       "SELECT query_id, " + ", ".join(f"{v} AS {k}" for k, v in _B4.items()) + " FROM fx_queries")
def b04(spark, sf):
    q = Tables(spark, sf).fx_queries
    return q.select("query_id", *[TX.clean("query", p).alias(p) for p in TX.PROFILES])


def _b5_inputs(q):
    w = F.split(F.lower(F.col("query")), " ", -1)
    return q.select("query_id", F.col("query").alias("prefix"), F.col("query").alias("completion"),
                    F.to_json(F.array(F.col("query"))).alias("context_json"),
                    # get() gives null beyond the last word, where [] fails
                    F.to_json(F.array(*[F.coalesce(F.get(w, F.lit(i)), F.lit("")) for i in range(3)])).alias("suggestions_json"))


_B5_ITEMS = lambda lst: dtrunc(f"array_to_string(list_transform({lst}, lambda t: {dnorm('t')}), ' | ')", 40)


@query("b05_completion_context", ["fx_queries"], f"""
SELECT query_id, '### Related Searches: ' || {_B5_ITEMS("[split_part(lower(query), ' ', 1), split_part(lower(query), ' ', 2), split_part(lower(query), ' ', 3)]")}
  || ', ### Previous Query: ' || {_B5_ITEMS('[query]')}
  || ', ### Prefix: ' || {dtrunc('lower(query)', 40)}
  || ' ### Completion: ' || array_to_string(list_slice(string_split(query, ' '), 1, 3), ' ') AS context
FROM fx_queries
""")
def b05(spark, sf):
    q = _b5_inputs(Tables(spark, sf).fx_queries)
    return q.select("query_id", TX.completion_context("prefix", "context_json", "suggestions_json", "completion").alias("context"))


@query("b06_merge_prefix_suffix", ["fx_queries"], """
SELECT query_id, regexp_replace(left(query, 12), '[^ ]*$', '') || 'weather today' AS merged FROM fx_queries
""")
def b06(spark, sf):
    q = Tables(spark, sf).fx_queries
    return q.select("query_id", TX.merge_prefix_suffix(F.left("query", F.lit(12)), F.lit("weather today")).alias("merged"))


@query("b07_split_lang", ["fx_tsv"], """
SELECT query_id, CASE WHEN len(string_split(line, chr(9))) = 2 THEN string_split(line, chr(9))[1] ELSE line END AS prefix,
       CASE WHEN len(string_split(line, chr(9))) = 2 THEN string_split(line, chr(9))[2] ELSE 'en' END AS lang
FROM fx_tsv
""")
def b07(spark, sf):
    t = Tables(spark, sf).fx_tsv
    return t.select("query_id", TX.split_lang("line").alias("s")).select("query_id", "s.prefix", "s.lang")


def _draft_pairs(t: Tables):
    # drafts carry ids only; the query text is attached last (text stays out of the draft shuffle)
    return t.fx_drafts.join(t.fx_queries.select("query_id", "query"), "query_id")


_B8_SQL = "'<|startoftext|>' || q.query || ' ###> ' || d.draft || '<|endoftext|>'"


@query("b08_training_text", ["fx_queries", "fx_drafts"], f"""
SELECT d.query_id, d.model_id, d.level, {_B8_SQL} AS text
FROM fx_drafts d JOIN fx_queries q USING (query_id)
""")
def b08(spark, sf):
    p = _draft_pairs(Tables(spark, sf))
    return p.select("query_id", "model_id", "level", TX.training_text("query", "draft").alias("text"))


@query("b09_extract_after_marker", ["fx_queries", "fx_drafts"], f"""
SELECT query_id, model_id, level,
  CASE WHEN len(string_split(text, ' ###> ')) = 2 THEN regexp_replace(string_split(text, ' ###> ')[2], '{DWS}+$', '')
       ELSE '' END AS extracted
FROM (SELECT d.query_id, d.model_id, d.level, {_B8_SQL} AS text FROM fx_drafts d JOIN fx_queries q USING (query_id)) AS g
""")
def b09(spark, sf):
    p = _draft_pairs(Tables(spark, sf)).select("query_id", "model_id", "level", TX.training_text("query", "draft").alias("text"))
    return p.select("query_id", "model_id", "level", TX.extract_after_marker("text").alias("extracted"))


@query("b10_extract_by_offset", ["fx_queries", "fx_drafts"], f"""
SELECT query_id, model_id, level, substr(string_split(gen, '##query##:')[-1], ql + 3) AS extracted
FROM (SELECT d.query_id, d.model_id, d.level, length({_B4['gpt2']}) AS ql,
             '##query##: ' || {_B4['phi_mini_infer']} || chr(10) || d.draft AS gen
      FROM fx_drafts d JOIN fx_queries q USING (query_id)) AS g
""")
def b10(spark, sf):
    p = _once_per_query(Tables(spark, sf), q=TX.clean("query", "phi_mini_infer"), ql=F.length(TX.clean("query", "gpt2")))
    gen = F.concat(F.lit(TX.QUERY_MARK + " "), F.col("q"), F.lit("\n"), F.col("draft"))
    return p.select("query_id", "model_id", "level", TX.extract_by_offset(gen, F.col("ql")).alias("extracted"))


def _d_msgs(profile: str, q: str, level: str, target: str | None) -> str:
    instruction, role, ack, n_examples, reply_role, target_role = TP.CHAT_PROFILES[profile]

    def m(role, content):
        return f"{{'role': '{role}', 'content': {content}}}"

    msgs = [m(role, sqlstr(instruction))]
    if ack:
        msgs.append(m("assistant", sqlstr(ack)))
    for text, replies in TP.EXAMPLES[:n_examples]:
        listed = "[" + ", ".join(sqlstr(r) for r in replies) + "]"
        msgs += [m("user", sqlstr(f"{TX.QUERY_MARK} {text}")), m(reply_role, f"{listed}[{level}]")]
    msgs.append(m("user", f"'{TX.QUERY_MARK} ' || {q}" if n_examples else q))
    if target:
        msgs.append(m(target_role, target))
    return "[" + ", ".join(msgs) + "]"


def _once_per_query(t: Tables, **cleaned):
    """Drafts joined to columns that are worked out once per query, not once per draft."""
    return t.fx_drafts.join(t.fx_queries.select("query_id", *[c.alias(n) for n, c in cleaned.items()]), "query_id")


_B11_MSGS = _d_msgs("llama", dtrunc(dnorm("q.query", lower=False), 40), "d.level", dtrunc(dnorm("d.draft", lower=False), 80))
_B11_MINI = _d_msgs("phi_mini", dtrunc(dnorm("q.query", lower=False), 40), "d.level", None)
_B11_ANSWER = _d_msgs("phi_medium", dtrunc(dnorm("d.draft", lower=False), 80), "d.level", None)


@query("b11_chat_messages", ["fx_queries", "fx_drafts"], f"""
SELECT query_id, model_id, level, CAST(len(msgs) AS BIGINT) AS n_messages, CAST(to_json(msgs) AS VARCHAR) AS messages_json,
  CAST(to_json(mini) AS VARCHAR) AS mini_json, CAST(to_json(answer) AS VARCHAR) AS answer_json
FROM (SELECT d.query_id, d.model_id, d.level, {_B11_MSGS} AS msgs, {_B11_MINI} AS mini, {_B11_ANSWER} AS answer
      FROM fx_drafts d JOIN fx_queries q USING (query_id)) AS g
""")
def b11(spark, sf):
    p = _once_per_query(Tables(spark, sf), q=TX.clean("query", "llama"))
    p = p.withColumn("draft", TX.clean("draft", "llama", "enhanced"))
    return p.select("query_id", "model_id", "level", TP.chat_messages("q", "level", "llama", target="draft").alias("msgs"),
                    TP.chat_messages("q", "level", "phi_mini").alias("mini"), TP.chat_messages("draft", "level", "phi_medium").alias("answer")).select(
        "query_id", "model_id", "level", F.size("msgs").cast("bigint").alias("n_messages"),
        F.to_json("msgs").alias("messages_json"), F.to_json("mini").alias("mini_json"), F.to_json("answer").alias("answer_json"))


_B12_MSGS = _d_msgs("phi_mini", dtrunc(dnorm("query"), 200), "CAST(2 AS BIGINT)", None)


@query("b12_render_chat", ["fx_queries"], f"""
SELECT query_id, array_to_string(list_transform({_B12_MSGS},
         lambda m: '<|' || m.role || '|>' || chr(10) || m.content || '<|end|>' || chr(10)), '')
       || '<|assistant|>' || chr(10) AS prompt
FROM fx_queries
""")
def b12(spark, sf):
    q = Tables(spark, sf).fx_queries
    msgs = TP.chat_messages(TX.clean("query", "phi_mini_train"), F.lit(2), "phi_mini")
    return q.select("query_id", TP.render_chat(msgs, add_generation_prompt=True).alias("prompt"))


def _d_render(template: str, values: dict, json_mode: bool = True) -> str:
    out, pos = [], 0
    for m in TP.SLOT_RE.finditer(template):
        if m.start() > pos:
            out.append(sqlstr(template[pos:m.start()]))
        v = values[m.group(1)]
        out.append(f"to_json({v})" if json_mode else v)
        pos = m.end()
    if pos < len(template):
        out.append(sqlstr(template[pos:]))
    return " || ".join(out)


@query("b13_render_prompt", ["fx_queries", "fx_drafts"], f"""
SELECT d.query_id, d.model_id, d.level,
  {_d_render(TP.JUDGE_TEMPLATES['eqdq'], {'query': 'q.query', 'draft': 'd.draft'})} AS prompt_json,
  {_d_render(TP.JUDGE_TEMPLATES['eqdq'], {'query': 'q.query', 'draft': 'd.draft'}, False)} AS prompt_raw
FROM fx_drafts d JOIN fx_queries q USING (query_id)
""")
def b13(spark, sf):
    p = _draft_pairs(Tables(spark, sf))
    tpl = TP.JUDGE_TEMPLATES["eqdq"]
    vals = {"query": "query", "draft": "draft"}
    return p.select("query_id", "model_id", "level", TP.render(tpl, vals).alias("prompt_json"),
                    TP.render(tpl, vals, json_mode=False).alias("prompt_raw"))


@query("b14_extract_json_field", ["fx_aue"], """
SELECT query_id, model_id, level,
  """ + ", ".join(f"""CASE WHEN json_valid(raw) AND json_type(raw, '$.{f}') = 'VARCHAR' THEN json_extract_string(raw, '$.{f}') END AS {f}"""
                  for f in ("explanation", "comprehension_score", "enhanced_query", "final_enhanced_query")) + """
FROM fx_aue
""")
def b14(spark, sf):
    a = Tables(spark, sf).fx_aue
    return a.select("query_id", "model_id", "level", TX.json_field("raw", "explanation").alias("explanation"),
                    TX.json_field("raw", "comprehension_score").alias("comprehension_score"),
                    TX.json_field("raw", "enhanced_query").alias("enhanced_query"),
                    TX.json_field("raw", "final_enhanced_query").alias("final_enhanced_query"))
