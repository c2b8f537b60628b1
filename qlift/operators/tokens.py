"""Token arrays and training-set preparation.

Sub-word tokenizers are not rebuilt; a word-level vocabulary is a corpus job:

* ``build_vocab`` counts tokens with a partial (map-side) aggregate, so a hot token is
  pre-summed per task before the shuffle, and ranks them with ``dense_index``.  Every token
  is kept unless the caller asks for ``max_size``.
* ``encode`` deals the rows into parts of some ``PART`` bytes of text, exchanged once.  The
  ``HEAD`` most frequent tokens (ids are dense, so their number is proven) are known in every
  task.  Of the other tokens each different one of a part travels once, as a row of its own, to
  its vocabulary entry (an exact equi-join by shuffle), and its id alone travels back to the part.
* ``decode`` explodes ids with their position, looks them up by an exact equi-join (the head by a
  broadcast join: these are the hot keys; the rest by shuffle, where ids found already travel
  under a key of their own, so no key is hot and nothing is replicated) and puts the tokens back
  in order per row (a group holds one row's tokens only).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.arrays import IGNORE_INDEX
from ..functions.text import WS, _c
from ..session import ship_package
from .ordering import dense_index

# Special tokens, in id order.
BOS, EOS, PAD, UNK = "<s>", "</s>", "<pad>", "<unk>"
SPECIALS = [BOS, EOS, PAD, UNK, "<"]
BOS_ID, EOS_ID, PAD_ID, UNK_ID = 0, 1, 2, 3

# Entries of the vocabulary (the most frequent ones) that are shipped to every task.
HEAD = 10_000

# Bytes of text that are encoded together.
PART = 8 << 20


def tokenize(c) -> Column:
    """Lower-cased words split on (Python-style) whitespace runs, no empty tokens: the same
    tokens as splitting the normalised text on single spaces, in one regex pass."""
    return F.filter(F.split(F.lower(_c(c)), "(?U)" + WS + "+", -1), lambda t: t != "")


def _specials(spark) -> DataFrame:
    rows = [(t, i) for i, t in enumerate(SPECIALS)]
    return spark.createDataFrame(rows, "token string, id bigint").withColumn("n", F.lit(None).cast("bigint"))


def build_vocab(df: DataFrame, col: str, max_size: int | None = None) -> DataFrame:
    """Specials first, then corpus tokens by (count desc, token); ``id`` is dense."""
    # explode() would put a filter on the array's size before itself, and cut the words once more for it
    counts = (df.select(F.explode_outer(tokenize(col)).alias("token")).where("token IS NOT NULL")
              .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
              .filter(~F.col("token").isin(*SPECIALS)))
    ranked = dense_index(counts, ["-n", "token"], "rank")
    if max_size is not None:
        ranked = ranked.filter(F.col("rank") < F.lit(max(max_size - len(SPECIALS), 0)))
    corpus = ranked.select("token", (F.col("rank") + len(SPECIALS)).cast("bigint").alias("id"), "n")
    return _specials(df.sparkSession).unionByName(corpus)


def looked_up(items: DataFrame, vocab: DataFrame, on: str, value: str, keys: list[str]) -> DataFrame:
    """Items with the vocabulary's ``value`` for their ``on`` (null if it has none)."""
    head = vocab.filter(F.col("id") < HEAD).select(F.col(on).alias("_qx_on"), F.col(value).alias("_qx_head"))
    tail = vocab.filter(F.col("id") >= HEAD).select(F.col(on).cast("string").alias("_qx_key"), F.col(value).alias("_qx_tail"))
    found = items.join(F.broadcast(head), F.col(on) == F.col("_qx_on"), "left")
    own = F.concat(F.lit("\x00"), F.xxhash64(*keys, "pos").cast("string"))  # no token holds a NUL
    settled = F.col("_qx_head").isNotNull() | F.col(on).isNull()
    found = found.withColumn("_qx_key", F.when(settled, own).otherwise(F.col(on).cast("string")))
    # by hash: the items (one row a token) need no sort; a task holds its share of the vocabulary, whose keys are unique
    return (found.join(tail.hint("shuffle_hash"), "_qx_key", "left").withColumn(value, F.coalesce("_qx_head", "_qx_tail"))
            .drop("_qx_on", "_qx_key", "_qx_head", "_qx_tail"))


def _regroup(pieces: DataFrame, keys: list[str], kept: list[str], value: Column, out_col: str, elem) -> DataFrame:
    """Put exploded pieces back in position order per row (one row's pieces per group); the
    row's other columns ride on its first piece and come back with the same aggregate."""
    carried = [F.first(c, ignorenulls=True).alias(c) for c in kept]
    # the look-up has spread a row's pieces, so nothing is gained by collecting before the exchange: one sort, and plain rows travel
    pieces = pieces.select(*keys, *kept, "pos", value.alias("_qx_value")).repartition(*keys)
    value = F.col("_qx_value")
    return (pieces.groupBy(*keys)
            .agg(*carried, F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", value.alias("v")))))
                 .alias("_qx_p"))
            .withColumn(out_col, F.transform("_qx_p", lambda x: x["v"].cast(elem))).drop("_qx_p"))


def _pieces(df: DataFrame, keys: list[str], kept: list[str], items: Column, name: str) -> DataFrame:
    """One row per item; the other columns only on the first (an empty row keeps one piece)."""
    out = df.select(*keys, *kept, F.posexplode_outer(items).alias("pos", name))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    return out.select(*keys, *[F.when(first, F.col(c)).alias(c) for c in kept], "pos", name)


class _Numbers(dict):
    """Numbers its keys as they are asked for."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _one_per_key(names: list[tuple], ids: list[np.ndarray], columns: list[pa.ChunkedArray]) -> tuple:
    """Rows that share a key as one: ids in the order of position, then id; of each column the first value that is not null."""
    of: dict = {}
    for i, name in enumerate(names):
        of.setdefault(name, []).append(i)
    merged = []
    for some in of.values():
        flat, place = np.concatenate([ids[i] for i in some]), np.concatenate([np.arange(len(ids[i])) for i in some])
        merged.append(flat[np.lexsort((flat, place))])
    valid = [c.is_valid().to_pylist() for c in columns]
    columns = [c.take([next((i for i in some if v[i]), some[0]) for some in of.values()]) for c, v in zip(columns, valid)]
    return [*of], merged, columns


def encode(df: DataFrame, text_col: str, vocab: DataFrame, out_col: str = "ids", keys: list[str] | None = None, carry: list[str] | None = None,
           beside: DataFrame | None = None) -> DataFrame:
    """Text to an id array (unknown -> ``UNK_ID``), token order kept.  ``keys`` must be unique.

    ``carry``: the columns that are kept (all).  ``beside``: a table of ``keys`` and further columns that is joined on the keys, without
    another exchange of the rows."""
    if not keys:
        raise ValueError("encode needs unique row keys")
    spark = df.sparkSession
    ship_package(spark)
    carry = [c for c in df.columns if c not in (*keys, out_col)] if carry is None else carry
    joined = beside is not None
    more = [c for c in beside.columns if c not in keys] if joined else []
    head = {r[0]: r[1] for r in vocab.where(F.col("id") < HEAD).select("token", F.col("id").cast("bigint")).collect()}
    # the words of tokenize(): lower case by Spark, cut by str.split, which knows the same white space
    size = df.select(F.sum(F.octet_length(F.col(text_col).cast("string")))).scalar()
    parts = F.greatest(F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))), F.ceil(size / PART))

    def part(of: DataFrame):
        return F.pmod(F.xxhash64(*[F.col(k).cast(df.schema[k].dataType) for k in keys]), parts).alias("_qx_part")

    rows = df.select(part(df), *dict.fromkeys([*keys, *carry, text_col])).repartition("_qx_part")
    rows = rows.select("_qx_part", *keys, *carry, F.lower(text_col).alias("_qx_text")).groupBy("_qx_part")

    def wanted(key, rows):
        words: set = set()
        for t in rows["_qx_text"].to_pylist():
            words.update((t or "").split())
        words = sorted(words - head.keys())
        at = pa.array(np.arange(len(words), dtype=np.int32))
        return pa.table({"_qx_part": pa.repeat(key[0], len(words)), "_qx_at": at, "_qx_token": pa.array(words, pa.string())})

    wants = rows.applyInArrow(wanted, "_qx_part long, _qx_at int, _qx_token string")
    # by hash: the tokens need no sort; a task holds its share of the vocabulary, whose keys are unique
    tail = vocab.where(F.col("id") >= HEAD).select(F.col("token").alias("_qx_token"), F.col("id").cast("bigint").alias("_qx_id"))
    found = wants.join(tail.hint("shuffle_hash"), "_qx_token").select("_qx_part", "_qx_at", "_qx_id")
    if joined:
        found = found.unionByName(beside.select(part(beside), *[F.col(k).cast(df.schema[k].dataType).alias(k) for k in keys], *more), allowMissingColumns=True)

    def encoded(rows, found):
        numbers = _Numbers()
        ids = [np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)) for w in ((t or "").split() for t in rows["_qx_text"].to_pylist())]
        rest = sorted(w for w in numbers if w not in head)
        looked = found.filter(pc.is_valid(found["_qx_at"]))
        of_rest = np.full(len(rest), UNK_ID, np.int64)
        of_rest[looked["_qx_at"].to_numpy()] = looked["_qx_id"].to_numpy()
        known = dict(zip(rest, of_rest.tolist())) | head
        of_word = np.array([known[w] for w in numbers], np.int64)
        ids = [of_word[i] for i in ids]
        columns = [rows[c] for c in (*keys, *carry)]
        names = [*zip(*[c.to_pylist() for c in columns[:len(keys)]])]
        if len(set(names)) < len(names):
            names, ids, columns = _one_per_key(names, ids, columns)
        added = []
        if joined:
            other = found.filter(pc.is_null(found["_qx_at"]))
            row = {name: i for i, name in enumerate(names) if None not in name}
            there = [row.get(name) for name in zip(*[other[k].to_pylist() for k in keys])]
            met = [i for i in there if i is not None]
            columns, ids = [c.take(pa.array(met, pa.int64())) for c in columns], [ids[i] for i in met]
            other = other.filter(pa.array([i is not None for i in there], pa.bool_()))
            added = [other[c] for c in more]
        ends = np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *ids])))
        return pa.table([*columns, lists, *added], names=[*keys, *carry, out_col, *more])

    schema = [df.schema[c] for c in (*keys, *carry)] + [StructField(out_col, ArrayType(LongType()))] + [beside.schema[c] for c in more]
    schema = StructType([StructField(f.name, f.dataType) for f in schema])
    return rows.cogroup(found.groupBy("_qx_part")).applyInArrow(encoded, schema)


def decode(df: DataFrame, ids_col: str, vocab: DataFrame, out_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Ids back to text; special ids skipped; result stripped.  ``keys`` must be unique."""
    if not keys:
        raise ValueError("decode needs unique row keys")
    kept = [c for c in df.columns if c not in (*keys, out_col)]
    ids = _pieces(df, keys, kept, F.filter(_c(ids_col), lambda i: i >= len(SPECIALS)), "id")
    joined = looked_up(ids, vocab, "id", "token", keys)
    out = _regroup(joined, keys, kept, F.col("token"), "_qx_words", "string")
    return out.withColumn(out_col, F.trim(F.array_join("_qx_words", " "))).drop("_qx_words")


def fit_parts(parts, budget) -> Column:
    """C4: how much of an array of texts the last ``budget`` tokens cover, as a struct.

    Token counts are summed from the last part backwards until the budget is spent: ``n_tokens`` in all, ``n_kept``,
    ``whole`` last parts that stay whole, ``cut`` the 0-based part that the cut falls into (null if all stay, or if it falls
    between two parts) and ``cut_kept`` its last tokens that stay.  No token may span two parts (a rendered message
    ends in white space).  A budget of 0 or less keeps nothing.
    """
    counts = F.transform(_c(parts), lambda p: F.size(tokenize(F.coalesce(p, F.lit("")))).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    total = F.aggregate(counts, zero, lambda acc, n: acc + n)
    start = F.struct(F.greatest(budget.cast("bigint"), zero).alias("left"), zero.alias("whole"), zero.alias("kept"), F.lit(True).alias("open"))

    def back(acc, n):
        fits = acc["open"] & (n <= acc["left"])
        return F.struct(F.when(fits, acc["left"] - n).otherwise(acc["left"]).alias("left"), (acc["whole"] + F.when(fits, 1).otherwise(0)).alias("whole"),
                        F.when(acc["open"] & ~fits, acc["left"]).otherwise(acc["kept"]).alias("kept"), fits.alias("open"))

    spent = F.aggregate(F.reverse(counts), start, back)
    return F.struct(
        total.alias("n_tokens"), F.least(total, F.greatest(budget.cast("bigint"), zero)).alias("n_kept"), spent["whole"].alias("whole"),
        F.when(spent["kept"] > 0, F.size(_c(parts)) - spent["whole"] - 1).cast("bigint").alias("cut"), spent["kept"].alias("cut_kept"))


def kept_text(parts, fit) -> Column:
    """C4: the tokens that ``fit_parts`` keeps, as text: the end of the cut part, then the whole parts."""
    p, f = _c(parts), _c(fit)
    words = tokenize(F.coalesce(F.get(p, f["cut"].cast("int")), F.lit("")))
    tail = F.slice(words, (F.size(words) - f["cut_kept"] + 1).cast("int"), f["cut_kept"].cast("int"))
    cut = F.when(f["cut"].isNull(), F.lit("")).otherwise(F.array_join(tail, " "))
    whole = F.slice(p, (F.size(p) - f["whole"] + 1).cast("int"), f["whole"].cast("int"))
    return F.concat_ws(" ", cut, F.array_join(whole, ""))


def chat_budget(df: DataFrame, messages: str, budget, vocab: DataFrame, keys: list[str], add_generation_prompt: bool = True) -> DataFrame:
    """C4 over B11/B12: chats rendered and trimmed to a token budget: ``keys..., text, n_tokens, n_kept, whole, cut, cut_kept,
    trimmed_text, is_trimmed``.

    A chat within its budget stays as it was rendered.  A longer one becomes the decoded last ``budget`` tokens, so the
    cut may fall inside one message; tokens unknown to ``vocab`` are lost on the way, as the ids have no name for them.
    ``is_trimmed`` compares the texts.  Only the kept tokens of longer chats pass the vocabulary joins.  ``budget`` is a
    number or a column; ``keys`` must be unique; a null message list is an empty chat.
    """
    from ..functions.templates import rendered_parts

    b = budget if isinstance(budget, Column) else F.lit(budget)
    none = F.expr("cast(array() as array<struct<role:string,content:string>>)")
    said = F.transform(F.coalesce(F.col(messages), none), lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    d = df.select(*keys, rendered_parts(said, add_generation_prompt).alias("_qx_parts"), b.alias("_qx_budget"))
    d = d.withColumn("_qx_fit", fit_parts("_qx_parts", F.col("_qx_budget")))
    fit = [F.col("_qx_fit")[n].alias(n) for n in ("n_tokens", "n_kept", "whole", "cut", "cut_kept")]
    text = F.array_join("_qx_parts", "").alias("text")
    over = F.col("_qx_fit.n_tokens") > F.greatest(F.col("_qx_budget"), F.lit(0))
    within = d.where(~over).select(*keys, text, *fit, text.alias("trimmed_text"))
    cut = d.where(over).select(*keys, text, *fit, kept_text("_qx_parts", "_qx_fit").alias("_qx_kept"))
    ids = encode(cut, "_qx_kept", vocab, "_qx_ids", keys).drop("_qx_kept")
    cut = decode(ids, "_qx_ids", vocab, "trimmed_text", keys).drop("_qx_ids")
    out = within.unionByName(cut)
    return out.withColumn("is_trimmed", F.col("trimmed_text") != F.col("text"))


def trim_report(df: DataFrame, worker_col: str, trimmed_col: str) -> DataFrame:
    """Processed, trimmed and trimmed/processed per worker (null ratio for 0 rows)."""
    return (df.groupBy(worker_col)
            .agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col(trimmed_col)).alias("trimmed"))
            .withColumn("ratio", F.try_divide(F.col("trimmed").cast("double"), F.col("processed").cast("double"))))


def assign_batches(df: DataFrame, order_by, batch_size: int, col: str = "batch_id") -> DataFrame:
    """``batch_id = idx div batch_size``; the last batch may be partial."""
    out = dense_index(df, order_by, "_qx_i")
    return (out.withColumn(col, F.expr(f"_qx_i div {int(batch_size)}"))
            .withColumn("batch_pos", (F.col("_qx_i") % F.lit(batch_size)).cast("bigint")).drop("_qx_i"))


def batch_longest(df: DataFrame, size: str, batch_col: str = "batch_id", col: str = "longest") -> DataFrame:
    """``df`` with the largest ``size`` of a row's batch."""
    return df.withColumn(col, F.max(size).over(Window.partitionBy(batch_col)))


def pad_batch(df: DataFrame, ids_col: str, batch_col: str = "batch_id", pad_id: int = PAD_ID,
              side: str = "right", longest: str | None = None) -> DataFrame:
    """Pad every row to its batch's longest row; a batch holds at most ``batch_size`` rows.  ``longest``: the column of
    ``batch_longest``, where the caller has it; the id arrays need no exchange then."""
    from ..functions.arrays import attention_mask, pad_ids

    if longest is None:
        out = batch_longest(df.withColumn("_qx_size", F.size(ids_col)), "_qx_size", batch_col, "_qx_len").drop("_qx_size")
    else:
        out = df.withColumn("_qx_len", F.col(longest)).drop(longest)
    return (out.withColumn("attention_mask", attention_mask(ids_col, F.col("_qx_len"), side))
            .withColumn(ids_col, pad_ids(ids_col, F.col("_qx_len"), pad_id, side)).drop("_qx_len"))


def mask_labels(prompt_ids, target_ids, max_len: int) -> Column:
    """struct(input_ids, labels, attention_mask) for one training example of ``max_len`` ids.

    ``[bos] + prompt + target + [eos]``; labels hide the prompt and the padding with
    ``IGNORE_INDEX`` and keep bos, target and eos; a longer example is cut to its last
    ``max_len`` ids, a shorter one is padded on the right (mask 0).
    """
    p, t = _c(prompt_ids), _c(target_ids)
    ids = F.concat(F.array(F.lit(BOS_ID).cast("bigint")), p, t, F.array(F.lit(EOS_ID).cast("bigint")))
    labels = F.concat(F.array(F.lit(BOS_ID).cast("bigint")),
                      F.array_repeat(F.lit(IGNORE_INDEX).cast("bigint"), F.size(p)), t,
                      F.array(F.lit(EOS_ID).cast("bigint")))
    mask = F.array_repeat(F.lit(1).cast("bigint"), F.size(ids))

    def fitted(a, fill):
        cut = F.slice(a, F.greatest(F.size(a) - F.lit(max_len) + 1, F.lit(1)), F.lit(max_len))
        return F.concat(cut, F.array_repeat(F.lit(fill).cast("bigint"), F.lit(max_len) - F.size(cut)))

    return F.struct(fitted(ids, PAD_ID).alias("input_ids"), fitted(labels, IGNORE_INDEX).alias("labels"),
                    fitted(mask, 0).alias("attention_mask"))


# Per-profile training cadence (batch, accumulation, eval/save/log divisors;
# 0 = "every epoch"), T5 uses rows // (batch * gpus) + 1.
STEP_PROFILES = [
    ("gpt2", 4, 2, 2, 0, 0),
    ("phi_mini", 2, 1, 2, 4, 40),
    ("llama", 8, 1, 4, 4, 40),
    ("t5", 4, 2, 0, 0, 0),
]


def plan_steps(df: DataFrame, gpus: int = 8) -> DataFrame:
    """Steps per epoch and eval/save/log cadence for every profile, from the row count."""
    spark = df.sparkSession
    prof = spark.createDataFrame(STEP_PROFILES, "profile string, batch int, accum int, eval_div int, save_div int, log_div int")
    rows = df.select(F.count(F.lit(1))).scalar()  # scalar subquery: no join with the data
    per = F.col("batch") * F.col("accum") * F.lit(gpus)
    steps = F.when(F.col("profile") == "t5", F.floor(rows / (F.col("batch") * F.lit(gpus))) + 1) \
        .otherwise(F.ceil(rows / per)).cast("bigint")

    def every(div):
        return F.when(F.col(div) == 0, F.col("steps")).otherwise(F.floor(F.col("steps") / F.col(div))).cast("bigint")

    return (prof.withColumn("rows", rows.cast("bigint")).withColumn("steps", steps)
            .select("profile", "rows", F.col("steps").alias("steps_per_epoch"),
                    F.greatest(every("eval_div"), F.lit(1)).cast("bigint").alias("eval_steps"),
                    every("save_div").alias("save_steps"), every("log_div").alias("logging_steps")))
