"""Batch inference jobs (H1-H4).

The model is a user callable ``list[str] -> list[str]`` made by a factory once per Python
worker (one model is held).  Rows reach Python in Arrow batches (``mapInPandas``), whose size has nothing to do with the
model's: rows are carried over from one Arrow batch to the next until a window of ``WINDOW`` model batches is full, so a
partition (and, in a sweep, a checkpoint of it) ends in one partial batch at most.  Inside a window rows are batched by
length, which keeps the padding of a batch short; the outputs go back to the rows' own order.  ``BatchStats`` counts
calls and padding where the caller asks for it.
Everything around the call (cleaning, prompt rendering, anti-joins, reports) stays in
JVM-side columns; only the call itself is Python.  Results never depend on partitioning:
one output per input is enforced for every batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean
from ..session import ship_package

_HELD: dict[bytes, Callable] = {}  # the worker's one model, by the content of its factory and tag


class OutputMismatch(RuntimeError):
    pass


def model_key(factory: Callable, tag: str | None) -> bytes:
    """What tells two models apart: the pickled factory (code and closure values) and the tag."""
    return hashlib.sha256(cloudpickle.dumps((factory, tag))).digest()


def _model(key: bytes, factory: Callable, tag: str | None) -> Callable:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = factory(tag)
    return _HELD[key]


WINDOW = 64  # model batches whose rows are batched by length together


class BatchStats:
    """Counts of model calls, summed over all tasks by accumulators (a task that is run again counts again).

    ``calls`` and of these ``partial`` ones; ``texts`` in and their ``words``; ``padded``: words that filling every batch to its longest
    text adds, and ``padded_in_order``: what it would add had the rows been batched in their own order.
    """

    FIELDS = ("calls", "partial", "texts", "words", "padded", "padded_in_order")

    def __init__(self, spark):
        self._sums = {f: spark.sparkContext.accumulator(0) for f in self.FIELDS}

    def add(self, **counts: int) -> None:
        for f, n in counts.items():
            self._sums[f].add(n)

    def report(self) -> dict[str, int]:
        return {f: a.value for f, a in self._sums.items()}


def _padding(lengths: list[int], size: int) -> int:
    batches = [lengths[i:i + size] for i in range(0, len(lengths), size)]
    return sum(max(b) * len(b) - sum(b) for b in batches)


def _called(model: Callable, texts: list, batch_size: int, stats: BatchStats | None) -> list:
    """The model's outputs for the texts in their order; batches are cut from the texts by length (ties: in order)."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
    out: list = [None] * len(texts)
    for n, i in enumerate(range(0, len(order), batch_size)):
        at = order[i:i + batch_size]
        res = list(model([texts[j] for j in at]))
        if len(res) != len(at):
            raise OutputMismatch(f"model call {n}: {len(at)} texts went in, {len(res)} came back")
        for j, r in zip(at, res):
            out[j] = r
    if stats is not None:
        words = [len((t or "").split()) for t in texts]
        stats.add(calls=-(-len(texts) // batch_size), partial=int(len(texts) % batch_size > 0), texts=len(texts), words=sum(words),
                  padded=_padding([words[i] for i in order], batch_size), padded_in_order=_padding(words, batch_size))
    return out


def _runs(pdf: pd.DataFrame, tag_col: str | None) -> Iterator[tuple]:
    """Neighbouring rows of one tag."""
    if tag_col is None or not len(pdf):
        yield None, pdf
        return
    tags = pdf[tag_col]
    for _, part in pdf.groupby((tags != tags.shift()).cumsum(), sort=False):
        yield part[tag_col].iloc[0], part


def in_batches(frames: Iterator[pd.DataFrame], model_of: Callable, text_col: str, out_col: str, batch_size: int, tag_col: str | None = None,
               window: int = WINDOW, stats: BatchStats | None = None) -> Iterator[pd.DataFrame]:
    """The frames' rows, in order, with the output of ``model_of(tag)`` for ``text_col``.  At most one window of rows (and one
    incoming frame) is held; a change of the tag ends a window."""
    held: list[pd.DataFrame] = []
    rows, tag = 0, None
    full = window * batch_size

    def flush(n: int) -> pd.DataFrame:
        nonlocal held, rows
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        now, rest = whole.iloc[:n].copy(), whole.iloc[n:]
        held, rows = ([rest] if len(rest) else []), len(rest)
        now[out_col] = pd.Series(_called(model_of(tag), now[text_col].tolist(), batch_size, stats), index=now.index, dtype=object)
        return now

    for frame in frames:
        for t, part in _runs(frame, tag_col):
            if not len(part):
                continue
            if rows and t != tag:
                yield flush(rows)
            tag = t
            held.append(part)
            rows += len(part)
            while rows >= full:
                yield flush(full)
    if rows:
        yield flush(rows)


def generate(df: DataFrame, factory: Callable, batch_size: int = 16, profile: str = "gpt2",
             text_col: str = "query", keep: tuple[str, ...] = ("query_id",), tag_col: str | None = None,
             window: int = WINDOW, stats: BatchStats | None = None) -> DataFrame:
    """H1: clean per profile, call the model in batches, emit ``(keep..., query, enhanced_query)``.

    With ``tag_col`` (H3) neighbouring rows of one tag are batched together and each tag uses its own model
    (e.g. a checkpoint); rows should come sorted by it.
    """
    ship_package(df.sparkSession)
    cols = list(keep) + ([tag_col] if tag_col else [])
    cleaned = df.select(*cols, clean(text_col, profile).alias("query"))
    schema = T.StructType(list(cleaned.schema.fields) + [T.StructField("enhanced_query", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def model_of(tag):
            return _model(model_key(factory, tag), factory, tag)

        return in_batches(frames, model_of, "query", "enhanced_query", batch_size, tag_col, window, stats)

    return cleaned.mapInPandas(run, schema)


def respond(df: DataFrame, factory: Callable, text_col: str = "draft", batch_size: int = 12,
            profile: str = "phi_medium", window: int = WINDOW, stats: BatchStats | None = None) -> DataFrame:
    """H2: keep every input column, add ``response`` and ``gen_tokens`` (whitespace tokens of it)."""
    ship_package(df.sparkSession)
    prompt = "_qx_prompt"
    src = df.withColumn(prompt, clean(text_col, profile))
    schema = T.StructType(list(df.schema.fields) + [T.StructField("response", T.StringType()),
                                                    T.StructField("gen_tokens", T.LongType())])
    key = model_key(factory, None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(key, factory, None)
        for pdf in in_batches(frames, lambda tag: model, prompt, "response", batch_size, None, window, stats):
            pdf = pdf.drop(columns=[prompt])
            pdf["gen_tokens"] = [None if r is None else len(r.split()) for r in pdf["response"]]
            yield pdf

    return src.mapInPandas(run, schema)


ROWS_PER_TASK = 20_000


def sweep(df: DataFrame, checkpoints: list[str], done: DataFrame, factory: Callable,
          key: str = "query_id", batch_size: int = 16, profile: str = "gpt2", text_col: str = "query",
          rows_per_task: int = ROWS_PER_TASK, stats: BatchStats | None = None) -> DataFrame:
    """H3: every checkpoint x every input, minus finished pairs, one result set per checkpoint.

    The checkpoint list is a literal array exploded per row (bounded by the list), the
    finished pairs are removed with a ``left_anti`` join before any model call.  The work of a checkpoint is
    spread over as many tasks as its counted rows need at ``rows_per_task``, whatever their number.
    """
    work = df.withColumn("checkpoint", F.explode(F.array(*[F.lit(c) for c in checkpoints])))
    todo = work.join(done.select("checkpoint", key), ["checkpoint", key], "left_anti")
    spread = max(1, -(-df.count() // rows_per_task))
    # rows of one checkpoint come together, so a worker loads each checkpoint once per partition
    todo = (todo.repartition(spread * max(1, len(checkpoints)), F.col("checkpoint"), F.pmod(F.xxhash64(key), F.lit(spread)))
            .sortWithinPartitions("checkpoint"))
    return generate(todo, factory, batch_size, profile, text_col, keep=(key,), tag_col="checkpoint", stats=stats)


def run_summary(df: DataFrame, worker_col: str, ts_col: str, trimmed) -> DataFrame:
    """H4: rows, trimmed, ratio and elapsed ``hh:mm:ss.ss`` per worker and overall (rollup)."""
    us = F.expr(f"timestampdiff(MICROSECOND, min({ts_col}), max({ts_col}))")
    g = (df.rollup(worker_col)
         .agg(F.count(F.lit(1)).alias("rows"), F.count_if(trimmed).alias("trimmed"), us.alias("_qx_us"))
         .withColumn(worker_col, F.coalesce(F.col(worker_col), F.lit("all"))))
    sec = F.col("_qx_us") / F.lit(1e6)
    elapsed = F.format_string("%02d:%02d:%05.2f", F.floor(sec / 3600).cast("int"),
                              F.floor((sec % 3600) / 60).cast("int"), sec % 60)
    return g.select(worker_col, "rows", "trimmed",
                    F.round(F.try_divide(F.col("trimmed").cast("double"), F.col("rows").cast("double")), 6).alias("ratio"),
                    elapsed.alias("elapsed"))
