r"""Ranked lexical search by the Best Position Algorithm.

``search`` ranks all documents for each query by ``sum of w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` over the query's
different terms (see ``impacts``; 64-bit integers, the weight ``w`` of a term is worked out in doubles).

One pass over the texts counts terms and writes, per document, its length and the counts of those terms that some query
holds (the text goes no further).  The collection's counts (documents, terms, documents per query term) are summed by
Spark.  Then every task cuts its documents into blocks and keeps per term of a block an impact list: the documents by
falling impact.  A query walks its lists side by side, some positions of each at a time (sorted access); a document met
for the first time is looked up in all of the query's lists (direct access), which gives its score and marks its
positions there as seen.  The best position of a list is the last one before which all are seen.  A document not met yet
stands behind the best position of each list, so its score is at most the sum of the weighted impacts that come next; the
walk ends once this bound is strictly below the k-th score (an equal score could still win by its id).  The k best of
earlier blocks go on as the start of the next one, so that later blocks often end before their first access.

At scale: documents are not shuffled; a task sends k rows per query, cut to k in salted groups and then per query.  Queries
are taken in blocks of about ``QUERY_BYTES`` of text (by a hash, one pass over the documents each), so what is broadcast
is bounded; a document block holds at most ``BLOCK`` counts (or one document).

Edge cases: a null or empty text has no terms and is never found; a document counts by its row, so repeated rows are
found as often as they stand; equal scores go by ascending ``doc_id``, null ids last; a query without terms, or whose
terms no document holds, gives no row; rows of one ``item_id`` (null included) are one query with the terms of all; an
empty table on either side gives an empty result; other columns of the caller are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, prepare, saved, text_column

QUERY_BYTES = 2 << 20
BLOCK = 1 << 20
STRIDE = 32
SALTS = 64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all that is not ASCII, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf, n, n_docs: int, n_terms: int):
    """Impact of a term with ``tf`` occurrences in a document of ``n`` terms (arrays of 64-bit integers)."""
    m = 10 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """The k best documents so far: by score, then by id (null last)."""

    def __init__(self, k: int):
        import numpy as np

        self.k = k
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores, ids, null) -> None:
        import numpy as np

        keep = scores > 0
        if len(self.scores) == self.k:
            keep &= scores >= self.scores[-1]
        if not keep.any():
            return
        s, i, u = (np.concatenate([a, b[keep]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((i, u, -s))[: self.k]
        self.scores, self.ids, self.null = s[order], i[order], u[order]

    def beyond(self, bound: int) -> bool:
        """Whether no document of at most this score can come in."""
        return bound <= 0 or (len(self.scores) == self.k and bound < self.scores[-1])


class Block:
    """Impact lists of a block of documents."""

    def __init__(self, ids, null, n, sizes, terms, tf, n_docs: int, n_terms: int, n_vocab: int):
        import numpy as np

        self.ids, self.null = ids, null
        self.from_ = np.concatenate([[0], np.cumsum(sizes)])  # the counts of document d: from_[d] to from_[d + 1]
        self.terms = terms
        doc = np.repeat(np.arange(len(ids)), sizes)
        self.impact = impacts(tf.astype(np.int64), n[doc], n_docs, n_terms)
        order = np.lexsort((doc, -self.impact, terms))  # all impact lists, one after the other
        self.doc_at, self.impact_at = doc[order], self.impact[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.lists = np.searchsorted(terms[order], np.arange(n_vocab + 1))

    def _counts_of(self, docs):
        """The places of all counts of these documents, document by document, and where each document's end."""
        import numpy as np

        lengths = self.from_[docs + 1] - self.from_[docs]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.from_[docs] - (ends - lengths), lengths)
        return at, ends

    def search(self, query, weights, best: Best) -> int:
        """Brings ``best`` up to date with this block; gives the number of sorted accesses."""
        import numpy as np

        held = self.lists[query + 1] > self.lists[query]
        query, weights = query[held], weights[held]
        first, end = self.lists[query], self.lists[query + 1]
        position = first.copy()  # first place of each list that is not seen
        of_term = np.zeros(len(self.lists), np.int64)
        of_term[query] = weights
        asked = np.zeros(len(self.lists), bool)
        asked[query] = True
        seen, met = np.zeros(len(self.place), bool), np.zeros(len(self.ids), bool)
        depth, step, accesses = 0, STRIDE, 0
        while True:
            open_ = position < end
            bound = int((weights[open_] * self.impact_at[position[open_]]).sum())
            if best.beyond(bound):
                return accesses
            # sorted access: the next places of each list
            rows = [self.doc_at[a + depth : min(a + depth + step, b)] for a, b in zip(first, end) if a + depth < b]
            accesses += sum(map(len, rows))
            found = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
            found = found[~met[found]]
            met[found] = True
            if len(found):
                # direct access: all counts of the new documents in the query's lists
                at, ends = self._counts_of(found)
                mine = asked[self.terms[at]]
                seen[self.place[at[mine]]] = True
                gains = np.concatenate([[0], np.cumsum(np.where(mine, of_term[self.terms[at]] * self.impact[at], 0))])
                scores = gains[ends] - gains[np.concatenate([[0], ends[:-1]])]
                best.add(scores, self.ids[found], self.null[found])
            for i in range(len(query)):
                a, b = position[i], end[i]
                while a < b and seen[a]:
                    part = seen[a : min(a + 1024, b)]
                    n = int(part.argmin())
                    a += len(part) if part[n] else n
                position[i] = a
            depth += step
            step = min(step * 2, 4096)


def count_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """``doc_id, n, terms, tfs`` per document with a term; ``vocabulary``: broadcast map of the queries' terms to numbers."""

    def count(batches):
        numbers = vocabulary.value
        known = numbers.keys()
        for b in batches:
            ids, ns, terms, tfs = [], [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                words = terms_of(t.as_py())
                if words:
                    c = Counter(words)
                    held = c.keys() & known
                    ids.append(i)
                    ns.append(len(words))
                    terms.append([numbers[w] for w in held])
                    tfs.append([c[w] for w in held])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                                             names=["doc_id", "n", "terms", "tfs"])

    d = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), text_column("`text`").alias("text"))
    return d.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def _blocks(batches, n_docs: int, n_terms: int, n_vocab: int):
    """Blocks of at most ``BLOCK`` counts from ``doc_id, n, terms, tfs``."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.list_value_length(b.column("terms")).to_pylist()
        for i, j in chunks([s + 1 for s in sizes], BLOCK):
            p = b.slice(i, j - i)
            ids = p.column("doc_id")
            yield Block(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_null(ids).to_numpy(zero_copy_only=False),
                        p.column("n").to_numpy(), np.asarray(sizes[i:j], np.int64), p.column("terms").flatten().to_numpy().astype(np.int64),
                        p.column("tfs").flatten().to_numpy(), n_docs, n_terms, n_vocab)


def _first(rows: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(docs: DataFrame, queries: dict, k: int) -> DataFrame:
    """One block of queries: ``{item_id: terms}``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*queries.values())))}
    counted = saved(count_terms(docs, sc.broadcast(vocabulary)))
    totals = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0
    # one row per term of the queries comes back
    df = {r["t"]: r["n"] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    plan = []
    for item, words in sorted(queries.items(), key=lambda q: (q[0] is None, q[0])):
        held = sorted(vocabulary[w] for w in words if vocabulary[w] in df)
        if held:
            plan.append((item, held, [weight(n_docs, df[t]) for t in held]))
    plan = sc.broadcast(plan)
    n_vocab = len(vocabulary)

    def walk(batches):
        import numpy as np

        asked = [(np.array(t, np.int64), np.array(w, np.int64), Best(k)) for _, t, w in plan.value]
        for block in _blocks(batches, n_docs, n_terms, n_vocab):
            for t, w, best in asked:
                block.search(t, w, best)
        items, ids, scores = [], [], []
        for (item, _, _), (_, _, best) in zip(plan.value, asked):
            items += [item] * len(best.scores)
            ids += [None if u else i for i, u in zip(best.ids.tolist(), best.null.tolist())]
            scores += best.scores.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (items, ids, scores)], names=["item_id", "doc_id", "score"])

    found = counted.mapInArrow(walk, "item_id long, doc_id long, score long")
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return _first(_first(found, k, "item_id", "salt").drop("rank", "salt"), k, "item_id").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents (``doc_id, text``) with a score above 0 of each item
    (``item_id, text``)."""
    prepare(docs.sparkSession)
    q = items.select(F.col("`item_id`").cast("long").alias("item_id"), text_column("`text`").alias("text"))
    size = q.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    parts = max(1, math.ceil(size / query_bytes))
    out = None
    for part in range(parts):  # a bounded number of queries at a time comes to the driver
        queries: dict = {}
        for r in q.where(F.pmod(F.xxhash64(F.lit(3), "item_id"), F.lit(parts)) == part).toLocalIterator():
            words = set(terms_of(r["text"]))
            if words:
                queries.setdefault(r["item_id"], set()).update(words)
        if queries:
            found = _search(docs, queries, k)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP11_SQL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
c AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS terms FROM d WHERE len(terms) > 0),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, c GROUP BY term, docs),
m AS (SELECT r, doc_id, 10 + (90 * len(d.terms)::BIGINT * docs) // c.terms AS m FROM d, c WHERE len(d.terms) > 0),
s AS (SELECT q.item_id, m.r, m.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m)))::BIGINT AS score
      FROM q JOIN w ON w.term = q.term JOIN t ON t.term = q.term JOIN m ON m.r = t.r GROUP BY q.item_id, m.r, m.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
