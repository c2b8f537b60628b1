r"""Conversation prefix trie: a z-fast trie over sequences of turns, kept as tables.

A conversation is the sequence of its turns ``(role, text)``.  The prefix of length d has the name ``p[d]``: a 128-bit
digest chained over the first d turns.  Compacted nodes are rows ``(up, node, low, depth, names, sums)``: the node's own
name and depth, its parent's (``up, low``), and the names and running byte counts of the prefixes on the edge between.
The hash table of the z-fast trie is the same table keyed by the *handle*, the name at the two-fattest depth of
``(low, depth]`` (the number there that is divisible by the highest power of two).

``build`` inserts the distinct sequences in batches:

1. every sequence still outside finds its exit node by fat binary search: from the deepest node ``a`` known to be its
   prefix, look up the name at the two-fattest depth of ``(a, b]``; a node found there moves ``a`` down to it if its whole
   extent is a prefix (else it is the exit node), no node moves ``b`` above that depth.  That is log2 of the longest
   length joins; if the exit node was not met itself, one look-up by the first name of an edge gives it;
2. the common part with the exit node's edge tells where the sequence leaves it.  Of all that leave at one place by the
   same next turn, the one with the least name (names are random) is the batch's; those that end on the edge need no more;
3. the places split the edges, and the batch's sequences become leaves.

The names being random, the sequences left behind one leaf halve in expectation from batch to batch, whatever their
order or depth; a group is reduced by ``min`` before it is shuffled.

Subtree sums (members, least member, leaves, saved tokens) go up by pointer doubling: in round i every node adds what the nodes
2^i levels below hold, so the rounds are logarithmic in the height.  At last the edges are expanded to one row per prefix.

At scale: texts are read once, for their digest and length; the turns of one conversation come together as digests
(24 bytes a turn).  Copies of a sequence are one row.  Both sides of the joins are exchanged by the join, so adaptive
execution can split a hot handle.  The ids that end in one node are sorted by range, joined to pieces of text in
parallel, and their pieces (not the ids) are streamed in order through the digest.

Edge cases: turns are in ascending ``turn``, null first, equal turns by digest; null role or text is empty; rows without
a conversation id belong to no conversation; repeated rows are repeated turns; an empty table has no trie (no rows);
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Stored
from .common import prepare

ROOT = bytes(16)
PIECE = 8192  # ids joined to one piece of text
MOST_BATCHES = 200
_SEQ = "member long, node binary, depth int, names array<binary>, sums array<long>"
_NODE = ("up", "node", "low", "depth", "base", "names", "sums")


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn (the role's length keeps role and text apart)."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: per conversation its turns in order (null turns first) as structs ``(turn, digest, bytes)``."""
    role, text = (F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in ("role", "text"))
    t = conversations.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"),
                             turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    t = t.where("conv_id is not null")
    return t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "bytes"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``member, node, depth, names, sums`` of every conversation rebuilt from its family's head: the first h turns of
    conversation ``c - c % 5``, then its own turns after the first h."""
    lists = Stored(conversations.sparkSession, "turns").put(turn_lists(conversations))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    own = lists.select("conv_id", h.cast("int").alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(5))).alias("head"), "turns")
    heads = lists.where(F.pmod("conv_id", F.lit(5)) == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, 8).alias("first"))
    none = F.expr("cast(array() as array<struct<turn:bigint,digest:binary,bytes:bigint>>)")
    joined = own.join(heads, "head", "left").select(
        F.col("conv_id").alias("member"),
        F.concat(F.slice(F.coalesce("first", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))
    return sequences(joined)


def sequences(lists: DataFrame) -> DataFrame:
    """``member, node, depth, names, sums`` from ``member, turns``: names and running bytes of all prefixes, ``node`` the last name."""
    d = lists.select("member", F.transform("turns", lambda t: t["digest"]).alias("digests"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))

    def chain(batches):
        for b in batches:
            nodes, depths, names, sums = [], [], [], []
            for ds, ns in zip(b.column("digests").to_pylist(), b.column("bytes").to_pylist()):
                last, total, p, s = ROOT, 0, [], []
                for digest, n in zip(ds, ns):
                    last = hashlib.blake2b(last + digest, digest_size=16).digest()
                    total += n
                    p.append(last)
                    s.append(total)
                nodes.append(last)
                depths.append(len(p))
                names.append(p)
                sums.append(s)
            yield pa.RecordBatch.from_arrays([b.column("member"), pa.array(nodes, pa.binary()), pa.array(depths, pa.int32()),
                                              pa.array(names, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64()))],
                                             names=["member", "node", "depth", "names", "sums"])

    return d.mapInArrow(chain, _SEQ)


def two_fattest(a: Column, b: Column) -> Column:
    """The number in ``(a, b]`` (``0 <= a < b``) that is divisible by the highest power of two: ``b`` without the bits
    below the highest one in which ``a`` and ``b`` differ."""
    power = F.pow(F.lit(2.0), F.length(F.bin(a.bitwiseXOR(b))) - 1)
    return (F.floor(b / power) * power).cast("int")


def handles(nodes: DataFrame) -> DataFrame:
    """The hash table: per node (but the root) the name at its handle depth."""
    f = two_fattest(F.col("low"), F.col("depth"))
    return nodes.where("depth > 0").select(F.get("names", f - F.col("low") - 1).alias("handle"), F.col("node").alias("t_node"), F.col("depth").alias("t_depth"),
                                           F.col("up").alias("t_up"), F.col("low").alias("t_low"))


def exits(outside: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """``outside`` (with ``a, at``: depth and name of a node that is a prefix) with these brought down to the deepest such
    node, the exit node's parent, by fat binary search."""
    table = handles(nodes)
    s = outside.withColumn("b", F.col("depth"))
    for _ in range(rounds):
        s = s.withColumn("f", F.when(F.col("a") < F.col("b"), two_fattest(F.col("a"), F.greatest(F.col("b"), F.col("a") + 1))))
        # what probes no more travels under its own name, so that it is spread
        s = s.withColumn("handle", F.coalesce(F.get("names", F.col("f") - 1), "node")).join(table, "handle", "left")
        met = F.col("f").isNotNull() & F.col("t_node").isNotNull()
        whole = met & F.coalesce(F.get("names", F.col("t_depth") - 1) == F.col("t_node"), F.lit(False))
        # a node whose whole extent is a prefix: go on below it; one that is left on its edge: it is the exit node
        s = s.select(
            *outside.drop("a", "at").columns,
            F.when(whole, F.col("t_depth")).when(met, F.col("t_low")).otherwise(F.col("a")).alias("a"),
            F.when(whole, F.col("t_node")).when(met, F.col("t_up")).otherwise(F.col("at")).alias("at"),
            F.when(F.col("f").isNull() | whole, F.col("b")).when(met, F.col("t_low")).otherwise(F.col("f") - 1).alias("b"))
    return s.drop("b")


def _insert(outside: DataFrame, nodes: DataFrame, rounds: int, tables: Stored) -> tuple[DataFrame, DataFrame]:
    """One batch: the nodes afterwards, and the sequences that are still outside."""
    s = exits(outside, nodes, rounds)
    edges = nodes.where("depth > 0").select(F.col("up").alias("at"), F.get("names", F.lit(0)).alias("first"), F.col("node").alias("exit"),
                                            F.col("names").alias("edge"))
    s = s.withColumn("first", F.coalesce(F.get("names", F.col("a")), "node")).join(edges, ["at", "first"], "left")
    mine = F.slice("names", F.col("a") + 1, F.size("names") + 1)
    # prefixes share their names, so the equal ones come first
    common = F.size(F.filter(F.zip_with(mine, "edge", lambda x, y: x == y), lambda equal: equal))
    s = tables.put(s.withColumn("leave", F.col("a") + F.when(F.col("exit").isNull(), 0).otherwise(common)).drop("edge", "first"))
    place = F.when(F.col("leave") > 0, F.get("names", F.col("leave") - 1)).otherwise(F.lit(ROOT))
    s = s.withColumns({"place": place, "next": F.get("names", F.col("leave"))})
    # one per place and next turn; without a next turn a sequence ends at its place
    going = s.where("next is not null")
    chosen = going.groupBy("next").agg(F.min("node").alias("node"))
    leaves = going.join(chosen, ["next", "node"], "left_semi").select(
        F.col("place").alias("up"), "node", F.col("leave").alias("low"), "depth",
        F.when(F.col("leave") > 0, F.get("sums", F.col("leave") - 1)).otherwise(F.lit(0).cast("long")).alias("base"),
        F.slice("names", F.col("leave") + 1, F.size("names")).alias("names"), F.slice("sums", F.col("leave") + 1, F.size("sums")).alias("sums"))
    cuts = s.where("exit is not null").groupBy(F.col("exit").alias("node")).agg(F.collect_set("leave").alias("cuts"))  # within an edge
    n = nodes.join(cuts, "node", "left")
    inner = F.filter(F.array_sort(F.coalesce("cuts", F.expr("cast(array() as array<int>)"))), lambda c: (c > F.col("low")) & (c < F.col("depth")))
    n = n.withColumn("bounds", F.concat(F.array("low"), inner, F.array("depth")))
    # the pieces between neighbouring bounds; the root is its only piece
    n = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("bounds") - 2)))
    lo, hi = F.get("bounds", F.col("i")), F.get("bounds", F.col("i") + 1)
    before = lo - F.col("low")
    pieces = n.select(
        F.when(before > 0, F.get("names", before - 1)).otherwise(F.col("up")).alias("up"),
        F.when(hi < F.col("depth"), F.get("names", hi - F.col("low") - 1)).otherwise(F.col("node")).alias("node"),
        lo.alias("low"), hi.alias("depth"), F.when(before > 0, F.get("sums", before - 1)).otherwise(F.col("base")).alias("base"),
        F.slice("names", before + 1, hi - lo).alias("names"), F.slice("sums", before + 1, hi - lo).alias("sums"))
    left = (going.join(chosen, ["next", "node"], "left_anti")
            .select("node", "depth", "names", "sums", F.col("leave").alias("a"), F.col("place").alias("at")))
    return tables.put(pieces.unionByName(leaves).select(*_NODE)), tables.put(left)


def build(seqs: DataFrame) -> DataFrame:
    """The compacted nodes ``up, node, low, depth, base, names, sums`` of the distinct sequences ``node, depth, names, sums``."""
    tables = Stored(seqs.sparkSession, "trie")
    nodes = seqs.sparkSession.range(1).select(
        F.lit(ROOT).alias("up"), F.lit(ROOT).alias("node"), F.lit(0).alias("low"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("base"),
        F.expr("cast(array() as array<binary>)").alias("names"), F.expr("cast(array() as array<bigint>)").alias("sums"))
    outside = tables.put(seqs.where("depth > 0").dropDuplicates(["node"]).select("node", "depth", "names", "sums", F.lit(0).alias("a"), F.lit(ROOT).alias("at")))
    for batch in range(MOST_BATCHES):
        state = outside.agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
        if not state["n"]:
            return nodes
        # the first batch meets the root alone
        nodes, outside = _insert(outside, nodes, state["d"].bit_length() + 1 if batch else 0, tables)
        tables.forget(2)
    raise RuntimeError(f"sequences are left after {MOST_BATCHES} batches")


def subtree(nodes: DataFrame, sums: list[str], least: list[str] = ()) -> DataFrame:
    """``nodes`` (``node, up`` and the value columns) with every value summed (or reduced to its least) over the subtree."""
    values = [*sums, *least]
    tables = Stored(nodes.sparkSession, "trie")
    s = nodes.select("node", F.when(F.col("node") != F.lit(ROOT), F.col("up")).alias("jump"), *values)
    while True:
        s = tables.put(s)
        tables.forget(1)
        climbing = s.where("jump is not null")
        if not climbing.take(1):
            return s.drop("jump")
        below = climbing.groupBy("jump").agg(*[F.sum(v).alias(f"b_{v}") for v in sums], *[F.min(v).alias(f"b_{v}") for v in least])
        s = (s.join(below.withColumnRenamed("jump", "node"), "node", "left")
             .select("node", "jump", *[(F.col(v) + F.coalesce(f"b_{v}", F.lit(0))).alias(v) for v in sums],
                     *[F.least(v, f"b_{v}").alias(v) for v in least]))
        # the next jump is twice as far; what has reached the root goes beside the join
        far = climbing.select(F.col("node").alias("jump"), F.col("jump").alias("further"))
        on = s.where("jump is not null").join(far, "jump", "left").select("node", F.col("further").alias("jump"), *values)
        s = on.unionByName(s.where("jump is null"))


def _ends(seqs: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of every node where members end: the digest of their ids, ascending, comma-joined."""
    ids = seqs.select("node", "member").repartitionByRange(F.col("node"), F.col("member")).sortWithinPartitions("node", "member")

    def join(batches):
        node, held = None, []

        def piece():
            return {"node": node, "first": held[0], "ids": ",".join(map(str, held))}

        for b in batches:
            out = []
            for n, m in zip(b.column("node").to_pylist(), b.column("member").to_pylist()):
                if held and (n != node or len(held) == PIECE):
                    out.append(piece())
                    held = []
                node = n
                held.append(m)
            yield pa.RecordBatch.from_pylist(out, schema=piece_schema)
        if held:
            yield pa.RecordBatch.from_pylist([piece()], schema=piece_schema)

    def digest(batches):
        node, sha = None, None
        for b in batches:
            out = []
            for n, t in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if n == node:
                    sha.update(b",")
                else:
                    if sha is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256()
                sha.update(t.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], names=["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    piece_schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    pieces = ids.mapInArrow(join, "node binary, first long, ids string")
    return pieces.repartition(F.col("node")).sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def trie(seqs: DataFrame) -> DataFrame:
    """The trie of the sequences (see ``sequences``), one row per distinct prefix: ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``."""
    prepare(seqs.sparkSession)
    put = Stored(seqs.sparkSession, "trie").put
    seqs = put(seqs)
    nodes = build(seqs)
    own = seqs.groupBy("node").agg(F.count("*").alias("n_convs"), F.min("member").alias("conv_id"))
    kids = nodes.where("depth > 0").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    n = (nodes.join(own, "node", "left").join(kids, "node", "left")
         .withColumns({"n_convs": F.coalesce("n_convs", F.lit(0).cast("long")), "n_children": F.coalesce("n_children", F.lit(0).cast("long"))}))
    n = n.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    kept = ("node", "up", "low", "depth", "base", "sums", "n_children")
    n = put(n.select(*kept, "n_convs", "conv_id", "n_leaves"))
    counted = subtree(n, ["n_convs", "n_leaves"], ["conv_id"])
    n = n.select(*kept).join(counted, "node")
    # an edge saves its bytes for every member but one
    n = n.withColumn("edge_saved", (F.col("n_convs") - 1) * (F.coalesce(F.get("sums", F.size("sums") - 1), "base") - F.col("base")))
    n = put(n)
    below = subtree(n.select("node", "up", F.col("edge_saved").alias("saved")), ["saved"])
    parents = n.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv_id"))
    n = n.join(below, "node").join(parents, "up").join(_ends(seqs), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    # one row per prefix on the edge; the root has no edge and stands for itself
    n = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.size("sums") - 1, F.lit(0)))))
    d = F.when(F.col("depth") == 0, 0).otherwise(F.col("low") + 1 + F.col("i"))
    last = d == F.col("depth")
    before = F.when(F.col("i") > 0, F.get("sums", F.col("i") - 1)).otherwise(F.col("base"))
    return n.where("n_convs > 0").select(
        "conv_id", d.cast("long").alias("depth"),
        F.when(F.col("depth") > 0, F.when(F.col("i") == 0, F.col("up_conv_id")).otherwise(F.col("conv_id"))).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (before - F.col("base"))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(none))).otherwise(F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand (``conv_id, turn, role, text``)."""
    prepare(conversations.sparkSession)
    return trie(sequences(turn_lists(conversations).withColumnRenamed("conv_id", "member")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: Prefixes by digests of whole lists, grouped; the CRC-32 by its bits.
OP12_SQL = """
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, ''))::BIGINT AS b
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(g := g, b := b) ORDER BY turn ASC NULLS FIRST, g) AS l FROM t GROUP BY conv_id),
k AS (SELECT conv_id, l, (xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, 8 * length(conv_id::VARCHAR)),
    lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, i // 8 + 1, 1))::BIGINT ELSE 0::BIGINT END)),
    lambda x, e: xor(xor(x, e) >> 1, 3988292384 * (xor(x, e) & 1)))) % 9)::INTEGER AS h FROM o),
r AS (SELECT k.conv_id, list_concat(list_slice(coalesce(o.l, []), 1, k.h), list_slice(k.l, k.h + 1, len(k.l))) AS l
  FROM k LEFT JOIN o ON o.conv_id = k.conv_id - (k.conv_id % 5 + 5) % 5),
p AS (SELECT conv_id, d, d = len(l) AS ends, md5(array_to_string(list_transform(list_slice(l, 1, d), lambda z: z.g), ',')) AS name,
    CASE WHEN d > 0 THEN md5(array_to_string(list_transform(list_slice(l, 1, d - 1), lambda z: z.g), ',')) END AS up,
    CASE WHEN d > 0 THEN l[d].b ELSE 0 END AS b
  FROM r, unnest(range(0, len(l) + 1)) AS u(d)),
n AS (SELECT d, name, any_value(up) AS up, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY d, name),
c AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up, d),
m AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.up = n.name AND c.d = n.d),
s AS (SELECT p.d, p.name, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.b) AS saved
  FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.d, p.name)
SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.d = m.d AND s.name = m.name LEFT JOIN m AS q ON q.name = m.up AND q.d = m.d - 1
"""
