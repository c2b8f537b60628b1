"""Removal of repeated passages by sorting suffixes (deep-shallow sorting).

A byte goes if a ``SPAN``-byte string (50) that covers it also starts in a document with a smaller id.  All strings of
that length that could repeat are sorted as suffixes, to the depth of 50 bytes:

* shallow: multikey quicksort over 8-byte symbols, the suffixes of a group split by their next symbol, to ``SHALLOW``
  bytes; only groups that still tie go on;
* deep: a blind trie of each remaining group orders it by the bytes where its members differ, so the long common
  prefixes are read once per suffix; neighbours that agree on all 50 bytes are one class.

Equal texts are one text with the smallest of their ids: the larger ids lose everything (or nothing, under 50 bytes).

How suffixes meet: every string of 50 bytes holds a minimizer, the least hash among its ``GRAM``-byte grams.  Equal strings
have equal minimizers, so runs of consecutive strings with one minimizer (cut at 31) travel as one piece of text.  Per block of
documents a piece is sent once, for the smallest document that holds it; the same piece in a
larger document of the block is gone anyway.  Only pieces whose minimizer occurs in at least two blocks travel; those
whose minimizer only documents of one block share are sorted in that block, a megabyte of whole minimizers at a time.

Steps: (0) each task passes a text on once, to the block that its digest names; (1) blocks emit their distinct minimizers, each
with the number of its different pieces; (2) minimizers seen in two blocks or more come back to the blocks, which emit
their pieces; (3) buckets of pieces sort the suffixes and answer with a bit mask of the strings that start in a smaller
document; (4) blocks lay the masks over their documents.  The text is shuffled once (the exchange by
block serves steps 1, 2 and 4); pieces go to buckets by minimizer, and the strings of a minimizer in more than ``HOT_BLOCKS``
blocks or with more than ``HOT_PIECES`` different pieces (counted per block in step 1, and summed) go by their own hash
instead, so no bucket grows with one passage, nor with one short phrase in many surroundings.

Edge cases: null and empty texts have no bytes; texts under 50 bytes lose nothing; documents without id count as
larger than all others and do not remove from each other; rows that repeat an id do not remove from each other; very long
texts are cut into pieces like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, count_blocks, prepare, text_column

SPAN = 50
GRAM = 24
RUN = 31  # strings in one piece at most: its mask fits an int
SHALLOW = 24
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
HOT_BLOCKS = 20_000
HOT_PIECES = 20_000  # at most 1.6 MB of a bucket
CHUNK = 1 << 20
NO_ID = (1 << 63) - 1
HASH_MASK = np.uint64((1 << 48) - 1)  # of a minimizer's hash; a chance match only sends a piece for nothing
NOTHING = hashlib.sha256(b"").hexdigest()


def _words(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a big-endian number (shorter by 7 places)."""
    n = len(x) - 7
    out = np.empty(n, np.uint64)
    raw = x.tobytes()
    for j in range(min(8, n)):
        part = np.frombuffer(raw, ">u8", (len(raw) - j) // 8, j)
        out[j::8] = part[: len(out[j::8])]
    return out


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    w = _words(x)
    n = len(x) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += w[8:n + 8]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h += w[16:n + 16]
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    size, m = 1, h
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - size: width - size + len(h) - width + 1])


def _marked_pieces(texts: list[bytes]):
    """``pieces`` and, last, a hash of each piece (the sum of its grams' hashes)."""
    x = np.frombuffer(b"".join(texts), np.uint8)
    length = np.array([len(t) for t in texts], np.int64)
    if len(x) < SPAN:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    begin = np.cumsum(length) - length
    grams = _gram_hashes(x)
    least = _window_min(grams, SPAN - GRAM + 1)
    change = np.empty(len(least), bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    fits = length >= SPAN
    change[begin[fits]] = True
    last = begin[fits] + length[fits] - SPAN + 1  # first place without a whole string
    change[last[last < len(change)]] = True
    start = np.nonzero(change)[0]
    size = np.diff(np.append(start, len(least)))
    of = np.searchsorted(begin, start, "right") - 1
    good = start - begin[of] + SPAN <= length[of]
    start, size, of = start[good], size[good], of[good]
    parts = -(-size // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, size, of = np.repeat(start, parts) + nth * RUN, np.repeat(size, parts) - nth * RUN, np.repeat(of, parts)
    size = np.minimum(size, RUN)
    upto = np.append(np.uint64(0), np.cumsum(grams))
    return of, start - begin[of], size, least[start] & HASH_MASK, upto[start + size + SPAN - GRAM] - upto[start]


def pieces(texts: list[bytes]):
    """Runs of strings with one minimizer: ``(text number, start in it, strings, minimizer)`` arrays, text by text."""
    return _marked_pieces(texts)[:4]


def _in_chunks(texts):
    """``pieces`` over parts of about a megabyte; text numbers count through."""
    for i, j in chunks([len(t) for t in texts], CHUNK):
        of, start, size, least = pieces(texts[i:j])
        yield of + i, start, size, least


def _once(batches):
    """Passes each text on once per task; ids stay with the table of digests."""
    seen: set[bytes] = set()
    for b in batches:
        new = ~b["digest"].duplicated() & ~b["digest"].isin(seen)
        seen.update(b["digest"][new])
        yield b[new]


def _texts(docs: pd.DataFrame) -> tuple[list[bytes], list[bytes]]:
    """The block's distinct texts in the order of their digests, and the digests."""
    docs = docs.drop_duplicates("digest").sort_values("digest")
    return [t.encode("utf-8", "surrogatepass") for t in docs["text"]], docs["digest"].tolist()


def _minimizers(key, docs: pd.DataFrame) -> pd.DataFrame:
    texts, _ = _texts(docs)
    least, mark = (np.concatenate(c) for c in zip(*[_marked_pieces(texts[i:j])[3:] for i, j in chunks([len(t) for t in texts], CHUNK)]))
    order = np.lexsort((mark, least))
    least, mark = least[order], mark[order]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (mark[1:] != mark[:-1])
    h, n = np.unique(least[new], return_counts=True)  # a block sends a piece once
    return pd.DataFrame({"h": h.view(np.int64), "block": np.full(len(h), key[0], np.int32), "pieces": n.astype(np.int32)})


def _settled_here(groups):
    """``(text number, start, strings)`` of the runs that also start in a smaller document, from lists of
    ``(text number, key, start, strings, piece)`` per minimizer."""
    groups = [g for g in groups if len(g) > 1]
    for i, j in chunks([sum(len(x[-1]) for x in g) for g in groups], CHUNK):
        rows = pd.DataFrame([x for g in groups[i:j] for x in g], columns=["row", "key", "start", "strings", "piece"])
        found = _judge_bucket(rows.assign(block=0))
        for n, start, mask in zip(found["row"].tolist(), found["start"].tolist(), found["mask"].tolist()):
            while mask:
                skip = (mask & -mask).bit_length() - 1
                mask >>= skip
                k = (~mask & (mask + 1)).bit_length() - 1  # ones at the low end
                yield n, start + skip, k
                mask >>= k
                start += skip + k


def _seen_pieces(buckets: int):
    def run(key, docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """The block's pieces: those that must be compared elsewhere, and masks settled here (bucket spread by start)."""
        texts, digests = _texts(docs)
        named = known[known["digest"].notna()]
        id_of = dict(zip(named["digest"], named["key"]))
        by_id = sorted(range(len(texts)), key=lambda n: id_of[digests[n]])  # smaller ids first: they keep their pieces
        ids = [id_of[digests[n]] for n in by_id]
        row, texts = by_id, [texts[n] for n in by_id]
        shared = known[known["digest"].isna()]
        h_all, hot_all = shared["h"].to_numpy(np.int64).view(np.uint64), shared["hot"].to_numpy(bool)
        order = np.argsort(h_all)
        h_all, hot_all = h_all[order], hot_all[order]
        first: dict[bytes, int] = {}  # piece -> smallest id here
        out = {n: [] for n in ("bucket", "row", "key", "start", "strings", "piece")}

        def put(bucket, n, start, strings, piece):
            for name, v in zip(out, (bucket, row[n], ids[n], start, strings, piece)):
                out[name].append(v)

        of, start, size, least = (np.concatenate(c) for c in zip(*_in_chunks(texts)))
        at = np.minimum(np.searchsorted(h_all, least), max(len(h_all) - 1, 0))
        there = h_all[at] == least if len(h_all) else np.zeros(len(least), bool)
        _, which = np.unique(least, return_inverse=True)
        low, high = np.full(len(which), len(texts)), np.full(len(which), -1)  # first and last text of each minimizer
        np.minimum.at(low, which, of)
        np.maximum.at(high, which, of)
        look = np.nonzero(there | (low < high)[which])[0]  # the others stand alone
        local: dict[int, list] = {}  # minimizer that only this block has -> its pieces
        bucket = (least[look] % np.uint64(buckets)).tolist()
        for n, s, k, elsewhere, a, b, m in zip(of[look].tolist(), start[look].tolist(), size[look].tolist(), there[look].tolist(), at[look].tolist(), bucket, which[look].tolist()):
            piece = texts[n][s:s + k + SPAN - 1]
            before = first.setdefault(piece, ids[n])
            if before < ids[n]:
                put(s % buckets, n, s, k, None)
            elif elsewhere:
                if hot_all[a]:
                    for i in range(k):
                        one = piece[i:i + SPAN]
                        put(xxhash.xxh64_intdigest(one) % buckets, n, s + i, 1, one)
                else:
                    put(b, n, s, k, piece)
            else:
                local.setdefault(m, []).append((n, ids[n], s, k, piece))
        for n, s, k in _settled_here(local.values()):
            put(s % buckets, n, s, k, None)
        d = pd.DataFrame(out, columns=list(out)).astype({"bucket": "int64", "row": "int32", "key": "int64", "start": "int32", "strings": "int32"})
        d["block"] = np.int32(key[0])
        return d[["bucket", "block", "row", "key", "start", "strings", "piece"]]

    return run


def _trie_classes(data: bytes, starts: list[int]) -> list[int]:
    """Class of each of the tied suffixes, equal ones together, by a blind trie over the bytes from SHALLOW to SPAN.

    A node is ``[place, children by byte]`` or the leaf ``(member, class)``; only the branching places are read on the way
    down, then one comparison with a member tells where the new suffix departs.
    """
    out = [0] * len(starts)
    classes = 1
    root: object = (starts[0], 0)
    for i in range(1, len(starts)):
        s = starts[i]
        node = root
        while type(node) is list:  # blind descent
            node = node[1].get(data[s + node[0]]) or next(iter(node[1].values()))
        member, cls = node
        a, b = data[s + SHALLOW:s + SPAN], data[member + SHALLOW:member + SPAN]
        if a == b:
            out[i] = cls
            continue
        lo = 0
        while a[lo] == b[lo]:
            lo += 1
        place = SHALLOW + lo
        leaf = (s, classes)
        out[i] = classes
        classes += 1
        parent, node = None, root
        while type(node) is list and node[0] < place:
            parent, node = node, node[1][data[s + node[0]]]
        if type(node) is list and node[0] == place:
            node[1][data[s + place]] = leaf
            continue
        fork = [place, {data[s + place]: leaf, data[member + place]: node}]
        if parent is None:
            root = fork
        else:
            parent[1][data[s + parent[0]]] = fork
    return out


def suffix_classes(data: bytes, starts: np.ndarray) -> np.ndarray:
    """A class number per suffix; suffixes are in one class if their first SPAN bytes agree."""
    x = np.frombuffer(data + bytes(8), np.uint8)
    words = _words(x)
    group = np.zeros(len(starts), np.int64)
    result = np.full(len(starts), -1, np.int64)
    tied = np.arange(len(starts))
    used = 0
    for depth in range(0, SHALLOW, 8):  # split every group by its next symbol
        symbol = words[starts[tied] + depth]
        order = np.lexsort((symbol, group))
        tied, group, symbol = tied[order], group[order], symbol[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])] if len(tied) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        alone = np.bincount(group)[group] == 1 if len(tied) else new
        result[tied[alone]] = used + np.arange(alone.sum())
        used += int(alone.sum())
        tied, group = tied[~alone], group[~alone]
    edges = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0] if len(tied) else np.empty(0, int)
    place = starts[tied].tolist()
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(tied)]):
        c = _trie_classes(data, place[a:b])
        result[tied[a:b]] = used + np.array(c)
        used += max(c) + 1
    return result


def _judge_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Masks of the strings that also start in a smaller document."""
    here = rows["piece"].isna().to_numpy()
    out = [pd.DataFrame({"block": rows["block"][here], "row": rows["row"][here], "start": rows["start"][here],
                         "mask": (np.int64(1) << rows["strings"][here].to_numpy(np.int64)) - 1})]
    rest = rows[~here].reset_index(drop=True)
    if len(rest):
        which, text = pd.factorize(rest["piece"])  # equal pieces are sorted once
        key = rest["key"].to_numpy()
        least = np.full(len(text), NO_ID)
        np.minimum.at(least, which, key)
        size = np.array([len(t) for t in text]) - SPAN + 1
        begin = np.cumsum(size + SPAN - 1) - (size + SPAN - 1)
        of = np.repeat(np.arange(len(text)), size)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        cls = suffix_classes(b"".join(text), begin[of] + nth)
        first = np.full(cls.max() + 1, NO_ID)
        np.minimum.at(first, cls, least[of])
        # per row: its strings are the strings of its text
        offset = np.cumsum(size) - size
        n = size[which]
        at = np.repeat(offset[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = first[cls[at]] < np.repeat(key, n)
        mask = np.add.reduceat(np.where(gone, np.int64(1) << bit, 0), np.cumsum(n) - n)
        found = mask != 0
        out.append(pd.DataFrame({"block": rest["block"][found], "row": rest["row"][found], "start": rest["start"][found], "mask": mask[found]}))
    return pd.concat(out, ignore_index=True)


def _cut(key, docs: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
    texts, digests = _texts(docs)
    masks = masks.sort_values("row")
    m_row, m_start, m_bits = masks["row"].to_numpy(), masks["start"].to_numpy(np.int64), masks["mask"].to_numpy()
    out = []
    for row, (data, digest) in enumerate(zip(texts, digests)):
        a, b = np.searchsorted(m_row, row, "left"), np.searchsorted(m_row, row, "right")
        gone, runs, kept = 0, 0, data
        if a < b:
            bits = (m_bits[a:b, None] >> np.arange(RUN)) & 1
            at = (m_start[a:b, None] + np.arange(RUN))[bits == 1]
            delta = np.zeros(len(data) + 1, np.int32)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + SPAN, -1)
            cover = np.cumsum(delta[:-1]) > 0
            gone = int(cover.sum())
            runs = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
            kept = np.frombuffer(data, np.uint8)[~cover].tobytes()
        out.append((digest, gone, runs, hashlib.sha256(kept).hexdigest(), kept))
    return pd.DataFrame(out, columns=["digest", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (the remaining bytes)."""
    prepare(docs.sparkSession)
    d = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), text_column("`text`").alias("text"))
    blocks = count_blocks(d, "text", BLOCK_BYTES, 48)
    buckets = max(48, blocks * BLOCK_BYTES // BUCKET_BYTES)
    block = F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int").alias("block")
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    members = d.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), digest)
    firsts = members.groupBy("digest").agg(F.min("key").alias("key"))
    texts = d.select(digest, "text").mapInPandas(_once, "digest binary, text string").select(block, "digest", "text")
    h = texts.groupBy("block").applyInPandas(_minimizers, "h long, block int, pieces int")
    same = Window.partitionBy("h")
    shared = (h.withColumn("lo", F.min("block").over(same)).withColumn("hi", F.max("block").over(same)).withColumn("n", F.count("*").over(same))
              .withColumn("pieces", F.sum("pieces").over(same))
              .where("lo < hi").select("block", "h", ((F.col("n") > HOT_BLOCKS) | (F.col("pieces") > HOT_PIECES)).alias("hot")))
    # no null numbers: pandas would read the column as floating point
    known = shared.select("block", "h", "hot", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("key")).unionByName(
        firsts.select(block, F.lit(0).cast("long").alias("h"), F.lit(False).alias("hot"), "digest", "key"))
    piece = texts.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
        _seen_pieces(buckets), "bucket long, block int, row int, key long, start int, strings int, piece binary")
    masks = piece.groupBy("bucket").applyInPandas(_judge_bucket, "block int, row int, start int, mask long")
    cut = texts.groupBy("block").cogroup(masks.groupBy("block")).applyInPandas(
        _cut if with_text else lambda key, a, b: _cut(key, a, b).drop(columns="kept"),
        "digest binary, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    # the keys are turned around so that both sides are exchanged for this join and a digest of many copies can be split
    around = F.reverse(F.hex("digest")).alias("around")
    cut = cut.join(firsts.withColumnRenamed("key", "first"), "digest").select(around, "first", *cut.columns[1:])
    out = members.select("*", around).join(cut, "around")
    copy = (F.col("key") > F.col("first")) & (F.col("n_bytes") >= SPAN)
    columns = ["doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
               F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
               F.when(copy, F.lit(NOTHING)).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    if with_text:
        columns.append(F.when(copy, F.unhex(F.lit(""))).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
