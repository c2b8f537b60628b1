"""BPE encoding and decoding by a token automaton.

The merges are compiled one after the other into a deterministic automaton over tokens that accepts exactly the
correct token sequences.  It starts with one state per symbol and every arc.  The gadget of merge ``u v -> uv``
(at time t)

* gives ``uv`` the state that ``v`` had just then (what may follow ``v`` may follow ``uv``),
* takes the arc ``v`` from the state of ``u`` (from now on that pair is always merged),
* adds the arc ``uv`` wherever the arc ``u`` stands (not to the state of ``u`` itself if ``u = v``: of three
  equal symbols the first two merge).

The dense table would need vocabulary squared entries, so ``TokenAutomaton`` keeps per token its parts and birth
time and the removed arcs, and works out an arc of the table when a word first asks for it.  A word has one accepted
path; it is found from left to right, the longest arc first, each step a look-up in the arc table, and a state and
place that led nowhere is left out from then on.  Decoding emits the label of each arc.

A text is cut as the tokenizer file says (NFC, lower case, contractions, runs of letters, single digits, runs of
other signs), with the tokenizer's own character tables, stated below; no word spans white space, so the ids of each white-space chunk are kept in a bounded table of the
worker.  Special tokens in a text keep their own id.  Nothing is shuffled; the merges (bounded by the vocabulary) are
broadcast.

Edge cases: a null or empty text has no tokens; repeated rows are encoded one by one; an empty table gives an empty
result; other columns of the caller are carried along by ``encode``.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
import zlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from .common import chunks, prepare, text_column

TOKENIZER_FILE = "word_bpe_49k.json"
END = "\n"  # stands for the end-of-word mark; no byte symbol is spelled so
# White space of the tokenizer's patterns (Unicode White_Space), stated for the texts where str.split() would differ.
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(f"[^{SPACES}]+")
# What the tokenizer's character tables hold beside (or without) those of Unicode 15.1.  Its letters and
# digits are those of Unicode 16, its lower case that of 17, its normal form that of 10.
UNICODE = "15.1.0"
MORE_LETTERS = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 "
    "11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0")
MORE_DIGITS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
MORE_LOWER = "1c89:1c8a a7cb:264 a7cc:a7cd a7ce:a7cf a7d2:a7d3 a7d4:a7d5 a7da:a7db a7dc:19b 10d50-10d65:10d70 16ea0-16eb8:16ebb"
UNKNOWN_MARKS = (  # combining marks (and one pair) that the normal form leaves where they stand
    "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 "
    "1133b 1145e 11839-1183a 11930 11935 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f "
    "1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef")
LOW = 0x250  # texts below it (Latin letters and signs) have a pattern of their own
START = -1
PART = 1 << 20  # bytes or ids of a part of a batch


def _ranges(stated: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (r.partition("-") for r in stated.split())]


def _class(ranges) -> str:
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


def _of_category(first: str) -> list[tuple[int, int]]:
    """The ranges of code points whose general category begins with ``first``, by the interpreter's tables."""
    out: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == first:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return [(a, b) for a, b in out]


class Text:
    """Normal form, lower case and words as the tokenizer has them, for every code point."""

    def __init__(self):
        if unicodedata.unidata_version != UNICODE:
            raise RuntimeError(f"character tables are stated for Unicode {UNICODE}, not {unicodedata.unidata_version}: "
                               "state the fixed values of this module anew (tests/llm/test_bpe.py compares every code point)")
        letters, digits = [*_of_category("L"), *_ranges(MORE_LETTERS)], [*_of_category("N"), *_ranges(MORE_DIGITS)]
        self.all_words = self._pattern(letters, digits)
        self.low_words = self._pattern(*([(a, min(b, LOW - 1)) for a, b in c if a < LOW] for c in (letters, digits)))
        self.unknown_marks = re.compile(f"([{_class(_ranges(UNKNOWN_MARKS))}]+)")
        self.more_lower = {}
        for entry in MORE_LOWER.split():
            source, to = entry.split(":")
            (a, b), = _ranges(source)
            self.more_lower |= {c: int(to, 16) + c - a for c in range(a, b + 1)}

    @staticmethod
    def _pattern(letters, digits):
        letters, digits = _class(letters), _class(digits)
        return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{SPACES}{letters}{digits}]+").findall

    def words(self, text: str) -> list[str]:
        """The pieces of a normal text; texts of low code points alone have a pattern of few ranges."""
        return self.low_words(text) if text.isascii() or max(text) < chr(LOW) else self.all_words(text)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self.unknown_marks.search(text):
            text = "".join(unicodedata.normalize("NFC", p) for p in self.unknown_marks.split(text))
        else:
            text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]).translate(self.more_lower)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte (printable Latin-1 for itself, the rest from U+0100 on)."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(more))
        more += b not in plain
    return out


def load_spec(path: str) -> dict:
    """What the automaton needs from a tokenizer file: ids by spelling, merges in order, special tokens."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in t["model"]["merges"]]
    return {"vocab": t["model"]["vocab"], "merges": merges,
            "special": {a["content"]: a["id"] for a in t["added_tokens"] if a["special"]},
            "mark": t["model"]["end_of_word_suffix"]}


class TokenAutomaton:
    """Deterministic automaton over tokens; ``path(word)`` gives the ids of a word's only accepted path."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], mark: str, arcs_kept: int = 200_000):
        def spell(t):
            return t[: -len(mark)] + END if t.endswith(mark) else t

        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.removed: dict[int, int] = {}  # arc (u, v) -> time of the gadget that took it
        self.tokens: dict[str, int] = {}
        self.arcs: dict[int, bool] = {}
        self.arcs_kept = arcs_kept
        made = {a + b for a, b in merges}
        for t, i in vocab.items():
            if t not in made:
                self.born[i] = 0
                self.tokens[spell(t)] = i
        for time, (a, b) in enumerate(merges, 1):
            self._gadget(vocab[a], vocab[b], vocab[a + b], time, spell(a + b))
        # the tokens' spellings as nested tables: a sign leads to the token spelled so far (or -1) and the table of what may follow
        self.spellings: dict = {}
        for t in sorted(self.tokens):
            node = self.spellings
            for c in t[:-1]:
                node = node.setdefault(c, (-1, {}))[1]
            node[t[-1]] = (self.tokens[t], node[t[-1]][1] if t[-1] in node else {})

    def _gadget(self, u: int, v: int, uv: int, time: int, spelling: str) -> None:
        if not self._arc_at(u, v, time):
            return  # no path reads u v any more: the merge never applies
        self.left[uv], self.right[uv], self.born[uv] = u, v, time
        self.removed[u << 20 | v] = time
        self.tokens[spelling] = uv

    def _arc_at(self, s: int, t: int, time: int) -> bool:
        """Whether the state of ``s`` has the arc ``t`` just before the gadget of ``time``."""
        while True:
            gone = self.removed.get(s << 20 | t)
            if gone is not None and gone < time:
                return False
            bs, bt = self.born[s], self.born[t]
            if bs == bt == 0:  # two symbols
                return True
            if s == t:  # the new state, still a copy of its right part's, gets the new arc beside that of the left part
                s, t, time = self.right[s], self.left[t], bs
                continue
            if bt > bs:  # the arc came with t's gadget, beside the arc of t's left part; that gadget counts
                t, time = self.left[t], bt + 1
            else:  # the state of s is a copy of its right part's, from just before its gadget
                s, time = self.right[s], bs

    def arc(self, s: int, t: int) -> bool:
        if s == START:
            return True
        key = s << 20 | t
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= self.arcs_kept:
                self.arcs.clear()
            found = self.arcs[key] = self._arc_at(s, t, 1 << 60)
        return found

    def path(self, word: str) -> list[int]:
        """``word``: byte symbols, then ``END``.  Follows the longest arc first; what led nowhere is not tried again."""
        whole = self.tokens.get(word)
        if whole is not None:
            return [whole]
        spellings, arcs, n = self.spellings, self.arcs, len(word)
        # most words: the longest arc at every step
        out: list[int] = []
        last, at = START, 0
        while at < n:
            node, best = spellings, -1
            for end in range(at, n):
                found = node.get(word[end])
                if found is None:
                    break
                t, node = found
                if t >= 0:
                    best, to = t, end + 1
            if best < 0:
                return self._search(word)
            if last >= 0:
                found = arcs.get(last << 20 | best)
                if not (self.arc(last, best) if found is None else found):
                    return self._search(word)
            out.append(best)
            last, at = best, to
        return out

    def _search(self, word: str) -> list[int]:
        """The same with a way back: what led nowhere is left out from then on."""
        spellings, arcs, n = self.spellings, self.arcs, len(word)
        out: list[int] = []
        ends = [0]
        dead: set[tuple[int, int]] = set()
        untried: list[list[tuple[int, int]]] = []  # per step the tokens spelled from its place on, longest last
        last, at = START, 0
        while True:
            if len(untried) == len(out):
                node, choices = spellings, []
                for end in range(at, n):
                    found = node.get(word[end])
                    if found is None:
                        break
                    t, node = found
                    if t >= 0:
                        choices.append((t, end + 1))
                untried.append(choices)
            else:
                choices = untried[-1]
            while choices:
                t, end = choices.pop()
                if last >= 0:
                    found = arcs.get(last << 20 | t)
                    if not (self.arc(last, t) if found is None else found):
                        continue
                if dead and (t, end) in dead:
                    continue
                out.append(t)
                if end == n:
                    return out
                last, at = t, end
                ends.append(end)
                break
            else:
                if not out:
                    raise ValueError(f"no path for {word[:60]!r}")
                untried.pop()
                dead.add((out.pop(), ends.pop()))
                last, at = (out[-1], ends[-1]) if out else (START, 0)


class Codec:
    """Texts to ids and back, with two bounded tables: the ids of short chunks and words seen (a plain word's are shared)."""

    def __init__(self, spec: dict, kept: int = 40_000, kept_words: int = 100_000):
        self.automaton = TokenAutomaton(spec["vocab"], spec["merges"], spec["mark"])
        self.special = spec["special"]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.labels = {i: t for t, i in {**spec["vocab"], **self.special}.items()}
        self.symbols = _byte_symbols()
        self.text = Text()
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.seen: dict[str, tuple[int, ...]] = {}
        self.kept, self.kept_words = kept, kept_words

    def _plain(self, text: str):
        text = self.text.normal(text)
        if text.isascii() and text.isalpha():
            return self._word(text)
        return [i for w in self.text.words(text) for i in self._word(w)]

    def _word(self, w: str) -> tuple[int, ...]:
        ids = self.seen.get(w)
        if ids is None:
            s = w if w.isascii() and w.isalnum() else "".join([self.symbols[b] for b in w.encode("utf-8")])
            ids = tuple(self.automaton.path(s + END))
            if len(w) <= 64:
                if len(self.seen) >= self.kept_words:
                    self.seen.clear()
                self.seen[w] = ids
        return ids

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if self.split_special and "<|" in chunk:
            ids = [i for p in self.split_special.split(chunk)
                   for i in ([self.special[p]] if p in self.special else self._plain(p))]
        else:
            ids = self._plain(chunk)
        ids = tuple(ids)  # the word's own, if it is one
        if len(chunk) <= 64:
            if len(self.chunks) >= self.kept:
                self.chunks.clear()
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text  # str.split() cuts there, the tokenizer doesn't
        get, chunk = self.chunks.get, self._chunk
        return list(chain.from_iterable([get(c) or chunk(c) for c in (_CHUNKS.findall(text) if odd else text.split())]))

    def forget(self) -> None:
        """Empties the tables of what was seen; the automaton stays."""
        self.chunks.clear()
        self.seen.clear()
        self.automaton.arcs.clear()

    def decode(self, ids) -> str:
        """The labels of the ids, joined by a space (the file names no decoder)."""
        return " ".join(map(self.labels.__getitem__, ids))


_CODECS: dict[tuple, Codec] = {}
# Words a worker keeps with their ids (and two fifths as many chunks); 150 bytes each or so.
FEW_WORDS, MANY_WORDS = 100_000, 200_000


def _codec(spec) -> Codec:
    """The worker's compiled automaton of this tokenizer; one is held, and of the broadcast only its packed form."""
    *key, packed = spec.value
    if tuple(key) not in _CODECS:
        _CODECS.clear()
        _CODECS[tuple(key)] = Codec(json.loads(zlib.decompress(packed)), key[1] * 2 // 5, key[1])
    return _CODECS[tuple(key)]


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def _broadcast(spark: SparkSession, path: str | None, kept_words: int = FEW_WORDS):
    prepare(spark)
    path = path or _tokenizer_path()
    return spark.sparkContext.broadcast((path, kept_words, zlib.compress(json.dumps(load_spec(path)).encode())))


def _with_column(df: DataFrame, name: str, kind: DataType, arrow, make, spec, source: str, as_text: bool, carried: list[str] | None = None):
    """The columns ``carried`` (default: all) of ``df`` and ``name = make(codec, source)``, by batches passed on in small parts.
    A column ``source`` that is carried is sent once, not once more to be read."""
    others = [n for n in df.columns if n != name and (carried is None or n in carried)]
    sent, column = [F.col(f"`{n}`") for n in others], F.col(f"`{source}`")
    if as_text and not isinstance(df.select(column).schema[0].dataType, StringType):
        source, column = "", column.cast("string")
    at = others.index(source) if source in others else len(others)
    if at == len(others):
        sent.append(column.alias("__source"))

    def run(batches):
        codec = _codec(spec)
        try:
            for b in batches:
                column, kept = b.column(at), b.select(list(range(len(others))))
                for i, j in chunks(_sizes(column), PART):
                    made = pa.array([make(codec, x.as_py()) for x in column.slice(i, j - i)], arrow)
                    yield pa.RecordBatch.from_arrays([*kept.slice(i, j - i).columns, made], names=[*others, name])
        finally:
            codec.forget()  # the worker may go on with another stage

    return df.select(*sent).mapInArrow(run, StructType([*[df.schema[n] for n in others], StructField(name, kind)]))


def _sizes(column) -> list[int]:
    import pyarrow.compute as pc

    measure = pc.binary_length if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.list_value_length
    return pc.fill_null(measure(column), 0).to_pylist()


def encode(docs: DataFrame, path: str | None = None, ids: str = "ids", carried: list[str] | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` in the column ``ids`` (array of int; a column of that name is replaced); of the
    other columns only those ``carried``, if named: what isn't asked for needn't pass through the workers."""
    return _with_column(docs, ids, ArrayType(IntegerType()), pa.list_(pa.int32()), lambda c, x: c.encode(x), _broadcast(docs.sparkSession, path), "text", True, carried)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the decoded text of the id array ``ids`` (null: null) in the column ``text`` (one of that name is replaced)."""
    return _with_column(rows, text, StringType(), pa.string(), lambda c, x: None if x is None else c.decode(x), _broadcast(rows.sparkSession, path), ids, False)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, decode and digest in one pass over the texts."""
    spec = _broadcast(docs.sparkSession, path, MANY_WORDS)  # no rows are carried along here, which leaves room

    def run(batches):
        codec = _codec(spec)
        as_text = {i: str(i) for i in codec.labels}
        for b in batches:
            n, first, second = [], [], []
            for t in b.column("text"):
                ids = codec.encode(t.as_py())
                n.append(len(ids))
                first.append(hashlib.sha256(" ".join(map(as_text.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), text_column("`text`").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
