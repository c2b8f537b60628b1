import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from qlift.llm import bpe

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_spec(PATH))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


HARD = ["", " ", "aaaaaaaaaaaaaaaaa", "I'll we've it's 'S", "x<|endoftext|>y <|startoftext|> <|endoftext|", "Ünï ÇÉ é ΑΣ İI ß ﬁ ²½Ⅷ٣",
        "a\u2028b\u3000c\u200ad\u1680e", "a\x1cb\x1f \x85c d", "日本語 😀😀 ‍", "<|ENDOFTEXT|>", "hahahahaha" * 50, "....!!!???", "1234 5", "\x00\x01", "é" * 300, "don't'd'll", "na" * 37]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == want
    assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abnorthei 'lst<|>é"), st.characters(codec="utf-8", max_codepoint=0x10FFFF)), max_size=60))
def test_any_text(codec, library, text):
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_every_code_point(codec, library):
    """Alone, among letters, among signs, before and after marks that a normal form would move or compose."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f":{c}a: q\u0301{c}\u05b0 {c}\u0327\u0301" if c < "\U00032400" else f":{c}a" for c in points]
    wrong = []
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        for c, t, want in zip(points[at:], part, library.encode_batch_fast(part, add_special_tokens=False)):
            if codec.encode(t) != want.ids:
                wrong.append(hex(ord(c)))
    assert not wrong


def test_query_on_whole_documents(spark, library):
    """The query's three columns against the library, over every document of a small scale."""
    import hashlib

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_bpe(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        said = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        back = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert got[d.doc_id] == (len(ids), said, back), d.doc_id


def test_operator(spark, library):
    rows = [(1, "Hello world, it's me"), (2, None), (3, ""), (3, "Hello world, it's me"), (None, "x " * 30000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.text): r for r in bpe.decode(bpe.encode(df)).collect()}
    for i, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i, t].ids == want and got[i, t].decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.round_trip(df).count() == 5
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_text_is_sent_once_and_only_carried_if_asked_for(spark):
    rows = [(1, "one two", "s"), (2, None, None), (None, "", "s"), (2, "Two's 3", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {(i, t, s): library.encode(t or "", add_special_tokens=False).ids for i, t, s in rows}
    whole = bpe.encode(docs)
    assert "__source" not in whole._jdf.queryExecution().analyzed().toString()
    assert whole.columns == ["doc_id", "text", "source", "ids"] and {tuple(r[:3]): r.ids for r in whole.collect()} == want
    few = bpe.encode(docs, carried=["source", "doc_id"])
    assert few.columns == ["doc_id", "source", "ids"]
    assert sorted(map(str, map(tuple, few.collect()))) == sorted(str((i, s, x)) for (i, t, s), x in want.items())
    assert "__source" not in bpe.decode(whole)._jdf.queryExecution().analyzed().toString()
    back = {tuple(r[:3]): r.decoded for r in bpe.decode(whole).collect()}
    assert back == {k: library.decode(x, skip_special_tokens=False) for k, x in want.items()}
    other = bpe.encode(docs.selectExpr("doc_id", "12 as text"), ids="text")  # no string, and replaced
    assert other.columns == ["doc_id", "text"] and other.first().text == library.encode("12", add_special_tokens=False).ids
