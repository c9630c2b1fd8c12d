import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
LETTERS = st.text(st.sampled_from(list("abtheTHE' \n\tllsré9日.,-_AC😅")), max_size=60)


@pytest.fixture(scope="module")
def both():
    import tiktoken

    own = tokens.encoder()
    return own, tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(LETTERS | st.text(max_size=40))
def test_same_ids_as_the_public_library(both, text):
    text = text.encode("utf-8", "replace").decode()
    own, public = both
    assert own.encode(text) == public.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(LETTERS, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 5), LETTERS.map(lambda s: s[:5])), max_size=4))
def test_edits_and_appends(both, text, edits):
    own, public = both
    e = tokens.Encoding(own, text)
    for at, cut, new in edits:
        at = min(at, len(e.text))
        e.edit(at, min(len(e.text), at + cut), new)
        assert e.ids == public.encode_ordinary(e.text)
    e.append("'ll go")
    assert e.ids == public.encode_ordinary(e.text)


def test_prefix_tokens_are_kept_on_append(both):
    own, _ = both
    whole = b"unbelievablyLongPieceOfText" * 20
    for cut in (1, 7, 100, 300):
        assert own.last_tokens(whole, own.last_tokens(whole[:cut])) == own.last_tokens(whole)


def test_long_pieces(both):
    own, public = both
    text = "ACDEFGHIKLMNPQRSTVWY" * 2000
    assert own.encode(text) == public.encode_ordinary(text)
    assert own.decode(own.encode("x" * 300_000)) == b"x" * 300_000


def test_table(rows, both):
    df = rows("doc_id long, text string, ids string", [(1, "Hello world", "c"), (2, "", "c"), (3, None, "c"), (4, "<|endoftext|>", "c"), (4, "<|endoftext|>", "c")])
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect())
    assert got[0] == (1, both[1].encode_ordinary("Hello world")) and got[1][1] == [] and got[2][1] == []
    assert got[3] == got[4] == (4, both[1].encode_ordinary("<|endoftext|>"))
    assert dict(tokens.encode_corpus(df).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    assert [r.n for r in df.orderBy("doc_id").select(tokens.token_count(F.col("text")).alias("n")).collect()][:3] == [2, 0, 0]


def test_bytes_that_are_not_text(spark):
    from pyspark.sql import functions as F

    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('41FF42') AS binary) AS text")
    got = df.select(tokens.token_ids(F.col("text")).alias("ids")).first().ids
    assert tokens.encoder().decode(got).decode() == "A�B"
