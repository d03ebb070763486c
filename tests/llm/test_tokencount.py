import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from korvex.llm import tokencount
from korvex.llm.tokencount import FOLDER, SPACE, VOCABULARY, PieceCounter

PATH = f"{FOLDER}/{VOCABULARY}"
have = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
TEXTS = ["", " ", "   a  b ", "Hello world, this is a test.", "naïve café 北京 🙂🙂 \U0001f9ff", "line\nline\r\n\ttab", "é" * 50, "a" * 3000, "▁▁x ▁", "<s> <0x0A> </s>", "1234567890" * 30, "Der Straße über"]


def tokenizer(pieces, byte_fallback):
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.Unigram(pieces, 0, byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(SPACE), normalizers.Replace(" ", SPACE)])
    return t


def reference(pieces):
    t = tokenizer(pieces, True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@have
def test_against_the_tokenizer():
    pieces = tokencount.vocabulary(PATH)
    own, other = PieceCounter(pieces), reference(pieces)
    for text in TEXTS:
        assert own.count(text) == other(text), text


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=40))
def test_ties_against_the_tokenizer(text):
    # Equal scores make many ties; no byte pieces, so unknown runs are one piece.
    pieces = [("<unk>", 0.0), (SPACE, -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -2.0), (SPACE + "a", -2.0), ("bab", -3.0), ("aa", -1.0)]
    assert PieceCounter(pieces).count(text) == len(tokenizer(pieces, False).encode(text).ids)


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", min_size=1, max_size=12))
def test_best_score_against_all_segmentations(text):
    pieces = {"a": -1.5, "b": -1.7, "c": -2.1, SPACE: -0.3, "ab": -2.0, "bc": -2.6, "abc": -3.9, SPACE + "a": -1.1}
    s = SPACE + text.replace(" ", SPACE)

    def best(at):
        if at == len(s):
            return 0.0, 0
        return max(((pieces[s[at:e]] + best(e)[0], -1 + best(e)[1]) for e in range(at + 1, min(len(s), at + 3) + 1) if s[at:e] in pieces), key=lambda x: x[0])

    assert PieceCounter(list(pieces.items())).count(text) == -best(0)[1]


@have
def test_query_nulls_and_columns(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(99, None), (None, "a b"), (1, " ")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, n_tokens string, count int")
    out = tokencount.token_counts(df)
    own = PieceCounter(tokencount.vocabulary(PATH))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((i, own.count(t))) for i, t in rows)
    assert tokencount.token_counts(df.limit(0)).count() == 0
