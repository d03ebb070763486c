import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from korvex.functions.text import NEWLINES, SPACES
from korvex.operators import chunking

TOKEN = chunking._TOKEN


def check(text):
    rows = chunking.chunk_text(text)
    covered = set()
    for k, body, _, a, b, byte_a, byte_b, tok_a, tok_b, line_a, line_b, before, after in rows:
        assert text[a:b] == body and len(body) <= 1600
        assert (byte_a, byte_b) == (len(text[:a].encode()), len(text[:b].encode()))
        assert tok_b - tok_a == len(TOKEN.findall(body)) and tok_a == len(TOKEN.findall(text[:a]))
        assert line_a == 1 + sum(text[:a].count(c) for c in NEWLINES) and line_b == line_a + sum(body.count(c) for c in NEWLINES)
        assert text[:a].endswith(before) and text[b:].startswith(after) and len(before) == min(120, a)
        covered.update(range(a, b))
    assert all(c in SPACES for k, c in enumerate(text) if k not in covered)
    assert [r[0] for r in rows] == list(range(len(rows)))
    return rows


@pytest.mark.parametrize("text", ["x" * 100 + " " * 1500 + "y" * 100, "a" + "\n" * 1700 + "b", "word " * 900, "p" * 1440 + " " * 160 + "q" * 500, "z" * 3000 + " " * 1700, ("é" * 700 + "\n") * 5, "\n".join(f"line {k}" for k in range(400))])
def test_layouts(text):
    check(text.strip(SPACES))


@settings(max_examples=60, deadline=None)
@given(st.text("ab é\n", min_size=1, max_size=300).map(lambda t: (t * 30).strip(SPACES)))
def test_any_text(text):
    if text:
        check(text)


def test_empty_and_repeats():
    assert [r[3:11] for r in chunking.chunk_text("")] == [(0, 0, 0, 0, 0, 0, 1, 1)]
    hard = check("abcdef" * 900)
    assert [(r[3], r[4]) for r in hard] == [(0, 1600), (1440, 3040), (2880, 4480), (4320, 5400)]


def test_ids_depend_on_text_not_on_place(spark):
    block = "same words here\n" * 100
    df = spark.createDataFrame([("d", "t", "T", block * 3, None), ("e", "t", "T", None, None)], "id string, type string, title string, body string, representation_id string")
    c = chunking.chunk_ids(chunking.chunk(df).selectExpr("*", "'l' lineage_id", "'p' policy_id")).collect()
    assert len({r.chunk_id for r in c}) == len(c)
    twice = [r for r in c if r.content_hash in {x.content_hash for x in c if x.occurrence}]
    assert {r.occurrence for r in twice} >= {0, 1} and sum(r.document_id == "e" for r in c) == 1
