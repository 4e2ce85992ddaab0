import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weaveline.llm import split as S

TOKEN = re.compile(r"\w+|[^\w\s]")


def test_short_text_is_one_piece():
    assert S.split_text("a b c", 5, 2) == [(0, 5, 3, 0)]
    assert S.split_text("", 5, 2) == [(0, 0, 0, 0)]


def test_exactly_at_the_limit_is_not_cut_and_one_over_is():
    assert len(S.split_text("w " * 250, 250, 40)) == 1
    assert len(S.split_text("w " * 251, 250, 40)) == 2


def test_cut_falls_on_the_blank_line_near_the_middle():
    left, right = " ".join(["one"] * 130), " ".join(["two"] * 120)
    pieces = S.split_text(f"{left}. More here.\n\n{right}", 200, 0)
    text = f"{left}. More here.\n\n{right}"
    assert text[pieces[1][0] :].startswith("two")


def test_sentence_end_beats_white_space():
    words = ["word"] * 300
    words[140] = "word."
    pieces = S.split_text(" ".join(words), 250, 0)
    assert " ".join(words)[pieces[0][0] : pieces[0][1]].endswith("word.")


@given(st.text(alphabet=st.sampled_from(list("ab \n.,;#é𝑥 ")), max_size=600), st.integers(6, 40), st.integers(0, 5))
@settings(max_examples=150, deadline=None)
def test_pieces_stay_under_the_limit_cover_everything_and_overlap(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    tokens = [m.span() for m in TOKEN.finditer(text)]
    covered = set()
    for k, (a, b, n, repeated) in enumerate(pieces):
        inside = [t for t in tokens if a <= t[0] and t[1] <= b]
        assert len(inside) == n <= max(limit, 0)
        assert repeated <= overlap and (k > 0 or repeated == 0)
        covered.update(inside)
        if k:
            assert a <= pieces[k - 1][1] or not overlap
    assert covered == set(tokens)


def test_very_long_text_and_one_long_word():
    assert all(n <= 250 for _, _, n, _ in S.split_text("word, " * 200_000))
    assert S.split_text("x" * 1_000_000) == [(0, 1_000_000, 1, 0)]


def test_bad_parameters():
    with pytest.raises(ValueError):
        S.split_text("a", 10, 10)


def test_table_with_nulls_empty_texts_repeats_and_clashing_columns(spark):
    long = "word " * 300
    df = spark.createDataFrame([(1, long, 10, 5), (1, long, 10, 5), (2, None, 0, 5), (3, "", None, 5), (4, long, None, 5)], "chunk_id long, text string, start_char long, piece int")
    rows = S.split_items(df, "chunk_id", "text", "start_char").collect()
    assert sorted({r["chunk_id"] for r in rows}) == [1, 3, 4]
    assert len([r for r in rows if r["chunk_id"] == 1]) == 4
    for r in rows:
        if r["chunk_id"] == 1:
            assert long[r["start_char"] - 10 : r["end_char"] - 10] == r["text"]
        if r["chunk_id"] == 4:
            assert r["start_char"] is None
        if r["chunk_id"] == 3:
            assert (r["text"], r["token_count"], r["n_pieces"]) == ("", 0, 1)
    assert sorted(r["chunk_id"] for r in S.oversized(S.split_items(df, "chunk_id", "text"), "chunk_id").collect()) == [1, 1, 4]


def test_empty_table(spark):
    df = spark.createDataFrame([], "chunk_id long, text string")
    assert S.split_items(df, "chunk_id", "text").collect() == []
