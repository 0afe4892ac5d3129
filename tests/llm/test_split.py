import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annalist.llm import split


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=400), st.integers(2, 60), st.integers(0, 59))
def test_limits_and_overlap(strengths, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError):
            split.cut_points(strengths, limit, overlap)
        return
    pieces = split.cut_points(strengths, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(strengths)
    assert all(0 < e - s <= limit for s, e in pieces)
    assert all(a[1] - b[0] == overlap and a[1] < b[1] for a, b in zip(pieces, pieces[1:]))


def test_cuts_at_breaks():
    text = " ".join(["w"] * 29 + ["end."] + ["w"] * 30)
    spans = [m.span() for m in split._WORD.finditer(text)]
    pieces = split.cut_points(split.boundary_strengths(text, spans), 35, 5)
    assert pieces[0] == (0, 30)


def test_rows(spark):
    rng = random.Random(1)
    long = "".join(rng.choice(["aa ", "b.\n", "c,\t", "דד "]) for _ in range(20_000))
    texts = {1: None, 2: "", 3: "   ", 4: "one two", 5: "w " * 50, 6: "w " * 51, 7: long}
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in texts.items()], "row_id bigint, chunk string, piece string, piece_no int")
    rows = split.split_oversized(df, "chunk", ["row_id", "piece"], 50, 5).toPandas()
    assert rows.columns.tolist().count("piece") == 2
    rows.columns = ["row_id", "key", "piece_no", "pieces", "from_word", "to_word", "piece"]
    n = rows.groupby("row_id").size()
    assert 1 not in n and all(n[i] == 1 for i in (2, 3, 4, 5)) and n[6] == 2
    for i, g in rows.groupby("row_id"):
        back, done = "", 0
        for r in g.sort_values("piece_no").itertuples():
            assert r.to_word - r.from_word + 1 <= 50
            words = split._WORD.finditer(r.piece)
            spans = [m.span() for m in words]
            skip = done - (r.from_word - 1)
            back += r.piece if r.piece_no == 1 else r.piece[spans[skip][0] :]
            done = r.to_word
        assert back == texts[i]
    only = split.split_oversized(df, "chunk", ["row_id"], 50, 5, whole=False)
    assert {r.row_id for r in only.collect()} == {6, 7}
    assert split.split_oversized(df.limit(0), "chunk", ["row_id"], 50, 5).collect() == []
