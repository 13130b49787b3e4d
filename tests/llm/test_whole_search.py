"""Nearest neighbours of repeated ids, and text that odd markup surrounds."""

from __future__ import annotations

import numpy as np
import pytest

from mediastrata.llm import html_extract, vptree


def test_repeated_rows_of_an_id_leave_its_equals_in(spark):
    rows = [(0, [1.0, 2.0])] * 8 + [(i, [1.0, 2.0]) for i in (1, 1, 1, 2, 3)] + [(9, [2.0, -1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = vptree.nearest(vectors, vectors.where("vec_id = 0").limit(1)).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [1, 1, 1, 2, 3]
    assert [round(r["score"], 9) for r in found] == [1.0] * 5


def test_kept_rows_hold_the_nearest_of_every_id():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ids = rng.integers(0, 6, 60)
        v = rng.integers(1, 3, (60, 1)).astype(float)
        keep = vptree._first_ids(v, ids, 5)
        for x in (1.0, 2.0):
            for own in range(7):
                whole, kept = (np.sort(i[(w[:, 0] == x) & (i != own)])[:5].tolist() for i, w in ((ids, v), (ids[keep], v[keep])))
                assert whole == kept


@pytest.mark.parametrize("start", ["<body>", "", "<p>"])
def test_a_head_without_end_hides_no_body(start):
    found = html_extract.blocks(f"<html><head><title>T</title><meta name=a><link rel=b>{start}Some text<p>More text</p></html>")
    assert [b.text for b in found] == ["Some text", "More text"]


def test_formulas_and_drawings_stay_in_their_sentence():
    page = """<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding="TeX">x{=}2</annotation></semantics></math> hold, see
    <svg viewBox="0 0 1 1"><title>t</title><style>p{}</style><defs><text>not drawn</text></defs><path d="M0"/><circle r="1"></circle><text>left</text><text>right</text></svg> for more.</p>"""
    assert [b.text for b in html_extract.blocks(page)] == ["Let x=2 hold, see left right for more."]
