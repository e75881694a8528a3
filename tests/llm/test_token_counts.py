from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import queries, token_counts
from millrace.llm.token_counts import RULES, Encoding, allocate, attribute, lines, outside

ENCODING = Encoding.load()


def brute(first, last, a, b, rule):
    total = 0.0
    for f, l in zip(first.tolist(), last.tolist()):
        at = {"start": f, "end": l - 1, "middle": (f + l - 1) // 2}.get(rule)
        total += max(0, min(l, b) - max(f, a)) / (l - f) if at is None else a <= at < b
    return total


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=4), st.sampled_from(RULES))
def test_allocation_against_brute_force(text, limits, rule):
    first, last = ENCODING.spans(text, text.encode())
    spans = [(min(a, b, len(text)), min(max(a, b), len(text))) for a, b in limits]
    starts, ends = np.array(spans, np.int64).reshape(-1, 2).T
    assert allocate(first, last, starts, ends, rule) == pytest.approx([brute(first, last, a, b, rule) for a, b in spans])
    held = sum(any(a <= {"start": f, "end": l - 1, "middle": (f + l - 1) // 2}[rule] < b for a, b in spans) for f, l in zip(first, last)) if rule != "proportional" else None
    if held is not None:
        assert outside(first, last, starts, ends, rule) == len(first) - held


def test_spans_cover_the_text():
    text = "héllo 日本\U0001f600 end"
    first, last = ENCODING.spans(text, text.encode())
    assert first[0] == 0 and last[-1] == len(text) and (first[1:] <= last[:-1]).all() and len(first) == len(ENCODING.encoder().encode_ordinary(text))


def test_lines():
    assert [x.tolist() for x in lines("a\nbc\n\nd")] == [[0, 2, 5, 6], [2, 5, 6, 7]] and len(lines("")[0]) == 0 and lines("a\n")[1].tolist() == [2]


@pytest.mark.parametrize("rule", RULES)
def test_lines_add_up(spark, odd, empty, rule):
    got = attribute(odd, ENCODING, rule).collect()
    assert not [r for r in got if r.doc_id in (1, 2)]
    total = sum(r.n_tokens for r in got if r.doc_id == 7)
    assert total == pytest.approx(len(ENCODING.encoder().encode_ordinary("日本語 \u2581 text\x00 with\u00a0odd é\u0301 \U0001f600 marks")))
    assert attribute(empty, ENCODING, rule).count() == 0
    with pytest.raises(ValueError):
        attribute(odd, ENCODING, "some")


def test_given_sections(spark):
    df = spark.createDataFrame(
        [(1, "hello world again", [(0, 5), (3, 8), (None, 4), (20, 90)]), (2, "text", None), (3, None, [(0, 1)])],
        "doc_id long, text string, sec array<struct<start:int,end:int>>",
    )
    got = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in attribute(df, ENCODING, sections_col="sec").collect()}
    assert got == {(1, 0): (1.0, 0), (1, 1): (1.0, 2), (1, 2): (0.0, 0), (1, -1): (1.0, 0), (2, -1): (1.0, 0), (3, 0): (0.0, 0)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "a", "Bc", "1", "'s", ".", "é"]), max_size=40).map("".join))
def test_cut_out_white_space_changes_nothing(text):
    before, token_counts._LONG_SPACE = token_counts._LONG_SPACE, re.compile(token_counts._LONG_SPACE.pattern.replace("5000", "2"))
    try:
        assert ENCODING.ids(text) == ENCODING.encoder().encode_ordinary(text)
    finally:
        token_counts._LONG_SPACE = before


def test_millions_of_spaces_and_bytes_that_are_no_text(spark):
    for run in (" " * 2_000_000, "\n" * 2_000_000):
        first, last = ENCODING.spans(f"a{run}b{run}", f"a{run}b{run}".encode())
        assert first[0] == 0 and last[-1] == 4_000_002 and (first[1:] == last[:-1]).all()
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF0A62' AS string) AS text")
    assert [(r.start, r.end, r.n_tokens > 0) for r in attribute(broken, ENCODING).collect()] == [(0, 3, True), (3, 4, True)]


def test_query_against_brute_force(spark, sf_dir):
    got = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens, r.n_crossing) for r in queries.op2_token_counts(spark, sf_dir).collect()}
    expected = {}
    encoder = ENCODING.encoder()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text, spans, upto = r.text or "", [], b""
        # which bytes, and so which characters, each token stands for
        for token in encoder.encode_ordinary(text):
            begin = len(upto.decode("utf-8", "ignore"))
            upto += encoder.decode_single_token_bytes(token)
            spans.append((begin, len(upto.decode("utf-8", "replace")))) if len(text) < 20_000 else None
        at = 0
        for i, line in enumerate(text.splitlines(keepends=True) if "\r" not in text and not set("\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029") & set(text) else re.findall(r"[^\n]*\n|[^\n]+", text)):
            end = at + len(line)
            if len(text) < 20_000:
                crossing = sum(a < end and b > at and (a < at or b > end) for a, b in spans)
                expected[r.doc_id, i] = (at, end, sum(at <= a < end for a, _ in spans), crossing)
            at = end
    assert expected and {k: got[k] for k in expected} == expected
    short = {d for d, _ in expected}
    assert {k for k in got if k[0] in short} == set(expected)
