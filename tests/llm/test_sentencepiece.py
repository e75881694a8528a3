from __future__ import annotations

import time

import pytest
from tests.llm.conftest import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import queries
from millrace.llm.sentencepiece_nbest import Pieces, encode, expanded

PIECES = Pieces.load()


def every_path(pieces, text):
    into = pieces.edges(text)

    def ends(j):
        if j == 0:
            yield 0.0, b""
        for i, score, ids in into[j]:
            for s, before in ends(i):
                yield s + score, before + ids

    return sorted((s for s, _ in ends(len(text))), reverse=True)


@pytest.mark.parametrize("text", ["hello wor", "the cat.", "été\u2581 x", "a\nb  c", "  ", "x", "日本", "end, of."])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_nbest_against_every_path(text, n):
    wanted = every_path(PIECES, " " + text)
    got = PIECES.nbest(text, n)
    assert [s for s, _ in got] == pytest.approx(wanted[:n])
    assert all(PIECES.decode(ids) == text for _, ids in got) and len({tuple(ids) for _, ids in got}) == len(got)
    assert PIECES.encode(text)[1] == pytest.approx(wanted[0])


def test_a_star_meets_paths_in_order():
    scores = [s for s, _ in PIECES.nbest_part(" wonderful", 40)]
    assert scores == sorted(scores, reverse=True) and scores == pytest.approx(every_path(PIECES, " wonderful")[:40])


def test_parts_never_cut_a_piece():
    for piece, _, _ in PIECES.entries:
        text = "ab" + piece.replace("\u2581", " ")
        cuts, at = set(), 0
        for part in PIECES.parts.findall(" " + text):
            at += len(part)
            cuts.add(at - 1)
        assert not cuts.intersection(range(3, len(text))), piece


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    ids, _ = PIECES.encode(text)
    assert PIECES.decode(ids) == text


def test_generations_of_the_cache(monkeypatch):
    monkeypatch.setattr("millrace.llm.sentencepiece_nbest._CACHED", 3)
    small, text = Pieces(PIECES.entries, PIECES.bytes_), "one two three four five six one two three seven"
    assert small.encode(text) == PIECES.encode(text) == small.encode(text)


def test_rows(spark, odd, empty):
    got = encode(odd, PIECES, nbest=3).collect()
    assert len(got) == 10 and all(r.round_trip for r in got)
    blank = [r for r in got if r.doc_id in (1, 2)]
    assert [(r.ids, r.n_pieces, r.score, r.nbest_scores) for r in blank] == [([], 0, 0.0, [0.0])] * 2
    assert all(r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.score == r.nbest_scores[0] for r in got)
    assert encode(empty, PIECES).count() == 0
    ids = encode(documents(spark, ["hello"]), PIECES).first().ids
    assert PIECES.decode(ids) == "hello"


def test_rows_hold_every_segmentation(spark):
    text = "the wonderful cat."
    row = encode(documents(spark, [text, "a" * 3000]), PIECES).where("doc_id = 1").first()
    assert row.nbest_scores == pytest.approx(every_path(PIECES, " " + text)[:5])
    assert row.nbest_ids[0] == row.ids and len({tuple(i) for i in row.nbest_ids}) == 5
    assert all(PIECES.decode(i) == text for i in row.nbest_ids)
    scores = {i: max(s, PIECES.fallback) for _, s, i in PIECES.entries}
    assert [sum(scores[i] for i in ids) for ids in row.nbest_ids] == pytest.approx(row.nbest_scores)


def test_ties_cost_no_more_than_the_lattice():
    paths = PIECES.nbest_part("a" * 3000, 5)
    assert len({ids for _, ids in paths}) == 5 and all(PIECES.decode(ids) == "a" * 3000 for _, ids in paths)


def test_edits_hold_the_same(spark, odd):
    texts = documents(spark, ["the wonderful cat.", "a" * 500, "été\u2581 x", None, "x", "=====|" * 40])
    for docs in (texts, odd):
        whole = sorted(map(str, encode(docs, PIECES).collect()))
        assert sorted(map(str, expanded(encode(docs, PIECES, edits=True)).collect())) == whole


@pytest.mark.parametrize("text", ["=====|" * 20_000, "x" * 100_000, "wonderful" * 10_000])
def test_long_parts_with_ties_are_linear(text):
    began = time.process_time()
    ways = PIECES.nbest(text, 5)
    assert time.process_time() - began < 20
    assert len({tuple(ids) for _, ids in ways}) == 5 and all(PIECES.decode(ids) == text for _, ids in ways)


def plain_nbest(text, n):
    """The n best scores of the whole lattice, in one pass over it: no parts, no A*, no automaton."""
    pieces = {p.replace("\u2581", " "): max(s, PIECES.fallback) for p, s, _ in PIECES.entries}
    longest, text = max(map(len, pieces)), " " + text
    best = [[0.0]]
    for j in range(1, len(text) + 1):
        ways = [s + pieces[text[i:j]] for i in range(max(0, j - longest), j) if text[i:j] in pieces for s in best[i]]
        if text[j - 1] not in pieces:
            ways += [s + PIECES.fallback for s in best[j - 1]]
        best.append(sorted(ways, reverse=True)[:n])
    return best[-1]


def test_query_against_brute_force(spark, sf_dir):
    """Scores of the five best of every document of up to 3,000 characters; every segmentation is of its score and decodes to the text."""
    rows = {r.doc_id: r for r in expanded(queries.op3_sentencepiece(spark, sf_dir)).collect()}
    scores = {i: max(s, PIECES.fallback) for _, s, i in PIECES.entries}
    spelled = set(PIECES.bytes_.values())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert set(rows) == {d.doc_id for d in docs} and all(r.round_trip for r in rows.values())
    for d in docs:
        row, text = rows[d.doc_id], d.text or ""
        assert row.nbest_ids[0] == row.ids and row.n_pieces == len(row.ids) and row.score == row.nbest_scores[0]
        assert len({tuple(i) for i in row.nbest_ids}) == len(row.nbest_ids) and all(PIECES.decode(i) == text for i in row.nbest_ids)
        if text and len(text) <= 3000:
            assert row.nbest_scores == pytest.approx(plain_nbest(text, 5))
            if text.isascii():
                for ids, score in zip(row.nbest_ids, row.nbest_scores):
                    assert sum(scores[i] for i in ids if i not in spelled) + PIECES.fallback * sum(i in spelled for i in ids) == pytest.approx(score)


def test_texts_that_pieces_do_not_give_back_are_told():
    small = Pieces(PIECES.entries, PIECES.bytes_)
    small.raw[PIECES.nbest("cat", 1)[0][1][-1]] = b"dog"
    for text in ("a cat sat", "cat", "some other words", "", " ", "a  b\n\u2581 c"):
        parts = small.parts.findall(" " + text) if text else []
        ids, _ = small.changes(parts, 3)
        assert small.gives_back(text, parts) == (small.decode(ids) == text)
    assert not small.gives_back("a cat sat", small.parts.findall(" a cat sat")) and not small.gives_back("some words", [" some"])
