from __future__ import annotations

import hashlib

import pytest
from tests.llm.conftest import documents

from millrace.llm import queries
from millrace.llm.exact_dedup import exact_dedup
from tests import oracle


@pytest.mark.parametrize("broadcast_keys", [0, 1_000_000])
def test_largest_id_stays(spark, broadcast_keys):
    docs = documents(spark, ["a", "b", "a", "", None, "a" * 70 + "x", "a" * 70 + "y", "a" * 70 + "x"])
    got = {r.doc_id: r for r in exact_dedup(docs, broadcast_keys=broadcast_keys).collect()}
    assert {i: r.keep_id for i, r in got.items()} == {1: 3, 2: 2, 3: 3, 4: 5, 5: 5, 6: 8, 7: 7, 8: 8}
    assert [i for i, r in sorted(got.items()) if r.kept] == [2, 3, 5, 7, 8]
    assert got[1].group_size == 2 and got[2].group_size == 1
    assert got[2].text_sha256 == hashlib.sha256(b"b").hexdigest() and got[5].text_sha256 == hashlib.sha256(b"").hexdigest()


def test_odd_rows(odd, empty):
    got = exact_dedup(odd).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].keep_id == 2 and by[4][0].keep_id == 5
    assert [(r.group_size, r.kept) for r in by[6]] == [(2, True)] * 2
    assert [(r.keep_id, r.group_size, r.kept) for r in by[None]] == [(None, 2, True)] * 2
    assert exact_dedup(empty).count() == 0


def test_query_matches_sql(spark, sf_dir):
    oracle.assert_same(queries.op7_exact_dedup(spark, sf_dir), oracle.tables(sf_dir), queries.OP7_SQL)
