from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import documents

from millrace.llm import queries
from millrace.llm.merkle import fold, folded, leaf, manifest
from millrace.llm.ranking import rank_table
from millrace.llm.common import materialize
from tests import oracle


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def build(nodes: list[str], fanout: int) -> tuple[str, list[list[str]]]:
    """The root and each node's siblings, a level at a time."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(at):
            first = i // fanout * fanout
            paths[j] += [n for k, n in enumerate(nodes[first : first + fanout], first) if k != i]
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def plain(rows: list[dict], fanout: int = 2) -> list[tuple]:
    def one(r, more=0):
        values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, one(r), one(r, 1), r["doc_id"]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: build([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, upper = build([trees[g][0] for g in order], fanout)
    out = []
    for g, above in zip(order, upper):
        for x, path in zip(sorted(groups[g]), trees[g][1]):
            broken = x[4] is not None and zlib.crc32(str(x[4]).encode()) % 7 == 0 and x[3] != x[2]
            out.append((x[4], x[2], trees[g][0], root, h(*path, *above), not broken))
    return out


def got(df) -> list[tuple]:
    rows = df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "verified", (F.col("folded_root") == F.col("root")).alias("same")).collect()
    assert all(r.verified == r.same for r in rows)
    return [tuple(r)[:6] for r in rows]


def order(rows):
    return sorted(rows, key=str)


def test_query_matches_sql(spark, sf_dir):
    oracle.assert_same(queries.op11_merkle(spark, sf_dir), oracle.tables(sf_dir), queries.OP11_SQL)


def saved(df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_odd_rows(spark, odd, empty, tmp_path):
    found = queries.op11_merkle(spark, saved(odd, tmp_path / "a"))
    assert order(got(found)) == order(plain([r.asDict() for r in odd.collect()]))
    assert queries.op11_merkle(spark, saved(empty, tmp_path / "b")).count() == 0
    most = documents(spark, ["x"] * 60).withColumn("n_chars", F.lit(2**63 - 1))
    assert order(got(queries.op11_merkle(spark, saved(most, tmp_path / "c")))) == order(plain([r.asDict() for r in most.collect()]))


@pytest.mark.parametrize("fanout, levels, n", [(2, 2, 1), (2, 2, 4), (2, 2, 31), (3, 1, 9), (5, 2, 26)])
def test_superblocks_of_any_size(spark, fanout, levels, n):
    """Superblocks of a few rows, so that there are several rounds; groups of one row, of one block and of many."""
    rows = [(i, f"t{i}", g, "s", i) for g, k in (("b", n), (None, 1), ("a", 4)) for i in range(k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    found = manifest(docs.withColumn("leaf", leaf(*values)), "lang", "doc_id", "leaf", fanout=fanout, levels=levels)
    found = folded(found, "leaf").collect()
    wanted = plain([dict(zip(docs.columns, r)) for r in rows], fanout)
    assert order((r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), h(r.siblings.hex())) for r in found) == order(w[:5] for w in wanted)
    assert all(r.folded_root == r.root == fold(r.leaf, r.siblings, r.counts) for r in found)
    assert sorted(r["at"] for r in found if r.lang == "b") == list(range(n))


def test_ranks_of_a_key_over_many_partitions(spark):
    """A third of the rows share a key, and so do the last and first rows of neighbouring partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        values = [7 if i % 3 == 0 else i // 5 for i in range(900)]
        rows = materialize(spark.createDataFrame(list(enumerate(values)), "i long, k long"), "test")
        told = {r["i"]: r for r in rank_table(rows, ["k"], ["i"], "test").collect()}
        some = {r["i"]: r for r in rank_table(rows, ["k"], ["i"], "test", drop_alone=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted(range(900), key=lambda i: (values[i], i))
    keys = sorted(values)
    for place, i in enumerate(ordered):
        assert (told[i].place, told[i]["first"], told[i].alone) == (place, keys.index(values[i]), values.count(values[i]) == 1)
        assert (i in some) == (not told[i].alone) and some.get(i, told[i])[:4] == told[i][:4]
