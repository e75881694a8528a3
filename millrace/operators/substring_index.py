"""A stored n-gram index for substrings: which documents hold a text, without reading the others.

Every place of a folded text begins a gram of three characters (the end is
padded), and a row of the postings holds a gram's documents of one block.  A
needle is looked up by its rarest grams: their documents are intersected block
by block, and what is left is compared with the text itself.  A needle shorter
than a gram is looked up by the grams that begin with it.  Folding lowers case
character by character, so one index serves searches that heed case and searches
that don't; both are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ranking import top_k
from millrace.session import new_folder, shuffles_dropped, written

GRAM = 3
#: Documents and grams of a block at most (a document is never cut).
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
#: Needles compared with a text in one row.
TOGETHER = 4096
_PAD = "\0" * GRAM
_POSTINGS = "gram string, block bigint, ids array<bigint>, n int"


def fold(text: str) -> str:
    """Lower case of each character by itself: a text's folded parts are the parts of the folded text."""
    return text.lower().replace("ς", "σ")


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _codes(text: str) -> np.ndarray:
    """The grams of a text, each once and in order, as numbers: 21 bits a character."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    n = max(0, len(points) - GRAM + 1)
    found = np.zeros(n, np.int64)
    for i in range(GRAM):
        found = found << 21 | points[i : i + n]
    found.sort()
    return found[np.append(True, found[1:] != found[:-1])] if n else found


def _name(code: int) -> str:
    return "".join(chr(code >> 21 * i & 0x1FFFFF) for i in reversed(range(GRAM)))


def _blocks(segment: int):
    """id, text -> postings of each block of the partition's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = segment << 44 | TaskContext.get().partitionId() << 22
        names: dict[int, str] = {}
        ids: list[int] = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            codes, owner = np.concatenate(held), np.repeat(np.array(ids, np.int64), [len(h) for h in held])
            order = np.argsort(codes, kind="stable")
            codes, owner = codes[order], owner[order]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            cuts = np.append(first, len(codes)).astype(np.int32)
            if len(names) > 1 << 18:
                names.clear()
            grams = [names.get(c) or names.setdefault(c, _name(c)) for c in codes[first].tolist()]
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(owner))
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.full(len(grams), block)), lists, pa.array(np.diff(cuts))], names=["gram", "block", "ids", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = _codes(fold(text.as_py()) + _PAD)
                ids.append(i)
                held.append(found)
                total += len(found)
                if len(ids) >= BLOCK or total >= BLOCK_GRAMS:
                    yield flush()
                    block += 1
                    ids, held, total = [], [], 0
        if held:
            yield flush()

    return run


def _holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, lower case of the text, list of (nid, needle, whether the lower case is meant) -> id and the nids of needles that it holds."""
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            lists = batch.column(3)
            flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            texts, lower = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [needle in (lower if either else texts)[at] for at, needle, either in zip(owner.tolist(), flat.field(1).to_pylist(), flat.field(2).to_pylist())]
            mask = np.array(found, bool)
            cuts = np.append(0, np.cumsum(np.bincount(owner[mask], minlength=len(lists)))).astype(np.int32)
            nids = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.field(0).to_numpy()[mask]))
            yield pa.RecordBatch.from_arrays([batch.column(0), nids], names=["id", "nids"])


def _needles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """nid, needle -> a row for each gram, or the beginning of grams (``short``) that stands for a short needle."""
    for batch in batches:
        rows: list[tuple[int, str, bool]] = []
        for nid, needle in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            folded = fold(needle)
            if len(folded) >= GRAM:
                rows += [(nid, g, False) for g in sorted(grams(folded))]
            else:  # every text holds the pad, and nothing
                rows.append((nid, folded or _PAD, bool(folded)))
        columns = zip(*rows) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.bool_()))], names=["nid", "gram", "short"])


class SubstringIndex:
    """Postings of documents in segments under one folder; documents are read once, when they are added."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, (root or new_folder(spark, "substring-index")).rstrip("/")

    def _segments(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if fs.exists(done(f"{s.getPath()}/_SUCCESS")))

    def postings(self) -> DataFrame:
        paths = [f"{self.root}/{s}" for s in self._segments()]
        return self.spark.read.schema(_POSTINGS).parquet(*paths) if paths else self.spark.createDataFrame([], _POSTINGS)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SubstringIndex:
        """Index ``docs`` (ids whole numbers, not null) as a further segment; null texts hold nothing and are left out.

        Rows of one id are one document to the index.  Postings are dealt out
        by ranges of gram and block and sorted, so a gram that every document
        has is spread over files, and readers of some grams skip row groups.
        A segment counts once it is whole.
        """
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
        name = f"{len(self._segments()):06d}-{uuid.uuid4().hex[:8]}"
        made = new_folder(self.spark, "grams")
        rows.mapInArrow(_blocks(int(name[:6])), _POSTINGS).write.parquet(made)
        with shuffles_dropped(self.spark):
            self.spark.read.schema(_POSTINGS).parquet(made).repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{self.root}/{name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self

    def candidates(self, needles: DataFrame, rarest: int = 4) -> DataFrame:
        """(nid, id): documents that hold the ``rarest`` grams of a needle (nid, needle), or one that begins with a short one."""
        wanted = written(needles.select("nid", "needle").mapInArrow(_needles, "nid bigint, gram string, short boolean"), "needle-grams")
        postings = self.postings()
        whole = wanted.where("NOT short")
        df = postings.select("gram", "n").join(whole.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("df"))
        # a gram that no document has comes first, and its needle is nowhere
        chosen = top_k(whole.join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))), rarest, [F.asc("df"), F.asc("gram")], query="nid")
        chosen = written(chosen.select("nid", "gram", "df"), "rarest-grams")
        need = chosen.groupBy("nid").agg(F.count(F.lit(1)).alias("need"), F.min("df").alias("least")).where("least > 0").select("nid", "need")
        # at most ``rarest`` lists of a block's documents meet in a group
        lists = postings.select("gram", "block", "ids").join(chosen.join(need, "nid").select("nid", "gram", "need"), "gram")
        both = lists.groupBy("nid", "block").agg(F.collect_list("ids").alias("lists"), F.first("need").alias("need")).where(F.size("lists") == F.col("need"))
        met = F.aggregate(F.slice("lists", 2, rarest), F.array_distinct(F.col("lists")[0]), lambda a, b: F.array_intersect(a, b))
        long = both.select("nid", F.explode(met).alias("id"))
        short = wanted.where("short").select("nid", F.col("gram").alias("start"))
        begins = postings.select("gram").distinct().select("gram", F.explode(F.array(*(F.left("gram", F.lit(n)) for n in range(1, GRAM)))).alias("start"))
        few = postings.select("gram", "ids").join(begins.join(short, "start").select("nid", "gram"), "gram")
        return long.unionByName(few.select("nid", F.explode("ids").alias("id")).distinct())

    def search(self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "item", ignore_case: bool | Column = False, rarest: int = 4) -> DataFrame:
        """(item id, id) for each item and row of the indexed ``docs`` whose text holds the item's text; exact.

        ``ignore_case`` may differ by item, as a column of ``items``.  Equal
        items are looked up once, and texts meet their candidates once for all
        items.  An empty item is in every text, a null
        item and a null text in none.  Jobs run when this is called.
        """
        either = F.coalesce(F.lit(ignore_case) if isinstance(ignore_case, bool) else ignore_case, F.lit(False))
        named = items.select(F.col(item_col), F.col(item_text).alias("needle"), either.alias("__either"))
        distinct = named.where("needle IS NOT NULL").select("needle", "__either").distinct()
        needles = written(distinct.withColumn("nid", F.monotonically_increasing_id()), "needles")
        with shuffles_dropped(self.spark):
            found = written(self.candidates(needles, rarest), "substring-candidates")
        # a text meets its candidates once, in groups of so many needles at most on average, and its lower case is made once for each
        groups = max(1, -(-needles.count() // TOGETHER))
        meant = F.struct("nid", F.when(F.col("__either"), F.lower("needle")).otherwise(F.col("needle")).alias("needle"), F.col("__either").alias("either"))
        together = found.join(needles, "nid").groupBy(F.col("id").alias("__doc"), F.pmod(F.xxhash64("nid"), F.lit(groups)).alias("__group")).agg(F.collect_list(meant).alias("__needles"))
        texts = docs.select(F.col(id_col).alias("__id"), F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("__text")).where("__text IS NOT NULL")
        lower = F.when(F.exists("__needles", lambda n: n["either"]), F.lower("__text"))
        met = texts.join(together, "__doc").select(F.col("__id").alias("id"), "__text", lower.alias("__lower"), "__needles")
        held = met.mapInArrow(_holds, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("nids", T.ArrayType(T.LongType()))]))
        held = held.select(F.col("id").alias("__id"), F.explode("nids").alias("nid"))
        return named.join(needles, ["needle", "__either"]).select(item_col, "nid").join(held, "nid").select(item_col, F.col("__id").alias(id_col))
