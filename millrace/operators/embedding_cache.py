"""An embedding cache as a table: vectors by key in a shared folder, grown by batches of what is missing.

Misses are found by a join of keys alone; the texts of misses are read in a
second pass, so known texts are never shuffled.  Misses are dealt into rounds by
their key, and each round's vectors are a folder of their own that counts once
it is whole: a run that is interrupted loses the round it was in, and the next
one embeds only that and what follows.  A model is made once per worker process
from a factory and kept there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators.models import Embedder
from millrace.session import written

_ROWS = "cache_key string, embedding array<double>"
#: Models of this worker process by cache folder, model name and factory.
_MODELS: dict[tuple[str, str, str], Embedder] = {}


def _model(root: str, name: str, make: Callable[[], Embedder]) -> Embedder:
    made = (root, name, f"{getattr(make, '__module__', '')}.{getattr(make, '__qualname__', repr(make))}")
    if made not in _MODELS:
        _MODELS[made] = make()
    return _MODELS[made]


class EmbeddingCache:
    """Vectors of one model, by the key of the text, under one folder.

    Parts are only ever added.  Two runs at once may both add a key; a lookup
    takes one of them, so this costs work but never a row.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, kind: str = "dense") -> None:
        self.spark, self.root, self.name, self.kind = spark, root.rstrip("/"), name, kind

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _parts(self) -> list[str]:
        fs, root = self._fs(f"{self.root}/parts")
        if not fs.exists(root):
            return []
        found = sorted(s.getPath().getName() for s in fs.listStatus(root))
        return [n for n in found if fs.exists(self._fs(f"{self.root}/parts/{n}/_SUCCESS")[1])]

    def table(self) -> DataFrame:
        """cache_key, embedding of every part that is whole."""
        paths = [f"{self.root}/parts/{n}" for n in self._parts()]
        return self.spark.read.schema(_ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], _ROWS)

    def _keyed(self, docs: DataFrame, text_col: str) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        return docs.withColumn("cache_key", tx.cache_key(text, F.lit(self.kind), F.lit(self.name)))

    def misses(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """cache_key of each distinct text of ``docs`` that the cache doesn't hold; null counts as empty."""
        return self._keyed(docs.select(text_col), text_col).select("cache_key").distinct().join(self.table().select("cache_key"), "cache_key", "left_anti")

    def fill(self, docs: DataFrame, make: Callable[[], Embedder], text_col: str = "text", rounds: int = 8, batch: int = 32, retries: int = 3) -> int:
        """Embed the distinct texts of ``docs`` that are missing; how many vectors were added.

        The model sees at most ``batch`` texts at once, each distinct text once.
        A batch that fails ``retries`` times is left out and is missing as
        before, so the next run tries it again.  Rounds without misses are not run.
        """
        rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
        missing = written(self.misses(docs, text_col).withColumn("round", F.pmod(F.xxhash64("cache_key"), F.lit(rounds)).cast("int")), "misses")
        todo = sorted(r[0] for r in missing.select("round").distinct().collect())  # at most ``rounds``
        if not todo:
            return 0
        # of the rows with one text the first is read again, by its key and without the others
        texts = self._keyed(rows, "text").join(missing, "cache_key").groupBy("cache_key").agg(F.min("round").alias("round"), F.any_value("text").alias("text"))
        texts = written(texts, "missing-texts")
        root, name = self.root, self.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = None
            for held in batches:
                for at in range(0, held.num_rows, batch):
                    part = held.slice(at, batch)
                    model = model or _model(root, name, make)
                    for _ in range(retries):
                        try:
                            vectors = pa.array(model(part.column(1).to_pylist()), pa.list_(pa.float64()))
                        except Exception:  # a provider may fail in any way; what it never gives stays missing
                            continue
                        yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=["cache_key", "embedding"])
                        break

        added = 0
        for n in todo:
            path = f"{self.root}/parts/{uuid.uuid4().hex}"
            texts.where(F.col("round") == n).select("cache_key", "text").mapInArrow(run, _ROWS).write.parquet(path)
            added += self.spark.read.schema(_ROWS).parquet(path).count()
        return added

    def lookup(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with cache_key and embedding; null where the cache has none."""
        known = self.table().groupBy("cache_key").agg(F.any_value("embedding").alias("embedding"))
        return self._keyed(docs, text_col).join(known, "cache_key", "left")

    def compact(self, files: int = 8) -> int:
        """Write all vectors as one part, each key once, and remove the parts it replaces; how many vectors there are.

        To be run while nothing else reads or fills the cache.
        """
        before = self._parts()
        path = f"{self.root}/parts/{uuid.uuid4().hex}"
        self.table().groupBy("cache_key").agg(F.any_value("embedding").alias("embedding")).repartitionByRange(files, "cache_key").write.parquet(path)
        for name in before:
            fs, p = self._fs(f"{self.root}/parts/{name}")
            fs.delete(p, True)
        return self.table().count()
