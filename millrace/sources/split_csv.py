"""CSV files with quoted line breaks, read by many tasks a file.

Spark's own reader gives such a file to one task, since no byte range says by
itself whether it begins within quotes.  Here Spark's text reader splits files
into ranges of whole lines.  A first pass finds, for each range, whether it ends
within quotes if it begins outside of them and if it begins within (two bits);
followed from range to range that tells how every range begins.  The second pass
puts lines together to records.  A record that goes on in the next range is sent
there in pieces, and joined by the range in which it began.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import ship

#: Lines taken from a batch at once; records and characters of a batch that is given out.
LINES, RECORDS, CHARACTERS = 256, 4096, 1 << 22
_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')
_CLOSED = re.compile(r'"[\x00-\x20]*(?=,|$)')


def ends_within(line: str, within: bool) -> bool:
    """Whether a line that begins at a field (or within quotes) ends within quotes.

    A quote opens only at a field's beginning and closes before a comma or the
    line's end; after any other quote in a quoted field the field is taken as
    unquoted up to the next comma or the line's end.
    """
    if '"' not in line:
        return within
    at, n = 0, len(line)
    while True:
        if within:
            at = _QUOTED.match(line, at).end()
            if at >= n:
                return True
            closed = _CLOSED.match(line, at)
            at = line.find(",", closed.end() if closed else at)
            within = False
        elif at < n and line[at] == '"':
            within, at = True, at + 1
            continue
        else:
            at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """(file, start) and its lines, for one range after the other."""
    seen = None
    for batch in batches:
        # a few lines at once as Python's strings: a batch counts rows, and lines may be long
        for at in range(0, batch.num_rows, LINES):
            few = batch.slice(at, LINES)
            for file, start, line in zip(*(few.column(i).to_pylist() for i in range(3))):
                if (file, start) != seen:
                    seen = (file, start)
                    yield seen, None
                yield None, line


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, line -> for each range how it ends if it begins outside of quotes, and within, and whether in the latter case a record ends in it."""
    found: list[list] = []
    for place, line in _ranges(batches):
        if place:
            found.append([*place, False, True, False])
        else:
            outside, within = found[-1][2:4]
            found[-1][2] = ends_within(line, outside)
            found[-1][3] = found[-1][2] if outside == within else ends_within(line, within)
            found[-1][4] |= not found[-1][3]
    columns = zip(*found) if found else [()] * 5
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "outside", "within", "closes"])


_PIECE = "file string, owner int, part int, at bigint, whole boolean, text string"


def _records(ranges: dict[tuple[str, int], tuple[int, int | None]]):
    """file, start, line -> records and pieces of records (file, the range that a record began in, the piece's range, place, whole, text).

    ``ranges`` has each range's number and, if it begins within quotes, the
    range in which that record began.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        file, number, owner, at, lines, within = "", 0, None, 0, [], False

        def flush(goes_on: bool) -> None:
            nonlocal at, lines, owner, size
            if lines:
                begun = number if owner is None else owner
                out.append((file, begun, number, begun << 33 | (at if owner is None else (1 << 33) - 1), owner is None and not goes_on, "\n".join(lines)))
                at, size = at + 1, size + len(out[-1][5])
            lines, owner = [], None

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names=["file", "owner", "part", "at", "whole", "text"])

        for place, line in _ranges(batches):
            if place:
                flush(within)
                file = place[0]
                number, owner = ranges[place]
                at, within = 0, owner is not None
                continue
            lines.append(line)
            within = ends_within(line, within)
            if not within:
                flush(False)
                if len(out) >= RECORDS or size >= CHARACTERS:
                    yield batch_of()
                    out.clear()
                    size = 0
        flush(within)
        yield batch_of()

    return run


def _parsed(records: DataFrame, names: list[str]) -> DataFrame:
    """Records (file, at, text) as columns; empty ones and the first of each file are left out.

    Where a file's first line ends in ``\\r\\n``, so do all, and line breaks within quotes become ``\\n``.
    """
    held = records.where(~F.col("text").isin("", "\r"))
    heads = held.groupBy("file").agg(F.min("at").alias("head"), F.min_by(F.endswith(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("\r")), "at").alias("crlf"))
    rows = held.join(F.broadcast(heads), "file").where("at > head")  # a row for each file
    plain = F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\r$", "")
    rows = rows.select("file", "at", F.when(F.col("crlf"), plain).otherwise(F.col("text")).alias("text"))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    parsed = rows.select("file", "at", F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), _OPTIONS | {"lineSep": "\x00"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], F.struct("file", "at").alias("_row"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files with a header, as strings, and ``_row`` (file, at), which orders them as they are in the files.

    Fields are separated by commas and may be quoted, with line breaks and
    doubled quotes within; lines end in ``\\n`` or ``\\r\\n``.  Rows with too few
    fields end in nulls, what is too much is left out, empty lines are skipped;
    names are those of the first file's header, and the first record of every
    file is its header.  A record that quotes never close goes on to the end of
    its file.

    Files are split as Spark splits text (``spark.sql.files.maxPartitionBytes``)
    and read twice; a row for each range passes through the driver between the
    passes.  A job runs when this is called.
    """
    ship(spark)
    names = spark.read.csv(path, header=True, multiLine=True, **_OPTIONS).columns
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    ranges: dict[tuple[str, int], tuple[int, int | None]] = {}
    before, within, owner, number = None, False, None, 0
    for r in sorted(lines.mapInArrow(_ends, "file string, start bigint, outside boolean, within boolean, closes boolean").collect(), key=lambda r: (r["file"], r["start"])):
        number = number + 1 if r["file"] == before else 0
        if r["file"] != before:
            within, owner = False, None
        ranges[r["file"], r["start"]] = (number, owner if within else None)
        # a record that goes on beyond this range began here, unless all of the range is within one from before
        after = r["within"] if within else r["outside"]
        owner = (number if not within or r["closes"] else owner) if after else None
        before, within = r["file"], after
    pieces = lines.mapInArrow(_records(ranges), _PIECE)
    joined = pieces.where("NOT whole").groupBy("file", "owner").agg(F.max("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "\n").alias("text"))
    records = pieces.where("whole").select("file", "at", "text").unionByName(joined.select("file", "at", "text"))
    return _parsed(records, names)
