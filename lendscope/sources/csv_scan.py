"""Quoted CSV read by byte ranges, and a quarantine for what is no record (A1, A2).

A quoted field may hold line breaks, so a range of a file may begin inside a
record. Two passes over the lines settle this without reading any file whole:

1. What a line does to the state (inside or outside quotes) is one of four
   functions, found by built-in text functions: it keeps the state, turns it
   round, or leads outside or inside whatever it was. Each range is folded into
   one such function, and a prefix scan over a file's ranges says in which
   state each range begins. (Where quotes only open and close fields this is
   the parity of their number; the four functions also cover quotes that stand
   inside unquoted fields, which are plain text.)
2. Each task joins the lines of its range into records. A record that
   crosses ranges leaves them in parts, and only such parts are shuffled.

Records are then split into fields by Spark's CSV functions. Those with
another number of fields than the header, or with a quote that never closes,
go to the rejects with file and line, whole; so do single values that can't be
cast, while their row stays. Both passes run at once, under one setting of the
ranges, and the rows are stored as a table in the shared folder.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import joins

#: What a line does to the state: keep it, turn it round, lead outside, lead inside quotes.
KEEP, TURN, OUT, IN = range(4)
#: The state after a line, by (function, whether it was inside).
AFTER = {(KEEP, False): False, (KEEP, True): True, (TURN, False): True, (TURN, True): False,
         (OUT, False): False, (OUT, True): False, (IN, False): True, (IN, True): True}
PER_TASK = "spark.sql.files.minPartitionNum"


@dataclass
class CsvTable:
    """``rows``: typed columns, and ``rejects`` (map of column to text that can't
    be cast). ``rejects``: (file, line, column_name, value, reason), with a
    null column_name and the whole record as value where the record is malformed."""

    rows: DataFrame
    rejects: DataFrame


def _without_pairs(line: Column) -> Column:
    """Doubled quotes change nothing outside or inside quotes."""
    return F.replace(line, F.lit('""'), F.lit(""))


def _unquoted(text: Column) -> Column:
    """A text without its whole quoted fields; ``text`` has no doubled quotes."""
    return F.regexp_replace(text, r'(^|,)"[^"]*+"', "$1")


def _opens(text: Column) -> Column:
    """Whether a text that begins at a field ends inside quotes."""
    return F.contains(text, F.lit('"')) & _unquoted(text).rlike(r'(^|,)"')


def line_function(line: Column) -> Column:
    """KEEP, TURN, OUT or IN."""
    bare = _without_pairs(line)
    at = F.locate('"', bare)
    outside = ~_opens(bare)
    # From inside, the first quote closes the field; what follows goes on an unquoted one.
    inside = ~_opens(F.concat(F.lit("x"), F.substring(bare, at + 1, F.length(bare))))
    both = F.when(outside & inside, OUT).when(outside, KEEP).when(inside, TURN).otherwise(IN)
    return F.when(F.contains(line, F.lit('"')), F.when(at > 0, both).otherwise(KEEP)).otherwise(KEEP).cast("int")


def field_count(record: Column) -> Column:
    """The number of fields of a record that ends outside quotes."""
    bare = F.when(F.contains(record, F.lit('"')), _unquoted(_without_pairs(record))).otherwise(record)
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


@contextmanager
def _same_ranges(spark: SparkSession) -> Iterator[None]:
    """Files are cut into the same ranges by every job run inside, also while executors come and go."""
    before = spark.conf.get(PER_TASK, None)
    if before is None:
        spark.conf.set(PER_TASK, spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PER_TASK)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(fid, block, function, line) in the order of each range; fid stands for the file's path."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.file_block_start").alias("block"),
                        line_function(F.col("value")).alias("function"), F.col("value").alias("line"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(fid, file); no content is read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    return files.select(F.xxhash64("file").alias("fid"), "file")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: its function, its number of lines, whether a record that it begins inside ends in it."""
    at, state, n, ends = None, (False, True), 0, False

    def done() -> pa.RecordBatch:
        function = next(k for k in range(4) if (AFTER[k, False], AFTER[k, True]) == state)
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([function], pa.int32()),
                                           pa.array([n], pa.int64()), pa.array([ends])], names=["fid", "block", "function", "lines", "ends"])

    for batch in batches:
        for a, b in _stretches(batch):
            key = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
            if key != at:
                if at is not None:
                    yield done()
                at, state, n, ends = key, (False, True), 0, False
            functions = batch.column(2).slice(a, b - a).to_numpy()
            for k in functions[functions != KEEP].tolist():
                state = (AFTER[k, state[0]], AFTER[k, state[1]])
                ends = ends or k in (TURN, OUT)
            n += b - a
    if at is not None:
        yield done()


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Stretches of a batch that lie in one range of one file."""
    if not batch.num_rows:
        return
    fid, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cuts = ((fid[1:] != fid[:-1]) | (block[1:] != block[:-1])).nonzero()[0] + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    yield from zip(edges, edges[1:])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the sorted ranges of files: the lines before each, and where the record began that it begins inside."""
    fid, inside, owner, before = None, False, None, 0
    for batch in batches:
        starts, owners = [], []
        for f, block, function, lines, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if f != fid:
                fid, inside, owner, before = f, False, None, 0
            starts.append(before)
            owners.append(owner if inside else None)
            if not inside or ends:  # a record that is open at its end began in it
                owner = block
            inside, before = AFTER[function, inside], before + lines
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int64()), pa.array(owners, pa.int64())],
                                         names=["fid", "block", "before", "owner"])


def _records(lines: DataFrame, owners: dict[tuple[int, int], int]) -> DataFrame:
    """(fid, block, line, owner, head, text): records, and, with an owner, the
    parts of records that cross ranges. ``line`` counts lines within the range."""
    names = ["fid", "block", "line", "owner", "head", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, first, opened, held, owner = (0, 0), 0, 0, False, [], None

        def row(text: str, to: int | None) -> tuple:
            return (*at, first, to, at[1] == 0 and first == 0, text)

        for batch in batches:
            out: list[tuple] = []
            for a, b in _stretches(batch):
                key = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if key != at or n == 0:
                    if held:
                        out.append(row("\n".join(held), at[1] if owner is None else owner))
                    at, n, first, held = key, 0, 0, []
                    owner = owners.get(key)
                    opened = owner is not None
                functions, texts = batch.column(2).slice(a, b - a).to_numpy(), batch.column(3).slice(a, b - a)
                i = 0
                for j in [*functions.nonzero()[0].tolist(), b - a]:  # the lines before j keep the state
                    if opened:
                        held += texts.slice(i, j - i).to_pylist()
                    else:
                        for k, text in enumerate(texts.slice(i, j - i).to_pylist()):
                            first = n + i + k
                            out.append(row(text, None))
                    if j == b - a:
                        break
                    if not opened:
                        first = n + j
                    held.append(texts[j].as_py())
                    opened = AFTER[int(functions[j]), opened]
                    if not opened:
                        out.append(row("\n".join(held), owner))
                        held, owner = [], None
                    i = j + 1
                n += b - a
            yield _table(out, names)
        if held:
            yield _table([row("\n".join(held), at[1] if owner is None else owner)], names)

    return lines.mapInArrow(run, "fid long, block long, line long, owner long, head boolean, text string")


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fid, block, line, head, text) of every record, and the stored ranges (fid, block, before).

    The records are to be computed inside ``_same_ranges``.
    """
    lines = _lines(spark, path)
    folded = lines.drop("line").mapInArrow(_fold, "fid long, block long, function int, lines long, ends boolean")
    folded = folded.repartition("fid").sortWithinPartitions("fid", "block")
    ranges = joins.stored(folded.mapInArrow(_scan, "fid long, block long, before long, owner long"), "csv-ranges")
    # Ranges that begin inside quotes: no more than the scan has tasks, which the driver lists anyway.
    owners = {(r.fid, r.block): r.owner for r in ranges.where("owner is not null").collect()}
    found = _records(lines, owners)
    if owners:
        found = joins.stored(found, "csv-records")
        parts = F.array_sort(F.collect_list(F.struct("block", "line", "text", "head")))
        across = found.where("owner is not null").groupBy("fid", "owner").agg(parts.alias("p"))
        across = across.select("fid", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["line"].alias("line"), F.col("p")[0]["head"].alias("head"),
                               F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
        found = found.where("owner is null").drop("owner").unionByName(across)
    else:
        # What is open at the end of a file stays with its range.
        found = found.drop("owner")
    return found.withColumn("text", F.regexp_replace("text", r"\r\z", "")), ranges


def read_csv(spark: SparkSession, path: str, schema: T.StructType, typed: dict[str, tuple[Column, Column]]) -> CsvTable:
    """The records of all files under ``path`` (each with the header of ``schema``).

    ``typed`` has, for each output column, its value and the text it is read
    from. The text is an expression over columns that are named as in
    ``schema`` and hold text; the value is one over the text, which then has
    the output column's name. Blank lines are skipped; a header that names
    other columns raises ``ValueError``.
    """
    names = schema.fieldNames()
    strings = ", ".join(f"`{n}` string" for n in names)
    with _same_ranges(spark):
        records, ranges = read_records(spark, path)
        records = records.where(F.trim(F.regexp_replace("text", r"[\t\r]", "")) != "")
        text = F.col("text")
        reason = F.when(_opens(_without_pairs(text)), "open quote").when(field_count(text) != len(names), F.concat(field_count(text).cast("string"), F.lit(" fields")))
        place = F.struct("fid", "block", "line", "head", reason.alias("reason")).alias("__at")  # beside columns of any name
        rows = records.select(place, text.alias("__record"), F.from_csv(text, strings, {"escape": '"', "quote": '"', "inputBufferSize": "4096"}).alias("__fields"))
        # Texts, values and rejects are made one after the other, so that no text is cleaned and no value is read twice.
        rows = rows.select("__at", "__record", "__fields.*")
        rows = rows.select("__at", "__record", *(source.alias(c) for c, (_, source) in typed.items()))
        texts = F.struct(*(F.col(f"`{c}`") for c in typed)).alias("__texts")
        rows = rows.select("__at", "__record", texts, F.struct(*(value.alias(c) for c, (value, _) in typed.items())).alias("__row"))
        bad = [F.struct(F.lit(c).alias("key"), F.when(F.col("__row")[c].isNull(), F.col("__texts")[c]).alias("value")) for c in typed]
        rejects = F.map_from_entries(F.filter(F.array(*bad), lambda e: e["value"].isNotNull()))
        kept = F.when(F.col("__at.reason").isNotNull() | F.col("__at.head"), F.col("__record"))
        rows = rows.select("__at.*", kept.alias("record"), F.col("__row").alias("row"), rejects.alias("rejects"))
        rows = joins.stored(rows, "csv-rows")
    for found in rows.where("head").select("record").distinct().limit(100).collect():
        header = next(csv.reader([found[0]]), [])
        if header != names:
            raise ValueError(f"a header names {header}, not {names}")
    rows = rows.where("not head")
    place = ranges.select(F.col("fid").alias("f"), F.col("block").alias("b"), "before")
    files = _files(spark, path).select(F.col("fid").alias("f2"), "file")
    cells = rows.where("reason is null and size(rejects) > 0").select("fid", "block", "line", F.explode("rejects").alias("column_name", "value"), F.lit("type").alias("reason"))
    whole = rows.where("reason is not null").select("fid", "block", "line", F.lit(None).cast("string").alias("column_name"), F.col("record").alias("value"), "reason")
    lost = cells.unionByName(whole)
    lost = lost.join(place, (lost.fid == place.f) & (lost.block == place.b)).join(files, F.col("fid") == F.col("f2"))
    lost = lost.select("file", (F.col("before") + F.col("line") + 1).alias("line"), "column_name", "value", "reason")
    good = rows.where("reason is null")
    return CsvTable(good.select("row.*", F.col("rejects").alias("rejects")), lost)
