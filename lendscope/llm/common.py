"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.sources.tables import load_table

#: What the contracts call a word; ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names.

    ``spark.checkpoint.dir`` decides. A temporary folder is set only where
    that is unset and the session is a single local process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; set it to a folder all machines share")
        base = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage
    is cut, and what a lost executor held is read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application: models are pickled
    with a reference to their class. Spark distributes the file; nothing else
    reads where the driver makes it. A package that lies in an archive was
    given to Spark as one, so the executors have it."""
    app = spark.sparkContext.applicationId
    top = Path(__file__).resolve().parent.parent
    if app in _SHIPPED or not top.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="llm-package-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def share(spark: SparkSession, model: object) -> Broadcast:
    """Broadcast a model of bounded size to executors that need not have this package."""
    ship_package(spark)
    return spark.sparkContext.broadcast(model)


def raw(col: str | Column) -> Column:
    """UTF-8 bytes of a text; empty for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("binary"), F.lit(b""))


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def free_name(taken: list[str], name: str) -> str:
    """``name``, or with underscores before it until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in the jobs run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text is alone."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, train: Column | None = None,
                    text: str = "text", longest: int = 200_000) -> DataFrame:
    """(doc_id, raw, y): at most ``per_class`` documents of either label, each
    of at most ``longest`` bytes, so that the sample has a bound in bytes too.

    The rows with the smallest hash of their id are taken, so the sample is
    the same on every run. ``train`` restricts the ids. A document id with
    several labels has the largest; null ids and labels are left out. The
    bound holds also where one id has many rows: the joined rows are cut again.
    """
    lab = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if train is not None:
        lab = lab.where(train)
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y"))
    d = docs.select("doc_id", raw(text).alias("raw")).where(F.length("raw") <= longest)
    out = None
    for y in (0, 1):
        few = lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        rows = d.join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("raw")).limit(per_class)
        out = rows if out is None else out.unionByName(rows)
    return out


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents")
