"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python: whole documents, so few at a time.
ARROW_ROWS = 256
#: Spark frees the shuffles of a query when it ends, if this holds.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What holds while a table is written. Spark broadcasts what it takes for small, by the size of rows or of compressed files;
#: in the driver that becomes many times as much, so that a few such joins fill its memory. F.broadcast() still holds.
WRITING = {CLEANUP: "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a local master (tests) gets a temporary folder; a
    cluster must name one, for its executors don't share local folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if not configured:
            if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside free their shuffle files as they end and broadcast nothing unasked; the session's own settings come back."""
    before = {key: spark.conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def give_back(spark: SparkSession) -> str:
    """Return to the system what malloc keeps of freed memory, in the driver's Python and in its JVM; says what the JVM gave.

    glibc keeps it for each of its many arenas, and Spark plans and reads with
    hundreds of threads: over the tables of one operator that is some 100 MB and
    more. Takes a few milliseconds; nothing happens where libc or the JVM
    doesn't have that call.
    """
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    lang, new = spark._jvm.java.lang, spark.sparkContext._gateway.new_array

    def array(kind, *items):  # what is not set is null
        made = new(kind, 4)
        for i, x in enumerate(items):
            made[i] = x
        return made

    try:  # by reflection, for the server's own class is not open to the gateway
        kinds = array(lang.Class, *map(lang.Class.forName, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        command = array(lang.Object, spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap")
        return lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), command)
    except Py4JError:
        return ""


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, whatever executors are lost.

    The table is compressed and read by column; the shuffles that made it are
    freed at once, and Spark broadcasts nothing unasked for it. It goes when the application ends, or by drop(). files: how
    many files to write, for tables that are known to be small.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    with shuffles_freed(spark):
        (df if files is None else df.coalesce(files)).write.parquet(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    give_back(spark)
    return out


def drop(table: DataFrame | None) -> None:
    """Delete a table made by cut() that nothing will read any more."""
    if table is not None and (path := getattr(table, "_table", None)):
        spark = table.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "dqengine.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for name in ("dqengine/__init__.py", *(str(p.relative_to(root)) for p in sorted((root / "dqengine" / "llm").glob("*.py")))):
            z.write(root / name, name)
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over small batches, so that a batch of long texts stays small."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(fn, schema)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores more as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or any(c.startswith(f"{name.lower()}_") for c in taken):
        name += "_"
    return name


def text_or_empty(name: str) -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(modulus)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str, text_col: str, keep: Column, per_class: int) -> DataFrame:
    """(_id, _t, _y, _share): at most per_class whole labelled texts of each class, the bound of what is learnt from.

    The bound holds for rows after the join with the documents: an id that many
    rows repeat counts once for each. Chosen by hashes of ids and texts, so that
    reruns agree; equal rows are one. _share is the class's share of all
    labelled ids. Rows with a null id, label or text are left out; an id
    labelled twice counts once (its largest label).
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).where(keep)
    ids = ids.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in ids.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [ids.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).where(F.col("_t").isNotNull())
    found = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "_id").withColumn("_o", F.xxhash64("_id", "_t"))  # 2 * per_class ids at most
    found = cut(found.dropDuplicates(["_id", "_o"]))
    # numbers alone are ranked, so that an id of very many rows sends no texts anywhere
    chosen = [found.where(F.col("_y") == y).select("_id", "_o").orderBy("_o", "_id").limit(per_class) for y in (0, 1)]
    share = F.when(F.col("_y") == 1, F.lit(counts.get(1, 0) / max(1, sum(counts.values())))).otherwise(F.lit(counts.get(0, 0) / max(1, sum(counts.values()))))
    return found.join(F.broadcast(chosen[0].unionByName(chosen[1])), ["_id", "_o"]).select("_id", "_t", "_y", share.alias("_share"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str, text_col: str, keep: Column, per_class: int, max_chars: int) -> tuple[list[str], list[int], float]:
    """The texts of labelled_rows(), their labels, and the share of label 1 among all labelled rows.

    max_chars bounds the characters of a class in all: a text that would go
    beyond it and those after it, in the order of their hashes, are not learnt from.
    """
    rows = labelled_rows(docs, labels, label, id_col=id_col, text_col=text_col, keep=keep, per_class=per_class)
    so_far = F.sum(F.length("_t")).over(Window.partitionBy("_y").orderBy(F.xxhash64("_id", "_t"), "_id"))
    found = rows.withColumn("_n", so_far).where(F.col("_n") <= max_chars).select("_id", "_t", "_y", "_share").collect()
    found.sort(key=lambda r: (str(r["_id"]), r["_t"]))
    share = next((r["_share"] if r["_y"] else 1 - r["_share"] for r in found), 0.5)
    return [r["_t"] for r in found], [r["_y"] for r in found], share
