"""Text files on any file system that Spark reaches, and readers of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p, jvm = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """Writes beside the target, then renames, so that a reader never sees half a file."""
    fs, p, jvm = _path(spark, path)
    if fs.exists(p) and not overwrite:
        raise FileExistsError(f"File {path} exists and overwrite is not enabled")
    parent = p.getParent()
    if parent is not None:
        fs.mkdirs(parent)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.writing")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"could not rename {path}.writing")


def read_table(spark: SparkSession, path_or_table: str, kind: str = "parquet", **options: str) -> DataFrame:
    """Any source Spark knows: parquet, orc, json, csv (with a header), jdbc or a catalog table."""
    if kind == "table":
        return spark.table(path_or_table)
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options)
    return reader.load(path_or_table) if kind != "jdbc" else reader.option("dbtable", path_or_table).load()
