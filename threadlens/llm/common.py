"""What the operators of this subpackage share: staged tables, table access and batching of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are worked on in slices of about this many bytes, so that a task's memory does not follow the batch size.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with underscores before it until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode may it be unset; it is a temporary one then."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='threadlens-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/threadlens/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage is cut, and a lost executor takes nothing with it."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files behind a table made by stage()."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/threadlens/" not in parent:
            raise ValueError(f"{parent} was not made by stage()")
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path behind a URI; schemes that pyarrow does not know itself are left to Hadoop's client library."""
    scheme, _, rest = uri.partition("://")
    if not rest or scheme in ("file", "s3", "gs", "hdfs", "abfs", "abfss"):
        return pafs.FileSystem.from_uri(uri)
    if scheme in ("s3a", "s3n"):
        return pafs.FileSystem.from_uri(f"s3://{rest}")
    host, _, path = rest.partition("/")
    return pafs.HadoopFileSystem(f"{scheme}://{host}"), f"/{path}"


def text_slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts as UTF-8, null as empty, in consecutive lists of about max_bytes; one longer text stands alone."""
    held: list[bytes] = []
    size = 0
    for value in texts.cast(pa.large_binary()):
        raw = value.as_py() or b""
        if held and size + len(raw) > max_bytes:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held
