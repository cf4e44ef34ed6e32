"""What the operators share: reading, batches of bounded size, the shared folder, the held-out fold."""

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 1 << 21
BATCH_BYTES = SLICE_BYTES * 7 // 8  # so that a batch, which its last row fills, is a slice mostly
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column) -> Column:
    """Whether a row's key, as text, falls into the fold that nothing is learned from; a null key does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where none is set and all run in one
    process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trailmark-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and there when executors are lost."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release() -> None:
    """Returns memory that earlier tasks of this worker have freed: workers live on and the allocators keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of about a slice, or in smaller ones if it did before. A batch is held several times, in
    the JVM and in Python, and 10,000 texts take 34 MB each time."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(conf, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each slice hold about `limit` bytes; a longer text comes alone."""
    release()
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        batch = size = ends = None
    release()


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a slice, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def cut_sql(column: str, pattern: str) -> str:
    """SQL for the words of a text, A-Z lower-cased; null has none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{upper}', '{upper.lower()}'), '{pattern}')"


_SHIFTS = tuple(map(np.uint64, (30, 27, 31)))
_FACTORS = tuple(map(np.uint64, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=False) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x ^= x >> _SHIFTS[0]
    x *= _FACTORS[0]
    x ^= x >> _SHIFTS[1]
    x *= _FACTORS[1]
    x ^= x >> _SHIFTS[2]
    return x
