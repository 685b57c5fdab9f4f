"""What the operators of this subpackage share: table reading, the shared folder, sizes."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of public tokenizer files is a parameter; this is its default file for the token operators.
TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Where an installed public tokenizer file lies, on the machine that asks."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of its own (driver and executors are one machine); a cluster is refused,
    as its executors would write to different disks.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="tidegauge-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


class Intermediates:
    """The intermediate tables that operators write while this is entered; ``drop`` deletes them, and only them.

    For a caller that has materialised the operators' results; tables written outside of any stay where they are.
    """

    _entered: ContextVar[Intermediates | None] = ContextVar("intermediates", default=None)

    def __init__(self) -> None:
        self.made: list[str] = []

    def __enter__(self) -> Intermediates:
        self._token = self._entered.set(self)
        return self

    def __exit__(self, *_) -> None:
        self._entered.reset(self._token)

    def drop(self, spark: SparkSession) -> None:
        while self.made:
            drop_path(spark, self.made.pop())

    @classmethod
    def current(cls) -> Intermediates | None:
        return cls._entered.get()


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path in the shared folder."""
    at = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep and (own := Intermediates.current()) is not None:
        own.made.append(at)
    return at


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows written to the shared folder as Parquet and read back: cuts lineage and survives lost executors.

    Without compression: most of it is hashes, and codecs hold direct buffers that only a collection of garbage frees.
    """
    spark = df.sparkSession
    at = new_path(spark, name, keep)
    df.write.option("compression", "snappy" if keep else "none").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Rows of a partition, and how many partitions there may be at least (or two for each core), where `gathered` is told of the rows.
PARTITION_ROWS, PARTITIONS = 50_000, 12


def gathered(df: DataFrame, rows: int, each: int = PARTITION_ROWS) -> DataFrame:
    """``df``, of ``rows`` rows at most, in no more partitions than those need at ``each`` a partition; fewer stay as they are.

    A shuffle has as many partitions as the session says, and each is a file when it is written, however few its rows; on a local
    disk Hadoop starts two processes for a file, to set modes, and each shares all the memory of its executor at first.
    """
    least = max(PARTITIONS, 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(max(least, -(-rows // each)))


#: Bytes of an Arrow batch: the JVM, the pipe and the Python worker each hold one, so memory follows it and not the text lengths.
ARROW_BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to ARROW_BATCH_BYTES; a smaller setting stays."""
    spark = df.sparkSession
    text = str(spark.conf.get(_BATCH_SETTING, "64m")).lower().removesuffix("b")
    size = int(text[:-1]) << {"k": 10, "m": 20, "g": 30}[text[-1]] if text and text[-1] in "kmg" else int(text or 0)
    if not 0 < size <= ARROW_BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(ARROW_BATCH_BYTES))
    return df


def released(f):
    """An Arrow function that gives freed memory back to the system now and then and when its partition ends: workers are kept for later tasks."""

    def release():
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    def run(batches):
        for k, out in enumerate(f(batches)):
            yield out
            if k % 16 == 15:
                release()
        release()

    return run


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of (doc_id, text hash) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def fields(df: DataFrame, *without: str) -> list[str]:
    """Quoted names of the columns, without those of the given names (case aside)."""
    dropped = {w.lower() for w in without}
    return [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in dropped]


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, hash of the text) is in ``gone`` (doc_id, key)."""
    known = written(gone.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), "gone")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    rows = docs.select(F.struct("*").alias("row"))
    kept = rows.join(known, rows["row.doc_id"].eqNullSafe(known["gone_id"]) & (text_key(rows["row.text"]) == known["gone_key"]), "left_anti")
    return kept.select("row.*")
