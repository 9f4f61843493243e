"""What the corpus operators share: reading, cutting lineage, size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts spell it: space and \x09 to \x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and its master is local (tests on one machine) a temporary
    folder is set; on a cluster the machines would not share it.
    """
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage on storage that outlives executors; unlike ``checkpoint()`` it is
    compressed and columnar. The table goes with ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``settled`` wrote, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_settled_path", None):
            spark = df.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free_prefix(*frames: DataFrame) -> str:
    """A prefix that no column of ``frames`` has, for columns beside those of the user."""
    taken, prefix = [c.lower() for df in frames for c in df.columns], "_t"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_below(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast if ``df`` (a settled, narrow table) has at most ``limit`` rows; else leave
    it to a shuffled join. The limit bounds what goes through the driver at any input size."""
    return F.broadcast(df) if df.count() <= limit else df


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id's decimal text, as the fold rules use it (null: crc32 of nothing)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def slices(batches, column: str = "text", max_bytes: int = 4 << 20):
    """Arrow batches cut so that ``column`` holds about ``max_bytes`` each (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if len(sizes) > begin:
            yield batch.slice(begin)


def texts_of(batch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


class Recent:
    """A cache of about ``max_cached`` entries that keeps, when it is full, what the next ``calls``
    calls ask for.

    ``missing(wanted)`` makes room and gives those of ``wanted`` that have to be made and put into the
    dictionary ``now``; the others can be looked up there until it is called again. It looks at
    ``wanted`` only, not at what is cached, but for when it makes room."""

    def __init__(self, max_cached: int, calls: int = 16):
        self.max_cached, self.calls, self.left = max_cached, calls, 0
        self.now, self.before = {}, {}

    def missing(self, wanted: set) -> set:
        fresh = wanted.difference(self.now)
        if self.now and len(self.now) + len(fresh) > self.max_cached:
            self.before, self.left = dict(self.now), self.calls
            self.now.clear()
            fresh = wanted
        if self.before:
            before = self.before
            again = {w: before[w] for w in fresh if w in before}
            self.now.update(again)
            fresh = fresh.difference(again)
            self.left -= 1
            if self.left < 0:
                self.before = {}
        return fresh


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once a Spark context)."""
    import pathlib
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    top = pathlib.Path(__file__).resolve().parents[2]
    path = pathlib.Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((top / "tessera").rglob("*.py")):
            out.write(file, file.relative_to(top))
    sc.addPyFile(str(path))
    sc._tessera_shipped = True


#: Rows of an Arrow batch at most, so that neither side of the pipe holds many texts at once.
ARROW_ROWS = 1000


def give_back() -> None:
    """Return to the system what this worker has freed; workers live on between stages, two or more
    beside one JVM, and the allocators would keep it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_KEPT: dict = {}


def kept(key, make):
    """What a worker keeps from one task to the next, as a tokenizer with its cache of words. One thing
    only: it goes when a task needs another, or comes from an operator that keeps nothing."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def arrow_map(df: DataFrame, run, schema, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` whose workers can import this package and give back memory after each task.

    The session's Arrow batches are lowered to ``ARROW_ROWS`` rows if they are larger, and stay so, as
    the frame runs later, when its caller asks for rows: both sides of the pipe hold a batch."""
    spark = df.sparkSession
    shipped(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))

    def task(batches):
        from tessera.llm.common import _KEPT  # the worker's own

        if not keeps:
            _KEPT.clear()
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)
