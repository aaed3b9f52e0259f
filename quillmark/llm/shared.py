"""Storage that the driver and all executors share, and small helpers around it.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``;
a folder of our own is used only where that is unset, as in tests on one machine.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer splits than there are: a small table in one
    file would keep one core busy. A large one has more splits and is left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows that go to Python at a time. Texts may be long, and a batch is held on both sides.
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have ``BATCH_ROWS`` rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


#: Places that this driver has written tables to and not removed.
_places: list[str] = []


def written(df: DataFrame, label: str, place: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    The committed files outlive any executor, so later stages restart from them.
    """
    spark = df.sparkSession
    place = place or new_place(spark, label)
    _places.append(place)
    df.write.mode("overwrite").parquet(place)
    out = spark.read.schema(df.schema).parquet(place)
    out._place = place
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Tables written in its body go when that is done, but for those given to what it yields."""
    before, kept = set(_places), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._place)
        return table

    yield keep
    for place in [p for p in _places if p not in before and p not in kept]:
        removed(spark, place)


def cleared(spark: SparkSession) -> None:
    """Delete every table that ``written`` made here. Results of operators read them, so call
    this when the results themselves were written or are not needed any more."""
    while _places:
        removed(spark, _places[-1])


def removed(spark: SparkSession, place: str) -> None:
    """Delete a folder of the shared storage that no plan needs any more."""
    if place in _places:
        _places.remove(place)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than one in so many rows goes by broadcast in ``looked_up``.
HEAVY = 200


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, grows: bool = False) -> DataFrame:
    """``rows`` left-joined to ``table`` (one row per key, ``weight`` = how many rows have it).

    Keys of more than one in ``HEAVY`` of all rows, so ``HEAVY`` at most whatever the data, are
    broadcast; their rows get scattered keys in the join of the others, so no task of it gets
    more of one key than that, nor of null keys. The first key is scattered; it is a long or
    binary. ``table`` is read twice: have it written. With ``grows`` the others are joined by a
    shuffle at any size, as they will be at the sizes that matter.
    """
    values = [c for c in table.columns if c not in (*on, weight)]
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = table.where(F.col(weight) * HEAVY > F.lit(total))
    met = F.broadcast(heavy.select(*on, F.lit(True).alias("_met"), *(F.col(c).alias(f"_heavy_{c}") for c in values)))
    out = rows.join(met, on, "left")
    alone = F.col("_met").isNotNull() | F.col(on[0]).isNull()
    other = F.xxhash64(F.monotonically_increasing_id()).cast("string").cast(rows.schema[on[0]].dataType)
    out = out.withColumn("_key", F.when(alone, other).otherwise(F.col(on[0]))).withColumn("_met", F.coalesce(alone, F.lit(False)))
    rest = table.where(F.col(weight) * HEAVY <= F.lit(total)).withColumnRenamed(on[0], "_key").withColumn("_met", F.lit(False)).drop(weight)
    out = out.join(rest.hint("merge") if grows else rest, ["_key", "_met", *on[1:]], "left")
    kept = [F.col(c) for c in rows.columns]
    return out.select(*kept, *(F.when(F.col("_met"), F.col(f"_heavy_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a URI, for tasks that read or write binary files."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str):
    """A binary stream whose file appears under ``uri`` only when it was closed in full.

    A lost or repeated task leaves at most a file of another name that nothing lists.
    """
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)
