"""What the operators of this subpackage share: the shared folder, staged tables and components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: str | None = None
#: Folders written by this process that haven't been removed.
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    global _fallback
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _fallback = _fallback or "file://" + tempfile.mkdtemp(prefix="quillon-")
        root = _fallback
    if not _staged:
        atexit.register(_release_all, spark)
    _staged.append(f"{root.rstrip('/')}/quillon-{uuid.uuid4().hex}")
    return _staged[-1]


def staged() -> list[str]:
    """The folders that this process has written and not removed."""
    return list(_staged)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Removes staged folders, through Spark's own file systems; frames that read them are void then."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _staged:
            _staged.remove(path)


def _release_all(spark: SparkSession) -> None:
    try:
        release(spark, staged())
    except Exception:  # noqa: BLE001  the session has ended: its folders stay
        _staged.clear()


def stage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch that Python functions work on at once, and bytes that Spark sends at once, about.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Arrow batches to Python workers are bounded, so that long texts fit in their memory; settings return afterwards."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def lower_batches(spark: SparkSession) -> None:
    """Bounds the batches of a lazy frame that passes whole rows through Python: it runs under the session's settings.

    Larger settings than these are lowered and stay so; all such frames ask for the same.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows, whatever the session's settings: a lazy frame runs under its caller's."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, told apart as Spark does, without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one key from which a join deals them out over several tasks.
HEAVY = 100_000


def salted_join(rows: DataFrame, per_key: DataFrame, keys: list[str], by: Column, heavy: int = HEAVY, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with per_key, which has a row per key at most; rows of a key beyond heavy are dealt out by the column by.

    The keys that need it are at most len(rows) / heavy; they are counted, in counted where that has the
    keys of rows at less cost, and broadcast where they are few.
    """
    counted = rows if counted is None else counted
    if counted.count() <= heavy:
        return rows.join(per_key, keys)
    many = counted.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > heavy)
    many = stage(many.select(*keys, F.ceil(F.col("_n") / heavy).cast("int").alias("_parts")))
    n = many.count()
    if not n:
        return rows.join(per_key, keys)
    many = F.broadcast(many) if n <= BROADCAST_IDS else many
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(many, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copies = per_key.join(many, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b: long): returns (node, component), component the smallest node reachable.

    Large-star and small-star steps until all edges are stars, each step's edges staged; they need a
    number of rounds that grows with the logarithm of the nodes. A node of very many links is
    pre-aggregated by min(), and its edges are dealt out over tasks where they meet that minimum.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, settled = stage(edges), False
    while not settled:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = edges.count() > HEAVY
        large = (salted_join(both, low, ["u"], F.col("v")) if big else both.join(low, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large) if big else large
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (salted_join(large, low, ["u"], F.col("v")) if big else large.join(low, "u")).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = stage(small.select("e.u", "e.v").where("u <> v").distinct())
        # Settled once all edges are stars about their smallest node: no node points to two, or both points and is pointed to.
        ends = edges.selectExpr("u as node", "1 as out", "0 as into").union(edges.selectExpr("v", "0", "1"))
        settled = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out + into = 2").isEmpty()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Rows of (id) up to which a side may be broadcast: about 32 MB in memory at most.
BROADCAST_IDS = 1_000_000


def join_ids(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join on a long column; ids is broadcast if a count shows it to be small, else both sides are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)
