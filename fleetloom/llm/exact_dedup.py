"""Exact deduplication of a document stream with disk-backed keyed state.

A streaming aggregation reads the files and keeps, for each digest of a
normalised text and without expiry, the identifier and the locator (file and row)
of the row that stays, and how many rows there were.  The state lives in RocksDB
stores whose checkpoints go to the shared folder, so a run that is started again
on the same *progress* folder reads only new files.  Rows whose digest is known
more than once are then compared byte by byte with the row that stays.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetloom.llm.shared import WHITE_SPACE, fits_broadcast, stored
from fleetloom.session import shared_path

#: Bytes of files that one micro-batch reads; bounds the memory and the work that is lost with it.
BATCH_BYTES = 256 << 20
#: Bytes of hit places that are sent to every executor; beyond them they are joined.
PLACES_BYTES = 64 << 20
#: Rows of one group that are compared in one task.
GROUP_SLICE = 512
_STATE = "spark.sql.streaming.stateStore"
_SETTINGS = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    # Without it each store takes megabytes of disk before it holds anything.
    f"{_STATE}.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without white space; a null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _marked(files: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digest of each row and its place in the order in which rows of a group stay, smallest first."""
    place = F.struct(
        (-F.length(F.coalesce("text", F.lit("")))).alias("fewer_chars"),
        F.isnull("doc_id").alias("no_id"),
        F.col("doc_id").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    body = normalised(F.col("text"))
    return files.select("doc_id", body.alias("body"), digest(body).alias("digest"), place.alias("place"))


@contextmanager
def _state_settings(spark: SparkSession):
    """State settings for a query that starts now; it keeps them, the session does not."""
    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _streamed(spark: SparkSession, path: str) -> str:
    """The path as a file stream takes it: a single file must be written as a pattern."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    alone = system.exists(place) and not system.getFileStatus(place).isDirectory()
    return f"{path[:-1]}[{path[-1]}]" if alone else path


def update_state(
    spark: SparkSession, path: str, progress: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Read the file or folder *path* as far as *progress* has not seen it; return the state.

    A folder may be partitioned (``name=value`` folders below it).  As everywhere in Spark, a path
    with the characters of a pattern is one.  The state has one row for each digest: ``digest``,
    ``keeper`` (the place of the row that stays) and ``size``.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(_streamed(spark, path))
    groups = _marked(stream, digest).groupBy("digest").agg(F.min("place").alias("keeper"), F.count("*").alias("size"))
    writer = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", progress)
    with _state_settings(spark):
        running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    state = spark.read.format("statestore").load(progress)
    names = state.schema["value"].dataType.names
    return state.select(
        "key.digest", F.col(f"value.{names[0]}").alias("keeper"), F.col(f"value.{names[1]}").alias("size")
    )


def deduplicate(
    spark: SparkSession, path: str, progress: str | None = None, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of the Parquet files at *path*, the dropped ones too.

    Of equal texts the row with most characters stays, then the one with the
    smallest ID; null IDs lose to others, and of rows that are still tied the first
    by file and row number stays.  Empty, blank and null texts are equal.  Columns other
    than ``doc_id`` and ``text`` are not read.
    """
    state = update_state(spark, path, progress or shared_path(spark, "dedup-progress"), digest)
    state = stored(state, "dedup-state")
    files = _marked(spark.read.parquet(path), digest)
    rows = stored(files.select("doc_id", "digest", "place", F.sha2("body", 256).alias("text_sha256")), "digests")
    found = rows.join(state, "digest")
    # Rows with a hit, by their place: only their texts are looked at again, once.
    hits = found.where("size > 1").select("place.file", "place.row", "digest", "keeper", "size")
    hits = stored(hits, "hits")
    # Sixteen bytes a hit pick the rows whose texts are shuffled; all others stay where they are.
    at = F.xxhash64("file", "row")
    places = hits.select(at.alias("at"))
    places = F.broadcast(places) if fits_broadcast(places.count(), 16, PLACES_BYTES) else places
    located = files.select("body", "place", F.col("place.file").alias("file"), F.col("place.row").alias("row"))
    located = located.withColumn("at", at).join(places, "at", "left_semi").drop("at")
    members = stored(located.join(hits, ["file", "row"]).drop("file", "row"), "members")
    collided = stored(_differing(members).select("digest").distinct(), "collisions")
    if not collided.isEmpty():
        # Digests shared by different texts: these groups are made by the whole text.
        same = members.drop("keeper", "size").join(collided, "digest", "left_semi")
        same = same.withColumn("doc_id", F.col("place.doc_id"))
        exact = same.groupBy("digest", "body").agg(F.min("place").alias("keeper"), F.count("*").alias("size"))
        split = same.join(exact, ["digest", "body"])
        split = split.select("digest", "doc_id", "place", F.sha2("body", 256).alias("text_sha256"), "keeper", "size")
        found = found.join(collided, "digest", "left_anti").unionByName(split)
    return found.select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.struct("place.file", "place.row") == F.struct("keeper.file", "keeper.row")).alias("kept"),
        "text_sha256",
    )


def _differing(members: DataFrame) -> DataFrame:
    """Rows whose full bytes differ from those of the row that stays under their digest.

    Rows of a group are cut into slices, and the text that stays is copied to each,
    so a group of any size is compared by many tasks.
    """
    slices = F.ceil(F.col("size") / GROUP_SLICE).cast("int")
    is_keeper = F.struct("place.file", "place.row") == F.struct("keeper.file", "keeper.row")
    keepers = members.where(is_keeper).select(
        "digest", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice")
    )
    drawn = F.pmod(F.xxhash64("place.file", "place.row"), slices).cast("int")
    others = members.where(~is_keeper).select("digest", "body", drawn.alias("slice"))
    return others.join(keepers, ["digest", "slice"]).where(F.col("body") != F.col("kept_body"))
