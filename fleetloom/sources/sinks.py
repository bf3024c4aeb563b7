"""Writing rendered configurations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetloom.session import task_count

HOST_SLICES = 64
_MANIFEST = "cluster_name string, run string, columns string"


def write_by_host(
    rendered: DataFrame, directory: str, per_host_files: bool = False, mode: str = "error"
) -> tuple[str, str]:
    """Write good rows to ``outcome=configs`` and failed ones to ``outcome=errors`` below *directory*.

    A failed row never holds up the others, and the input is computed once for
    both.  Files are split by cluster and sorted by host; *per_host_files* adds a
    folder per host, which suits small fleets only.  Hosts of a cluster are dealt
    into slices by hash, so a cluster of any size is written by many tasks.
    """
    outcome = F.when(F.col("error").isNull(), F.lit("configs")).otherwise(F.lit("errors"))
    folders = ["outcome", "cluster_name", *(["host"] if per_host_files else [])]
    piece = F.pmod(F.xxhash64("host"), F.lit(HOST_SLICES))
    placed = rendered.withColumn("outcome", outcome).repartition("outcome", "cluster_name", piece)
    placed.sortWithinPartitions(*folders, "host").write.mode(mode).partitionBy(*folders).parquet(directory)
    return f"{directory}/outcome=configs", f"{directory}/outcome=errors"


def publish(rendered: DataFrame, directory: str, run: str) -> None:
    """Write *rendered* as the run *run* and make its clusters those that :func:`published` reads.

    Clusters that are not in *rendered* stay as an earlier run left them.  A manifest of one
    file, written last, names the run of each cluster: a run that dies before it is never
    read, and is simply done again under the same name.  A run that some cluster is still read
    from cannot be written again.  One run publishes at a time; old folders are left to the user.
    """
    spark = rendered.sparkSession
    version, current = _manifest(spark, directory)
    if current is not None and not current.where(F.col("run") == run).isEmpty():
        raise ValueError(f"run {run} is already published in {directory}")
    folder = f"{directory}/runs/run={run}"
    write_by_host(rendered, folder, mode="overwrite")
    columns = [field for field in rendered.schema.fields if field.name != "cluster_name"]
    columns += [T.StructField("cluster_name", rendered.schema["cluster_name"].dataType), T.StructField("outcome", T.StringType())]
    schema = T.StructType(columns)
    written = spark.read.schema(schema).parquet(folder).select(F.col("cluster_name").cast("string"))
    mine = written.distinct().withColumns({"run": F.lit(run), "columns": F.lit(schema.json())})
    if current is not None:
        # As a struct, a null name equals itself.
        mine_key, name = mine.select(F.struct("cluster_name").alias("_key")), F.struct("cluster_name").alias("_key")
        rest = current.select("*", name).join(mine_key, "_key", "left_anti").drop("_key")
        mine = mine.unionByName(rest)
    mine.coalesce(1).write.mode("overwrite").parquet(f"{directory}/manifest/version={version + 1}")


def published(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of every published cluster, from the run that its manifest names, with ``outcome`` and ``run``."""
    _, current = _manifest(spark, directory)
    if current is None:
        raise ValueError(f"nothing is published in {directory}")
    # One number a run that still counts, not one a cluster.
    runs = [row[0] for row in current.select("run").distinct().collect()]
    columns = current.select(F.max_by("columns", "run")).first()[0]
    schema = T.StructType.fromJson(json.loads(columns)).add("run", T.StringType())
    rows = spark.read.schema(schema).parquet(f"{directory}/runs").where(F.col("run").isin(runs))
    home = current.select(F.struct("run", "cluster_name").alias("_home"))
    own = F.struct("run", F.col("cluster_name").cast("string").alias("cluster_name"))
    return rows.withColumn("_home", own).join(home, "_home", "left_semi").drop("_home")


def _manifest(spark: SparkSession, directory: str) -> tuple[int, DataFrame | None]:
    try:
        rows = spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{directory}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    version = rows.agg(F.max("version")).first()[0]
    return (0, None) if version is None else (version, rows.where(F.col("version") == version).drop("version"))


def write_files(texts: DataFrame, root: str) -> int:
    """Write ``(file, text)`` as files of these names below *root*; a null text removes its file.

    Each file appears whole, by a rename, and a task that is run again writes the same.  Names
    that lead out of *root* stop the job.  Returns the number of rows.  Files are dealt to tasks by
    name; of rows of one name, the last one counts.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place = root.replace("file:/", "/", 1) if root.startswith("file:/") and not root.startswith("file://") else root
        system, base = fs.FileSystem.from_uri(place)
        for batch in batches:
            for name, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                steps = name.split("/")
                if not all(steps) or {".", ".."} & set(steps):
                    raise ValueError(f"not a file name below the root: {name!r}")
                path = f"{base}/{name}"
                if text is not None:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(f"{path}.partial") as out:
                        out.write(text.encode())
                    system.move(f"{path}.partial", path)
                elif system.get_file_info(path).type == fs.FileType.File:
                    system.delete_file(path)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    # Rows of one name stay in their order, in one task.
    numbered = texts.select("file", "text", F.monotonically_increasing_id().alias("_row"))
    dealt = numbered.repartition(task_count(texts.sparkSession), "file").sortWithinPartitions("_row").select("file", "text")
    return dealt.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
