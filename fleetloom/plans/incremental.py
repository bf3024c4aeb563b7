"""Merged settings that are kept between runs and merged again only where layers change.

Subtree rules act below one top-level key, so a cluster's leaves fall into groups by that key which merge
independently.  Groups are dealt to shards by a hash; a shard is a folder of its leaves and one of its merged rows.
An update finds the groups that changed layer files touch, reads and rewrites the shards
that hold them, and shuffles the leaves of those groups alone.

Every version is written next to the earlier ones and becomes visible by one small file, the
manifest that names the folder of every shard.  A run that dies before leaves the last version
in force and is simply repeated.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fleetloom.operators.layers import NO_ROLE, _by_reach, merge_layers, with_precedence
from fleetloom.session import cut_lineage

#: Stands for no host: rows of a whole cluster or role.
NO_HOST = "\u0000"
#: Role of a host that has layers and is not among the nodes.
UNKNOWN_ROLE = "\u0000?"
_OWNER = ["cluster_name", "role", "host"]
_FILE = ["cluster_name", "layer_path"]
_MANIFEST = "part string, shard int, home int, columns string"


def top_key() -> Column:
    return F.coalesce(F.get("path", F.lit(0)), F.lit(NO_HOST))


class MergedStore:
    """Leaves of layers and their merge, in a folder that all executors reach.

    Leaves are ``(cluster_name, scope, scope_value, layer_path, doc_index, path, kind, value)`` as
    :func:`merged_settings` takes them.  *shards* bounds what the driver holds, one number
    each, and is fixed when the store is built; a shard should have some 100 MB.  One
    update runs at a time; folders of earlier versions stay until someone removes them.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int = 256, list_mode: str = "replace"):
        self.spark, self.folder, self.shards, self.list_mode = spark, folder.rstrip("/"), shards, list_mode

    def build(self, nodes: DataFrame, settings: DataFrame) -> None:
        """Write the first version; a folder that has one already is an error."""
        if self._versions() is not None:
            raise ValueError(f"there is a store in {self.folder}")
        leaves = settings.withColumn("top", top_key())
        self._write("leaves", 1, leaves, self._shard("cluster_name", "top"))
        kept = self._written("leaves", 1, leaves.schema)
        merged = self._merge(nodes, kept)
        self._write("merged", 1, merged, self._shard("cluster_name", "top"))
        files = _index(kept)
        self._write("files", 1, files, self._shard("cluster_name"))
        schemas = {"leaves": leaves.schema, "merged": merged.schema, "files": files.schema}
        self._commit(1, {(part, shard): 1 for part, schema in schemas.items() for shard in self._present(part, 1, schema)}, schemas)

    def update(self, nodes: DataFrame, changed: DataFrame, files: DataFrame, hosts: DataFrame | None = None) -> int:
        """Replace the leaves of some layer files, merge what they touch, and return the number of the new version.

        *files* names all files that are new, changed or gone, by ``(cluster_name, layer_path)``; *changed* has
        all leaves of those that exist.  *hosts* names nodes ``(cluster_name, host)`` that are new or have another role.
        """
        version, homes, schemas = self._manifest()
        files = files.select(*_FILE).distinct()
        changed = cut_lineage(changed.withColumn("top", top_key()).select(*schemas["leaves"].names))
        moved = files.select("cluster_name")
        moved = moved if hosts is None else moved.unionByName(hosts.select("cluster_name"))
        index_shards = self._numbers(moved, self._shard("cluster_name"))
        index = self._read("files", homes, schemas, index_shards)
        touched = index.join(files, _FILE, "left_semi").select("cluster_name", "top")
        touched = touched.unionByName(changed.select("cluster_name", "top"))
        if hosts is not None:
            mine = index.where("host IS NOT NULL").join(hosts.select("cluster_name", "host"), ["cluster_name", "host"], "left_semi")
            touched = touched.unionByName(mine.select("cluster_name", "top"))
        touched = cut_lineage(touched.distinct())
        shards = self._numbers(touched, self._shard("cluster_name", "top"))
        new = version + 1
        group = ["cluster_name", "top"]
        kept = self._read("leaves", homes, schemas, shards).join(files, _FILE, "left_anti")
        self._write("leaves", new, kept.unionByName(changed), self._shard(*group))
        again = self._merge(nodes, self._written("leaves", new, schemas["leaves"]).join(touched, group, "left_semi"))
        rest = self._read("merged", homes, schemas, shards).join(touched, group, "left_anti")
        self._write("merged", new, rest.unionByName(again), self._shard(*group))
        others = index.join(files, _FILE, "left_anti").unionByName(_index(changed))
        self._write("files", new, others, self._shard("cluster_name"))
        rewritten = {"leaves": shards, "merged": shards, "files": index_shards}
        homes = {(part, shard): home for (part, shard), home in homes.items() if shard not in rewritten[part]}
        homes |= {(part, shard): new for part, schema in schemas.items() for shard in self._present(part, new, schema)}
        self._commit(new, homes, schemas)
        return new

    def settings(self, nodes: DataFrame) -> DataFrame:
        """``(cluster_name, host, role, path, kind, value, precedence)`` of every node, as :func:`merged_settings` gives it.

        Nodes with layers of their own take their own groups and those of their role for other keys; all
        others take the groups of their role.  A node with layers whose role is not the one it was merged with
        stops the job: it belongs among the *hosts* of an update.
        """
        _, homes, schemas = self._manifest()
        merged = self._read("merged", homes, schemas, None)
        side = nodes.select("cluster_name", "host", F.coalesce("role", F.lit(NO_ROLE)).alias("role"))
        out = [*_OWNER, "top", "path", "kind", "value", "precedence"]
        shared = merged.where(F.col("host") == NO_HOST).drop("host")
        hosted = merged.where(F.col("host") != NO_HOST)
        # What each role has: its own groups, and those of the cluster for other keys.
        roles = side.select("cluster_name", "role").distinct()
        by_role = shared.where(F.col("role") != NO_ROLE).join(roles, ["cluster_name", "role"], "left_semi")
        wide = roles.join(shared.where(F.col("role") == NO_ROLE).drop("role"), "cluster_name")
        taken = by_role.where("path IS NULL").select("cluster_name", "role", "top")
        wide = wide.join(taken, ["cluster_name", "role", "top"], "left_anti")
        of_role = by_role.unionByName(wide.select(*by_role.columns)).where("path IS NOT NULL")
        owners = hosted.where("path IS NULL").select("cluster_name", "host", F.col("role").alias("_role"), "top")
        with_own = owners.groupBy("cluster_name", "host").agg(F.collect_set("_role").alias("_roles"))
        message = F.concat(F.lit("role of a node with layers has changed, update the store for "), F.col("host"))
        same = F.when(F.array_contains("_roles", F.col("role")), True).otherwise(F.raise_error(message).cast("boolean"))
        own = side.join(with_own, ["cluster_name", "host"]).where(same).select(*_OWNER)
        passed = side.join(with_own, ["cluster_name", "host"], "left_anti").join(of_role, ["cluster_name", "role"])
        inherited = own.join(of_role, ["cluster_name", "role"]).join(owners.drop("_role"), ["cluster_name", "host", "top"], "left_anti")
        theirs = own.join(hosted.where("path IS NOT NULL"), _OWNER)
        found = passed.select(*out).unionByName(inherited.select(*out)).unionByName(theirs.select(*out))
        return found.withColumn("role", F.nullif("role", F.lit(NO_ROLE))).select("cluster_name", "host", "role", *out[4:])

    def _merge(self, nodes: DataFrame, leaves: DataFrame) -> DataFrame:
        """Merged rows of the groups in *leaves*, and a row without path for each owner of a group.

        Owners are the cluster, each role with layers for the key, and each host with layers for the key.
        """
        wide, by_role, by_host = _by_reach(with_precedence(leaves))
        leaf = ["top", "path", "kind", "value", "precedence"]
        wide = wide.select("cluster_name", *leaf)
        by_role = by_role.select("cluster_name", F.col("scope_value").alias("role"), *leaf)
        by_host = by_host.select("cluster_name", F.col("scope_value").alias("host"), *leaf)
        known = nodes.select("cluster_name", "host", F.coalesce("role", F.lit(NO_ROLE)).alias("role")).distinct()
        hosts = by_host.select("cluster_name", "host", "top").distinct().join(known, ["cluster_name", "host"], "left")
        hosts = cut_lineage(hosts.withColumn("role", F.coalesce("role", F.lit(UNKNOWN_ROLE))))
        no_host = F.lit(NO_HOST).alias("host")
        roles = by_role.select("cluster_name", "role", "top").distinct()
        clusters = wide.select("cluster_name", "top").distinct()
        owners = clusters.select("cluster_name", F.lit(NO_ROLE).alias("role"), no_host, "top")
        owners = owners.unionByName(roles.select("cluster_name", "role", no_host, "top")).unionByName(hosts.select(*_OWNER, "top"))
        columns = [*_OWNER, *leaf]
        parts = [
            wide.withColumns({"role": F.lit(NO_ROLE), "host": F.lit(NO_HOST)}),
            roles.join(wide, ["cluster_name", "top"]).withColumn("host", F.lit(NO_HOST)),
            by_role.withColumn("host", F.lit(NO_HOST)),
            hosts.join(wide, ["cluster_name", "top"]),
            hosts.join(by_role, ["cluster_name", "role", "top"]),
            hosts.join(by_host, ["cluster_name", "host", "top"]),
        ]
        rows = parts[0].select(*columns)
        for part in parts[1:]:
            rows = rows.unionByName(part.select(*columns))
        merged = merge_layers(rows, _OWNER, self.list_mode).withColumn("top", top_key())
        merged = merged.select(*_OWNER, "top", "path", "kind", "value", "precedence")
        empty = {name: F.lit(None).cast(merged.schema[name].dataType) for name in ("path", "kind", "value", "precedence")}
        return merged.unionByName(owners.withColumns(empty))

    def _shard(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.shards)).cast("int")

    def _numbers(self, rows: DataFrame, shard: Column) -> list[int]:
        """Shards of some rows: at most as many numbers as there are shards."""
        return sorted(row[0] for row in rows.select(shard).distinct().collect())

    def _write(self, part: str, version: int, rows: DataFrame, shard: Column) -> None:
        # A shard that holds a hot group is split over several files.
        dealt = rows.withColumn("shard", shard).hint("rebalance", "shard")
        dealt.write.mode("overwrite").partitionBy("shard").parquet(f"{self.folder}/{part}/version={version}")

    def _written(self, part: str, version: int, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}/version={version}")

    def _present(self, part: str, version: int, schema: StructType) -> list[int]:
        path = f"{self.folder}/{part}/version={version}"
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("shard", IntegerType())])).parquet(path)
        return sorted(row[0] for row in rows.select("shard").distinct().collect())

    def _read(self, part: str, homes: dict[tuple[str, int], int], schemas: dict[str, StructType], shards: Sequence[int] | None) -> DataFrame:
        """Rows of some shards, or of all: only their folders are listed and read."""
        wanted = [(shard, home) for (p, shard), home in homes.items() if p == part and (shards is None or shard in shards)]
        paths = [f"{self.folder}/{part}/version={home}/shard={shard}" for shard, home in sorted(wanted)]
        if not paths:
            return self.spark.createDataFrame([], schemas[part])
        return self.spark.read.schema(schemas[part]).parquet(*paths)

    def _commit(self, version: int, homes: dict[tuple[str, int], int], schemas: dict[str, StructType]) -> None:
        """One file, which appears by a rename: the version counts from then on."""
        rows = [(part, -1, version, schema.json()) for part, schema in schemas.items()]
        rows += [(part, shard, home, None) for (part, shard), home in homes.items()]
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")

    def _versions(self) -> DataFrame | None:
        schema = f"{_MANIFEST}, version int"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return None if rows.isEmpty() else rows

    def _manifest(self) -> tuple[int, dict[tuple[str, int], int], dict[str, StructType]]:
        versions = self._versions()
        if versions is None:
            raise ValueError(f"there is no store in {self.folder}")
        version = versions.agg(F.max("version")).first()[0]
        rows = versions.where(F.col("version") == version).collect()
        homes = {(row["part"], row["shard"]): row["home"] for row in rows if row["shard"] >= 0}
        return version, homes, {row["part"]: StructType.fromJson(json.loads(row["columns"])) for row in rows if row["shard"] < 0}


def _index(leaves: DataFrame) -> DataFrame:
    """Which top-level keys each layer file sets, and for which host."""
    hosted = (F.col("scope") == "node") | ((F.col("scope") == "base") & F.col("scope_value").isNotNull())
    host = F.when(hosted, F.col("scope_value")).alias("host")
    return leaves.select(*_FILE, host, "top").distinct()
