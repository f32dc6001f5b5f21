"""The dependency inventory of a project: its scans found, their manifests parsed, versions filled from parents, bills of
materials and central files, one page of it listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.dependencies import bom_versions, fill_versions, first_wins, wanted_kinds, with_parents
from quarrylight.operators.scratch import checkpointed
from quarrylight.sources.manifests import read_manifests
from quarrylight.sources.workspaces import central_versions, read_poms, scans


def pom_versions(files: DataFrame) -> DataFrame:
    """files (path, content) to the versions that each POM gets from its parent and from the bills that it imports:
    project (its path), coord, version. POMs are known to each other by their coordinates."""
    parents, imports, managed = (checkpointed(table) for table in read_poms(files))
    own = imports.select(F.col("path").alias("project"), F.col("child").alias("gav"), "pos")
    named = parents.where("parent is not null").select(F.col("path").alias("project"), F.col("parent").alias("gav"))
    edges = imports.select("gav", "child", "pos")
    # A parent is read like a bill that any import overrides; those that it imports come after the own ones.
    entries = managed.select("gav", "coord", "version", "pos")
    first = own.unionByName(named.select("project", "gav", F.lit(-1).alias("pos")))
    return bom_versions(with_parents(first, named, edges), entries, edges).select("project", "coord", "version")


def project_dependencies(files: DataFrame, include_dev: bool, include_optional: bool) -> DataFrame:
    """manifest_idx, project_root, manifest_type, manifest_path, file_pos, pos, name, ecosystem, declared_version, kind, error: a row a dependency of a scan, a failed
    manifest, or a scan without dependencies (name and error null). Versions come from parents, bills and central files; of
    several members of a scan that declare a dependency, the first counts."""
    found = checkpointed(scans(files))
    own = files.join(found.select("path").distinct(), "path", "left_semi")
    rows = checkpointed(read_manifests(own, dev=include_dev, optional=include_optional))
    wanted = wanted_kinds(rows.where("error is null"), include_dev, include_optional)
    # POMs know each other by coordinates, wherever they lie.
    versions = checkpointed(pom_versions(files))
    filled = checkpointed(fill_versions(wanted.withColumn("project", F.col("manifest_path")), versions).drop("project"))
    central = central_versions(filled.where("ecosystem = 'nuget'"), files)
    columns = rows.columns
    whole = filled.where("ecosystem <> 'nuget'").select(*columns).unionByName(central.select(*columns))
    placed = found.withColumnRenamed("path", "manifest_path").join(whole, "manifest_path")
    first = first_wins(placed, ["manifest_idx", "name", "ecosystem"], ["file_pos", "pos"])
    failed = found.withColumnRenamed("path", "manifest_path").join(rows.where("error is not null"), "manifest_path")
    done = first.unionByName(failed.select(*first.columns))
    bare = found.select("manifest_idx", "project_root", "manifest_type").distinct().join(done.select("manifest_idx").distinct(), "manifest_idx", "left_anti")
    return checkpointed(done.unionByName(bare, allowMissingColumns=True))


def inventory_page(deps: DataFrame, primary_only: bool, offset: int, limit: int) -> DataFrame:
    """A page of the dependencies of the first scan, and, unless ``primary_only``, all of the other scans, with the number of the first scan's (total) and of
    all (manifests_total)."""
    there = deps.where("name is not null")
    totals = there.agg(F.count(F.lit(1)).alias("manifests_total"), F.count_if(F.col("manifest_idx") == 0).alias("total"))
    page = there.where("manifest_idx = 0").orderBy("file_pos", "pos", "name").offset(offset).limit(limit)
    rows = page if primary_only else page.unionByName(there.where("manifest_idx > 0"))
    # One row of totals.
    return rows.join(F.broadcast(totals)).orderBy("manifest_idx", "file_pos", "pos", "name")
