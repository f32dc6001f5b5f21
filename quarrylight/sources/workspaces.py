"""Projects of several manifests: where a scan begins, and which member manifests a workspace file names.

Files are a table (path, content) of one tree, paths relative to it. Members are found by equality joins on paths; globs
are matched against the folders that hold a manifest.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import DEFAULT
from quarrylight.operators.dependencies import first_wins, project_roots
from quarrylight.operators.scratch import checkpointed
from quarrylight.sources import manifests as m


def upward_manifest(folder: str, home: str, levels: int = DEFAULT.upward_levels) -> str | None:
    """The manifest of the nearest folder from ``folder`` up to ``home``, by priority inside a folder."""
    at, end = Path(folder).resolve(), Path(home).resolve()
    for _ in range(levels):
        names = sorted(p.name for p in at.iterdir() if p.is_file()) if at.is_dir() else []
        for wanted in m.PRIORITY:
            found = [n for n in names if n == wanted or wanted.startswith(".") and n.endswith(wanted)]
            if found:
                return str(at / found[0])
        if at == end or at == at.parent:
            return None
        at = at.parent
    return None


def glob_pattern(glob: str) -> str | None:
    """A regular expression for a member glob; None for globs that are passed over: ``**``, absolute, or with ``..``."""
    body = glob.removeprefix("./").rstrip("/")
    if not body or "**" in body or body.startswith("/") or ".." in body.split("/"):
        return None
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in body)


def members_named(path: str, content: str) -> list[tuple[str, str, bool]]:
    """(pattern of a folder or file below the workspace's folder, kind of manifest, whether it is taken away)."""
    name = posixpath.basename(path)
    globs: list[str] = []
    wanted = name
    try:
        if name == "package.json":
            found = json.loads(content).get("workspaces", [])
            globs = found.get("packages", []) if isinstance(found, dict) else found
        elif name in ("pnpm-workspace.yaml", "pnpm-workspace.yml"):
            globs, wanted = m.pnpm_workspace(content), "package.json"
        elif name == "Cargo.toml":
            found = m._toml(content).get("workspace", {})
            globs = found.get("members", []) + [f"!{x}" for x in found.get("exclude", [])]
        elif name == "go.work":
            globs, wanted = m.go_work(content), "go.mod"
        elif name == "pom.xml":
            globs = m.pom_parts(content)["modules"]
        elif name.startswith("settings.gradle"):
            globs, wanted = m.settings_gradle(content), r"build\.gradle"
        elif name.endswith(".sln"):
            return [(glob_pattern(p) or "", "file", False) for p in m.sln(content) if glob_pattern(p)]
    except (m.ManifestError, ValueError, AttributeError):
        return []
    out = []
    for glob in globs if isinstance(globs, list) else []:
        taken = isinstance(glob, str) and glob.startswith("!")
        pattern = glob_pattern(glob[1:] if taken else glob) if isinstance(glob, str) else None
        if pattern:
            out.append((pattern, "build.gradle" if "gradle" in wanted else wanted, taken))
    return out


def workspace_members(files: DataFrame, cap: int = DEFAULT.workspace_cap) -> DataFrame:
    """(root, member, pos): the member manifests of each workspace file, in the order of its patterns, then by path. A
    member that a pattern takes away is left out, members that are not there are passed over."""
    schema = "root string, folder string, pattern string, kind string, taken boolean, turn int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                folder = posixpath.dirname(path)
                rows += [(path, folder, p, k, t, i) for i, (p, k, t) in enumerate(members_named(path, content or ""))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    named = files.mapInPandas(run, schema)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    parts = F.filter(F.split("own", "/"), lambda x: x != "")
    # A file is looked up from each folder above it.
    places = files.select("path", folder.alias("own"), F.regexp_extract("path", "[^/]*$", 0).alias("name")).withColumn("above", F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    places = places.select("path", "own", "name", F.explode("above").alias("folder"))
    inner = F.when(F.col("folder") == "", F.col("own")).otherwise(F.substr("own", F.length("folder") + 2))
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substr("path", F.length("folder") + 2))
    same = F.when(F.col("kind") == "file", F.regexp_like(below, F.concat(F.lit("^"), F.col("pattern"), F.lit("$")))).otherwise(
        F.regexp_like(inner, F.concat(F.lit("^"), F.col("pattern"), F.lit("$"))) & ((F.col("name") == F.col("kind")) | ((F.col("kind") == "build.gradle") & F.startswith("name", F.lit("build.gradle")))))
    hits = named.join(places, "folder").where(same & (F.col("path") != F.col("root")))
    away = hits.where("taken").select("root", "path").distinct()
    kept = first_wins(hits.where("not taken"), ["root", "path"], ["turn"]).join(away, ["root", "path"], "left_anti")
    placed = kept.withColumn("pos", F.row_number().over(Window.partitionBy("root").orderBy("turn", "path")) - 1)
    return placed.where(F.col("pos") < cap).select("root", F.col("path").alias("member"), "pos")


def scans(files: DataFrame, depth: int = DEFAULT.scan_depth) -> DataFrame:
    """files (path, content) of a tree to the manifests of its scans: manifest_idx (from 0, the nearest folders first), project_root, manifest_type,
    path, file_pos.

    A scan begins in every folder with a manifest that lies in no other such one; its manifest is the first by priority. A workspace's members belong to
    its scan, after its own manifest. A solution is a list of members, and no manifest where none of them is there; a Gradle build's members are not read.
    A pnpm workspace file that names packages is asked instead of package.json."""
    named = m.placed_manifests(files.select("path"))
    roots = project_roots(named.select(F.concat("folder", F.when(F.col("folder") == "", "").otherwise("/"), F.lit("manifest")).alias("path")), depth)
    own = named.join(roots, "folder")
    above = F.when(F.contains("root", F.lit("/")), F.regexp_replace("root", "/[^/]*$", "")).otherwise("")
    tool = F.regexp_extract("root", "[^/]*$", 0)
    members = checkpointed(workspace_members(files).withColumn("folder", above).withColumn("by", F.when(tool.startswith("pnpm"), "package.json").when(F.endswith(tool, F.lit(".sln")), "sln").otherwise(tool)).withColumn("pnpm", tool.startswith("pnpm")))
    listed = members.where("by = 'sln'").select(F.col("root").alias("path")).distinct()
    usable = own.where("type <> 'sln'").unionByName(own.where("type = 'sln'").join(listed, "path", "left_semi").select(*own.columns))
    primary = checkpointed(first_wins(usable, ["folder"], ["turn", "path"]))
    asked = members.join(members.groupBy("folder", "by").agg(F.max("pnpm").alias("by_pnpm")), ["folder", "by"]).where("pnpm = by_pnpm")
    joined = primary.select("folder", "type", F.col("path").alias("matched")).join(asked, (F.col("type") == F.col("by")) & primary["folder"].eqNullSafe(asked["folder"]) & (F.col("pnpm") | (F.col("matched") == F.col("root")))).select(primary["folder"], F.col("member").alias("path"), (F.col("pos") + 1).alias("file_pos"))
    first = primary.where("type not in ('sln', 'go.work')").select("folder", "path", F.lit(0).alias("file_pos"))
    # A row a scan of one tree.
    numbers = primary.select("folder", "type", (F.row_number().over(Window.orderBy("depth", "folder")) - 1).alias("manifest_idx"))
    placed = first_wins(first.unionByName(joined), ["folder", "path"], ["file_pos"])
    return numbers.join(placed, "folder", "left").select("manifest_idx", F.col("folder").alias("project_root"), F.col("type").alias("manifest_type"), "path", "file_pos")


def read_poms(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """POMs (path, content) to three tables: parents (path, gav, parent), imports (path, gav, child, pos) and managed
    versions (path, gav, coord, version, pos)."""
    schema = "path string, gav string, parent string, imports array<string>, managed array<struct<coord: string, version: string>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    p = m.pom_parts(content or "")
                except m.ManifestError:
                    continue
                rows.append((path, p["gav"], p["parent"], p["imports"], [{"coord": c, "version": v} for c, v in p["managed"]]))
            yield pd.DataFrame(rows, columns=["path", "gav", "parent", "imports", "managed"])

    poms = files.where(F.col("path").rlike(r"(^|/)pom[\w.-]*\.xml$|\.pom$")).select("path", "content").mapInPandas(run, schema)
    imports = poms.select("path", "gav", F.posexplode("imports").alias("pos", "child"))
    managed = poms.select("path", "gav", F.posexplode("managed").alias("pos", "m")).select("path", "gav", "m.coord", "m.version", "pos")
    return poms.select("path", "gav", "parent"), imports, managed


def central_versions(references: DataFrame, props: DataFrame) -> DataFrame:
    """Package references (manifest_path, name, declared_version, ...) without a version get that of the nearest central
    file above them: props (path, content)."""
    schema = "props_folder string, name string, central string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(posixpath.dirname(path), n, v) for n, v in m.directory_packages_props(content or "").items()]
                except m.ManifestError:
                    continue
            yield pd.DataFrame(rows, columns=["props_folder", "name", "central"])

    known = props.where(F.col("path").rlike(r"(^|/)Directory\.Packages\.props$")).select("path", "content").mapInPandas(run, schema)
    folder = F.when(F.contains("manifest_path", F.lit("/")), F.regexp_replace("manifest_path", "/[^/]*$", "")).otherwise("")
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = references.select("manifest_path", "name", F.explode(above).alias("props_folder")).distinct()
    nearest = asked.join(known, ["props_folder", "name"]).groupBy("manifest_path", "name").agg(F.max_by("central", F.length("props_folder")).alias("central"))
    return references.join(nearest, ["manifest_path", "name"], "left").withColumn("declared_version", F.coalesce("declared_version", "central")).drop("central")
