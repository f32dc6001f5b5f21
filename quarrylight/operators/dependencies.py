"""Dependency inventory: versions filled from parents and bills of materials, repositories resolved from captured registry
answers, frameworks recognised, changes between two scans."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.config import DEFAULT
from quarrylight.functions.text import fuzzy_repo, github_repo, semver_key
from quarrylight.operators.scratch import checkpointed

# Framework, confidence, repository, match, name or prefix, ecosystem.
SIGNATURES = [
    ("next.js", "high", "vercel/next.js", "exact", "next", "npm"),
    ("Nuxt", "high", "nuxt/nuxt", "exact", "nuxt", "npm"),
    ("React", "high", "facebook/react", "exact", "react", "npm"),
    ("Vue", "high", "vuejs/core", "exact", "vue", "npm"),
    ("Angular", "high", "angular/angular", "exact", "@angular/core", "npm"),
    ("Svelte", "high", "sveltejs/svelte", "exact", "svelte", "npm"),
    ("NestJS", "high", "nestjs/nest", "exact", "@nestjs/core", "npm"),
    ("Express", "high", "expressjs/express", "exact", "express", "npm"),
    ("Fastify", "high", "fastify/fastify", "exact", "fastify", "npm"),
    ("Django", "high", "django/django", "exact", "django", "pypi"),
    ("Flask", "high", "pallets/flask", "exact", "flask", "pypi"),
    ("FastAPI", "high", "tiangolo/fastapi", "exact", "fastapi", "pypi"),
    ("Spring Boot", "high", "spring-projects/spring-boot", "prefix", "org.springframework.boot:spring-boot-starter-", "maven"),
    ("Spring Framework", "high", "spring-projects/spring-framework", "exact", "org.springframework:spring-context", "maven"),
    ("Spring Framework", "high", "spring-projects/spring-framework", "exact", "org.springframework:spring-core", "maven"),
    ("Rails", "high", "rails/rails", "exact", "rails", "gem"),
    ("Gin", "high", "gin-gonic/gin", "exact", "github.com/gin-gonic/gin", "go"),
    ("Echo", "high", "labstack/echo", "exact", "github.com/labstack/echo/v4", "go"),
    ("Fiber", "high", "gofiber/fiber", "exact", "github.com/gofiber/fiber/v2", "go"),
    ("Chi", "high", "go-chi/chi", "exact", "github.com/go-chi/chi/v5", "go"),
    ("Actix", "high", "actix/actix-web", "exact", "actix-web", "cargo"),
    ("Axum", "high", "tokio-rs/axum", "exact", "axum", "cargo"),
    ("Rocket", "high", "rwf2/Rocket", "exact", "rocket", "cargo"),
    ("Tokio", "medium", "tokio-rs/tokio", "exact", "tokio", "cargo"),
    ("ASP.NET Core", "high", "dotnet/aspnetcore", "exact", "Microsoft.AspNetCore.App", "nuget"),
    ("Blazor", "high", "dotnet/aspnetcore", "exact", "Microsoft.AspNetCore.Components.Web", "nuget"),
]


def detect_frameworks(deps: DataFrame, signatures: list[tuple] | None = None) -> DataFrame:
    """deps (project, name, ecosystem, pos) to one row a framework and project: the first dependency that shows it, by
    the first signature that fits the dependency. Exact and prefix matches are looked up by equality in both cases:
    prefixes by the lengths that occur."""
    spark = deps.sparkSession
    rows = [(i, *s) for i, s in enumerate(SIGNATURES if signatures is None else signatures)]
    table = spark.createDataFrame(rows, "turn int, framework string, confidence string, source_repo string, match string, pattern string, ecosystem string")
    lengths = sorted({len(r[5]) for r in rows if r[4] == "prefix"})
    names = [F.struct(F.lit("exact").alias("match"), F.col("name").alias("pattern"))]
    names += [F.struct(F.lit("prefix").alias("match"), F.substr("name", F.lit(1), F.lit(n)).alias("pattern")) for n in lengths]
    keyed = deps.select("project", "name", "ecosystem", "pos", F.explode(F.array(*names)).alias("k")).select("project", "name", "ecosystem", "pos", "k.match", "k.pattern")
    hits = keyed.join(F.broadcast(table), ["ecosystem", "match", "pattern"])
    own = Window.partitionBy("project", "pos", "name").orderBy("turn")
    first = Window.partitionBy("project", "framework").orderBy("pos", "turn")
    hits = hits.withColumn("n", F.row_number().over(own)).where("n = 1").withColumn("n", F.row_number().over(first)).where("n = 1")
    return hits.select("project", "framework", "confidence", "source_repo", "name", "ecosystem", "pos")


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key, the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def bom_versions(imports: DataFrame, managed: DataFrame, edges: DataFrame, depth: int | None = DEFAULT.bom_depth) -> DataFrame:
    """The version map of each project: the closure over bills of materials, level by level, each bill once a project; down to ``depth``
    levels, or to the last one if that is None.

    imports (project, gav, pos): what the project imports. edges (gav, child, pos): what bills import. managed (gav,
    coord, version, pos). Nearer levels win; in a level the later sibling wins, and in a bill the later entry.
    """
    # Each level is written, as the next ones read it several times.
    frontier = checkpointed(first_wins(imports, ["project", "gav"], ["pos"]).select("project", "gav", F.array(F.col("pos").cast("int")).alias("path")).withColumn("depth", F.lit(0)))
    seen = frontier
    for level in count(1) if depth is None else range(1, depth):
        below = frontier.join(edges, "gav").select("project", F.col("child").alias("gav"), F.concat("path", F.array(F.col("pos").cast("int"))).alias("path"))
        below = first_wins(below, ["project", "gav"], ["path"]).join(seen.select("project", "gav"), ["project", "gav"], "left_anti")
        frontier = checkpointed(below.withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        # Of a long chain, the levels so far are one table again now and then.
        seen = seen.unionByName(frontier) if level % 8 else checkpointed(seen.unionByName(frontier))
    # A bill's last entry of a coordinate is the same for every project, so only that is joined; it is combined before the shuffle. Nulls are least.
    last = managed.groupBy("gav", "coord").agg(F.max(F.struct("pos", "version")).alias("last")).select("gav", "coord", "last.version")
    entries = seen.join(last, "gav").select("project", "coord", "version", "depth", "path")
    return first_wins(entries, ["project", "coord"], ["depth", F.col("path").desc()]).select("project", "coord", "version", "depth")


def fill_versions(deps: DataFrame, versions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """deps of Maven without a version get that of the map (project, coord, version); declared versions stay."""
    keys = keys or ["project"]
    known = versions.select(*keys, F.col("coord").alias("name"), F.lit("maven").alias("ecosystem"), F.col("version").alias("__v"))
    return deps.join(known, [*keys, "name", "ecosystem"], "left").withColumn("declared_version", F.coalesce("declared_version", "__v")).drop("__v")


def with_parents(imports: DataFrame, parents: DataFrame, parent_imports: DataFrame) -> DataFrame:
    """A project's imports and, after them, those of its parent, one level up. parents (project, gav)."""
    last = imports.groupBy("project").agg(F.max("pos").alias("last"))
    more = parents.join(parent_imports.select(F.col("gav"), F.col("child"), "pos"), "gav").join(last, "project", "left")
    more = more.select("project", F.col("child").alias("gav"), (F.coalesce("last", F.lit(-1)) + 1 + F.col("pos")).cast("int").alias("pos"))
    return imports.select("project", "gav", F.col("pos").cast("int").alias("pos")).unionByName(more)


#: Where a registry's answer names the repository, by confidence; the first that is on the host wins.
FIELDS = {
    "npm": [("$.repository.url", "high"), ("$.repository", "high")],
    "pypi": [("$.info.project_urls.Source", "high"), ("$.info.project_urls.source", "high"), ("$.info.project_urls.Repository", "high"), ("$.info.project_urls.repository", "high"), ("$.info.project_urls.Homepage", "medium"), ("$.info.home_page", "medium")],
    "cargo": [("$.crate.repository", "high"), ("$.crate.homepage", "medium")],
    "composer": [("$.source.url", "high"), ("$.homepage", "medium")],
    "gem": [("$.source_code_uri", "high"), ("$.homepage_uri", "medium")],
    "maven": [("$.scm.url", "high"), ("$.scm.connection", "high"), ("$.url", "medium")],
    "nuget": [("$.repository.url", "high"), ("$.projectUrl", "medium")],
    "go": [("$.repository", "high"), ("$.go_import", "medium")],
}
SOURCES = {"npm": "npm-registry", "pypi": "pypi", "cargo": "crates-io", "composer": "packagist", "gem": "rubygems", "maven": "maven-central", "nuget": "nuget", "go": "go-proxy"}
#: Answers without a repository on the host: a guess from the name, or nothing.
GUESS_EMPTY = ("cargo", "composer")
#: Registries whose failure is no ground for a guess.
NO_GUESS = ("maven", "go")


def resolve_repos(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """packages (name, ecosystem) with owner, repo, source, confidence and alternates, by captured answers: registry
    (name, ecosystem, http_status, json). Unknown packages (404) resolve to nothing, failures (no answer or another
    status) to a guess of low confidence."""
    answered = packages.join(registry, ["name", "ecosystem"], "left")
    stripped = lambda url: F.regexp_replace(F.regexp_replace(url, "^scm:git:", ""), "^scm:", "")

    def found(ecosystem: str) -> Column:
        return F.filter(F.array(*[F.struct(github_repo(stripped(F.get_json_object("json", path))).alias("full"), F.lit(level).alias("level"), F.lit(i).alias("i")) for i, (path, level) in enumerate(FIELDS[ecosystem])]), lambda x: x["full"].isNotNull())

    matches = F.coalesce(*[F.when(F.col("ecosystem") == e, found(e)) for e in FIELDS])
    go = (F.col("ecosystem") == "go") & F.startswith("name", F.lit("github.com/"))
    path = F.split("name", "/")
    direct = F.when(go & (F.size(path) >= 3), F.concat(F.get(path, F.lit(1)), F.lit("/"), F.get(path, F.lit(2))))
    ok = F.col("http_status").between(200, 299)
    shape = F.when(F.col("ecosystem") == "maven", F.col("name").rlike("^[^:]+:[^:]+$")).when(F.col("ecosystem") == "composer", F.col("name").rlike(r"^[\w.-]+/[\w.-]+$")).when(F.col("ecosystem") == "nuget", F.col("name").rlike(r"^[\w.-]+$")).otherwise(True)
    guess = F.when(F.coalesce(F.col("http_status") == 404, F.lit(False)) | F.col("ecosystem").isin(*NO_GUESS) | ~shape, None).when(ok & ~F.col("ecosystem").isin(*GUESS_EMPTY), None).otherwise(fuzzy_repo(F.col("name")))
    rows = answered.withColumn("matches", F.when(ok & shape & ~go, matches)).withColumn("best", F.when(F.size("matches") > 0, F.element_at("matches", 1)))
    rows = rows.withColumn("direct", F.when(ok, direct)).withColumn("guess", guess)
    full = F.coalesce("direct", "best.full", "guess")
    source = F.when(F.col("direct").isNotNull(), "go-proxy").when(F.col("best").isNotNull(), F.when((F.col("ecosystem") == "go") & (F.col("best.level") == "medium"), "go-vanity").otherwise(F.coalesce(*[F.when(F.col("ecosystem") == e, s) for e, s in SOURCES.items()]))).when(F.col("guess").isNotNull(), "fuzzy")
    level = F.when(F.col("direct").isNotNull(), "high").when(F.col("best").isNotNull(), F.col("best.level")).when(F.col("guess").isNotNull(), "low")
    rows = rows.withColumns({"full": full, "source": source, "confidence": level})
    others = F.array_distinct(F.transform(F.filter("matches", lambda m: m["full"] != F.col("full")), lambda m: m["full"]))
    return rows.select("name", "ecosystem", F.split_part("full", F.lit("/"), F.lit(1)).alias("owner"), F.split_part("full", F.lit("/"), F.lit(2)).alias("repo"), "source", "confidence", F.coalesce(F.when(F.size("matches") > 0, others), F.array().cast("array<string>")).alias("alternates"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """versions (name, version) to the latest of each name: stable ones before pre-releases."""
    keyed = versions.withColumn("key", semver_key(F.col("version"))).where("key is not null")
    return keyed.groupBy("name").agg(F.max_by("version", F.struct("key.stable", "key.major", "key.minor", "key.patch", "key.pre")).alias("version"))


def resolve_and_probe(deps: DataFrame, repos: DataFrame, wiki_status: DataFrame) -> DataFrame:
    """deps with their repository and whether it has a wiki; null if it was never probed."""
    known = repos.select(F.col("query").alias("name"), "ecosystem", F.concat("owner", F.lit("/"), "repo").alias("resolved"), "source", "confidence")
    return deps.join(known, ["name", "ecosystem"], "left").join(wiki_status.select(F.col("repo").alias("resolved"), "has_wiki", "page_count"), "resolved", "left")


def wanted_kinds(deps: DataFrame, include_dev: bool = DEFAULT.include_dev, include_optional: bool = DEFAULT.include_optional) -> DataFrame:
    kinds = ["runtime"] + ["dev"] * include_dev + ["optional"] * include_optional
    return deps.where(F.coalesce("kind", F.lit("runtime")).isin(*kinds))


def removed(before: DataFrame, after: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Dependencies of the scan before that the scan after no longer has, whatever their kind."""
    key = key or ["name", "ecosystem"]
    return before.join(after.select(*key).distinct(), key, "left_anti")


def orphaned_repos(gone: DataFrame, staying: DataFrame, repos: DataFrame) -> DataFrame:
    """Repositories that only removed dependencies resolved to."""
    full = repos.select(F.col("query").alias("name"), "ecosystem", F.concat("owner", F.lit("/"), "repo").alias("resolved"))
    key = ["name", "ecosystem"]
    return gone.join(full, key).select("resolved").distinct().join(staying.join(full, key).select("resolved").distinct(), "resolved", "left_anti")


def watch_set(roots: DataFrame, cap: int = DEFAULT.watch_cap) -> DataFrame:
    """roots (path, class: 0 root, 1 extra, 2 member; root_idx, pos) to the paths that are watched: roots first."""
    return first_wins(roots, ["path"], ["class", "root_idx", "pos"]).orderBy("class", "root_idx", "pos").limit(cap)


# Folders that a scan does not enter.
IGNORED = ("node_modules", ".git", "dist", "build", "target", "vendor", ".venv", "venv", "__pycache__", ".next", ".gradle", "bin", "obj")


def project_roots(files: DataFrame, depth: int = DEFAULT.scan_depth) -> DataFrame:
    """files (path, relative) to the folders that hold a manifest, down to a depth, and are not below another such one.
    Ancestors are looked up by equality on the prefixes of a path."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    parts = F.filter(F.split("folder", "/"), lambda p: p != "")
    folders = files.select(folder.alias("folder")).distinct().withColumn("parts", parts).where((F.size("parts") <= depth) & ~F.arrays_overlap("parts", F.array(*[F.lit(i) for i in IGNORED])))
    above = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))
    up = folders.where(F.size("parts") > 0).select("folder", F.explode(above).alias("up"))
    nested = up.join(folders.select(F.col("folder").alias("up")), "up", "left_semi").select("folder").distinct()
    return folders.join(nested, "folder", "left_anti").select("folder", F.size("parts").alias("depth"))
