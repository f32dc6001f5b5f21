"""Edges of the knowledge graph from canonical nodes, their merge, and one-hop questions to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import DEFAULT
from quarrylight.functions.text import WIKI_BASE, diagram_node_id, file_id, markdown_links, prose_blob_links, section_id, wiki_link
from quarrylight.functions.vector import cosine
from quarrylight.operators.documents import in_sections
from quarrylight.schemas import EDGE_KEY

FIELDS = ["sha", "line_range", "source", "label", "anchor_text", "anchor", "file_path"]


def _edge(rows: DataFrame, src_kind: str, src: Column, dst_kind: str, dst: Column, edge_type: str, order: Column, kinds: list[str] | None = None, **meta: Column) -> DataFrame:
    metadata = [meta.get(f, F.lit(None).cast("string")).cast("string").alias(f) for f in FIELDS]
    values = F.array(*[F.lit(k) for k in kinds]) if kinds else F.array().cast("array<string>")
    return rows.select(
        F.lit(src_kind).alias("src_kind"), src.alias("src_id"), F.lit(dst_kind).alias("dst_kind"), dst.alias("dst_id"), F.lit(edge_type).alias("edge_type"), "repo",
        *metadata, values.alias("kinds"), order.alias("order"))


def extract_edges(nodes: DataFrame, base: str = WIKI_BASE) -> DataFrame:
    """nodes to merged edges. Content outside its section is left out."""
    rows = in_sections(nodes).where("type <> 'heading' and heading is not null")
    here = section_id(F.col("repo"), F.col("heading"))
    order = lambda step, at: F.struct(F.col("page_slug"), F.col("seq"), F.lit(step).alias("step"), at.cast("int").alias("at"))
    first = F.lit(0)
    code = rows.where("type = 'code' and github is not null")
    g = F.col("github")
    found = [
        _edge(code, "section", here, "file", file_id(g["repo"], g["path"]), "code_ref", order(0, first), sha=g["sha"], line_range=g["line_range"]),
        _edge(code.where("github.repo <> repo"), "section", here, "repo", g["repo"], "cross_repo_ref", order(1, first), ["code_block"], file_path=g["path"], sha=g["sha"]),
    ]
    diagrams = rows.where("type = 'diagram'").withColumn("members", F.filter("nodes", lambda n: ~F.contains(n["id"], F.lit("::"))))
    members = diagrams.select("repo", "page_slug", "seq", "heading", F.posexplode("members").alias("at", "n"))
    found.append(_edge(members, "section", here, "diagram_node", diagram_node_id(F.col("repo"), F.col("heading"), F.col("n.id")), "diagram_member", order(0, F.col("at")), label=F.col("n.label")))
    valid = F.transform("members", lambda n: n["id"])
    inner = diagrams.withColumn("inner", F.filter("edges", lambda e: F.array_contains(valid, e["from"]) & F.array_contains(valid, e["to"])))
    links = inner.select("repo", "page_slug", "seq", "heading", F.posexplode("inner").alias("at", "e"))
    end = lambda c: diagram_node_id(F.col("repo"), F.col("heading"), F.col(c))
    found.append(_edge(links, "diagram_node", end("e.from"), "diagram_node", end("e.to"), "diagram_edge", order(1, F.col("at")), label=F.nullif(F.col("e.label"), F.lit(""))))

    prose = rows.where("type = 'prose'")
    anchors = prose.select("repo", "page_slug", "seq", "heading", F.posexplode(markdown_links(F.col("markdown"), base)).alias("at", "link"))
    wiki = wiki_link(F.col("link.target"), base)
    anchors = anchors.withColumn("wiki", wiki).withColumn("anchor", F.when(F.startswith("link.target", F.lit("#")), F.substr("link.target", F.lit(2))).when(F.col("wiki.repo") == F.col("repo"), F.col("wiki.anchor")))
    found.append(_edge(anchors.where("anchor <> ''"), "section", here, "section", section_id(F.col("repo"), F.col("anchor")), "section_link", order(0, F.col("at")), anchor_text=F.col("link.label")))
    other = anchors.where("wiki.repo <> repo")
    found.append(_edge(other, "section", here, "repo", F.col("wiki.repo"), "cross_repo_ref", order(0, F.col("at")), ["anchor_link"], anchor_text=F.col("link.label"), anchor=F.col("wiki.anchor")))
    blobs = prose.select("repo", "page_slug", "seq", "heading", F.posexplode(prose_blob_links(F.col("markdown"))).alias("at", "b"))
    found.append(_edge(blobs, "section", here, "file", file_id(F.col("b.repo"), F.col("b.path")), "code_ref", order(1, F.col("at") * 2), sha=F.col("b.sha"), line_range=F.col("b.line_range"), source=F.lit("prose_link")))
    found.append(_edge(blobs.where("b.repo <> repo"), "section", here, "repo", F.col("b.repo"), "cross_repo_ref", order(1, F.col("at") * 2 + 1), ["prose_link"], anchor_text=F.col("b.label"), file_path=F.col("b.path"), sha=F.col("b.sha")))
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    return merge_edges(everything)


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges with equal keys become one: of each metadata field the last value, of kinds the sorted union."""
    latest = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("order"))).alias(f) for f in FIELDS]
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds")
    merged = edges.groupBy(*EDGE_KEY).agg(*latest, kinds)
    return merged.select(*EDGE_KEY, F.struct(*FIELDS, "kinds").alias("metadata"), F.lit("").alias("commit_sha"), F.lit(0).cast("long").alias("indexed_at_ms"))


def canonical_order(edges: DataFrame) -> DataFrame:
    return edges.orderBy(F.concat_ws("::", *EDGE_KEY))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def find_edges(edges: DataFrame, **wanted: str) -> DataFrame:
    """Edges by equality on src_kind, src_id, dst_kind, dst_id, repo, edge_type; one of src_id, dst_id, repo is needed."""
    if not wanted.keys() & {"src_id", "dst_id", "repo"}:
        raise ValueError("a source, a destination or a repository is needed")
    for column, value in wanted.items():
        edges = edges.where(F.col(column) == value)
    return edges


def neighbour_order() -> list[Column]:
    return [F.col("indexed_at_ms").desc(), F.col("dst_id")]


def limited(rows: DataFrame, order: list, limit: int = DEFAULT.neighbour_limit, keys: list[str] | None = None) -> DataFrame:
    """The first rows in order, pos from 1, and whether there are more."""
    limit = max(1, min(DEFAULT.max_neighbours, limit))
    by = Window.partitionBy(*(keys or [F.lit(1)]))
    placed = rows.withColumn("pos", F.row_number().over(by.orderBy(*order))).where(F.col("pos") <= limit + 1)
    return placed.withColumn("truncated", F.max(F.col("pos") > limit).over(by)).where(F.col("pos") <= limit)


def pages_referencing_file(edges: DataFrame, path: str, repo: str | None = None, limit: int = DEFAULT.neighbour_limit) -> DataFrame:
    """Sections with a reference to the file; without a repository, to a file of that path in any."""
    files = edges.where((F.col("dst_kind") == "file") & (F.col("edge_type") == "code_ref"))
    files = files.where(F.col("dst_id") == f"{repo}:{path}" if repo else F.endswith("dst_id", F.lit(":" + path)))
    return limited(files.withColumn("direction", F.lit("in")), neighbour_order(), limit)


def both_ways(edges: DataFrame, node: str, edge_type: str, direction: str = "both", limit: int = DEFAULT.neighbour_limit) -> DataFrame:
    """Edges that leave the node, then those that reach it."""
    if direction not in ("in", "out", "both"):
        raise ValueError(f"no direction {direction}")
    own = edges.where(F.col("edge_type") == edge_type)
    out = own.where(F.col("src_id") == node).withColumns({"direction": F.lit("out"), "half": F.lit(0)})
    back = own.where(F.col("dst_id") == node).withColumns({"direction": F.lit("in"), "half": F.lit(1)})
    rows = out if direction == "out" else back if direction == "in" else out.unionByName(back)
    return limited(rows, ["half", *neighbour_order(), "src_id"], limit).drop("half")


def section_links(edges: DataFrame, repo: str, slug: str, direction: str = "both", limit: int = DEFAULT.neighbour_limit) -> DataFrame:
    return both_ways(edges, f"{repo}#{slug}", "section_link", direction, limit)


def diagram_neighbours(edges: DataFrame, repo: str, slug: str, node: str | None = None, limit: int = DEFAULT.neighbour_limit) -> DataFrame:
    """Of a diagram's node, the edges out and in; of a section, its members and then the edges among them."""
    if node is not None:
        return both_ways(edges, f"{repo}#{slug}::{node}", "diagram_edge", "both", limit)
    members = edges.where((F.col("src_id") == f"{repo}#{slug}") & (F.col("edge_type") == "diagram_member"))
    inner = edges_among(edges.where("edge_type = 'diagram_edge'"), members.select(F.col("dst_id").alias("id")))
    rows = members.withColumns({"half": F.lit(0), "source_node_id": F.lit(None).cast("string")}).unionByName(inner.withColumns({"half": F.lit(1), "source_node_id": F.col("src_id")}))
    return limited(rows, ["half", *neighbour_order(), "src_id"], limit).drop("half")


def edges_among(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members (id)."""
    ids = members.select("id").distinct()
    for end in ("src_id", "dst_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges


def _by_other(edges: DataFrame, repo: str, other: str, direction: str) -> DataFrame:
    """repo, other, from_sections (in the order first seen), kinds (sorted), sha (of the first edge). Edges are first
    combined by section, so an array holds each section once, however many edges there are."""
    pos = F.struct((F.col("indexed_at_ms") * -1).alias("age"), "dst_id", "src_id")
    rows = edges.where("edge_type = 'cross_repo_ref'").select(F.col(repo).alias("repo"), F.col(other).alias("other"), "src_id", "commit_sha", F.explode_outer("metadata.kinds").alias("kind"), pos.alias("pos"))
    sections = rows.groupBy("repo", "other", "src_id").agg(F.min("pos").alias("pos"), F.min_by("commit_sha", "pos").alias("sha"), F.collect_set("kind").alias("kinds"))
    grouped = sections.groupBy("repo", "other").agg(
        F.array_sort(F.collect_list(F.struct("pos", "src_id"))).alias("sections"), F.min_by("sha", "pos").alias("sha"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))
    return grouped.select("repo", "other", F.col("sections.src_id").alias("from_sections"), "kinds", "sha", F.lit(direction).alias("direction"))


def cross_repo_out(edges: DataFrame) -> DataFrame:
    """The repositories that each one refers to."""
    return _by_other(edges, "repo", "dst_id", "out")


def cross_repo_in(edges: DataFrame) -> DataFrame:
    """The repositories that refer to each one; kinds are not told from this end."""
    return _by_other(edges, "dst_id", "repo", "in").withColumn("kinds", F.array().cast("array<string>"))


def dep_links(dependencies: DataFrame, repos: DataFrame, status: DataFrame, repo: str) -> DataFrame:
    """Repositories with an index that a project's dependencies resolve to, but for itself. Not made distinct."""
    resolved = dependencies.join(repos.select(F.col("query").alias("name"), "ecosystem", F.concat("owner", F.lit("/"), "repo").alias("other")), ["name", "ecosystem"])
    indexed = status.select(F.col("repo").alias("other"), F.col("commit_sha").alias("sha"))
    return resolved.join(indexed, "other").where(F.col("other") != repo).select(F.lit(repo).alias("repo"), "other", F.array().cast("array<string>").alias("from_sections"), F.array(F.lit("dep_link")).alias("kinds"), F.coalesce("sha", F.lit("")).alias("sha"), F.lit("out").alias("direction"))


def cross_repo(edges: DataFrame, status: DataFrame, repo: str, direction: str = "both", deps: DataFrame | None = None, limit: int = DEFAULT.neighbour_limit) -> DataFrame:
    """Out, in, then derived dependency links of a repository; the commit of the index counts before the edge's own."""
    parts = []
    if direction in ("out", "both"):
        parts.append(cross_repo_out(edges).withColumn("half", F.lit(0)))
    if direction in ("in", "both"):
        parts.append(cross_repo_in(edges).withColumn("half", F.lit(1)))
    if deps is not None and direction in ("out", "both"):
        parts.append(deps.withColumn("half", F.lit(2)))
    if not parts:
        raise ValueError(f"no direction {direction}")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    known = status.select(F.col("repo").alias("other"), F.col("commit_sha").alias("known"))
    rows = rows.where(F.col("repo") == repo).join(known, "other", "left").withColumn("sha", F.coalesce("known", "sha")).drop("known")
    return limited(rows, ["half", "other"], limit).drop("half")


def ready(status: DataFrame) -> DataFrame:
    """Repositories whose graph has been built, at whatever time."""
    return status.where("edge_count >= 0")


def semantic_order(neighbours: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """neighbours (node_id, pos) by likeness of their section's vector to the query's; those without one stay last, in
    their order. vectors (node_id, vector); vectors of another length score 0."""
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = neighbours.join(vectors, "node_id", "left").withColumn("semantic", F.when(F.col("vector").isNotNull(), cosine(F.col("vector"), target)))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("semantic").isNull(), F.col("semantic").desc(), "pos")
    return scored.drop("vector").withColumn("pos", F.row_number().over(order))


KINDS = {
    "pages_referencing_file": {"file_path"}, "section_links": {"repo", "section_slug"}, "diagram_neighbors": {"repo", "section_slug"}, "cross_repo": {"repo"},
}


def find_neighbours(edges: DataFrame, status: DataFrame, kind: str, **args) -> DataFrame:
    """One of the four questions, after a check of its arguments."""
    if kind not in KINDS:
        raise ValueError(f"no question {kind}")
    missing = {a for a in KINDS[kind] if not args.get(a)}
    if missing:
        raise ValueError(f"{kind} needs {', '.join(sorted(missing))}")
    limit = args.get("limit", DEFAULT.neighbour_limit)
    if kind == "pages_referencing_file":
        return pages_referencing_file(edges, args["file_path"], args.get("github_repo"), limit)
    if kind == "section_links":
        return section_links(edges, args["repo"], args["section_slug"], args.get("direction", "both"), limit)
    if kind == "diagram_neighbors":
        return diagram_neighbours(edges, args["repo"], args["section_slug"], args.get("diagram_node_id"), limit)
    return cross_repo(edges, status, args["repo"], args.get("direction", "both"), args.get("dependencies"), limit)
