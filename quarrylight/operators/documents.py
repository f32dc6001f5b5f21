"""The canonical tree of a page (a flat list of nodes in order), its chunks, and pages cut from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import DEFAULT
from quarrylight.functions.text import estimate_tokens
from quarrylight.operators.citations import footer
from quarrylight.operators.scratch import checkpointed


def rendered(node_type: str = "type") -> Column:
    """A node's Markdown; the templates of links and of diagrams as text are fixed values."""
    c = F.col
    or_empty = lambda x: F.coalesce(x, F.lit(""))
    link = F.when(c("github").isNotNull(), F.concat(
        F.lit("\n_Source: https://github.com/"), c("github.repo"), F.lit("/blob/"), c("github.sha"), F.lit("/"), c("github.path"),
        or_empty(F.concat(F.lit("#"), c("github.line_range"))), F.lit("_\n")))
    quoted = lambda s: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    nodes = F.when(F.size("nodes") > 0, F.array_join(F.transform("nodes", lambda n: F.concat(n["id"], F.lit("="), quoted(n["label"]))), ", ")).otherwise("(none)")
    edges = F.when(F.size("edges") > 0, F.array_join(F.transform("edges", lambda e: F.concat(e["from"], F.lit(" -> "), e["to"], or_empty(F.concat(F.lit(" ["), F.nullif(e["label"], F.lit("")), F.lit("]"))))), ", ")).otherwise("(none)")
    fallback = F.concat(F.lit("> Diagram (text fallback)\n>\n> nodes: "), nodes, F.lit("\n> edges: "), edges, or_empty(F.concat(F.lit("\n> view: "), c("source_url"))), F.lit("\n"))
    mermaid = F.concat(F.lit("```mermaid\n"), c("mermaid"), F.lit("\n```\n"))
    return (
        F.when(c(node_type) == "heading", F.concat(F.repeat(F.lit("#"), c("level")), F.lit(" "), c("title"), F.lit("\n")))
        .when(c(node_type) == "prose", F.concat(F.trim("markdown"), F.lit("\n")))
        .when(c(node_type) == "code", F.concat(F.lit("```"), or_empty(c("language")), F.lit("\n"), c("text"), F.lit("\n```"), or_empty(link)))
        .otherwise(F.when(c("mermaid").isNotNull() & ~F.coalesce("lossy", F.lit(False)), mermaid).otherwise(fallback))
    )


def with_heading(nodes: DataFrame, page: list[str] | None = None) -> DataFrame:
    """nodes with heading: seq and slug of the last heading up to them, null before the first."""
    order = Window.partitionBy(*(page or ["repo", "page_slug"])).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("heading", F.last(F.when(F.col("type") == "heading", F.struct("seq", "slug")), ignorenulls=True).over(order))


def in_sections(nodes: DataFrame, page: list[str] | None = None) -> DataFrame:
    """nodes with heading, the slug of the last heading before them; content that names another section is left out."""
    marked = with_heading(nodes, page)
    return marked.where((F.col("type") == "heading") | (F.col("heading.slug") == F.col("section_slug"))).withColumns({"heading_seq": F.col("heading.seq"), "heading": F.col("heading.slug")})


def sections(nodes: DataFrame) -> DataFrame:
    """One row a heading: repo, page_slug, section_slug, heading_seq, text (the nodes' Markdown, a line each), github
    (only if exactly one code node has a link)."""
    rows = in_sections(nodes).where("heading is not null").withColumn("markdown_out", rendered())
    linked = F.when((F.col("type") == "code") & F.col("github").isNotNull(), F.col("github"))
    grouped = rows.groupBy("repo", "page_slug", F.col("heading").alias("section_slug"), "heading_seq").agg(
        F.array_sort(F.collect_list(F.struct("seq", "markdown_out"))).alias("parts"), F.collect_list(linked).alias("links"))
    return grouped.select("repo", "page_slug", "section_slug", "heading_seq", F.array_join("parts.markdown_out", "\n").alias("text"), F.when(F.size("links") == 1, F.element_at("links", 1)).alias("github"))


def windows(text: Column, limit: int = DEFAULT.max_tokens, overlap: int = DEFAULT.overlap_tokens, separator: str = r"\n\n") -> Column:
    """Paragraphs packed into windows: a window ends before the paragraph that would take it over ``limit`` tokens, and the
    next begins with its last paragraphs that fit into ``overlap`` tokens, then that paragraph, even if the two exceed the
    limit. Empty paragraphs are passed over. A fold over the array."""
    joiner = "\n\n" if separator == r"\n\n" else "\n"
    parts = F.transform(F.filter(F.split(text, separator), lambda p: p != ""), lambda p: F.struct(p.alias("p"), estimate_tokens(p).alias("n")))
    empty = "array<struct<p: string, n: int>>"
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["n"])

    def tail(buffer: Column) -> Column:
        """The longest run of last paragraphs within the overlap."""
        step = lambda acc, x: F.when(
            ~acc["done"] & (acc["n"] + x["n"] <= overlap),
            F.struct(F.concat(F.array(x), acc["kept"]).alias("kept"), (acc["n"] + x["n"]).alias("n"), F.lit(False).alias("done")),
        ).otherwise(F.struct(acc["kept"].alias("kept"), acc["n"].alias("n"), F.lit(True).alias("done")))
        zero = F.struct(F.array().cast(empty).alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        return F.aggregate(F.reverse(buffer), zero, step)["kept"]

    def step(acc: Column, x: Column) -> Column:
        buffer, out = acc["buffer"], acc["out"]
        full = (F.size(buffer) > 0) & (total(buffer) + x["n"] > limit)
        flushed = F.concat(out, F.array(F.array_join(F.transform(buffer, lambda b: b["p"]), joiner)))
        return F.when(full, F.struct(flushed.alias("out"), F.concat(tail(buffer), F.array(x)).alias("buffer"))).otherwise(F.struct(out.alias("out"), F.concat(buffer, F.array(x)).alias("buffer")))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast(empty).alias("buffer"))
    last = lambda acc: F.when(F.size(acc["buffer"]) > 0, F.concat(acc["out"], F.array(F.array_join(F.transform(acc["buffer"], lambda b: b["p"]), joiner)))).otherwise(acc["out"])
    packed = F.aggregate(parts, zero, step, last)
    return F.when((estimate_tokens(text) <= limit) | (F.size(packed) == 0), F.array(text)).otherwise(packed)


def chunks(nodes: DataFrame, limit: int = DEFAULT.max_tokens, overlap: int = DEFAULT.overlap_tokens, separator: str = r"\n\n") -> DataFrame:
    """nodes to chunks, keyed by repo, page_slug, section_slug, ordinal. Of headings with one slug, the last counts."""
    last = Window.partitionBy("repo", "page_slug", "section_slug").orderBy(F.col("heading_seq").desc())
    kept = sections(nodes).withColumn("turn", F.row_number().over(last)).where("turn = 1")
    cut = kept.select("repo", "page_slug", "section_slug", "github", F.posexplode(windows(F.col("text"), limit, overlap, separator)).alias("ordinal", "text"))
    own = F.when(F.contains(F.col("text"), F.col("github.sha")), F.col("github"))
    return cut.select("repo", "page_slug", "section_slug", "ordinal", "text", *[own[c].alias(f"github_{c}") for c in ("repo", "sha", "path", "line_range")])


def parent_slugs(headings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """headings (keys, slug) with parent_slug: of the page's slugs that begin it, followed by a dash, the longest.
    Prefixes at dashes are looked up by equality, so a page's headings are never paired with each other."""
    keys = keys or ["repo", "page_slug"]
    names = headings.select(*keys, "slug").distinct()
    parts = F.split("slug", "-")
    prefixes = names.select(*keys, "slug", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))).alias("parent"))
    prefixes = prefixes.where("parent <> slug")
    found = prefixes.join(names.select(*keys, F.col("slug").alias("parent")), [*keys, "parent"], "left_semi").groupBy(*keys, "slug").agg(F.max_by("parent", F.length("parent")).alias("parent_slug"))
    return headings.drop("parent_slug").join(found, [*keys, "slug"], "left")


def subtree(nodes: DataFrame, root: str, page: list[str] | None = None) -> DataFrame:
    """The nodes of a heading and of all headings below it, by parent_slug. Each heading's ancestors are found by doubling:
    a round joins the ancestors known so far with their own, so that a chain of n levels takes log2(n) rounds. A chain that
    bites its own tail is followed until nothing is new."""
    page = page or ["repo", "page_slug"]
    links = nodes.where("type = 'heading'").select(*page, "slug", F.col("parent_slug").alias("above")).distinct()
    slugs = links.select(*page, "slug").distinct()
    pairs = checkpointed(links.where("above is not null").unionByName(slugs.withColumn("above", F.col("slug"))).distinct())
    count = pairs.count()
    while True:
        higher = pairs.select(*page, F.col("slug").alias("above"), F.col("above").alias("top"))
        pairs = checkpointed(pairs.join(higher, [*page, "above"]).select(*page, "slug", F.col("top").alias("above")).distinct())
        now = pairs.count()
        if now == count:
            break
        count = now
    found = pairs.where(F.col("above") == root).join(slugs.where(F.col("slug") == root).select(*page), page, "left_semi").select(*page, "slug")
    return nodes.join(found.withColumnRenamed("slug", "section_slug"), [*page, "section_slug"], "left_semi")


def budgeted(rows: DataFrame, tokens: str, page: list[str], order: list[str], limit: int = DEFAULT.page_tokens) -> DataFrame:
    """The first rows of each page whose tokens fit the limit together; the first row always stays. truncated says
    whether the page goes on."""
    upto = Window.partitionBy(*page).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*page)
    summed = rows.withColumns({"used": F.sum(tokens).over(upto), "place": F.row_number().over(Window.partitionBy(*page).orderBy(*order))})
    summed = summed.withColumn("truncated", F.max((F.col("used") > limit) & (F.col("place") > 1)).over(whole))
    return summed.where((F.col("used") <= limit) | (F.col("place") == 1)).drop("place")


def serialized(nodes: DataFrame, citations: DataFrame, limit: int = DEFAULT.page_tokens) -> DataFrame:
    """One row a page: markdown within the budget, a notice if it was cut, and the footer; truncated. citations (repo,
    source_url, commit_sha)."""
    rows = nodes.withColumn("markdown_out", rendered()).withColumn("tokens", estimate_tokens(F.col("markdown_out")))
    kept = budgeted(rows, "tokens", ["repo", "page_slug"], ["seq"], limit)
    pages = kept.groupBy("repo", "page_slug").agg(F.array_sort(F.collect_list(F.struct("seq", "markdown_out"))).alias("parts"), F.max("truncated").alias("truncated"))
    notice = F.when(F.col("truncated"), "\n\n_Truncated: ask for a section of this page to read on._").otherwise("")
    out = pages.join(citations, "repo")
    return out.select("repo", "page_slug", F.concat(F.array_join("parts.markdown_out", "\n"), notice, footer(F.col("source_url"), F.col("commit_sha"))).alias("markdown"), "truncated")


def contents(nodes: DataFrame) -> DataFrame:
    """The table of contents: headings in order."""
    return nodes.where("type = 'heading'").select("repo", "page_slug", "seq", "slug", "title", "level", "parent_slug", "has_diagrams")


def page_index(old: DataFrame, fetched: DataFrame, now_ms: int, ttl_ms: int = DEFAULT.page_ttl_ms) -> DataFrame:
    """What to do with each fetched page, by the cached one: store, cached, touch, replace, invalidate or retry.
    old (repo, fetched_at_ms, commit_sha), fetched (repo, not_found, empty_shell, first_commit_sha)."""
    both = fetched.join(old.select("repo", "fetched_at_ms", "commit_sha"), "repo", "left")
    fresh = F.col("fetched_at_ms") > now_ms - ttl_ms
    action = (
        F.when(F.coalesce(fresh, F.lit(False)), "cached").when(F.col("not_found"), "invalidate").when(F.col("empty_shell"), "retry")
        .when(F.col("fetched_at_ms").isNull(), "store").when(F.col("commit_sha").eqNullSafe(F.col("first_commit_sha")), "touch").otherwise("replace")
    )
    return both.withColumn("action", action)
