import random

import pytest
from pyspark.sql import functions as F

from quarrylight import schemas
from quarrylight.functions.text import WIKI_BASE
from quarrylight.operators import documents as doc
from quarrylight.operators import graph as gr
from quarrylight.sources import html_tree

SHA = "0123456789abcdef0123456789abcdef01234567"
BLOB = f"https://github.com/o/r/blob/{SHA}/src/main.py"


def nodes_of(spark, rows, repo="o/r"):
    columns = [c for c in spark.createDataFrame([], schemas.NODE).columns]
    full = [tuple({"repo": repo, "page_slug": "__root__", "seq": i, **r}.get(c) for c in columns) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schemas.NODE)


def heading(slug, level=2, parent=None):
    return {"type": "heading", "section_slug": slug, "slug": slug, "title": slug.title(), "level": level, "parent_slug": parent, "has_diagrams": False}


TREE = [
    {"type": "prose", "section_slug": "lost", "markdown": "before any heading [x](#intro)"},
    heading("intro"),
    {"type": "prose", "section_slug": "intro", "markdown": f"See [setup](#setup) and [other]({WIKI_BASE}a/b#part) and [file](https://github.com/a/b/blob/{SHA}/lib/x.py#L1) and [self]({WIKI_BASE}o/r)."},
    {"type": "code", "section_slug": "intro", "language": "python", "text": f"print(1)  # {SHA}", "github": ("o/r", SHA, "src/main.py", "L1-L2")},
    {"type": "code", "section_slug": "intro", "language": None, "text": "x", "github": ("a/b", SHA, "lib/y.py", None)},
    heading("setup"),
    {"type": "diagram", "section_slug": "setup", "lossy": False, "nodes": [("A", "Node a"), ("B", "b"), ("C::d", "bad")], "edges": [("A", "B", "calls"), ("A", "C::d", None)]},
    {"type": "prose", "section_slug": "intro", "markdown": "orphan [y](#setup)"},
    heading("setup-deep", 3, "setup"),
    {"type": "prose", "section_slug": "setup-deep", "markdown": "Deep."},
]


def test_edges_of_all_types_merge(spark):
    edges = {(r["edge_type"], r["src_id"], r["dst_id"]): r for r in gr.extract_edges(nodes_of(spark, TREE)).collect()}
    assert set(edges) == {
        ("section_link", "o/r#intro", "o/r#setup"), ("cross_repo_ref", "o/r#intro", "a/b"), ("code_ref", "o/r#intro", "a/b:lib/x.py"),
        ("code_ref", "o/r#intro", "o/r:src/main.py"), ("code_ref", "o/r#intro", "a/b:lib/y.py"),
        ("diagram_member", "o/r#setup", "o/r#setup::A"), ("diagram_member", "o/r#setup", "o/r#setup::B"), ("diagram_edge", "o/r#setup::A", "o/r#setup::B"),
    }
    cross = edges["cross_repo_ref", "o/r#intro", "a/b"]["metadata"]
    assert (cross["kinds"], cross["anchor"], cross["anchor_text"], cross["file_path"]) == (["anchor_link", "code_block", "prose_link"], "part", "file", "lib/y.py")
    assert edges["code_ref", "o/r#intro", "a/b:lib/x.py"]["metadata"]["source"] == "prose_link"


def test_chunks_follow_sections(spark):
    got = {(r["section_slug"], r["ordinal"]): r for r in doc.chunks(nodes_of(spark, TREE)).collect()}
    assert set(got) == {("intro", 0), ("setup", 0), ("setup-deep", 0)}
    assert got["intro", 0]["text"].startswith("## Intro\n") and got["intro", 0]["github_sha"] is None
    assert "nodes: A=\"Node a\", B=\"b\"" in got["setup", 0]["text"] and "A -> B [calls]" in got["setup", 0]["text"]
    single = [heading("a"), {"type": "code", "section_slug": "a", "text": f"at {SHA}", "github": ("o/r", SHA, "f.py", "L1")}]
    row = doc.chunks(nodes_of(spark, single)).first()
    assert (row["github_repo"], row["github_path"]) == ("o/r", "f.py") and f"_Source: https://github.com/o/r/blob/{SHA}/f.py#L1_" in row["text"]


def packed(text, limit, overlap, mark, joiner):
    tokens = lambda s: -(-len(s.encode("utf-16-le")) // 8)
    if tokens(text) <= limit:
        return [text]
    out, buffer = [], []
    for p in (p for p in text.split(mark) if p):
        if buffer and sum(map(tokens, buffer)) + tokens(p) > limit:
            out.append(joiner.join(buffer))
            tail = []
            for q in reversed(buffer):
                if sum(map(tokens, tail)) + tokens(q) > overlap:
                    break
                tail.insert(0, q)
            buffer = tail
        buffer.append(p)
    return out + ([joiner.join(buffer)] if buffer else []) or [text]


def test_windows_against_a_loop(spark):
    r = random.Random(1)
    texts = ["\n\n".join("x" * r.choice([3, 40, 90, 260, 900]) + str(i) for i in range(r.randrange(1, 25))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", doc.windows(F.col("t"), 128, 32).alias("w")).collect()
    assert {x["i"]: x["w"] for x in rows} == {i: packed(t, 128, 32, "\n\n", "\n\n") for i, t in enumerate(texts)}


def test_subtree_contents_and_budget(spark):
    nodes = nodes_of(spark, TREE)
    below = doc.subtree(nodes, "setup")
    assert sorted({r["section_slug"] for r in below.collect()}) == ["setup", "setup-deep"]
    assert [r["slug"] for r in doc.contents(nodes).orderBy("seq").collect()] == ["intro", "setup", "setup-deep"]
    citation = spark.createDataFrame([("o/r", WIKI_BASE + "o/r", SHA)], "repo string, source_url string, commit_sha string")
    whole, cut = (doc.serialized(nodes, citation, n).first() for n in (8000, 20))
    assert not whole["truncated"] and cut["truncated"] and len(cut["markdown"]) < len(whole["markdown"])
    assert whole["markdown"].endswith(f"(generated text, pinned to commit {SHA})*")


def test_parent_slugs(spark):
    rows = [("p", s) for s in ("a", "a-b", "a-b-c", "ab", "a-x-y", "b-c")]
    got = {r["slug"]: r["parent_slug"] for r in doc.parent_slugs(spark.createDataFrame(rows, "page string, slug string"), ["page"]).collect()}
    assert got == {"a": None, "a-b": "a", "a-b-c": "a-b", "ab": None, "a-x-y": "a", "b-c": None}


def test_page_cache_decisions(spark):
    old = spark.createDataFrame([("fresh", 90, "x"), ("same", 0, "x"), ("new", 0, "x")], "repo string, fetched_at_ms long, commit_sha string")
    new = spark.createDataFrame([(r, r == "gone", r == "shell", "x" if r in ("fresh", "same") else "y") for r in ("fresh", "same", "new", "gone", "shell", "first")], schemas.PAGE_META)
    got = {r["repo"]: r["action"] for r in doc.page_index(old, new, 100, 50).collect()}
    assert got == {"fresh": "cached", "same": "touch", "new": "replace", "gone": "invalidate", "shell": "retry", "first": "store"}


def test_neighbours(spark):
    edges = gr.extract_edges(nodes_of(spark, TREE))
    status = spark.createDataFrame([("o/r", 3), ("a/b", 1)], "repo string, edge_count int").withColumn("commit_sha", F.lit(SHA))
    assert [r["src_id"] for r in gr.find_neighbours(edges, status, "pages_referencing_file", file_path="lib/x.py").collect()] == ["o/r#intro"]
    assert [r["dst_id"] for r in gr.find_neighbours(edges, status, "section_links", repo="o/r", section_slug="intro").collect()] == ["o/r#setup"]
    inner = gr.find_neighbours(edges, status, "diagram_neighbors", repo="o/r", section_slug="setup").orderBy("pos").collect()
    assert [(r["edge_type"], r["source_node_id"]) for r in inner] == [("diagram_member", None), ("diagram_member", None), ("diagram_edge", "o/r#setup::A")]
    one = gr.find_neighbours(edges, status, "diagram_neighbors", repo="o/r", section_slug="setup", limit=1).first()
    assert one["truncated"]
    cross = gr.find_neighbours(edges, status, "cross_repo", repo="o/r").first()
    assert (cross["other"], cross["from_sections"], cross["sha"]) == ("a/b", ["o/r#intro"], SHA)
    for bad in (("nothing", {}), ("section_links", {"repo": "o/r"})):
        with pytest.raises(ValueError):
            gr.find_neighbours(edges, status, bad[0], **bad[1])
    with pytest.raises(ValueError):
        gr.find_edges(edges, edge_type="code_ref")


def test_semantic_order_keeps_the_unscored_last(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "node_id string, pos int")
    vectors = spark.createDataFrame([("c", [1.0, 0.0]), ("b", [0.0, 1.0]), ("d", [1.0])], "node_id string, vector array<double>")
    assert [r["node_id"] for r in gr.semantic_order(rows, vectors, [1.0, 0.2]).orderBy("pos").collect()] == ["c", "b", "d", "a"]


PAGE = f"""<html><body>
<body-content-section><div id="intro"><h1>Intro</h1></div><documentation-markdown><h1>Intro</h1><p>Hello <b>you</b>, see <a href="#setup">setup</a>.</p>
<ul><li>one</li><li>two <code>x</code></li></ul><pre><code class="language-python">print(1)
</code></pre><p><a href="{BLOB}#L1-L2">source</a></p></documentation-markdown></body-content-section>
<body-content-section><div id="intro-more"><h3>More</h3></div><code-documentation-diagram-inline><svg>
<g class="node"><title>A</title><text>Start</text></g><g class="node"><title>B</title></g><g class="edge"><title>A-&gt;B</title><text>go</text></g></svg></code-documentation-diagram-inline></body-content-section>
</body></html>"""


def test_html_tree(spark):
    pages = spark.createDataFrame([("o/r", PAGE), ("n/f", "<app-not-found></app-not-found>"), ("e/s", "<div>loading"), ("z/z", None)], "repo string, html string")
    rows = html_tree.canonical_nodes(pages).orderBy("seq").collect()
    assert [(r["type"], r["section_slug"]) for r in rows] == [("heading", "intro"), ("prose", "intro"), ("code", "intro"), ("heading", "intro-more"), ("diagram", "intro-more")]
    assert rows[1]["markdown"].startswith("Hello **you**, see [setup](#setup).\n\n* one\n* two `x`")
    assert (rows[2]["language"], rows[2]["text"], rows[2]["github"]["path"]) == ("python", "print(1)", "src/main.py")
    assert (rows[3]["parent_slug"], rows[3]["level"], rows[3]["has_diagrams"]) == ("intro", 3, True)
    assert rows[4]["mermaid"] == 'flowchart TD\n  N0["Start"]\n  N1["B"]\n  N0 -->|go| N1'
    meta = {r["repo"]: (r["not_found"], r["empty_shell"], r["first_commit_sha"]) for r in html_tree.page_meta(pages).collect()}
    assert meta == {"o/r": (False, False, SHA), "n/f": (True, False, None), "e/s": (False, True, None), "z/z": (False, True, None)}


def test_titles_cut_in_a_reference(spark):
    pages = spark.createDataFrame([(1, "<title>a &lt;b&gt; &amp;&amp;&amp</title><p><a href='x?a&ltb'>y</a>"), (2, "<title>&amp;amp; &#38 &</title>")], "page_id long, html string")
    assert [tuple(r) for r in html_tree.text_nodes(pages, "page_id").orderBy("page_id").collect()] == [(1, "a <b> &&&amp", 1, 3), (2, "&amp; &#38 &", 0, 1)]
