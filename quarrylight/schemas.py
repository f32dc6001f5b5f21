"""Schemas of the engine's tables, and the grammar of node identifiers."""

from __future__ import annotations

GITHUB = "struct<repo: string, sha: string, path: string, line_range: string>"
DIAGRAM_NODES = "array<struct<id: string, label: string>>"
DIAGRAM_EDGES = "array<struct<from: string, to: string, label: string>>"
#: One wide row for the four kinds of node: heading, prose, code, diagram.
NODE = (
    "repo string, page_slug string, seq int, type string, section_slug string, slug string, title string, level int, parent_slug string, "
    f"has_diagrams boolean, markdown string, language string, text string, github {GITHUB}, svg_base64 string, mermaid string, source_url string, "
    f"lossy boolean, nodes {DIAGRAM_NODES}, edges {DIAGRAM_EDGES}"
)
PAGE_META = "repo string, not_found boolean, empty_shell boolean, first_commit_sha string"
CHUNK_KEY = ["repo", "page_slug", "section_slug", "ordinal"]
CHUNK = (
    "repo string, page_slug string, section_slug string, ordinal int, text string, github_repo string, github_sha string, github_path string, "
    "github_line_range string, embedding array<float>, indexed_at_ms long, commit_sha string"
)
EDGE_KEY = ["src_kind", "src_id", "dst_kind", "dst_id", "edge_type", "repo"]
METADATA = "struct<sha: string, line_range: string, source: string, label: string, anchor_text: string, anchor: string, file_path: string, kinds: array<string>>"
EDGE = f"src_kind string, src_id string, dst_kind string, dst_id string, edge_type string, repo string, metadata {METADATA}, commit_sha string, indexed_at_ms long"
STATUS = "repo string, build_id string, indexed_at_ms long, commit_sha string, chunk_count int, edge_count int"
REPOS = "query string, ecosystem string, owner string, repo string, source string, confidence string, resolved_at_ms long"
WIKI_STATUS = "repo string, has_wiki boolean, page_count int, checked_at_ms long"
MANIFEST_FILE = "path string, content string"
DEPENDENCY = "manifest_path string, name string, ecosystem string, declared_version string, kind string, pos int"

NODE_KINDS = ("section", "file", "diagram_node", "repo")
EDGE_TYPES = ("code_ref", "cross_repo_ref", "diagram_member", "diagram_edge", "section_link")
ECOSYSTEMS = ("npm", "pypi", "go", "cargo", "composer", "maven", "gem", "nuget")
