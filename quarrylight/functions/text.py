"""Column functions on text: tokens, links, identifiers. All run in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Latin letters with marks, and their base letters, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, base) for c, base in pairs if base != c and base.isascii() and c.islower()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


FOLD_FROM, FOLD_TO = _folds()


def utf16_length(text: Column) -> Column:
    return F.length(F.encode(text, "UTF-16BE")) / 2


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    return F.ceil(utf16_length(text) / 4).cast("int")


def index_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits without diacritics."""
    folded = F.translate(F.lower(text), FOLD_FROM, FOLD_TO)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(text: Column, split: bool = False) -> Column:
    """Tokens of a query: white space separates, other characters vanish and so glue their sides, unless ``split``.
    Repeated tokens stay, as each counts."""
    if split:
        return index_tokens(text)
    glued = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.filter(F.transform(glued, lambda t: F.translate(F.lower(t), FOLD_FROM, FOLD_TO)), lambda t: t != "")


def match_expression(text: Column) -> Column:
    """The quoted disjunction of a query's tokens, empty if there are none."""
    glued = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.array_join(F.transform(F.filter(glued, lambda t: t != ""), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def overlap_score(query: Column, text: Column) -> Column:
    """Number of distinct words of the query that the text contains as substrings, regardless of case."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\W+"), lambda t: t != ""))
    return F.size(F.filter(words, lambda w: F.contains(F.lower(text), w))).cast("double")


BLOB = r"https?://github\.com/([^/\s]+/[^/\s]+)/blob/([0-9a-f]{40})/([^#\s)?]+)(?:#(L\d+(?:-L\d+)?))?"


def blob_link(url: Column) -> Column:
    """(repo, sha, path, line_range) of a link to a file at a commit, null for other links."""
    part = lambda i: F.nullif(F.regexp_extract(url, BLOB, i), F.lit(""))
    return F.when(url.rlike(BLOB), F.struct(part(1).alias("repo"), part(2).alias("sha"), part(3).alias("path"), part(4).alias("line_range")))


def blob_links(text: Column) -> Column:
    """All links to files at a commit in a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(BLOB), F.lit(0)), blob_link)


#: Where the pages of the wiki are, followed by owner/name; links to other hosts do not count.
WIKI_BASE = "https://wiki.example.org/github.com/"


def links_in(text: Column) -> Column:
    """(label, target) of all Markdown links, in order."""
    link = r"\[([^\]]+)\]\(([^)]+)\)"
    return F.transform(F.regexp_extract_all(text, F.lit(link), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, link, 1).alias("label"), F.regexp_extract(x, link, 2).alias("target")))


def markdown_links(text: Column, base: str = WIKI_BASE) -> Column:
    """(label, target) of the links to an anchor or to a page of the wiki, in order."""
    def wanted(link: Column) -> Column:
        start = F.when(F.startswith(link["target"], F.lit(base)), len(base)).when(F.startswith(link["target"], F.lit("#")), 1)
        return F.length(link["target"]) > start

    return F.filter(links_in(text), lambda link: F.coalesce(wanted(link), F.lit(False)))


def before_mark(url: Column, marks: str) -> Column:
    return F.regexp_extract(url, f"^[^{marks}]*", 0)


def wiki_link(url: Column, base: str = WIKI_BASE) -> Column:
    """(repo, anchor) of a page of the wiki, null for other URLs, such as those with a query or with further parts."""
    rest = F.when(F.startswith(url, F.lit(base)), F.substr(url, F.lit(len(base) + 1)))
    page = before_mark(rest, "#")
    parts = F.split(page, "/")
    sound = (F.size(parts) == 2) & ~F.contains(page, F.lit("?")) & (F.element_at(parts, 1) != "") & (F.element_at(parts, -1) != "") & (rest != F.concat(page, F.lit("#")))
    anchor = F.substr(rest, F.length(page) + 2)
    return F.when(sound, F.struct(page.alias("repo"), F.nullif(anchor, F.lit("")).alias("anchor")))


def _blob_of(link: Column) -> Column:
    """(label, repo, sha, path, line_range) of a link whose target is a file at a commit; null fields if it is not."""
    whole = before_mark(link["target"], "#")
    fragment = F.substr(link["target"], F.length(whole) + 1)
    path = before_mark(whole, "?")
    parts = F.split(path, "/")
    at = lambda i: F.get(parts, F.lit(i))
    file = F.array_join(F.slice(parts, F.lit(8), F.greatest(F.size(parts) - 7, F.lit(0))), "/")
    sound = F.startswith(path, F.lit("https://github.com/")) & (at(5) == "blob") & at(6).rlike("^[0-9a-f]{40}$") & (file != "") & ~file.rlike(r"\s") & fragment.rlike(r"^(#L\d+(-L\d+)?)?$")
    return F.struct(
        link["label"].alias("label"), F.when(sound, F.concat(at(3), F.lit("/"), at(4))).alias("repo"), at(6).alias("sha"), file.alias("path"), F.nullif(F.substr(fragment, F.lit(2)), F.lit("")).alias("line_range"))


def prose_blob_links(text: Column) -> Column:
    """(label, repo, sha, path, line_range) of Markdown links to files at a commit, in order."""
    return F.filter(F.transform(links_in(text), _blob_of), lambda x: x["repo"].isNotNull())


def language_of(css_class: Column) -> Column:
    return F.nullif(F.regexp_extract(css_class, r"(?:^|\s)(?:language|lang)-([A-Za-z0-9_+#.-]+)", 1), F.lit(""))


def section_id(repo: Column, slug: Column) -> Column:
    return F.concat(repo, F.lit("#"), slug)


def file_id(repo: Column, path: Column) -> Column:
    return F.concat(repo, F.lit(":"), path)


def diagram_node_id(repo: Column, slug: Column, node: Column) -> Column:
    return F.concat(repo, F.lit("#"), slug, F.lit("::"), node)


def slug_of(node_id: Column) -> Column:
    """The section slug in the identifier of a section or of a diagram node."""
    return F.regexp_extract(node_id, r"#(.*?)(?:::|$)", 1)


def strip_repo(node_id: Column, repo: Column) -> Column:
    """The identifier without its repository and the mark after it."""
    return F.when(F.startswith(node_id, repo), F.substr(node_id, F.length(repo) + 2)).otherwise(node_id)


def github_repo(url: Column) -> Column:
    """owner/repo that a repository URL names (git+, ssh, https, or the bare form), null if it is not on github.com."""
    s = F.regexp_replace(F.regexp_replace(F.trim(url), r"^git\+", ""), r"(?i)^git@github\.com:", "https://github.com/")
    bare = r"^([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\.git)?$"
    host = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?github\.com/+([^/?#]+)/+([^/?#]+)"
    short = ~F.contains(s, F.lit("://")) & ~F.contains(s, F.lit("github.com"))
    name = F.regexp_replace(F.regexp_extract(s, host, 2), r"(?i)\.git$", "")
    full = F.when(s.rlike(host) & (name != ""), F.concat(F.regexp_extract(s, host, 1), F.lit("/"), name))
    return F.when(short, F.when(s.rlike(bare), F.concat(F.regexp_extract(s, bare, 1), F.lit("/"), F.regexp_extract(s, bare, 2)))).otherwise(full)


def fuzzy_repo(name: Column) -> Column:
    """The guess for a name whose registry did not answer: vendor/package as it is, a plain name for both parts."""
    part = r"[A-Za-z0-9][A-Za-z0-9._-]*"
    return F.when(name.rlike(f"^{part}/{part}$"), name).when(name.rlike(f"^{part}$"), F.concat(name, F.lit("/"), name))


def is_commit(sha: Column) -> Column:
    return F.coalesce(sha.rlike(r"^[0-9a-f]{40}$"), F.lit(False))


def semver_key(version: Column) -> Column:
    """A struct that orders versions: stable first when descending, then major, minor, patch, and for pre-releases their
    identifiers, where numbers are below words and compare as numbers. A fourth number and build metadata do not count."""
    core = r"^\D*?(\d+)(?:\.(\d+))?(?:\.(\d+))?"
    number = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(version, core, i), F.lit("")), F.lit("9" * 18)), F.lit(0)).cast("long")
    pre = F.regexp_extract(version, r"^\D*?\d+\.\d+\.\d+-([0-9A-Za-z.-]+)", 1)
    parts = F.transform(F.filter(F.split(pre, r"\."), lambda p: p != ""), lambda p: F.struct(
        (~p.rlike(r"^\d+$")).alias("word"), F.when(p.rlike(r"^\d+$"), p.cast("long")).otherwise(F.lit(0).cast("long")).alias("n"), F.when(p.rlike(r"^\d+$"), F.lit("")).otherwise(p).alias("s")))
    return F.when(version.rlike(r"\d"), F.struct((pre == "").alias("stable"), number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), parts.alias("pre")))
