"""Citations: source, commit and time of a row, and the footer that states them in Markdown."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import WIKI_BASE


def footer(url: Column, sha: Column) -> Column:
    return F.concat(F.lit("\n\n---\n*Source: "), url, F.lit(" (generated text, pinned to commit "), sha, F.lit(")*"))


def footer_pattern(base: str = WIKI_BASE) -> str:
    """Matches a footer at the end of a text."""
    return r"\n+---\n\*Source: (" + re.escape(base) + r"\S+) \(generated text, pinned to commit ([0-9a-f]{40})\)\*$"


def without_footer(text: Column, base: str = WIKI_BASE) -> Column:
    return F.regexp_replace(text, footer_pattern(base), "")


def cited(rows: DataFrame, now_ms: int, base: str = WIKI_BASE) -> DataFrame:
    """rows (repo, section_slug, commit_sha, text) with source_url, last_checked and the footer in place of any older one.
    An incomplete commit is an error, as its footer would be broken."""
    anchor = F.when(F.coalesce("section_slug", F.lit("")) != "", F.concat(F.lit("#"), F.col("section_slug"))).otherwise(F.lit(""))
    moment = F.date_format(F.timestamp_millis(F.lit(now_ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    sha = F.when(F.col("commit_sha").rlike("^[0-9a-f]{40}$"), F.col("commit_sha")).otherwise(F.raise_error(F.concat(F.lit("not a full commit: "), F.coalesce("commit_sha", F.lit("null")))).cast("string"))
    out = rows.withColumns({"source_url": F.concat(F.lit(base), F.col("repo"), anchor), "last_checked": moment})
    return out.withColumn("text", F.concat(without_footer(F.col("text"), base), footer(F.col("source_url"), sha)))
