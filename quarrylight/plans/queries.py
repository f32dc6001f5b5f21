"""The engine's operators on the driver's tables, each with the same question in DuckDB SQL where SQL can ask it.

Documents stand for chunks (repository: source; section: document), embeddings for their vectors, pages, line items and
orders for edges, conversations for pages with headings, events for metrics and statuses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as tx
from quarrylight.operators import dependencies as dep
from quarrylight.operators import documents as doc
from quarrylight.operators import graph as gr
from quarrylight.operators import lexical as lx
from quarrylight.operators import metrics as me
from quarrylight.operators import models
from quarrylight.operators import ranking as rk
from quarrylight.operators.scratch import scratch_path
from quarrylight.operators.vector_search import nearest
from quarrylight.sources import html_tree
from quarrylight.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    """Registers a query by its function's name, with its SQL."""

    def take(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return take


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEY = ["repo", "doc_id"]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries: documents with a vector whose id is divisible by 100 ask with their first line and their vector."""
    own = load(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select("vec_id", F.col("embedding").alias("vector"))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1).alias("query"))
    return docs.join(own, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("query_id"), "query", "vector")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("source").alias("repo"), "doc_id", "text")


def with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return corpus(spark, sf_dir).select(*KEY).join(vectors, "doc_id")


ASKED_SQL = """asked as (
    select doc_id as query_id, split_part(coalesce(text, ''), chr(10), 1) as query, vec_id from documents join embeddings on vec_id = doc_id where vec_id % 100 = 0)"""
FOLDED = f"translate(lower({{}}), '{tx.FOLD_FROM}', '{tx.FOLD_TO}')"
TOKENS = r"list_filter(string_split_regex(" + FOLDED.format("text") + r", '[^\p{L}\p{N}]+'), lambda t: t <> '')"
QUERY_TOKENS = r"list_filter(list_transform(string_split_regex(query, '\s+'), lambda t: " + FOLDED.format(r"regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')") + r"), lambda t: t <> '')"

SCORES_SQL = f"""{ASKED_SQL},
scored as (
    select a.query_id, d.source as repo, d.doc_id,
           list_dot_product(e.embedding::double[], q.embedding::double[])
           / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))) as score
    from documents d join embeddings e on e.vec_id = d.doc_id cross join asked a join embeddings q on q.vec_id = a.vec_id)"""

BM25_SQL = f"""toks as (select source as repo, doc_id, {TOKENS} as toks from documents),
stats as (select count(*)::double as n_chunks, avg(coalesce(len(toks), 0)) as avgdl from toks),
terms as (select query_id, term, count(*) as times from (select query_id, unnest({QUERY_TOKENS}) as term from asked) group by all),
post as (select repo, doc_id, dl, term, count(*) as tf from (select repo, doc_id, len(toks) as dl, unnest(toks) as term from toks) where term in (select term from terms) group by all),
dfs as (select term, count(*) as df from post group by term),
idfs as (select term, case when ln((n_chunks - df + 0.5) / (df + 0.5)) > 0 then ln((n_chunks - df + 0.5) / (df + 0.5)) else 0.000001 end as idf from dfs, stats),
lexical as (
    select query_id, repo, doc_id, sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
    from post join terms using (term) join idfs using (term), stats group by query_id, repo, doc_id)"""

LISTS_SQL = f"""{SCORES_SQL}, {BM25_SQL},
v as (select * from (select *, row_number() over (partition by query_id, repo order by round(score, 12) desc, doc_id) as rank from scored) where rank <= 50),
b as (select * from (select *, row_number() over (partition by query_id, repo order by round(score, 9) desc, doc_id) as rank from lexical) where rank <= 50)"""

WINDOW_SQL = f"""{LISTS_SQL},
fused as (
    select query_id, repo, doc_id, v.rank as vector_rank, b.rank as bm25_rank, v.score as vector_score, b.score as bm25_score,
           coalesce(1.0::double / (60 + v.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) as rrf
    from v full join b using (query_id, repo, doc_id)),
best as (select * from (select *, row_number() over (partition by query_id, repo order by rrf desc, vector_rank nulls last, bm25_rank nulls last) as p from fused) where p <= 50),
fwindow as (select * from (select *, row_number() over (partition by query_id order by rrf desc, repo, vector_rank nulls last, bm25_rank nulls last) as fused_pos from best) where fused_pos <= 50)"""


@registered(f"""with {SCORES_SQL}
select query_id, doc_id, repo, rank::int as rank, round(score, 6) as score from (
    select *, row_number() over (partition by query_id order by round(score, 12) desc, repo, doc_id) as rank from scored) where rank > 5 and rank <= 25""")
def vector_topk(spark, sf_dir):
    """The second page of each query, over all repositories."""
    best = nearest(with_vectors(spark, sf_dir), asked(spark, sf_dir), KEY, 25, group=None)
    return best.where("rank > 5").select("query_id", "doc_id", "repo", "rank", F.round("score", 6).alias("score"))


@registered(f"""with {SCORES_SQL}
select query_id, repo, doc_id, rank::int as rank from (
    select *, row_number() over (partition by query_id, repo order by round(score, 12) desc, doc_id) as rank from scored) where rank <= 5""")
def vector_topk_per_repo(spark, sf_dir):
    return nearest(with_vectors(spark, sf_dir), asked(spark, sf_dir), KEY, 5).select("query_id", "repo", "doc_id", "rank")


_indexes: dict[tuple, str] = {}


def _version(spark, sf_dir) -> tuple:
    """The files of the documents with their sizes and times: another version is another index."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


def lexical_index(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The index of the documents, written when the first question of a session needs it."""
    key = (spark.sparkContext.applicationId, *_version(spark, sf_dir))
    if key not in _indexes:
        path = scratch_path(spark, "lexical-index")
        lx.write_index(corpus(spark, sf_dir), KEY, path)
        _indexes[key] = path
    return lx.read_index(spark, _indexes[key])


@registered(rf"""with toks as (select source as repo, doc_id, {TOKENS} as toks from documents),
post as (select repo, doc_id, len(toks) as dl, unnest(toks) as term from toks),
tfs as (select repo, doc_id, dl, term, count(*) as tf from post group by all)
select term, repo, count(*) as df, max(tf)::int as max_tf, min(dl)::int as min_dl, sum(tf)::bigint as tokens, sum(dl)::bigint as lengths from tfs group by term, repo""")
def lexical_blocks(spark, sf_dir):
    """Builds the index, whatever was built before; a row a term and repository of what its blocks hold."""
    path = scratch_path(spark, "lexical-index")
    lx.write_index(corpus(spark, sf_dir), KEY, path)
    blocks, _ = lx.read_index(spark, path)
    total = lambda field: F.sum(F.aggregate("docs", F.lit(0).cast("long"), lambda s, d: s + d[field]))
    return blocks.groupBy("term", "repo").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"), total("tf").alias("tokens"), total("dl").alias("lengths"))


def asking(spark, sf_dir) -> lx.Question:
    return lx.question(lexical_index(spark, sf_dir), asked(spark, sf_dir).select("query_id", "query"))


def lexical_best(spark, sf_dir, k: int, per_group: bool = True) -> DataFrame:
    return lx.topk(asking(spark, sf_dir), KEY, k, per_group=per_group).rows


@registered(f"""with {ASKED_SQL}, {BM25_SQL}
select query_id, doc_id, rank::int as rank, round(score, 6) as score from (
    select *, row_number() over (partition by query_id order by round(score, 9) desc, repo, doc_id) as rank from lexical) where rank <= 20""")
def bm25_topk(spark, sf_dir):
    return lexical_best(spark, sf_dir, 20, False).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The ranked vector and lexical lists of each query and repository."""
    return nearest(with_vectors(spark, sf_dir), asked(spark, sf_dir), KEY, rk.DEFAULT.window), lexical_best(spark, sf_dir, rk.DEFAULT.window)


@registered(f"with {WINDOW_SQL} select query_id, repo, doc_id, vector_rank::int as vector_rank, bm25_rank::int as bm25_rank, round(rrf, 9) as rrf, fused_pos::int as fused_pos from fwindow")
def hybrid_rrf(spark, sf_dir):
    v, b = lists(spark, sf_dir)
    return rk.fused_window(rk.fuse(v, b, KEY)).select("query_id", "repo", "doc_id", "vector_rank", "bm25_rank", F.round("rrf", 9).alias("rrf"), "fused_pos")


@registered(f"""with {WINDOW_SQL},
scored2 as (
    select w.*, len(list_filter(list_distinct(list_filter(string_split_regex(lower(a.query), '\\W+'), lambda t: t <> '')), lambda t: contains(lower(d.text), t)))::double as rerank_score
    from fwindow w join asked a using (query_id) join documents d on d.doc_id = w.doc_id),
final as (select *, row_number() over (partition by query_id order by rerank_score desc, fused_pos) as pos from scored2)
select query_id, doc_id, pos::int as pos, rerank_score, rerank_score as effective_score from final where pos > 4 and pos <= 12""")
def hybrid_rerank_page(spark, sf_dir):
    v, b = lists(spark, sf_dir)
    window = rk.fused_window(rk.fuse(v, b, KEY)).join(corpus(spark, sf_dir), KEY)
    return rk.page(rk.reranked(window, asked(spark, sf_dir)), k=8, offset=4).select("query_id", "doc_id", "pos", "rerank_score", "effective_score")


@registered(f"""with {WINDOW_SQL},
-- Every repository with vectors is a target; its lexical question is asked whenever the query has a token.
targets as (select distinct d.source as repo from documents d join embeddings e on e.vec_id = d.doc_id where d.source is not null),
pairs as (select a.query_id, t.repo, case when len({QUERY_TOKENS}) = 0 then 'empty_query_tokens' end as reason from asked a cross join targets t),
vt as (select query_id, repo, count(*) as vector_total from scored group by all), bt as (select query_id, repo, count(*) as bm25_total from lexical group by all),
vc as (select query_id, repo, count(*) as vector_count from v group by all), bc as (select query_id, repo, count(*) as bm25_count from b group by all),
overlap as (select query_id, repo, count(*) as n from v join b using (query_id, repo, doc_id) group by all),
per as (
    select query_id, repo, reason, coalesce(vector_total, 0) as vt, coalesce(vector_count, 0) as vc, coalesce(bm25_count, 0) as bc,
           coalesce(vector_total, 0) + case when reason is null then greatest(0, coalesce(bm25_total, 0) - coalesce(n, 0)) else 0 end as rt
    from pairs left join vt using (query_id, repo) left join bt using (query_id, repo) left join vc using (query_id, repo) left join bc using (query_id, repo) left join overlap using (query_id, repo))
select query_id, 60 as rrf_k, sum(vc)::bigint as vector_count, sum(bc)::bigint as bm25_count, (select count(*) from fwindow f where f.query_id = per.query_id) as fused_count,
       sum(rt)::bigint as repo_total, sum(vt)::bigint as union_total, least(sum(rt), 50)::bigint as total, max(vt) > 50 or sum(least(rt, 50)) > 50 as truncated,
       case when count(reason) = 0 then 'hybrid' when count(reason) = count(*) then 'vector_only' else 'partial' end as mode, case when count(reason) = count(*) then min(reason) end as reason
from per group by query_id""")
def hybrid_envelope(spark, sf_dir):
    v, b = lists(spark, sf_dir)
    queries, chunks = asked(spark, sf_dir).select("query_id", "query"), with_vectors(spark, sf_dir).where("repo is not null")
    sizes = chunks.groupBy("repo").agg(F.count(F.lit(1)).alias("vector_total"))
    totals = sizes.join(rk.checked(queries.select("query_id"))).join(lx.totals(asking(spark, sf_dir), KEY), ["query_id", "repo"], "full").fillna(0)
    per_repo = rk.repository_modes(sizes.select("repo", F.lit(None).cast("string").alias("reason")), queries, v, b, totals, key=KEY)
    return rk.envelope(per_repo, rk.fused_window(rk.fuse(v, b, KEY)))


@registered("""with e as (select user_id::varchar as repo, epoch_us(ts) // 1000 as ms from events)
select repo, max(ms)::bigint as indexed_at_ms from e group by repo having max(ms) > (select max(ms) from e) - 86400000 order by 1 limit 16""")
def fresh_repos(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    status = events.groupBy("repo").agg(F.max("ms").alias("indexed_at_ms"))
    now = events.agg(F.max("ms")).first()[0]
    return rk.target_repos(status, now or 0)


UNITS = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


@registered(f"""with toks as (select doc_id, list_distinct({TOKENS}) as words from documents),
held as (select doc_id, unnest(words) as word from toks),
placed as (select doc_id, ('0x' || substr(md5(word), 1, 7))::bigint as h from held),
sums as (select doc_id, (h >> 1) % 64 as place, sum(case when h % 2 = 1 then 1 else -1 end) as s from placed group by all),
counted as (select word, count(*) as df from held group by word),
added as (select word, place, sum(s)::bigint as s from held join sums using (doc_id) group by all),
every as (select word, df, unnest(range(64)) as place from counted)
select word, df, md5(string_agg(coalesce(s, 0)::varchar, ',' order by place)) as vector_md5 from every left join added using (word, place) group by word, df""")
def word_vectors(spark, sf_dir):
    """The vectors that the local encoder and scorer are trained from, of every word of the documents."""
    found = models.word_vectors(load(spark, sf_dir, "documents"))
    return found.select("word", "df", F.md5(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary")).alias("vector_md5"))


@registered(f"select doc_id, ceil({UNITS.format('text')} / 4.0)::int as tokens from documents")
def token_estimate(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@registered(f"""with t as (select conv_id, turn, ceil({UNITS.format('text')} / 4.0)::int as tokens from conversations),
s as (select *, sum(tokens) over w as used, row_number() over w as place from t window w as (partition by conv_id order by turn)),
m as (select *, max((used > 200 and place > 1)::int) over (partition by conv_id) = 1 as truncated from s)
select conv_id, turn, tokens, used::bigint as used, truncated from m where used <= 200 or place = 1""")
def token_budget_prefix(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.estimate_tokens(F.col("text")).alias("tokens"))
    return doc.budgeted(rows, "tokens", ["conv_id"], ["turn"], 200).select("conv_id", "turn", "tokens", "used", "truncated")


@registered(f"""with recursive docs as (
    select doc_id, text, list_filter(string_split(text, chr(10)), lambda p: p <> '') as ps from documents where text is not null),
parts as (select doc_id, text, ps, list_transform(ps, lambda p: ceil({UNITS.format('p')} / 4.0)::int) as ns from docs),
sums as (select doc_id, text, ps, list_transform(range(0, len(ns) + 1), lambda i: coalesce(list_sum(ns[1:i]), 0)) as c from parts where ceil({UNITS.format('text')} / 4.0) > 256 and len(ps) > 0),
-- A window from paragraph s, of which p has been taken, ends before e; c[i + 1] are the tokens of the first i paragraphs.
w(doc_id, ordinal, s, e) as (
    select doc_id, 0, 1, coalesce(list_filter(range(2, len(ps) + 1), lambda i: c[i + 1] - c[1] > 256)[1], len(ps) + 1) from sums
    union all
    select w.doc_id, w.ordinal + 1, j.s, coalesce(list_filter(range(w.e + 1, len(x.ps) + 1), lambda i: x.c[i + 1] - x.c[j.s] > 256)[1], len(x.ps) + 1)
    from w join sums x on x.doc_id = w.doc_id and w.e <= len(x.ps), lateral (select list_filter(range(w.s, w.e + 1), lambda k: x.c[w.e] - x.c[k] <= 64)[1] as s) j),
cut as (
    select w.doc_id, w.ordinal, array_to_string(x.ps[w.s:w.e - 1], chr(10)) as chunk from w join sums x on x.doc_id = w.doc_id
    union all select doc_id, 0, text from documents where text is not null and doc_id not in (select doc_id from sums))
select doc_id, ordinal::int as ordinal, ceil({UNITS.format('chunk')} / 4.0)::int as tokens, md5(chunk) as md5 from cut""")
def chunk_windows(spark, sf_dir):
    """Lines as paragraphs, as documents hold no blank lines."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(doc.windows(F.col("text"), 256, 64, r"\n")).alias("ordinal", "window"))
    return docs.select("doc_id", "ordinal", tx.estimate_tokens(F.col("window")).alias("tokens"), F.md5(F.col("window").cast("binary")).alias("md5"))


@registered("""select conv_id, turn, heading from (
    select conv_id, turn, role, last_value(case when role = 'user' then 'turn-' || turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as heading
    from conversations) where heading is not null""")
def section_assign(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    slug = F.when(user, F.concat(F.lit("turn-"), F.col("turn").cast("string")))
    nodes = turns.select("conv_id", "turn", F.col("turn").alias("seq"), F.when(user, "heading").otherwise("prose").alias("type"), slug.alias("slug"))
    return doc.with_heading(nodes, ["conv_id"]).where("heading is not null").select("conv_id", "turn", F.col("heading.slug").alias("heading"))


HREFS_SQL = """links as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, regexp_extract(url, '^([a-z]+):', 1) as scheme, generate_subscripts(hs, 1) as pos, unnest(hs) as target
from (select page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) as hs from pages))"""


def hrefs(spark, sf_dir) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    host, scheme = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.regexp_extract("url", "^([a-z]+):", 1)
    return load(spark, sf_dir, "pages").select("page_id", host.alias("host"), scheme.alias("scheme"), F.posexplode(found).alias("pos", "target"))


@registered(f"with {HREFS_SQL} select page_id, pos::int as pos, target from links")
def page_links(spark, sf_dir):
    return hrefs(spark, sf_dir).select("page_id", (F.col("pos") + 1).alias("pos"), "target")


def link_edges(spark, sf_dir) -> DataFrame:
    """Links as unmerged edges: a host's section links to a path, the page being the label."""
    none = F.lit(None).cast("string")
    meta = {f: none for f in gr.FIELDS} | {"label": F.col("page_id").cast("string")}
    return hrefs(spark, sf_dir).select(
        F.lit("section").alias("src_kind"), F.col("host").alias("src_id"), F.lit("section").alias("dst_kind"), F.col("target").alias("dst_id"), F.lit("section_link").alias("edge_type"), F.col("host").alias("repo"),
        *[c.alias(f) for f, c in meta.items()], F.array("scheme").alias("kinds"), F.struct("page_id", "pos").alias("order"))


@registered(f"""with {HREFS_SQL}
select host as src_id, target as dst_id, arg_max(page_id, (page_id, pos))::varchar as label, array_to_string(list_sort(list_distinct(list(scheme))), ',') as kinds from links group by host, target""")
def edges_merged(spark, sf_dir):
    return gr.merge_edges(link_edges(spark, sf_dir)).select("src_id", "dst_id", "metadata.label", F.array_join("metadata.kinds", ",").alias("kinds"))


def item_edges(spark, sf_dir) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    return items.select(node("l_suppkey").alias("src_id"), node("l_partkey").alias("dst_id"), F.lit("section_link").alias("edge_type"), F.col("l_orderkey").alias("indexed_at_ms"))


@registered("""with e as (select 'n' || l_suppkey as src_id, 'n' || l_partkey as dst_id, l_orderkey as indexed_at_ms from lineitem),
r as (select *, 'out' as direction, 0 as half from e where src_id = 'n7' union all select *, 'in', 1 from e where dst_id = 'n7'),
p as (select *, row_number() over (order by half, indexed_at_ms desc, dst_id, src_id) as pos from r)
select direction, src_id, dst_id, indexed_at_ms, pos::int as pos, (select count(*) from r) > 40 as truncated from p where pos <= 40""")
def neighbours_in_out(spark, sf_dir):
    return gr.both_ways(item_edges(spark, sf_dir), "n7", "section_link", "both", 40).select("direction", "src_id", "dst_id", "indexed_at_ms", "pos", "truncated")


@registered("""with e as (select n_name as repo, n_name || '#' || c_mktsegment as src_id, o_orderpriority as dst_id, o_orderstatus as kind
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
select repo, dst_id as other, array_to_string(list_sort(list_distinct(list(src_id))), ',') as from_sections, array_to_string(list_sort(list_distinct(list(kind))), ',') as kinds, 'out' as direction from e group by repo, dst_id
union all
select dst_id, repo, array_to_string(list_sort(list_distinct(list(src_id))), ','), '', 'in' from e group by repo, dst_id""")
def cross_repo_agg(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    edges = rows.select(F.col("n_name").alias("repo"), F.concat_ws("#", "n_name", "c_mktsegment").alias("src_id"), F.col("o_orderpriority").alias("dst_id"), F.lit("cross_repo_ref").alias("edge_type"), F.struct(F.array("o_orderstatus").alias("kinds")).alias("metadata"), F.lit("").alias("commit_sha"), F.lit(0).cast("long").alias("indexed_at_ms"))
    both = gr.cross_repo_out(edges).unionByName(gr.cross_repo_in(edges))
    return both.select("repo", "other", F.array_join("from_sections", ",").alias("from_sections"), F.array_join("kinds", ",").alias("kinds"), "direction")


@registered(r"""with f as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) as folder from pages),
p as (select *, row_number() over (order by page_id desc, host) as pos from f where folder = 'en')
select page_id, host, pos::int as pos, (select count(*) from f where folder = 'en') > 16 as truncated from p where pos <= 16""")
def file_suffix_lookup(spark, sf_dir):
    host, folder = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^/?#]*)", 1)
    edges = load(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.lit("file").alias("dst_kind"), F.lit("code_ref").alias("edge_type"), F.concat(host, F.lit(":"), folder).alias("dst_id"), F.col("page_id").alias("indexed_at_ms"))
    return gr.pages_referencing_file(edges, "en").select("page_id", "host", "pos", "truncated")


@registered("""with e as (select 'n' || l_suppkey as src_id, 'n' || l_partkey as dst_id from lineitem)
select src_id, dst_id, count(*) as n from e
where src_id in (select 'n' || p_partkey from part where p_size < 10) and dst_id in (select 'n' || p_partkey from part where p_size < 10) group by all""")
def members_both_ends(spark, sf_dir):
    members = load(spark, sf_dir, "part").where("p_size < 10").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"))
    return gr.edges_among(item_edges(spark, sf_dir), members).groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("n"))


@registered("""select r_name || '/' || n_name as other, count(*) as n
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where n_nationkey in (select s_nationkey from supplier) and r_name || '/' || n_name <> 'ASIA/NATION_7' group by 1""")
def dep_link(spark, sf_dir):
    nations = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey").cast("string")
    repos = nations.select(key.alias("query"), F.lit("npm").alias("ecosystem"), F.col("r_name").alias("owner"), F.col("n_name").alias("repo"))
    deps = load(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("name"), F.lit("npm").alias("ecosystem"))
    status = nations.join(load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi").select(F.concat_ws("/", "r_name", "n_name").alias("repo"), F.lit("").alias("commit_sha"))
    return gr.dep_links(deps, repos, status, "ASIA/NATION_7").groupBy("other").agg(F.count(F.lit(1)).alias("n"))


@registered("""with d as (select distinct ts::date as day, user_id, event_type from events)
select a.day::varchar as day, a.user_id, a.event_type from d a where not exists (
    select 1 from d b where b.day = a.day + 1 and b.user_id = a.user_id and b.event_type = a.event_type) and a.day < (select max(day) from d)""")
def removed_deps(spark, sf_dir):
    scans = load(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", "event_type").distinct()
    before = scans.withColumn("scan", F.date_add("day", 1))
    after = scans.withColumnRenamed("day", "scan")
    last = scans.agg(F.max("day").alias("last"))
    gone = dep.removed(before, after, ["scan", "user_id", "event_type"])
    return gone.join(F.broadcast(last)).where("day < last").select(F.col("day").cast("string").alias("day"), "user_id", "event_type")


@registered("""with gone as (select distinct l_orderkey from lineitem where l_returnflag = 'R'), kept as (select distinct l_orderkey from lineitem where l_returnflag <> 'R')
select 's/' || l_orderkey as resolved from gone where l_orderkey not in (select l_orderkey from kept)""")
def orphaned_repos(spark, sf_dir):
    """Line items as dependencies of a project before and after; the order is the repository."""
    items = load(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("name"), F.lit("npm").alias("ecosystem"), "l_returnflag", F.col("l_orderkey").cast("string").alias("repo"))
    repos = items.select(F.col("name").alias("query"), "ecosystem", F.lit("s").alias("owner"), "repo").distinct()
    return dep.orphaned_repos(items.where("l_returnflag = 'R'"), items.where("l_returnflag <> 'R'"), repos)


@registered("""with v as (select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by l_linenumber, l_suppkey desc, l_orderkey desc) as n from lineitem)
select p_partkey, coalesce(case when p_size % 2 = 0 then p_size::varchar end, l_suppkey::varchar) as declared_version from part left join (select * from v where n = 1) on l_partkey = p_partkey""")
def version_fill(spark, sf_dir):
    deps = load(spark, sf_dir, "part").select("p_partkey", F.lit("x").alias("project"), F.col("p_partkey").cast("string").alias("name"), F.lit("maven").alias("ecosystem"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).alias("declared_version"))
    entries = load(spark, sf_dir, "lineitem").select(F.lit("x").alias("project"), F.col("l_partkey").cast("string").alias("coord"), F.col("l_suppkey").cast("string").alias("version"), "l_linenumber", "l_suppkey", "l_orderkey")
    versions = dep.first_wins(entries, ["project", "coord"], ["l_linenumber", F.col("l_suppkey").desc(), F.col("l_orderkey").desc()])
    return dep.fill_versions(deps, versions.select("project", "coord", "version")).select("p_partkey", "declared_version")


SLUGS_SQL = """slugs as (
    select distinct unnest([lower(p_type), lower(p_type || '-' || replace(p_name, ' ', '-')), lower(p_type || '-' || replace(p_name, ' ', '-') || '-' || replace(p_brand, '#', ''))]) as slug from part)"""


@registered(f"""with {SLUGS_SQL}
select a.slug, arg_max(b.slug, length(b.slug)) as parent_slug from slugs a left join slugs b on starts_with(a.slug, b.slug || '-') group by a.slug""")
def prefix_parent(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    name, brand = F.replace("p_name", F.lit(" "), F.lit("-")), F.replace("p_brand", F.lit("#"), F.lit(""))
    slugs = p.select(F.explode(F.array(*[F.lower(F.concat_ws("-", *parts)) for parts in (["p_type"], ["p_type", name], ["p_type", name, brand])])).alias("slug")).distinct()
    return doc.parent_slugs(slugs.withColumn("repo", F.lit("x")), ["repo"]).select("slug", "parent_slug")


@registered("""with recursive h(slug, parent) as (
    select 'r' || r_regionkey, null::varchar from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),
t(slug) as (select slug from h where slug = 'r1' union select h.slug from h join t on h.parent = t.slug)
select slug from t""")
def subtree(spark, sf_dir):
    none = F.lit(None).cast("string")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    heads = load(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("slug"), none.alias("parent_slug"))
    heads = heads.unionByName(load(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("slug"), name("r", "n_regionkey").alias("parent_slug")))
    heads = heads.unionByName(load(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("slug"), name("n", "s_nationkey").alias("parent_slug")))
    nodes = heads.withColumns({"repo": F.lit("x"), "type": F.lit("heading"), "section_slug": F.col("slug")})
    return doc.subtree(nodes, "r1", ["repo"]).select("slug")


@registered("""with r as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as turn from events),
s as (select event_type, list_sort(list(value)) as v from r where turn <= 1000 group by event_type),
a as (select event_type, count(*) as n, round(sum(value), 2) as total, min(value) as lowest, max(value) as highest from events group by event_type)
select event_type, n, total, lowest, highest, v[least(floor(0.5 * len(v))::int + 1, len(v))] as p50, v[least(floor(0.95 * len(v))::int + 1, len(v))] as p95 from a join s using (event_type)""")
def metric_buckets(spark, sf_dir):
    return me.buckets(load(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"]).withColumn("total", F.round("total", 2))


@registered("""select event_id, user_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 9 preceding and current row), 6) as rolling
from events where event_type <> 'error'""")
def rolling_build_mean(spark, sf_dir):
    builds = load(spark, sf_dir, "events").where("event_type <> 'error'")
    return me.rolling_mean(builds, ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", F.round("rolling", 6).alias("rolling"))


@registered("""select (epoch_us(ts) // 30000000 * 30000)::bigint as window_ms, event_type, count(*) as n, round(sum(value), 2) as total, min(value) as lowest, max(value) as highest from events group by 1, 2""")
def tumbling_30s(spark, sf_dir):
    rows = feeds.tumbling(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"])
    return rows.select(F.unix_millis("window_start").alias("window_ms"), "event_type", "n", F.round("total", 2).alias("total"), "lowest", "highest")


@registered(f"""with {ASKED_SQL}, {BM25_SQL},
ranked as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, repo, doc_id) as pos from lexical),
rel as (select query_id, doc_id from asked cross join (select doc_id from labels where quality = 1)),
wanted as (select query_id, count(*) as n_relevant from rel group by query_id),
found as (select query_id, count(*) as n_found, sum(1 / log2(pos + 1)) as dcg from ranked join rel using (query_id, doc_id) where pos <= 8 group by query_id)
select query_id, round(coalesce(n_found, 0) / n_relevant, 9) as recall, coalesce(n_found, 0) = n_relevant as hit,
       round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_relevant, 8) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg
from wanted left join found using (query_id)""")
def ndcg_recall(spark, sf_dir):
    best = lexical_best(spark, sf_dir, 8, False).withColumnRenamed("rank", "pos").select("query_id", F.col("doc_id").alias("item"), "pos")
    good = load(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("item"))
    return me.ndcg(best, good, queries=asked(spark, sf_dir)).select("query_id", F.round("recall", 9).alias("recall"), "hit", F.round("ndcg", 6).alias("ndcg"))


@registered("""with d as (select doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) as name from documents),
s(framework, pattern, prefix) as (values ('F1', 'the', false), ('F2', 'tion', true), ('F3', 'anth', false)),
h as (select doc_id, framework, name from d join s on case when prefix then starts_with(name, pattern) else name = pattern end)
select doc_id as project, framework, count(*) > 0 as found from h group by 1, 2""")
def framework_matches(spark, sf_dir):
    words = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("project"), F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("pos", "name")).withColumn("ecosystem", F.lit("npm"))
    table = [("F1", "high", "a/b", "exact", "the", "npm"), ("F2", "high", "c/d", "prefix", "tion", "npm"), ("F3", "low", "e/f", "exact", "anth", "npm")]
    return dep.detect_frameworks(words, table).select("project", "framework", F.lit(True).alias("found"))


@registered("""select p_brand as name, arg_max(version, (stable, major, minor, patch)) as version from (
    select p_brand, (p_partkey % 50)::int as major, p_size as minor, (p_partkey // 50)::int as patch, p_partkey % 3 > 0 as stable,
           (p_partkey % 50) || '.' || p_size || '.' || (p_partkey // 50) || case when p_partkey % 3 = 0 then '-rc.1' else '' end as version from part) group by p_brand""")
def latest_versions(spark, sf_dir):
    key = F.col("p_partkey")
    pre = F.when(key % 3 == 0, "-rc.1").otherwise("")
    versions = load(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.concat(F.concat_ws(".", (key % 50).cast("string"), F.col("p_size").cast("string"), F.floor(key / 50).cast("string")), pre).alias("version"))
    return dep.latest_versions(versions)


@registered("""select page_id, replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as title,
       len(regexp_extract_all(html, '<a [^>]*href="[^"]+"'))::int as n_links, len(regexp_extract_all(html, '<[a-zA-Z]'))::int as n_elements from pages""")
def html_text_nodes(spark, sf_dir):
    """Any page through the tree's parser."""
    return html_tree.text_nodes(load(spark, sf_dir, "pages"), "page_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval with reranking, the first page of results."""
    v, b = lists(spark, sf_dir)
    window = rk.fused_window(rk.fuse(v, b, KEY)).join(corpus(spark, sf_dir), KEY)
    return rk.page(rk.reranked(window, asked(spark, sf_dir))).select("query_id", "pos", "repo", "doc_id", "rerank_score", "effective_score")
