"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.bpe import encode
from quarrylight.llm.common import prepare, scratch
from quarrylight.llm.dart_minhash import near_duplicate_classes
from quarrylight.llm.exact_dedup import exact_dedup
from quarrylight.llm.fingerprints import fingerprint_classes, near_duplicates
from quarrylight.llm.hard_negatives import mine_hard_negatives
from quarrylight.llm.html_extract import extract
from quarrylight.llm.line_dedup import dedup_lines
from quarrylight.llm.merkle import leaf_digest, merkle_manifest
from quarrylight.llm.mixing import words_taken
from quarrylight.llm.quality import fit_quality, held_out, score_quality
from quarrylight.llm.toxicity import fit_toxicity, score_toxicity
from quarrylight.llm.toxicity import held_out as held_out_toxic
from quarrylight.llm.url_filters import filter_urls
from quarrylight.llm.warc import CHUNK, chunked, http_block, page_number, read_warc, write_warc

#: The ranks that the BPE query and the pipeline encode with.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Longest block of the WARC query's records; longer pages are segmented.
SEGMENT_BYTES = 1 << 12
#: (host, path, verdict) of the URL query.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"), min_chars=10)
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents),
keyed as (
    select doc_id, line, pos,
           translate(regexp_replace(regexp_replace(line, '^[ \t\n\x0b\x0c\r]+', ''), '[ \t\n\x0b\x0c\r]+$', ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines),
shared as (
    select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
marked as (
    select k.doc_id, k.line, k.pos, s.first is not null and s.first < k.doc_id as gone
    from keyed k left join shared s on k.key = s.key)
select doc_id, count(*) as n_lines, sum(case when gone then 1 else 0 end)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(table(spark, sf_dir, "documents", "doc_id", "text"), threshold=0.8, words=5)
    return found.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(prepare(spark), "warc")
    write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), path, revisit_bytes=0, segment_bytes=SEGMENT_BYTES)
    pages = read_warc(spark, path)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"), "segments")


#: Bytes of a record's block before its framed body.
HEAD = len(http_block(b"", True)) - len(chunked(b""))
#: The SHA-1 in base 32: five hexadecimal digits are twenty bits, which are four letters.
OP3_SQL = f"""
with docs as (select page_id, coalesce(html, '') as payload from pages),
sized as (select page_id, strlen(payload)::bigint as n, sha1(payload) as h, min(page_id) over (partition by payload) as first from docs),
digested as (
    select page_id, n, first,
           array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((list_sum(list_transform(range(1, 6), lambda d:
                   ((instr('0123456789abcdef', substr(h, (g * 5 + d)::int, 1)) - 1) << (20 - 4 * d)::int)))::bigint >> s::int) & 31)::int + 1, 1)), '')), '') as payload_digest
    from sized),
framed as (
    select *, {HEAD} + 5 + n + (n // {CHUNK}) * {len(f"{CHUNK:x}") + 4} + case when n % {CHUNK} > 0 then length(printf('%x', n % {CHUNK})) + 4 else 0 end as block from digested)
select page_id, n as payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to,
       case when page_id = first and block > {SEGMENT_BYTES} then ceil(block / {SEGMENT_BYTES}.0)::int else 0 end as segments
from framed
"""


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return score_quality(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_taken(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


OP5_SQL = r"""
with docs as (
    select doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           md5(coalesce(doc_id::varchar, '')) as key
    from documents),
sizes as (select source, sum(size)::bigint as source_size from docs group by source),
weighed as (
    select *, (2 * source_size)::double as cap,
           [5.0, 2.0, 1.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight
    from sizes),
levels as (
    select *, ((select sum(source_size)::double * 1.5 from sizes)
               - coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as level
    from weighed),
targets as (
    select source, source_size,
           case when cap / weight <= level then cap
                else weight * (select max(level) from levels where not cap / weight <= level) end as target
    from levels),
placed as (
    select d.doc_id, d.key, d.source, d.size, t.source_size, t.target, (t.source_size + 65535) // 65536 as most,
           coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
    from docs d join targets t on d.source is not distinct from t.source),
packets as (
    select doc_id, size, source, target, most, epoch, start + epoch * source_size as begin, unnest(range(1, (size + most - 1) // most + 1)) as i
    from placed, (values (0), (1)) e(epoch) where size > 0),
finished as (
    select doc_id, source, epoch, least(i * most, size) - (i - 1) * most as words, begin + least(i * most, size) as pos, (begin + least(i * most, size)) / target as finish
    from packets),
mixed as (
    select doc_id, source, epoch, words, sum(words) over (order by finish, source is null, source, pos rows unbounded preceding) - words as before from finished),
cut as (
    select doc_id, epoch, sum(greatest(0, least(words, (select floor(sum(source_size)::double * 1.5) from sizes) - before)))::bigint as words
    from mixed group by doc_id, epoch),
served as (select doc_id, sum(words)::bigint as taken, count(*) filter (where words > 0) as turns from cut group by doc_id)
select p.doc_id, p.size, p.source_size, p.target, coalesce(s.taken, 0)::bigint as taken, coalesce(s.turns, 0)::bigint as turns
from placed p left join served s on p.doc_id = s.doc_id
"""


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
with normal as (select doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+', ' ', 'g') as text from documents)
select doc_id, min(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
       doc_id is not distinct from min(doc_id) over (partition by text) as kept, sha256(text) as text_sha256
from normal
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode(table(spark, sf_dir, "documents", "doc_id", "text"), RANKS, public_tokenizers.PATTERN, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    urls = filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules, default="allow")
    return urls.select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
with rest as (
    select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
hosts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from rest),
urls as (
    select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
    from hosts),
rules(rhost, rpath, rverdict) as (
    values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
select page_id, host, path,
       arg_max(rhost || rpath, length(rhost) + length(rpath)) as rule,
       coalesce(arg_max(rverdict, length(rhost) + length(rpath)), 'allow') as verdict
from (select row_number() over () as rid, * from urls) u
left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
group by rid, page_id, host, path
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


OP11_SQL = """
with valid as (
    select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.row as anchor, a.vec_id as anchor_id, b.row, b.vec_id, a.label = b.label as same,
           list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
    from valid a join valid b on a.vec_id % 100 = 0 and a.row <> b.row),
positives as (
    select anchor, anchor_id, row as positive, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor order by score desc, vec_id nulls last, row) <= 5),
ranked as (
    select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
           row_number() over (partition by p.anchor, p.positive order by s.score desc, s.vec_id nulls last, s.row)::int as rank
    from positives p join scored s on s.anchor = p.anchor and not s.same
         and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""


def op12_noisy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", held_out_toxic("doc_id").alias("held_out"), "score", "predicted", "n_disguised")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(odd, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle_manifest(docs, leaf_digest([*rest, F.col("text")]), leaf_digest([*rest, tampered]))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _tree(name: str, levels: int) -> str:
    """Level by level, nodes (g, i, n, h) of {name}0 and up, and what stands on both sides of each node in its run."""
    out = []
    for at in range(levels + 1):
        if at:
            out.append(f"""{name}{at} as materialized (
    select g, i // 3 as i, max((n + 2) // 3) as n, sha256(string_agg(h, '' order by i)) as h from {name}{at - 1} where n > 1 group by g, i // 3)""")
        out.append(f"""{name}{at}_beside as materialized (
    select g, i, coalesce(string_agg(h, '') over (partition by g, i // 3 order by i rows between unbounded preceding and 1 preceding), '') as l,
           coalesce(string_agg(h, '') over (partition by g, i // 3 order by i rows between 1 following and unbounded following), '') as r
    from {name}{at} where n > 1)""")
    return ",\n".join(out)


def _walk(tree: str, walk: str, levels: int) -> str:
    """{walk}0 (row, g, at, proof, cur) up the tree."""
    out = []
    for at in range(levels):
        out.append(f"""{walk}{at + 1} as materialized (
    select w.row, w.g, w.at // 3 as at, w.proof || coalesce(b.l || b.r, '') as proof, case when b.g is null then w.cur else sha256(b.l || w.cur || b.r) end as cur
    from {walk}{at} w left join {tree}{at}_beside b on b.g = w.g and b.i = w.at)""")
    return ",\n".join(out)


#: Levels of the two trees in the SQL: 3^12 documents of a source, 3^8 sources.
LEVELS, UPPER = 12, 8
OP13_SQL = f"""
with bytes as (
    select doc_id, list_transform(range(1, length(doc_id::varchar) + 1), lambda p: ascii(substr(doc_id::varchar, p::int, 1))::bigint) as codes from documents),
crc as (
    select doc_id, list_reduce(list_concat([4294967295::bigint], codes), lambda c, b: list_reduce(list_concat([xor(c, b)], range(0, 8)),
               lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)) as crc
    from bytes),
texts as (
    select d.doc_id, source, {_field("d.doc_id::varchar")} || {_field("source")} || {_field("lang")} || {_field("n_chars::varchar")} as head, text,
           case when c.crc % 2 = 1 then replace(text, chr(10), '') else text end as tampered
    from documents d left join (select distinct doc_id, crc from crc) c on c.doc_id = d.doc_id),
leaves as (
    select row_number() over () as row, doc_id, coalesce('=' || source, '-') as g,
           sha256(head || {_field("text")}) as leaf, sha256(head || {_field("tampered")}) as claim
    from texts),
a0 as materialized (
    select row, doc_id, claim, g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n, leaf as h from leaves),
{_tree("a", LEVELS)},
subroots as materialized ({" union all ".join(f"select g, h from a{at} where n = 1" for at in range(LEVELS + 1))}),
s0 as materialized (select '' as g, g as name, row_number() over (order by g) - 1 as i, count(*) over () as n, h from subroots),
{_tree("s", UPPER)},
top as ({" union all ".join(f"select h from s{at} where n = 1" for at in range(UPPER + 1))}),
w0 as materialized (select row, g, i as at, '' as proof, claim as cur from a0),
{_walk("a", "w", LEVELS)},
v0 as materialized (select w.row, '' as g, s.i as at, w.proof, w.cur from w{LEVELS} w join s0 s on s.name = w.g),
{_walk("s", "v", UPPER)}
select a.doc_id, a.h as leaf, s.h as subroot, t.h as root, sha256(v.proof) as proof_sha256, v.cur as folded_root, v.cur = t.h as verified
from a0 a join v{UPPER} v on v.row = a.row join subroots s on s.g = a.g cross join top t
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_dart_minhash": op2_dart_minhash,
        "op3_warc_segments": op3_warc_segments,
        "op4_attention_quality": op4_attention_quality,
        "op5_weighted_fair_mix": op5_weighted_fair_mix,
        "op6_html_blocks": op6_html_blocks,
        "op7_minhash_fingerprints": op7_minhash_fingerprints,
        "minhash_near_duplicates": minhash_near_duplicates,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_url_filters": op10_url_filters,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_noisy_toxicity": op12_noisy_toxicity,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op3_warc_segments": OP3_SQL,
        "op5_weighted_fair_mix": OP5_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op10_url_filters": OP10_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
