"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import public_tokenizers
import pytest

import corpus_pipeline
from quarrylight.llm.bpe import encode
from quarrylight.llm.dart_minhash import near_dedup, near_duplicate_classes
from quarrylight.llm.exact_dedup import exact_dedup
from quarrylight.llm.fingerprints import edited_fingerprints, fingerprint, fingerprint_classes, near_duplicates
from quarrylight.llm.html_extract import extract
from quarrylight.llm.line_dedup import dedup_lines
from quarrylight.llm.mixing import mix, words_taken
from quarrylight.llm.quality import AttentionModel, score_quality
from quarrylight.llm.url_filters import filter_urls
from quarrylight.llm.warc import read_warc, write_warc

RULES = [("w1", "/", "block")]


def _urls(df):
    return filter_urls(df, df.sparkSession.createDataFrame(RULES, "host string, path string, verdict string"), url="text")


def _warc(df):
    from quarrylight.llm.common import scratch

    path = scratch(df.sparkSession, "warc-test")
    write_warc(df, path, "doc_id", "lang", "text", segment_bytes=1 << 16)
    return read_warc(df.sparkSession, path)


OPERATORS = {
    "line dedup": dedup_lines, "near classes": near_duplicate_classes, "near dedup": near_dedup, "warc": _warc,
    "quality": lambda df: score_quality(df, AttentionModel()), "mix": mix, "words taken": words_taken,
    "html": lambda df: extract(df, "text"), "fingerprint": fingerprint, "edited": edited_fingerprints, "fingerprint classes": fingerprint_classes, "similar": near_duplicates,
    "exact": exact_dedup, "bpe": lambda df: encode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True),
    "urls": _urls,
}
#: These do not return a row for each row.
FEWER = {"near dedup", "mix"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_with_clashing_names(name, docs, odd, clashing):
    df = clashing(docs(odd))
    out = OPERATORS[name](df)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    if name not in FEWER:
        assert len(rows) == len(odd)
    else:
        assert rows


def test_fingerprint_classes_of_odd_rows(docs, odd):
    """Each row has the fingerprint and the class of its own text, also where ids are null or repeated."""
    one = sorted(map(str, fingerprint_classes(docs(odd)).drop("class_id", "class_size").collect()))
    assert one == sorted(map(str, edited_fingerprints(docs(odd)).collect()))
    both = fingerprint_classes(docs(odd)).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(str, both)) == sorted(map(str, near_duplicates(docs(odd)).collect()))
    empty = {(r["class_id"], r["class_size"]) for r in both if r["doc_id"] in (1, 2, 3)}
    assert empty == {(1, 4)}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, docs, clashing):
    assert OPERATORS[name](docs([])).collect() == []


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_tables(at, docs, odd, spark, tmp_path):
    name, stage = corpus_pipeline.STAGES[at]
    labels = [(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, None), (99, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd, []):
        out = stage(spark, docs(rows), str(tmp_path))
        found = out.collect()
        assert bool(found) == bool(rows)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
