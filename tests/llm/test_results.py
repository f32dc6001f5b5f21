"""Every query against brute force on small tables, and the operators' own interfaces."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quarrylight.llm import queries as q
from quarrylight.llm.bpe import Codec, decode, encode, pieces, read_ranks
from quarrylight.llm.bucket_links import words_digest
from quarrylight.llm.common import scratch
from quarrylight.llm.components import components
from quarrylight.llm.dart_minhash import BANDS, ROWS, dart_signature, near_dedup, near_duplicate_classes
from quarrylight.llm.exact_dedup import DigestIndex, bit_filter, exact_dedup, may_be_in
from quarrylight.llm.fingerprints import _resigned, _signed, digits, fingerprint_classes, likeness, near_duplicates, signature
from quarrylight.llm.html_extract import main_text
from quarrylight.llm.line_dedup import dedup_lines
from quarrylight.llm.minimal_hash import MinimalHash
from quarrylight.llm.mixing import mix, words_taken
from quarrylight.llm.quality import WIDTH, AttentionModel, encode_passages, pooled, score_quality
from quarrylight.llm.shingles import shingle_hashes, word_hashes
from quarrylight.llm.url_filters import filter_urls
from quarrylight.llm.warc import chunked, http_block, parse, read_warc, record, unchunked, write_warc

DATA = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(name, *columns):
    return list(zip(*(pq.read_table(f"{DATA}/{name}.parquet").column(c).to_pylist() for c in columns), strict=True))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 1 line dedup


def brute_lines(docs):
    keys = lambda t: [x.strip(WHITE).translate(UPPER) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t in docs:
        for k in keys(t):
            holders[k].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, keys(t), strict=True) if len(k) < 10 or len(holders[k]) < 2 or min(holders[k]) == i]
        out.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return sorted(out)


def test_op1(spark):
    assert sorted(map(tuple, q.op1_line_dedup(spark, DATA).collect())) == brute_lines(rows("documents", "doc_id", "text"))


def test_a_line_of_all_documents_and_short_keys(spark, docs):
    made = [(i, f"  The Common Line HERE\t\nown line of {i:05d}\nshort\n\nthe common line here") for i in range(3000)]
    out = dedup_lines(docs(made)).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out} == {
        i: (t, 5, 0) if i == 0 else (f"own line of {i:05d}\nshort\n", 5, 2) for i, t in made
    }


def test_minimal_hash_is_minimal_and_perfect():
    r = np.random.default_rng(3)
    h1, h2 = r.integers(0, 2**64, 20_000, np.uint64), r.integers(0, 2**64, 20_000, np.uint64)
    h1[:50] = h1[0]
    index = MinimalHash.from_bytes(MinimalHash.of(h1, h2).to_bytes())
    assert sorted(index.slots(h1, h2)) == list(range(20_000))


# 2 and 7 near duplicates


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def weighted(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def plain(a, b):
    return len(a.keys() & b.keys()) / max(1, len(a.keys() | b.keys()))


def brute_classes(docs, similar):
    sets = [shingles(t) for _, t in docs]
    words = [tuple(re.findall(r"\w+", (t or "").lower())) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if words[i] == words[j] or (sets[i] and sets[j] and similar(sets[i], sets[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)].append(d)
    return sorted((d, min(least[find(i)]), len(least[find(i)])) for i, (d, _) in enumerate(docs))


def test_op2(spark):
    found = q.op2_dart_minhash(spark, DATA).collect()
    assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in found) == brute_classes(rows("documents", "doc_id", "text"), weighted)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


@pytest.fixture
def copies(prose):
    """Chains of near copies, a large group of near and exact copies, repeated passages, and texts that share a passage."""
    made, r = [], random.Random(5)
    for c in range(6):
        words = prose(c, 150).split()
        for _ in range(6):
            made.append(" ".join(words))
            words = list(words)
            for _ in range(3):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    base = prose(99, 120).split()
    for i in range(120):
        words = list(base)
        for j in range(2):
            words[r.randrange(len(words))] = f"x{r.randrange(5)}"
        made.append(" ".join(words) if i % 3 else " ".join(base).upper())
    passage = prose(77, 60)
    made += [f"{prose(1000 + i, 80)} {passage} {prose(2000 + i, 40)}" for i in range(60)]
    made += [f"{passage} {passage}", passage, "", " . ", "one two three", "One, two three!", "one two four"]
    return [(i, t) for i, t in enumerate(made)]


def test_near_classes_lose_no_link(docs, copies):
    found = near_duplicate_classes(docs(copies)).collect()
    assert sorted(map(tuple, found)) == brute_classes(copies, weighted)
    kept = near_dedup(docs(copies)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({r["class_id"] for r in found})


def test_near_dedup_keeps_one_row_a_class(docs, prose):
    a, b, c, d, e = (prose(i) for i in range(20, 25))
    rows = [(3, b), (7, a), (7, b), (8, a), (9, c), (9, c), (9, c), (None, c), (None, d), (None, d), (None, e), (None, a), (10, e + " more")]
    kept = near_dedup(docs(rows)).collect()
    assert sorted((r["text"], r["doc_id"], r["class_size"]) for r in kept) == sorted([(b, 3, 2), (a, 7, 3), (c, 9, 4), (e + " more", 10, 2), (d, None, 2)])


def test_copies_far_from_their_pivot(docs, prose):
    """Copies with up to eight edits of a text: some are near others only, some near none."""
    r, made = random.Random(9), []
    base = prose(5, 140).split()
    for i in range(160):
        words = list(made[r.randrange(len(made))].split()) if i % 4 == 3 else list(base)
        for _ in range(r.randrange(1, 9)):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        made.append(" ".join(words))
    rows = list(enumerate(made))
    want = brute_classes(rows, weighted)
    assert len({c for _, c, _ in want}) > 5
    assert sorted(map(tuple, near_duplicate_classes(docs(rows)).collect())) == want


def test_crowds_at_a_distance(docs, prose, monkeypatch):
    """Several versions of a text, each with near copies of its own: copies meet by the differences of their version."""
    from quarrylight.llm import bucket_links

    monkeypatch.setattr(bucket_links, "CROWD", 1)
    r, made = random.Random(21), []
    base = prose(8, 160).split()
    versions = [list(base) for _ in range(4)]
    for i, words in enumerate(versions):
        for j in range(6):
            words[(20 + 25 * j + 3 * i) % 160] = f"v{i}x{j}"
    for i in range(120):
        words = list(versions[i % 4] if i % 5 else base)
        for _ in range(r.randrange(0, 3)):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        made.append(" ".join(words))
    rows = list(enumerate(made))
    assert sorted(map(tuple, near_duplicate_classes(docs(rows)).collect())) == brute_classes(rows, weighted)


def test_fingerprint_classes(docs, copies):
    assert sorted(map(tuple, near_duplicates(docs(copies)).collect())) == brute_classes(copies, plain)


def test_dart_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(8)
    for n, top, share in ((300, 1, 0.8), (40, 30, 0.5), (2000, 3, 0.6)):
        e, w = r.integers(0, 2**64, n, np.uint64), r.integers(1, top + 1, n).astype(float)
        a, b = r.random(n) < (1 + share) / 2, r.random(n) < (1 + share) / 2
        true = w[a & b].sum() / w[a | b].sum()
        got = (dart_signature(e[a], w[a] * 0.7, 1024) == dart_signature(e[b], w[b] * 0.7, 1024)).mean()
        assert abs(got - true) < 0.06


def test_few_similar_pairs_share_no_band():
    """No more than with the 34 bands of 6 that came before."""
    missed = lambda bands, rows, similarity: (1 - similarity**rows) ** bands
    for similarity in (0.8, 0.85, 0.9):
        assert missed(BANDS, ROWS, similarity) <= missed(34, 6, similarity)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted((i, find(i)) for i in root if find(i) != i)


def test_op7(spark):
    docs = sorted(rows("documents", "doc_id", "text"))
    got = sorted(map(tuple, q.op7_minhash_fingerprints(spark, DATA).collect()))
    prints = [digits(signature(shingle_hashes(t))) for _, t in docs]
    for i, (d, t) in enumerate(docs):
        k, quarter = (i + 1) % len(docs), len(t) // 4
        edited = t[: len(t) - quarter] + docs[k][1][:quarter]
        other = digits(signature(shingle_hashes(edited)))
        assert got[i][:7] == (d, len(t), sha(edited), prints[i], other, likeness(prints[i], other), likeness(prints[i], prints[k]))
        assert abs(got[i][5] - plain(shingles(t), shingles(edited))) < 0.22
    assert len(got) == len(docs)
    assert [(g[0], *g[7:]) for g in got] == brute_classes(docs, plain)


def test_op7_shuffles_texts_once_and_compressed(spark, docs, prose):
    """Texts meet their neighbours compressed; for the join only those of shared buckets move."""
    made = [(i, prose(i, 60 if i == 3 else 30_000)) for i in range(60)]
    made += [(1000, made[3][1] + " more")]
    path = scratch(spark, "texts")
    docs(made).write.parquet(path)
    written = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in fingerprint_classes(spark.read.parquet(path)).collect()}
    assert got == {i: (3, 2) if i in (3, 1000) else (i, 1) for i, _ in made}
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < written() - before < 0.75 * sum(len(t) for _, t in made)


def test_parts_of_a_text_are_signed_as_the_whole():
    r = random.Random(5)
    some = [*"aZ09_ \n.'\t\u00a0\u3000", "\u03a3", "\u0130", "\u00e9", "\u4e2d", "\U0001f600", "word ", "\u039f\u0394\u039f\u03a3 ", "two words\n"]
    for _ in range(400):
        own, following = ("".join(r.choice(some) for _ in range(r.randrange(90))) for _ in "ab")
        quarter = len(own) // 4
        edited = own[: len(own) - quarter] + following[:quarter]
        signed = _signed(own, 5)
        assert (signed.whole == signature(shingle_hashes(own))).all() and (signed.h1, signed.h2) == words_digest(word_hashes(own))
        assert (_resigned(signed, edited, 5) == signature(shingle_hashes(edited))).all()


def test_minhash_near_duplicates(spark):
    found = q.queries()["minhash_near_duplicates"](spark, DATA).collect()
    assert sorted(map(tuple, found)) == brute_classes(rows("documents", "doc_id", "text"), plain)


def test_fingerprint_likeness_estimates_jaccard(prose):
    a, b = prose(1, 900).split(), prose(2, 900).split()
    mixed = a[:600] + b[:300]
    true = plain(shingles(" ".join(a)), shingles(" ".join(mixed)))
    one, other = (digits(signature(shingle_hashes(" ".join(x)))) for x in (a, mixed))
    assert abs(likeness(one, other) - true) < 0.13


# 3 WARC


def test_op3(spark):
    pages = rows("pages", "page_id", "html")
    first = {}
    for i, h in sorted(pages):
        first.setdefault(h or "", i)
    want = []
    for i, h in pages:
        data = (h or "").encode()
        other = None if first[h or ""] == i else first[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if other is None else "revisit", other))
    got = q.op3_warc_segments(spark, DATA).drop("segments").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_op3_reassembles_long_pages(spark):
    size = {i: len((h or "").encode()) for i, h in rows("pages", "page_id", "html")}
    got = [r for r in q.op3_warc_segments(spark, DATA).collect() if r["record_type"] == "response"]
    assert any(r["segments"] for r in got)
    assert all(r["segments"] >= size[r["page_id"]] / q.SEGMENT_BYTES for r in got if size[r["page_id"]] > q.SEGMENT_BYTES)


def test_segments_are_reassembled(spark, docs):
    made = [(1, "ä€\U0001f600" * 5000), (2, "small"), (3, "ä€\U0001f600" * 5000), (4, ""), (5, "\r\n\r\nWARC/1.1\r\n" * 900)]
    path = scratch(spark, "warc")
    write_warc(docs(made), path, "doc_id", "lang", "text", revisit_bytes=10, segment_bytes=4096, file_records=7)
    got = {r["page_id"]: r for r in read_warc(spark, path).collect()}
    assert {i: bytes(got[i]["payload"]) for i in (1, 2, 4, 5)} == {i: t.encode() for i, t in made if i != 3}
    assert (got[3]["record_type"], got[3]["payload_bytes"], got[3]["payload_digest"]) == ("revisit", 45_000, got[1]["payload_digest"])
    assert got[3]["refers_to"] == got[1]["record_id"]
    assert got[1]["segments"] > 10 and got[5]["segments"] > 2 and got[2]["segments"] == 0


def test_bad_segments_raise(spark, docs, tmp_path):
    (tmp_path / "kind=segmented").mkdir()
    import gzip

    block = http_block(b"z" * 100, True)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Segment-Number", "1")]
    tail = [("WARC-Type", "continuation"), ("WARC-Record-ID", "<b>"), ("WARC-Segment-Origin-ID", "<a>"), ("WARC-Segment-Number", "2"), ("WARC-Segment-Total-Length", "999")]
    data = b"\r\n\r\n".join([record(tail, block[60:]), record(head, block[:60]), b""])
    (tmp_path / "kind=segmented/x.gz").write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="missing or do not have the total length"):
        read_warc(spark, str(tmp_path)).collect()
    assert [(r["record_id"], r["whole"]) for r in read_warc(spark, str(tmp_path), strict=False).collect()] == [("<a>", False)]
    assert [b for _, b in parse(data)] == [block[60:], block[:60]]


def test_chunked_framing():
    for n in (0, 1, 7, 8, 9, 100):
        assert unchunked(chunked(b"x\r\n" * n, 8)) == b"x\r\n" * n
    assert unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        unchunked(b"4\r\nabc\r\n0\r\n\r\n")


# 4 quality


def test_op4_on_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    labels = dict(zip(*(pq.read_table(f"{data}/labels.parquet").column(c).to_pylist() for c in ("doc_id", "quality")), strict=True))
    got = q.op4_attention_quality(spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    test = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(test) > 50 and sum(a == b for a, b in test) / len(test) > 0.95


def test_op4_scores_against_plain_loops(docs, prose):
    """The forward pass, passage by passage and number by number."""
    model = AttentionModel(0.4)
    r = np.random.default_rng(1)
    model.mean, model.scale = r.random(WIDTH) / 10, 1 + r.random(WIDTH)
    model.p["c"] = r.normal(0, 1, len(model.p["c"]))
    p = {k: v.tolist() for k, v in model.p.items()}
    texts = ["", None, "  two! words", prose(1, 63), prose(2, 64), "x\n" * 500, prose(3, 700)]

    def plain(text):
        dot = lambda x, matrix: [sum(a * row[j] for a, row in zip(x, matrix, strict=True)) for j in range(len(matrix[0]))]
        hidden, gates = [], []
        for x in encode_passages(text).tolist():
            x = [(a - m) * s for a, m, s in zip(x, model.mean.tolist(), model.scale.tolist(), strict=True)]
            h = [math.tanh(a + b) for a, b in zip(dot(x, p["W"]), p["b"], strict=True)]
            hidden.append(h)
            gates.append(sum(w * math.tanh(v) / (1 + math.exp(-u)) for w, v, u in zip(p["w"], dot(h, p["V"]), dot(h, p["U"]), strict=True)))
        total = sum(math.exp(g) for g in gates)
        z = [sum(math.exp(g) / total * h[j] for g, h in zip(gates, hidden, strict=True)) for j in range(len(p["c"]))]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["c"], strict=True)) - p["d"]))

    got = {r["doc_id"]: r for r in score_quality(docs(enumerate(texts)), model).collect()}
    for i, text in enumerate(texts):
        assert abs(got[i]["score"] - plain(text)) < 1e-6 and got[i]["predicted"] == (got[i]["score"] >= 0.3)


def test_gradients_against_differences():
    r, model = np.random.default_rng(4), AttentionModel(0.3)
    model.p["c"] = r.normal(0, 1, len(model.p["c"]))
    x, starts, y = r.normal(0, 1, (9, WIDTH)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.score(x, starts)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, gradient in model._gradients(x, starts, y).items():
        flat = model.p[name].reshape(-1)
        for i in {0, flat.size // 2, flat.size - 1}:
            kept = flat[i]
            flat[i] = kept + 1e-5
            above = loss()
            flat[i] = kept - 1e-5
            below = loss()
            flat[i] = kept
            assert abs((above - below) / 2e-5 - np.asarray(gradient).reshape(-1)[i]) < 1e-6


def test_passages_of_a_text(prose):
    assert encode_passages("  one two! three four!")[0, 9] == encode_passages("one two! three four!")[0, 9] == 0.5
    x = encode_passages(prose(1, 64 * 300))
    few = pooled(x, 128)
    assert len(x) == 300 and len(few) == 128 and np.allclose(few[0], x[:2].mean(0)) and np.allclose(few[-1], x[-3:].mean(0)) and pooled(x, 300) is x


# 5 mixing


def brute_mix(docs):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    own = {s: sum(n for n, d in zip(size, docs, strict=True) if d[2] == s) for s in names}
    target, left, budget = {}, set(names), 1.5 * sum(size)
    while left:
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if 2 * own[s] <= weight[s] * level}
        target |= {s: float(2 * own[s]) for s in full} if full else {s: weight[s] * level for s in left}
        left = left - full if full else set()
    return size, own, target


def test_op5(spark):
    docs = rows("documents", "doc_id", "text", "source")
    size, own, target = brute_mix(docs)
    got = {r["doc_id"]: r for r in q.op5_weighted_fair_mix(spark, DATA).collect()}
    taken = Counter()
    for (i, _, s), n in zip(docs, size, strict=True):
        r = got[i]
        assert (r["size"], r["source_size"]) == (n, own[s]) and math.isclose(r["target"], target[s]) and 0 <= r["taken"] <= 2 * n
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in own) and len(got) == len(docs)


def test_mix_is_in_order_and_cut_at_words(docs, prose):
    made = [(i, "  " + prose(i, 20 + i), f"s{i % 4}") for i in range(40)]
    out = mix(docs(made)).collect()
    finish = [r["mix_finish"] for r in out]
    assert finish == sorted(finish)
    texts = dict((i, t) for i, t, _ in made)
    for r in out:
        assert len(r["text"].split()) == r["mix_words"] and texts[r["doc_id"]].startswith(r["text"])
    size, _, target = brute_mix(made)
    assert sum(r["mix_words"] for r in out) == math.floor(1.5 * sum(size))
    given = Counter()
    for r in out:
        given[r["source"]] += r["mix_words"]
    assert all(abs(given[s] - target[s]) <= 1 for s in target)


def test_the_budget_cuts_the_sorted_packets(docs, prose, monkeypatch):
    """Packets of many words, sorted by finish time in plain Python: the cut falls into one of them."""
    from quarrylight.llm import mixing

    monkeypatch.setattr(mixing, "PACKETS", 7)
    monkeypatch.setattr(mixing, "RANGES", 5)
    made = [(i, prose(i, 1 + 13 * i % 200), f"s{i % 5}" if i % 5 else None) for i in range(60)]
    size, own, target = brute_mix(made)
    packets, position = [], Counter()
    queue = sorted(range(60), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    for epoch in (0, 1):
        for i in queue:
            s, most = made[i][2], -(-own[made[i][2]] // 7)
            for at in range(0, size[i], most):
                words = min(most, size[i] - at)
                position[s] += words
                packets.append((position[s] / target[s], s is None, s or "", position[s], words, i))
    want, left = Counter(), math.floor(1.5 * sum(size))
    for *_, words, i in sorted(packets):
        want[i] += min(words, left)
        left -= min(words, left)
    got = {r["doc_id"]: r["taken"] for r in words_taken(docs(made)).collect()}
    assert got == {i: want[i] for i in range(60)}
    texts = Counter()
    for r in mix(docs(made)).collect():
        texts[r["doc_id"]] += len(r["text"].split())
    assert texts == +want


# 6 HTML


def article(page):
    """The blocks of the article of the tables' pages."""
    import html

    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"<(?:b|br)>", " ", p) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(t for t in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if t)


def test_op6(spark):
    pages = {i: (u, h) for i, u, h in rows("pages", "page_id", "url", "html")}
    got = q.op6_html_blocks(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r["url"], r["text"]) == (pages[r["page_id"]][0], article(pages[r["page_id"]][1])) and r["n_chars"] == len(r["text"])


def test_html_parts():
    body = "It is the first part of the text that we would like to have from this page, and it has many of the words that are in all texts. " * 3
    page = f"""<html><head><title>T</title></head><body class="nav-open"><header><a href=/>Site</a></header><nav><ul><li><a href=a>Menu</a></ul></nav>
    <div id="cookieNotice">We use cookies to make this site work for you and for the others who use it.</div>
    <div class=content><h2>A heading &amp; more</h2><p>{body}<p>Short one.<p>{body}<ul><li>x &lt; y<li>an item</ul></div>
    <aside>On the side</aside><form><p>Your name and your mail so that we can write to you</p></form><div class="comments"><p>{body}</p></div>
    <script>var a = "<p>no</p>";</script><style>p {{}}</style><!-- <p>no</p> --><footer>&copy; {body}</footer></body></html>"""
    clean = re.sub(r"\s+", " ", body).strip()
    assert main_text(page) == "\n".join(["A heading & more", clean, "Short one.", clean, "x < y", "an item"])
    inside = page.replace("<div class=content>", "<main>").replace("</ul></div>", "</ul></main>")
    assert main_text(inside) == "\n".join(["A heading & more", clean, "Short one.", clean, "x < y", "an item"])
    assert main_text(None) == main_text("") == main_text("<div><p") == ""
    assert main_text("plain words only") == "plain words only"


WRAPPED = [
    '<div class="content-sidebar-wrap"><main><article>{}</article></main></div>', '<div class="layout has-sidebar"><p>{}</div>',
    '<main class="content no-sidebar">{}</main>', '<form id=aspnetForm><div class=page><article>{}</article></div></form>',
    '<div class="sidebar-left"><h1>Title</h1><article class="post widget">{}</article></div>', '<div class="sidebar-layout"><p>{}</div>',
    '<div role="form"><div role="main" class="with-comments">{}</div></div>', '<div id="comments"><article>{}</article></div>', '<div class="contentSidebarWrap"><p>{}</div>',
]


@pytest.mark.parametrize("wrapped", WRAPPED)
def test_marks_of_wrappers_keep_the_article(wrapped):
    body = "It is the first part of the text that we would like to have from this page, and it has many of the words that are in all texts. " * 3
    clean = re.sub(r"\s+", " ", body).strip()
    inner = f"<p>{body}</p><div class='has-children menu-item-has-children'>A line of the menu</div><form>{body}</form><div class=comments><article class=comment>{body}</article></div>"
    page = f"<body><nav>Menu</nav>{wrapped.format(inner)}<div class='footer-wrap'>{body}</div><div class='sidebar'><p>{body}</div><aside><article>{body}</article></aside></body>"
    assert main_text(page) == clean


PROSE = "It is the first part of the text that we would like to have from this page, and it has many of the words that are in all texts."


@pytest.mark.parametrize("page, want", [
    (f"<div><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><div><a>Home</a> <a>About us</a></div>", [PROSE, "Short one.", PROSE]),
    (f"<div><ul><li><a>Home</a><li><a>News</a></ul></div><div><p>{PROSE * 2}</p><p>Yes.</p><p>{PROSE}</p></div><div><p>Rights reserved</p><p><a>Imprint</a></p></div>", [PROSE * 2, "Yes.", PROSE]),
    (f"<div><p>Log in</p><p><a>Start page</a></p></div><div><h2>The news</h2><p>{PROSE * 2}</p></div><div><p><a>More of the news</a></p><p>Top</p></div>", ["The news", PROSE * 2]),
    (f"<div><p>{PROSE * 2}</p><p>Zahlen Preise Termine Adressen Telefon Karte Anfahrt Parken Buchen Preise Zeiten</p><p>{PROSE * 2}</p></div>", [PROSE * 2, PROSE * 2]),
    (f"<article class='post search-engines'><p>{PROSE}</article>", [PROSE]), (f"<article class=form-guide><p>{PROSE}</article>", [PROSE]),
    (f"<main><div class=promotion-guide><p>{PROSE}</div></main>", [PROSE]), (f"<article><p>{PROSE}<p><a>The full report of the committee</a><p>{PROSE}</article>", [PROSE, "The full report of the committee", PROSE]),
    (f"<article><p>{PROSE}</article><div class=kommentare><p>{PROSE}</div>", [PROSE]),
])
def test_blocks_are_told_by_density_links_and_neighbours(page, want):
    assert main_text(page) == "\n".join(want)


@pytest.mark.parametrize("part", ["section class=social-history", "div class='legal-analysis'", "div class=notice-of-meeting", "div class=share-price-table", "section id=search-algorithms", "div class='left side'"])
def test_an_article_keeps_sections_with_names_like_those_of_other_parts(part):
    page = f"<article><p>{PROSE}</p><{part}><p>Its own part. {PROSE}</p></{part.split()[0]}></article>"
    assert main_text(page) == f"{PROSE}\nIts own part. {PROSE}"


@pytest.mark.parametrize("name", ["comments", "comment-list", "ad", "ad-slot", "related-posts", "share-buttons", "newsletter", "post comments"])
def test_parts_that_are_no_text_go_from_an_article(name):
    assert main_text(f"<article><p>{PROSE}</p><div class='{name}'><p>{PROSE}</p></div></article>") == PROSE


def test_references_open_links_and_pages_of_short_blocks():
    assert main_text(f"<article><p>{PROSE}</p><ul><li><a href=x>First reference</a><li><a href=y>Second</a></ul></article>") == f"{PROSE}\nFirst reference\nSecond"
    assert main_text("<div class='content'><p>Short one.</p><p>Two short.</p></div><nav>Menu</nav>") == "Short one.\nTwo short."
    assert main_text(f"<div><a href=/><div>Home page, {PROSE}</div></a></div><div><p>{PROSE}</p></div>") == PROSE
    # A link that the page never closes ends with its block.
    assert main_text(f"<div><a href=/><p>{PROSE}</p><p>{PROSE}</p></div>") == f"{PROSE}\n{PROSE}"
    assert main_text(f"<div><p><a name=top>{PROSE}</a></p></div>") == PROSE


def test_density_links_and_neighbours_without_marks():
    """The tables' pages without articles, menus and classes: what the two passes make of bare divs."""
    lost = kept = 0
    for (page,) in rows("pages", "html"):
        bare = re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", re.sub(r' (?:class|id|role)="[^"]*"', "", page))
        want, got = set(article(page).split("\n")), set(main_text(bare).split("\n"))
        lost, kept = lost + len(want - got), kept + len(want & got)
        assert not any(re.search(r"<|href", t) for t in got)
    assert lost / (lost + kept) < 0.1


def test_a_long_attribute_takes_linear_time():
    import time

    began = time.process_time()
    assert main_text(f"<div {'n' * 400_000}><p>{PROSE}</p></div>") == PROSE
    assert time.process_time() - began < 1


@pytest.mark.parametrize("part", ["<a href=x>", "<div a='", "a=' ", "<div x y z ", "<svg>", "<title>", "<head>", "<div>", "<p>", "<li>", "<script>", "<!--", "<a '", "&", "<div></p>"])
def test_malformed_pages_take_linear_time(part):
    import time

    began = time.process_time()
    main_text(part * (400_000 // len(part)) + "<p>end")
    assert time.process_time() - began < 5


# 8 exact dedup


def test_op8(spark):
    docs = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows("documents", "doc_id", "text")]
    groups = defaultdict(list)
    for i, t in docs:
        groups[t].append(i)
    want = [(i, min(groups[t]), len(groups[t]), i == min(groups[t]), sha(t)) for i, t in docs]
    assert sorted(map(tuple, q.op8_exact_dedup(spark, DATA).collect())) == sorted(want)


def test_large_group_and_white_space(docs):
    made = [(i, "a  b\tc" if i % 2 else "a b \n c") for i in range(4000)] + [(5000, "a b c "), (None, "z"), (None, None), (7000, "")]
    got = {r["doc_id"]: r for r in exact_dedup(docs(made)).collect() if r["doc_id"] is not None}
    assert all((got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (0, 4000, i == 0) for i in range(4000))
    assert (got[5000]["keep_id"], got[5000]["group_size"]) == (5000, 1) and (got[7000]["keep_id"], got[7000]["group_size"]) == (7000, 2)


def test_runs_are_compacted(spark):
    index = DigestIndex(spark, fan_in=3)
    for batch in range(4):
        index.flush(spark.createDataFrame([(bytes([d]), batch * 10 + d) for d in range(5)], "digest binary, id long"))
    assert len(index.runs) == 1 and index.level
    for _ in range(2):
        assert sorted((bytes(r[0]), r[1], r[2]) for r in index.lookup().collect()) == [(bytes([d]), d, 4) for d in range(5)]
        assert [tuple(r)[1:] for r in index.find(bytes([3])).collect()] == [(3, 4)] and index.find(b"x").isEmpty()
        index.compact()


def test_runs_are_sorted_and_flushed_by_each_task(spark):
    index = DigestIndex(spark)
    rows = spark.range(1000).repartition(4).selectExpr("unhex(sha2(cast(id % 300 as string), 256)) as digest", "id")
    parts = [[r["digest"] for r in x] for x in index.flush(rows).rdd.glom().collect() if x]
    assert sum(map(len, parts)) == 1000 and len({r["f"] for r in spark.read.parquet(index.runs[0]).selectExpr("input_file_name() as f").collect()}) == 4
    index.compact()
    assert not index.runs and index.lookup().count() == 300


def test_bit_filter_has_all_its_ids_and_few_others(spark):
    words, bits = bit_filter(spark.range(0, 3000, 3), 1000)
    kept = {r["id"] for r in may_be_in(spark.range(-6000, 6000), words, bits).collect()}
    assert kept >= set(range(0, 3000, 3)) and len(kept) < 1000 + 0.1 * 12000 and words.count() <= bits // 64


def test_texts_that_share_a_digest(docs):
    """Digests of one byte, so that many do; ids repeat too."""
    made = [(i % 700 if i < 1400 else i, f"text {i % 400}" + " " * (i % 3)) for i in range(2000)] + [(None, "text 1"), (None, "alone"), (None, None)]
    groups = defaultdict(list)
    for i, t in made:
        groups[re.sub(" +", " ", t or "")].append(2**63 - 1 if i is None else i)
    want = Counter()
    for i, t in made:
        own = groups[norm := re.sub(" +", " ", t or "")]
        least = min(own)
        want[i, None if least == 2**63 - 1 else least, len(own), (2**63 - 1 if i is None else i) == least, sha(norm)] += 1
    for size in (1, 32):
        got = exact_dedup(docs(made), digest_bytes=size).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert Counter(map(tuple, got)) == want


# 9 BPE


def test_op9(spark):
    codec = Codec(read_ranks(q.RANKS), public_tokenizers.PATTERN)
    want = []
    for i, t in rows("documents", "doc_id", "text"):
        ids = codec.encoding.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert sorted(map(tuple, q.op9_byte_bpe(spark, DATA).collect())) == sorted(want)


def test_long_texts_in_pieces(docs, spark):
    r = random.Random(4)
    text = "".join(r.choice(["word", " ", "\n", "  ", "é", "12", "'s", "!", "\u00a0", "\U0001f600"]) for _ in range(200_000))
    codec = Codec(read_ranks(q.RANKS), public_tokenizers.PATTERN)
    assert "".join(pieces(text)) == text and len(list(pieces(text))) > 3
    assert codec.encode(text) == codec.encoding.encode_ordinary(text)
    coded = encode(docs([(1, text), (2, None)]), q.RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["decoded"]) for r in decode(coded, q.RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {1: text.encode(), 2: b""}
    half = codec.encode("\U0001f600")[:1]
    assert "\U0001f600".encode().startswith(codec.decode(half)) and codec.decode(half)


def test_long_white_space():
    codec = Codec(read_ranks(q.RANKS), public_tokenizers.PATTERN)
    one = lambda text: codec.encoding._encode_single_piece(text)
    n = 1_000_000
    for white in (" ", "\n", " \t\n\u3000"):
        run = white * (n // len(white))
        assert codec.encode(run) == one(run)
        assert codec.encode(f"a{run} b") == [*one("a"), *one(run), *one(" b")]
    assert codec.decode(codec.encode("\n" * n + "x")) == b"\n" * n + b"x"


def test_white_space_is_cut_where_the_pattern_cuts(monkeypatch):
    from quarrylight.llm import bpe

    monkeypatch.setattr(bpe, "PIECE", 20)
    monkeypatch.setattr(bpe.pieces, "__defaults__", (20,))
    monkeypatch.setattr(bpe, "_RUN", re.compile(bpe._RUN.pattern.replace(str(1 << 16), "5")))
    codec, r = Codec(read_ranks(q.RANKS), public_tokenizers.PATTERN), random.Random(1)
    for _ in range(2000):
        text = "".join(r.choice("ab1.' \t\n\x1c\x85\u3000\u00e9") * r.choice([1, 1, 1, 2, 7]) for _ in range(r.randrange(1, 60)))
        assert codec.encode(text) == codec.encoding.encode_ordinary(text)


# 10 URL filters


def test_nested_rules_against_brute_force(spark):
    r = random.Random(6)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "net", "x.net", "example.net", "ample.com"]
    paths = ["/", "/en", "/en/", "/en/a", "/en/a/b", "/de/", "/e", ""]
    rules = {(r.choice(hosts), r.choice(paths)): r.choice(["allow", "block"]) for _ in range(28)}
    urls = [(i, r.choice(["http://", "https://", "//", "", "x://"]) + r.choice(["", "w."]) + r.choice(hosts + ["EXAMPLE.com", "com:80"]) + r.choice(paths) + r.choice(["", "a", "/b", "?q=/en/", "#/en/", "en/a/b"])) for i in range(900)]
    urls += [(i, "http://example.com/en/hot") for i in range(900, 2000)] + [(2000, None), (2000, "http://"), (2000, "http://example.com/en/hot")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")
    want = []
    for i, u in urls:
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(UPPER)
        fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        want.append((i, host, path, best[2] or "", best[3]))
    got = [(r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in filter_urls(df, table).collect()]
    assert sorted(got) == sorted(want)


# the pipeline


def test_pipeline_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        path = scratch(spark, "stage")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = [r.asDict() for r in docs.collect()]
    everything = dict(rows("documents", "doc_id", "text"))
    good = {r["doc_id"]: r["text"] for r in out["quality classifier"]}
    assert all(everything[i] == t for i, t in good.items()) and 0.6 * len(everything) < len(good) < len(everything)
    lined = {r["doc_id"]: r["text"] for r in out["line dedup"]}
    assert {i: sha(t) for i, t in lined.items()} == {i: digest for i, _, _, digest in brute_lines(sorted(good.items()))}
    classes = brute_classes(sorted(lined.items()), weighted)
    assert sorted(r["doc_id"] for r in out["MinHash near-dedup"]) == sorted({c for _, c, _ in classes})
    near = [(r["doc_id"], r["text"], r["source"]) for r in out["MinHash near-dedup"]]
    _, own, target = brute_mix(near)
    taken = Counter()
    for r in out["mixing"]:
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - target[s]) <= 1 for s in own) and sum(taken.values()) == math.floor(1.5 * sum(own.values()))
    codec = Codec(read_ranks(q.RANKS), public_tokenizers.PATTERN)
    last = sorted((r["doc_id"], r["n_tokens"], sha(r["text"])) for r in ({**m, "n_tokens": len(codec.encode(m["text"]))} for m in out["mixing"]))
    assert last == sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in out["byte-level BPE"])
    ran = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in ran) == last
