"""The Merkle manifest against a plain tree, tampering, odd rows and open frontiers."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import merkle
from quarrylight.llm import queries as q
from quarrylight.llm.merkle import LINK, OPEN, ROOT, climb, fold, leaf_digest, merkle_manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    """(left siblings, right siblings) a level."""
    out = []
    for level in tree[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def brute(docs, tampered):
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append((d[0] is not None, d[0], leaf_of(d), leaf_of(tampered(d))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[s] = levels([x[2] for x in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, doc, leaf, claim) in enumerate(groups[s]):
            sides = path(trees[s], i) + path(top, k)
            cur = claim
            for left, right in sides:
                cur = sha(left + cur + right)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in sides)), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    rows = df.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("p"), "folded_root", "verified")
    return sorted(map(tuple, rows.collect()), key=str)


def test_op13(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*COLUMNS).collect()
    cut = lambda d: (*d[:4], d[4].replace("\n", "") if d[4] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 else d[4])
    out = q.op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows == brute(docs, cut)
    assert 0 < sum(r[-1] for r in rows) < len(rows)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_open_frontiers_of_every_height(docs, monkeypatch, height):
    """Trees of 1 to 400 leaves over few partitions, one of them with most rows; blocks as low as one level."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    made = [(i, f"text {i}\nline", f"s{min(i * i // 900, 12)}" if i % 3 else "hot") for i in range(400)]
    df = docs(made).repartition(3)
    leaf = leaf_digest([F.col(c) for c in COLUMNS])
    rows = [(i, s, "en", len(t), t) for i, t, s in made]
    assert found(merkle_manifest(df, leaf)) == brute(rows, lambda d: d)


def test_odd_rows_clashing_names_and_an_empty_table(docs, odd, clashing):
    leaf = leaf_digest([F.col(c) for c in COLUMNS])
    rows = [(i, s, "en", len(t or ""), t) for i, t, s in odd]
    out = merkle_manifest(clashing(docs(odd)), leaf)
    assert found(out) == brute(rows, lambda d: d)
    assert merkle_manifest(docs([]), leaf).collect() == []


def test_many_groups_of_one_row(docs):
    made = [(i, "t", f"s{i:03d}") for i in range(200)]
    rows = [(i, s, "en", 1, t) for i, t, s in made]
    assert found(merkle_manifest(docs(made), leaf_digest([F.col(c) for c in COLUMNS]))) == brute(rows, lambda d: d)


def test_a_proof_verifies_its_row_only(docs):
    leaf = leaf_digest([F.col(c) for c in COLUMNS])
    rows = merkle_manifest(docs([(i, f"text {i}", f"s{i % 4}") for i in range(60)]), leaf).collect()
    for r in rows:
        assert r["verified"] and fold(r["leaf"], r["proof"], r["turns"]) == r["root"]
        assert fold(sha("other"), r["proof"], r["turns"]) != r["root"]


def test_partial_parents_wait_for_the_arity_that_their_size_gives():
    events = [("g", 7, 0, i, sha(str(i))) for i in (0, 2, 4, 5, 6)]
    out = list(climb(events))
    # 3 and 1 are not there: 4 and 5 stay open, 0 and 2 too; 6 is a run of one, its parent an only child so far.
    assert [r[3:5] for r in out if r[0] == LINK] == [(1, 2)]
    assert sorted(r[3:5] for r in out if r[0] == OPEN) == [(0, 0), (0, 2), (0, 4), (0, 5), (1, 2)]
    rest = list(climb([r[1:] for r in out if r[0] == OPEN] + [("g", 7, 0, 1, sha("1")), ("g", 7, 0, 3, sha("3"))]))
    assert [r for r in rest if r[0] == ROOT][0][5] == levels([sha(str(i)) for i in range(7)])[-1][0]
