"""Nearest neighbours and BM25 against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import ann, bm25


def exact(vectors, queries, k):
    out = {}
    for q, x in queries.items():
        scored = sorted(((-float(np.dot(v, x)), i) for i, v in vectors.items() if i != q))
        out[q] = [i for _, i in scored[:k]]
    return out


def as_double(x):
    return np.array(x, np.float32).astype(np.float64)


def test_small_tables_are_searched_nearly_exactly(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(v) for v in draw.normal(size=8) * draw.uniform(0.2, 3)], 0) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(frame, frame.filter("vec_id % 20 = 0"), 20).collect()
    vectors = {i: as_double(x) for i, x, _ in rows}
    want = exact(vectors, {i: x for i, x in vectors.items() if i % 20 == 0}, 20)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), abs=1e-12)
    assert sum(len(set(found[q]) & set(x)) for q, x in want.items()) >= 0.9 * sum(map(len, want.values()))
    # Equal vectors are found together, in the order of their ids.
    for q, ids in found.items():
        copies = [i for i in ids if i >= 300 or i == 0]
        assert copies == sorted(copies), q


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equal_vectors_have_equal_scores_wherever_they_lie(spark, kind):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(40, 64))
    rows = [(i, [float(v) for v in base[draw.integers(0, 40)]]) for i in range(3000)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = ann.nearest(frame, frame.filter("vec_id % 100 = 0"), 60).collect()
    vectors = {i: tuple(as_double(x) if kind == "float" else np.array(x)) for i, x in rows}
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault(r["query_id"], []).append(r)
    for q, found in by_query.items():
        score = {}
        for r in found:
            score.setdefault(vectors[r["vec_id"]], set()).add(r["score"])
        assert all(len(x) == 1 for x in score.values())
        order = [(-r["score"], r["vec_id"]) for r in found]
        assert order == sorted(order)
        # All that ties with the first in the list and has a smaller id than the last of them is there.
        own = sorted(i for i, x in vectors.items() if x == vectors[q] and i != q)[: len(found)]
        assert [r["vec_id"] for r in found][: len(own)] == own


def test_double_vectors_are_not_rounded(spark):
    rows = [(0, [1.0, 0.0]), (20, [1e300, 1e-3]), (1, [1.0 + 1e-12, 0.0]), (2, [1.0, 5.0]), (3, [1e39, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(frame, frame.filter("vec_id % 20 = 0"), 20).collect()}
    assert got[0, 1] == 1.0 + 1e-12 and got[0, 3] == 1e39 and got[0, 20] == 1e300


@pytest.mark.parametrize("n", [30, 500])
def test_recall_of_the_hashing_on_small_random_tables(spark, n):
    draw = np.random.default_rng(n)
    x = draw.normal(size=(n, 64)).astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(frame, frame.filter("vec_id % 10 = 0"), 20).collect()
    hits = total = 0
    for q in range(0, n, 10):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = set(np.argsort(-scores)[: min(20, n - 1)].tolist())
        hits += len(best & {r["vec_id"] for r in got if r["query_id"] == q})
        total += len(best)
    assert hits / total >= 0.9


def test_cells_that_many_queries_visit_are_copied(spark, monkeypatch):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(1200, 16))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    ask = frame.filter("vec_id % 4 = 0")
    rows = lambda: sorted(map(tuple, ann.nearest(frame, ask, 5).collect()))
    whole = rows()
    monkeypatch.setattr(ann, "CELL_BYTES", 16 * 8 * 50)
    assert rows() == whole


def test_recall_on_random_vectors(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(6000, 32)) + 1.5 * draw.normal(size=(10, 32))[draw.integers(0, 10, 6000)]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(frame, frame.filter("vec_id % 60 = 0"), 20).collect()
    vectors = x.astype(np.float32).astype(float)
    hits = total = 0
    for q in range(0, 6000, 60):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = set(np.argsort(-scores)[:20].tolist())
        hits += len(best & {r["vec_id"] for r in got if r["query_id"] == q})
        total += 20
    assert hits / total >= 0.9


def test_awkward_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 0.0]), (6, [1.0]), (7, []), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (40, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(frame, frame.filter("vec_id % 20 = 0"), 20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 20), (20, 1, 0)]
    assert ann.nearest(frame.limit(0), frame.limit(0), 20).count() == 0


def test_hot_buckets_are_split_without_loss(spark, monkeypatch):
    draw = np.random.default_rng(3)
    centre = draw.normal(size=16)
    x = np.vstack([centre + 0.01 * draw.normal(size=(3000, 16)), draw.normal(size=(1000, 16))])
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "CELL_BYTES", 256 * 8 * 16)
    monkeypatch.setattr(ann, "HOT", 32)
    got = ann.nearest(frame, frame.filter("vec_id % 400 = 0"), 20).collect()
    vectors = x.astype(np.float32).astype(float)
    for q in range(0, 2800, 400):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        assert len(set(np.argsort(-scores)[:20].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q}) >= 19


def test_probe_template_is_in_order_and_valid():
    sets = ann.probe_template(6, 40)
    assert len(sets) == len(set(sets)) == 40 and sets[0] == (0,)
    assert all(11 - p not in s for s in sets for p in s)


def brute_bm25(documents, query, k):
    words = {d: (t or "").encode().lower().split() for d, t in documents}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    counts = {d: Counter(w) for d, w in words.items()}
    held = Counter(t for c in counts.values() for t in c)
    scored = []
    for d, c in counts.items():
        s = 0.0
        for t in sorted(set(query.encode().lower().split())):
            if c[t]:
                s += math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(words[d]) / mean))
        if s:
            scored.append((-round(s, 6), d))
    return [(d, -s) for s, d in sorted(scored)[:k]]


@pytest.mark.parametrize("shard", [7, 16384])
def test_bm25_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(bm25, "SHARD", shard)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    draw = random.Random(3)
    vocabulary = [f"t{int(draw.paretovariate(0.7)) % 300}" for _ in range(3000)]
    documents = [(d, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 80)))) for d in range(300)] + [(900, None), (901, "")]
    documents += [(1000 + d, documents[5][1]) for d in range(30)]
    queries = [(q, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 12)))) for q in range(15)] + [(50, None), (51, ""), (52, "unseen"), (53, documents[5][1])]
    got = bm25.search(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), 10).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    want = {q: brute_bm25(documents, t or "", 10) for q, t in queries}
    assert {q: x for q, x in want.items() if x} == found


@pytest.mark.parametrize(("shard", "words"), [(7, 900), (16384, 900), (16384, 4 << 20)])
def test_bm25_pruning_changes_no_answer_and_opens_fewer_blocks(monkeypatch, shard, words):
    monkeypatch.setattr(bm25, "SHARD", shard)
    monkeypatch.setattr(bm25, "SHARD_WORDS", words)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    draw = random.Random(5)
    vocabulary = [f"t{int(draw.paretovariate(0.6)) % 400}" for _ in range(3000)]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60))) for _ in range(400)] + ["t1 " * 2000, None, ""]
    ids = [d // 2 if d < 40 else None if d == 200 else d for d in range(len(texts))]
    rows = [dict(zip(b.schema.names, (c[0].as_py() for c in b.columns), strict=True)) for b in bm25._index(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])]))]
    assert sum(r["documents"] for r in rows) == len(texts) and max(r["documents"] for r in rows) <= shard
    assert sum(r["words"] for r in rows) == sum(len((t or "").split()) for t in texts)
    asked = np.unique(np.array([bm25.term_of(w.encode()) for w in set(vocabulary)], np.uint64))
    idf = np.random.default_rng(2).uniform(0.01, 6, len(asked))
    opened = total = 0
    for r in rows:
        one = bm25._shard(r, asked, idf, 30.0)
        # Lists lie by term and document.
        assert len(one.docs) == len(one.shares) == one.ends[-1]
        for _ in range(20):
            terms = np.sort(draw.sample(range(len(asked)), draw.randint(1, 9)))
            (a, x), (b, y) = one._pruned(terms, 3), one._scored(terms, 3)
            assert one.ids[a].tolist() == one.ids[b].tolist() and x.tolist() == pytest.approx(y.tolist())
            assert 200 not in one.ids[a].tolist()
            cells = bm25.spans(one.term_cells[terms], one.term_cells[terms + 1])
            bound = np.bincount(one.cells[cells] % one.blocks, one.cell_max[cells], one.blocks)
            opened += int((bound >= (x[-1] if len(x) == 3 else 0)).sum())
            total += one.blocks
    # Small shards have few blocks to leave out.
    assert opened < total * (0.5 if words > 900 else 1)


def test_bm25_takes_queries_in_blocks(spark, monkeypatch):
    documents = spark.createDataFrame([(d, f"a b{d % 7} c{d % 11}") for d in range(80)] + [(None, "a")], "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"b{q % 7} c{q % 5} a a") for q in range(9)], "item_id long, text string")
    whole = bm25.search(documents, queries, 4).collect()
    monkeypatch.setattr(bm25, "QUERIES", 2)
    assert sorted(bm25.search(documents, queries, 4).collect()) == sorted(whole)
    monkeypatch.setattr(bm25, "QUERY_WORDS", 1)
    assert sorted(bm25.search(documents, queries, 4).collect()) == sorted(whole)


def test_bm25_on_empty_tables_and_repeated_rows(spark):
    documents = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "a", "x")], "doc_id long, text string, rank string")
    queries = spark.createDataFrame([(0, "a")], "item_id long, text string")
    assert [(r["doc_id"], r["rank"]) for r in bm25.search(documents, queries, 5).collect()] == [(1, 1)]
    assert bm25.search(documents.limit(0), queries, 5).count() == 0
    assert bm25.search(documents, queries.limit(0), 5).count() == 0
