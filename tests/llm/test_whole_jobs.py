"""The registered jobs take whole tables, whole texts and all links."""

import random

import numpy as np
import pytest
from test_search import brute_bm25

from spanloom.llm import ann, html_text, ngram_join, queries


def test_whole_documents_are_queries(spark, tmp_path):
    draw = random.Random(8)
    vocabulary = [f"t{int(draw.paretovariate(0.7)) % 900}" for _ in range(4000)]
    rows = [(d, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([5, 60, 400])))) for d in range(120)]
    rows += [(130, None), (140, ""), (160, rows[20][1]), (180, "word " * 3000 + rows[40][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in sorted(queries.queries()["op3_bm25_documents"](spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    want = {d: brute_bm25(rows, t or "", 20) for d, t in rows if d % 20 == 0}
    assert {q: x for q, x in want.items() if x} == found


def test_all_links_are_counted(spark, tmp_path):
    draw = random.Random(9)
    base = [f"v{draw.randrange(10**6)}" for _ in range(60)]
    rows = [(d, " ".join([*base[:k], f"x{d}", *base[k + 1 :]])) for d in range(60) for k in [draw.randrange(60)]]
    rows += near_copies(draw, 100)
    rows += [(900, rows[7][1]), (901, rows[7][1].upper()), (902, None), (903, ""), (904, "one two"), rows[3]]
    spark.createDataFrame([*rows, (None, rows[5][1])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {d: set(ngram_join.shingle_set(t).tolist()) for d, t in rows}
    want = {d: sum(100 * len(s & x) >= 80 * len(s | x) for o, x in sets.items() if o != d and s and x) for d, s in sets.items()}
    got = queries.queries()["op5_ngram_join"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 1 and max(want.values()) > 20
    assert {r["doc_id"]: r["n_links"] for r in got} == {**want, None: 0}
    groups = ngram_join.jaccard_groups(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert {r["doc_id"]: r["component_id"] for r in groups} == {r["doc_id"]: r["component_id"] for r in got}


def near_copies(draw, first):
    for d in range(first, first + 40):
        if d % 8 == first % 8:
            words = [f"w{draw.randrange(400)}" for _ in range(draw.randint(20, 90))]
        copy = list(words)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(len(copy))] = "new"
        yield d, " ".join(copy)


LINE = "A line of the text that is as long as the lines of such pages are. "


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div><h1>Title</h1><p>lead</p><div class=body><p>{LINE * 9}</p></div></div>", ["Title", "lead", LINE * 9]),
        (f"<div><section><p>{LINE}</p></section><section><p>{LINE * 20}</p></section></div>", [LINE, LINE * 20]),
        (f"<main><p>{LINE * 3}</p><p>{LINE * 3}</p><article><p>{LINE}</p></article></main>", [LINE * 3, LINE * 3, LINE]),
        (f"<main><p>{LINE * 3}</p><p>{LINE * 3}</p></main><article><p>{LINE}</p></article>", [LINE * 3, LINE * 3, LINE]),
        (f"<body><article><p>{LINE}</p></article><article><p>{LINE * 2}</p></article><article><p>{LINE}</p></article></body>", [LINE, LINE * 2, LINE]),
        ("<nav>only this</nav>", []),
    ],
)
def test_the_main_text_is_whole(html, text):
    assert html_text.main_text(html) == "\n\n".join(" ".join(x.split()) for x in text)


@pytest.mark.parametrize("kind", ["one long", "skewed"])
def test_recall_does_not_depend_on_norms(spark, kind):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(10000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one long":
        x[7] *= 20
    else:
        x *= np.exp(draw.normal(size=(10000, 1)))
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.nearest(frame, frame.filter("vec_id % 50 = 0"), 20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    vectors, hits = x.astype(np.float32).astype(float), 0
    for q in range(0, 10000, 50):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(found.get(q, set()) & set(np.argsort(-scores)[:20].tolist()))
    print("RECALL", kind, hits / 4000)
    assert hits / 4000 >= 0.9
