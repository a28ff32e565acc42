"""The pipeline's stages against brute force on a small corpus, and its registration."""

import random

import corpus_pipeline as P
import pytest
from test_documents import brute_groups, brute_lines, water_fill

from spanloom.llm.components import connected_components

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(12)
    rows, labels = [], []
    for d in range(240):
        words = [f"word{draw.randrange(300)}" for _ in range(draw.randint(12, 60))]
        toxic = d % 6 == 1
        if toxic:
            words.insert(3, "nastyword")
        rows.append((d, " ".join(words), "en", f"src{d % 3}", 1))
        labels.append((d, 1, int(toxic)))
    rows += [(240 + k, rows[k][1] + f"\nan extra line {k} at the end", "en", "src0", 1) for k in (0, 2, 3)]
    rows += [(300, None, None, None, None), (301, "", "en", "src1", 0)]
    top = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top), rows


def test_stages_keep_columns_and_take_effect(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = P.drop_toxic(spark, docs, folder)
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and kept == {d for d, *_ in rows if not (d < 240 and d % 6 == 1)}
    lines = P.drop_repeated_lines(spark, clean, folder)
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert lines.columns == docs.columns and texts[240] == "an extra line 0 at the end" and texts[300] is None and texts[0] == rows[0][1]
    single = P.drop_near_copies(spark, docs, folder)
    want = {d: label for d, (_, label) in brute_groups([(r[0], r[1]) for r in rows]).items()}
    assert {r["doc_id"] for r in single.collect()} == {d for d, label in want.items() if label == d} and single.columns == docs.columns
    mixed = P.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns and mixed.filter("text IS NULL OR text = ''").count() == 0


def test_run_equals_its_stages_by_brute_force(spark, corpus):
    """Toxic rows by their planted word, lines and groups by brute force, the mix by its targets, ids by the decoded text."""
    folder, rows = corpus
    clean = [(d, t, s) for d, t, _, s, _ in rows if not (d < 240 and d % 6 == 1)]
    kept = {d: text for d, (_, _, text) in brute_lines([(d, t) for d, t, _ in clean]).items()}
    groups = brute_groups(list(kept.items()))
    left = {d: kept[d] for d, _, _ in clean if groups[d][1] == d}
    source = {d: s for d, _, s in clean}
    sizes, taken, tokens = {}, {}, {}
    for d, text in left.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(text.split())
    for r in P.run(spark, folder).collect():
        assert r["source"] == source[r["doc_id"]] and tokens.setdefault(r["doc_id"], list(r["ids"])) == list(r["ids"])
        taken[r["source"]] = taken.get(r["source"], 0) + len(left[r["doc_id"]].split())
    want = water_fill(sizes)
    assert all(abs(taken.get(s, 0) - x) <= 30 for s, x in want.items()), (taken, want)
    import public_tokenizers

    from spanloom.llm import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pieces = sorted(ranks, key=ranks.__getitem__)
    assert all(b"".join(pieces[i] for i in ids).decode() == left[d] for d, ids in tokens.items())


def test_stages_keep_odd_rows_and_further_columns(spark, tmp_path):
    text = "a text of several words that is of no harm"
    rows = [(1, text, "en", "a", 1, 0.5, "x")] * 3 + [(None, f"{text} {k}", None, None, None, 0.1, "y") for k in range(4)] + [(2, None, "en", "a", 0, None, None), (3, text + " " + "more " * 50_000, "en", "b", 1, 0.2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in P.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        got = sorted(map(str, found.collect()))
        if name != "mixing":
            assert got == sorted(map(str, docs.collect())), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    # Each of the equal rows is mixed by itself, as in the operator.
    copies = P.mixing.mix(docs).groupBy("doc_id").agg({"copies": "sum"}).collect()
    assert {r[0]: r[1] for r in copies if r[1]} == {r["doc_id"]: r["n"] for r in P.mix_sources(spark, docs, str(tmp_path)).groupBy("doc_id").agg(P.F.count("*").alias("n")).collect()}


def test_run_encodes_what_is_left(spark, corpus):
    out = P.run(spark, corpus[0]).collect()
    assert out and all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in out)
    assert not {r["doc_id"] for r in out} & {d for d in range(240) if d % 6 == 1}


def test_components_equal_union_find(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(400 + k, 401 + k) for k in range(40)] + [(600, 600 + k) for k in range(50)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
