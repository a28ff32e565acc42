"""A counterfactual-regularised toxicity classifier.

Features are presences of hashed words, their beginnings of 3 to 6 characters
and their last 4 and 5. Training takes at most ``PER_CLASS`` labelled rows of
each class, those with the smallest hash of doc_id, and one text of each (that
with the smallest hash, if rows repeat a doc_id); among them the ``KEPT``
features whose document frequencies differ most between the classes are kept,
with all identity terms. A logistic model is fitted to them whose loss also
holds ``penalty`` times the squared change of the score when the identity
terms of a labelled text are swapped for others of their row, by as many places
as a hash of the text tells, so that it is what is said of
a group and not the group's name that counts. The intercept is then shifted
from the balanced sample to the class shares of all labelled rows.

Scoring looks each distinct word of a whole text up and applies the sigmoid to
the sum of the weights of the features present.

Defined results: null and empty texts get the score of the intercept alone;
labels of one class only score that class, 0 or 1, everywhere, and no labels
score 0; conflicting labels of one doc_id count as toxic, null labels and null
doc_ids not at all; among features with equal evidence those with smaller
hashes are kept; repeated rows are scored alike; other columns are kept unless named like an added one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import checkpointed

PER_CLASS = 2000
KEPT = 4096
LEAST_TEXTS = 4
LEAST_Z = 3.5
CACHE_ENTRIES = 400_000
BATCH_BYTES = 64 << 20
_WORD = re.compile(r"\w+")

# Names of groups; a term is swapped for another one of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("immigrants", "refugees", "citizens", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("muslime", "christen", "juden"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
)
PLACE = {word: (row, k) for row in IDENTITY_TERMS for k, word in enumerate(row)}


def swapped(word: str, turn: int) -> str:
    """Another term of the word's row, each of them for some turn; other words stay."""
    if word not in PLACE:
        return word
    row, k = PLACE[word]
    return row[(k + 1 + turn % (len(row) - 1)) % len(row)]


def _hash(kind: str, part: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + part)


def word_features(word: str) -> list[int]:
    """The word, its beginnings and its endings; a name of a group is only itself."""
    out = [_hash("w", word)]
    if word not in PLACE:
        out += [_hash("b", word[:n]) for n in range(3, 7) if len(word) > n]
        out += [_hash("e", word[-n:]) for n in (4, 5) if len(word) > n]
    return out


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> np.ndarray:
    return np.unique(np.array([f for w in words for f in word_features(w)], np.uint64))


@dataclass
class Model:
    weights: dict[int, float]
    intercept: float

    def score(self, text: str | None, cache: dict[str, tuple[int, ...]]) -> float:
        words = words_of(text)
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = tuple(f for f in word_features(w) if f in self.weights)
        hit = {f for w in words for f in cache[w]}
        z = self.intercept + sum(self.weights[f] for f in sorted(hit))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain, other, toxic, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(plain, pa.binary()), pa.array(other, pa.binary()), pa.array(toxic, pa.int32())], names=["plain", "swapped", "toxic"])

        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            turn = xxhash.xxh3_64_intdigest(text or "") >> 8
            plain.append(features_of(words).tobytes())
            other.append(None if words.isdisjoint(PLACE) else features_of({swapped(w, turn) for w in words}).tobytes())
            toxic.append(label)
            size += len(plain[-1]) + len(other[-1] or b"")
            if size > BATCH_BYTES:
                yield out()
                plain, other, toxic, size = [], [], [], 0
        yield out()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts of the partition hold each feature."""
    for batch in batches:
        toxic = batch.column(1).to_pylist()
        sides = [[np.frombuffer(x, np.uint64) for x, y in zip(batch.column(0).to_pylist(), toxic, strict=True) if y == k] for k in (0, 1)]
        found = [np.unique(np.concatenate(s), return_counts=True) if s else (np.empty(0, np.uint64), np.empty(0, np.int64)) for s in sides]
        ids = np.concatenate([found[0][0], found[1][0]])
        n = [np.concatenate([found[0][1], np.zeros(len(found[1][0]), np.int64)]), np.concatenate([np.zeros(len(found[0][0]), np.int64), found[1][1]])]
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["feature", "neither", "toxic"])


def fit_weights(plain: list[np.ndarray], swapped: list[np.ndarray | None], toxic: np.ndarray, features: np.ndarray, penalty: float, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised logistic model, by Adam on all rows at once."""

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, col = [], []
        for k, x in enumerate(rows):
            at = np.searchsorted(features, x)
            at = at[features[np.minimum(at, len(features) - 1)] == x] if len(features) else at[:0]
            row.append(np.full(len(at), k))
            col.append(at)
        return np.concatenate([*row, np.empty(0, int)]).astype(int), np.concatenate([*col, np.empty(0, int)]).astype(int)

    n, d = len(plain), len(features)
    row, col = sparse(plain)
    pairs = [k for k, x in enumerate(swapped) if x is not None]
    own_row, own_col = sparse([plain[k] for k in pairs])
    cf_row, cf_col = sparse([swapped[k] for k in pairs])
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + b
        err = (1 / (1 + np.exp(-z)) - toxic) / n
        grad = np.bincount(col, err[row], d) + ridge * w / max(n, 1)
        if pairs:
            gap = 2 * penalty * (np.bincount(own_row, w[own_col], len(pairs)) - np.bincount(cf_row, w[cf_col], len(pairs))) / len(pairs)
            grad += np.bincount(own_col, gap[own_row], d) - np.bincount(cf_col, gap[cf_row], d)
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(documents: DataFrame, labels: DataFrame, penalty: float = 1.0, per_class: int = PER_CLASS) -> Model:
    """Learns from documents (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not share.get(0) or not share.get(1):
        return Model({}, 500.0 if share.get(1) else -500.0)
    # At most 2 * per_class rows, so the broadcast is bounded.
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.filter("toxic = 1").orderBy(*order).limit(per_class).unionByName(known.filter("toxic = 0").orderBy(*order).limit(per_class))
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("text", "toxic")
    rows = checkpointed(rows.mapInArrow(_featurise, "plain binary, swapped binary, toxic int"))
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return Model({}, 500.0 if size.get(1) else -500.0)
    sums = rows.select("plain", "toxic").mapInArrow(_frequencies, "feature long, neither long, toxic long").groupBy("feature").agg(F.sum("neither").alias("a"), F.sum("toxic").alias("b"))
    pooled = (F.col("a") + F.col("b") + 1) / (size[0] + size[1] + 2)
    z = F.abs(F.col("b") / size[1] - F.col("a") / size[0]) / F.sqrt(pooled * (1 - pooled) * (1 / size[0] + 1 / size[1]))
    best = sums.filter(F.col("a") + F.col("b") >= LEAST_TEXTS).select("feature", z.alias("z")).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(KEPT)
    chosen = np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64)
    features = np.unique(np.concatenate([chosen, np.array([_hash("w", x) for x in PLACE], np.uint64)]))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def few(x):
            return None if x is None else np.intersect1d(np.frombuffer(x, np.uint64), features).tobytes()

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([few(x) for x in batch.column(k).to_pylist()], pa.binary()) for k in (0, 1)] + [batch.column(2)], names=["plain", "swapped", "toxic"])

    got = rows.mapInArrow(narrow, rows.schema).collect()
    got = sorted(got, key=lambda r: (r["toxic"], bytes(r["plain"])))
    plain = [np.frombuffer(bytes(r["plain"]), np.uint64) for r in got]
    swapped = [None if r["swapped"] is None else np.frombuffer(bytes(r["swapped"]), np.uint64) for r in got]
    weights, intercept = fit_weights(plain, swapped, np.array([r["toxic"] for r in got], float), features, penalty)
    shift = np.log(share[1] / share[0]) - np.log(size[1] / size[0])
    return Model({int(f): float(w) for f, w in zip(features, weights, strict=True) if w}, float(intercept + shift))


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score and predicted."""
    keep = [f for f in documents.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in keep]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, cache = shared.value, {}
        for batch in batches:
            scores = np.array([fitted.score(x, cache) for x in batch.column(text).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return documents.mapInArrow(run, T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
