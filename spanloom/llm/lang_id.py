"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 characters of the lower-cased text, runs
of non-letters as one space) of every labelled row into ``BUCKETS`` buckets
per language; the log probabilities form a languages x buckets matrix, which
is broadcast. Its size depends on neither rows nor texts, only on the number of
languages; a table with more than ``MOST_LANGUAGES`` of them, 256 MB, is
refused. Scoring makes a sparse count row per text, gathers the rows of a batch
into one sparse matrix and multiplies it with the dense one in numpy.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text if nothing was learned. Ties go to the first language in
code point order. A null language is not learned from. Empty tables, repeated
rows, null ids and further columns are fine; long texts are counted whole, and
the piece in which they are counted does not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 15
SMOOTHING = 0.5
PIECE = 1 << 20
MOST_LANGUAGES = 1024
#: Languages that a task counts before it passes their counts on: 16 MB.
HELD_LANGUAGES = 64
#: Terms of a sparse product that are held at once: 32 MB.
PRODUCT = 1 << 22
_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the text's 1- to 3-grams."""
    plain = " " + _OTHER.sub(" ", text.lower()) + " "
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(plain), PIECE):
        # Two characters more, for the n-grams that start in this piece and end in the next one.
        c = np.frombuffer(plain[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[1:] >> 7)) * np.uint32(0x85EBCA77)
        three = (two[:-1] ^ (one[2:] >> 11)) * np.uint32(0xC2B2AE3D)
        total += np.bincount(np.concatenate([one[:PIECE], two[:PIECE], three]) >> 17, minlength=BUCKETS)
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (language, bucket, n) of what the partition saw; bucket -1 counts rows."""
    seen: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            columns = [[lang] * (len(at) + 1), np.append(at, -1), np.append(counts[at], rows[lang])]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["lang", "bucket", "n"])
        seen.clear()
        rows.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if has_letter(text):
                if lang not in seen and len(seen) == HELD_LANGUAGES:
                    yield from out()
                seen[lang] = seen.get(lang, 0) + ngram_counts(text)
                rows[lang] = rows.get(lang, 0) + 1
    yield from out()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities by bucket and language) of all rows whose language is known."""
    known = labelled.select(text, lang).filter(labelled[lang].isNotNull())
    many = known.select(lang).distinct().limit(MOST_LANGUAGES + 1).count()
    if many > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(sums.column("lang").to_pylist(), object)
    langs = sorted(set(names), key=lambda x: x.encode())
    at = {x: k for k, x in enumerate(langs)}
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[sums.column("bucket").to_numpy(), [at[x] for x in names]] = sums.column("n").to_numpy()
    rows, counts = counts[-1], counts[:-1] + SMOOTHING
    return langs, np.log(rows / rows.sum()) if langs else rows, np.log(counts / counts.sum(axis=0)) if langs else counts


def log_scores(texts: list[str], prior: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A row per text, each with a letter, of unnormalised log probabilities: one sparse product for many texts."""
    out, buckets, counts, starts, held = [], [], [], [], 0

    def product() -> np.ndarray:
        weighted = matrix[np.concatenate(buckets)] * np.concatenate(counts)[:, None]
        return prior + np.add.reduceat(weighted, starts, axis=0)

    for text in texts:
        own = ngram_counts(text)
        at = np.flatnonzero(own)
        buckets.append(at)
        counts.append(own[at])
        starts.append(held)
        held += len(at)
        if held * matrix.shape[1] > PRODUCT:
            out.append(product())
            buckets, counts, starts, held = [], [], [], 0
    if held:
        out.append(product())
    return np.concatenate(out) if out else np.empty((0, len(prior)))


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """Adds lang_pred and score, the posterior probability of the predicted language."""
    keep = [f for f in documents.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in keep]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, matrix = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            known = [k for k, x in enumerate(texts) if langs and has_letter(x)]
            found, scores = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                logs = log_scores([texts[k] for k in known], prior, matrix)
                best = logs.argmax(axis=1)
                scores[known] = 1 / np.exp(logs - logs[np.arange(len(best)), best][:, None]).sum(axis=1)
                for k, b in zip(known, best.tolist(), strict=True):
                    found[k] = langs[b]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return documents.mapInArrow(run, T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
