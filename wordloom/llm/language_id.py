"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Texts are lower-cased, white space becomes single spaces, and n-grams of one
to three characters are hashed into :data:`BUCKETS` counts. Document
frequencies cover all training documents. Weights are fitted by
follow-the-regularised-leader with elastic-net penalties (per coordinate
rates; the L1 part makes them sparse) on a bounded sample of training rows,
:data:`PER_LANGUAGE` of each language by id hash and at most
:data:`MAX_SAMPLE` in all. A fifth of the sample is kept from fitting and sets
the temperature that calibrates the probabilities.

Every whole text is then scored where it lies, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import hash_share, in_arrow, map_batches
from wordloom.llm.words import texts_of

UNKNOWN = "und"
BUCKETS = 1 << 15
PER_LANGUAGE = 300
MAX_SAMPLE = 4_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.002
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in the whole text, ascending, and their counts."""
    c = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = np.zeros(BUCKETS, dtype=np.int64)
    h = np.zeros(len(c), dtype=np.uint32)
    for n in range(3):
        if len(c) <= n:
            break
        h = (h[:len(c) - n] + c[n:]) * _MIX[n]
        h ^= h >> np.uint32(15)
        total += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray      # buckets x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; ``und`` and
        0 for null, for a text without a letter, and without any training."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, n = ngram_counts(text)
        z = (self.vector(at, n) @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def is_held_out(id_col: Column) -> Column:
    """The fixed third of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts (one column) hold each bucket, and their number."""
    def run(batches):
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for b in batches:
            for t in texts_of(b.column(0)).to_pylist():
                df[ngram_counts(t)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])
    sums = in_arrow(texts, run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, n = np.zeros(BUCKETS), 0
    for r in sums.collect():        # BUCKETS + 1 rows at most
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, n


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes) and bias by FTRL-proximal over sparse rows
    ``(buckets, values)``, in a fixed shuffled order."""
    z = np.zeros((BUCKETS + 1, k))
    n = np.zeros((BUCKETS + 1, k))

    def weight(at):
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2)
        return np.where(np.abs(za) > L1, w, 0.0)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = weight(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = np.outer(x, p)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weight(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        s = logits / math.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean()) + 1e-4 * t * t
    a, b, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns only from text and non-null language of rows outside the
    held-out third."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .filter(~is_held_out(F.col("id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_SAMPLE).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(BUCKETS), 1.0)
    df, n = document_frequency(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    each = max(1, min(PER_LANGUAGE, MAX_SAMPLE // len(languages)))
    shares = docs.sparkSession.createDataFrame([(g, 1.3 * each / n) for g, n in sizes.items()], "l string, share double")
    hashed = rows.select("id", "lang", F.xxhash64("id", F.lit("lid")).alias("h")) \
        .join(F.broadcast(shares), F.col("lang") == F.col("l")).filter(hash_share(F.col("h")) < F.col("share")) \
        .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).filter(F.col("k") <= each)
    # MAX_SAMPLE rows at most
    chosen = F.broadcast(hashed.select(F.col("id").alias("i"), F.col("lang").alias("l"), "k").distinct())
    sample = rows.join(chosen, (F.col("id") == F.col("i")) & (F.col("lang") == F.col("l"))).select("text", "lang", "k")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [ngram_counts(t) for t in texts_of(b.column(0)).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [b.column(1), b.column(2), pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())),
             pa.array([c.astype(np.int32) for _, c in got], pa.list_(pa.int32()))], ["lang", "k", "at", "n"])

    got = map_batches(sample, run, "lang string, k int, at array<int>, n array<int>").orderBy("lang", "k").toArrow()
    model = Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), idf, 1.0)
    at, counts = got["at"].combine_chunks(), got["n"].combine_chunks()
    vectors = []
    for i in range(len(got)):
        a = at[i].values.to_numpy()
        vectors.append((a.copy(), model.vector(a, counts[i].values.to_numpy()).astype(np.float32)))
    y = np.array([languages.index(v) for v in got["lang"].to_pylist()], dtype=np.int64)
    apart = got["k"].to_numpy() % 5 == 0
    del got, at, counts
    fit = np.flatnonzero(~apart)
    model.weights, model.bias = fit_ftrl([vectors[i] for i in fit], y[fit], len(languages))
    test = np.flatnonzero(apart)
    logits = np.array([vectors[i][1] @ model.weights[vectors[i][0]] + model.bias for i in test]).reshape(len(test), -1)
    model.temperature = fit_temperature(logits, y[test])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` for every row; only the text
    decides. Repeated rows come out as often as they came in."""
    bc = docs.sparkSession.sparkContext.broadcast(model)    # buckets x languages

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [bc.value.predict(t) for t in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()),
             pa.array([g[1] for g in got], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("id"), is_held_out(F.col(id_col)).alias("held_out"),
                                  F.col(text_col).alias("text")), run,
                      f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or less likely than
    ``min_score``; no shuffle."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            got = [bc.value.predict(t) for t in b.column(place).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in got], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
