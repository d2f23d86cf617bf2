"""Quality classifier by co-training of a text view and a metadata view.

The text view sees only the text: shares of character-class trigrams (lower,
upper, digit, space, line end, stop, shout, symbol, other) and a few measures
of repetition and length. The metadata view sees only source, language and the
recorded number of characters. Both are ridge logistic regressions.

Each is fitted on labelled rows. In every round each view scores a pool of
unlabelled rows, and the rows it is most confident of join the training set of
the other view. A view passes on only rows as confident as those it is right
about on labelled rows kept apart (at least :data:`SURE` of them, and more
often than chance allows), so that a view without information stays silent. In
the end both views are calibrated and combined by a logistic regression on the
rows kept apart, and the combination scores all documents.

Two targets are co-trained so: quality, and not being toxic. The text view of
toxicity sees words: how large a part of the whole text's words is a given word
or starts with given letters. In every round those words and word starts are
chosen anew that stand, once or twice or more, in toxic rows more often than
chance allows (exact binomial tail, Bonferroni over all of them); rows count by
their label or pseudo-label. Candidates are those that labels alone make likely
(:data:`CANDIDATE_RISK`), found by sums in Spark. A document is good where it is of quality and not
toxic: its score is the lesser of both probabilities. Labels that bear out no
word leave toxicity out.

Fitting uses a bounded sample: :data:`LABELLED_ROWS` of toxic, of bad and of
good labelled rows, and :data:`POOL_ROWS` unlabelled ones, all by id hash. Rows
are weighted back to the counts of all labels.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import hash_share, in_arrow, map_batches, remove, written

LABELLED_ROWS = {"toxic": 1_200, "bad": 1_200, "good": 1_600}
POOL_ROWS = 4_000
ROUNDS = 4
PER_ROUND = 300
SURE = 0.98
CHANCE = 0.001              # of a view without information passing rows on, per round and label
RIDGE = 1.0
KEEP = 0.5
CLASSES = 9
DENSE = 12
TEXT_SIZE = CLASSES ** 3 + DENSE
SOURCES, LANGUAGES, SIZES = 64, 32, 24
META_SIZE = SOURCES + LANGUAGES + SIZES
WORD = re.compile(r"\w+")
STARTS = range(3, 8)        # lengths of word starts, in characters
CANDIDATE_RISK = 0.01       # per word, by labels alone; pseudo-labels may bear such words out
WORD_RISK = 0.01            # of taking any word for toxic by chance

_CLASS = np.full(0x250, 8, dtype=np.uint8)
for _c in range(0x250):
    _s = chr(_c)
    _CLASS[_c] = (0 if _s.islower() else 1 if _s.isupper() else 2 if _s.isdigit() else 4 if _s in "\n\r" else
                  3 if _s.isspace() else 5 if _s in ".,;:'\"()-" else 6 if _s in "!?" else 7 if _s in "#*$%&|<>@^~_=+\\/{}[]" else 8)


def _hash(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass"))


def pieces_of(word: str) -> list[int]:
    """Hashes of a word and of its starts; the upper half is that of the
    shortest start, so words that share none are told apart by it alone."""
    head = _hash(word[:STARTS[0]]) >> 1 << 32
    return [head | _hash(word + " "), *[head | _hash(word[:n]) for n in STARTS if n <= len(word)]]


def share_measure(count: np.ndarray, words: int) -> np.ndarray:
    """What ``count`` of a text's words counts for; short texts count less."""
    return np.log1p(100 * count / (words + 50))


def word_pieces(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a whole text's words and word starts, ascending, how often
    each occurs, and the number of words."""
    words = Counter(WORD.findall((text or "").lower()))
    found = [(p, k) for w, k in words.items() for p in pieces_of(w)]
    at, of = np.unique(np.array([p for p, _ in found], dtype=np.int64), return_inverse=True)
    count = np.bincount(of.reshape(-1), [k for _, k in found], minlength=len(at)) if found else np.zeros(0)
    return at, count.astype(np.int32), words.total()


def piece_shares(texts: list[str | None], chosen: np.ndarray) -> np.ndarray:
    """One row per whole text, one column per chosen piece."""
    x = np.zeros((len(texts), len(chosen)), dtype=np.float32)
    place = {p: j for j, p in enumerate(chosen.tolist())}
    heads = {p >> 32 for p in place}
    known: dict[str, bool] = {}
    for i, text in enumerate(texts):
        words = WORD.findall((text or "").lower())
        for w in words:
            head = w[:STARTS[0]]
            if head not in known:
                known[head] = _hash(head) >> 1 in heads
            if known[head]:
                for p in pieces_of(w):
                    if p in place:
                        x[i, place[p]] += 1
        x[i] = share_measure(x[i], len(words))
    return x


def text_measures(text: str | None) -> np.ndarray:
    """Measures of one whole text; null counts as empty."""
    text = text or ""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cls = _CLASS[np.minimum(code, 0x24F)].astype(np.int64)
    x = np.zeros(TEXT_SIZE, dtype=np.float32)
    if len(cls) >= 3:
        tri = np.bincount((cls[:-2] * CLASSES + cls[1:-1]) * CLASSES + cls[2:], minlength=CLASSES ** 3)
        x[:CLASSES ** 3] = np.sqrt(tri / tri.sum())
    words = text.split()
    lines = [s for s in text.split("\n") if s.strip()]
    n = max(1, len(words))
    share = np.bincount(cls, minlength=CLASSES) / max(1, len(cls))
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    pairs = list(zip(words, words[1:]))
    x[CLASSES ** 3:] = [np.log1p(len(words)) / 10, min(3.0, sum(map(len, words)) / n / 10), len(set(words)) / n, repeats,
                        1 - len(set(pairs)) / max(1, len(pairs)), 1 - len(set(lines)) / max(1, len(lines)),
                        share[1], share[2], share[6] * 5, share[7] * 5, share[4] * 5, min(3.0, len(lines) / n * 5)]
    return x


def meta_features(source, lang, n_chars) -> np.ndarray:
    """Features of one row's metadata; nulls have places of their own."""
    x = np.zeros(META_SIZE, dtype=np.float32)
    x[0 if source is None else 1 + crc32(str(source).encode()) % (SOURCES - 1)] = 1
    x[SOURCES + (0 if lang is None else 1 + crc32(str(lang).encode()) % (LANGUAGES - 1))] = 1
    x[SOURCES + LANGUAGES + (0 if n_chars is None else min(SIZES - 1, 1 + int(np.log2(max(0, n_chars) + 1))))] = 1
    return x


@dataclass
class Logistic:
    """A ridge logistic regression with the scaling of its inputs."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 12) -> Logistic:
    """Newton steps on the weighted, ridge-penalised log loss."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    a = np.ones((len(x), x.shape[1] + 1), dtype=np.float32)
    np.divide(x - mean, scale, out=a[:, :-1], casting="same_kind")
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w.astype(np.float32), -30, 30).astype(np.float64)))
        grad = a.T @ (weight * (p - y)) + penalty * w
        root = np.sqrt(weight * np.maximum(p * (1 - p), 1e-6)).astype(np.float32)
        b = a * root[:, None]
        h = (b.T @ b).astype(np.float64) + np.diag(penalty)
        step = np.linalg.solve(h, grad)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def binomial_tail(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(X >= k) of a binomial distribution, exact."""
    log_factorial = np.append(0, np.cumsum(np.log(np.arange(1, n.max(initial=0) + 1))))

    def one(k: int, n: int) -> float:
        i = np.arange(k, n + 1)
        logs = log_factorial[n] - log_factorial[i] - log_factorial[n - i] + i * np.log(p) + (n - i) * np.log1p(-p)
        return float(np.exp(logs).sum())
    known: dict[tuple[int, int], float] = {}
    return np.array([known[c] if c in known else known.setdefault(c, one(*c)) for c in zip(k.tolist(), n.tolist())])


class Evidence:
    """The words and word starts of sampled texts: an entry per row and
    distinct piece."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray, int]], total: int | None = None):
        """``total``: how many different pieces the texts hold, where only
        candidates are given."""
        self.rows = len(pieces)
        sizes = [len(at) for at, _, _ in pieces]
        self.hashes, piece = np.unique(np.concatenate([np.zeros(0, np.int64), *[at for at, _, _ in pieces]]), return_inverse=True)
        self.total = len(self.hashes) if total is None else total
        self.piece = piece.reshape(-1).astype(np.int32)
        self.row = np.repeat(np.arange(self.rows, dtype=np.int32), sizes)
        self.count = np.concatenate([np.zeros(0, np.int32), *[k for _, k, _ in pieces]])
        self.words = np.array([n for _, _, n in pieces], dtype=np.int64)

    def choose(self, rows: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """Places of the pieces that stand, at least once or at least twice,
        in bad rows more often than chance allows."""
        label = np.full(self.rows, -1, dtype=np.int8)
        label[rows] = bad
        share = label[label >= 0].mean()
        if not 0 < share < 1:
            return np.zeros(0, dtype=np.int64)
        of = label[self.row]
        found = []
        for times in (1, 2):
            seen = (of >= 0) & (self.count >= times)
            n = np.bincount(self.piece[seen], minlength=len(self.hashes))
            k = np.bincount(self.piece[seen & (of == 1)], minlength=len(self.hashes))
            able = np.flatnonzero((k > share * n) & (k > 1))
            found.append(able[binomial_tail(k[able], n[able], share) * 2 * self.total <= WORD_RISK])
        return np.unique(np.concatenate(found))

    def shares(self, chosen: np.ndarray) -> np.ndarray:
        """As :func:`piece_shares` of the sampled texts."""
        column = np.full(len(self.hashes), -1, dtype=np.int64)
        column[chosen] = np.arange(len(chosen))
        at = np.flatnonzero(column[self.piece] >= 0) if len(chosen) else np.zeros(0, dtype=np.int64)
        x = np.zeros((self.rows, len(chosen)), dtype=np.float32)
        x[self.row[at], column[self.piece[at]]] = share_measure(self.count[at], self.words[self.row[at]])
        return x


@dataclass
class Model:
    """The fitted views of one target, their calibrations and the combination;
    ``constant`` is the probability of every row where labels do not hold both
    classes. ``pieces``: the words and word starts that end the text view.
    ``toxic``: the model of not being toxic beside one of quality."""
    constant: float | None
    text: Logistic | None = None
    meta: Logistic | None = None
    text_scale: Logistic | None = None
    meta_scale: Logistic | None = None
    both: Logistic | None = None
    passed: tuple[int, int] = (0, 0)    # pseudo-labels given by the text and by the metadata view
    pieces: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    toxic: Model | None = None

    def score(self, x_text: np.ndarray, x_meta: np.ndarray) -> np.ndarray:
        """Probability of the target."""
        if self.constant is not None:
            return np.full(len(x_text), self.constant)
        views = np.column_stack([self.text_scale.logit(self.text.logit(x_text)[:, None]),
                                 self.meta_scale.logit(self.meta.logit(x_meta)[:, None])])
        return probability(self.both.logit(views))


def sure_from(p: np.ndarray, right: np.ndarray, weight: np.ndarray) -> float:
    """The least probability from which on rows kept apart are right as often
    as :data:`SURE`, and more often than chance allows; infinite without any."""
    if right.all():
        return np.inf
    order = np.argsort(-p, kind="stable")
    p, right, weight = p[order], right[order], weight[order]
    ends = np.append(p[1:] != p[:-1], True)
    share = np.cumsum(weight * right) / np.cumsum(weight)
    able = np.flatnonzero(ends & (share >= SURE))
    tail = binomial_tail(np.cumsum(right)[able].astype(np.int64), able + 1, float(right.mean()))
    able = able[tail <= CHANCE]
    return float(p[able[-1]]) if len(able) else np.inf


def co_train(x: list[np.ndarray], y: np.ndarray, weight: np.ndarray, pool: list[np.ndarray],
             evidence: Evidence | None = None) -> Model:
    """``x`` and ``pool``: (text view, metadata view) of labelled and
    unlabelled rows. Every third labelled row is kept apart for calibration.
    ``evidence``: the words of the labelled and then of the unlabelled rows."""
    apart = np.arange(len(y)) % 3 == 2
    if min(y[apart].sum(), (1 - y[apart]).sum(), y[~apart].sum(), (1 - y[~apart]).sum()) < 1:
        return Model(float((y * weight).sum() / weight.sum()))
    rows = [np.vstack(v) for v in zip(x, pool)]
    kept, unknown = np.flatnonzero(apart), np.arange(len(y), len(rows[0]))
    # per view: training rows, labels, weights
    sets = [[np.flatnonzero(~apart), y[~apart].astype(float), weight[~apart]] for _ in x]
    free = [np.ones(len(unknown), dtype=bool) for _ in x]
    passed = [0, 0]
    base = float((y * weight).sum() / weight.sum())

    def fitted() -> tuple[list[np.ndarray], list[tuple[Logistic, Logistic]], np.ndarray]:
        """Both views' inputs, fits and calibrations, and the chosen pieces."""
        chosen, seen = np.zeros(0, dtype=np.int64), rows
        if evidence is not None:
            chosen = evidence.choose(np.concatenate([s[0] for s in sets]), 1 - np.concatenate([s[1] for s in sets]))
            seen = [np.hstack([rows[0], evidence.shares(chosen)]), rows[1]]
        views = []
        for v, (at, labels, weights) in enumerate(sets):
            model = fit_logistic(seen[v][at], labels, weights)
            views.append((model, fit_logistic(model.logit(seen[v][kept])[:, None], y[apart], weight[apart], ridge=0.1)))
        return seen, views, chosen

    seen, views, chosen = fitted()
    for _ in range(ROUNDS):
        given = 0
        for v in (0, 1):
            other = 1 - v
            model, scale = views[v]
            known, p = (probability(scale.logit(model.logit(seen[v][at])[:, None])) for at in (kept, unknown))
            for label, of_known, sure, share in ((1.0, known, p, base), (0.0, 1 - known, 1 - p, 1 - base)):
                cut = sure_from(of_known, (y[apart] == label).astype(float), weight[apart])
                able = np.flatnonzero(free[v] & (sure >= cut))
                best = able[np.argsort(-sure[able], kind="stable")][:max(1, int(PER_ROUND * share))]
                free[v][best] = False
                s = sets[other]
                sets[other] = [np.append(s[0], unknown[best]), np.append(s[1], np.full(len(best), label)),
                               np.append(s[2], np.full(len(best), weight.mean()))]
                passed[v] += len(best)
                given += len(best)
        if not given:
            break
        seen, views, chosen = fitted()
    logits = np.column_stack([views[v][1].logit(views[v][0].logit(seen[v][kept])[:, None]) for v in (0, 1)])
    both = fit_logistic(logits, y[apart], weight[apart], ridge=0.1)
    return Model(None, views[0][0], views[1][0], views[0][1], views[1][1], both, tuple(passed),
                 np.zeros(0, dtype=np.int64) if evidence is None else evidence.hashes[chosen])


def views_of(text: list, source: list, lang: list, size: list) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([text_measures(t) for t in text], dtype=np.float32).reshape(len(text), TEXT_SIZE),
            np.array([meta_features(*m) for m in zip(source, lang, size)], dtype=np.float32).reshape(len(text), META_SIZE))


def candidate_pieces(told: DataFrame, share: float) -> tuple[np.ndarray, int]:
    """Of the pieces (column ``p``, counts ``k``) of labelled rows (column
    ``toxic``, 0 or 1) those that stand in toxic rows, once or twice or more,
    so much more often than their ``share`` that the binomial tail is below
    :data:`CANDIDATE_RISK` (Chernoff bound); and the number of all pieces."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at, count = (b.column(i).flatten().to_numpy() for i in (0, 1))
            bad = np.repeat(b.column(2).to_numpy(), [len(v) for v in b.column(0)])
            piece, of = np.unique(at, return_inverse=True)
            sums = [np.bincount(of.reshape(-1)[seen], minlength=len(piece)) for seen in
                    (count >= 1, (count >= 1) & (bad == 1), count >= 2, (count >= 2) & (bad == 1))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (piece, *sums)], ["piece", "n1", "k1", "n2", "k2"])

    sums = in_arrow(told.select("p", "k", "toxic"), run, "piece bigint, n1 bigint, k1 bigint, n2 bigint, k2 bigint") \
        .groupBy("piece").agg(*[F.sum(c).alias(c) for c in ("n1", "k1", "n2", "k2")])
    sums = written(told.sparkSession, sums, "pieces")

    def clear(n: str, k: str):
        n, k = F.col(n), F.col(k)
        part = k / n
        rest = F.when(k < n, (n - k) * F.log((1 - part) / (1 - share))).otherwise(0.0)
        return (k > 1) & (part > share) & (k * F.log(part / share) + rest >= -np.log(CANDIDATE_RISK))

    # pieces of a bounded sample of rows
    chosen = sums.filter(clear("n1", "k1") | clear("n2", "k2")).select("piece").toArrow()["piece"].to_numpy()
    total = sums.count()
    remove(told.sparkSession, sums)
    return np.sort(chosen), total


def judge(model: Model, text: list, source: list, lang: list, size: list, toxicity: bool = True) -> np.ndarray:
    """Scores of rows: the probability of quality or, with ``toxicity``, the
    lesser one of quality and of not being toxic."""
    x_text, x_meta = views_of(text, source, lang, size)
    p = model.score(x_text, x_meta)
    if toxicity and model.toxic is not None:
        p = np.minimum(p, model.toxic.score(piece_shares(text, model.toxic.pieces), x_meta))
    return p


def _columns(b: pa.RecordBatch, at: list[int]) -> list[list]:
    return [b.column(i).to_pylist() for i in at]


VIEW_COLUMNS = ("text", "source", "lang", "n_chars")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality",
          columns: tuple[str, str, str, str] = VIEW_COLUMNS, toxic_col: str = "toxic") -> Model:
    """Fits on documents with a label (the mean of repeated ones, 0.5 or more
    is good, or toxic; labels other than 0 and 1 are not used). Without labels
    of both classes every row's quality is the share of good labels, or 1
    without any. Labels may lack the column ``toxic_col``."""
    toxic = F.col(toxic_col) if toxic_col in labels.columns else F.lit(None).cast("int")
    label = labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("q"), toxic.alias("x")).filter("q in (0, 1)") \
        .groupBy("id").agg((F.avg("q") >= 0.5).cast("int").alias("good"),
                           (F.avg(F.when(F.col("x").isin(0, 1), F.col("x"))) >= 0.5).cast("int").alias("toxic"))
    ids = docs.select(F.col(id_col).alias("id")).filter("id is not null")
    marked = ids.join(label, "id", "left").withColumn("h", F.xxhash64("id", F.lit("quality")))
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("good") == 1, "good").when(F.col("good") == 0, "bad").otherwise("none")
    marked = marked.withColumn("kind", kind)
    totals = {r["kind"]: r["count"] for r in marked.groupBy("kind").count().collect()}
    limits = LABELLED_ROWS | {"none": POOL_ROWS}
    below, limit = F.lit(0.0), F.lit(0)
    for k, n in limits.items():
        below = F.when(F.col("kind") == k, 1.3 * n / max(1, totals.get(k, 0))).otherwise(below)
        limit = F.when(F.col("kind") == k, n).otherwise(limit)
    chosen = marked.filter(hash_share(F.col("h")) < below) \
        .withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("h", "id"))).filter(F.col("k") <= limit)
    # LABELLED_ROWS and POOL_ROWS at most
    small = F.broadcast(chosen.select(F.col("id").alias("i"), "good", "toxic", "kind", "h").dropDuplicates(["i"]))
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)]) \
        .join(small, F.col("id") == F.col("i")).select("good", "toxic", "kind", "h", *[f"v{i}" for i in range(4)])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        given = _columns(b, [4, 5, 6, 7])
        xt, xm = views_of(*given)
        pieces = [word_pieces(t) for t in given[0]]
        return pa.RecordBatch.from_arrays(
            [*b.columns[:4], pa.array(list(xt), pa.list_(pa.float32())), pa.array(list(xm), pa.list_(pa.float32())),
             pa.array([p for p, _, _ in pieces], pa.list_(pa.int64())), pa.array([k for _, k, _ in pieces], pa.list_(pa.int32())),
             pa.array([n for _, _, n in pieces], pa.int64())], ["good", "toxic", "kind", "h", "t", "m", "p", "k", "n"])

    schema = "good int, toxic int, kind string, h bigint, t array<float>, m array<float>, p array<bigint>, k array<int>, n bigint"
    spark = docs.sparkSession
    sample = written(spark, map_batches(rows, run, schema).withColumn("r", F.monotonically_increasing_id()), "sample")
    got = sample.drop("p", "k").toArrow()
    if not len(got):
        remove(spark, sample)
        return Model(1.0)
    got = got.take(np.argsort(got["h"].to_numpy(), kind="stable"))
    good, bad_words = (np.array([-1 if g is None else g for g in got[c].to_pylist()], dtype=np.int64) for c in ("good", "toxic"))
    view = [np.asarray(got[c].combine_chunks().values, dtype=np.float32).reshape(len(good), -1) for c in ("t", "m")]
    kinds = got["kind"].to_pylist()
    in_sample = Counter(kinds)
    weight = np.array([totals[k] / in_sample[k] for k in kinds])
    known = good >= 0
    if not known.any():
        return Model(1.0)

    def fit(known: np.ndarray, y: np.ndarray, x: list[np.ndarray], evidence: Evidence | None = None) -> Model:
        return co_train([v[known] for v in x], y[known].astype(float), weight[known] / weight[known].mean(),
                        [v[~known] for v in x], evidence)

    model = fit(known, good, view)
    told = bad_words >= 0
    if 0 < (bad_words == 1).sum() < told.sum():
        candidates, total = candidate_pieces(sample.filter("toxic is not null"), float((bad_words == 1).sum() / told.sum()))
        bc = spark.sparkContext.broadcast(candidates)

        def held(b: pa.RecordBatch) -> pa.RecordBatch:
            at = [v.values.to_numpy() for v in b.column(1)]
            seen = [np.isin(v, bc.value) for v in at]
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([v[w] for v, w in zip(at, seen)], pa.list_(pa.int64())),
                 pa.array([v.values.to_numpy()[w] for v, w in zip(b.column(2), seen)], pa.list_(pa.int32()))], ["r", "p", "k"])

        found = map_batches(sample.select("r", "p", "k"), held, "r bigint, p array<bigint>, k array<int>").toArrow()
        place = {r: i for i, r in enumerate(found["r"].to_pylist())}
        p, k = (found[c].combine_chunks() for c in ("p", "k"))
        words, at = got["n"].to_pylist(), [place[r] for r in got["r"].to_pylist()]
        order = np.append(np.flatnonzero(told), np.flatnonzero(~told)).tolist()
        evidence = Evidence([(p[at[i]].values.to_numpy(), k[at[i]].values.to_numpy(), words[i]) for i in order], total)
        toxic = fit(told, 1 - bad_words, [np.zeros((len(good), 0), dtype=np.float32), view[1]], evidence)
        if toxic.constant is None and len(toxic.pieces):
            model.toxic = toxic
    remove(spark, sample)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          columns: tuple[str, str, str, str] = VIEW_COLUMNS, keep: float = KEEP, toxicity: bool = False) -> DataFrame:
    """``(id, quality_score, kept)`` for every row, by quality alone or, with
    ``toxicity``, by quality without toxicity; nulls in any column are values
    like others. No shuffle."""
    bc = docs.sparkSession.sparkContext.broadcast(model)     # some thousand numbers

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = judge(bc.value, *_columns(b, [1, 2, 3, 4]), toxicity)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(s >= keep)],
                                          ["id", "quality_score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    return map_batches(src, run, f"id {kind}, quality_score double, kept boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, columns: tuple[str, str, str, str] = VIEW_COLUMNS,
              keep: float = KEEP) -> DataFrame:
    """``docs`` without the rows that score below ``keep`` by quality without
    toxicity; no shuffle."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in columns]

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(judge(bc.value, *_columns(b, at)) >= keep)) if b.num_rows else b

    return in_arrow(docs, run, docs.schema)
