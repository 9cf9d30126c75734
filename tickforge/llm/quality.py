"""Quality classifier: random-indexing word vectors pooled per document and a two-layer network in numpy.

A word's index vector is sparse and ternary, seeded by its hash. Its vector is that plus the normalized sum of
the index vectors of its neighbours over the labelled texts, so no matrix is factored. Words outside the
vocabulary take the vector of their class (lower case, title, upper case, digits, signs); adjacent equal words
count as a word of their own. A document is the mean of its words' vectors; a hidden layer and a logistic
output are trained with Adam, and one temperature, fitted on labelled rows kept out of training, calibrates the
probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .worker import begin, bound_batches, trim

#: Bounds of the fit: labelled rows, their text bytes (longer texts take no part in it), words of the vocabulary.
FIT_ROWS, FIT_TEXT_BYTES, VOCABULARY = 4000, 30_000, 6000
DIMENSIONS, NONZERO, WINDOW, HIDDEN = 96, 8, 2, 48
THRESHOLD = 0.7
SEED = 7
EPOCHS, BATCH, RATE, DECAY = 60, 64, 0.003, 1e-4
#: Strings between white space whose words are kept in a worker's memo; it is emptied when full.
MEMO = 200_000
WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall
CLASSES = ["<lower>", "<title>", "<upper>", "<digits>", "<signs>", "<same>", "<near>"]


def _class(word: str) -> int:
    if word[0].isalpha():
        return 0 if word.islower() else 2 if len(word) > 1 and word.isupper() else 1 if word[0].isupper() else 0
    return 3 if word.isdigit() else 4


def index_vector(word: str) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(word.encode()))
    v = np.zeros(DIMENSIONS, np.float32)
    v[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return v / np.sqrt(NONZERO)


class Vectors:
    """Vocabulary and word vectors."""

    def __init__(self, texts: list[str]):
        count = Counter()
        for t in texts:
            count.update(WORDS(t))
        words = [w for w, n in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 2]
        self.ids = {w: i + len(CLASSES) for i, w in enumerate(words)}
        index = np.stack([index_vector(w) for w in CLASSES + words])
        context = np.zeros_like(index)
        self.memo: dict[str, tuple[int, ...]] = {}
        ids = [self.lookup(t.split()) for t in texts]
        for k in range(1, WINDOW + 1):
            near = [x for x in ids if len(x) > k]
            left, right = np.concatenate([np.empty(0, np.int64), *[x[:-k] for x in near]]), np.concatenate([np.empty(0, np.int64), *[x[k:] for x in near]])
            for d in range(DIMENSIONS):
                context[:, d] += np.bincount(left, index[right, d], len(index)) + np.bincount(right, index[left, d], len(index))
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        self.vectors = index + context / np.maximum(norm, 1e-6)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def lookup(self, strings: list[str]) -> np.ndarray:
        """Ids of the words in strings without white space."""
        memo = self.memo
        found = list(map(memo.get, strings))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    s = strings[k]
                    found[k] = ids = memo.get(s) or tuple(self.ids[w] if w in self.ids else _class(w) for w in WORDS(s))
                    if len(s) < 48:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[s] = ids
        return np.fromiter(chain.from_iterable(found), np.int64)

    def pool(self, texts: list[str]) -> np.ndarray:
        """Mean vectors of documents, with the logarithm of the number of words."""
        out = np.zeros((len(texts), DIMENSIONS + 1), np.float32)
        size = len(self.vectors)
        for at in range(0, len(texts), 64):
            part = texts[at:at + 64]
            counts = np.zeros((len(part), size), np.float32)
            for r, t in enumerate(part):
                strings = t.split()
                if strings:
                    counts[r] = np.bincount(self.lookup(strings), minlength=size)
                    counts[r, 5] = sum(map(eq, strings[1:], strings))
                    counts[r, 6] = sum(map(eq, strings[2:], strings))
            n = counts.sum(1, keepdims=True)
            out[at:at + 64, :-1] = counts @ self.vectors / np.maximum(n, 1)
            out[at:at + 64, -1:] = np.log1p(n) / 10
        return out


class QualityModel:
    """Vectors, network and temperature; scores are the same for equal texts."""

    def __init__(self, texts: list[str], labels: list[int], tune: list[bool]):
        y, tune = np.array(labels, np.float32), np.array(tune, bool)
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        self.vectors = None
        if not 0 < y.sum() < len(y):
            return  # one class or none: every text gets the smoothed share of label 1
        self.vectors = Vectors([t for t, k in zip(texts, tune) if not k] or texts)
        x = self.vectors.pool(texts)
        fit = ~tune if 0 < y[~tune].sum() < (~tune).sum() else np.ones(len(y), bool)
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        self._train((x[fit] - self.mean) / self.scale, y[fit])
        self.temperature = 1.0
        if tune.any():
            z, grid = self._logits(x[tune]), np.geomspace(0.5, 8, 61)
            loss = [np.mean(np.logaddexp(0, np.where(y[tune] > 0, -1, 1) * z / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _train(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                r = order[at:at + BATCH]
                h = np.tanh(x[r] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[r]) / len(r)
                back = d[:, None] * p[2] * (1 - h * h)
                grads = [x[r].T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], d.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = p

    def _logits(self, x: np.ndarray) -> np.ndarray:
        p = self.layers
        return np.tanh((x - self.mean) / self.scale @ p[0] + p[1]) @ p[2] + p[3]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logits(self.vectors.pool(texts)) / self.temperature, -500, 500)))


def held_out(id_col) -> F.Column:
    """Rows that never take part in a fit: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model from at most FIT_ROWS labelled rows that aren't held out, the first by a hash of the id.

    Labels that are null are no labels; of several labels of an id the smallest counts, of several texts the first
    in order. Texts over FIT_TEXT_BYTES and null ids take no part in the fit, but are scored. A quarter of the rows, by CRC-32 of
    the id, sets the temperature.
    """
    key = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id")))
    key = key.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(FIT_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= FIT_TEXT_BYTES)
    rows = rows.join(F.broadcast(key), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))  # FIT_ROWS rows at most
    found = rows.toPandas().sort_values(["id", "text"])
    tune = [zlib.crc32(str(i).encode()) % 4 == 3 for i in found["id"]]
    return QualityModel(found["text"].tolist(), found["label"].tolist(), tune)


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns id_col (and those of keep), held_out, score and predicted for every row of docs.

    A null text counts as empty and gets the score of an empty text. Rows with null or repeated ids are scored
    like others (a null id is not held out); an empty table gives no rows. Texts of any length are scored whole. A
    column of keep that has the name of one given out here is left out.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY and DIMENSIONS
    columns = [id_col, *[c for c in keep or [] if c not in (id_col, "held_out", "score", "predicted")]]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    inner = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("__text"))

    def run(batches):
        begin("quality")
        for batch in batches:
            texts = batch.column(len(columns))
            scores = []
            for at in range(0, len(texts), 256):
                scores.append(shared.value.score([t or "" for t in texts.slice(at, 256).to_pylist()]))
            if scores:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores), pa.float64())], names=[*columns, "score"])
            trim()

    out = inner.mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in columns) + ", score double")
    return out.select(*[F.col(f"`{c}`") for c in columns], held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
