"""Toxicity by a classifier chain that ends with the labelled category.

The first categories grade the labelled one by its markers, stems that the
training rows tie to the label: ``severe``, ``repeated`` and ``present`` are
toxic documents with at least four, two and one different markers.  Their linear
models see stems (beginnings of words); the last, ``toxic`` itself, sees whole
words and the probabilities of the categories before it.  So the chain carries
over what whole words don't show, such as an unseen form of a known stem.

In training the probabilities come from models that have not seen the document
(out-of-fold): a fold's models know neither its rows nor features or markers
chosen with them.  In scoring they come from the earlier categories' final
models.  The verdict is the last probability against a threshold that has the
best out-of-fold F1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid.llm import common, kernels

#: Labelled documents that training takes, by hash of the id; features of each kind the models see; folds.
SAMPLE, WORDS, FOLDS = 6000, 512, 5
#: Bytes of the beginnings of words that are stems; a shorter word is its own stem.
PREFIXES = (4, 5, 6, 7, 8)
#: Distinct markers of each derived category, first to last, and the lift and count that make a stem a marker.
GRADES = {"severe": 4, "repeated": 2, "present": 1}
LAST = "toxic"
LIFT, LEAST = 4.0, 8
#: Least chi-squared between a feature and the label for the models to see it: chance reaches it once in about 3,000 features.
GAIN = 13.0

_APART = kernels.SPACE.copy()
_APART[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: The lowest bit of a feature's hash tells stems from words.
_ODD = np.uint64(1)


@dataclass
class Chain:
    """Sorted feature hashes and, for each category, weights of the features and of the earlier probabilities, and a bias."""

    categories: list[str]
    words: np.ndarray
    weights: np.ndarray
    links: np.ndarray
    bias: np.ndarray
    #: Probability of the last category from which a document counts as such.
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all categories of rows of feature presence."""
        p = np.zeros((len(x), len(self.categories)), dtype=np.float64)
        linear = x @ self.weights.T
        for j in range(len(self.categories)):
            p[:, j] = _sigmoid(linear[:, j] + p[:, :j] @ self.links[j, :j] + self.bias[j])
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words of all texts (even) and of their stems of PREFIXES bytes (odd; 0: none of this size), and each text's first word.

    Texts are lower-cased and cut at white space and ASCII punctuation.  A word
    below the least size of a stem is its own stem, too.
    """
    data, at = kernels.buffers(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, first = kernels.runs(~_APART[data], at)
    size = ends - starts
    whole = kernels.hash_runs(data, starts, ends)
    out = [whole & ~_ODD]
    for k in PREFIXES:
        h = np.zeros(len(starts), dtype=np.uint64)
        longer = size >= k
        h[longer] = (kernels.hash_runs(data, starts[longer], starts[longer] + k) + np.uint64(k)) | _ODD
        if k == PREFIXES[0]:
            h[~longer] = whole[~longer] | _ODD
        out.append(h)
    return out, first


def stems(words: np.ndarray) -> np.ndarray:
    """Which feature hashes are stems'."""
    return (words & _ODD) > 0


def word_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct feature hashes of each text."""
    hashes, first = features(column)
    for i in range(len(first) - 1):
        yield np.unique(np.concatenate([h[first[i] : first[i + 1]] for h in hashes]))


def presence(sets: Sequence[np.ndarray], words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sets), len(words)), dtype=np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(words, s)
        at = at[at < len(words)][words[at[at < len(words)]] == s[at < len(words)]]
        x[i, at] = 1
    return x


def _fit(x: np.ndarray, p: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 3e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by accelerated gradient descent on scaled columns: weights of x, of p, and the bias."""
    n, d = x.shape
    if not n or y.min() == y.max():
        return np.zeros(d), np.zeros(p.shape[1]), 20.0 if n and y.min() == 1 else -20.0
    rate = x.mean(axis=0, dtype=np.float64)
    # a rare word counts as much as a common one
    scale = np.concatenate([1 / np.sqrt(rate * (1 - rate) + 0.01), np.ones(p.shape[1]) * 4])
    z = np.concatenate([(x - rate.astype(np.float32)) * scale[:d].astype(np.float32), (p - p.mean(axis=0)) * scale[d:]], axis=1, dtype=np.float32)
    step = 4 / float(np.linalg.norm(z[:, :] @ _leading(z)) ** 2 / n + 1)
    w = np.zeros(z.shape[1] + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    v = w.copy()
    for t in range(1, steps + 1):
        err = _sigmoid(z @ v[:-1].astype(np.float32) + v[-1]) - y
        grad = np.append(err.astype(np.float32) @ z, err.sum()) / n
        grad[:-1] += ridge * v[:-1]
        new = v - step * grad
        v, w = new + (t - 1) / (t + 2) * (new - w), new
    out = w[:-1] * scale
    return out[:d], out[d:], float(w[-1] - out[:d] @ rate - out[d:] @ p.mean(axis=0))


def _leading(z: np.ndarray) -> np.ndarray:
    """The direction in which the rows spread most, by power iteration."""
    v = np.ones(z.shape[1], dtype=np.float32) / np.sqrt(max(1, z.shape[1]))
    for _ in range(12):
        v = (z @ v) @ z
        v /= max(float(np.linalg.norm(v)), 1e-12)
    return v


def markers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each word is a marker: far commoner in positive rows."""
    pos, neg = x[y == 1].sum(axis=0), x[y == 0].sum(axis=0)
    lift = ((pos + 0.5) / ((y == 1).sum() + 1)) / ((neg + 0.5) / ((y == 0).sum() + 1))
    return (lift >= LIFT) & (pos >= LEAST)


def learn(x: np.ndarray, toxic: np.ndarray, folds: np.ndarray, words: np.ndarray, allowed: np.ndarray | None = None) -> Chain:
    """The chain from presence of features, labels and each row's fold.

    ``allowed`` (FOLDS + 1 rows) tells which features were chosen without each
    fold, last the ones chosen from all rows; by default all are.
    """
    names = [*GRADES, LAST]
    y = toxic.astype(np.int64)
    k, n = len(names), len(y)
    allowed = np.ones((FOLDS + 1, len(words)), dtype=bool) if allowed is None else allowed
    stem = stems(words)
    chain = Chain(names, words, np.zeros((k, len(words))), np.zeros((k, k)), np.zeros(k))
    oof = np.zeros((n, k))
    everything = np.ones(n, dtype=bool)
    # what is known without each fold, and with all of them: features and the rows' numbers of markers
    known = []
    for f in range(FOLDS + 1):
        seen = folds != f if f < FOLDS else everything
        own = allowed[f] & stem
        own[own] = markers(x[seen][:, own], y[seen]) if seen.any() else False
        known.append((seen, x @ own.astype(np.float32) if n else np.zeros(0)))
    for j, name in enumerate(names):
        for f, (seen, hits) in enumerate(known):
            use = np.flatnonzero(allowed[f] & (stem if name != LAST else ~stem))
            target = y if name == LAST else y * (hits >= GRADES[name])
            w, c, b = _fit(x[seen][:, use], oof[seen, :j], target[seen])
            if f < FOLDS:
                oof[~seen, j] = _sigmoid(x[~seen][:, use] @ w + oof[~seen, :j] @ c + b)
            else:
                chain.weights[j, use], chain.links[j, :j], chain.bias[j] = w, c, b
    chain.threshold = cut(oof[:, -1], y)
    return chain


def cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 on out-of-fold probabilities, midway to the next lower one, within 0.1 and 0.9; 0.5 without positives."""
    if not y.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.flatnonzero(f1 == f1.max())[-1])
    below = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float(np.clip((p[order[best]] + below) / 2, 0.1, 0.9))


def telling_words(rows: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the features that tell most, and which of them do so without each fold and (last) over all rows.

    rows: (y, fold, words), the latter all feature hashes of a document.  Of
    words and of stems, the ``words`` first by chi-squared are taken: how far a
    feature's count among positive rows is from what its total suggests.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, f, w in zip(b.column("y").to_pylist(), b.column("fold").to_pylist(), b.column("words").to_pylist(), strict=True):
                own = np.frombuffer(w, np.int64)
                yield pa.RecordBatch.from_pydict({"word": pa.array(own), "fold": pa.array(np.full(len(own), f, np.int32)), "y": pa.array(np.full(len(own), y, np.int32))})

    size = {r["fold"]: (r["n"], r["p"]) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()}
    all_n, all_p = (sum(v[i] for v in size.values()) for i in (0, 1))
    totals = [(all_n - size.get(f, (0, 0))[0], all_p - size.get(f, (0, 0))[1]) for f in range(FOLDS)] + [(all_n, all_p)]
    none = np.zeros(0, np.uint64), np.zeros((FOLDS + 1, 0), bool)
    if not any(0 < p < n for n, p in totals):
        return none
    counts = [F.sum(F.when(F.col("fold") != f, F.lit(1)).otherwise(0)).alias(f"n{f}") for f in range(FOLDS + 1)]
    counts += [F.sum(F.when(F.col("fold") != f, F.col("y")).otherwise(0)).alias(f"p{f}") for f in range(FOLDS + 1)]
    counted = rows.select("y", "fold", "words").mapInArrow(each, "word long, fold int, y int").groupBy("word").agg(*counts)
    gains = []
    for f, (n, p) in enumerate(totals):
        rate = p / n if n else 0.0
        own, hit = F.col(f"n{f}"), F.col(f"p{f}")
        gain = F.when((own >= 4) & F.lit(0 < p < n), F.pow(hit - rate * own, 2) / (own * (rate * (1 - rate) or 1.0)))
        gains.append(F.struct(F.lit(f).alias("f"), gain.alias("gain")))
    told = counted.select("word", F.explode(F.array(*gains)).alias("g")).select("word", "g.f", "g.gain").where(F.col("gain") >= GAIN)
    rank = F.row_number().over(Window.partitionBy("f", F.col("word").bitwiseAND(F.lit(1))).orderBy(F.col("gain").desc(), "word"))
    # no more than 2 * (FOLDS + 1) * words rows
    best = [(r["word"], r["f"]) for r in told.withColumn("rank", rank).where(F.col("rank") <= words).select("word", "f").collect()]
    if not best:
        return none
    found, where = np.unique(np.array([w for w, _ in best], dtype=np.int64).view(np.uint64), return_inverse=True)
    allowed = np.zeros((FOLDS + 1, len(found)), dtype=bool)
    allowed[[f for _, f in best], where] = True
    return found, allowed


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Chain:
    """Trains on at most ``sample`` labelled documents, those whose ids hash lowest; folds go by hash too.

    Features are counted by the cluster; the driver gets the telling ones and
    which of them each sampled document has, at most
    2 * (FOLDS + 1) * WORDS places for each, whatever its length.

    Labels without id or label are left out; an id labelled more than once is
    toxic if any label says so, and a positive label of any size counts as 1.
    Repeated rows of an id train once (one of them, if their texts differ).
    Null and empty texts train as documents without features.  Without labels,
    or with one class only, the chain knows no features and calls nothing toxic
    (everything, if all are).  Other columns are not read.
    """
    key = F.xxhash64("id", F.lit("fold"))
    # an id labelled more than once is toxic if any label says so
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(sample)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in kernels.pieces(b, "text"):
                yield pa.RecordBatch.from_pydict({"id": p.column("id"), "y": p.column("y"), "fold": p.column("fold"), "words": pa.array([s.tobytes() for s in word_sets(p.column("text"))], pa.binary())})

    # no more than `sample` rows are broadcast
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    kind = dict(base.dtypes)["id"]
    # repeated rows train once
    rows = base.select("id", "text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"), F.pmod(key, F.lit(FOLDS)).cast("int").alias("fold")).dropDuplicates(["id"])
    seen = common.materialize(rows.mapInArrow(scan, f"id {kind}, y int, fold int, words binary"), "labelled")
    words, allowed = telling_words(seen)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.flatnonzero(presence([np.frombuffer(w, np.uint64)], words)[0]).astype(np.int32) for w in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("id", "y", "fold")} | {"at": pa.array([v.tobytes() for v in x], pa.binary())})

    got = sorted(seen.mapInArrow(find, f"id {kind}, y int, fold int, at binary").collect(), key=lambda r: r["id"])
    x = np.zeros((len(got), len(words)), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(bytes(r["at"]), np.int32)] = 1
    return learn(x, np.array([r["y"] for r in got], dtype=np.int64), np.array([r["fold"] for r in got], dtype=np.int64), words, allowed)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """(id, a probability of each category, toxic) per row; toxic tells whether the last probability reaches the threshold (the chain's own by default).

    Whole texts are read.  Null and empty texts have no words and get the
    models' probabilities of that.  Null ids, ties and repeated rows are carried
    through; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            for p in kernels.pieces(b, "text"):
                hashes, first = features(p.column("text"))
                x = np.zeros((p.num_rows, len(c.words)), dtype=np.float32)
                owner = np.repeat(np.arange(p.num_rows), np.diff(first))
                for h in hashes if len(c.words) else ():
                    where = np.minimum(np.searchsorted(c.words, h), len(c.words) - 1)
                    hit = c.words[where] == h
                    x[owner[hit], where[hit]] = 1
                prob = c.score(x)
                yield pa.RecordBatch.from_pydict({"id": p.column("id")} | {n: pa.array(prob[:, j]) for j, n in enumerate(names)})

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = ", ".join([f"id {dict(base.dtypes)['id']}", *(f"{n} double" for n in names)])
    return base.mapInArrow(scan, shape).select(F.col("id").alias(id_col), *names, (F.col(names[-1]) >= F.lit(chain.threshold if threshold is None else threshold)).alias("toxic"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
