"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

The examples are a bounded sample of labelled rows. Every word of theirs is a term; inverse document frequencies come from
all documents. A term's weight has a factor that grows with what its presence tells of the label, and is never zero. The
examples stand in blocks of like vectors; the posting list of a term has the greatest weight of each block. A text first
reads the short lists of its rare terms whole. What its common terms can add to an example is bounded twice: by the sum of
their block maxima, and by the product of the two vectors' norms over common terms. Only blocks with an example that can
still be among the K nearest are read, once for all texts of a batch that want them; the long lists are held without gaps,
so the cosines of the nearest are exact.

The neighbours vote with their similarity, against the share of toxic examples among those without any word. A fifth of
the sample gives no examples: a logistic curve through its votes and labels turns votes into calibrated scores. The
nearest ids are the evidence.

Defined results: null text is empty text; a text without a word of the examples gets that share; ties go to the smaller
example id; with no labelled rows the score is 0; null ids count as held out; repeated labels count once, and of rows with
one id one text is learned from; very long texts are read whole; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ensure_checkpoint_dir, id_remainder, text_of
from .quality import HELD_OUT, learning_rows

SAMPLE, CURVE_PART = 12_000, 5
PSEUDO, FLOOR = 5.0, 0.1
BLOCK, NEAREST, PROBED, COMMON = 64, 15, 4, 16
RUN = re.compile(r"[^\W\d_]+")
LETTERS = bytes(i if RUN.match(chr(i)) else 32 for i in range(256))  # of Latin-1, all else as spaces
TEXTS = 64  # that are scored together
SCHEMA = "score double, evidence array<long>"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; a text within Latin-1 is split through a table of its bytes, with the same words."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return RUN.findall(low)


def _present(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each word of a task's rows: how many have it, and how many of them are toxic."""
    a, b = Counter(), Counter()
    for part in parts:
        for label, text in zip(part["label"], part["text"], strict=True):
            words = set(words_of(text))
            b.update(words)
            if label:
                a.update(words)
    yield pd.DataFrame({"term": list(b), "a": [a[t] for t in b], "b": list(b.values())})


def _frequencies(docs: DataFrame, terms: list[str]) -> np.ndarray:
    """Number of documents with each term, summed in each part first."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {t: i for i, t in enumerate(shared.value)}
        counts: Counter = Counter()
        for part in parts:
            for text in part["text"]:
                counts.update(filter(place.__contains__, set(words_of(text))))
        yield pd.DataFrame({"term": np.fromiter(map(place.get, counts), np.int64, len(counts)), "n": np.fromiter(counts.values(), np.int64, len(counts))})

    found = text_of(docs).select("text").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def label_factor(a: np.ndarray, b: np.ndarray, prior: float) -> np.ndarray:
    """Divergence of the label's share among the b examples with a term, a of them toxic, from its share among all."""
    q = (a + PSEUDO * prior) / (b + PSEUDO)
    return FLOOR + q * np.log(q / prior) + (1 - q) * np.log((1 - q) / (1 - prior))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """terms with idf and factor, the examples (ids, labels and sparse unit vectors, in blocks of like vectors), calibration."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    learned = learning_rows(docs, labels, "toxic", sample).checkpoint()
    kept_back = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(CURVE_PART)) == 0
    rows = learned.where(~kept_back)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n = counts.get(1, 0), sum(counts.values())
    prior = (n1 + 0.0) / n if n else 0.0
    empty = {"terms": [], "idf": np.zeros(0), "factor": np.zeros(0), "ids": [], "labels": np.zeros(0), "vectors": np.zeros((0, 0), np.float32), "prior": prior, "rest": prior}
    if not n1 or n1 == n:
        return empty
    present = rows.select("label", "text").mapInPandas(_present, "term string, a double, b double").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow().sort_by("term")
    terms = present["term"].to_pylist()
    if not terms:
        return empty
    factor = label_factor(present["a"].to_numpy(), present["b"].to_numpy(), prior)
    idf = np.log((docs.count() + 1) / (_frequencies(docs, terms) + 1)) + 1e-6
    model = empty | {"terms": terms, "idf": idf, "factor": factor}
    shared = spark.sparkContext.broadcast({k: model[k] for k in ("terms", "idf", "factor")})

    @F.pandas_udf("places binary, weights binary")
    def weights(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectorise = Vectors(shared.value)
        for part in parts:
            yield pd.DataFrame([(i.astype(np.int32).tobytes(), w.astype(np.float32).tobytes()) for i, w in map(vectorise, part)], columns=["places", "weights"])

    found = rows.select("doc_id", "label", weights("text").alias("v")).select("doc_id", "label", "v.*").toArrow()
    ids, y = found["doc_id"].to_numpy(), found["label"].to_numpy().astype(float)
    vectors = [(np.frombuffer(i, np.int32), np.frombuffer(w, np.float32)) for i, w in zip(found["places"].to_pylist(), found["weights"].to_pylist(), strict=True)]
    full = np.array([len(i) > 0 for i, _ in vectors])
    rest = (y[~full].sum() + prior) / ((~full).sum() + 1)
    strongest = np.array([i[w.argmax()] if len(i) else -1 for i, w in vectors])
    order = np.lexsort((y, ids, strongest))
    order = order[full[order]]
    starts = np.concatenate([[0], np.cumsum([len(vectors[r][0]) for r in order])])
    packed = (starts, np.concatenate([vectors[r][0] for r in order]), np.concatenate([vectors[r][1] for r in order]))
    model |= {"ids": ids[order], "labels": y[order], "vectors": packed, "rest": float(rest)}
    return model | {"curve": calibrated(learned.where(kept_back), model)}


def calibrated(rows: DataFrame, model: dict) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from the votes for these rows to their labels."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def votes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = index_of(shared)
        for part in parts:
            yield pd.DataFrame({"label": part["label"], "vote": [vote for vote, _ in index.scores(part["text"])]})

    found = rows.select("label", "text").mapInPandas(votes, "label int, vote double").toArrow()
    return logistic(odds(found["vote"].to_numpy()), found["label"].to_numpy().astype(float))


def odds(vote: np.ndarray) -> np.ndarray:
    return np.log((vote + 1e-3) / (1 - vote + 1e-3))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope (above 0) and intercept by Newton's steps, drawn towards 1 and 0."""
    w, z = np.array([1.0, 0.0]), np.c_[x, np.ones(len(x))]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(2), z.T @ (p - y) + ridge * (w - [1.0, 0.0]))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 and np.isfinite(w).all() else (1.0, 0.0)


class Vectors:
    """Text to the terms and weights of a unit vector."""

    def __init__(self, model: dict):
        self.place = {t: i for i, t in enumerate(model["terms"])}
        self.weight = model["idf"] * model.get("factor", 1.0)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(words_of(text))
        items = np.fromiter(map(self.place.get, counts, repeat(-1)), np.int64, len(counts))
        tf = np.fromiter(counts.values(), float, len(counts))[items >= 0]
        items = items[items >= 0]
        w = (1 + np.log(tf)) * self.weight[items]
        return items, w / np.linalg.norm(w) if len(items) else w


def _sparse(dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts of the rows, terms, weights."""
    rows, terms = np.nonzero(dense)
    return np.searchsorted(rows, np.arange(len(dense) + 1)), terms, dense[rows, terms]


class BlockMaxIndex:
    """Exact nearest examples by cosine, from posting lists with a maximum for each block of examples."""

    def __init__(self, model: dict):
        self.vectorise, self.rest = Vectors(model), model["rest"]
        self.ids, self.labels = np.asarray(model["ids"]), model["labels"]
        vectors = model["vectors"]
        starts, terms, weights = vectors if isinstance(vectors, tuple) else _sparse(vectors)
        self.n, n_terms = len(starts) - 1, len(model["terms"])
        self.block_starts = np.arange(0, self.n, BLOCK)
        self.n_blocks = len(self.block_starts)
        rows = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(starts))
        common = np.bincount(terms, minlength=n_terms) * COMMON > self.n
        self.number = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)  # of a term among the common ones
        # the lists of common terms without gaps, block by block, and the greatest weight of each block
        long = common[terms]
        self.dense = np.zeros((int(common.sum()), self.n_blocks * BLOCK), np.float32)
        self.dense[self.number[terms[long]], rows[long]] = weights[long]
        self.blocks = np.ascontiguousarray(self.dense.reshape(-1, self.n_blocks, BLOCK).transpose(1, 0, 2))
        self.most, self.dense = self.blocks.max(axis=2).T.copy() if self.n_blocks else self.dense, None
        self.norm = np.sqrt(np.bincount(rows[long], weights[long].astype(float) ** 2, minlength=self.n))
        terms, rows, weights = terms[~long], rows[~long], weights[~long]
        order = np.argsort(terms, kind="stable")
        self.rows, self.weights = rows[order], weights[order]
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def _add(self, begin: np.ndarray, length: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What these stretches of postings add to the cosine of every example."""
        at = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
        return np.bincount(self.rows[at], self.weights[at] * np.repeat(weights, length), minlength=self.n)

    def candidates(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector all examples that can be among the k nearest, and their exact cosines.

        A block's lists are read once for all vectors that want the block.
        """
        sums, common = np.zeros((len(vectors), self.n)), np.zeros((len(vectors), len(self.most)), np.float32)
        for i, (terms, weights) in enumerate(vectors):
            numbers = self.number[terms]
            rare = numbers < 0
            short = terms[rare]
            sums[i] = self._add(self.first[short], self.first[short + 1] - self.first[short], weights[rare])
            common[i, numbers[~rare]] = weights[~rare]
        bound = np.minimum(np.repeat(common @ self.most, BLOCK, axis=1)[:, : self.n], np.linalg.norm(common, axis=1)[:, None] * self.norm.astype(np.float32))
        bound = sums + bound
        of_block = np.maximum.reduceat(bound, self.block_starts, axis=1)
        more = np.zeros((len(vectors), self.n_blocks, BLOCK), np.float32)

        def read(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(axis=0)):
                of = np.flatnonzero(wanted[:, block])
                more[of, block] = common[of] @ self.blocks[block]

        probed = np.argpartition(-of_block, min(PROBED, self.n_blocks) - 1, axis=1)[:, :PROBED]
        first = np.zeros(of_block.shape, bool)
        np.put_along_axis(first, probed, True, axis=1)
        read(first)
        least = np.zeros(len(vectors))
        places = self.block_starts[:, None] + np.arange(BLOCK)
        for i, blocks in enumerate(probed):
            rows = places[blocks].ravel()
            real = rows < self.n
            cosines = sums[i, rows[real]] + more[i, blocks].ravel()[real]
            if len(cosines) >= k:
                least[i] = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
        read((of_block >= least[:, None] - 1e-5) & ~first)
        more = more.reshape(len(vectors), -1)
        for i in range(len(vectors)):
            rows = np.flatnonzero(bound[i] >= least[i] - 1e-5)
            yield rows, sums[i, rows] + more[i, rows]

    def nearest(self, terms: list[int] | np.ndarray, weights: np.ndarray, k: int = NEAREST) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest."""
        terms, weights = np.asarray(terms, np.int64), np.asarray(weights, float)
        return next(self.nearest_each([(terms, weights)], k)) if len(terms) and self.n else []

    def nearest_each(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST) -> Iterator[list[tuple[float, int]]]:
        """For each vector with terms (cosine, example) of the k nearest."""
        for rows, cosines in self.candidates(vectors, k):
            floor = np.partition(cosines, len(cosines) - k)[len(cosines) - k] if len(cosines) > k else 0.0
            high = (cosines >= floor - 2e-6) & (cosines > 0)
            rows, cosines = rows[high], cosines[high]
            best = np.lexsort((self.ids[rows], -np.round(cosines, 6)))[:k]
            yield list(zip(cosines[best].tolist(), rows[best].tolist(), strict=True))

    def scores(self, texts: Iterable[str | None]) -> list[tuple[float, list[int]]]:
        """For each text the neighbours' similarity-weighted share of toxic labels, and the ids of the nearest."""
        vectors = [self.vectorise(t) for t in texts]
        out = [(self.rest, [])] * len(vectors)
        told = [i for i, (terms, _) in enumerate(vectors) if len(terms)] if self.n else []
        for at in range(0, len(told), TEXTS):
            part = told[at : at + TEXTS]
            for i, near in zip(part, self.nearest_each([vectors[i] for i in part]), strict=True):
                votes = sum(c * self.labels[x] for c, x in near)
                out[i] = float((votes + 0.5 * self.rest) / (sum(c for c, _ in near) + 0.5)), [int(self.ids[x]) for _, x in near[:3]]
        return out


def index_of(shared) -> BlockMaxIndex:
    """One index for each Python worker and broadcast model."""
    model = shared.value
    if "index" not in model:
        model["index"] = BlockMaxIndex(model)
        model["vectors"] = model["terms"] = None
    return model["index"]


def scorer(spark: SparkSession, model: dict):
    shared = spark.sparkContext.broadcast(model)
    slope, intercept = model.get("curve", (1.0, 0.0))

    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = index_of(shared)
        for part in parts:
            out = pd.DataFrame(index.scores(part), columns=["score", "evidence"])
            bent = 1 / (1 + np.exp(-(slope * odds(out["score"].to_numpy()) + intercept)))
            yield out.assign(score=np.where(out["evidence"].map(len) > 0, bent, out["score"]))

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence."""
    mod, out = HELD_OUT
    scored = text_of(docs).select("doc_id", scorer(docs.sparkSession, model)("text").alias("_s"))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), mod) == out).alias("held_out"), "_s.score", (F.col("_s.score") >= 0.5).cast("int").alias("predicted"), "_s.evidence")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
