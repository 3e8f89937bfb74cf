"""Language ID by word-first backoff.

The model is learned from about `SAMPLE` labelled documents of each language, all where there are fewer, chosen by a hash.
All lower-cased letter runs of theirs, and all character n-grams with word marks, are known, however rare. A known word is
scored by its log frequency in each language; any other by the longest n-grams that are known, from five letters down to
one. Each word gives a bounded log posterior over the languages, and a document sums its words.

The model is sent to all tasks while it has no more than `ENTRIES` entries; with so many languages, or so long texts, that it has
more, words meet it in joins, with the same results. Only the list of languages is always held on the driver.

Defined results: null text, or text without a letter, gives `und` with score 0, as does a corpus from which nothing
can be learned; ties go to the language first in code-point order; rows with null language are not learned from;
null ids count as remainder 0; repeated rows count and are scored one by one; very long texts are read whole; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ensure_checkpoint_dir, id_remainder, row_of, slim_worker

RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
ENTRIES = 1_500_000
SAMPLE = 1500
NGRAM = 5
FLOOR = -8.0
HELD_OUT = (3, 1)
SCHEMA = "lang_pred string, score double"


def words_of(token: str) -> list[str]:
    low = token.lower()
    if low.isalpha() or (low := low.strip(".,;:!?|*$%&#\"'()[]")).isalpha():
        return [low]
    return [w for w in RUN.findall(low) if any(map(str.isalpha, w))]


def _count(limit: int):
    def run(batches):
        slim_worker()
        counts: Counter = Counter()

        def flush():
            words: Counter = Counter()
            for (lang, token), n in counts.items():
                for w in words_of(token):
                    words[lang, w] += n
            counts.clear()
            keys = list(words)
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.string()), pa.array([words[k] for k in part], pa.int64())], names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.update((lang, t) for t in text.split())
                if len(counts) > limit:
                    yield from flush()
        yield from flush()

    return run


def learning_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, text of about `sample` labelled rows a language: those whose hash is below the share that this is of them all.

    A row's hash is that of its id and text, so repeated rows count and are taken together.
    """
    mod, out = HELD_OUT
    rows = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & (id_remainder(docs["doc_id"], mod) != out)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("_id"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("_n"))  # a row for each language
    place = F.pmod(F.xxhash64("_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.join(F.broadcast(sizes), "lang").where(place * F.col("_n") < sample).select("lang", "text")


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n over rows of lang, text."""
    return rows.mapInArrow(_count(200_000), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def model_tables(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """cells (level, gram, lang, n), level 0 for words; wholes (level, lang, whole): the sums of n."""
    ensure_checkpoint_dir(docs.sparkSession)
    words = word_counts(learning_rows(docs, sample)).checkpoint()
    marked = words.select("lang", F.concat(F.lit("<"), "word", F.lit(">")).alias("w"), "n")
    place = F.length("w") + 1 - F.col("level")
    levels = marked.select("lang", "w", "n", F.explode(F.sequence(F.lit(1), F.lit(NGRAM))).alias("level")).where(place >= 1)
    wholes = levels.groupBy("level", "lang").agg(F.sum(F.col("n") * place).alias("whole")).unionByName(words.groupBy("lang").agg(F.sum("n").alias("whole")).withColumn("level", F.lit(0))).checkpoint()
    grams = levels.select("lang", "level", "n", "w", F.explode(F.sequence(F.lit(1), place)).alias("i")).groupBy("level", F.expr("substring(w, i, level)").alias("gram"), "lang").agg(F.sum("n").alias("n"))
    both = words.select(F.lit(0).alias("level"), F.col("word").alias("gram"), "lang", "n").unionByName(grams)
    return both.checkpoint(), wholes


def fit(docs: DataFrame, entries: int = ENTRIES, sample: int = SAMPLE) -> dict:
    """The model: languages, grams per level (0 words, 1 to 5 n-grams), and a matrix of their log frequencies; or its tables."""
    cells, wholes = model_tables(docs, sample)
    whole = {(r["level"], r["lang"]): r["whole"] for r in wholes.collect()}
    langs = sorted(lang for level, lang in whole if level == 0)
    if not langs:
        return {"langs": [], "grams": [], "matrix": np.zeros((1, 0), np.float32)}
    if cells.count() > entries:
        return {"langs": langs, "cells": cells, "wholes": whole}
    found = cells.toArrow()
    level, n = found["level"].to_numpy(), found["n"].to_numpy()
    lang = np.searchsorted(np.array(langs, object), np.array(found["lang"].to_pylist(), object))
    grams, parts = [], []
    for i in range(NGRAM + 1):
        mask = level == i
        coded = found["gram"].filter(pa.array(mask)).combine_chunks().dictionary_encode()
        seen = np.zeros((len(coded.dictionary), len(langs)))
        seen[coded.indices.to_numpy(), lang[mask]] = n[mask]
        grams.append(coded.dictionary.to_pylist())
        parts.append(np.log((seen + 0.5) / np.array([max(whole.get((i, x), 1), 1) for x in langs], float)).astype(np.float32))
    return {"langs": langs, "grams": grams, "matrix": np.concatenate([*parts, np.zeros((1, len(langs)), np.float32)])}


class Scorer:
    """Scores texts in batches and holds the vectors of tokens seen, up to a bound.

    All grams of the model are rows of one matrix. A word is the mean of the rows that its level gives; the words that
    a batch brings anew are worked out together.
    """

    LIMIT = 120_000

    def __init__(self, model: dict):
        self.langs, self.matrix, self.grams, n = model["langs"], model["matrix"], [], 0
        for table in model["grams"]:
            self.grams.append(dict(zip(table, range(n, n + len(table)), strict=True)))
            n += len(table)
        self.rows: dict[str, int] = {}
        self.vectors, self.words = np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int32)

    def known(self, word: str) -> list[int]:
        """Rows of the word, or of its longest n-grams that the model has; else the row of zeros."""
        if (row := self.grams[0].get(word)) is not None:
            return [row]
        marked = f"<{word}>"
        for n in range(min(NGRAM, len(marked)), 0, -1):
            get = self.grams[n].get
            if found := [x for i in range(len(marked) - n + 1) if (x := get(marked[i : i + n])) is not None]:
                return found
        return [len(self.matrix) - 1]

    def learn(self, tokens: list[str]) -> None:
        grams, sizes, owners, counts = [], [], [], []
        for i, token in enumerate(tokens):
            found = words_of(token)
            counts.append(len(found))
            for w in found:
                grams += (k := self.known(w))
                sizes.append(len(k))
                owners.append(i)
        new = np.zeros((len(tokens), len(self.langs)), np.float32)
        if sizes:
            firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            v = np.add.reduceat(self.matrix[grams], firsts, axis=0) / np.array(sizes, np.float32)[:, None]
            v -= v.max(axis=1, keepdims=True)
            v = np.maximum(v - np.log(np.exp(v).sum(axis=1, keepdims=True)), FLOOR)
            np.add.at(new, owners, v)
        n = len(self.rows)
        self.rows.update(zip(tokens, range(n, n + len(tokens)), strict=True))
        self.vectors, self.words = np.concatenate([self.vectors[:n], new]), np.concatenate([self.words[:n], np.array(counts, np.int32)])

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For a few hundred texts at a time."""
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.rows) > self.LIMIT:
            self.rows.clear()
        split = [(t or "").split() for t in texts]
        if missing := set().union(*split).difference(self.rows):
            self.learn(sorted(missing))
        out = []
        for tokens in split:
            ids = np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))
            n = int(self.words[ids].sum())
            if not n:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.vectors[ids].sum(axis=0, dtype=np.float64) / math.sqrt(n)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def scorer(model: dict):
    """Pandas UDF from text to (lang_pred, score)."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        held = model.get("scorer")
        if held is None:
            slim_worker()
            held = model["scorer"] = Scorer(model)
            model["grams"] = []
            slim_worker()
        for part in parts:
            rows = [x for i in range(0, len(part), 500) for x in held.score(part.iloc[i : i + 500].tolist())]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return run


def _words(batches):
    """id, word, n for the distinct words of each text; a row with a null word stands for each text."""
    for b in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
        rows = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows.append((i, None, 0))
            rows += ((i, w, n) for w, n in Counter(w for t in (text or "").split() for w in words_of(t)).items())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["id", "word", "n"])


def word_vectors(words: DataFrame, model: dict) -> DataFrame:
    """word, v: its bounded log posterior over the languages, from joins with the model's tables."""
    langs, cells = F.array(*map(F.lit, model["langs"])), model["cells"]
    wholes = F.array(*(F.array(*(F.lit(float(max(model["wholes"].get((i, x), 1), 1))) for x in model["langs"])) for i in range(NGRAM + 1)))
    logs = F.transform(langs, lambda x, i: F.log((F.coalesce(F.try_element_at("seen", x), F.lit(0)) + 0.5) / F.get(F.get(wholes, F.col("level")), i)))
    rows = cells.groupBy("level", "gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("seen")).select("level", "gram", logs.alias("v"))
    known = words.join(rows.where("level = 0").select(F.col("gram").alias("word"), "v"), "word")
    other = words.join(known.select("word"), "word", "left_anti").withColumn("w", F.concat(F.lit("<"), "word", F.lit(">")))
    other = other.select("word", "w", F.explode(F.sequence(F.lit(1), F.lit(NGRAM))).alias("level")).where(F.length("w") >= F.col("level"))
    other = other.select("word", "level", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1 - F.col("level")), lambda i: F.substring(F.col("w"), i, F.col("level")))).alias("gram"))
    found = other.join(rows, ["level", "gram"]).groupBy("word", "level").agg(F.collect_list("v").alias("vs")).groupBy("word").agg(F.max_by("vs", "level").alias("vs"))
    none = F.transform(langs, lambda x: F.lit(0.0))
    mean = F.transform(F.aggregate("vs", none, lambda s, x: F.zip_with(s, x, lambda a, b: a + b)), lambda x: x / F.size("vs"))
    v = known.unionByName(other.select("word").distinct().join(found.select("word", mean.alias("v")), "word", "left").select("word", F.coalesce("v", none).alias("v")))
    spread = F.log(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("v")))) + F.array_max("v")
    return v.withColumn("_log", spread).select("word", F.transform("v", lambda x: F.greatest(x - F.col("_log"), F.lit(FLOOR))).alias("v"))


def _joined(docs: DataFrame, model: dict) -> DataFrame:
    """_row and _s, with the model in tables."""
    rows = docs.select(row_of(docs).alias("_row"), F.monotonically_increasing_id().alias("_id")).checkpoint()
    words = rows.select("_id", F.col("_row.text").cast("string").alias("t")).mapInArrow(_words, "id long, word string, n long").checkpoint()
    each = words.where("word is not null")
    vectors = word_vectors(each.select("word").distinct(), model)
    sums = each.join(vectors, "word").select("id", "n", F.posexplode("v").alias("i", "x")).groupBy("id", "i").agg(F.sum(F.col("x") * F.col("n")).alias("x"), F.sum("n").alias("n"))
    sums = sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.sqrt("n")).alias("x")))).alias("v"))
    best = F.array_max(F.transform("v", lambda e: e["x"]))
    at = F.get(F.filter("v", lambda e: e["x"] == best), 0)["i"]
    score = 1 / F.aggregate("v", F.lit(0.0), lambda s, e: s + F.exp(e["x"] - best))
    named = sums.select(F.col("id").alias("_id"), F.struct(F.get(F.array(*map(F.lit, model["langs"])), at).alias("lang_pred"), score.alias("score")).alias("_s"))
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.join(named, "_id", "left").select("_row", F.coalesce("_s", nothing).alias("_s"))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """_row (the input row) and _s (lang_pred, score)."""
    if "cells" in model:
        return _joined(docs, model)
    return docs.select(row_of(docs).alias("_row"), scorer(model)(F.col("text").cast("string")).alias("_s"))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    mod, out = HELD_OUT
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("_row.doc_id", "_s")
    return rows.select("doc_id", (id_remainder(F.col("doc_id"), mod) == out).alias("held_out"), "_s.lang_pred", "_s.score")


def keep_identified(docs: DataFrame, model: dict, least: float | None = None) -> DataFrame:
    """The input rows whose language is found, with all their columns.

    A score under `least` is as good as none; by default that is one that hardly differs from all languages alike.
    """
    least = min(1.0, 1.01 / max(1, len(model["langs"]))) if least is None else least
    return scored(docs, model).where((F.col("_s.lang_pred") != UNKNOWN) & (F.col("_s.score") >= least)).select("_row.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
