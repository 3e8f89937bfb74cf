"""Each operator against a plain statement of its contract, on small and awkward tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechjobs.llm import exact_dedup, fingerprints, language_id, mixing, near_dedup, packing, pii, quality, substring_dedup, toxicity

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, grp string, epoch string, owner string, _row string, _sha_ string, _nth string, _id string, node string"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def awkward():
    """Nulls in any column, empty and long texts, ties, repeated rows, near copies."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    long = [rng.choice(vocabulary) for _ in range(4000)]
    near = [*long[:2000], "changed", *long[2001:]]
    base = " ".join(long[100:160])
    texts = [(1, base, "en", "a"), (2, None, None, "a"), (3, "", "en", None), (4, " \n\t ", "en", "b"), (5, base.replace(" ", "\n", 3), "en", "a"), (6, " ".join(long), "fr", "a"), (7, " ".join(near), "fr", "a"), (8, base, None, "b"), (8, base, None, "b"), (None, "one two", "en", "c"), (None, base.upper(), "fr", "a"), (12, "😀 é 語 " * 30, "fr", "c"), (13, "x", "en", "a"), (14, base + " tail", "en", "a"), (15, "mail a.b@c.dd now", "en", "a")]
    texts += [(20 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))), rng.choice(["en", "fr"]), rng.choice("abc")) for i in range(25)]
    return [(i, t, lang, source, len(t or ""), *("clash",) * 10) for i, t, lang, source in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], i % 2, i % 3 == 0 and 1 or 0) for i, r in enumerate(awkward())] + [(1, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return df.collect()


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# --- PII


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(map(str.isdigit, m)) <= 15),
}


def base_spans(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if ok(m.group()))


def run_op1(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return pii.op1_pii(spark, str(tmp_path)).collect()


def test_pii_base(spark, tmp_path):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "1", "25", "256", "00", "4111 1111 1111 1111", " ", "-", "+", "(", "é", "😀", "_", "%", "x@y.zz", "10.0.0.1", "+1 (234) 567-8901", "\n", "4111-1111-1111-1111"]
    texts = dict(enumerate(["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(600)] + [None, "", "a@b.c_d@e.f", "a" * 50_000 + "@", "1" * 60_000]))
    got = run_op1(spark, list(texts.items()), tmp_path)
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[3] == k for s in want) for k in PLAIN]
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{e}" for a, _, e, k in want))


def test_pii_terms(spark, tmp_path):
    filler = [(100 + i, f"Ask common words at here or there number{i} else common words") for i in range(40)]
    told = [(i, "Ask (Jaronix) common, at jx@corp.example or else common words") for i in range(4)]
    rows = [*filler, *told, (50, "Ask Onceonly at once@corp.example common words"), (None, None)]
    got = {r["doc_id"]: r for r in run_op1(spark, rows, tmp_path)}
    assert len(got) == len(rows)
    spans = got[0]["spans"].split(",")
    assert "term:5:12" in spans and "email:25:40" in spans and spans == sorted(spans, key=lambda s: int(s.split(":")[1]))
    assert not any(r["n_term"] for i, r in got.items() if i is None or i >= 50)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[0].startswith("Ask () common, at [EMAIL]") and clean[100] == filler[0][1] and clean[None] == ""


def test_pii_terms_anywhere(spark, tmp_path):
    """Telling words far from the entity, again and again, and beyond a number that is no card; equal rows, null ids."""
    filler = [(100 + i, f"common words stand at here and there number{i} with common words") for i in range(40)]
    far = [(i, "Jaronix, " + "common words " * 40 + "at jx@corp.example, " + "common words " * 40 + "(JARONIX)") for i in range(3)]
    card = [(10 + i, "common Jonathan, room 12, 4111 1111 1111 1111 common words") for i in range(3)]
    rows = [*filler, *far, *card, *[(60, "Copied x@copy.example common")] * 4, (None, far[0][1] + " words")]
    got = {}
    for r in run_op1(spark, rows, tmp_path):
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    text, marks = far[0][1], got[0][0]["spans"].split(",")
    assert [m for m in marks if m.startswith("term")] == ["term:0:7", f"term:{text.index('JARONIX')}:{text.index('JARONIX') + 7}"]
    assert got[None][0]["n_term"] == 2 and "term:7:15" in got[10][0]["spans"].split(",")
    assert not any(r["n_term"] for i, part in got.items() if i is not None and i >= 60 for r in part)


def spans_plain(rows, support=3, generalise=0.8):
    """All spans of each row by the plain statement: counts over all rows, every word of every document tried."""
    import regex

    term = regex.compile(pii.TERM)
    base = [base_spans(t) for _, t in rows]
    words = [{m.group(1).lower() for m in term.finditer(t or "")} for _, t in rows]
    holds = [{(k, (t or "")[a:e]) for a, _, e, k in b} | {(k, "") for *_, k in b} for (_, t), b in zip(rows, base, strict=True)]
    n, n_t, n_c = len(rows), Counter(w for ws in words for w in ws), Counter(c for h in holds for c in h)
    together, different = Counter(), defaultdict(set)
    for (i, t), ws, h in zip(rows, words, holds, strict=True):
        for c in h:
            different[c].add((i, t or ""))
            for w in ws:
                together[c, w] += 1
                different[c, w].add((i, t or ""))

    def telling(c, w):
        whole = np.log2(n / min(n_c[c], max(n // 2, 1)))
        return len(different[c]) >= support and len(different[c, w]) >= support and whole > 0 and np.log2(together[c, w] * n / (n_c[c] * n_t[w])) / whole >= generalise

    out = []
    for (_, t), b, ws, h in zip(rows, base, words, holds, strict=True):
        told = {w for w in ws if any(telling(c, w) for c in h)}
        spans = [(a, i, e, k) for a, i, e, k in b] + [(m.start(1), 4, m.end(1), "term") for m in term.finditer(t or "") if m.group(1).lower() in told]
        out.append(",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(spans)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pii_all_spans_plain(spark, tmp_path, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    values = ["a.b@c.dd", "10.0.0.1", "4111 1111 1111 1111", "+1 (234) 567-8901"]
    marks = {v: [f"tell{'abcd'[k]}{j}" for j in 'xy'] for k, v in enumerate(values)}
    rows = []
    for i in range(90):
        parts = [rng.choice(words) for _ in range(rng.randrange(0, 15))]
        if rng.random() < 0.3:
            v = rng.choice(values)
            parts += [v if rng.random() < 0.6 else v.replace("1", str(rng.randrange(2, 9)), 1)] + [w for w in marks[v] if rng.random() < 0.7]
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, None), (95, "")]
    got = sorted((str(r["doc_id"]), r["spans"]) for r in run_op1(spark, rows, tmp_path))
    want = sorted((str(i), x) for (i, _), x in zip(rows, spans_plain(rows), strict=True))
    assert got == want and sum("term" in x for _, x in want) >= 5


# --- mixing


def fill_level(budget, nodes):
    """nodes: name to (cap, weight); plain water-filling."""
    left, out, open_ = budget, {}, dict(nodes)
    while open_:
        level = left / sum(w for _, w in open_.values())
        full = {k for k, (c, w) in open_.items() if c <= w * level}
        if not full:
            return out | {k: w * level for k, (_, w) in open_.items()}
        for k in full:
            out[k] = open_[k][0]
            left -= open_.pop(k)[0]
    return out


def test_mixing_budgets(spark):
    rng = random.Random(8)
    for _ in range(3):
        leaves = [(f"d{d}", f"l{x}", f"s{s}", rng.choice([10, 1000, 50_000]), 5) for d in range(3) for x in range(rng.randrange(1, 3)) for s in range(rng.randrange(1, 4))]
        weights = {"domain": {"d0": 0.7}, "lang": {"l1": 0.25}, "source": {"s0": 2.0}}
        weight = lambda level, name: weights[level].get(name, 1.0)  # noqa: E731, B023
        budget = sum(x[3] for x in leaves)
        got = {tuple(r)[:3]: r["grant"] for r in mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, rows long"), budget, 2, weights).collect()}
        cap = lambda p: 2 * sum(x[3] for x in leaves if x[: len(p)] == p)  # noqa: E731, B023
        for d, b in fill_level(budget, {x[0]: (cap(x[:1]), weight("domain", x[0])) for x in leaves}).items():
            for lang, c in fill_level(b, {x[1]: (cap(x[:2]), weight("lang", x[1])) for x in leaves if x[0] == d}).items():
                for s, g in fill_level(c, {x[2]: (cap(x[:3]), weight("source", x[2])) for x in leaves if x[:2] == (d, lang)}).items():
                    assert abs(got[d, lang, s] - g) <= 3


def test_mixing_prefixes(docs, none):
    got = rows_of(mixing.mix(docs, share=0.7, max_epochs=3).select("_row.doc_id", "_row.text", "domain", "lang", "source", "epoch", "n_tokens", "taken"))
    assert all(r["n_tokens"] == len(WORDS.findall(r["text"])) and 0 < r["taken"] <= r["n_tokens"] for r in got)
    by_leaf = defaultdict(list)
    for r in got:
        by_leaf[r["domain"], r["lang"], r["source"]].append(r)
    for leaf in by_leaf.values():
        assert sum(r["taken"] < r["n_tokens"] for r in leaf) <= 1
        counts = Counter(r["epoch"] for r in leaf)
        assert [counts[e] for e in sorted(counts)] == sorted(counts.values(), reverse=True)
    total = sum(len(WORDS.findall(r[1] or "")) for r in awkward())
    assert 0 <= int(0.7 * total) - sum(r["taken"] for r in got) <= 40
    kept = mixing.keep_mixed(docs, share=1.0, max_epochs=1)
    assert kept.columns == docs.columns and kept.count() == sum(bool(WORDS.findall(r[1] or "")) for r in awkward())
    assert mixing.mix(none).count() == 0


# --- repeated substrings


def remove_plain(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - n + 1):
            first[b[a : a + n]] = min(first.get(b[a : a + n], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - n + 1):
            if first[b[a : a + n]] < i:
                gone[a : a + n] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return sorted(out)


def test_substring_dedup(spark, docs, none):
    rng = random.Random(6)
    passages = ["".join(rng.choice("abc é") for _ in range(rng.choice([30, 49, 50, 51, 120, 700]))) for _ in range(8)]
    texts = [(i, "".join(rng.choice([*passages, "x" * 60, "".join(rng.choice("qrst") for _ in range(20))]) for _ in range(rng.randrange(6)))) for i in range(60)]
    for group_bytes, hot in ((1 << 22, 50_000), (3000, 50_000), (3000, 1), (1 << 22, 0)):  # the last two deal windows out one by one
        got = rows_of(substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), group_bytes=group_bytes, hot_phrases=hot, partitions=3).drop("kept"))
        assert sorted(map(tuple, got)) == remove_plain(texts)
    last = 1 << 62
    own = [(r[0] if r[0] is not None else last, r[1]) for r in awkward()]
    got = [(r[0] if r[0] is not None else last, *r[1:]) for r in map(tuple, rows_of(substring_dedup.remove_repeats(docs).drop("kept")))]
    assert sorted(got) == remove_plain(own)
    assert substring_dedup.remove_repeats(none).count() == 0


# --- exact duplicates


def test_exact_dedup(docs, none):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in awkward():
        groups[sha(normal(r[1]))].append(r[0])
    for limit in (64 << 20, 3000):  # the second one spills
        got = rows_of(exact_dedup.exact_dedup(docs, limit))
        assert len(got) == len(awkward())
        for r in got:
            ids = [i for i in groups[r["text_sha256"]] if i is not None]
            assert r["keep_id"] == (min(ids) if ids else None) and r["group_size"] == len(groups[r["text_sha256"]])
        assert all(sum(r["kept"] for r in got if r["text_sha256"] == h) == 1 for h in groups)
    kept = exact_dedup.keep_owners(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_patricia_trie():
    rng = random.Random(1)
    trie, plain = exact_dedup.PatriciaTrie(), {}
    spilled = []
    for _ in range(3000):
        key, owner = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))), rng.randrange(1000)
        trie.insert(key, owner, 1)
        o, n = plain.get(key, (owner, 0))
        plain[key] = (min(o, owner), n + 1)
        if rng.random() < 0.002:
            spilled += trie.spill()
    found = {}
    for key, owner, n in [*spilled, *trie.entries()]:
        o, m = found.get(key, (owner, 0))
        found[key] = (min(o, owner), m + n)
    assert found == plain


# --- classifiers


@needs_tables
def test_classifiers_hold_out(spark):
    import pandas as pd

    truth = pd.read_parquet(f"{SF}/labels.parquet")
    for query, name, least in ((quality.op5_quality, "quality", 0.9), (toxicity.op6_toxicity, "toxic", 0.85)):
        got = query(spark, SF).toPandas()
        assert len(got) == 1000 and got.score.between(0, 1).all() and (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
        both = got.merge(truth, on="doc_id")
        held = both[both.held_out]
        assert (held.predicted == held[name]).mean() >= least


def test_classifiers_awkward(spark, docs, none, labels):
    model = quality.fit(docs, labels)
    got = rows_of(quality.score(docs, model))
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    one = quality.fit(docs, labels.where("quality = 1"))
    assert not one[1] and len({r["score"] for r in quality.score(docs, one).collect()}) == 1
    tox = toxicity.fit(docs, labels)
    got = rows_of(toxicity.score(docs, tox))
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0"))["rest"] == 0


def test_compiled_rules(spark, docs):
    table = quality.statistics(docs).select(*quality.STATISTICS).toPandas().to_numpy(float)
    y = (table[:, 0] > 30).astype(float)
    intercept, rules = quality.fit_rules(table, y)
    assert rules
    plain = intercept + sum(w * np.logical_and.reduce([(table[:, f] > b) == above for f, above, b in rule]) for rule, w in rules)
    got = quality.statistics(docs).select(quality.compiled(intercept, rules).alias("s")).toPandas()["s"].to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-plain))) and ((got > 0.5) == y).mean() > 0.9


def test_block_max_is_exact():
    rng = np.random.default_rng(3)
    vectors = rng.random((700, 40)).astype(np.float32) * (rng.random((700, 40)) < 0.1)
    vectors[vectors.sum(axis=1) == 0, 0] = 1
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    index = toxicity.BlockMaxIndex({"terms": [f"t{i}" for i in range(40)], "idf": np.ones(40), "ids": np.arange(700), "labels": np.zeros(700), "vectors": vectors, "rest": 0.0})
    for _ in range(100):
        terms = sorted(rng.choice(40, rng.integers(1, 6), replace=False).tolist())
        w = rng.random(len(terms)).astype(np.float32)
        w /= np.linalg.norm(w)
        plain = np.sort(vectors[:, terms] @ w)[::-1][:15]
        assert np.allclose([c for c, _ in index.nearest(terms, w)], plain[plain > 0], atol=1e-5)


def test_toxicity_rare_terms(spark):
    clean = [(i, f"plain words number {chr(97 + i % 26)}{chr(97 + i // 26)} stand here") for i in range(150)]
    rare = [(200 + i, f"plain words vilest {chr(97 + i)} here") for i in range(8)]
    rows = [*clean, *rare, (900, "here stand plain words of the vilest kind"), (901, "here stand plain words")]
    labels = spark.createDataFrame([(i, int(i >= 200)) for i, _ in [*clean, *rare]], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    learned = [t for i, t in [*clean, *rare] if zlib.crc32(str(i).encode()) % 5]
    assert "vilest" in model["terms"] and set(model["terms"]) <= {w for t in learned for w in t.split()}
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert got[900]["predicted"] == 1 and got[901]["predicted"] == 0 and all(i >= 200 for i in got[900]["evidence"])


def test_toxicity_plain(spark):
    """All scores by dense vectors, a full sort of the cosines, votes and the curve."""
    rng = random.Random(31)
    common, rare = [f"word{chr(97 + i)}" for i in range(20)], ["".join(rng.choice("bcdfg") for _ in range(5)) for _ in range(250)]
    rows = [(i, " ".join([rng.choice(common) for _ in range(rng.randrange(0, 30))] + [rng.choice(rare) for _ in range(rng.randrange(0, 9))] + ["vile"] * (i % 7 == 0))) for i in range(500)]
    rows += [(600, None), (601, ""), (602, "12 34"), (None, rows[3][1]), (5, "another text of number five")]
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(400)] + [(3, 0), (None, 1), (999, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    texts = {}
    for i, t in rows:
        texts[i] = min(texts.get(i, t or ""), t or "")
    assert all(i is not None and zlib.crc32(str(i).encode()) % 5 for i in model["ids"].tolist()) and 200 < len(model["ids"]) < 320
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    df = Counter(w for _, t in rows for w in set(words(t)))
    weight = {t: (np.log((len(rows) + 1) / (df[t] + 1)) + 1e-6) * f for t, f in zip(model["terms"], model["factor"], strict=True)}

    def vector(t):
        tf = Counter(w for w in words(t) if w in weight)
        v = {w: (1 + np.log(n)) * weight[w] for w, n in tf.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {w: x / norm for w, x in v.items()}

    examples = [(int(i), y, vector(texts[int(i)])) for i, y in zip(model["ids"], model["labels"], strict=True)]
    slope, intercept = model["curve"]
    got = sorted(toxicity.score(docs, model).collect(), key=lambda r: (str(r["doc_id"]), r["score"]))
    want = []
    for i, t in rows:
        v = vector(t)
        if not v:
            want.append((str(i), model["rest"]))
            continue
        near = sorted(((sum(x * e.get(w, 0) for w, x in v.items()), j, y) for j, y, e in examples), key=lambda c: (-round(c[0], 6), c[1]))
        near = [c for c in near if c[0] > 0][: toxicity.NEAREST]
        vote = (sum(c * y for c, _, y in near) + 0.5 * model["rest"]) / (sum(c for c, _, _ in near) + 0.5)
        want.append((str(i), 1 / (1 + np.exp(-(slope * np.log((vote + 1e-3) / (1 - vote + 1e-3)) + intercept)))))
    assert len(got) == len(want)
    off = [abs(r["score"] - w) for r, (_, w) in zip(got, sorted(want), strict=True)]
    assert max(off) < 1e-2 and np.mean(np.array(off) > 1e-4) < 0.02  # float sums may swap neighbours that tie


# --- packing


def test_fill_is_best():
    rng = random.Random(9)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        target = rng.randrange(60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        got = packing.fill(counts, target)
        assert all(n <= counts[k] for k, n in got.items()) and sum(k * n for k, n in got.items()) == max(s for s in sums if s <= target)


def check_pieces(pieces, texts, tokenizer):
    """texts: list of (id, text); every id of each text in exactly one piece, sequences gapless."""
    want = Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            want[i, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces) == want
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 2048 - at
    return padding, len(by_sequence)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary()[0])
    padding, n = check_pieces(rows_of(packing.pack(docs)), [(r[0], r[1]) for r in awkward()], tokenizer)
    assert padding < 2 * 2048 and n > 5
    assert packing.pack(none).count() == 0


def test_unit_tokenizer():
    rng = random.Random(1)
    tokenizer = packing.UnitTokenizer(*packing.vocabulary())
    parts = [" ", "  ", "\n", "a", "b", "é", "'s", "'ll", "1", "23", "!", "?", "\t", "<|endoftext|>", "語", "　", " ", ".", "A", " x", " y", " ."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)]
    for t, p in zip(texts, [x for i in range(0, 5000, 200) for x in tokenizer.packed(texts[i : i + 200])], strict=True):
        assert p == np.array(tokenizer.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


# --- language


@needs_tables
def test_language_id_holds_out(spark):
    import pandas as pd

    got = language_id.op8_language_id(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    assert len(got) == 1000 and (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97


def test_language_id_awkward(docs, none):
    model = language_id.fit(docs)
    got = rows_of(language_id.identify(docs, model))
    texts = Counter((r[0], not any(map(str.isalpha, r[1] or ""))) for r in awkward())
    assert Counter((r["doc_id"], r["lang_pred"] == "und") for r in got) == texts
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = language_id.keep_identified(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(n for (_, und), n in texts.items() if not und)
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(none)).collect()} == {"und"}


def test_language_sample_is_of_each_language(spark):
    rows = [(i, f"w{i % 7} x", "aa" if i % 20 else "bb") for i in range(6000)] + [(9000, "once", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r["lang"] for r in language_id.learning_rows(df, 500).collect())
    every = Counter(lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    assert 400 < got["aa"] < 600 and got["bb"] == every["bb"] and got["cc"] == every["cc"]
    assert Counter(r["lang"] for r in language_id.learning_rows(df, 10**6).collect()) == every


def languages_plain(rows):
    """rows: (doc_id, text, lang); one prediction and score a row, by the plain statement of the method."""
    words_in = lambda t: [w for x in (t or "").split() for w in language_id.words_of(x)]
    grams_in = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    counts = [defaultdict(Counter) for _ in range(6)]
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode() if i is not None else b"") % 3 * (i is not None) != 1:
            for w in words_in(text):
                counts[0][lang][w] += 1
                for n in range(1, 6):
                    counts[n][lang].update(grams_in(w, n))
    langs = sorted(counts[0])
    whole = [[max(1, sum(c[x].values())) for x in langs] for c in counts]
    known = [{k: [c[x][k] for x in langs] for x in langs for k in c[x]} for n, c in enumerate(counts)]
    known = [{k: np.log((np.array(v) + 0.5) / whole[n]) for k, v in t.items() if any(v)} for n, t in enumerate(known)]

    def vector(w):
        if w in known[0]:
            return known[0][w]
        for n in range(5, 0, -1):
            found = [known[n][g] for g in grams_in(w, n) if g in known[n]]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(langs))

    out = []
    for _, text, _ in rows:
        vs = [vector(w) for w in words_in(text)] if langs else []
        if not vs:
            out.append(("und", 0.0))
            continue
        total = sum(np.maximum(v - np.log(np.exp(v).sum()), -8) for v in vs) / len(vs) ** 0.5
        out.append((langs[int(total.argmax())], 1 / np.exp(total - total.max()).sum()))
    return out


@pytest.mark.parametrize("entries", [10**6, 0])
def test_language_id_plain(spark, entries):
    """Scores by the plain statement; with the model sent to all tasks, and with words that meet it in joins."""
    rng = random.Random(21)
    vocabulary = {x: ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(60)] for x, letters in (("aa", "abcdef"), ("bb", "cdefgh"), ("cc", "éfgßi"))}
    rows = []
    for i in range(120):
        lang = rng.choice(list(vocabulary))
        words = [rng.choice(vocabulary[lang]) if rng.random() < 0.9 else "".join(rng.choice("abghxyzé") for _ in range(4)) for _ in range(rng.randrange(0, 12))]
        rows.append((i, " ".join(words), lang if rng.random() < 0.9 else None))
    rows += [(200, None, "aa"), (201, "12 34 !", "bb"), (None, "cde fgh", "bb"), (None, "cde fgh", "bb"), (202, "ααα βββ", None), (203, "don't stop-here x2y", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, entries)
    assert ("cells" in model) == (entries == 0)
    got = language_id.identify(df, model).collect()
    want = languages_plain(rows)
    assert len(got) == len(rows)
    order = lambda r: (str(r[0]), r[1], r[2])
    for a, b in zip(sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in got), key=order), sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=order), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3


def test_backoff_order():
    matrix = np.log(np.array([[0.9, 0.1], [0.1, 0.9], [0.2, 0.8], [1, 1]])).astype(np.float32)
    scorer = language_id.Scorer({"langs": ["x", "y"], "grams": [["known"], ["k"], [], ["unk"], [], []], "matrix": matrix})
    assert [p for p, _ in scorer.score(["known", "unkn", "k", "zzz"])] == ["x", "y", "y", "x"]


# --- near duplicates


def near_plain(rows, width=3, num=85, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_near_dedup(spark, docs, none):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, node_rows in ((4_000_000, 2000), (400, 2000), (150, 3)):  # the others deal components into blocks, and nodes into parts
        got = rows_of(near_dedup.near_components(df, block_shingles=block, node_rows=node_rows))
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_plain(rows)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(near_dedup.near_components(df, width=5, numerator=80))) == near_plain(rows, 5, 80)
    last = 1 << 62
    got = sorted((last if r["doc_id"] is None else r["doc_id"], r["n_shingles"], last if r["component_id"] is None else r["component_id"]) for r in rows_of(near_dedup.near_components(docs)))
    want = near_plain([(last if r[0] is None else r[0], r[1]) for r in awkward()])
    assert [g for g in got if g[1]] == [w for w in want if w[1]] and len(got) == len(want)
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert near_dedup.near_components(none).count() == 0


def test_near_dedup_large_group_goes_no_further(spark, monkeypatch):
    """A large group of near copies with few rows apart: its node is done without children, and no loose link is lost."""
    rng = np.random.default_rng(9)
    signs = rng.integers(0, 1 << 32, (1000, near_dedup.COORDINATES), dtype=np.uint32)
    near = lambda i, j, n: signs.__setitem__(i, np.where(rng.permutation(64) < n, rng.integers(0, 1 << 32, 64, dtype=np.uint32), signs[j]))
    for i in range(1, 900):
        near(i, 0, 4)
    for i in range(900, 950):  # near one member each, rather than all
        near(i, i - 700, 23)
    for i in range(951, 970):
        near(i, i - 1, 12)
    agree, keys = near_dedup.margin(85, 100), [b"%04d" % i for i in range(1000)]

    def branched(with_sign):
        raise AssertionError("the group was sent to children")

    monkeypatch.setattr(near_dedup, "_children", branched)
    df = spark.createDataFrame([(5, keys[i], signs[i].tobytes()) for i in range(1000)], "node long, set_key binary, sign binary")
    got = [(int(r["a"]), int(r["b"])) for r in near_dedup.loose_links(df, agree, 4, node_rows=120).collect()]
    assert all((signs[a] == signs[b]).sum() >= agree for a, b in got)

    def rooted(pairs):
        up = list(range(1000))
        for a, b in pairs:
            a, b = up[a], up[b]
            up = [min(a, b) if x in (a, b) else x for x in up]
        return up

    assert rooted(got) == rooted((i, j) for i in range(1000) for j in np.flatnonzero((signs == signs[i]).sum(axis=1) >= agree) if j > i and (i in (0, 950) or j >= 900))


def test_near_dedup_chains_cost_no_rounds(spark):
    """A chain of copies of copies comes out of a task as a star, so labels are right before the first round over the cluster."""
    words = [f"w{i}" for i in range(230)]
    rows = [(100 - i, " ".join(words[4 * i : 4 * i + 100])) for i in range(30)]
    rng = np.random.default_rng(3)
    signs = rng.integers(0, 1 << 32, (30, near_dedup.COORDINATES), dtype=np.uint32)
    for i in range(1, 30):
        signs[i] = np.where(rng.permutation(64) < 8, signs[i], signs[i - 1])
    agree = near_dedup.margin(85, 100)
    keys = sorted(bytes([i * 37 % 101]) for i in range(30))
    order = rng.permutation(30)
    nodes = spark.createDataFrame([(5, keys[i], signs[n].tobytes(), keys[i]) for n, i in enumerate(order.tolist())], "node long, set_key binary, sign binary, label binary")
    sets = [near_dedup.shingle_set(text, 3, {}) for _, text in rows]
    dealt = spark.createDataFrame([(b"r", 0, 0, keys[i], sets[n].tobytes()) for n, i in enumerate(order.tolist())], "root binary, i int, j int, set_key binary, shingles binary")
    for links in (near_dedup._searched(nodes, agree, 3), near_dedup._verified(dealt, 85, 100, 3)):
        assert sorted((bytes(r["a"]), bytes(r["b"])) for r in links.collect()) == [(keys[0], k) for k in keys[1:]]
    assert near_dedup.stars(iter([(2, 1), (4, 3), (3, 2), (0, 0), (5, 6), (6, 5)]), [b"a", b"b", b"c", b"d", b"c", b"y", b"x"]) == [(b"b", b"c"), (b"b", b"d"), (b"x", b"y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(near_dedup.near_components(df))) == near_plain(rows)


def test_near_dedup_large_nodes(spark):
    """A node far above the bound: a large group of near copies, pairs apart from it, and chains of copies of copies."""
    rng = np.random.default_rng(4)
    signs = rng.integers(0, 1 << 32, (1500, near_dedup.COORDINATES), dtype=np.uint32)
    near = lambda i, j, n: signs.__setitem__(i, np.where(rng.permutation(64) < n, rng.integers(0, 1 << 32, 64, dtype=np.uint32), signs[j]))
    for i in range(1, 900):
        near(i, 0, 4)
    for i in range(900, 1100, 2):
        near(i + 1, i, 6)
    for i in range(1101, 1200):
        near(i, i - 1, 6)
    keys = [b"%04d" % i for i in range(1500)]
    df = spark.createDataFrame([(5, keys[i], signs[i].tobytes()) for i in range(1500)], "node long, set_key binary, sign binary")
    links = near_dedup.loose_links(df, near_dedup.margin(85, 100), 4, node_rows=100).collect()
    assert len(links) < 3 * 1500
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in ((bytes(r["a"]), bytes(r["b"])) for r in links):
        root[find(a)] = find(b)
    groups = Counter(find(k) for k in keys[:900])
    assert groups.most_common(1)[0][1] >= 895
    assert sum(find(keys[i]) == find(keys[i + 1]) for i in range(900, 1100, 2)) >= 90
    assert sum(find(keys[i]) == find(keys[i - 1]) for i in range(1101, 1200)) >= 90
    assert len({find(k) for k in keys[1200:]}) == 300


def test_search_recall_in_large_nodes():
    rng = np.random.default_rng(1)
    signs = rng.integers(0, 1 << 32, (3000, near_dedup.COORDINATES), dtype=np.uint32)
    signs[:, :6] = 7  # one node of unlike members
    for i in range(0, 600, 2):
        signs[i + 1] = signs[i]
        signs[i + 1, rng.choice(64, 6, replace=False)] = rng.integers(0, 1 << 32, 6)
    found = {tuple(sorted(p)) for p in near_dedup.search(signs, np.arange(3000), near_dedup.margin(85, 100), 5)}
    assert sum((i, i + 1) in found for i in range(0, 600, 2)) >= 290


# --- fingerprints


def generalised(a, b):
    a, b = Counter(WORDS.findall(a)), Counter(WORDS.findall(b))
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_fingerprints(spark, docs, none):
    rows = sorted({(r[0], r[1] or "") for r in awkward() if r[0] is not None})
    got = {r["doc_id"]: r for r in rows_of(fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")))}
    errors = []
    for k, (i, t) in enumerate(rows):
        after, quarter = rows[(k + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - quarter] + after[:quarter]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == sha(edited)
        errors += [got[i]["near_edited"] - generalised(t, edited), got[i]["near_next"] - generalised(t, after)]
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.3
    assert got[1]["fingerprint"] == got[8]["fingerprint"] and got[3]["fingerprint"] == got[4]["fingerprint"] != got[13]["fingerprint"]
    all_rows = rows_of(fingerprints.fingerprint(docs))
    assert len(all_rows) == len(awkward()) and all(0 <= r["near_next"] <= 1 for r in all_rows)
    assert len({(r["fingerprint"], r["edited_sha256"]) for r in all_rows if r["doc_id"] == 8}) == 1
    assert fingerprints.fingerprint(none).count() == 0
    one = fingerprints.fingerprint(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_work_out_few_draws(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = ["", " ", "one", "a b", *(" ".join(rng.choices(vocabulary, k=n)) for n in (5, 17, 400, 900, 1500)), "same " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {reach: sorted(map(tuple, rows_of(fingerprints.fingerprint(docs, reach=reach)))) for reach in (None, 0.5, 4.0, fingerprints.REACH)}
    assert len(rows[None]) == len(texts) and all(r == rows[None] for r in rows.values())
    long = docs.where("doc_id in (7, 8)").select("doc_id", F.xxhash64("text").alias("text_hash"), "text", F.concat("text", F.lit(" more")).alias("edited"))
    counts = fingerprints.counted(long, fingerprints.REACH)
    assert fingerprints.candidates(counts, 64).count() < 0.15 * 64 * counts.count()
    assert fingerprints.signatures(long, 64, 0.5).where("not settled").count() == 2


# --- entry


def test_labelled_sample_counts_ids(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] * 30, "doc_id long, quality int")
    learning = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(2000))
    for size in (400, 1200):
        rows = quality.labelled_sample(labels, "quality", size).collect()
        assert 0.9 * size <= len(rows) <= size and len({r["doc_id"] for r in rows}) == len(rows)
    assert quality.labelled_sample(labels, "quality", 5000).count() == learning


def test_quality_of_few_labels(spark):
    for n in (4, 19):
        x, y = np.arange(n * 16, dtype=float).reshape(n, 16), np.array([i % 2 for i in range(n)], float)
        intercept, rules = quality.fit_rules(x, y)
        assert rules == [] and abs(1 / (1 + np.exp(-intercept)) - (y.sum() + 1) / (n + 2)) < 1e-9
    docs = spark.createDataFrame([(i, f"text {i}.") for i in range(12)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int"))
    assert model[1] == [] and all(0 < r["score"] < 1 for r in quality.score(docs, model).collect())


def test_many_matches_in_one_text(spark):
    text = " ".join(f"word{i % 7} {i % 90 + 10}," for i in range(400_000)) + " mail a.b@c.dd card 4539 1488 0343 6467"
    mails = " ".join(f"a{i}@b.cc" for i in range(100_000))
    got = {r["doc_id"]: r["base"] for r in pii.find(spark.createDataFrame([(1, text), (2, mails)], "doc_id long, text string")).collect()}
    assert [text[x["start"] : x["end"]] for x in got[1]] == ["a.b@c.dd", "4539 1488 0343 6467"]
    at = 0
    for i, x in enumerate(got[2]):
        assert (x["start"], x["end"]) == (at, at + len(f"a{i}@b.cc"))
        at = x["end"] + 1
    assert len(got[2]) == 100_000


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 512, 1000)]
    for r in spark.createDataFrame([(x,) for x in rows], "v array<int>").select("v", pii.running_sums(F.col("v")).alias("s")).collect():
        assert r["s"] == np.cumsum(r["v"]).tolist()


@pytest.mark.parametrize("stage", ["identify_language", "drop_copies", "drop_near_copies", "mix_sources"])
def test_stages_carry_columns_of_any_name(spark, stage):
    import corpus_pipeline

    rows = [(i, f"the word number {i % 3} and some more words here to be read {i % 3}", "en" if i % 2 else "fr", "s", 1, "x", "y", "z") for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", "a.b", "c`d", "_row"])
    out = getattr(corpus_pipeline, stage)(spark, docs, "")
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= set(rows)


def test_ids_and_text_only_matter(docs):
    renamed = docs.select("doc_id", "text", "lang", "source", "n_chars")
    a = sorted(map(str, rows_of(exact_dedup.exact_dedup(docs))))
    assert a == sorted(map(str, rows_of(exact_dedup.exact_dedup(renamed))))


def test_parse_ignores_the_order_of_rows():
    import pyarrow as pa

    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(40_000))).encode()) for i in range(20)]
    one, other = (substring_dedup._parse_of(pa.table({"doc_id": [r[0] for r in x], "body": [r[1] for r in x]})) for x in (rows, rng.sample(rows, 20)))
    assert (one.starts == other.starts).all() and (one.counts == other.counts).all() and (one.triggers == other.triggers).all()


def test_components_deal_out_labels_once_a_round(spark):
    """Right roots, in a bounded number of tasks; more ran when each join of a round dealt out the labels anew."""
    from speechjobs.llm.components import components

    pairs = [(b"%03d" % (7 * i % 101), b"%03d" % (7 * (i + 1) % 101)) for i in range(60) if i % 20] + [(b"x", b"x"), (b"900", b"901"), (b"901", b"900")]
    links = spark.createDataFrame(pairs, "a binary, b binary").checkpoint()
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    context, name = spark.sparkContext, "components of a test"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup(name, name)
    try:
        got = components(links)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((bytes(r["node"]), bytes(r["root"])) for r in got.collect()) == sorted((a, b) for a, b in up.items() if a != b"x")
    status = context.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(name) for s in status.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)
    assert tasks <= 320  # of three partitions; 300 were counted


def test_toxicity_texts_together():
    """Words from the table of bytes are those of the expression; texts scored together read no block twice and get what they get alone."""
    odd = [*map(chr, range(0x250)), "\u0130", "\u212a", "\u0301", "\u2019", "\u4e2d"]
    for text in [None, "", *(f"A{c}B c{c} {c}{c}D" for c in odd), "".join(odd), " ".join(odd)]:
        assert toxicity.words_of(text) == toxicity.RUN.findall((text or "").lower())
    rng = np.random.default_rng(4)
    vectors = rng.random((900, 60)).astype(np.float32) * (rng.random((900, 60)) < np.r_[np.full(30, 0.3), np.full(30, 0.02)])
    vectors[vectors.sum(axis=1) == 0, 0] = 1
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    index = toxicity.BlockMaxIndex({"terms": words, "idf": 1 + rng.random(60), "ids": rng.permutation(900), "labels": rng.integers(0, 2, 900), "vectors": vectors, "rest": 0.25})
    texts = [None, "", "none", *(" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(150)), words[59]]
    for text, (vote, evidence) in zip(texts, index.scores(texts), strict=True):
        alone, near = index.scores([text])[0]
        assert abs(vote - alone) < 1e-5 and len(evidence) == len(near)
        terms, weights = index.vectorise(text)
        plain = np.sort(vectors[:, terms] @ weights)[::-1][: toxicity.NEAREST] if len(terms) else np.zeros(0)
        assert np.allclose([c for c, _ in index.nearest(terms, weights)], plain[plain > 0], atol=1e-5)
