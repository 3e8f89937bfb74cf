"""BPE, conversation repair and centroids against plain statements of their contracts, on small and awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from test_operators import SCHEMA, awkward, needs_tables, rows_of, sha

from speechjobs.llm import bpe, centroids, conversations

SF = "/root/testdata/sf0.001"


# --- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def test_bpe_equals_the_library(library):
    coder, decoder, rng = bpe.ForcedBoundaryBPE(bpe.vocabulary()), bpe.Decoder(bpe.vocabulary()), random.Random(1)
    odd = [chr(c) for c in (0xA0, 0x85, 0x1680, 0x2003, 0x2028, 0x3000, 0x1C, 0, 0x301, 0x200B, 0x10EC5, 0x1F600, 0xFFFD)]
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "\r\n", "é", "à", "中", "'s", "'ll", "12", "!", "...", "<|endoftext|>", "<|endof", "_", *odd]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(8000)]
    texts += [f"{chr(c)}a {chr(c)} {chr(c)}1" for c in range(0x3100)] + ["a" * 5000, " " * 3000, "ab" * 40_000, "word " * 20_000, "x" * 100 + "\n" * 50]
    for text in texts:
        ids, want = np.frombuffer(coder.encode(text), "<i4").tolist(), library.encode(text, add_special_tokens=False).ids
        assert ids == want and decoder.decode(np.array(ids, int)) == library.decode(want, skip_special_tokens=False)
    assert decoder.decode(np.array([0, 99_999_999, -1])) == decoder.decode(np.array([0]))


def test_forced_boundaries_are_certain(library):
    """No token holds a pair that is cut, and each pre-token's ids are those of its pieces."""
    coder = bpe.ForcedBoundaryBPE(bpe.vocabulary())
    assert len(coder.pairs) < 5000
    for word in ("éçèêzqxj", "qzqzqz", "Thandthat", "日本語日本", "x1y2"):
        token = "".join(bpe.byte_characters()[b] for b in word.encode())
        pieces = coder.cuts(token)
        assert "".join(pieces) == token
        assert [t.id for p in pieces for t in library.model.tokenize(p)] == [t.id for t in library.model.tokenize(token)]
    assert any(len(coder.cuts("".join(bpe.byte_characters()[b] for b in w.encode()))) > 1 for w in ("éçèêzqxj", "qzqzqz"))


def test_bpe_rows(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    docs = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    got = rows_of(bpe.decode(bpe.encode(docs)))
    want = sorted((-1 if r[0] is None else r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in awkward())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == want
    assert sorted(r["text"] for r in got) == sorted(r[1] or "" for r in awkward())
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] is None


@needs_tables
def test_op11_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows_of(bpe.op11_bpe(spark, SF))
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


# --- conversations

BLANK = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """A conversation's facts, and the cheapest way by a table of the best (cost, audit) per state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    blank = duplicate = truncated = 0
    seen, best = set(), {0: (0, "", ())}

    def better(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def inserts(table):
        for _ in range(4):
            for state, (cost, audit, lines) in list(table.items()):
                new = 3 if state == 2 else 2
                better(table, new, (cost + 3, audit + "I", (*lines, "user:" if new == 2 else "assistant:")))

    for _, _, role, text in rows:
        empty, again, cut = not text.strip(BLANK), (role, text) in seen, text.rstrip(BLANK)[-1:] not in (".", "!", "?")
        blank, duplicate, truncated = blank + empty, duplicate + (again and not empty), truncated + (cut and not again and not empty)
        seen.add((role, text))
        inserts(best)
        after = {}
        for state, (cost, audit, lines) in best.items():
            better(after, state, (cost + 4, audit + "D", lines))
            if empty or again:
                continue
            kept = {"u": None if state == 2 else 2, "a": 3 if state == 2 else None, "s": 1 if state == 0 else None}.get(role[:1])
            if kept is not None:
                better(after, kept, (cost + 3 * cut, audit + "K", (*lines, f"{role}:{text}")))
            new = 3 if state == 2 else 2
            better(after, new, (cost + 3 + 3 * cut, audit + "R", (*lines, f"{'user' if new == 2 else 'assistant'}:{text}")))
        best = after
    inserts(best)
    cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda w: w[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, sha("\n".join(lines))


def odd_conversations():
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ua"], ["a.", "b!", "c", "", " \n", None, "d? ", "e.f", "g. x", "x" * 70_000 + "."]
    rows = [(conv, rng.choice([i, i, i + 2, None]), rng.choice(roles), rng.choice(texts[: rng.choice([5, 10])])) for conv in range(250) for i in range(rng.randrange(1, 9))]
    rows += [(1000, i, ["user", "assistant"][i % 2], f"t{i % 7}.") for i in range(300)] + [(1001, None, "user", "same.")] * 200
    rows += [(1002, i, rng.choice(roles[:4]), f"{i}{rng.choice(['.', ''])}") for i in range(400)] + [(None, 1, "user", "q."), (None, 2, "assistant", "r.")]
    rows += [(c, 0, "user", "gone.") for c in range(2000, 2400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows += [(3000, i, "system", "s.") for i in range(5)] + [(3001, 2**62, "user", "a."), (3001, -5, "user", "b.")]
    return rows


@pytest.mark.parametrize("bounds", [(2000, 1 << 30, 100_000), (60, 1 << 30, 50), (2, 100, 30)])
def test_repair_of_short_and_long_conversations(spark, bounds):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, key string, part string").repartition(5)
    damage = conversations.damage(df)
    if bounds[0] == 2:  # every conversation in pieces: a part of them will do
        damage = damage.where("conv_id is null or conv_id >= 1000 or conv_id < 20")
    got = {r["conv_id"]: tuple(r)[1:] for r in rows_of(conversations.repair_conversations(damage, *bounds))}
    now = damaged(rows)
    want = {c: plain_repair([r for r in now if r[0] == c]) for c in {r[0] for r in rows}}
    if bounds[0] == 2:
        want = {c: w for c, w in want.items() if c is None or c >= 1000 or c < 20}
    assert got == want
    assert any(w == (0, 0, 0, 0, 0, 0, "", sha("")) for w in want.values())


def test_layers_hold_any_cost():
    """Ways of thousands of edits, in one piece and in many."""
    rng = random.Random(4)
    rows = [(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.3, rng.choice([1, 1, 2])) for _ in range(3000)]
    whole = conversations.Rows(rows)
    layers = whole.layers(conversations.ACCEPT)
    letters, state = whole.trace(layers, 0)
    assert sum({"D": 4, "I": 3, "R": 3, "K": 0}[e] for x in letters for e in x) + 3 * sum(r[2] and ("K" in x or "R" in x) for r, x in zip(rows, letters)) + 3 * len(conversations.ending(state)) == conversations.costs_of(*layers[0])[0]
    costs, parts = conversations.ACCEPT, [conversations.Rows(rows[i : i + 7]) for i in range(0, 3000, 7)]
    for part in parts[::-1]:
        m = part.between()
        costs = [min(m[s][e] + costs[e] for e in range(4)) for s in range(4)]
    assert costs[0] == conversations.costs_of(*layers[0])[0]


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_conversations(conversations.damage(none)).count() == 0


# --- centroids


def plain_lloyd(rows, k=16, rounds=3):
    """vec_id, numbers in; sorted (id, cluster, distance, cluster inertia, inertia, digest) out, in whole numbers."""
    import math

    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[1]))
    cents = [v for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(cents)), key=lambda c: (far(v, cents[c]), c))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for c in set(at):
            own = [v for (_, v), x in zip(kept, at) if x == c]
            cents[c] = [sum(col) // len(own) for col in zip(*own)]
    at = [nearest(v) for _, v in kept]
    d = [far(v, cents[c]) for (_, v), c in zip(kept, at)]
    top = (1 << 63) - 1
    inertia = {c: sum(min(x, top) for x, y in zip(d, at) if y == c) for c in set(at)}
    return sorted(((i is None, i or 0), c, min(x, top), min(inertia[c], top), min(sum(inertia.values()), top), sha(",".join(map(str, cents[c])))) for (i, _), c, x in zip(kept, at, d))


def vectors(n, spread, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (7, 64))
    return [(int(i), [float(np.float32(x)) for x in middles[rng.integers(7)] + rng.normal(0, spread, 64)]) for i in range(n)]


@pytest.mark.parametrize("case", ["clusters", "noise", "odd", "huge", "few", "same"])
def test_centroids_equal_plain_lloyd(spark, case):
    rows = {
        "clusters": lambda: vectors(700, 0.05, 1),
        "noise": lambda: vectors(400, 3.0, 2),
        "odd": lambda: [*vectors(80, 0.3, 3), (500, None), (501, [1.0] * 63), (502, [1.0] * 65), (503, [None] + [1.0] * 63), (504, [float("nan")] * 64), (505, [float("inf")] * 64), (None, [0.5] * 64), (None, [0.25] * 64), (7, [0.5] * 64), (7, [0.5] * 64), (8, [])],
        "huge": lambda: [*vectors(30, 0.3, 4), (900, [float(np.float32(3e38))] * 64), (901, [float(np.float32(-1e20))] + [0.0] * 63), (902, [40_000.5] * 64)],
        "few": lambda: vectors(5, 1.0, 5),
        "same": lambda: [(i, [0.125] * 64) for i in range(300)] + vectors(20, 0.5, 6),
    }[case]()
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(4)
    got = sorted(((r[0] is None, r[0] or 0), *tuple(r)[1:]) for r in rows_of(centroids.cluster_vectors(df)))
    assert got == plain_lloyd(rows)


def test_cover_tree_and_pruning():
    points = centroids.whole_numbers(np.array([v for _, v in vectors(3000, 0.05, 7)]))
    tree = centroids.CoverTree(points, 32)
    for node in range(len(tree.centre)):
        rows = tree.rows(node)
        assert centroids._near(points[[tree.centre[node]]], points[rows])[0].max() <= tree.radius[node] + 1e-9
        if tree.children[node]:
            assert sorted(rows.tolist()) == sorted(r for c in tree.children[node] for r in tree.rows(c).tolist())
    whole, leaves = centroids.assign(tree, centroids.CoverTree(points[:16], 1))
    nearest = centroids.squares(points, points[:16]).argmin(1)
    assert all((nearest[tree.rows(n)] == c).all() for n, c in whole)
    assert all(np.isin(nearest[rows], near).all() for rows, near in leaves)
    assert sum(tree.end[n] - tree.begin[n] for n, _ in whole) > 500  # nodes that were given as a whole


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster_vectors(none).count() == 0


@needs_tables
def test_new_queries_read_whole_tables(spark):
    assert centroids.op13_centroids(spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    ids = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert conversations.op12_conversations(spark, SF).count() == ids
    assert hashlib.sha256(b"").hexdigest() == sha("")


def test_stages_drop_what_others_left_in_a_worker():
    import pyarrow as pa

    from speechjobs.llm import language_id, packing
    from speechjobs.llm.common import worker_cache

    worker_cache()["another stage's"] = bytes(10)
    assert sum(b.num_rows for b in language_id._count(10)([pa.RecordBatch.from_pydict({"lang": ["x"], "text": ["a b a"]})])) == 2
    assert not worker_cache()
    worker_cache()["another stage's"] = bytes(10)
    assert not list(packing._tokenise(packing.vocabulary(), 8, 1)([]))
    assert list(worker_cache()) == [packing.vocabulary()]
    worker_cache().clear()


def test_later_passes_sort_triggers_alone(monkeypatch):
    """The bits that come back belong to the distinct triggers in order; their phrases are not counted again."""
    import numpy as np
    import pyarrow as pa

    from speechjobs.llm import substring_dedup as sd

    rng = np.random.default_rng(3)
    bodies = [bytes(rng.integers(97, 101, 900, dtype=np.uint8)) for _ in range(6)]
    bodies += [bodies[0][100:700] + bodies[1], bodies[0][50:650] + bodies[2][:300]]
    parse = sd.Parse(list(range(8)), bodies)
    triggers, several, phrases = parse.distinct_triggers()
    for t, more, n in zip(triggers, several, phrases, strict=True):
        own = parse.triggers == t
        assert more == (len(set(parse.docs[own])) > 1) and n == len(set(parse.names[own]))
    assert (np.diff(triggers) > 0).all() and set(triggers) == set(parse.triggers)

    def counted(self):
        raise AssertionError("phrases were counted again")

    monkeypatch.setattr(sd.Parse, "distinct_triggers", counted)
    at = sd._ranges(triggers, 1)
    flags = [np.packbits(several[a:b]).tobytes() for a, b in zip(at, at[1:])]
    back = pa.table({"part": [0, 1], "kind": ["trigger"] * 2, "bits": flags})
    assert (sd._chosen(parse, back, 1) == triggers[several]).all() and several.any()
