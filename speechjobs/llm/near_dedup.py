"""Near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct three-word shingles. Documents with equal sets are one class and count once. Each
of several independent trees sends a class down by the value of a chosen minwise coordinate. In a node, pivots are
compared with all that are not yet visited, within a budget of work; what is left when the budget ends branches by
further minwise coordinates, and small nodes are compared to the end. Nodes compare minwise estimates with a margin
under the threshold; the loose links found so, at most one per class and visit, make loose components. Each loose
component then meets once with its full sets: breadth-first search by exact similarity gives the links, so no pair of
a large group of copies is listed twice and no link between components is missed inside it. What a task finds connected
is given as a star around its smallest name, loose or exact, so that chains of links do not cost rounds over the cluster.

Large nodes are not searched in one task. Their members are dealt out by a second key and meet a few pivots of the node
in every part; a member linked with a pivot takes its label. If few are then apart from the largest group, which is what
becomes of a large group of near copies, they meet all parts of the group, and the node is done: the group goes no
further, and is never compared with itself. Other nodes branch by two further coordinates. A loose component
above `block_shingles` is dealt into blocks that meet a few pivots with full sets first; only what is not linked with the
largest group is then compared with all blocks, and the group itself is never compared pair by pair.

Recall: with threshold 0.85 a tree misses a pair at the threshold with probability 0.15, six trees with about 1e-5, and
the margin of the estimate, five standard deviations of 64 coordinates, misses such a pair with about 1e-5. Where a node
branches, by large size or a budget that ends, two coordinates keep such a pair together with 0.98 a level, and a tree
finds it with 0.85 * 0.98 then; six trees still miss about 2e-5 a level.

Defined results: null text and text without words have an empty set, are linked with nothing and stay; rows that
share a doc_id share its fate; null ids sort after all others, and so does the id 2^63 - 1, which is given back as null;
very long texts are read whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ensure_checkpoint_dir, row_of, shuffle_parts, slim_worker, text_of, worker_cache
from .components import components

COORDINATES = 64
TREES = 6
LEAF = 256
DEPTH = 8
NODE_ROWS, LEVELS, PIVOTS, FEW_NODES = 2000, 6, 16, 200_000
BLOCK_SHINGLES = 4_000_000
NUMERATOR, DENOMINATOR = 85, 100
LAST = (1 << 63) - 1
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingle_set(text: str, width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `width` words; fewer words make one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > 100_000:
        known.clear()
    get, hashes = known.get, []
    for w in words:
        if (h := get(w)) is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, dtype=np.uint64)
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray, seed: int = 20) -> np.ndarray:
    odd = np.random.default_rng(seed).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            least = np.minimum(least, ((s[i : i + 2048, None] * odd) >> _U(32)).astype(np.uint32).min(axis=0))
    return least


def _key(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _sketch(width: int):
    def run(batches):
        cache = worker_cache()
        known = (cache if "shingle words" in cache else slim_worker()).setdefault("shingle words", {})
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            sizes, keys, signs = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, width, known)
                sizes.append(len(s))
                keys.append(_key(s) if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sign"])

    return run


def _branch(trees: int):
    """A row for each tree: the node below its root is named by one coordinate's value."""

    def run(batches):
        for b in batches:
            signs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            for tree in range(trees):
                node = signs[:, tree].astype(np.int64) * trees + tree
                yield pa.RecordBatch.from_arrays([pa.array(node), b.column(0), b.column(1)], names=["node", "set_key", "sign"])

    return run


def margin(numerator: int, denominator: int) -> int:
    """Coordinates that must agree: what the threshold predicts less five standard deviations."""
    t = numerator / denominator
    return max(1, int(COORDINATES * t - 5 * (COORDINATES * t * (1 - t)) ** 0.5))


def search(signs: np.ndarray, members: np.ndarray, agree: int, seed: int, depth: int = 0) -> Iterator[tuple[int, int]]:
    """Loose links in a node, as (pivot, member)."""
    rest, queue = members, []
    budget = 48 * len(members) if depth < DEPTH and len(members) > LEAF else None
    while len(rest) and (budget is None or budget > 0):
        if queue:
            at = queue.pop()
        else:
            at, rest = rest[0], rest[1:]
        near = (signs[rest] == signs[at]).sum(axis=1) >= agree
        budget = budget and max(0, budget - len(rest))
        yield from ((at, x) for x in rest[near])
        queue.extend(rest[near])
        rest = rest[~near]
    if not len(rest):
        return
    left = np.array([*queue, *rest], dtype=np.int64)
    rng = np.random.default_rng((seed, depth))
    for coordinate in rng.choice(COORDINATES, 2, replace=False):
        values = signs[left, coordinate]
        order = np.argsort(values, kind="stable")
        for part in np.split(left[order], np.flatnonzero(np.diff(values[order])) + 1):
            if len(part) > 1:
                yield from search(signs, part, agree, seed, depth + 1)


def runs(batches, keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows with equal values in the first `keys` columns."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_pylist() for i in range(keys)]
        rows = list(zip(*cols, strict=True))
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if rows[start] != now:
                if held:
                    yield now, held
                now, held = rows[start], []
            held.append(b.slice(start, end - start))
    if held:
        yield now, held


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])


def joining(links: Iterator[tuple[int, int]], labels: list[bytes]) -> Iterator[tuple[int, int]]:
    """The links that join two labels which no link before has joined."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for a, b in links:
        x, y = top(labels[a]), top(labels[b])
        if x != y:
            up[x] = y
            yield a, b


def stars(links: Iterator[tuple[int, int]], labels: list[bytes]) -> list[tuple[bytes, bytes]]:
    """What the links connect: the smallest label of each group with each other label of it."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for a, b in links:
        x, y = top(labels[a]), top(labels[b])
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(top(x), x) for x in list(up)]


def _nodes(agree: int):
    def run(batches):
        out = []
        for (node,), parts in runs(batches, 1):
            keys, signs, labels = ([x for p in parts for x in p.column(i).to_pylist()] for i in (1, 2, 3))
            if len(keys) > 1:
                matrix = np.frombuffer(b"".join(signs), np.uint32).reshape(-1, COORDINATES)
                order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
                out.extend(stars(search(matrix, order, agree, node % (1 << 31)), labels))
                if len(out) > 50_000:
                    yield _links(out)
                    out = []
        yield _links(out)

    return run


def _searched(nodes: DataFrame, agree: int, parts: int) -> DataFrame:
    """a, b: what loose links connect in nodes that are searched in one task each, by labels, which are linked with their rows already."""
    return nodes.select("node", "set_key", "sign", "label").repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_nodes(agree), "a binary, b binary")


_MET = "node long, set_key binary, sign binary, label binary, pivot binary"


def _meet(agree: int):
    """Members of a part of a node against its pivots: the first near one, and the label of its group.

    A pivot is of the group of the first pivot before it that is near. Members link with pivots of other labels only.
    """

    def run(batches):
        for (node, _), parts in runs(batches, 2):
            keys, signs, labels, chosen = ([x for p in parts for x in p.column(i).to_pylist()] for i in range(2, 6))
            matrix = np.frombuffer(b"".join(signs), np.uint32).reshape(-1, COORDINATES)
            pivots = sorted((i for i, c in enumerate(chosen) if c), key=keys.__getitem__)
            members = np.array([i for i, c in enumerate(chosen) if not c], np.int64)
            if not len(members):
                continue
            group = {}
            for i in pivots:
                group[i] = next((group[j] for j in group if (matrix[i] == matrix[j]).sum() >= agree), labels[i])
            found = np.full(len(members), -1)
            for i in pivots:
                found[((matrix[members] == matrix[i]).sum(axis=1) >= agree) & (found < 0)] = i
            rows = list(zip(members.tolist(), found.tolist(), strict=True))
            columns = [keys[r] for r, _ in rows], [signs[r] for r, _ in rows], [group[i] if i >= 0 else labels[r] for r, i in rows], [keys[i] if i >= 0 and labels[i] != labels[r] else None for r, i in rows]
            yield pa.RecordBatch.from_arrays([pa.array([node] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["node", "set_key", "sign", "label", "pivot"])

    return run


def _near_rest(signs: np.ndarray, rest: np.ndarray, group: np.ndarray, agree: int, within: bool) -> Iterator[tuple[int, int]]:
    """Loose links of each row of `rest` with one of the group, and, if `within`, with rows of `rest`."""
    own = signs[group]
    for n, at in enumerate(rest):
        yield from ((at, x) for x in group[np.flatnonzero((own == signs[at]).sum(axis=1) >= agree)[:1]])
        if within:
            after = rest[n + 1 :]
            yield from ((at, x) for x in after[(signs[after] == signs[at]).sum(axis=1) >= agree])


def _meet_group(agree: int):
    """Rows apart from the node's largest group against a part of it, and in the first part against each other."""

    def run(batches):
        out = []
        for (_, salt), parts in runs(batches, 2):
            keys, signs, labels, apart = ([x for p in parts for x in p.column(i).to_pylist()] for i in range(2, 6))
            matrix = np.frombuffer(b"".join(signs), np.uint32).reshape(-1, COORDINATES)
            rest = np.array(sorted((i for i, x in enumerate(apart) if x), key=keys.__getitem__), np.int64)
            members = np.array([i for i, x in enumerate(apart) if not x], np.int64)
            out.extend((keys[a], keys[x]) for a, x in joining(_near_rest(matrix, rest, members, agree, not salt), labels))
            if len(out) > 50_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _group_links(met: DataFrame, few: DataFrame, agree: int, parts: int, node_rows: int) -> DataFrame:
    """a, b: loose links of the nodes `few` (node, most, rows, rest) between their largest groups and the rest, and within the rest."""
    rows = met.join(few, "node").withColumn("apart", F.col("label") != F.col("most"))
    salts = F.greatest(F.ceil((F.col("rows") - F.col("rest")) / node_rows).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("set_key"), salts).cast("int")
    dealt = rows.select("node", F.explode(F.when(F.col("apart"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(own))).alias("salt"), "set_key", "sign", "label", "apart")
    return dealt.repartition(parts, "node", "salt").sortWithinPartitions("node", "salt").mapInArrow(_meet_group(agree), "a binary, b binary")


def _children(with_sign: bool):
    """Two rows for each member: the node's children by the values of two coordinates that its name chooses."""

    def run(batches):
        for b in (b for b in batches if b.num_rows):
            node = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            signs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            for i in (1, 2):
                with np.errstate(over="ignore"):
                    name = _mix(node + _U(i) * _U(0x9E3779B97F4A7C15))
                    value = signs[np.arange(len(node)), (name % _U(COORDINATES)).astype(np.int64)]
                    child = pa.array(_mix(name ^ (value.astype(np.uint64) * _U(0xD6E8FEB86659FD93))).view(np.int64))
                if with_sign:
                    yield pa.RecordBatch.from_arrays([child, *(b.column(k) for k in (1, 2, 3))], names=["node", "set_key", "sign", "label"])
                else:
                    yield pa.RecordBatch.from_arrays([child, b.column(3)], names=["node", "label"])

    return run


def loose_links(nodes: DataFrame, agree: int, parts: int, node_rows: int = NODE_ROWS, levels: int = LEVELS) -> DataFrame:
    """a, b from (node, set_key, sign): pairs that connect what loose links connect in the nodes."""
    held, links = nodes.withColumn("label", F.col("set_key")), []
    for _ in range(levels):
        large = held.groupBy("node").agg(F.count("*").alias("rows")).where(F.col("rows") > node_rows).checkpoint()
        n = large.count()
        if not n:
            break
        few = F.broadcast(large) if n <= FEW_NODES else large
        links.append(_searched(held.join(few, "node", "left_anti"), agree, parts))
        members = held.join(few, "node").withColumn("salts", F.ceil(F.col("rows") / node_rows).cast("int")).checkpoint()
        pivots = [F.min(F.struct(F.xxhash64("label", F.lit(j)).alias("h"), "set_key", "sign", "label")).alias(f"p{j}") for j in range(PIVOTS)]
        chosen = members.groupBy("node", "salts").agg(*pivots).select("node", "salts", F.explode(F.array_distinct(F.array(*(F.col(f"p{j}").dropFields("h") for j in range(PIVOTS))))).alias("p"))
        chosen = chosen.select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "p.*", F.lit(True).alias("chosen"))
        dealt = members.select("node", F.pmod(F.xxhash64("set_key"), F.col("salts")).cast("int").alias("salt"), "set_key", "sign", "label", F.lit(False).alias("chosen")).unionByName(chosen)
        met = dealt.repartition(parts, "node", "salt").sortWithinPartitions("node", "salt").mapInArrow(_meet(agree), _MET).checkpoint()
        links.append(met.where("pivot is not null").select(F.col("pivot").alias("a"), F.col("set_key").alias("b")))
        groups = met.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.sum("n").alias("rows"), F.max("n").alias("_n"))
        groups = groups.select("node", "most", "rows", (F.col("rows") - F.col("_n")).alias("rest")).where("rest > 0").checkpoint()  # nodes of one group are done
        few = groups.where(F.col("rest") <= node_rows)
        if n := few.count():
            links.append(_group_links(met, F.broadcast(few) if n <= FEW_NODES else few, agree, parts, node_rows))
        many = groups.where(F.col("rest") > node_rows).select("node")
        n = many.count()
        if not n:
            held = None
            break
        met = met.join(F.broadcast(many) if n <= FEW_NODES else many, "node", "left_semi")
        label = F.xxhash64("label")
        mixed = met.mapInArrow(_children(False), "node long, label binary").groupBy("node").agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low < high").select("node").checkpoint()
        n = mixed.count()
        held = met.mapInArrow(_children(True), "node long, set_key binary, sign binary, label binary").join(F.broadcast(mixed) if n <= FEW_NODES else mixed, "node", "left_semi").checkpoint()
    searched = links if held is None else [_searched(held, agree, parts), *links]
    out = searched[0]
    for more in searched[1:]:
        out = out.unionByName(more)
    return out


def exact_links(sets: list[np.ndarray], numerator: int, denominator: int) -> Iterator[tuple[int, int]]:
    """Links that connect the same sets as all links of the group do, by breadth-first search on the full sets."""
    sizes = np.array([len(s) for s in sets])
    whole, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    rest, queue = np.arange(len(sets)), []
    while len(rest):
        if queue:
            at = queue.pop()
        else:
            at, rest = rest[0], rest[1:]
        own, n = sets[at], sizes[at]
        fits = (denominator * np.minimum(sizes[rest], n) >= numerator * np.maximum(sizes[rest], n)).nonzero()[0]
        near = np.zeros(len(rest), bool)
        for i in range(0, len(fits), 2000):
            part = rest[fits[i : i + 2000]]
            lengths = sizes[part]
            firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            values = whole[np.repeat(starts[part] - firsts, lengths) + np.arange(lengths.sum())]
            place = np.minimum(np.searchsorted(own, values), n - 1)
            shared = np.add.reduceat((own[place] == values).astype(np.int64), firsts)
            near[fits[i : i + 2000]] = denominator * shared >= numerator * (n + lengths - shared)
        yield from ((at, x) for x in rest[near])
        queue.extend(rest[near])
        rest = rest[~near]


def _verify(numerator: int, denominator: int):
    def run(batches):
        out = []
        for _, parts in runs(batches, 3):
            by_key = {}
            for p in parts:
                by_key.update(zip(p.column(3).to_pylist(), p.column(4).to_pylist(), strict=True))
            keys = sorted(by_key)
            out.extend(stars(exact_links([np.frombuffer(by_key[k], np.uint64) for k in keys], numerator, denominator), keys))
            if len(out) > 50_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _verify_pivots(numerator: int, denominator: int):
    """Members of a block against the component's pivots, by full sets: the first that is linked, or none."""

    def run(batches):
        for _, parts in runs(batches, 2):
            keys, sets, chosen = ([x for p in parts for x in p.column(i).to_pylist()] for i in range(2, 5))
            pivots = [(k, np.frombuffer(x, np.uint64)) for k, x, c in zip(keys, sets, chosen, strict=True) if c]
            a, b = [], []
            for key, x in ((k, np.frombuffer(x, np.uint64)) for k, x, c in zip(keys, sets, chosen, strict=True) if not c):
                for k, own in pivots:
                    shared = int(np.isin(x, own, assume_unique=True).sum()) if denominator * min(len(x), len(own)) >= numerator * max(len(x), len(own)) else 0
                    if denominator * shared >= numerator * (len(x) + len(own) - shared):
                        a.append(k)
                        b.append(key)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _verified(dealt: DataFrame, numerator: int, denominator: int, parts: int) -> DataFrame:
    """a, b from (root, i, j, set_key, shingles): what exact links connect of the sets that meet in (root, i, j)."""
    return dealt.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verify(numerator, denominator), "a binary, b binary")


def large_links(large: DataFrame, numerator: int, denominator: int, parts: int, block_shingles: int) -> DataFrame:
    """a, b from (root, set_key, n_shingles, shingles, block, blocks): links that connect what all exact links connect."""
    pivots = [F.min(F.struct(F.xxhash64("set_key", F.lit(j)).alias("h"), "set_key", "shingles")).alias(f"p{j}") for j in range(4)]
    chosen = large.groupBy("root", "blocks").agg(*pivots).select("root", "blocks", F.explode(F.array_distinct(F.array(*(F.col(f"p{j}").dropFields("h") for j in range(4))))).alias("p"))
    chosen = chosen.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "p.*", F.lit(True).alias("chosen"))
    dealt = large.select("root", "block", "set_key", "shingles", F.lit(False).alias("chosen")).unionByName(chosen)
    met = dealt.repartition(parts, "root", "block").sortWithinPartitions("root", "block").mapInArrow(_verify_pivots(numerator, denominator), "a binary, b binary").checkpoint()
    labels = large.select("root", "set_key").join(met.select(F.col("b").alias("set_key"), F.col("a").alias("label")), "set_key", "left")
    groups = labels.where("label is not null").groupBy("root", "label").agg(F.count("*").alias("n"))
    largest = groups.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("_most"))
    rest = large.join(labels.drop("root"), "set_key").join(largest, "root", "left").withColumn("_apart", ~F.coalesce(F.col("label") == F.col("_most"), F.lit(False)))
    apart = rest.where("_apart").groupBy("root").agg(F.sum("n_shingles").alias("_n"))
    rest = rest.join(apart, "root").checkpoint()  # components with one group are done
    rest = rest.withColumn("_others", F.ceil(F.col("_n") / F.lit(block_shingles)).cast("int"))
    whole = rest.select("root", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_others") - 1)).alias("j"), "set_key", "shingles")
    few = rest.where("_apart").select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("set_key", F.lit(7)), F.col("_others")).cast("int").alias("j"), "set_key", "shingles")
    return met.unionByName(_verified(whole.unionByName(few), numerator, denominator, parts))


def _full_sets(width: int):
    def run(batches):
        known = worker_cache().setdefault("shingle words", {})
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            keys, sets = [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, width, known)
                keys.append(_key(s) if len(s) else None)
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "set_key", "shingles"])

    return run


def near_components(docs: DataFrame, width: int = 3, trees: int = TREES, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, block_shingles: int = BLOCK_SHINGLES, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    n = shuffle_parts(spark)
    rows = text_of(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
    sketches = rows.mapInArrow(_sketch(width), "doc_id long, n_shingles long, set_key binary, sign binary").checkpoint()
    classes = sketches.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("owner"), F.max("n_shingles").alias("n_shingles"), F.first("sign").alias("sign"))

    nodes = classes.select("set_key", "sign").mapInArrow(_branch(trees), "node long, set_key binary, sign binary")
    loose = loose_links(nodes, margin(numerator, denominator), 2 * n, node_rows)
    rooted = components(loose)

    members = classes.select("set_key", "owner", "n_shingles").join(rooted.select(F.col("node").alias("set_key"), "root"), "set_key")
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n_shingles") / F.lit(block_shingles)).cast("int").alias("blocks"))
    members = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")).checkpoint()
    counted = members.agg(F.count_if(F.col("blocks") <= 1).alias("small"), F.count_if(F.col("blocks") > 1).alias("large")).first()

    def full(part: DataFrame, size: int) -> DataFrame:
        owners = part.select(F.col("owner").alias("doc_id"))
        texts = rows.join(F.broadcast(owners) if size <= FEW_NODES else owners, "doc_id", "left_semi")
        return texts.mapInArrow(_full_sets(width), "doc_id long, set_key binary, shingles binary").drop("doc_id").join(part, "set_key")

    one = full(members.where("blocks <= 1"), counted["small"]).select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), "set_key", "shingles")
    links = _verified(one, numerator, denominator, 2 * n)
    if counted["large"]:
        links = links.unionByName(large_links(full(members.where("blocks > 1"), counted["large"]).checkpoint(), numerator, denominator, 2 * n, block_shingles))

    linked = components(links).select(F.col("node").alias("set_key"), "root")
    grouped = classes.select("set_key", "owner").join(linked, "set_key", "left").select("set_key", F.coalesce("root", "set_key").alias("root"), "owner").checkpoint()
    least = grouped.groupBy("root").agg(F.min("owner").alias("component_id"))
    found = grouped.join(least, "root").select("set_key", "component_id")
    out = sketches.drop("sign").join(found, "set_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    real = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return out.select(real("doc_id"), "n_shingles", real("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_representatives(docs: DataFrame, **how) -> DataFrame:
    """The input rows that stay, with all their columns, whatever their names."""
    keep = near_components(docs, **how).where("kept").select(F.col("doc_id").alias("_keep")).distinct()
    rows = docs.select(row_of(docs).alias("_row"), docs["doc_id"].cast("long").alias("_id"))
    return rows.join(keep, rows["_id"].eqNullSafe(keep["_keep"]), "left_semi").select("_row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))


OP9_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM t),
e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id
"""
