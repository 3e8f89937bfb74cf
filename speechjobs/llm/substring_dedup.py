"""Repeated passages by prefix-free parsing and suffix arrays.

A rolling hash over `GRAM` bytes triggers phrases: a window of `LENGTH` bytes belongs to the gram in it with the
smallest hash, and a phrase is a maximal run of windows with one trigger. Neighbouring phrases overlap by
`LENGTH` - 1 bytes, so each window lies in one phrase, and equal windows have equal triggers wherever they stand.

1. Documents are dealt by id into groups of bounded size. A group sends its distinct triggers, in blobs by hash
   range; a trigger that only one document has cannot hold a repeat and gets a zero bit back.
2. A group sends its distinct phrases with repeated triggers, each with its smallest doc_id: the dictionary. The
   blob of a range of triggers holds all windows that can be equal. The suffix array of the dictionary, sorted to
   window length, together with the parse (which group has which phrase, from which document on) gives each window
   its first document in the corpus. A bit per window goes back: whether that is before the phrase's own first.
3. In its group, an occurrence of a phrase is a repeat where an earlier document of the group has the phrase, or the
   bit is set. The bytes that repeats cover are removed.

All that goes between groups is one entry per distinct trigger or phrase of a group, however often it occurs there,
so a passage in a third of all documents is one entry a group. A trigger that stands in more than `HOT_PHRASES` different
phrases, as a stock phrase in ever new contexts does, would send them all to one range: its windows are dealt out one by
one, by a hash of their own bytes. Ranges grow with the text, so that the dictionary of one stays small; they are dealt over at
most `PARTITIONS` shuffle partitions, in which they come sorted and one is held at a time. The text is shuffled once, by id and text, so rows that share an id, or have none, are
not one group.

Defined results: null text is empty; a document never repeats itself or rows with its own id; null ids come last;
documents shorter than a window stay whole; a very long text is one document of its group, read whole; equal texts with
different ids are repeats of the smallest; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of
from .near_dedup import runs

LENGTH, GRAM = 50, 20
GROUP_BYTES = 8 << 20
CHUNK = 1 << 17
HOT_PHRASES = 50_000
PARTITIONS = 8192
LAST = (1 << 63) - 1
_U = np.uint64
_TOP = _U(np.iinfo(np.uint64).max)
_PLACE = _U((1 << 18) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit rolling hashes of all grams of 20 bytes, by doubling."""
    m = 0x9E3779B97F4A7C15
    power = lambda k: _U(pow(m, k, 1 << 64))
    h1 = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)[data]

    def joined(h, gap):
        out = h[:-gap] * power(gap)
        out += h[gap:]
        return out

    h2 = joined(h1, 1)
    h4 = joined(h2, 2)
    h16 = joined(joined(h4, 4), 8)
    h = h16[: len(data) - GRAM + 1] * power(4)
    h += h4[16 : 16 + len(data) - GRAM + 1]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


class Parse:
    """The phrases of a group of documents: start, number of windows, trigger and document of each."""

    def __init__(self, ids: list[int], bodies: list[bytes]):
        self.ids, self.bodies = np.array(ids, np.int64), bodies
        self.sizes = np.array([len(b) for b in bodies], np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.text = b"".join(bodies)
        data = np.frombuffer(self.text, np.uint8)
        ends = self.firsts + self.sizes
        span, starts, counts, triggers, names = LENGTH - GRAM + 1, [], [], [], []
        for at in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
            part = data[at : at + CHUNK + LENGTH - 1]
            hashes = gram_hashes(part)
            least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
            width = 1
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
            # windows that would cross a document's end are none
            for d in range(np.searchsorted(ends, at, "right"), len(ends)):
                if self.firsts[d] >= at + len(least):
                    break
                least[max(self.firsts[d], ends[d] - LENGTH + 1, at) - at : ends[d] - at] = _TOP
            cuts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            lengths = np.diff(np.concatenate([cuts, [len(least)]]))
            real = least[cuts] != _TOP
            cuts, lengths = cuts[real], lengths[real]
            starts.append(cuts + at)
            counts.append(lengths)
            chosen = hashes[(least[cuts] & _PLACE).astype(np.int64)] * _U(0x9E3779B97F4A7C15)
            triggers.append(chosen ^ (chosen >> _U(29)))  # smallest hashes crowd at 0: spread them over the ranges again
            names.append(hashes[cuts] * _U(0xD6E8FEB86659FD93) + hashes[cuts + lengths + LENGTH - GRAM - 1] + lengths.astype(np.uint64))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.starts, self.counts, self.triggers = join(starts, np.int64), join(counts, np.int64), join(triggers, np.uint64)
        self.names = join(names, np.uint64)  # of phrases with one trigger, alike if equal
        self.split = np.zeros(len(self.starts), bool)
        self.docs = self.ids[np.searchsorted(self.firsts, self.starts, "right") - 1] if len(self.starts) else np.zeros(0, np.int64)

    def distinct_triggers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted triggers, whether two documents of the group have it, and in how many different phrases it stands."""
        order = np.argsort(self.triggers)
        t = self.triggers[order]
        if not len(t):
            return t, np.zeros(0, bool), np.zeros(0, np.uint32)
        new = np.concatenate([[True], t[1:] != t[:-1]])
        shared = ~(new & np.concatenate([new[1:], [True]]))  # most triggers stand once: only the others are sorted by name
        again = order[shared]
        order[shared] = again[np.lexsort((self.names[again], self.triggers[again]))]
        d, n = self.docs[order], self.names[order]
        cuts = np.flatnonzero(new)
        fresh = new | np.concatenate([[True], n[1:] != n[:-1]])
        return t[cuts], np.minimum.reduceat(d, cuts) != np.maximum.reduceat(d, cuts), np.add.reduceat(fresh.astype(np.uint32), cuts, dtype=np.uint32)

    def split_phrases(self, hot: np.ndarray) -> None:
        """Each window of a phrase with such a trigger becomes a phrase of its own, with a hash of its bytes as trigger."""
        import xxhash

        place = np.minimum(np.searchsorted(hot, self.triggers), max(len(hot) - 1, 0))
        mask = hot[place] == self.triggers if len(hot) else np.zeros(len(self.triggers), bool)
        if not mask.any():
            return
        n = self.counts[mask]
        at = np.repeat(self.starts[mask] - np.cumsum(n) + n, n) + np.arange(n.sum())
        own = np.array([xxhash.xxh3_64_intdigest(self.text[a : a + LENGTH]) for a in at.tolist()], np.uint64)
        self.docs = np.concatenate([self.docs[~mask], np.repeat(self.docs[mask], n)])
        self.split = np.concatenate([self.split[~mask], np.ones(len(at), bool)])
        self.starts, self.counts, self.triggers = np.concatenate([self.starts[~mask], at]), np.concatenate([self.counts[~mask], np.ones(len(at), np.int64)]), np.concatenate([self.triggers[~mask], own])

    def phrases(self, repeated: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Occurrences (by number) whose trigger is repeated, and their bytes."""
        place = np.minimum(np.searchsorted(repeated, self.triggers), max(len(repeated) - 1, 0))
        which = np.flatnonzero((repeated[place] == self.triggers) | self.split) if len(repeated) else np.flatnonzero(self.split)
        text = self.text
        return which, [text[a:b] for a, b in zip(self.starts[which].tolist(), (self.starts + self.counts + LENGTH - 1)[which].tolist(), strict=True)]


def _ranges(sorted_triggers: np.ndarray, bits: int) -> np.ndarray:
    """Where each hash range begins and the last ends."""
    return np.searchsorted(sorted_triggers >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _deltas(values: np.ndarray) -> bytes:
    """Differences of sorted numbers, by byte planes, which compress well."""
    return np.ascontiguousarray(np.diff(values, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _parse_of(table: pa.Table) -> Parse:
    """In the order of ids and bytes, so that every pass cuts the group's text alike, however its rows arrive."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("body").to_pylist(), strict=True))
    return Parse([r[0] for r in rows], [r[1] for r in rows])


_SENT = "part int, grp long, blob binary, extra binary, owners binary"


def _sent(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "grp", "blob", "extra", "owners"])


def _send_triggers(bits: int):
    def run(key, table):
        triggers, several, phrases = _parse_of(table).distinct_triggers()
        at = _ranges(triggers, bits)
        return _sent([(i, key[0].as_py(), _deltas(triggers[a:b]), np.packbits(several[a:b]).tobytes(), phrases[a:b].tobytes()) for i, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a])

    return run


def _parts(batches) -> Iterator[tuple[int, list[tuple]]]:
    for (part,), held in runs(batches, 1):
        yield part, [r for b in held for r in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.binary()))], names=["grp", "part", "kind", "bits"])


_BACK = "grp long, part int, kind string, bits binary"


def _repeated_triggers(hot_phrases: int):
    """Two bits per sent trigger: whether two documents of the corpus have it, and whether it stands in too many phrases."""

    def run(batches):
        for part, rows in _parts(batches):
            lists = [_values(r[1]) for r in rows]
            ends = np.cumsum([len(v) for v in lists])[:-1]
            several = [np.unpackbits(np.frombuffer(r[2], np.uint8), count=len(v)).astype(bool) for r, v in zip(rows, lists, strict=True)]
            values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
            repeated = counts > 1
            repeated[inverse[np.concatenate(several)]] = True
            phrases = np.bincount(inverse, np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows]), minlength=len(values))
            for kind, of in (("trigger", repeated), ("hot", repeated & (phrases > hot_phrases))):
                if of.any():
                    yield _batch([(r[0], part, kind, np.packbits(f).tobytes()) for r, f in zip(rows, np.split(of[inverse], ends), strict=True)])

    return run


def _chosen(parse: Parse, back: pa.Table, bits: int) -> np.ndarray:
    """The group's repeated triggers, from the bits it got back; phrases of those in too many phrases are split."""
    triggers = np.unique(parse.triggers)
    at, out = _ranges(triggers, bits), {"trigger": [], "hot": []}
    for part, kind, flags in zip(*(back.column(c).to_pylist() for c in ("part", "kind", "bits")), strict=True):
        if kind in out:
            own = triggers[at[part] : at[part + 1]]
            out[kind].append(own[np.unpackbits(np.frombuffer(flags, np.uint8), count=len(own)).astype(bool)])
    repeated, hot = (np.sort(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in out.values())
    parse.split_phrases(hot)
    return repeated


def _dictionary(parse: Parse, which: np.ndarray, phrases: list[bytes], bits: int) -> dict[int, tuple[list[bytes], dict[bytes, int]]]:
    """Hash range to its sorted distinct phrases, and each phrase's smallest doc_id."""
    out: dict[int, dict[bytes, int]] = {}
    for part, phrase, doc in zip((parse.triggers[which] >> _U(64 - bits)).tolist(), phrases, parse.docs[which].tolist(), strict=True):
        owners = out.setdefault(part, {})
        if owners.setdefault(phrase, doc) > doc:
            owners[phrase] = doc
    return {part: (sorted(owners), owners) for part, owners in out.items()}


def _send_phrases(bits: int):
    def run(key, docs, back):
        parse = _parse_of(docs)
        which, phrases = parse.phrases(_chosen(parse, back, bits))
        rows = []
        for part, (names, owners) in _dictionary(parse, which, phrases, bits).items():
            rows.append((part, key[0].as_py(), b"".join(names), np.array([len(x) for x in names], np.uint8).tobytes(), np.array([owners[x] for x in names], np.int64).tobytes()))
        return _sent(rows)

    return run


def suffix_order(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that begin at `starts` in the order of their first LENGTH bytes, and which differ from the one before."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    keys = [np.ascontiguousarray(words[starts + i]).view(">u8").ravel().astype(np.uint64) for i in (*range(0, LENGTH - 7, 8), LENGTH - 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(starts), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


def _first_owners(batches):
    """A bit per window of each sent phrase: whether a document before the phrase's own first has it."""
    for part, rows in _parts(batches):
        ids: dict[bytes, int] = {}
        own, first = [], []
        for _, blob, extra, owners in rows:
            ends = np.cumsum(np.frombuffer(extra, np.uint8).astype(np.int64)).tolist()
            own.append(np.array([ids.setdefault(blob[a:b], len(ids)) for a, b in zip([0, *ends], ends, strict=False)], np.int64))
            first.append(np.frombuffer(owners, np.int64))
        names = list(ids)
        least = np.full(len(names), LAST, np.int64)
        for i, d in zip(own, first, strict=True):
            np.minimum.at(least, i, d)
        sizes = np.array([len(x) for x in names], np.int64)
        windows = sizes - LENGTH + 1
        begin = np.concatenate([[0], np.cumsum(windows)[:-1]])
        inside = np.arange(windows.sum()) - np.repeat(begin, windows)
        text = np.frombuffer(b"".join(names), np.uint8)
        order, new = suffix_order(text, np.repeat(np.cumsum(sizes) - sizes, windows) + inside)
        of = np.repeat(least, windows)[order]
        classes = np.cumsum(new) - 1
        earliest = np.empty(len(order), np.int64)
        earliest[order] = np.minimum.reduceat(of, np.flatnonzero(new))[classes]
        out = []
        for (group, *_), i, d in zip(rows, own, first, strict=True):
            n = windows[i]
            at = np.repeat(begin[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((group, part, "window", np.packbits(earliest[at] < np.repeat(d, n)).tobytes()))
        yield _batch(out)


def _remove(bits: int, with_text: bool):
    def run(key, docs, back):
        parse = _parse_of(docs)
        which, phrases = parse.phrases(_chosen(parse, back, bits))
        dictionary = _dictionary(parse, which, phrases, bits)
        flags = {p: np.unpackbits(np.frombuffer(b, np.uint8)) for p, k, b in zip(*(back.column(c).to_pylist() for c in ("part", "kind", "bits")), strict=True) if k == "window"}
        offset, place = 0, {}
        whole = []
        for part, (names, _) in dictionary.items():
            counts = [len(x) - LENGTH + 1 for x in names]
            at = offset
            for x, n in zip(names, counts, strict=True):
                place[part, x] = at
                at += n
            whole.append(flags[part][: sum(counts)])
            offset = at
        flag = np.concatenate(whole) if whole else np.zeros(0, np.uint8)
        cover = np.zeros(len(parse.text) + 1, np.int16)
        parts = (parse.triggers[which] >> _U(64 - bits)).tolist()
        docs_of = parse.docs[which]
        first = np.array([dictionary[p][1][x] for p, x in zip(parts, phrases, strict=True)], np.int64)
        later = docs_of > first
        starts, counts = parse.starts[which], parse.counts[which]
        np.add.at(cover, starts[later], 1)
        np.add.at(cover, (starts + counts + LENGTH - 1)[later], -1)
        s, n = starts[~later], counts[~later]
        at = np.array([place[p, x] for p, x, l in zip(parts, phrases, later.tolist(), strict=True) if not l], np.int64)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        windows = (np.repeat(s, n) + inside)[flag[np.repeat(at, n) + inside].astype(bool)]
        np.add.at(cover, windows, 1)
        np.add.at(cover, windows + LENGTH, -1)
        gone = np.cumsum(cover[:-1]) > 0
        data, out = np.frombuffer(parse.text, np.uint8), ([], [], [], [], [], [])
        for doc, a, size in zip(parse.ids.tolist(), parse.firsts.tolist(), parse.sizes.tolist(), strict=True):
            g = gone[a : a + size]
            kept = data[a : a + size][~g].tobytes() if g.any() else parse.text[a : a + size]
            spans = int((g[1:] & ~g[:-1]).sum() + g[0]) if size else 0
            for c, v in zip(out, (doc, size, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                c.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, group_bytes: int = GROUP_BYTES, with_text: bool = False, hot_phrases: int = HOT_PHRASES, partitions: int = PARTITIONS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept if wanted."""
    rows = text_of(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.col("text").cast("binary").alias("body"))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    bits = max(1, min(24, (groups - 1).bit_length() + 2))  # four ranges a group keep a range's dictionary small
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "body"), F.lit(groups)))
    by_group = rows.groupBy("grp")
    deal = lambda df: df.repartition(min(1 << bits, partitions), "part").sortWithinPartitions("part", "grp")
    triggers = deal(by_group.applyInArrow(_send_triggers(bits), _SENT)).mapInArrow(_repeated_triggers(hot_phrases), _BACK)
    phrases = by_group.cogroup(triggers.groupBy("grp")).applyInArrow(_send_phrases(bits), _SENT)
    windows = deal(phrases).mapInArrow(_first_owners, _BACK)
    done = by_group.cogroup(triggers.unionByName(windows).groupBy("grp")).applyInArrow(_remove(bits, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


OP3_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, 500 * k AS base, substr(h, 1000 * k + 1, 1098) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1000 + 1)) AS k FROM b)),
w AS (SELECT doc_id, base + j AS i, hash(substr(h, 2 * j + 1, 100)) AS s FROM (SELECT doc_id, base, h, unnest(range(0, least(500, length(h) // 2 - 49))) AS j FROM c)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT w.doc_id, i FROM w JOIN m ON w.s = m.s WHERE first < w.doc_id),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM r),
n AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
p AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY ALL),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM k JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM b LEFT JOIN t USING (doc_id)
"""
