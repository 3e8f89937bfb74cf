"""Exact duplicates by Patricia-trie owners.

Texts are normalised (runs of ASCII white space become one space) and dealt out by byte length and content hash.
Full byte strings are inserted into a compressed radix trie whose terminal nodes hold the smallest id and the number
of rows. A first trie per input partition folds copies before the shuffle, so a text that fills a third of the corpus
reaches the second stage as one row per partition. When a trie outgrows its memory, its largest subtree is emitted
and freed; the second stage merges such pieces.

Defined results: null text is empty text; equal rows with one doc_id are one member each, of which one stays; null
ids sort after all others, and so does the id 2^63 - 1, which is given back as null; very long texts are held and
compared whole; an empty table gives an empty result; other columns are not looked at, and keep_owners carries them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, row_of, shuffle_parts, slim_worker, text_of

LAST = (1 << 63) - 1


class _Node:
    __slots__ = ("label", "children", "owner", "count")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.count = label, None, None, 0


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Byte strings to (smallest id, number of rows)."""

    def __init__(self):
        self.root, self.bytes = _Node(b""), 0

    def insert(self, key: bytes, owner: int, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                leaf = _Node(key[at:])
                node.children[key[at]] = leaf
                self.bytes += len(leaf.label) + 200
                node = leaf
                break
            n = len(child.label)
            if key[at : at + n] != child.label:
                n = _common(child.label, key[at:])
                middle = _Node(child.label[:n])
                child.label = child.label[n:]
                middle.children = {child.label[0]: child}
                node.children[key[at]] = middle
                self.bytes += 200
                child = middle
            node, at = child, at + n
        node.owner = owner if node.owner is None else min(node.owner, owner)
        node.count += count

    @staticmethod
    def _entries(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, int, int]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.count:
                yield prefix, node.owner, node.count
            if node.children:
                stack.extend((c, prefix + c.label) for c in node.children.values())

    def entries(self) -> Iterator[tuple[bytes, int, int]]:
        return self._entries(self.root, b"")

    def spill(self) -> Iterator[tuple[bytes, int, int]]:
        """Takes out the subtree below the root that holds the most bytes."""
        sizes = {}
        for first, child in (self.root.children or {}).items():
            stack, size = [child], 0
            while stack:
                node = stack.pop()
                size += len(node.label) + 200
                stack.extend((node.children or {}).values())
            sizes[first] = size
        if sizes:
            first = max(sizes, key=sizes.get)
            child = self.root.children.pop(first)
            self.bytes -= sizes[first]
            yield from self._entries(child, child.label)


_SCHEMA = "n long, h long, body binary, owner long, rows long"


def _rows(entries: Iterator[tuple[bytes, bytes, int, int]]) -> Iterator[pa.RecordBatch]:
    """Record batches of about 8 MB from (head, body, owner, rows)."""
    cols, size = ([], [], [], [], []), 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["n", "h", "body", "owner", "rows"])

    for head, body, owner, count in entries:
        for c, v in zip(cols, (int.from_bytes(head[8:], "big"), int.from_bytes(head[:8], "big", signed=True), body, owner, count), strict=True):
            c.append(v)
        size += len(body) + 40
        if size > 8 << 20:
            yield batch()
            cols, size = ([], [], [], [], []), 0
    if cols[0]:
        yield batch()


def _fold(limit: int):
    """Trie per input partition: key is hash, length and full bytes, so subtrees below the root are of like size."""

    def entries(batches):
        slim_worker()
        trie = PatriciaTrie()
        for b in batches:
            for n, h, body, owner, count in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                trie.insert(h.to_bytes(8, "big", signed=True) + n.to_bytes(8, "big") + body, owner, count)
                while trie.bytes > limit:
                    for key, *rest in trie.spill():
                        yield key[:16], key[16:], *rest
        for key, *rest in trie.entries():
            yield key[:16], key[16:], *rest

    return lambda batches: _rows(entries(batches))


def _merge(batches):
    """Rows come sorted by length and hash; a trie lives for one such pair and is emitted when the next begins."""

    def entries():
        trie, head = PatriciaTrie(), None
        for b in batches:
            for n, h, body, owner, count in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                now = h.to_bytes(8, "big", signed=True) + n.to_bytes(8, "big")
                if now != head:
                    if head is not None:
                        yield from ((head, *e) for e in trie.entries())
                    trie, head = PatriciaTrie(), now
                trie.insert(body, owner, count)
        if head is not None:
            yield from ((head, *e) for e in trie.entries())

    return _rows(entries())


def exact_owners(docs: DataFrame, trie_bytes: int = 64 << 20) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, group_size."""
    spark = docs.sparkSession
    body = F.regexp_replace("text", SPACE, " ").cast("binary")
    keyed = text_of(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("owner"), body.alias("body")).select(F.octet_length("body").cast("long").alias("n"), F.xxhash64("body").alias("h"), "body", "owner", F.lit(1).cast("long").alias("rows"))
    folded = keyed.mapInArrow(_fold(trie_bytes), _SCHEMA)
    dealt = folded.repartition(shuffle_parts(spark), "n", "h").sortWithinPartitions("n", "h")
    merged = dealt.mapInArrow(_merge, _SCHEMA)
    return merged.select(F.sha2("body", 256).alias("text_sha256"), F.when(F.col("owner") != LAST, F.col("owner")).alias("keep_id"), F.col("rows").alias("group_size"))


def exact_dedup(docs: DataFrame, trie_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    rows = text_of(docs).select("doc_id", F.sha2(F.regexp_replace("text", SPACE, " ").cast("binary"), 256).alias("text_sha256")).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("_copies"))
    joined = rows.join(exact_owners(docs, trie_bytes), "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_i")).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), "text_sha256"
    )


def keep_owners(docs: DataFrame, trie_bytes: int = 64 << 20) -> DataFrame:
    """The input rows that stay, with all their columns, whatever their names.

    Of rows with equal id and text, the one whose other columns come first as JSON stays.
    """
    keep = exact_dedup(docs, trie_bytes).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.regexp_replace(F.coalesce(docs["text"].cast("string"), F.lit("")), SPACE, " ").cast("binary"), 256)
    rows = docs.select(row_of(docs).alias("_row"), F.to_json(row_of(docs, without="text")).alias("_rest"), docs["doc_id"].cast("long").alias("_id"), sha.alias("_own"))
    kept = rows.join(keep, rows["_id"].eqNullSafe(keep["_keep"]) & (rows["_own"] == keep["_sha"]), "left_semi")
    first = kept.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_own").orderBy("_rest")))
    return first.where("_nth = 1").select("_row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
