"""Packing into token windows by minimum bin slack.

Documents are tokenised and end with one end id. A document longer than the window is cut into whole windows and a
rest. Rests are dealt by hash into groups of bounded size; in a group, each window starts from the longest rest left,
and a bitset subset-sum programme over the remaining lengths, with their counts, finds the multiset that fills the
window closest to its capacity. A pattern found is used as often as the counts allow. Only the few last windows of a
group carry padding.

Defined results: null text is empty text and gives the end id alone; equal rows are packed one by one, in no fixed order
among themselves; null ids pass through; a very long text gives as many whole windows as it fills; an empty table gives
no pieces; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slim_worker, text_of, worker_cache

WINDOW = 2048
END = 1
GROUP_DOCS = 4000
CACHE_UNITS = 600_000


def vocabulary() -> tuple[str, str, str]:
    """Default files: the tokenizer, the same vocabulary as ranks, and its pre-token pattern."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


class UnitTokenizer:
    """Ids of a text as packed little-endian 32-bit integers, equal to those of the tokenizer file.

    The pre-tokenizer starts a new token at a single space before a non-space, so a text is the concatenation of such
    units and the ids of a unit can be kept. New units of a batch are encoded together, by ranks, and cut apart by
    their byte lengths. Texts with the end-of-text string go through the tokenizer itself.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.by_ranks = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.units: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> None:
        """Each unit begins with a space, so their concatenation is cut where they begin."""
        ids = np.asarray(self.by_ranks.encode_to_numpy("".join(units)), dtype="<u4")
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(u.encode()) for u in units])) + 1
        data, start = ids.tobytes(), 0
        for unit, end in zip(units, (4 * ends).tolist(), strict=True):
            self.units[unit] = data[start:end]
            start = end

    def _whole(self, text: str) -> bytes:
        if self.SPECIAL in text:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.asarray(self.by_ranks.encode_to_numpy(text), dtype="<u4").tobytes() if text else b""

    def packed(self, texts: list[str]) -> list[bytes]:
        """For a few hundred texts at a time."""
        if len(self.units) > CACHE_UNITS:
            self.units.clear()
        parts = []
        for text in texts:
            if "  " in text or text[-1:].isspace() or text[:1].isspace() or self.SPECIAL in text:
                parts.append(self._whole(text))
            else:
                first, *rest = text.split(" ")
                parts.append((first, [" " + w for w in rest]))
        wanted = dict.fromkeys(u for p in parts if isinstance(p, tuple) for u in p[1] if u not in self.units)
        if wanted:
            self._learn(list(wanted))
        return [p if isinstance(p, bytes) else self._whole(p[0]) + b"".join(map(self.units.__getitem__, p[1])) for p in parts]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _tokenise(files: tuple[str, str, str], window: int, end: int):
    def run(batches):
        cache = worker_cache() if files in worker_cache() else slim_worker()
        tokenizer = cache.get(files) or cache.setdefault(files, UnitTokenizer(*files))
        tail = np.array([end], dtype="<u4").tobytes()
        for b in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            out = ([], [], [], [], [])
            for doc_id, ids in zip(b.column(0).to_pylist(), tokenizer.packed(b.column(1).to_pylist()), strict=True):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    for c, v in zip(out, (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is closest to target from below."""
    reach, steps, goal, mask = 1, [], 1 << target, (1 << target + 1) - 1
    for length in sorted((x for x in counts if x <= target), reverse=True):
        left, take = min(counts[length], target // length), 1
        while left and not reach & goal:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left, take = left - take, take * 2
        if reach & goal:
            break
    total, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= length * take
    return out


def patterns(counts: dict[int, int], window: int) -> Iterator[tuple[dict[int, int], int]]:
    """Multisets that fill windows, each with the number of windows that use it, until nothing is left."""
    counts = {k: v for k, v in counts.items() if v}
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen = fill({k: v for k, v in counts.items() if v}, window - seed)
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        yield chosen, times


def _pack(window: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable", na_position="last").reset_index(drop=True)
        by_length = {int(k): v.tolist() for k, v in pdf.groupby("length").indices.items()}
        sequence, offset, at = [0] * len(pdf), [0] * len(pdf), int(key[0]) << 32
        for chosen, times in patterns({k: len(v) for k, v in by_length.items()}, window):
            for _ in range(times):
                used = 0
                for length in sorted(chosen, reverse=True):
                    for _ in range(chosen[length]):
                        row = by_length[length].pop()
                        sequence[row], offset[row] = at, used
                        used += int(length)
                at += 1
        return pdf.assign(sequence_id=sequence, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, window: int = WINDOW, end: int = END, group_docs: int = GROUP_DOCS, files: tuple[str, str, str] | None = None) -> DataFrame:
    """Pieces of documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group_docs))
    pieces = text_of(docs).mapInArrow(_tokenise(files or vocabulary(), window, end), _PIECES)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(_pack(window), _PIECES + ", sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
