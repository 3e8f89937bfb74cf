"""Byte-level BPE encoding and decoding with forced boundaries.

No merge ever joins two bytes that never stand side by side inside a token, so such a pair of bytes marks a certain cut:
the fragments on both sides are encoded on their own and their ids are put one after the other. Cuts are made twice.
Texts are cut between a visible character and ASCII white space, where each pre-token of a byte-level tokenizer ends, so
no merge reaches over it either; such fragments repeat, so their ids are kept in a worker. A new fragment is split by the pre-tokenizer of the file, each
pre-token is cut at all its forced boundaries, and the library's merges run on each piece between two cuts, in n log n of
its length; pieces repeat more than words do, and are kept as well.

Defined results: null text is empty text, with no ids; repeated rows are encoded one by one; null ids pass through; very
long texts are encoded whole; an empty table gives no rows; other columns are not looked at. Strings of added tokens are
that one token, as in the library. Ids outside the vocabulary decode to nothing, as there.
"""

from __future__ import annotations

import json
import re
import struct
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of, worker_cache

CACHE_ENTRIES = 350_000
BATCH_TEXTS = 100
SHORT = 48  # characters of what is kept
LATIN_END = chr(0x250)
SIMPLE = re.compile(r" ?[!-~]+")
SIMPLE_TOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+")
ASCII_SPACE = "\t\n\v\f\r "
OTHER_SPACE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def vocabulary() -> str:
    """Default file."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
    return [others.get(b, chr(b)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder of one vocabulary file; `pairs` are the characters that stand side by side in some token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [x for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(x)]
        split = spec["pre_tokenizer"]
        if odd or spec["normalizer"] or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"not a plain byte-level vocabulary: {odd}")
        library = Tokenizer.from_file(path)
        self.split, self.model = library.pre_tokenizer.pre_tokenize_str, library.model
        self.ids: dict[str, int] = model["vocab"]
        self.pairs = {token[i : i + 2] for token in self.ids for i in range(len(token) - 1)}
        letters = byte_characters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        a = re.escape(ASCII_SPACE)
        # A cut needs a visible character before it: after other white space the pre-token may go on.
        self.fragment = re.compile(f"[{a}]*[^{a}]+(?:(?<=[{OTHER_SPACE}])[{a}]+[^{a}]*)*|[{a}]+")
        # Texts without these are cut at their single spaces.
        self.unusual = [*OTHER_SPACE, *(c + " " for c in ASCII_SPACE)]
        self.latin = {i: "".join(letters[b] for b in chr(i).encode()) for i in range(ord(LATIN_END))}
        self.blank, self.known, self.pieces = letters[32], {}, {}

    def cuts(self, token: str) -> list[str]:
        """The pieces of a pre-token between its forced boundaries."""
        out, at, pairs = [], 0, self.pairs
        for i, pair in enumerate(map(add, token, token[1:]), 1):
            if pair not in pairs:
                out.append(token[at:i])
                at = i
        out.append(token[at:])
        return out

    def _encode_piece(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece)
        packed = struct.pack(f"<{len(tokens)}i", *[t.id for t in tokens])
        if len(self.pieces) >= CACHE_ENTRIES:
            self.pieces.clear()
        if len(piece) <= SHORT:
            self.pieces[piece] = packed
        return packed

    def _encode_fragment(self, fragment: str) -> bytes:
        if SIMPLE.fullmatch(fragment):  # ASCII without inner white space, split as the pre-tokenizer does
            tokens = [t.replace(" ", self.blank) for t in SIMPLE_TOKEN.findall(fragment)]
        elif (word := fragment[1:] if fragment[0] == " " else fragment).isalpha() and max(word) < LATIN_END:  # one pre-token
            tokens = [fragment.translate(self.latin)]
        else:
            tokens = [t for t, _ in self.split(fragment)]
        known, encode = self.pieces.get, self._encode_piece
        packed = b"".join([known(p) or encode(p) for t in tokens for p in self.cuts(t)])
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        if len(fragment) <= SHORT:
            self.known[fragment] = packed
        return packed

    def fragments(self, text: str) -> list[str]:
        if not text.strip(" ") or text[-1] in ASCII_SPACE or any(map(text.__contains__, self.unusual)):
            return self.fragment.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]

    def _plain(self, text: str) -> bytes:
        known, encode = self.known.get, self._encode_fragment
        return b"".join([known(f) or encode(f) for f in self.fragments(text)])

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        added = {s: np.array([i], dtype="<i4").tobytes() for s, i in self.added.items()}
        return b"".join(added.get(part) or self._plain(part) for part in self.special.split(text))


class Decoder:
    """Bytes of ids: one row of bytes for the whole vocabulary, from which tokens are taken by place and width."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_characters())}
        tokens = {i: b"".join(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.size = max(tokens) + 1
        self.width = np.array([len(tokens.get(i, b"")) for i in range(self.size)] + [0])
        self.begin = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(self.size)), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)  # the last place is of width 0
        width = self.width[ids]
        ends = np.cumsum(width)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.begin[ids] - ends + width, width) + np.arange(total)].tobytes().decode("utf-8", errors="replace")


def _coder(kind, path: str):
    cache = worker_cache()
    name = (kind.__name__, path)
    return cache.get(name) or cache.setdefault(name, kind(path))


def _parts(batches):
    return (b.slice(i, BATCH_TEXTS) for b in batches for i in range(0, b.num_rows, BATCH_TEXTS))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: one row per input row."""
    path = path or vocabulary()

    def run(batches):
        coder = _coder(ForcedBoundaryBPE, path)
        for b in _parts(batches):
            packed = [coder.encode(text) for text in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text from doc_id, ids; null ids give null."""
    path = path or vocabulary()

    def run(batches):
        coder = _coder(Decoder, path)
        for b in _parts(batches):
            ids = b.column(1)
            values, ends = ids.flatten().to_numpy(), np.cumsum(ids.value_lengths().fill_null(0).to_numpy())
            parts = np.split(values, ends[:-1])
            texts = [coder.decode(part) if known else None for part, known in zip(parts, ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode(encode(documents(spark, sf_dir)))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
