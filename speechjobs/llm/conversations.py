"""Repair of conversation structure at the least cost, by layers of reachable grammar states.

A conversation is read from its end. One integer a turn holds the layers of increasing cost, four bits a layer: bit s of
layer c says that the rest of the turns can be brought into the grammar from state s at cost c. An edit of cost e moves
all layers by e at once, and the layers are counted from the cheapest one, as two states never differ by more than a few
edits; so a turn costs a few shifts, however high the total. The first layer that holds the start state is the least
cost, and following its bits forward, the least letter first, gives the least audit.

States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn. The grammar is
`(s?(ua)+)?` over role initials.

Conversations of up to LONG_ROWS rows and LONG_BYTES bytes go through one sorted pass. Longer ones are put in order by
ranges of (conversation, turn), so that one that holds a third of all rows becomes many pieces; a piece gives its costs
between states, the pieces of a conversation are chained (one small row each), and each piece is then traced alone. Equal
rows are counted before they are sorted. Only the digest of the repaired text, which has no parallel form, runs through
blocks of one conversation in one task, in bounded memory. Both ways give the same rows.

Defined results: null role and text are one space, null ids and turns are one space in the damage key; null conv_id is
one conversation; rows of one turn are ordered by role and text; repeated rows are rows; very long texts are carried
whole; an empty table gives no rows; other columns are not looked at. Other roles than system, user and assistant are
told apart by their initial only, and one with another initial cannot be kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ensure_checkpoint_dir, shuffle_parts

LONG_ROWS, LONG_BYTES = 2000, 32 << 20
PIECE_ROWS, BLOCK_BYTES = 100_000, 1 << 20
INSERT, REROLE, DELETE, CUT = 3, 3, 4, 3
LAYERS = 20
ALL = (1 << 4 * LAYERS) - 1
COLUMN = sum(1 << 4 * i for i in range(LAYERS))  # state 0 in all layers
ACCEPT = [0, 6, 3, 0]  # what the end costs in each state
FAR = 1 << 60
LEGAL = {"su", "ua", "au"}


def word_of(costs: list[int]) -> tuple[int, int]:
    """The layers of costs by state, and the cost of the lowest layer."""
    base = min(costs)
    return sum(1 << 4 * (c - base) + s for s, c in enumerate(costs) if c - base < LAYERS), base


def costs_of(word: int, base: int) -> list[int]:
    """The lowest layer of each state."""
    out = []
    for s in range(4):
        bits = word >> s & COLUMN
        out.append(base + ((bits & -bits).bit_length() >> 2) if bits else FAR)
    return out


def _user(word: int) -> int:
    """States that a user turn brings to state 2."""
    x = word >> 2 & COLUMN
    return x | x << 1 | x << 3


def _assistant(word: int) -> int:
    return (word >> 3 & COLUMN) << 2


def _system(word: int) -> int:
    return word >> 1 & COLUMN


KEEPS = {"u": _user, "a": _assistant, "s": _system}


def _normal(word: int) -> tuple[int, int]:
    low = (word & -word).bit_length() - 1 >> 2
    return word >> 4 * low & ALL, low


def before_row(word: int, initial: str, cut: bool) -> tuple[int, int]:
    """Layers before a row that may be kept, from those after it; and by how much the lowest layer rose."""
    after = CUT if cut else 0
    new = word << 4 * DELETE | (_user(word) | _assistant(word)) << 4 * (REROLE + after)
    if initial in KEEPS:
        new |= KEEPS[initial](word) << 4 * after
    for _ in range(2):
        new |= (_user(new) | _assistant(new)) << 4 * INSERT
    return _normal(new)


class Rows:
    """Turns after damage, in order: initial, must go, cut off, how often (repeats of a row must go)."""

    def __init__(self, rows: Iterable[tuple[str, bool, bool, int]]):
        self.rows = list(rows)

    def layers(self, costs: list[int]) -> list[tuple[int, int]]:
        """Word and base before each row and after the last, from the costs after it."""
        word, base = word_of(costs)
        out = [(word, base)]
        for initial, gone, cut, times in reversed(self.rows):
            base += DELETE * (times if gone else times - 1)
            if not gone:
                word, rise = before_row(word, initial, cut)
                base += rise
            out.append((word, base))
        return out[::-1]

    def between(self) -> list[list[int]]:
        """Costs from each state before the rows to each state after them.

        No edit leads back to the states 0 and 1, so they end there only if all rows, or all but a kept one, go.
        """
        gone = DELETE * sum(r[3] for r in self.rows)
        keeps = [CUT if cut else 0 for initial, must, cut, _ in self.rows if not must and initial == "s"]
        out = [[FAR] * 4 for _ in range(4)]
        out[0][0] = out[1][1] = gone
        if keeps:
            out[0][1] = gone - DELETE + min(keeps)
        for end in (2, 3):
            # Inserts after the last row are those before the next piece's first.
            word, base = self.layers([0 if s == end else FAR for s in range(4)])[0]
            for s, c in enumerate(costs_of(word, base)):
                out[s][end] = c
        return out

    def trace(self, layers: list[tuple[int, int]], state: int) -> tuple[list[str], int]:
        """Letters of each row, inserts before it included, and the state after the last row."""
        word, base = layers[0]
        left = costs_of(word, base)[state]
        out = []
        for i, (initial, gone, cut, times) in enumerate(self.rows):
            letters, (now, low), (word, base) = "", layers[i], layers[i + 1]
            if gone:
                left -= DELETE * times
                out.append("D" * times)
                continue
            # Repeats go last; they cost the same wherever the first one's way leads.
            repeats = DELETE * (times - 1)

            def there(w: int, b: int, s: int, c: int) -> bool:
                return 0 <= c - b < LAYERS and bool(w >> 4 * (c - b) + s & 1)

            after, added = base + repeats, CUT if cut else 0
            while True:
                new = 3 if state == 2 else 2
                kept = {"u": state != 2 and 2, "a": state == 2 and 3, "s": state == 0 and 1}.get(initial, False)
                if there(word, after, state, left - DELETE):
                    letters, left = letters + "D", left - DELETE
                elif there(now, low, new, left - INSERT):
                    letters, state, left = letters + "I", new, left - INSERT
                    continue
                elif kept and there(word, after, kept, left - added):
                    letters, state, left = letters + "K", kept, left - added
                else:
                    letters, state, left = letters + "R", new, left - REROLE - added
                break
            left -= repeats
            out.append(letters + "D" * (times - 1))
        return out, state


def ending(state: int) -> str:
    """Inserts after the last row."""
    return ["", "II", "I", ""][state]


def repaired(rows: Iterable[tuple[str, str]], letters: Iterable[str], state: int) -> Iterator[str]:
    """The lines that stay, of (role, text) and the letters of each."""
    for (role, text), edits in zip(rows, letters, strict=True):
        for e in edits:
            if e == "K":
                state = {"u": 2, "a": 3, "s": 1}[role[0]]
                yield f"{role}:{text}"
            elif e in "IR":
                state = 3 if state == 2 else 2
                yield f"{'user' if state == 2 else 'assistant'}:{text if e == 'R' else ''}"


def facts(rows: list[tuple]) -> dict:
    """Counts of (turn, initial, blank, duplicate, cut, times) in order, with what the next piece's counts need."""
    out = {"rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "first": None, "last": None}
    for turn, initial, blank, duplicate, cut, times in rows:
        out["rows"] += times
        if blank:
            out["blank"] += times
        else:
            out["duplicate"] += times - (not duplicate)
            out["truncated"] += cut and not duplicate
        out["illegal"] += times - 1 + (out["last"] is not None and out["last"] + initial not in LEGAL)
        out["first"], out["last"] = initial if out["first"] is None else out["first"], initial
        if turn is not None and turn != out["high"]:
            out["turns"] += 1
            out["low"], out["high"] = turn if out["low"] is None else out["low"], turn
    return out


def chained(pieces: list[dict]) -> dict:
    """Facts of a conversation from those of its pieces in order."""
    total = dict(pieces[0])
    for p in pieces[1:]:
        for k in ("rows", "blank", "duplicate", "truncated", "illegal", "turns"):
            total[k] += p[k]
        total["illegal"] += total["last"] + p["first"] not in LEGAL
        total["last"] = p["last"]
        if p["low"] is not None:
            total["turns"] -= p["low"] == total["high"]
            total["low"], total["high"] = p["low"] if total["low"] is None else total["low"], p["high"]
    return total


def gaps(f: dict) -> int:
    return 0 if f["low"] is None else f["high"] - f["low"] + 1 - f["turns"]


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"


def repair_rows(rows: list[tuple]) -> tuple:
    """One conversation of (turn, role, text, times, blank, cut) in order: counts, cost, audit and repaired text."""
    seen, marked = set(), []
    for turn, role, text, times, blank, cut in rows:
        marked.append((turn, role[:1], blank, (role, text) in seen, cut, times))
        seen.add((role, text))
    if not marked:
        return 0, 0, 0, 0, 0, 0, "", ""
    f = facts(marked)
    turns = Rows((i, b or d, c, t) for _, i, b, d, c, t in marked)
    layers = turns.layers(ACCEPT)
    letters, state = turns.trace(layers, 0)
    lines = repaired([*((r[1], r[2]) for r in rows), ("", "")], [*letters, ending(state)], 0)
    return gaps(f), f["blank"], f["duplicate"], f["truncated"], f["illegal"], costs_of(*layers[0])[0], "".join(letters) + ending(state), "\n".join(lines)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times (0: dropped) with the planted faults."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def with_marks(rows: DataFrame) -> DataFrame:
    """Whether a text is blank, and whether its last visible character ends a sentence."""
    return rows.withColumn("blank", ~F.col("text").rlike(WORD)).withColumn("cut", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))


def _whole(batches):
    """Conversations one after the other from sorted rows."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

    def groups():
        now, rows = ("none",), []
        for b in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            for conv, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (conv,) != now:
                    if now != ("none",):
                        yield now[0], rows
                    now, rows = (conv,), []
                if row[3]:
                    rows.append(tuple(row))
        if now != ("none",):
            yield now[0], rows

    def batch(out):
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    out = []
    for conv, rows in groups():
        *counts, text = repair_rows(rows)
        out.append((conv, *counts, hashlib.sha256(text.encode()).hexdigest()))
        if len(out) == 1000:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


_FACTS = "rows long, blank long, duplicate long, truncated long, illegal long, turns long, low string, high string, first string, last string"


def _turns(pdf: pd.DataFrame) -> tuple[pd.DataFrame, Rows]:
    pdf = pdf.sort_values("pos")
    gone = pdf["blank"] | pdf["repeat"]
    return pdf, Rows(zip(pdf["initial"].tolist(), gone.tolist(), pdf["cut"].tolist(), pdf["times"].tolist(), strict=True))


def _piece(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, turns = _turns(pdf)
    turn = [t if known else None for known, t in zip(pdf["known"].tolist(), pdf["turn"].tolist(), strict=True)]
    f = facts(list(zip(turn, pdf["initial"].tolist(), pdf["blank"].tolist(), pdf["repeat"].tolist(), pdf["cut"].tolist(), pdf["times"].tolist(), strict=True)))
    texts = {k: None if f[k] is None else str(f[k]) for k in ("low", "high")}  # a null makes a float of a number in pandas
    return pd.DataFrame([{"key": key[0], "part": key[1], **f, **texts, "between": [c for row in turns.between() for c in row]}])


def _chain(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Facts of the conversation, and for each piece the costs after it."""
    pdf = pdf.sort_values("part")
    pieces = pdf.drop(columns=["between", "key", "part"]).to_dict("records")
    for p in pieces:
        p.update({k: None if p[k] is None else int(p[k]) for k in ("low", "high")})
    f, after, costs = chained(pieces), [], ACCEPT
    for between in pdf["between"].tolist()[::-1]:
        after.append(costs)
        costs = [min(FAR, min(int(between[4 * s + e]) + costs[e] for e in range(4))) for s in range(4)]
    row = {"key": key[0], "gaps": gaps(f), **{k: f[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": costs[0]}
    return pd.DataFrame([{**row, "part": p, "after": a} for p, a in zip(pdf["part"].tolist(), after[::-1], strict=True)])


def _trace(key, rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """Audits and last states of a piece for each state before it."""
    rows, turns = _turns(rows)
    layers = turns.layers([int(c) for c in ends["after"].iloc[0]])
    ways = [turns.trace(layers, s) if costs_of(*layers[0])[s] < FAR else ([], 0) for s in range(4)]
    return pd.DataFrame([{"key": key[0], "part": key[1], "audits": [" ".join(w[0]) for w in ways], "states": [w[1] for w in ways]}])


def _join(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The audit of each piece from the state before it; the last one also ends the conversation."""
    pdf, state, out = pdf.sort_values("part"), 0, []
    for part, audits, states in zip(pdf["part"].tolist(), pdf["audits"].tolist(), pdf["states"].tolist(), strict=True):
        out.append({"key": key[0], "part": part, "state": state, "audit": audits[state], "ending": ""})
        state = int(states[state])
    out[-1]["ending"] = ending(state)
    return pd.DataFrame(out)


def _blocks(key, rows: pd.DataFrame, audit: pd.DataFrame) -> pd.DataFrame:
    """The repaired lines of a piece in blocks of about a megabyte."""
    rows = rows.sort_values("pos")
    (at, letters, end) = audit[["state", "audit", "ending"]].iloc[0]
    texts = [*zip(rows["role"].tolist(), rows["text"].tolist(), strict=True), ("", "")]
    out, lines, size = [], [], 0
    for line in repaired(texts, [*letters.split(" "), end], int(at)):
        lines.append(line)
        size += len(line)
        if size > BLOCK_BYTES:
            out.append("\n".join(lines))
            lines, size = [], 0
    if lines:
        out.append("\n".join(lines))
    return pd.DataFrame({"key": [key[0]] * len(out), "part": key[1], "block": range(len(out)), "lines": out}).astype({"key": object, "lines": object})


def _digests(batches):
    """SHA-256 of each conversation's blocks, as they come in order."""
    now, digest = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])

    for b in (b.slice(i, 16) for b in batches for i in range(0, b.num_rows, 16)):
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    yield done()
                now, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(b"\n" + text.encode())
    if now is not None:
        yield done()


def _repair_long(rows: DataFrame, pieces: int) -> DataFrame:
    """Conversations of any length, in pieces."""
    ensure_checkpoint_dir(rows.sparkSession)
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    known = F.col("turn").isNotNull().cast("int")
    rows = rows.where("times > 0").withColumn("key", name)
    counted = rows.groupBy("key", "turn", "role", "text").agg(F.sum("times").alias("times")).withColumns({"known": known, "same": same})
    firsts = counted.groupBy("key", "same").agg(F.min(F.struct("known", "turn")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    marked = with_marks(counted.join(firsts, ["key", "same"], "left"))
    repeat = F.coalesce(~F.struct("known", "turn").eqNullSafe(F.col("_first")), F.lit(False))
    marked = marked.withColumn("repeat", F.col("_first").isNotNull() & repeat).drop("_first")
    # Borders of the ranges come from a sample that the driver sees, so they hold the beginning of a text only.
    dealt = marked.repartitionByRange(pieces, "key", "known", "turn", "role", F.substring("text", 1, 100)).sortWithinPartitions("key", "known", "turn", "role", "text")
    ordered = dealt.select("key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "known", F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "role", F.substring("role", 1, 1).alias("initial"), "text", "times", "blank", "repeat", "cut").checkpoint()

    slim = ordered.drop("text", "role")
    between = slim.groupBy("key", "part").applyInPandas(_piece, f"key string, part int, {_FACTS}, between array<long>").checkpoint()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    chain = between.groupBy("key").applyInPandas(_chain, f"key string, {counts}, part int, after array<long>").checkpoint()
    by = ["key", "part"]
    traced = slim.groupBy(*by).cogroup(chain.select(*by, "after").groupBy(*by)).applyInPandas(_trace, "key string, part int, audits array<string>, states array<int>")
    audits = traced.groupBy("key").applyInPandas(_join, "key string, part int, state int, audit string, ending string").checkpoint()
    blocks = ordered.select(*by, "pos", "role", "text").groupBy(*by).cogroup(audits.groupBy(*by)).applyInPandas(_blocks, "key string, part int, block int, lines string")
    digests = blocks.repartition("key").sortWithinPartitions("key", "part", "block").select("key", "lines").mapInArrow(_digests, "key string, repaired_sha256 string")
    letters = F.translate(F.concat("audit", "ending"), " ", "")
    whole = audits.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", letters.alias("a")))).getField("a"), "").alias("audit"))
    totals = chain.select("key", *_COUNTS).distinct()
    return totals.join(whole, "key").join(digests, "key", "left")


def repair_conversations(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, times); rows that come zero times only name it."""
    spark = rows.sparkSession
    sizes = rows.groupBy("conv_id").agg(F.sum(F.greatest("times", F.lit(1))).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size"))
    ensure_checkpoint_dir(spark)
    long = sizes.where((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select(F.col("conv_id").alias("_long"), "n").checkpoint()
    found = long.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    short = rows
    if found["k"]:
        # At most one id for LONG_ROWS rows or LONG_BYTES bytes; beyond the bound Spark joins by shuffling.
        ids = F.broadcast(long) if found["k"] <= 1_000_000 else long
        is_long = rows["conv_id"].eqNullSafe(ids["_long"])
        short = rows.join(ids, is_long, "left_anti")
    dealt = with_marks(short).repartition(shuffle_parts(spark), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    out = dealt.select("conv_id", "turn", "role", "text", "times", "blank", "cut").mapInArrow(_whole, _RESULT)
    if not found["k"]:
        return out
    pieces = max(shuffle_parts(spark), -(-found["n"] // piece_rows))
    done = _repair_long(rows.join(ids, is_long, "left_semi"), pieces)
    named = long.select(F.col("_long").alias("conv_id"), F.coalesce(F.col("_long").cast("string"), F.lit("none")).alias("key")).join(done, "key", "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.unionByName(named.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
faults AS (
  SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS f
  FROM keyed, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM faults),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
marked AS (
  SELECT conv_id, i, turn, role, text, substr(role, 1, 1) AS r, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
    substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) AS before FROM placed),
costed AS (SELECT *, blank OR dup AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM marked),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {c: 0::BIGINT, a: ''} AS s0, {c: 1000000000::BIGINT, a: ''} AS s1, {c: 3::BIGINT, a: 'I'} AS s2, {c: 6::BIGINT, a: 'II'} AS s3 FROM damaged
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, list_sort([n3, {c: m2.c + 3, a: m2.a || 'I'}])[1] FROM (
    SELECT conv_id, i, n0, n1, n3, list_sort([n2, {c: n0.c + 3, a: n0.a || 'I'}, {c: n1.c + 3, a: n1.a || 'I'}, {c: n3.c + 3, a: n3.a || 'I'}])[1] AS m2 FROM (
      SELECT s.conv_id, d.i, {c: s0.c + 4, a: s0.a || 'D'} AS n0,
        list_sort([{c: s1.c + 4, a: s1.a || 'D'}, {c: CASE WHEN r = 's' AND NOT gone THEN s0.c + more ELSE 2000000000 END, a: s0.a || 'K'}])[1] AS n1,
        list_sort([{c: s2.c + 4, a: s2.a || 'D'}] || list_transform([s0, s1, s3], lambda x: {c: CASE WHEN gone THEN 2000000000 ELSE x.c + more + CASE WHEN r = 'u' THEN 0 ELSE 3 END END, a: x.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END}))[1] AS n2,
        list_sort([{c: s3.c + 4, a: s3.a || 'D'}, {c: CASE WHEN gone THEN 2000000000 ELSE s2.c + more + CASE WHEN r = 'a' THEN 0 ELSE 3 END END, a: s2.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END}])[1] AS n3
      FROM steps s JOIN costed d ON d.conv_id IS NOT DISTINCT FROM s.conv_id AND d.i = s.i + 1))),
best AS (
  SELECT conv_id, least_way.c AS cost, least_way.a AS audit FROM (
    SELECT conv_id, list_sort([s0, s3])[1] AS least_way FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
letters AS (SELECT conv_id, p, substr(audit, p, 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
spots AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
outs AS (
  SELECT l.conv_id, l.p, l.e, l.o - max(CASE WHEN l.o = 1 AND l.e = 'K' AND d.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS o, d.role, d.text
  FROM spots l LEFT JOIN costed d ON d.conv_id IS NOT DISTINCT FROM l.conv_id AND d.i = l.i AND l.e <> 'I' WHERE l.e <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN o % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body FROM outs GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT blank AND NOT dup) AS truncated, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
