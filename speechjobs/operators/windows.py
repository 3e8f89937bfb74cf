"""Windows for batch translation: ids, glossary hits, budgets, request text."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoint_dir

MAX_CHARS, LEAST_SEGMENTS = 2500, 3
BAND, GROUP_ROWS, PIECE = 8192, 20_000, 4096  # characters of a band, bands of a group, segments of a piece


def translation_segments(segments: DataFrame, order: list[str]) -> DataFrame:
    """Ids from 1 in time order."""
    return segments.withColumn("id", F.row_number().over(Window.partitionBy("track_id").orderBy(*order)).cast("long"))


def _dealt(rows: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a work in groups of about `GROUP_ROWS`, and its terms once a group."""
    sizes = rows.groupBy("work_id").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("_groups"))
    salted = rows.join(sizes, "work_id").withColumn("_salt", F.pmod(F.xxhash64("track_id", F.get("ids", 0)), F.col("_groups")).cast("int")).drop("_groups")
    spread = terms.join(sizes, "work_id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")
    return salted, spread


def _spans(key, rows: pa.Table, terms: pa.Table) -> pa.Table:
    """Places of a work's terms in its bands, all in one reading of each text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, ja in zip(terms["term_id"].to_pylist(), terms["ja"].to_pylist(), strict=True):
        if ja:
            found.add_word(ja, (*found.get(ja, ()), (term, len(ja))))
    out = ([], [], [], [])
    if len(found):
        found.make_automaton()
        for track, text, width, starts, ids in zip(*(rows[c].to_pylist() for c in ("track_id", "text", "width", "starts", "ids")), strict=True):
            ends: dict[tuple[int, int], int] = {}
            for at, same in found.iter(text):
                last = ids[bisect_right(starts, at) - 1]
                for term, n in same:
                    if (begin := at - n + 1) < width:
                        ends.setdefault((term, ids[bisect_right(starts, begin) - 1]), last)
            for (term, first), last in ends.items():
                for column, value in zip(out, (track, term, first, last), strict=True):
                    column.append(value)
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["track_id", "term_id", "first", "id"])


def term_spans(bands: DataFrame, terms: DataFrame) -> DataFrame:
    """track_id, term_id, first, id: for each term of its work and part where a place begins, the part where one ends first.

    Bands (work_id, track_id, text, width, starts, ids) are texts made of parts: places that begin before `width` count,
    `starts` are the parts' first characters and `ids` their names. A group of bands meets its work's terms in one
    automaton, so a term costs no more for being long or frequent, and a large work is many groups.
    """
    rows, spread = _dealt(bands, terms.select("work_id", "term_id", "ja"))
    by = ["work_id", "_salt"]
    return rows.groupBy(*by).cogroup(spread.groupBy(*by)).applyInArrow(_spans, "track_id long, term_id long, first long, id long")


def glossary_hits(windows: DataFrame, terms: DataFrame) -> DataFrame:
    """Each window (work_id, track_id, window_idx, text) with the terms (work_id, ja) that its text holds: an array in order."""
    named = terms.where("ja <> ''").withColumn("term_id", F.dense_rank().over(Window.partitionBy("work_id").orderBy("ja")).cast("long"))
    whole = windows.select("work_id", "track_id", "text", F.length("text").alias("width"), F.array(F.lit(0)).alias("starts"), F.array(F.col("window_idx").cast("long")).alias("ids"))
    spans = term_spans(whole, named).select(F.col("track_id").alias("_track"), F.col("id").alias("_window"), "term_id")
    at = (windows["track_id"] == spans["_track"]) & (windows["window_idx"] == spans["_window"])
    hit = windows.drop("text").join(spans, at).drop("_track", "_window").join(named.select("work_id", "term_id", "ja").distinct(), ["work_id", "term_id"])
    listed = hit.groupBy("work_id", "track_id", "window_idx").agg(F.array_sort(F.collect_set("ja")).alias("terms"))
    return windows.drop("text").join(listed, ["work_id", "track_id", "window_idx"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def window_entries(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """work_id, track_id, window_idx, kind, ja: each window's glossary, as its work's cvs and characters, which always count, and
    the terms that it holds (hits); a window without any has one row of nulls. pairs: (work_id, kind, ja)."""
    entry = "array<struct<kind:string,ja:string>>"
    names = pairs.where("ja <> '' and kind in ('cv', 'character')").groupBy("work_id").agg(F.collect_set(F.struct("kind", "ja")).cast(entry).alias("_names"))
    terms = F.transform("terms", lambda x: F.struct(F.lit("term").alias("kind"), x.alias("ja"))).cast(entry)
    each = hits.join(names, "work_id", "left").withColumn("_e", F.explode_outer(F.concat(F.coalesce("_names", F.array().cast(entry)), terms)))
    return each.select("work_id", "track_id", "window_idx", "_e.kind", "_e.ja")


def glossary_names(terms: DataFrame) -> DataFrame:
    """work_id, names: the cvs and characters of a work, which count in each of its windows; those without ja never do."""
    return terms.where("ja <> '' and kind in ('cv', 'character')").groupBy("work_id").agg(F.array_sort(F.collect_set("ja")).alias("names"))


def text_bands(rows: DataFrame, overlap: DataFrame, width: int = BAND) -> DataFrame:
    """Bands of `width` characters of a track's running text, longer by the work's `overlap` (work_id, more) at the end.

    A segment goes to the bands that it touches, as the piece that lies there. The width is four times the overlap at least,
    so at most a quarter of the text is read twice.
    """
    by = Window.partitionBy("track_id").orderBy("id")
    placed = rows.where(F.length("text") > 0).withColumn("_n", F.length("text").cast("long")).withColumn("_end", F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("_at", F.col("_end") - F.col("_n")).join(overlap, "work_id").withColumn("width", F.greatest(F.lit(width).cast("long"), 4 * F.col("more")))
    first = F.floor(F.greatest(F.col("_at") - F.col("more"), F.lit(0)) / F.col("width"))
    cut = placed.withColumn("_band", F.explode(F.sequence(first, F.floor((F.col("_end") - 1) / F.col("width")))))
    left = F.col("_band") * F.col("width")
    cut = cut.withColumns({"_from": F.greatest(F.col("_at"), left), "_to": F.least(F.col("_end"), left + F.col("width") + F.col("more"))}).where("_from < _to")
    piece = F.struct((F.col("_from") - left).cast("int").alias("s"), "id", F.expr("substring(text, int(_from - _at + 1), int(_to - _from))").alias("t"))
    parts = cut.groupBy("work_id", "track_id", "_band", "width").agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    field = lambda c: F.transform("_p", lambda x: x[c])
    return parts.select("work_id", "track_id", F.array_join(field("t"), "").alias("text"), F.col("width").cast("int").alias("width"), field("s").alias("starts"), field("id").alias("ids"))


def term_places(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """track_id, id, term_id, chars, first: terms (work_id, term_id, ja, chars) by the segment `id` where a place ends.

    `first` is the segment where the place begins; a place may reach over the borders of segments, as their texts are
    read without a break. For each term and first segment the earliest end counts. term_id is a number of the work's own.
    """
    overlap = terms.where("ja <> ''").groupBy("work_id").agg((F.max(F.length("ja")) - 1).cast("long").alias("more"))
    spans = term_spans(text_bands(rows, overlap), terms).groupBy("track_id", "term_id", "first").agg(F.min("id").alias("id"))
    works = rows.select("track_id", "work_id").distinct()
    return spans.join(works, "track_id").join(terms.select("work_id", "term_id", "chars"), ["work_id", "term_id"]).select("track_id", "id", "term_id", "chars", "first")


def glossary_entry(ja: Column, zh: Column) -> Column:
    """One entry of the glossary text, at its depth of the layout."""
    return F.concat(F.lit('    {\n      "ja": '), json_text(ja), F.lit(',\n      "zh": '), json_text(zh), F.lit("\n    }"))


def glossary_text(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, glossary: cvs, characters and terms (kind, ord, ja, zh) as JSON in a layout of two spaces a level."""
    listed = pairs.withColumn("_e", glossary_entry(F.col("ja"), F.col("zh"))).groupBy(*keys, "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_e"))), lambda x: x["_e"]), ",\n").alias("_l"))
    part = lambda k: F.coalesce(F.concat(F.lit("[\n"), F.max(F.when(F.col("kind") == k, F.col("_l"))), F.lit("\n  ]")), F.lit("[]"))
    return listed.groupBy(*keys).agg(F.concat(F.lit('{\n  "cvs": '), part("cv"), F.lit(',\n  "characters": '), part("character"), F.lit(',\n  "terms": '), part("term"), F.lit("\n}")).alias("glossary"))


def glossary_overhead(pairs: DataFrame) -> DataFrame:
    """work_id, chars: length of a work's glossary text with all its names and no term."""
    return glossary_text(pairs.where("kind <> 'term'").select("work_id", "kind", "ord", "ja", "zh"), ["work_id"]).select("work_id", F.length("glossary").alias("chars"))


def window_glossary(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """track_id, window_idx, glossary: the glossary text of each window, with its work's names and the terms that it holds."""
    by = ["track_id", "window_idx"]
    terms = hits.select("work_id", *by, F.explode("terms").alias("ja")).join(pairs.where("kind = 'term'"), ["work_id", "ja"])
    names = hits.select("work_id", *by).join(pairs.where("kind <> 'term'"), "work_id")
    text = glossary_text(terms.select(*by, "kind", "ord", "ja", "zh").unionByName(names.select(*by, "kind", "ord", "ja", "zh")), by)
    return hits.select(*by).join(text, by, "left").withColumn("glossary", F.coalesce("glossary", F.lit(NO_ENTRIES)))


NO_ENTRIES = '{\n  "cvs": [],\n  "characters": [],\n  "terms": []\n}'
EMPTY_GLOSSARY = len(NO_ENTRIES)


def prompt_overhead(template: int, name: Column, summary: Column, glossary: Column) -> Column:
    """Characters of a window's prompt but for its terms and segments: the caller's template, the track's name, the work's
    summary, the glossary with its names, and the brackets of an empty transcript."""
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    return F.lit(template) + length(name) + length(summary) + F.coalesce(glossary, F.lit(EMPTY_GLOSSARY)) + len("[]")


def json_base(text: Column, start: Column, end: Column) -> Column:
    """Characters of a transcript line without its padded id."""
    return F.length(json_text(text)) + F.length(start.cast("string")) + F.length(end.cast("string")) + len('  {"id": , "text": , "start": , "end": }')


def json_text(text: Column) -> Column:
    packed = F.to_json(F.struct(text.alias("t")))
    return F.substring(packed, F.lit(6), F.length(packed) - 6)


class _Windows:
    """Greedy windows among rows with ids, bases and terms in order."""

    def __init__(self, ids: list[int], base: list[int], terms: list, overhead: int, limit: int, least: int):
        self.ids, self.base, self.terms, self.overhead, self.limit, self.least, self.known = ids, base, terms, overhead, limit, least, {}

    def end(self, start: int) -> int | None:
        """The row after the window that starts at a row; none if there are too few rows left for one."""
        if start in self.known:
            return self.known[start]
        ids, total, seen, at = self.ids, 0, {}, start
        while at < len(ids):
            more = seen
            if self.terms[at]:
                more = seen | {t["id"]: t["chars"] + 2 for t in self.terms[at] if t["first"] >= ids[start]}
            n = at - start + 1
            if n > self.least and self.overhead + sum(more.values()) + 2 * bool(more) + total + self.base[at] + n * len(str(ids[at])) + 2 * (n - 1) + 4 > self.limit:
                break
            total, seen, at = total + self.base[at], more, at + 1
        self.known[start] = at if start + self.least <= len(ids) else None
        return self.known[start]

    def path(self, start: int, stop: int) -> list[tuple[int, int]]:
        """(start, end) of the windows from a start on that begin before `stop`."""
        out = []
        while start < min(stop, len(self.ids)) and (end := self.end(start)) is not None:
            out.append((start, end))
            start = end
        return out


def _pieces(batches, columns: int):
    """(track, piece), the last `columns` of its first row, and its ids, bases, terms and overhead, from sorted rows."""
    now, rows = None, []

    def one():
        ids, base, terms, overhead = zip(*(r[:4] for r in rows), strict=True)
        return now, rows[0][len(rows[0]) - columns :], list(ids), list(base), list(terms), overhead[0]

    for b in batches:
        for track, piece, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (track, piece) != now:
                if rows:
                    yield one()
                now, rows = (track, piece), []
            rows.append(row)
    if rows:
        yield one()


def _numbers(rows, names: list[str]):
    """Record batches of whole numbers."""
    out = []
    for row in rows:
        out.append(row)
        if len(out) == 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)


def _links(limit: int, least: int, size: int, ahead: int):
    """For each row of a piece where its first window may start: where the next piece's does, how many windows lie between
    and where the last of them starts."""

    def links(batches):
        for (track, piece), _, ids, base, terms, overhead in _pieces(batches, 0):
            rows, first = _Windows(ids, base, terms, overhead, limit, least), piece * size + 1
            for at in range(1 if piece == 0 else min(ahead, size, len(ids))):
                way = rows.path(at, size)
                yield track, piece, first + at, first + (way[-1][1] if way else at), len(way), first + way[-1][0] if way else -1

    return lambda batches: _numbers(links(batches), ["track_id", "_piece", "entry", "exit", "n", "last_start"])


def _ranked(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The entry that each piece of a track has, the number of windows before it, and the window that reaches into it."""
    at, n, start, out = 1, 0, -1, []
    for piece, links in pdf.groupby("_piece"):
        out.append((piece, at, n, start))
        own = links[links["entry"] == at]
        if len(own):
            n, start, at = n + int(own["n"].iloc[0]), int(own["last_start"].iloc[0]) if own["n"].iloc[0] else start, int(own["exit"].iloc[0])
    return pd.DataFrame({"track_id": [key[0]] * len(out), **{c: [o[i] for o in out] for i, c in enumerate(("_piece", "entry", "before", "reaching"))}})


def _marked(limit: int, least: int, size: int):
    """Window and place in it of a piece's rows."""

    def marks(batches):
        for (track, piece), (entry, before, reaching), ids, base, terms, overhead in _pieces(batches, 3):
            first = piece * size + 1
            if entry is None:
                entry, before, reaching = 1, 0, -1
            if entry < first:  # too few rows are left for a window
                continue
            if before:
                yield from ((track, first + i, before - 1, first + i - reaching + 1) for i in range(min(entry - first, size, len(ids))))
            for k, (start, end) in enumerate(_Windows(ids, base, terms, overhead, limit, least).path(entry - first, size)):
                yield from ((track, first + i, before + k, i - start + 1) for i in range(start, min(end, size)))

    return lambda batches: _numbers(marks(batches), ["track_id", "id", "window_idx", "local_id"])


def budget_windows(rows: DataFrame, limit: int = MAX_CHARS, least: int = LEAST_SEGMENTS, keep_tail: bool = False, piece: int = PIECE) -> DataFrame:
    """track_id, id, window_idx, local_id from rows (track_id, id from 1 on, base, overhead, terms: array of (id, chars, first)).

    A window starts with `least` segments and grows while the track's overhead, the terms that its text holds and its
    transcript fit the limit. A tail of fewer than `least` gets no window unless keep_tail puts it in one of its own.

    Where a window ends depends on its start alone, and it holds a bounded number of segments. So a track is cut into pieces
    of segments, each with a few of the next one's: a piece tells for each start that it may be entered at where it is left,
    the pieces of a track are chained by these links, a few numbers each, and then each piece marks its rows. A track of one
    piece needs no links.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    slim = rows.select("track_id", "id", "base", "overhead", "terms").checkpoint()
    lowest = max(slim.agg(F.min("base")).first()[0] or 0, 0)
    ahead = max(least, limit // (lowest + 3)) + least + 2
    piece = max(piece, ahead)
    own = F.floor((F.col("id") - 1) / piece)
    spread = slim.withColumn("_piece", F.explode(F.when((own > 0) & ((F.col("id") - 1) % piece < ahead), F.array(own, own - 1)).otherwise(F.array(own))))
    by, columns = ["track_id", "_piece"], ["id", "base", "terms", "overhead"]
    tracks = slim.where(F.col("id") > piece).select("track_id").distinct()
    dealt = spread.join(tracks, "track_id", "left_semi").repartition(*by).sortWithinPartitions(*by, "id").select(*by, *columns)
    links = dealt.mapInArrow(_links(limit, least, piece, ahead), "track_id long, _piece long, entry long, exit long, n long, last_start long")
    entries = links.groupBy("track_id").applyInPandas(_ranked, "track_id long, _piece long, entry long, before long, reaching long")
    ready = spread.join(entries, by, "left").repartition(*by).sortWithinPartitions(*by, "id").select(*by, *columns, "entry", "before", "reaching")
    out = ready.mapInArrow(_marked(limit, least, piece), "track_id long, id long, window_idx long, local_id long")
    if keep_tail:
        out = out.checkpoint()
        tail = rows.select("track_id", "id").join(out, ["track_id", "id"], "left_anti")
        next_idx = out.groupBy("track_id").agg((F.max("window_idx") + 1).alias("window_idx"))
        local = F.row_number().over(Window.partitionBy("track_id").orderBy("id")).cast("long")
        out = out.unionByName(tail.join(next_idx, "track_id", "left").na.fill(0, ["window_idx"]).withColumn("local_id", local))
    return out


def token_budget(n_segments: Column, chars: Column, context: int = 8192) -> Column:
    p = F.greatest(F.lit(1), F.ceil(chars / 2))
    return F.greatest(F.lit(1), F.least(512 * n_segments, F.ceil(p * 3.5), F.greatest(F.lit(0), F.lit(context) - p), F.greatest(F.lit(0), F.lit(4096) - p)))


def transcript_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text for each window: a line a segment, ids padded to the width of the last."""
    last = F.max("local_id").over(Window.partitionBy(*keys))
    padded = F.substring(F.lpad(F.col("local_id").cast("string"), 19, " "), 20 - F.length(last.cast("string")), F.length(last.cast("string")))
    line = F.concat(F.lit('  {"id": '), padded, F.lit(', "text": '), json_text(F.col("text")), F.lit(', "start": '), F.col("start_ms").cast("string"), F.lit(', "end": '), F.col("end_ms").cast("string"), F.lit("}"))
    lines = rows.withColumn("_line", line).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("local_id", "_line"))).alias("_l"))
    return lines.select(*keys, F.concat(F.lit("[\n"), F.array_join(F.transform("_l", lambda x: x["_line"]), ",\n"), F.lit("\n]")).alias("transcript"))


def chunk_plan(tracks: DataFrame, chunk: int, stride: int, least: int) -> DataFrame:
    """Overlapping chunks of n_samples; a chunk shorter than `least` samples is left out."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_samples") - 1, F.lit(0)), F.lit(stride).cast("long"))
    out = tracks.where("n_samples > 0").select("track_id", "n_samples", F.posexplode(starts).alias("chunk_idx", "start"))
    return out.select("track_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "start", F.least(F.col("start") + chunk, "n_samples").alias("end")).where(F.col("end") - F.col("start") >= least)


def retry_split(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of attempts 3 (halves) and 4 (pairs) for each segment of a window."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("half", F.when(F.col("local_id") <= F.ceil(n / 2), 0).otherwise(1)).withColumn("pair", F.floor((F.col("local_id") - 1) / 2))
