"""Personal data by patterns and by information-theoretic sanitisation, with DataFrame operations only.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. Words of a document that holds an
entity may reveal it. What is protected has two levels, each single value and its kind as a whole, as most values stand in
one document only. Of N documents, n(c) hold c of either level, n(t) hold word t and n(c, t) hold both. The disclosure of c
by t is

    log2(n(c, t) * N / (n(c) * n(t))) / log2(N / n(c))

and is 1 for a word that is in documents of c only; n(c) counts as half of N at most. A word that is together with c in
`SUPPORT` different documents or more and whose disclosure reaches `GENERALISE` is a span of kind `term` wherever it stands
in a document of c: it is generalised to a tag, or removed from `REMOVE` on. Different are documents that differ in id or
text; all others count as often as they come. As n(c, t) is n(c) at most, words too frequent to disclose an entity are
left out before pairs are made, which changes no result. Patterns start at a word's border or where the last match ended
and never backtrack into a run, so the time is linear in the text.

Defined results: null text is empty text; equal rows give equal results and each counts in the statistics; null ids
pass through; very long texts are read whole, in time linear in their length; ties between words are none, as each is a
span of its own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, ensure_checkpoint_dir, text_of

LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
MARKS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"(?<!\S)[^\s\p{L}0-9@]*+(\p{L}[\p{L}\p{M}'’-]*+)[^\s\p{L}0-9@]*+(?!\S)"
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.length(digits).between(12, 19) & (F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


PART = 256


def _bound(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(values: Column) -> Column:
    """Running sums, in time of the square of the length."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")))["out"]


def running_sums(values: Column) -> Column:
    """Running sums by parts of `PART` values and the sums of the parts, so that a long array costs little more a value."""
    parts = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda j: _sums(F.slice(v, j * PART + 1, PART)))
    joined = lambda p: _bound(_sums(F.transform(p, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(F.transform(p, lambda x, j: F.transform(x, lambda y: y + F.when(j > 0, F.get(ends, j - 1)).otherwise(0)))))
    return F.when(F.size(values) > 0, _bound(values, lambda v: _bound(parts(v), joined))).otherwise(F.array().cast("array<int>"))


def placed(matches: Column, gaps: Column, valid) -> Column:
    """Structs (start, end, value) of the valid ones among the matches of a pattern, by the pieces that it splits off."""
    sizes = _bound(gaps, lambda g: F.transform(matches, lambda m, i: F.length(F.get(g, i)) + F.length(m)))
    kept = F.filter(F.transform(matches, lambda m, i: F.struct(i.alias("i"), m.alias("value"))), lambda x: valid(x["value"]))

    def one(ends: Column, x: Column) -> Column:
        end = F.get(ends, x["i"])
        return F.struct((end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.size(matches) > 0, _bound(kept, lambda k: F.when(F.size(k) > 0, _bound(running_sums(sizes), lambda ends: F.transform(k, lambda x: one(ends, x)))).otherwise(none))).otherwise(none)


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, found: the valid matches of all kinds, and the text where there is one."""
    rows = text_of(docs).withColumn("text_hash", F.xxhash64("text"))
    for kind, pattern in PATTERNS.items():
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if kind in MARKS:
            matches = F.when(F.contains("text", F.lit(MARKS[kind])), matches).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn(f"_{kind}", matches)
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(f"_{kind}_gaps", F.when(F.size(f"_{kind}") > 0, F.split("text", pattern, -1)))

    def part(i: int, kind: str) -> Column:
        valid = placed(F.col(f"_{kind}"), F.col(f"_{kind}_gaps"), lambda v: _valid(kind, v))
        return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    parts = [part(i, kind) for i, kind in enumerate(PATTERNS)]
    rows = rows.select("doc_id", "text_hash", F.concat(*parts).alias("found"), "text")
    return rows.withColumn("text", F.when(F.size("found") > 0, F.col("text")))


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["_doc_id"]) & (a["text_hash"] == b["_text_hash"])


def renamed(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})


def words_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(1)), F.lower))


def telling_words(docs: DataFrame, holders: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, text_hash, term, disclosure: the words of each document that disclose an entity of its own."""
    total = docs.count() or 1
    level = lambda value: F.transform("found", lambda x: F.concat(x["kind"].cast("string"), value(x)))
    contexts = F.array_distinct(F.concat(level(lambda x: x["value"]), level(lambda x: F.lit(""))))  # texts, which are told apart by hash; no value is empty: that is the kind
    each = holders.select("doc_id", "text_hash", "copies", F.explode(contexts).alias("x"))
    each = each.select("doc_id", "text_hash", "copies", F.substring("x", 1, 1).cast("int").alias("kind"), F.expr("substring(x, 2)").alias("value"))
    n_c = each.groupBy("kind", "value").agg(F.sum("copies").alias("n_c"), F.count("*").alias("docs")).where(F.col("docs") >= support)
    whole = F.log2(F.lit(float(total)) / F.least(F.col("n_c"), F.lit(max(total // 2, 1))))
    n_c = n_c.select("kind", "value", "n_c", whole.alias("whole"), (total * F.pow(F.lit(2.0), -generalise * whole) * (1 + 1e-9)).alias("most"))
    each = each.join(n_c, ["kind", "value"]).checkpoint()
    n_t = text_of(docs).select(F.explode(words_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= support)
    wanted = renamed(each.groupBy("doc_id", "text_hash").agg(F.max("most").alias("greatest")))
    words = holders.join(wanted, same_document(holders, wanted)).select("_doc_id", "_text_hash", "greatest", F.explode(words_of(F.col("text"))).alias("term"))
    words = words.join(n_t, "term").where(F.col("n_t") <= F.col("greatest")).select("_doc_id", "_text_hash", "term", "n_t")
    both = each.join(words, same_document(each, words) & (words["n_t"] <= each["most"])).drop("_doc_id", "_text_hash").checkpoint()
    pairs = both.groupBy("kind", "value", "term").agg(F.sum("copies").cast("double").alias("n_ct"), F.count("*").alias("docs"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t"), F.first("whole").alias("whole")).where(F.col("docs") >= support)
    gain = F.log2(F.col("n_ct") * F.lit(float(total)) / (F.col("n_c") * F.col("n_t")))
    telling = pairs.select("kind", "value", "term", F.try_divide(gain, F.col("whole")).alias("disclosure")).where(F.col("disclosure") >= generalise)
    return both.join(telling, ["kind", "value", "term"]).groupBy("doc_id", "text_hash", "term").agg(F.max("disclosure").alias("disclosure"))


def occurrences(holders: DataFrame, telling: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end, disclosure: every place of the telling words in their documents."""
    documents = renamed(telling.select("doc_id", "text_hash").distinct())
    rows = holders.join(documents, same_document(holders, documents), "left_semi")
    pieces = F.arrays_zip(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("whole"), F.transform(F.split("text", TERM, -1), F.length).alias("gap"))
    rows = rows.select("doc_id", "text_hash", F.posexplode(pieces).alias("i", "x")).where("x.whole is not null").select("doc_id", "text_hash", "i", "x.*")
    end = F.sum(F.col("gap") + F.length("whole")).over(Window.partitionBy("doc_id", "text_hash").orderBy("i"))
    inner = F.regexp_extract("whole", TERM, 1)
    rows = rows.withColumn("at", end - F.length("whole")).select("doc_id", "text_hash", F.lower(inner).alias("term"), (F.col("at") + F.instr("whole", inner) - 1).cast("int").alias("start"), F.length(inner).alias("n"))
    right = renamed(telling).withColumnRenamed("term", "_term")
    return rows.join(right, same_document(rows, right) & (rows["term"] == right["_term"])).select("doc_id", "text_hash", "start", (F.col("start") + F.col("n")).cast("int").alias("end"), "disclosure")


def find(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, text_hash, base, all_spans: structs (start, kind, end, disclosure), in order; base ones have none."""
    ensure_checkpoint_dir(docs.sparkSession)
    found = entities(docs).checkpoint()
    holders = found.where(F.size("found") > 0).groupBy("doc_id", "text_hash").agg(F.first("found").alias("found"), F.first("text").alias("text"), F.count("*").alias("copies"))
    telling = telling_words(docs, holders, support, generalise).checkpoint()
    spans = occurrences(holders, telling).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", F.lit(len(PATTERNS)).alias("kind"), "end", "disclosure")).alias("terms"))
    base = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(None).cast("double").alias("disclosure"))))
    left = found.select("doc_id", "text_hash", base.alias("base"))
    right = renamed(spans)
    joined = left.join(right, same_document(left, right), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,disclosure:double>>")
    return joined.select("doc_id", "text_hash", "base", F.array_sort(F.concat("base", F.coalesce("terms", none))).alias("all_spans"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id and text, with entities and generalised words replaced by a tag and removed words left out."""
    rows = text_of(docs).withColumn("text_hash", F.xxhash64("text"))
    spans = find(docs, support, generalise).select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), "all_spans").distinct()
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["_doc_id"]) & (rows["text_hash"] == spans["_text_hash"]))
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def add(state: Column, x: Column) -> Column:
        tag = F.when(x["disclosure"] >= remove, F.lit("")).otherwise(tags[x["kind"]])
        text = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, x["start"] - state["at"]), tag)
        moved = F.struct(x["end"].alias("at"), text.alias("out"))
        inside = F.struct(F.greatest(state["at"], x["end"]).alias("at"), state["out"].alias("out"))
        return F.when(x["start"] < state["at"], inside).otherwise(moved)

    done = F.aggregate("all_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    return joined.withColumn("_done", done).select("doc_id", F.concat("_done.out", F.substring(F.col("text"), F.col("_done.at") + 1, F.length("text"))).alias("text"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find(documents(spark, sf_dir))

    def count(i: int) -> Column:
        return F.size(F.filter("all_spans", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    return spans.select("doc_id", *map(count, range(len(PATTERNS))), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"), count(len(PATTERNS)))
