"""Work metadata and glossaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

# The head of the page's row of voice actors; entities of HTML, the ampersand last.
VOICES = "声優"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\u00A0", "&amp;": "&"}
KANA = "[\\u3040-\\u30FF]"
LATIN = "[A-Za-zＡ-Ｚａ-ｚ]"
HINT_CHARS = 250


def html_field(html: Column, tag: str) -> Column:
    """Trimmed text of the first such element, without inner tags; null if there is none."""
    return F.nullif(trimmed(F.regexp_replace(F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")), F.lit(""))


def page_metadata(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", html_field(F.col("html"), "title").alias("title"), html_field(F.col("html"), "h1").alias("heading"), F.nullif(F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1), F.lit("")).alias("lang"))


def _plain(html: Column) -> Column:
    """Text of a piece of HTML: without tags, the commonest entities read, trimmed; null if nothing is left."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.nullif(trimmed(text), F.lit(""))


def element_text(html: Column, attribute: str, value: str) -> Column:
    """Text of the first element whose attribute has the value among its words, with all that is nested in it."""
    opening = rf'(?s)<([A-Za-z][A-Za-z0-9]*)(?=[^>]*\s{attribute}="(?:[^"]*\s)?{value}(?:\s[^"]*)?")[^>]*>(.*)'
    tag, rest = F.regexp_extract(html, opening, 1), F.regexp_extract(html, opening, 2)
    pieces = F.split(rest, F.concat(F.lit("(?=</?"), tag, F.lit(r"\b)")))
    closes = lambda x: F.startswith(x, F.concat(F.lit("</"), tag))
    opens = lambda x: F.startswith(x, F.concat(F.lit("<"), tag))

    def add(state: Column, x: Column) -> Column:
        depth = state["depth"] + F.when(closes(x), -1).when(opens(x), 1).otherwise(0)
        inside = (state["depth"] > 0) & (depth > 0)
        return F.struct(F.when(state["depth"] > 0, depth).otherwise(0).alias("depth"), F.when(inside, F.concat(state["out"], x)).otherwise(state["out"]).alias("out"))

    held = F.aggregate(pieces, F.struct(F.lit(1).alias("depth"), F.lit("").alias("out")), add, lambda s: s["out"])
    return F.when(tag != "", _plain(held))


def cell_after(html: Column, head: str) -> Column:
    """Text of the table cell after the head cell with that text."""
    return _plain(F.nullif(F.regexp_extract(html, rf"(?s)<th[^>]*>\s*{head}\s*</th>\s*<td[^>]*>(.*?)</td>", 1), F.lit("")))


def product_page(html: Column) -> Column:
    """title, maker, voices and description of a product's page; what is absent is null."""
    return F.struct(element_text(html, "id", "work_name").alias("title"), element_text(html, "class", "maker_name").alias("maker"), cell_after(html, VOICES).alias("voices"), element_text(html, "class", "work_parts_container").alias("description"))


def product_id(text: Column, prefix: str = "RJ") -> Column:
    """The number in a product path, else the first such number, upper-cased; null if there is none."""
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(text, rf"(?i)product_id/({prefix}\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(text, rf"(?i)({prefix}\d+)", 1), F.lit(""))))


def split_names(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,、，／/]"), trimmed), lambda x: x != "")


def info_record(json: Column) -> Column:
    """Fields of a video record: text fields only if they are text, uploader from three places, tags that are text."""
    record = F.try_parse_json(json)
    part = lambda k: F.try_variant_get(record, f"$.{k}", "variant")
    is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    text = lambda k: F.when(is_text(part(k)), F.try_variant_get(record, f"$.{k}", "string"))
    tags = F.transform(F.filter(F.try_variant_get(record, "$.tags", "array<variant>"), is_text), lambda v: F.try_variant_get(v, "$", "string"))
    return F.struct(F.coalesce(text("id"), F.lit("unknown")).alias("id"), text("title").alias("title"), F.coalesce(text("uploader"), text("channel"), text("creator")).alias("uploader"), text("description").alias("description"), F.when(F.size(tags) > 0, tags).alias("tags"), text("webpage_url").alias("webpage_url"))


def file_lists(tracks: DataFrame) -> DataFrame:
    """work_id, files: a line for each track's path, in order."""
    return tracks.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("rel_path")), lambda p: F.concat(F.lit("- "), p)), "\n").alias("files"))


def markdown(title: Column, maker: Column, names: Column, description: Column, files: Column | None = None) -> Column:
    """The sections that are there, in a fixed order."""
    listed = F.concat(F.lit("## Files\n"), files) if files is not None else F.lit(None).cast("string")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.concat(F.lit("Maker: "), maker), F.when(F.size(names) > 0, F.concat(F.lit("Voices: "), F.array_join(names, ", "))), F.concat(F.lit("## Description\n"), description), listed)


def record_markdown(record: Column) -> Column:
    """The sections of a video's record (title, uploader, tags, description) that are there; an empty one is none."""
    section = lambda name, text: F.when(text != "", F.concat(F.lit(f"# {name}\n\n"), text, F.lit("\n\n"))).otherwise("")
    parts = (("Title", record["title"]), ("Creator", record["uploader"]), ("Tags", F.array_join(record["tags"], ", ")), ("Description", record["description"]))
    return F.concat(*(F.coalesce(section(name, text), F.lit("")) for name, text in parts))


def has_latin(text: Column) -> Column:
    return text.rlike(LATIN)


def latin_routes(entities: DataFrame) -> DataFrame:
    """Adds `list`: names with Latin letters are translated by the permissive rules, others by the strict ones."""
    return entities.withColumn("list", F.when(has_latin(F.col("ja")), F.lit("permissive")).otherwise(F.lit("strict")))


def track_titles(tracks: DataFrame, translated: DataFrame) -> DataFrame:
    """zh of each track (work_id, number, ja) by its number, else its own title."""
    return tracks.join(translated.select("work_id", "number", "zh"), ["work_id", "number"], "left").withColumn("zh", F.coalesce("zh", "ja"))


def merge_glossary(strict: DataFrame, loose: DataFrame) -> DataFrame:
    """Per kind and ja the last row wins, rows of the loose list after those of the strict; rows without a side go."""
    both = strict.withColumn("_list", F.lit(0)).unionByName(loose.withColumn("_list", F.lit(1))).where("ja <> '' and zh <> ''")
    return both.groupBy("work_id", "kind", "ja").agg(F.max_by("zh", F.struct("_list", "ord")).alias("zh"))


def lookup(names: DataFrame, glossary: DataFrame) -> DataFrame:
    """zh by kind and ja, else ja."""
    return names.join(glossary, ["work_id", "kind", "ja"], "left").withColumn("zh", F.coalesce("zh", "ja"))


def work_subset(entities: DataFrame, glossary: DataFrame, kinds: list[str]) -> DataFrame:
    """A work's translated entities by ja; of kinds that share a ja the last one in order counts."""
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return entities.join(glossary, ["work_id", "kind", "ja"]).groupBy("work_id", "ja").agg(F.max_by("zh", order).alias("zh"), F.max_by("kind", order).alias("kind"))


def glossary_faults(glossary: DataFrame) -> DataFrame:
    """zh with kana, or with Latin letters where ja has none."""
    return glossary.withColumn("kana", F.col("zh").rlike(KANA)).withColumn("latin", F.col("zh").rlike(LATIN) & ~has_latin(F.col("ja")))


def hint(text: Column) -> Column:
    return F.substring(trimmed(text), 1, HINT_CHARS)


def hint_faults(text: Column, forbidden: str) -> Column:
    return F.struct(text.rlike(forbidden).alias("symbols"), (F.length(text) > HINT_CHARS).alias("long"))


def fallback_glossary(works: DataFrame, known: DataFrame) -> DataFrame:
    """For works without extracted data: title, description as summary, and the voices (or uploader) with ja = zh."""
    left = works.join(known.select("work_id").distinct(), "work_id", "left_anti")
    names = F.when(F.size("voices") > 0, F.col("voices")).otherwise(F.array_compact(F.array("uploader")))
    return left.select("work_id", "title", F.coalesce("description", F.lit("")).alias("summary"), F.array_join(names, "|").alias("cvs"))
