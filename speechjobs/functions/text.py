"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = r"[\s\u00A0\u3000\uFEFF\p{P}\p{S}]"
BLANKS = r"^[\s\u00A0\u3000\uFEFF]+|[\s\u00A0\u3000\uFEFF]+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def effective(text: Column) -> Column:
    """Without white space, punctuation and symbols."""
    return F.regexp_replace(text, MARKS, "")


def normalised(text: Column) -> Column:
    return F.lower(effective(text))


def collapse_runs(text: Column) -> Column:
    """A character four times or more in a row becomes three and an ellipsis."""
    return F.regexp_replace(text, r"(.)\1{3,}", "$1$1$1…")


def strip_speaker(text: Column) -> Column:
    """Without a leading name of one to ten CJK characters and a colon."""
    return F.regexp_replace(text, r"^[\u3040-\u30FF\u3400-\u9FFF]{1,10}[\uFF1A:]\s*", "")


def lrc_time(ms: Column) -> Column:
    """[mm:ss.xx]; hundredths are rounded without a carry."""
    rest = F.pmod(ms, F.lit(60000))
    hundredths = F.floor((rest + 5) / 10)
    return F.format_string("[%02d:%02d.%02d]", F.floor(ms / 60000), F.floor(hundredths / 100), F.pmod(hundredths, F.lit(100)))


def vtt_time(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.pmod(F.floor(ms / 60000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def path_safe(text: Column) -> Column:
    """Percent-encodes what a path part cannot hold."""
    chars = F.split(text, "")
    unsafe = r'[%<>:"/\\|?*\x00-\x1F]'
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(unsafe), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")


def top_counts(text: Column) -> Column:
    """Counts of the characters of a text, largest first."""
    return F.sort_array(F.transform(F.array_distinct(F.split(text, "")), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))), asc=False)
