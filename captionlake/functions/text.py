"""Text, time and endpoint expressions, all built of Spark functions.

White space is Unicode white space (``(?U)\\s``), lengths count code points, case folding is ASCII
only unless said otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = r"!-/:-@\[-`{-~"  # ASCII


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words_of(text: Column) -> Column:
    """The words between white space, none of them empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def trim_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")


def ends_caption(text: Column) -> Column:
    """Whether a word ends a sentence for captions: closing quotes after the mark don't matter."""
    return text.rlike("[.!?][\"'”’]*$")


def ends_chunk(text: Column) -> Column:
    """Whether a segment ends a sentence for chunks: the mark must be last."""
    return text.rlike("[.!?]$")


def phrase_pattern(find: Column) -> Column:
    """A whole phrase, ASCII letters in any case, with no letter or number beside it.

    What stands before is looked at once the phrase is found, as that is seldom.
    """
    quoted = F.concat(F.lit(r"\Q"), F.replace(find, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit("(?i)"), quoted, F.lit(r"(?<![\p{IsAlphabetic}\p{N}]"), quoted, F.lit(r")(?![\p{IsAlphabetic}\p{N}])"))


def replacement(text: Column) -> Column:
    """text as a replacement in which no character is special."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def replace_phrase(text: Column, find: Column, replace: Column) -> Column:
    return F.regexp_replace(text, phrase_pattern(find), replacement(replace))


def count_phrase(text: Column, find: Column) -> Column:
    return F.regexp_count(text, phrase_pattern(find))


def term_key(text: Column) -> Column:
    """The ASCII letters and digits of a term, in lower case."""
    return ascii_lower(F.regexp_replace(text, "[^0-9A-Za-z]", ""))


def similarity(left: Column, right: Column) -> Column:
    """One less the share of edits between term keys, as a float; null where both are empty. right isn't folded."""
    left = term_key(left)
    longest = F.greatest(F.char_length(left), F.char_length(right))
    share = F.when(longest > 0, F.levenshtein(left, right) / longest)
    return F.lit(1.0).cast("float") - share.cast("float")


def seconds_to_ms(seconds: Column) -> Column:
    """Milliseconds, half away from zero; zero for null, negative and non-finite seconds."""
    fine = ~F.isnan(seconds) & (seconds > 0) & (seconds < float("inf"))
    return F.when(fine, F.round(seconds * 1000.0).cast("long")).otherwise(F.lit(0).cast("long"))


def parse_seconds(text: Column) -> Column:
    """Milliseconds of a number in a string; null where it is no number or negative."""
    seconds = text.try_cast("double")
    return F.when((seconds >= 0) & (seconds < float("inf")), F.round(seconds * 1000.0).cast("long"))


def _clock(ms: Column) -> list[Column]:
    return [F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000]


def srt_time(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", *(x.cast("long") for x in _clock(ms)))


def vtt_time(ms: Column) -> Column:
    h, m, s, f = (x.cast("long") for x in _clock(ms))
    return F.when(h > 0, F.format_string("%02d:%02d:%02d.%03d", h, m, s, f)).otherwise(F.format_string("%02d:%02d.%03d", m, s, f))


def chapter_time(ms: Column) -> Column:
    """Minutes, which may be more than 59, and seconds."""
    seconds = F.floor(ms / 1000)
    return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)


def span_text(start_ms: Column, end_ms: Column, text: Column) -> Column:
    return F.format_string("[%08.3fs - %08.3fs] %s", start_ms / 1000.0, end_ms / 1000.0, text)


def human_duration(ms: Column) -> Column:
    """Minutes and seconds, seconds with a tenth, or milliseconds."""
    seconds, tenths = F.floor(ms / 1000).cast("long"), F.floor(ms % 1000 / 100).cast("long")
    long = F.format_string("%dm %ds", F.floor(seconds / 60).cast("long"), seconds % 60)
    return F.when(seconds >= 60, long).when(ms >= 1000, F.format_string("%d.%ds", seconds, tenths)).otherwise(F.format_string("%dms", ms))


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)"


def clean_endpoint(url: Column) -> Column:
    """A URL without credentials, query, fragment and final slashes."""
    parts = [F.regexp_extract(url, _URL, n) for n in (1, 2, 3)]
    whole = F.concat(F.lower(parts[0]), F.lit("://"), F.lower(parts[1]), F.regexp_replace(parts[2], "/+$", ""))
    return F.when(url.rlike(_URL), whole).otherwise(F.lit("<invalid-url>"))


def is_remote(url: Column) -> Column:
    """Whether an endpoint is on another machine; what can't be read is."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.coalesce(~host.rlike(r"^(localhost|127(\.\d{1,3}){3}|\[::1\]|\[::ffff:(127(\.\d{1,3}){3}|7f[0-9a-f]{2}:[0-9a-f]{1,4})\])$"), F.lit(True))


def quoted(text: str) -> str:
    """A Python string as a pattern that matches just it."""
    return re.escape(text)
