"""Text expressions for articles: lexicon scores, tags, keys, availability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word; nested words each count."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def lexicon_score(text: Column, good: Sequence[str], bad: Sequence[str], most: int = 2) -> Column:
    score = sum((word_count(text, w) for w in good), F.lit(0.0)) - sum((word_count(text, w) for w in bad), F.lit(0.0))
    return F.greatest(F.least(score, F.lit(float(most))), F.lit(float(-most)))


def tags(text: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """The names whose words occur, joined by '|' in the given order."""
    hit = [F.when(F.greatest(*(F.contains(text, F.lit(w)) for w in ws), F.lit(False)), F.lit(name)) for name, ws in words.items()]
    return F.concat_ws("|", *hit)


def clean_list(text: Column, delimiters: str = "[,;|]") -> Column:
    """Parts of a delimited text, trimmed, without empty ones and "nan", each once."""
    parts = F.transform(F.split(text, delimiters), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan")))


def dedup_key(category: Column, url: Column, title: Column, time: Column) -> Column:
    return F.concat_ws("#", category, F.coalesce(F.nullif(url, F.lit("")), F.concat_ws("#", title, time.cast("string"))))


def available_date(time: Column, cutoff_hour: int) -> Column:
    """The day on which an article counts: from the cutoff hour on, the next one."""
    return F.when(F.hour(time) >= cutoff_hour, F.date_add(F.to_date(time), 1)).otherwise(F.to_date(time))


def mixed_time(text: Column) -> Column:
    """A time written in any of the usual forms; null where it is none of them."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm", "yyyyMMdd")
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms))
