"""Season and part numbers in titles, search titles, and audio flags of stream titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season words for two to five, patterns of season and part numbers, of what search titles go without, and of subtitles and audio.
ORDINALS = {2: ("2nd", "second", "ii"), 3: ("3rd", "third", "iii"), 4: ("4th", "fourth", "iv"), 5: ("5th", "fifth", "v")}
NUMBERED = r"(?i)(?:season|part| s| s\.)\s*(\d+)"
NUMBER_TOKEN = r"(?:season|part| s| s\.)\s*\d+"
ORDINAL_TOKEN = r"\b(?:2nd|3rd|4th|5th|second|third|fourth|fifth)\s+season\b"
ROMAN_TOKEN = r"\b(?:i{2,3}|iv|v)\b"
SEASON_N = r"(?i)Season\s*(\d+)"
NTH_SEASON = r"(?i)(\d+)(?:st|nd|rd|th)\s*Season"
PART_N = r"(?i)(?:Part|Cour|Parte)\s*(\d+)"
SEASON_AT_END = r"(?i)(?:Season\s*\d+|\d+(?:st|nd|rd|th)\s*Season)\s*$"
NUMBER_AT_END = r"\s(\d+)$"
SEASON_SUFFIX = r"(?i)\s*(?:-|–|—)?\s*\(?\s*(Stagione|Season)\s*\d+\s*\)?\s*"
SUBTITLES = (r"(?i)\[[^\]]*?subs?[^\]]*?\]", r"(?i)\([^)]*?subs?[^)]*?\)", r"(?i)\b(?:SUB\s*ITA|ITA\s*SUB)\b", r"(?i)\b(?:SUBTITLES?|SUBS?)[\s\-_]*(?:ITA|ITALIANO?)\b", r"(?i)\b(?:ITA|ITALIANO?)[\s\-_]*(?:SUBTITLES?|SUBS?)\b")
AUDIO = "(?i)(?:\\b(?:ITA|ITALIAN|ITALIANO)\\b|\U0001F1EE\U0001F1F9)"
READABLE = r"[぀-ヿ㐀-䶿一-鿿]"


def season_from_title(c: Column) -> Column:
    """The season a title names: words for two to five, else a number up to 20, else 1."""
    t = F.lower(c)
    out = F.lit(None).cast("int")
    for n, (short, word, roman) in reversed(ORDINALS.items()):
        named = t.contains(f"season {n}") | t.contains(f"{short} season") | t.contains(f" s{n}") | t.contains(f"{word} season") | t.contains(f"part {n}") | t.contains(f"part {roman}") | t.endswith(f" {roman}") | t.contains(f" {roman} ") | t.contains(f" {short}")
        out = F.when(named, n).otherwise(out)
    number = F.regexp_extract(c, NUMBERED, 1).try_cast("int")
    return F.when(c.isNull() | (c == ""), 1).otherwise(F.coalesce(out, F.when(number.between(1, 20), number), F.lit(1)))


def drop_first(c: Column, pattern: str) -> Column:
    """Without the pattern's first match, in any case."""
    return F.regexp_replace(c, f"(?is)^(.*?)(?:{pattern})", "$1")


def search_title(c: Column) -> Column:
    """Without season, part, ordinal and roman tokens, and with single spaces."""
    t = drop_first(c, NUMBER_TOKEN)
    t = drop_first(t, ORDINAL_TOKEN)
    t = drop_first(t, ROMAN_TOKEN)
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))


def season_number(c: Column) -> Column:
    """The number in "season n" or "nth season", else null."""
    a, b = (F.regexp_extract(c, p, 1) for p in (SEASON_N, NTH_SEASON))
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).try_cast("int")


def part_number(c: Column, season: Column) -> Column:
    """The part or cour in a title, else a number at its end that isn't the season; null below 2."""
    named = F.regexp_extract(c, PART_N, 1).try_cast("int")
    at_end = F.when(~c.rlike(SEASON_AT_END), F.regexp_extract(c, NUMBER_AT_END, 1).try_cast("int"))
    n = F.coalesce(named, F.when(at_end != season, at_end))
    return F.when(n > 1, n)


def clean_title(c: Column) -> Column:
    """Without a season suffix, which badges show instead."""
    return F.trim(F.regexp_replace(c, SEASON_SUFFIX, ""))


def season_badge(season: Column, part: Column, seasons: Column, episodes: Column, media_type: Column) -> Column:
    """S<n> and Pt<n>; season 1 only if there are several, or at most 50 episodes and no film."""
    s = F.when(season > 1, F.concat(F.lit("S"), season.cast("string"))).when((season == 1) & ((seasons > 1) | ((episodes <= 50) & (media_type != "movie"))), "S1")
    return F.nullif(F.concat_ws(" - ", s, F.concat(F.lit("Pt"), part.cast("string"))), F.lit(""))


def readable_title(new: Column, old: Column) -> Column:
    """new, unless it is in Japanese script and old isn't."""
    return F.when(new.rlike(READABLE) & ~F.coalesce(old, F.lit("")).rlike(READABLE), old).otherwise(new)


def has_audio(title: Column, name: Column, description: Column) -> Column:
    """Whether a stream's first title line, name or description names the language, subtitle markers apart."""
    text = F.concat_ws(" ", F.split(F.coalesce(title, F.lit("")), "\n")[0], F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")))
    for p in SUBTITLES:
        text = F.regexp_replace(text, p, "")
    return text.rlike(AUDIO)
