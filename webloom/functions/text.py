"""Text expressions that agree with Unicode-aware string handling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space, the separators that Java's \s leaves out included; also valid in RE2.
SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Line ends; a CR LF pair counts once.
LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(collapse(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normal_lines(text: Column) -> Column:
    """Collapsed, non-blank lines; a line equal to the kept line before it is dropped."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), collapse), lambda x: x != "")
    # an equal neighbour in the list of non-blank lines is equal to the last kept line as well
    return F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("x"), F.concat(F.array(F.lit("")), lines).alias("p")), lambda s: s["x"].isNotNull() & (s["x"] != s["p"])), lambda s: s["x"]), "\n")


def keyword_text(text: Column) -> Column:
    """Percent-decoded, lower-case, ASCII words parted by single spaces; & reads as "and"."""
    sound = F.regexp_replace(F.coalesce(text, F.lit("")), "%(?![0-9A-Fa-f]{2})", "%25")
    lowered = F.replace(F.lower(F.coalesce(F.try_url_decode(sound), sound)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def has_phrase(normal: Column, phrase: str) -> Column:
    """Whether keyword text holds the phrase as whole words."""
    return F.contains(F.concat(F.lit(" "), normal, F.lit(" ")), F.lit(f" {phrase} "))
