"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are never keywords.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do",
    "does", "did", "will", "would", "should", "could", "may", "might", "must", "can", "how", "what",
    "when", "where", "why", "which", "who", "describe", "explain", "tell", "about", "me",
)
#: Spellings of a form field's truth value.
TRUE_WORDS = ("true", "1", "yes", "on", "enabled", "enable")
FALSE_WORDS = ("false", "0", "no", "off", "disabled", "disable", "", "none", "null")
TOKEN = r"[\p{L}\p{N}_]+"


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Unix line ends, at most one blank line between lines, no white space around."""
    return strip(F.regexp_replace(unix_lines(text), r"\n{3,}", "\n\n"))


def normalize(text: Column) -> Column:
    """Unix line ends, runs of blanks and tabs as one blank, no white space around."""
    return strip(F.regexp_replace(unix_lines(text), r"[ \t]+", " "))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def titled(text: Column) -> Column:
    """Each word between spaces with its first character in upper case and the rest in lower case, character by
    character: no letter becomes two (initcap makes Ss of a first ß) and the length stays."""

    def word(w: Column) -> Column:
        first, rest = F.left(w, F.lit(1)), F.substr(w, F.lit(2))
        return F.concat(F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(F.translate(first, "ß", "ẞ")), F.lower(F.translate(rest, "İΣ", "iσ")))

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def truth(value: Column) -> Column:
    """Form booleans: unknown words are true."""
    word = F.lower(F.trim(value))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isNull() | word.isin(*FALSE_WORDS), False).otherwise(True)


def keywords(question: Column, most: int = 15) -> Column:
    """Words of a question worth looking for: over two characters, no stop words, lower case, the first `most`."""
    words = F.split(F.regexp_replace(question, r"[^\p{L}\p{N}_\s-]", " "), r"\s+")
    lower = F.transform(words, lambda w: F.lower(w))
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.slice(F.filter(lower, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)), 1, most)


def tokens(text: Column) -> Column:
    """Search tokens: runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text without overlap; 0 for an empty part."""
    gone = F.length(text) - F.length(F.replace(text, part))
    return F.when(F.length(part) > 0, F.floor(gone / F.length(part))).otherwise(0).cast("int")


def matching(content: Column, words: Column) -> Column:
    """The words (lower case) that content contains."""
    low = F.lower(content)
    return F.filter(words, lambda w: low.contains(w))


def despaced(line: Column) -> Column:
    """'L I N K' as 'LINK'."""
    return F.when(line.rlike(r"^([A-Z]\s){2,}[A-Z]$"), F.regexp_replace(line, r"\s", "")).otherwise(line)


def spread(payload: Column, known: tuple[str, ...]) -> Column:
    """The entries of a map whose keys are not fields of their own: what a hit carries as metadata."""
    return F.map_filter(payload, lambda k, _: ~k.isin(*known))


def merged(*maps: Column) -> Column:
    """Maps as one; later ones win, and a null map adds nothing."""
    none = F.create_map().cast("map<string,string>")
    entries = F.concat(*(F.map_entries(F.coalesce(m, none)) for m in maps))
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)
