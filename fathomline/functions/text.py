"""Text columns: class names, tokens, numbers, citations, names of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of search terms; own list.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def class_name(x: Column) -> Column:
    """Lower case, blanks, underscores and slashes to single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[\s_/]+", "-"), "^-+|-+$", "")


def singular(word: Column, longer_than: int = 3) -> Column:
    return F.when((F.length(word) > longer_than) & word.endswith("s") & ~word.endswith("ss"), F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def has_token_run(name: Column, target: Column) -> Column:
    """Whether the hyphen tokens of ``target`` follow each other in ``name``, both in the singular."""
    joined = lambda c: F.concat(F.lit("-"), F.array_join(F.transform(F.split(class_name(c), "-"), singular), "-"), F.lit("-"))
    return F.contains(joined(name), joined(target))


def alnum(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def tokens(x: Column) -> Column:
    """``[a-z0-9]+`` of the lower-cased text, of two characters or more and no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def content_terms(x: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9][a-z0-9-]*"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def numbers(x: Column) -> Column:
    """Figures as written, without digit grouping."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))


def citations(x: Column) -> Column:
    """Distinct numbers in [n] markers, rising."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda n: n.cast("int"))))


def snippet(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.left(x, F.lit(most))), F.lit("..."))).otherwise(x)


def redacted_keys(x: Column) -> Column:
    """Key-like strings and values of password-like names blotted out."""
    return F.regexp_replace(F.regexp_replace(x, r"AKIA[A-Z0-9]{16}", "[key]"), r"(password|token|secret)(\s*[=:]\s*)(\S+)", "$1$2[hidden]")


def basename(x: Column) -> Column:
    return F.regexp_extract(x, r"([^/\\]*)$", 1)


def tile_parts(name: Column) -> tuple[Column, Column, Column]:
    """strip, x and y of names like strip_x_y.ext, read from the right; nulls where they do not fit."""
    pattern = r"^(.+)_([0-9]+)_([0-9]+)(?:\.[A-Za-z0-9]+)?$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return part(1), part(2).cast("int"), part(3).cast("int")


def sentences(x: Column) -> Column:
    return F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)


def script(x: Column) -> Column:
    """The first of a few scripts that a text has letters of."""
    found = (("devanagari", "[\\u0900-\\u097F]"), ("tamil", "[\\u0B80-\\u0BFF]"), ("cyrillic", "[\\u0400-\\u04FF]"), ("latin-ext", "[\\u00C0-\\u024F]"), ("latin", "[A-Za-z]"))
    return reduce(lambda acc, it: acc.when(x.rlike(it[1]), it[0]), found[1:], F.when(x.rlike(found[0][1]), found[0][0])).otherwise("none")


def longest_key(x: Column, keys: tuple[str, ...]) -> Column:
    """``x`` itself if it is a key, else the longest key it contains (the first of equal length), else null."""
    ranked = sorted(keys, key=lambda k: (-len(k), keys.index(k)))
    contained = F.coalesce(*[F.when(F.contains(x, F.lit(k)), F.lit(k)) for k in ranked])
    return F.when(x.isin(*keys), x).otherwise(contained)
