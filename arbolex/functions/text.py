"""Column functions on words. All count code points, as the data model asks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets, marks and token families of the data model.
CYRILLIC = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЬЫЪЭЮЯабвгдеёжзийклмнопрстуфхцчшщьыъэюя"
INITIALS = "абвгдеёжзийклмнопрстуфхцчшщыэюя"
NUMERIC_LEMMAS = ["@num@", "@num@,@num@", "@num@:@num@", "@num@-@num@", "@num@--@num@", "@num@‒@num@", "@num@–@num@", "@num@—@num@"]
PUNCTUATION = [
    ".", ",", "!", "?", ";", "…", "...", ":", "-", "--", "—", "–", "‒", "'", "ʼ", "ˮ", "\"", "«", "“", "„", "‘", "‚", "»", "”", "‟", "’", "‛",
    "(", "[", "{", "⟨", ")", "]", "}", "⟩",
]
#: Words of fewer code points give no suffixes.
SUFFIX_SOURCE = 6
SUFFIX_MARK = "_OOV_"
NUMBER_FOLD = r"^[0-9‐‒–—\-−˗―─,]*[0-9‒–—−˗―─,][-‐]([А-Яа-яЁё][А-Яа-яЁё\-‐]*)$"


def fold_number(word: Column) -> Column:
    """15-летие becomes @num@-летие; other words stay."""
    return F.regexp_replace(word, NUMBER_FOLD, "@num@-$1")


def is_number(lemma: Column) -> Column:
    return lemma.isin(NUMERIC_LEMMAS)


def has_cyrillic(word: Column) -> Column:
    return word.rlike("[а-яё]")


def fold_yo(word: Column) -> Column:
    return F.translate(word, "ё", "е")


def suffixes(word: Column, longest: int) -> Column:
    """array<string>: the last 1 to longest characters; empty for words shorter than SUFFIX_SOURCE."""
    count = F.when(F.length(word) >= SUFFIX_SOURCE, F.least(F.length(word), F.lit(longest))).otherwise(0)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.right(word, i))).otherwise(F.array().cast("array<string>"))


def oov_suffixes(form: Column, longest: int) -> Column:
    """array<string>: the pseudo-words a form counts for: LD_ if it begins with a Cyrillic letter and ends
    with a digit, else its suffixes as far as they are Cyrillic (a hyphen may stand before то and ка)."""
    letters = F.regexp_extract(form, rf"((?:[{CYRILLIC}]|-(?=(?:то|ка)$))*)$", 1)
    own = F.least(F.length(letters), F.lit(longest))
    cut = F.when((F.length(form) >= SUFFIX_SOURCE) & (own > 0), F.transform(F.sequence(F.lit(1), F.greatest(own, F.lit(1))), lambda i: F.right(form, i)))
    found = F.when(form.rlike(rf"^[{CYRILLIC}](.*[^\n])?[0-9]$") | form.rlike(rf"^[{CYRILLIC}][0-9]$"), F.array(F.lit("LD_"))).otherwise(F.coalesce(cut, F.array().cast("array<string>")))
    return F.transform(found, lambda s: F.concat(F.lit(SUFFIX_MARK), s))


def pos_matches(constraint: Column, feats: Column) -> Column:
    """Whether a tag meets noun, adj or noun_proper."""
    return F.when(constraint == "noun", feats.startswith("N")).when(constraint == "adj", feats.startswith("A")).when(constraint == "noun_proper", feats.startswith("Np")).otherwise(False)
