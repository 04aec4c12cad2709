"""Morphological tags as 64 binary features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The features in the order of their slots.
FEATURES = """noun pronoun adjective numeral adverb verb adposition conjunction particle interjection common proper
masculine feminine neuter singular plural nominative genitive dative accusative instrumental locative vocative animate inanimate
positive comparative superlative short full possessive indicative imperative conditional infinitive participle gerund
present past future first second third active passive progressive perfective personal demonstrative indefinite interrogative
relative reflexive negative nonspecific as-noun as-adjective as-adverb cardinal ordinal collective coordinating subordinating""".split()
GENDER = {"m": "masculine", "f": "feminine", "n": "neuter"}
NUMBER = {"s": "singular", "p": "plural"}
CASE = {"n": "nominative", "g": "genitive", "d": "dative", "a": "accusative", "i": "instrumental", "l": "locative", "v": "vocative"}
ANIMATE = {"y": "animate", "n": "inanimate"}
TENSE = {"p": "present", "f": "future", "s": "past"}
PERSON = {"1": "first", "2": "second", "3": "third"}
DEFINITE = {"s": "short", "f": "full"}
DEGREE = {"p": "positive", "c": "comparative", "s": "superlative"}
MOOD = {"i": "indicative", "m": "imperative", "c": "conditional", "n": "infinitive", "p": "participle", "g": "gerund"}
VOICE = {"a": "active", "p": "passive"}
ASPECT = {"p": "progressive", "e": "perfective"}
PRONOUN = {"p": "personal", "d": "demonstrative", "i": "indefinite", "s": "possessive", "q": "interrogative", "r": "relative", "x": "reflexive", "z": "negative", "n": "nonspecific"}
SYNTAX = {"n": "as-noun", "a": "as-adjective", "r": "as-adverb"}
#: By the tag's first letter: its feature, and what each later position means.
CLASSES = {
    "N": ("noun", {1: {"c": "common", "p": "proper"}, 2: GENDER, 3: NUMBER, 4: CASE, 5: ANIMATE}),
    "V": ("verb", {2: MOOD, 3: TENSE, 4: PERSON, 5: NUMBER, 6: GENDER, 7: VOICE, 8: DEFINITE, 9: ASPECT, 10: CASE}),
    "A": ("adjective", {1: {"s": "possessive"}, 2: DEGREE, 3: GENDER, 4: NUMBER, 5: CASE, 6: DEFINITE}),
    "P": ("pronoun", {1: PRONOUN, 2: PERSON, 3: GENDER, 4: NUMBER, 5: CASE, 6: SYNTAX, 7: ANIMATE}),
    "R": ("adverb", {1: DEGREE}),
    "M": ("numeral", {1: {"c": "cardinal", "o": "ordinal", "l": "collective"}, 2: GENDER, 3: NUMBER, 4: CASE}),
    "S": ("adposition", {3: CASE}),
    "C": ("conjunction", {1: {"c": "coordinating", "s": "subordinating"}}),
    "Q": ("particle", {}),
    "I": ("interjection", {}),
}


def slots(tag: str) -> list[int]:
    """The slots that a tag sets, ascending."""
    if not tag or tag[0] not in CLASSES:
        return []
    name, places = CLASSES[tag[0]]
    found = {name} | {places[i][c] for i, c in enumerate(tag) if i in places and c in places[i]}
    return sorted(FEATURES.index(x) for x in found)


def bits(tag: str) -> int:
    """The slots as a 64-bit number, slot 0 the lowest; negative with slot 63."""
    n = sum(1 << i for i in slots(tag))
    return n - (1 << 64) if n >> 63 else n


def _rules() -> list[list[tuple[str, int, str]]]:
    """For each slot the (class, position, letter) that set it."""
    rules: list[list[tuple[str, int, str]]] = [[] for _ in FEATURES]
    for letter, (name, places) in CLASSES.items():
        rules[FEATURES.index(name)].append((letter, 0, letter))
        for i, values in places.items():
            for c, feature in values.items():
                rules[FEATURES.index(feature)].append((letter, i, c))
    return rules


def features(tag: Column) -> Column:
    """array<int> of 64 zeros and ones, by built-in expressions."""

    def one(rules):
        return "|".join(f"^{letter}" if not i else f"^{letter}.{{{i - 1}}}[{c}]" for letter, i, c in rules)

    return F.array(*[F.coalesce(tag.rlike(one(r)).cast("int"), F.lit(0)) for r in _rules()])


def packed(tag: Column) -> Column:
    """The same as a long, a bit for each slot."""
    each = F.transform(features(tag), lambda x, i: F.call_function("shiftleft", x.cast("long"), i))
    return F.aggregate(each, F.lit(0).cast("long"), lambda n, x: n.bitwiseOR(x))


SLOT_SQL = [(name, r) for name, r in zip(FEATURES, _rules(), strict=True)]
