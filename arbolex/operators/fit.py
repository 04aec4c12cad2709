"""Clean-up of parsed sentences (the fit step).

Rules that look at one token alone are built-in expressions over the array of tokens. Rules that follow or
move arcs see each other's edits, token by token, so they run in one Arrow function per sentence, which
holds one sentence at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.functions.text import INITIALS, NUMERIC_LEMMAS, PUNCTUATION, fold_number
from arbolex.operators.prepositions import RELATION
from arbolex.sources.conll import FIELDS

# Relations that are kept.
RELATIONS = [
    "предик", "агент", "квазиагент", "дат-субъект", "присвяз", "аналит", "пасс-анал", "1-компл", "2-компл", "3-компл", "4-компл", "неакт-компл",
    "сочин", "соч-союзн", "предл", "атриб", "опред", "оп-опред", "обст", "обст-тавт", "суб-обст", "об-обст", "длительн", "кратно-длительн",
    "дистанц", "аппоз", "количест", "PUNC",
]
CHAINED = ("сочин", "соч-союзн", "_")


def cleaned(toks: Column, exclude_numbers: bool) -> Column:
    """The tokens after all rules that need no other token: case, punctuation, unknown lemmas, numbers, initials, relations.

    Each step names what later steps read more than once, so that nothing is worked out again for each use."""

    def marked(t):
        form = F.lower(t["form"])
        mark = form.isin(PUNCTUATION)
        return F.struct(t.alias("t"), form.alias("form"), mark.alias("mark"), F.when(t["lemma"].isin("<unknown>", "@card@") | (~mark & t["lemma"].isin(PUNCTUATION)), "_").otherwise(t["lemma"]).alias("lemma"))

    def numbered(x):
        punc, number = x["mark"] | F.coalesce(x["t"]["deprel"] == "PUNC", F.lit(False)), x["lemma"].isin(NUMERIC_LEMMAS)
        form = F.when(punc, x["form"]).when(number, x["lemma"]).otherwise(fold_number(x["form"]))
        lemma = F.when(punc | number, x["lemma"]).otherwise(fold_number(x["lemma"]))
        return F.struct(x["t"].alias("t"), form.alias("form"), x["mark"].alias("mark"), lemma.alias("lemma"))

    def named(x):
        t = x["t"]
        initial = (F.length(x["form"]) == 1) & (F.length(x["lemma"]) == 1) & F.lit(INITIALS).contains(x["form"]) & t["feats"].startswith("Np")
        deprel = F.when(x["mark"], "PUNC").when(t["deprel"].isin(RELATIONS), t["deprel"]).otherwise("_")
        new = {"form": x["form"], "lemma": F.when(initial, F.concat(x["lemma"], F.lit("_NP"))).otherwise(x["lemma"]), "deprel": deprel}
        return F.struct(*[new.get(f, t[f]).alias(f) for f in FIELDS])

    steps = F.transform(toks, marked)
    return F.transform(F.transform(steps, numbered) if exclude_numbers else steps, named)


class Sentence:
    """Tokens as dicts, and arcs by number; numbers out of 1..n point nowhere."""

    def __init__(self, toks: list[dict]):
        self.toks = toks

    def head(self, t: dict) -> dict | None:
        try:
            i = int(t["head"])
        except ValueError:
            return None
        return self.toks[i - 1] if 1 <= i <= len(self.toks) else None

    def prepositions(self, by_case: bool) -> None:
        """A preposition's dependent takes its place; with by_case, the relation that the preposition and the noun's case give."""
        for t in self.toks:
            if t["deprel"] != "предл" or by_case and not t["feats"].startswith("N"):
                continue
            p = self.head(t)
            if p is None:
                continue
            relation = p["deprel"]
            if by_case:
                relation = RELATION.get((p["lemma"], t["feats"][4:5] or "-"))
                if relation is None:
                    continue
            if p["deprel"] in CHAINED:
                t["deprel"] = "_"
            else:
                t["head"], t["deprel"] = p["head"], relation
            p["head"], p["deprel"] = t["id"], "ud_prepos"

    def completives(self) -> None:
        for t in self.toks:
            if t["feats"].startswith("N") and t["deprel"] in ("2-компл", "3-компл", "4-компл"):
                t["deprel"] = "компл-" + (t["feats"][4:5] or "-")

    def copulas(self) -> None:
        """The subject of a copula goes to its nominal predicate."""
        for t in self.toks:
            if t["deprel"] == "присвяз" and t["feats"][:1] in ("N", "A"):
                subject = next((x for x in self.toks if x["head"] == t["head"] and x["deprel"] == "предик"), None)
                if subject and subject["feats"].startswith("N"):
                    subject["head"] = t["id"]

    def lifted(self, t: dict) -> list[dict]:
        """Moves the siblings of a content verb from the auxiliary to it."""
        moved = [x for x in self.toks if x["head"] == t["head"] and x["id"] != t["id"] and x["deprel"] != "присвяз"]
        for x in moved:
            x["head"] = t["id"]
        return moved

    def analytic(self) -> None:
        for t in self.toks:
            if t["deprel"] == "аналит" and t["lemma"] not in ("бы", "б"):
                self.lifted(t)

    def passive(self) -> None:
        for t in self.toks:
            if t["deprel"] == "пасс-анал":
                for x in self.lifted(t):
                    if x["deprel"] == "предик":
                        x["deprel"] = "предик-пасс"
            if t["deprel"] == "предик":
                head = self.head(t)
                tag = head["feats"] if head else ""
                if len(tag) >= 8 and (tag[0], tag[2], tag[7]) == ("V", "p", "p"):
                    t["deprel"] = "предик-пасс"

    def coordination(self) -> None:
        for t in self.toks:
            if t["deprel"] == "соч-союзн":
                h = self.head(t)
                if h and h["lemma"] == "и" and h["deprel"] == "сочин":
                    t["head"], t["deprel"] = h["head"], h["deprel"]
                else:
                    t["deprel"] = "_"
        for t in self.toks:
            if t["deprel"] != "сочин":
                continue
            first, seen = t if t["feats"][:1] in ("N", "A") else None, set()
            while first and first["deprel"] == "сочин":
                seen.add(id(first))
                first = self.head(first)
                if first and id(first) in seen:  # a circle has no first member
                    first = None
            if first is None or first["deprel"] == "аппоз":
                t["deprel"] = "_"
            else:
                t["head"], t["deprel"] = first["head"], first["deprel"]

    def punctuation(self) -> None:
        for t in self.toks:
            if t["form"] in _PUNCTUATION:
                t["deprel"] = "PUNC"

    def function_words(self) -> None:
        """Loose conjunctions and particles hang from stubs after the sentence."""
        stubs: dict[str, str] = {}
        for t in self.toks:
            kind = t["feats"][:1]
            if t["deprel"] == "_" and kind in ("C", "Q"):
                t["head"] = stubs.setdefault(kind, str(len(self.toks) + len(stubs) + 1))
                t["deprel"] = t["feats"].lower() if kind == "C" else "q"
        for number in stubs.values():
            self.toks.append(dict.fromkeys(FIELDS, "_") | {"id": number, "head": "0", "misc": "STUB"})

    def rewrite(self) -> list[dict]:
        self.prepositions(True)
        self.prepositions(False)
        self.completives()
        self.copulas()
        self.analytic()
        self.passive()
        self.coordination()
        self.punctuation()
        self.function_words()
        return self.toks


_PUNCTUATION = frozenset(PUNCTUATION)
_NUMBER = re.compile("[0-9]+")


#: What the rules read; of these they change head and deprel.
_READ = ("id", "form", "lemma", "feats", "head", "deprel")


def _in_order(ids: list[str]) -> bool:
    """Whether the ids begin with the numbers 1, 2, ..."""
    return all(x == str(i) or (m := _NUMBER.match(x)) is not None and m[0] == str(i) for i, x in enumerate(ids, 1))


#: Relations that a rule before the last two looks at; a sentence without any meets only those two.
_MOVING = ("предл", "2-компл", "3-компл", "4-компл", "присвяз", "аналит", "пасс-анал", "предик", "соч-союзн", "сочин")
#: Tokens worked on at once.
TOKENS = 200_000


def _plain_order(ids: pa.Array, pos: np.ndarray) -> np.ndarray:
    """Which ids are just the number of their place."""
    return pc.equal(ids, pc.cast(pa.array(pos), pa.string())).to_numpy(zero_copy_only=False)


def _per_row(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[ends])


def _loose(columns: dict[str, pa.Array], kind: str) -> np.ndarray:
    return pc.and_(pc.equal(columns["deprel"], "_"), pc.starts_with(columns["feats"], kind)).to_numpy(zero_copy_only=False)


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("toks")).to_numpy(zero_copy_only=False).astype(np.int64))])
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(sums, sums[i] + TOKENS, "right")) - 1)
            yield _rewritten_part(batch.slice(i, j - i))
            i = j


def _rewritten_part(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sentences that only the last rules concern are worked on as arrays; the others one by one."""
    lists = batch.column("toks")
    toks = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
    columns = {f: toks.field(f).fill_null("") for f in FIELDS}
    size = np.diff(ends)
    pos = np.arange(ends[-1]) - np.repeat(ends[:-1], size) + 1
    odd = _per_row(~_plain_order(columns["id"], pos), ends) > 0
    moving = _per_row(pc.is_in(columns["deprel"], pa.array(_MOVING)).to_numpy(zero_copy_only=False), ends) > 0
    simple = np.flatnonzero((size > 0) & ~odd & ~moving)
    # the array way: punctuation, then stubs by the first loose conjunction and the first loose particle
    columns_now = columns | {"deprel": pc.if_else(pc.is_in(columns["form"], pa.array(PUNCTUATION)), "PUNC", columns["deprel"])}
    loose = {kind: _loose(columns_now, kind) for kind in ("C", "Q")}
    firsts = {}
    for kind, flags in loose.items():
        at = np.flatnonzero(flags)
        rows = np.searchsorted(ends, at, "right") - 1
        first = np.full(len(batch), np.iinfo(np.int64).max)
        np.minimum.at(first, rows, at)
        firsts[kind] = first
    none = np.iinfo(np.int64).max
    number, stubs = {}, np.zeros(len(batch), np.int64)
    for kind, other in (("C", "Q"), ("Q", "C")):
        number[kind] = size + 1 + (firsts[other] < firsts[kind])
        stubs += firsts[kind] < none
    rows = np.repeat(np.arange(len(batch)), size)
    head, deprel = columns["head"], columns_now["deprel"]
    for kind, flags in loose.items():
        mask = pa.array(flags)
        head = pc.replace_with_mask(head, mask, pc.cast(pa.array(number[kind][rows[flags]]), pa.string()))
        deprel = pc.replace_with_mask(deprel, mask, pc.utf8_lower(columns["feats"].filter(mask)) if kind == "C" else pa.array(["q"] * int(flags.sum()), pa.string()))
    # the others
    slow = [x for x in np.flatnonzero((size > 0) & (odd | moving)).tolist() if not odd[x] or _in_order(columns["id"].slice(ends[x], size[x]).to_pylist())]
    done = {}
    for x in slow:
        read = [columns[f].slice(ends[x], size[x]).to_pylist() for f in _READ]
        done[x] = Sentence([dict(zip(_READ, t, strict=True)) for t in zip(*read, strict=True)]).rewrite()
    kept = np.sort(np.concatenate([simple, np.array(slow, np.int64)]))
    n = stubs.copy()
    for x, t in done.items():
        n[x] = len(t) - size[x]
    # each kept row: its tokens, then its stubs
    total = (size + n)[kept]
    out = np.concatenate([[0], np.cumsum(total)])
    of = np.repeat(kept, total)
    place = np.arange(out[-1]) - np.repeat(out[:-1], total)
    stub = place >= size[of]
    takes = pa.array(np.where(stub, 0, ends[of] + place), pa.int64(), mask=stub)
    ids = pc.if_else(pa.array(stub), pc.cast(pa.array(place + 1), pa.string()), columns["id"].take(takes))
    new = {"id": ids, "head": head.take(takes).fill_null("0"), "deprel": deprel.take(takes).fill_null("_")}
    if done:
        at = dict(zip(kept.tolist(), out[:-1].tolist(), strict=True))
        spots = np.concatenate([np.arange(at[x], at[x] + len(t)) for x, t in done.items()])
        order = np.argsort(spots)
        mask = np.zeros(out[-1], bool)
        mask[spots] = True
        for f in new:
            values = pa.array([t[f] for toks in done.values() for t in toks], pa.string()).take(pa.array(order))
            new[f] = pc.replace_with_mask(new[f], pa.array(mask), values)
    made = [new[f] if f in new else columns[f].take(takes).fill_null("STUB" if f == "misc" else "_") for f in FIELDS]
    toks = pa.ListArray.from_arrays(pa.array(out.astype(np.int32)), pa.StructArray.from_arrays(made, list(FIELDS)))
    return pa.RecordBatch.from_arrays([batch.column("sent_id").take(pa.array(kept, pa.int64())), toks], ["sent_id", "toks"])


def fit(sentences: DataFrame, exclude_numbers: bool = False) -> DataFrame:
    """sent_id, toks after all rules, in their order. Sentences whose ids are not 1..n go."""
    rows = sentences.where("toks IS NOT NULL").select("sent_id", cleaned(F.col("toks"), exclude_numbers).alias("toks"))
    fields = ", ".join(f"{f}: string" for f in FIELDS)
    kind = dict(sentences.dtypes)["sent_id"]
    return rows.mapInArrow(_rewritten, f"sent_id {kind}, toks array<struct<{fields}>>")
