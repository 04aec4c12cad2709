"""Token ids of whole texts by the tokenizers library, with a vectorised front end.

The two kinds of byte-pair tokenizers used here cut a text into pieces that are encoded independently of
each other. ``Encoder`` finds the pieces of a whole batch with numpy, asks the library only for pieces it
has not yet seen in this process, and gathers the ids. The classes of characters come from the library's
own regular expressions. A tokenizer of another kind, and a text with a character that changes length when
normalised, go to the library whole; so does a text that holds a special token's string, which the library
reads as that token unless it is told to take it as ordinary text (special_as_text).
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arbolex.llm.textarrays import mix

#: Pieces kept before the table is started anew; bounds a worker's memory to about 60 MB.
MAX_PIECES = 2_000_000
#: Code points processed at once.
CHUNK = 1_000_000
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}
_TOP = 0x110000


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder for a file and a way in each process."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, special_as_text)
    return _ENCODERS[key]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classify(kinds: np.ndarray, points: np.ndarray) -> None:
    """Enters SPACE, LETTER, NUMBER or OTHER for code points not seen before, by the library's regular expressions."""
    from tokenizers import Regex, pre_tokenizers

    text = points.tobytes().decode("utf-32-le")
    kinds[points] = OTHER
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for _, (a, b) in split.pre_tokenize_str(text):
            kinds[points[a:b]] = kind


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        added = [x for x in said.get("added_tokens", ()) if not (special_as_text and x["special"])]
        self.marks = [x["content"] for x in added]
        steps = said["pre_tokenizer"]
        steps = [steps] if steps and steps["type"] != "Sequence" else (steps or {"pretokenizers": []})["pretokenizers"]
        normal = said.get("normalizer")
        normal = [normal] if normal and normal["type"] != "Sequence" else (normal or {"normalizers": []})["normalizers"]
        kinds, normals = [x["type"] for x in steps], [x["type"] for x in normal]
        self.spaced = kinds == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"] and not normals
        self.folded = kinds == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "") and normals == ["NFC", "Replace", "Lowercase"]
        self.simple = said["model"]["type"] == "BPE" and not said["model"].get("dropout")
        self.fast = self.simple and (self.spaced or self.folded) and not any(x["normalized"] for x in added)
        self.keys = np.zeros(0, np.uint64)
        self.table: list[np.ndarray] = []
        if self.fast:
            self.kind = np.full(_TOP, UNKNOWN, np.uint8)
            _classify(self.kind, np.arange(0x250, dtype=np.uint32))
            if self.folded:
                self.lower = np.arange(_TOP, dtype=np.uint32)
                for c in [*range(0xD800), *range(0xE000, 0x20000)]:  # no letters of two cases lie beyond
                    if (low := chr(c).lower()) != chr(c):
                        self.lower[c] = ord(low) if len(low) == 1 else _TOP - 1
            self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size, self.ids, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1 << 16, np.uint32), 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's bounds in them. Null is empty."""
        ids, bounds, _ = self._encoded(texts, False)
        return ids, bounds

    def encode_with_places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Also each id's first code point within its text: the first character of which it holds a byte."""
        return self._encoded(texts, True)

    def _encoded(self, texts, places: bool):
        out, size, spots, part, n = [], [], [], [], 0
        for t in [*texts, None]:
            part.append(t or "")
            n += len(part[-1])
            if n >= CHUNK or len(size) + len(part) == len(texts):
                ids, each, where = self._part(part, places)
                out.append(ids)
                size += each.tolist()
                spots.append(where)
                part, n = [], 0
                if len(size) >= len(texts):
                    break
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return cat(out, np.uint32), np.concatenate([[0], np.cumsum(np.array(size, np.int64))]).astype(np.int64), cat(spots, np.int64) if places else None

    def _whole(self, text: str, places: bool):
        found = self.library.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.array([a for a, _ in found.offsets], np.int64) if places else None

    def _part(self, texts: list[str], places: bool):
        if not self.fast:
            each = [self._whole(t, places) for t in texts]
            return np.concatenate([x for x, _ in each]), np.array([len(x) for x, _ in each]), np.concatenate([p for _, p in each]) if places else None
        odd: dict[int, tuple] = {}
        for i, t in enumerate(texts):
            if any(m in t for m in self.marks) or self.folded and not t.isascii() and (not unicodedata.is_normalized("NFC", t) or (self.lower[_code_points(t)] == _TOP - 1).any() or "Σ" in t):
                odd[i] = self._whole(t, places)
        texts = ["" if i in odd else t for i, t in enumerate(texts)]
        points = _code_points("".join(texts))
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if self.folded:
            points = self.lower[points]
        starts, ends = self._cut(points, bounds)
        key = self._hashes(points, starts, ends)
        known, inverse = np.unique(key, return_inverse=True)
        row = self._rows(known, key, inverse, points, starts, ends)[inverse]
        size = self.size[row].astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        within = np.arange(first[-1]) - np.repeat(first[:-1], size)
        ids = self.ids[np.repeat(self.at[row], size) + within]
        each = np.diff(first[np.searchsorted(starts, bounds)])
        where = None
        if places:
            where = self._places(points, starts, ends, bounds, ids, first)
        if odd:
            cut = np.concatenate([[0], np.cumsum(each)])
            ids = np.concatenate([odd[i][0] if i in odd else ids[cut[i] : cut[i + 1]] for i in range(len(texts))])
            if places:
                where = np.concatenate([odd[i][1] if i in odd else where[cut[i] : cut[i + 1]] for i in range(len(texts))])
            each = np.array([len(odd[i][0]) if i in odd else each[i] for i in range(len(texts))])
        return ids, each, where

    def _cut(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.kind[points]
        if (kind == UNKNOWN).any():
            _classify(self.kind, np.unique(points[kind == UNKNOWN]))
            kind = self.kind[points]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        new = edge[:-1].copy()
        new[1:] |= kind[1:] != kind[:-1]
        if self.folded:
            new |= kind == NUMBER
        run = np.flatnonzero(new)
        end = np.append(run[1:], n)
        if self.spaced:
            # of white space before other characters, the last is a piece of its own, or joins them if it is a blank
            space = (kind[run] == SPACE) & ~edge[end]
            last = end[space] - 1
            blank = points[last] == 0x20
            new[last] = True
            new[end[space][blank]] = False
        # an apostrophe that begins a piece of its own draws in the ending after it
        quote = np.flatnonzero((points[:-1] == 0x27) & new[:-1] & new[1:] & ~edge[1:-1]) if n > 1 else np.zeros(0, np.int64)
        if len(quote):
            a = points[quote + 1]
            two = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
            b = np.where(two, points[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            pair = np.zeros(len(quote), bool)
            for x, y in ("re", "ve", "ll"):
                pair |= (a == ord(x)) & (b == ord(y))
            new[quote[one | pair] + 1] = False
            for at in (quote[one] + 2, quote[pair & ~one] + 3):
                at = at[at < n]
                new[at] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        if self.folded:
            keep = kind[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    def _hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        size = ends - starts
        value = mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        place = np.arange(len(points)) - np.repeat(starts, np.diff(np.append(starts, len(points)))) if starts[0] == 0 else np.arange(len(points)) - starts[np.maximum(np.searchsorted(starts, np.arange(len(points)), "right") - 1, 0)]
        value *= mix(np.arange(1, int(np.abs(place).max()) + 2, dtype=np.uint64))[np.abs(place)] | np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        return mix((total[ends] - total[starts]) ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def _rows(self, known: np.ndarray, key: np.ndarray, inverse: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's row of each known key; new pieces are encoded and entered first."""
        if len(self.keys) > MAX_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, known)
        there = np.zeros(len(known), bool)
        if len(self.keys):
            there = self.keys[np.minimum(at, len(self.keys) - 1)] == known
        if not there.all():
            example = np.empty(len(known), np.int64)
            example[inverse] = np.arange(len(key))
            miss = np.flatnonzero(~there)
            texts = [points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts[example[miss]].tolist(), ends[example[miss]].tolist(), strict=True)]
            ids, size = self._library(texts)
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), np.uint32)])
            self.ids[self.used : self.used + len(ids)] = ids
            new = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
            self.used += len(ids)
            place = at[miss]
            self.keys, self.at, self.size = np.insert(self.keys, place, known[miss]), np.insert(self.at, place, new), np.insert(self.size, place, size)
            at = np.searchsorted(self.keys, known)
        return at

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pieces, and how many each has. Each stays one piece when encoded alone."""
        found = self.library.encode(texts, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(texts))

    def _places(self, points, starts, ends, bounds, ids, first):
        """First code point of each id, by the bytes its token holds; for tokenizers whose pieces keep all characters."""
        if not self.spaced:
            raise ValueError("places need a tokenizer that keeps every character")
        if not hasattr(self, "bytes"):
            self.bytes = np.zeros(self.library.get_vocab_size(), np.int64)
            for token, i in self.library.get_vocab().items():
                self.bytes[i] = len(token)  # one character stands for each byte
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_of_point = np.concatenate([[0], np.cumsum(width)])
        byte = np.concatenate([[0], np.cumsum(self.bytes[ids])])[:-1]
        where = np.searchsorted(byte_of_point, byte, "right") - 1
        each = np.diff(first[np.searchsorted(starts, bounds)])
        return where - np.repeat(bounds[:-1], each)


def slices(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about limit bytes of text each (a longer row is a batch of its own): what a worker
    holds at once follows the text's size, not the number of rows that Spark puts in a batch."""
    for batch in batches:
        size = sum(pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        total = np.concatenate([[0], np.cumsum(size)])
        start = 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
