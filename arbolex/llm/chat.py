"""Chat formatting over a prefix tree: conversations that share initial turns are merged, and shared tokens
are emitted once, depth-first, with position ids and ancestor attention intervals.

A turn is ``<turn>role\\ntext</turn>\\n``. Inside roles and texts a backslash, and the two marks, are
escaped with a backslash (and a newline inside a role is written ``\\n``), so that parsing gives every
string back.

Conversations are sorted by the chained hashes of their turns, so those with a common beginning are
neighbours and the sort is the tree's depth-first order; equal conversations are one. Each task streams
over its range and emits blocks of about BLOCK_TOKENS tokens: the units of training and of attention. A
subtree of any size is spread over blocks and tasks; a block begins by emitting anew the turns that its
first conversation shares with the block before, as attention never reaches across blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.llm.common import refuse_clashes, stored
from arbolex.llm.pieces import encoder

OPEN, CLOSE, BREAK = "<turn>", "</turn>", "\n"
BLOCK_TOKENS = 65_536
#: Conversations whose turns are encoded in one call.
AT_ONCE = 500
NODE = "struct<parent:int,depth:int,start:int,end:int,position:int,loss_start:int,loss_end:int,attend:array<struct<start:int,end:int>>>"
BLOCKS = f"block long, ids array<int>, nodes array<{NODE}>, conversations array<struct<key:string,node:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct([*((c, pa.int32()) for c in ("parent", "depth", "start", "end", "position", "loss_start", "loss_end")), ("attend", pa.list_(_SPAN))])
_BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int32())), ("nodes", pa.list_(_NODE)), ("conversations", pa.list_(pa.struct([("key", pa.string()), ("node", pa.int32())])))])
_TURN = re.compile(rf"{OPEN}((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!/?turn>))*){CLOSE}\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(OPEN, "\\" + OPEN).replace(CLOSE, "\\" + CLOSE)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str, role: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.DOTALL)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    return OPEN + escape_role(role) + BREAK, escape(text), CLOSE + BREAK


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1], True), unescape(found[2])))
        at = found.end()
    return out


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        path = []
        for turns in batch.column("turns").to_pylist():
            last, steps = b"", []
            for t in turns:
                role = (t["role"] or "").encode()  # its length comes first, so that no other turn gives the same bytes
                last = hashlib.blake2b(last + len(role).to_bytes(8, "little") + role + (t["text"] or "").encode(), digest_size=16).digest()
                steps.append(last.hex())
            path.append("".join(steps))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(path, pa.string()), batch.column("turns")], ["conv_id", "path", "turns"])


class Block:
    """A part of the tree, filled in depth-first order."""

    def __init__(self):
        self.ids: list[int] = []
        self.nodes: list[dict] = []
        self.ends: list[dict] = []
        self.open: list[tuple[str, int]] = []  # hash and node of the turns of the last conversation

    def add(self, steps: list[str], turns: list[tuple[str, str]], encoded: dict[tuple[str, str], tuple]) -> None:
        shared = 0
        while shared < min(len(steps), len(self.open)) and self.open[shared][0] == steps[shared]:
            shared += 1
        del self.open[shared:]
        for step, turn in zip(steps[shared:], turns[shared:], strict=True):
            ids, opened, closed = encoded[turn]
            parent = self.open[-1][1] if self.open else -1
            up = self.nodes[parent] if self.open else None
            attend = [dict(x) for x in up["attend"]] if up else []
            if up and attend and attend[-1]["end"] == up["start"]:
                attend[-1]["end"] = up["end"]
            elif up:
                attend.append({"start": up["start"], "end": up["end"]})
            first = len(self.ids)
            loss = turn[0] == "assistant"
            self.ids += ids
            self.nodes.append({
                "parent": parent, "depth": len(self.open), "start": first, "end": len(self.ids), "position": up["position"] + up["end"] - up["start"] if up else 0,
                "loss_start": first + opened if loss else 0, "loss_end": first + closed if loss else 0, "attend": attend,
            })
            self.open.append((step, len(self.nodes) - 1))
        self.ends.append({"key": steps[-1], "node": self.open[-1][1]})


def encode_turns(turns: set[tuple[str, str]], tool) -> dict[tuple[str, str], tuple[list[int], int, int]]:
    """Of each different (role, text) its ids, and where among them the text begins and ends; all in one call."""
    order = sorted(turns)
    ids, at = tool.encode([part for t in order for part in turn_parts(*t)])
    return {t: (ids[at[3 * i] : at[3 * i + 3]].tolist(), int(at[3 * i + 1] - at[3 * i]), int(at[3 * i + 2] - at[3 * i])) for i, t in enumerate(order)}


def _blocks(tokenizer: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, tool = TaskContext.get(), encoder(tokenizer, special_as_text=True)
        number = (context.partitionId() if context else 0) << 40
        block = Block()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, block.ids, block.nodes, block.ends), _BLOCKS, strict=True)], schema=_BLOCKS)

        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, len(b), AT_ONCE)):
            every = [[(t["role"] or "", t["text"] or "") for t in turns] for turns in batch.column("turns").to_pylist()]
            encoded = encode_turns({t for turns in every for t in turns}, tool)
            for path, turns in zip(batch.column("path").to_pylist(), every, strict=True):
                block.add([path[i : i + 32] for i in range(0, len(path), 32)], turns, encoded)
                if len(block.ids) >= limit:
                    yield row()
                    block, number = Block(), number + 1
        if block.ends:
            yield row()

    return run


def format_conversations(turns: DataFrame, tokenizer: str, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(blocks, members). blocks: block, ids, nodes and conversations (key and last node), one row each.
    members: conv_id, key: one row for each conversation; equal conversations share a key.

    A node is a turn: parent (-1: none) and depth, its tokens ids[start:end], the position id of its first
    token, loss_start and loss_end (an assistant's text alone bears loss; else 0, 0), and attend: the
    intervals of its ancestors' tokens, which it sees besides its own tokens so far.

    Rows of a conversation are ordered by turn, then role and text; rows that repeat are turns of their
    own. Null text or role: empty. Null turn: first. Null conv_id: one conversation. Empty table: no blocks.
    Other columns are left out. Very long texts are whole; a conversation longer than a block is not cut.
    """
    refuse_clashes(turns, "conv_id", "turn", "role", "text")
    whole = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    whole = whole.select("conv_id", F.transform(F.sort_array("turns"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    kind = dict(turns.dtypes)["conv_id"]
    paths = whole.mapInArrow(_paths, f"conv_id {kind}, path string, turns array<struct<role:string,text:string>>")
    paths = stored(paths, "conversations")
    members = paths.select("conv_id", F.expr("right(path, 32)").alias("key"))
    different = paths.groupBy("path").agg(F.first("turns").alias("turns"))
    blocks = different.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_blocks(tokenizer, block_tokens), BLOCKS)
    return stored(blocks, "blocks"), members


def _read(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer, special_as_text=True).library
        text = lambda ids: tool.decode(ids, skip_special_tokens=False)
        for batch in batches:
            out: list[tuple] = []
            for ids, nodes, ends in zip(*(batch.column(c).to_pylist() for c in ("ids", "nodes", "conversations")), strict=True):
                said = [text(ids[n["start"] : n["end"]]) for n in nodes]
                loss = [unescape(text(ids[n["loss_start"] : n["loss_end"]])) for n in nodes]
                for end in ends:
                    path, i = [], end["node"]
                    while i >= 0:
                        path.append(i)
                        i = nodes[i]["parent"]
                    path.reverse()
                    formatted = "".join(said[i] for i in path)
                    found = parse(formatted)
                    learned = "".join(loss[i] for i in path)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in found).encode()).hexdigest()
                    out.append((end["key"], len(found), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
            names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def read_back(blocks: DataFrame, tokenizer: str) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the blocks' ids and nodes alone."""
    return blocks.mapInArrow(_read(tokenizer), "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
