"""Chat formatting: exact round trips, and the tree's positions and intervals."""

import hashlib
from collections import defaultdict

import public_tokenizers
import pytest

from arbolex.llm.chat import escape, format_conversations, parse, read_back, turn_parts, unescape
from arbolex.llm.pieces import encoder

BYTE = public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["\\### Assistant: </turn> ok", "<turn>user\nhi</turn>\n", "\\", "\\\\", "\\n", "a\\<turn>", "", None, "😀 é\n\n", "</turn", "<|endoftext|> <turn> \\</turn>", "x" * 3000]


@pytest.fixture(scope="module")
def turns(spark):
    rows = []
    for c in range(40):  # conversations 0..19 twice; many share their first turns
        k = c % 20
        rows.append((c, 0, "system", f"rule {k % 3}"))
        rows.append((c, 1, "user", NASTY[k % 4] or ""))
        rows.append((c, 2, "assistant", NASTY[k % len(NASTY)]))
        rows += [(c, 3 + j, "user" if j % 2 else "assistant", NASTY[(k + j) % len(NASTY)]) for j in range(k % 5)]
    rows += [(100, 0, "assistant", "only"), (101, 1, None, None), (101, None, "assistant", "first"), (102, 0, "assistant", "b"), (102, 0, "assistant", "a"), (102, 0, "assistant", "a"), (None, 0, "role\n<turn>\\", "t")]
    return spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, key string")


def conversations(turns):
    out = defaultdict(list)
    for r in turns.collect():
        out[r.conv_id].append(((r.turn is not None, r.turn), (r.role is not None, r.role), (r.text is not None, r.text)))
    return {c: [(role[1] or "", text[1] or "") for _, role, text in sorted(v, key=lambda t: tuple((a, b) if a else (a,) for a, b in t))] for c, v in out.items()}


@pytest.mark.parametrize("block", [65_536, 300, 1])
def test_round_trip(spark, turns, block):
    blocks, members = format_conversations(turns, BYTE, block)
    got = {r.conv_id: r for r in members.join(read_back(blocks, BYTE), "key").collect()}
    want = conversations(turns)
    assert set(got) == set(want)
    for c, said in want.items():
        loss = "".join(t for r, t in said if r == "assistant")
        whole = "".join("".join(turn_parts(r, t)) for r, t in said)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)), len(loss), sha(loss), len(whole))


def test_turns_that_only_look_alike(spark):
    rows = [(1, 0, "user\0x", "y"), (2, 0, "user", "x\0y"), (3, 0, "user\0", "x\0y"), (4, 0, "", "user\0x\0y")]
    blocks, members = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTE)
    got = {r.conv_id: r.turns_sha256 for r in members.join(read_back(blocks, BYTE), "key").collect()}
    assert got == {c: hashlib.sha256(f"{a}\n{b}\n".encode()).hexdigest() for c, _, a, b in rows}


def test_tree(spark, turns):
    blocks, members = format_conversations(turns, BYTE)
    prefixes = {tuple(said[: i + 1]) for said in conversations(turns).values() for i in range(len(said))}
    rows = blocks.collect()
    tool = encoder(BYTE, special_as_text=True).library
    seen = []
    for b in rows:
        for i, n in enumerate(b.nodes):
            path, at = [], i
            while at >= 0:
                path.append(b.nodes[at])
                assert b.nodes[at].parent < at
                at = b.nodes[at].parent
            assert n.depth == len(path) - 1 and n.position == sum(x.end - x.start for x in path[1:])
            visible = {p for x in path[1:] for p in range(x.start, x.end)}
            assert {p for s in n.attend for p in range(s.start, s.end)} == visible
            assert all(s.end < t.start for s, t in zip(n.attend, n.attend[1:], strict=False))
            seen.append(tuple(parse("".join(tool.decode(b.ids[x.start : x.end], skip_special_tokens=False) for x in reversed(path)))))
        assert [n.start for n in b.nodes] == [0, *(n.end for n in b.nodes[:-1])] and b.nodes[-1].end == len(b.ids)
    assert set(seen) == prefixes
    if len(rows) == 1:
        assert len(seen) == len(prefixes)  # shared turns are emitted once
    assert members.count() == len(conversations(turns))


def test_escapes():
    for t in NASTY:
        assert unescape(escape(t or "")) == (t or "")
        assert parse("".join(turn_parts("a\n" + (t or ""), t or ""))) == [("a\n" + (t or ""), t or "")]
    with pytest.raises(ValueError):
        parse("<turn>user\nhi")


def test_no_turns(spark, turns):
    blocks, members = format_conversations(turns.where("1 = 0"), BYTE)
    assert blocks.count() == members.count() == read_back(blocks, BYTE).count() == 0
