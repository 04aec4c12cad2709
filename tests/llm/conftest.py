import random

import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "sé", "вы") for b in ("r", "nd", "ß", "x1", "ö", "q")]
SCHEMA = "doc_id long, text string, n_words string, spans int, kept string, `a.b` string, __text int, __drops string, __k1 int, __row int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) + r.choice(WORDS)
        out.append(w.capitalize() if i % 9 == 0 else w)
        out.append(".\n" if i % 17 == 16 else " ")
    return "".join(out)


@pytest.fixture(scope="session")
def rows():
    """Texts with nulls, blanks, repeats, near copies, one long text, odd characters."""
    r = random.Random(7)
    out = [(i, prose(i, 30 + 7 * i)) for i in range(20)]
    for i in range(20, 30):  # near copies of document 5
        w = out[5][1].split(" ")
        for _ in range(i - 20):
            w[r.randrange(len(w))] = "neu"
        out.append((i, " ".join(w)))
    out += [(30, out[3][1]), (31, out[3][1].upper()), (32, None), (33, ""), (34, " \n\t "), (35, "one two"), (36, "One  TWO"), (37, prose(99, 4000)), (38, "a\nshared line of text\n\nb"), (39, "  SHARED line of text \nc\r\n")]
    out += [(None, "shared line of text\nown"), (None, None), (2, out[2][1]), (2, out[2][1]), (40, "日本語 😀 text 😀 text 😀 text"), (41, "\x00odd\x1f bytes \u2028 here"), (42, "don't <|endoftext|> we'll  go'VE\u00a0x ３ ")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns that clash with results' names."""
    return spark.createDataFrame([(a, b, "x", 1, "y", "dot", 7, "drop", 3, 4) for a, b in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
