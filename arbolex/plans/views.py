"""The engine's inputs over plain tables: documents as parsed sentences, embeddings as a model.

A parse: words are what blanks and newlines part, lower-cased; the lemma is a word without what is neither
letter nor digit; the head is half the position; the relation r0 .. r4 follows the length; tags go round.
Pure punctuation gets the relation PUNC and no lemma. The same view in SQL is PARSE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ["Ncmsny", "Vmip3s-a-p", "Afpmsnf", "Sp-l", "R", "Npfsgy", "C", "Q"]
#: Dimensions of the model view: syntactic, associative, grammatical.
SIZES = (40, 24, 0)


def _forms(text: str = "text"):
    return F.array_remove(F.split(F.lower(text), "[ \n]+"), "")


def _lemma(form):
    return F.regexp_replace(form, r"[^\p{L}\p{N}]", "")


def _relation(form, lemma):
    return F.when(lemma == "", "PUNC").otherwise(F.concat(F.lit("r"), (F.length(form) % 5).cast("string")))


def parsed(docs: DataFrame) -> DataFrame:
    """sent_id long, toks array<struct of the ten fields>: one row for each document with a word."""
    tags = F.array(*map(F.lit, TAGS))

    def token(x, i):
        form, lemma = x["form"], x["lemma"]
        return F.struct(
            (i + 1).cast("string").alias("id"), form.alias("form"), F.when(lemma == "", "_").otherwise(lemma).alias("lemma"), F.lit("_").alias("upos"), F.lit("_").alias("xpos"), F.get(tags, i % len(TAGS)).alias("feats"),
            F.floor((i + 1) / 2).cast("string").alias("head"), _relation(form, lemma).alias("deprel"), F.lit("_").alias("deps"), F.lit("_").alias("misc"),
        )

    return _sentences(docs, token)


def _once(rows: DataFrame, **made) -> DataFrame:
    """rows with the columns made, each worked out once a row: the generator between keeps the optimizer from
    copying their expressions into every filter and projection that reads them."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def sentences(docs: DataFrame) -> DataFrame:
    """sent_id, toks of the same parse with the fields form, lemma, feats, head and deprel alone."""
    tags = F.array(*map(F.lit, TAGS))

    def token(x, i):
        form, lemma = x["form"], x["lemma"]
        return F.struct(form.alias("form"), F.when(lemma == "", "_").otherwise(lemma).alias("lemma"), F.get(tags, i % len(TAGS)).alias("feats"), F.shiftright(i + 1, 1).cast("string").alias("head"), _relation(form, lemma).alias("deprel"))

    return _sentences(docs, token)


def _sentences(docs: DataFrame, token) -> DataFrame:
    """sent_id, toks of token(word, place); forms, lemmas and tokens are each made once a document, and filters read forms alone."""
    rows = _once(docs.select(F.col("doc_id").alias("sent_id"), _forms().alias("forms")).where(F.size("forms") > 0), words=F.transform("forms", lambda x: F.struct(x.alias("form"), _lemma(x).alias("lemma"))))
    return _once(rows.select("sent_id", "words"), toks=F.transform("words", token)).select("sent_id", "toks")


def flat(docs: DataFrame, heads: bool = True) -> DataFrame:
    """The same parse, a row for each token: sent_id, pos, form, lemma, feats, deprel, head, and, if heads are wanted,
    the head's values in parent_form, parent_lemma, parent_deprel (null without one)."""
    rows = docs.select(F.col("doc_id").alias("sent_id"), _forms().alias("forms")).select("sent_id", "forms", F.posexplode_outer("forms").alias("i", "form")).where("form IS NOT NULL")
    up = F.shiftright(F.col("i") + 1, 1)
    above = F.get("forms", up - 1)
    rows = rows.select("sent_id", "i", "form", up.alias("head"), *[above.alias("above")] * heads)
    rows = _once(rows, l=_lemma(F.col("form")), **({"al": _lemma(F.col("above"))} if heads else {}))
    known = lambda x: F.when(F.col(x) == "", "_").otherwise(F.col(x))
    there = F.col("above").isNotNull()
    parent = [F.col("above").alias("parent_form"), known("al").alias("parent_lemma"), F.when(there, _relation(F.col("above"), F.col("al"))).alias("parent_deprel"), F.when(there, "_").alias("parent_misc")] if heads else []
    return rows.select(
        "sent_id", (F.col("i") + 1).alias("pos"), "form", known("l").alias("lemma"), F.get(F.array(*map(F.lit, TAGS)), F.col("i") % len(TAGS)).alias("feats"),
        _relation(F.col("form"), F.col("l")).alias("deprel"), "head", F.lit("_").alias("misc"), *parent,
    )


def counted(docs: DataFrame) -> DataFrame:
    """form, lemma, deprel, n: the tokens of flat, counted by form before a form's lemma is made."""
    rows = docs.select(F.explode_outer(_forms()).alias("form")).where("form IS NOT NULL").groupBy("form").agg(F.count("*").alias("n"))
    rows = _once(rows, l=_lemma(F.col("form")))
    return rows.select("form", F.when(F.col("l") == "", "_").otherwise(F.col("l")).alias("lemma"), _relation(F.col("form"), F.col("l")).alias("deprel"), "n")


PARSE_SQL = """f AS (SELECT doc_id AS sent_id, regexp_split_to_array(lower(text), '[ \\n]+') AS w FROM documents),
u AS (SELECT sent_id, unnest(list_filter(w, lambda x: x <> '')) AS form, generate_subscripts(list_filter(w, lambda x: x <> ''), 1) AS pos FROM f),
toks AS (SELECT sent_id, pos, form, CASE WHEN l = '' THEN '_' ELSE l END AS lemma, pos // 2 AS head,
  CASE WHEN l = '' THEN 'PUNC' ELSE 'r' || (length(form) % 5) END AS deprel, ['Ncmsny', 'Vmip3s-a-p', 'Afpmsnf', 'Sp-l', 'R', 'Npfsgy', 'C', 'Q'][(pos - 1) % 8 + 1] AS feats
  FROM (SELECT *, regexp_replace(form, '[^\\p{L}\\p{N}]', '', 'g') AS l FROM u))"""


def model(embeddings: DataFrame) -> DataFrame:
    """idx long, word string, vec array<float>."""
    return embeddings.select(F.col("vec_id").alias("idx"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").cast("array<float>").alias("vec"))


MODEL_SQL = "model AS (SELECT vec_id AS idx, 'w' || vec_id AS word, embedding AS vec FROM embeddings)"


def scored(embeddings: DataFrame) -> DataFrame:
    """word1, word2, sim 0/1: each vector with the three after it, alike if their labels are."""
    e = embeddings.select(F.col("vec_id").alias("a"), F.col("label").alias("la"))
    pairs = e.select("a", "la", F.explode(F.array(*[F.col("a") + d for d in (1, 2, 3)])).alias("b"))
    pairs = pairs.join(embeddings.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
    word = lambda c: F.concat(F.lit("w"), F.col(c).cast("string"))
    return pairs.select(word("a").alias("word1"), word("b").alias("word2"), (F.col("la") == F.col("lb")).cast("int").alias("sim"))


PAIRS_SQL = """pairs AS (SELECT 'w' || a.vec_id AS word1, 'w' || b.vec_id AS word2, (a.label = b.label)::INT AS sim
  FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3)"""
