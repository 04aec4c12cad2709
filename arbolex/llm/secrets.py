"""Secret scans: multipart credential linking. DataFrame functions only.

Strong parts are reported wherever they stand. Weak parts (names of accounts, mixed strings, endpoints)
are reported only where a complementary part stands in the same scope: an interval join of parts on
(document, block of positions), blocks as long as the scope, with the distance as residual condition.
Positions come from the texts between matches: a regex split gives the gaps, their running lengths the
offsets, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolex.llm.common import KEY, of_row, refuse_clashes, row_key, stored, whole_row

#: kind: (pattern, group whose length counts, least length, role, strong, pattern the value must also have)
KINDS = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, "secret", True, None),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, "access", True, None),
    "hex": (r"[0-9a-f]+", 0, 32, "secret", True, None),
    "account": (r"(?i:\b(?:user|username|login|account|client_?id))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._+-]+)", 1, 3, "access", False, None),
    "endpoint": (r"\b(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://([A-Za-z0-9._~:/?#@!$&*+,;=%-]+)", 1, 4, "endpoint", False, None),
    "mixed": (r"\b[A-Za-z0-9+/]{20,}=*", 0, 20, "secret", False, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
}
BASE = ("assign", "access", "hex")
#: A test that is quick and true wherever the pattern can hold a long enough match.
QUICK = {
    "hex": r"[0-9a-f]{32}",
    "mixed": r"\b(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{20}",
}


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind, i, found, value, gap>>; empty where there is none."""
    pattern, group, least, *_ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.transform(F.arrays_zip(found.alias("found"), value.alias("value"), F.split(text, pattern).alias("gap")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["found"].alias("found"), x["value"].alias("value"), x["gap"].alias("gap")))
    none = F.array().cast("array<struct<kind:string,i:int,found:string,value:string,gap:string>>")
    return F.when(text.rlike(QUICK.get(kind, pattern)), each.cast("array<struct<kind:string,i:int,found:string,value:string,gap:string>>")).otherwise(none)


def parts(docs: DataFrame) -> DataFrame:
    """__k1, __k2, kind, start int, end int, role, strong: all parts, leftmost and non-overlapping within a kind."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*row_key("doc_id", "text"), F.explode(F.concat(*[_matches(text, k) for k in KINDS])).alias("m")).select(*KEY, "m.*").where(F.col("found").isNotNull()).distinct()
    before = F.sum(F.length("gap") + F.length("found")).over(Window.partitionBy(*KEY, "kind").orderBy("i"))
    rows = rows.select(*KEY, "kind", "value", "found", before.alias("end"))
    own = F.lit(False)
    for kind, (_, _, least, _, _, also) in KINDS.items():
        ok = (F.col("kind") == kind) & (F.length("value") >= least)
        own = own | (ok & F.col("value").rlike(also) if also else ok)
    pick = lambda j: F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[j])])[F.col("kind")]
    return rows.where(own).select(*KEY, "kind", (F.col("end") - F.length("found")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), pick(3).alias("role"), pick(4).alias("strong"))


def linked(found: DataFrame, scope: int) -> DataFrame:
    """The weak parts of found that have a complementary part at most scope code points away.

    A secret needs an access identifier or an endpoint; an access identifier or endpoint needs a secret.
    """
    weak = found.where(~F.col("strong"))
    block = (F.col("start") / scope).cast("int")
    # a part may be longer than the scope: it stands in every block that it touches or is near
    weak = weak.withColumn("__b", F.explode(F.sequence(((F.col("start") - scope) / scope - 1).cast("int"), ((F.col("end") + scope) / scope).cast("int"))))
    other = found.select(*KEY, F.explode(F.sequence(block, (F.col("end") / scope).cast("int"))).alias("__b"), F.col("start").alias("__s"), F.col("end").alias("__e"), (F.col("role") == "secret").alias("__secret"))
    near = (F.col("__s") - F.col("end") <= scope) & (F.col("start") - F.col("__e") <= scope)
    rest = F.col("__secret") != (F.col("role") == "secret")
    apart = (F.col("__s") >= F.col("end")) | (F.col("start") >= F.col("__e"))
    return weak.join(other, [*KEY, "__b"]).where(near & rest & apart).select(*found.columns).distinct()


def secret_scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Columns of docs, then spans array<struct<start int, rank int, kind string, end int>>, by start and then kind.

    Kinds and their rank are those of KINDS in order; the first three are strong. Ends are exclusive,
    positions count code points. Null or empty text: no spans. Null and repeated doc_ids, and rows that
    repeat: each row has its own spans. Empty table: no rows. Other columns pass through; one named
    spans is replaced.
    """
    refuse_clashes(docs, "doc_id", "text")
    docs = docs.drop("spans")
    found = stored(parts(docs), "parts")  # read three times below; texts are searched once
    spans = found.where("strong").unionByName(linked(found, scope))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])[F.col("kind")]
    spans = spans.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return docs.select(whole_row(docs), *row_key("doc_id", "text")).join(spans, KEY, "left").select(*of_row(docs), F.coalesce("spans", none).alias("spans"))
