"""Near-duplicate documents: SetSketch registers, banded; candidates estimated jointly by likelihood;
links verified on the full sets of word shingles; components of the links.

Stages, each distributed, none that emits all pairs of a group:

1. One pass makes, for each document, the size of its shingle set, a 128-bit fingerprint of the set and
   M registers. Documents of equal sets form one class, named after its least doc_id (partial aggregates).
2. Classes share a bucket where ROWS consecutive registers agree, in BANDS bands: with 32 bands of 4, a
   pair at similarity 0.8 is missed once in 2 * 10^7. In each bucket every class is paired with the least
   one alone (a star), so pairs are fewer than BANDS per class.
3. Pairs whose sizes, or whose likelihood estimate, rule the threshold out are left; the estimate must
   fall SLACK short for that (over five standard errors). The rest is verified on the sets themselves.
4. Where a star leaves a group of candidates in several components, links may run between its other
   members. Those outside the group's largest component are compared with all of the group, in blocks of
   about BLOCK sets: a block pair's similarities come at once from one product of incidence matrices,
   exactly, and only links that join components leave it. A group of over DENSE such members, as many
   documents with the same frame make, is first cut by what its members share: one band, then, where that
   is still over DENSE, two, then three (a pair at 0.8 shares fewer than three of its bands once in 8 * 10^4;
   it needs them only if each band that it shares is such a large group). So the number of sets compared
   grows with the documents. No cap: what three bands leave together is compared in blocks, however much.
5. Components of all links.

Every group that a task holds is bounded: a block, or one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.llm import setsketch, textarrays
from arbolex.llm.common import KEY, refuse_clashes, row_key, stored
from arbolex.llm.graph import components

BANDS, ROWS = 32, 4
SLACK = 0.2
BLOCK = 200
#: Members outside the main component from which a group is cut by its members' bands.
DENSE = 10 * BLOCK
#: Bound of the number of groups whose sizes are broadcast.
HOT = 2_000


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By chunks of rows: the concatenated sets of distinct shingles, ascending, and their bounds."""
    for _, bounds, data in textarrays.chunks(texts):
        data = textarrays.lowered(data)
        starts, ends, rows = textarrays.word_spans(data, bounds, textarrays.SPACE)
        found, at = textarrays.shingles(textarrays.span_hashes(data, starts, ends), rows, k)
        sets = [np.unique(found[at[i] : at[i + 1]]) for i in range(len(bounds) - 1)]
        yield np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, registers = [], [], [], []
            for sets, at in shingle_sets(batch.column("text"), k):
                sums = np.zeros((2, len(at)), np.uint64)
                for j, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
                    np.cumsum(textarrays.mix(sets + np.uint64(salt)), out=(total := np.zeros(len(sets) + 1, np.uint64))[1:])
                    sums[j, :-1] = np.diff(total[at])
                n.append(np.diff(at))
                f1.append(sums[0, :-1].view(np.int64))
                f2.append(sums[1, :-1].view(np.int64))
                registers += map(bytes, setsketch.sketch(sets, at))
            one = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n, f1, f2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEY, "doc_id")), pa.array(one[0], pa.int64()), pa.array(one[1], pa.int64()), pa.array(one[2], pa.int64()), pa.array(registers, pa.binary())], ["__k1", "__k2", "doc_id", "n", "node", "f2", "registers"])

    return run


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("ra", "rb")]
            size = [batch.column(c).to_numpy().astype(float) for c in ("na", "nb")]
            keep = setsketch.jaccard(*regs, *size) >= threshold - SLACK
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verified(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            a, i = batch.column("a"), 0
            for others, at in shingle_sets(batch.column("tb"), k):
                for j in range(len(at) - 1):
                    if a[i].as_py() != last:
                        last = a[i].as_py()
                        mine = next(shingle_sets(batch.column("ta").slice(i, 1), k))[0]
                    other = others[at[j] : at[j + 1]]
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    keep[i] = both > 0 and 100 * both >= percent * (len(mine) + len(other) - both)
                    i += 1
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sets[at[i] : at[i + 1]].tobytes() for sets, at in shingle_sets(batch.column("text"), k) for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "set"])

    return run


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """(i, j) of every linked pair, i from left and j from right: exact sizes of intersections by a matrix product."""
    size = np.array([len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = counts[inverse] > 1
    place = np.cumsum(counts > 1) - 1
    row, column = row[shared], place[inverse[shared]]
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [a, a + width]))
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[row[part], column[part] - a] = 1
        both += matrix[left] @ matrix[right].T
    union = size[left][:, None] + size[right][None, :] - both
    for i, j in zip(*np.nonzero((both > 0) & (100 * both >= percent * union)), strict=True):
        yield int(left[i]), int(right[j])


def _block_pair(percent: int):
    def run(group: pa.Table) -> pa.Table:
        comp = group.column("component").to_pylist()
        first = np.array(group.column("first").to_pylist())
        sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        left = np.flatnonzero(first)
        right = np.flatnonzero(~first) if not first.all() else left
        parent = {c: c for c in comp}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        out = []
        if len(right):
            for i, j in block_links(sets, left, right, percent):
                if (x := root(comp[i])) != (y := root(comp[j])):
                    parent[x] = y
                    out.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles long, component_id long, kept boolean: one row for each row of docs.

    Words are what white space parts, A-Z lower-cased. A document's set: its distinct shingles of k
    words; with fewer words, all its words as one. Documents are linked where 100 * intersection >=
    percent * union; component_id is the least doc_id reachable. Shingles are compared by 64-bit hashes.

    Null, empty or blank text: an empty set, linked with nothing. Null doc_id: not linked, component_id
    null, kept. Rows with one doc_id are one document, linked by any of its texts. Ties have no part: all
    links count. Empty table: no rows. Other columns are left out. Very long texts are whole.
    """
    refuse_clashes(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "__k1 long, __k2 long, doc_id long, n long, node long, f2 long, registers binary"
    sketches = stored(docs.select(*row_key("doc_id", "text"), "doc_id", "text").mapInArrow(_sketches(k), schema), "sketches")
    named = sketches.where("n > 0 AND doc_id IS NOT NULL")
    # a class of equal sets is a node, named by the first half of its fingerprint; its texts all serve
    nodes = named.groupBy("node", "f2").agg(F.min(F.struct("doc_id", *KEY)).alias("least"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    nodes = stored(nodes.select("node", "n", "registers", "least.*"), "classes")

    def band(i: int):
        return F.struct(F.lit(i).alias("band"), F.xxhash64(F.substring("registers", 1 + 2 * ROWS * i, 2 * ROWS)).alias("h"))

    members = nodes.select("node", "doc_id", F.explode(F.array(*map(band, range(BANDS)))).alias("x")).select("node", "doc_id", "x.*")
    hubs = members.groupBy("band", "h").agg(F.min(F.struct("doc_id", "node")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("band", "h", F.col("hub.node").alias("a"))
    star = stored(members.join(hubs, ["band", "h"]).where("node <> a").select("a", F.col("node").alias("b")).distinct(), "star")

    involved = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    texts = nodes.select("node", *KEY).join(involved, "node")
    texts = stored(docs.select(*row_key("doc_id", "text"), "text").join(texts, KEY).select("node", "text").dropDuplicates(["node"]), "texts")
    sizes = nodes.select("node", "n", "registers")
    likely = star.join(sizes.toDF("a", "na", "ra"), "a").join(sizes.toDF("b", "nb", "rb"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    likely = likely.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely(percent / 100), "a long, b long")
    pairs = likely.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    several = named.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = stored(pairs.mapInArrow(_verified(k, percent), "a long, b long").union(several), "links")

    named_by = stored(components(links, "a", "b"), "components")
    label = nodes.select("node", "doc_id", "n").join(named_by, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = components(stored(_rest(star, named_by, label, nodes, texts, k, percent), "more"), "a", "b").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    label = label.join(more, "component", "left").select("node", "doc_id", F.coalesce("whole", "component").alias("component"))
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = label.select("node", "component").join(least, "component").select("node", "component_id")
    linked = named.select(*KEY, "doc_id", "n", "node").join(label, "node").select("doc_id", "n", "component_id")
    alone = sketches.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _sized(rows: DataFrame) -> DataFrame:
    """Of rows (group, node, component, n), those of groups with several components: with the group's main component,
    its members and shingles, and those of the others. One aggregate by component, then by group."""
    parts = rows.groupBy("group", "component").agg(F.count("*").alias("members"), F.sum("n").alias("elements"))
    whole = parts.groupBy("group").agg(F.max(F.struct("members", "component", "elements")).alias("x"), F.sum("members").alias("all"), F.sum("elements").alias("every")).where(F.col("all") > F.col("x.members"))
    whole = whole.select("group", F.col("x.component").alias("main"), F.col("x.members").alias("members"), F.col("x.elements").alias("elements"), (F.col("all") - F.col("x.members")).alias("other_members"), (F.col("every") - F.col("x.elements")).alias("other_elements"), F.col("all").alias("every_row"))
    # groups of over 1 / HOT of all rows are fewer than HOT: they are broadcast, and their rows dealt out by node
    facts = F.struct("main", "members", "elements", "other_members", "other_elements")
    whole = stored(whole.select("group", facts.alias("facts"), "every_row"), "sizes")
    often = F.col("every_row") * HOT > whole.agg(F.sum("every_row")).scalar()
    hot = F.broadcast(whole.where(often).select("group", F.col("facts").alias("hot")))
    rest = whole.where(~often).select(F.col("group").alias("key"), "facts")
    rows = rows.join(hot, "group", "left").withColumn("key", F.when(F.col("hot").isNotNull(), F.col("node")).otherwise(F.col("group"))).join(rest, "key", "left")
    return rows.withColumn("facts", F.coalesce("hot", "facts")).where("facts IS NOT NULL").select("group", "node", "component", "n", "facts.*")


def _buckets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The groups of one large group of candidates: rows as _sized gives them. Members that share a band are a group;
    a group still of over DENSE others is cut anew by what its members share besides: two bands, then three."""
    label = rows.select("node", "component", "n").distinct()
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)])
    level = label.join(nodes.select("node", bands.alias("groups")), "node").select("node", "component", "n", F.explode("groups").alias("group"))
    after = lambda c, i: F.slice(c, i + 2, F.size(c))
    twos = lambda c: F.flatten(F.transform(c, lambda x, i: F.transform(after(c, i), lambda y: F.xxhash64(x, y))))
    threes = lambda c: F.flatten(F.transform(c, lambda x, i: F.transform(twos(after(c, i)), lambda y: F.xxhash64(x, y))))
    out, keys = None, None
    for cut in (twos, threes, None):
        sized = stored(_sized(level), "buckets")
        fine = sized if cut is None else sized.where(F.col("other_members") <= DENSE)
        out = fine if out is None else out.unionByName(fine)
        if cut is None:
            break
        big = sized.where(F.col("other_members") > DENSE)
        if big.isEmpty():
            break
        if keys is None:  # BANDS keys a node at most
            keys = stored(big.groupBy("node", "component", "n").agg(F.sort_array(F.collect_set("group")).alias("keys")), "keys")
        else:
            keys = keys.join(big.select("node").distinct(), "node", "left_semi")
        level = keys.select("node", "component", "n", F.explode(cut(F.col("keys"))).alias("group"))
    # groups of the same members say the same
    same = out.groupBy("group").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s")).groupBy("c", "s").agg(F.min("group").alias("group"))
    return out.join(same.select("group"), "group", "left_semi")


def _rest(star: DataFrame, named_by: DataFrame, label: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): components to be joined, by links between members of one group of candidates that the stars have left in different components."""
    open_ = star
    for c in ("a", "b"):
        open_ = open_.join(named_by.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    groups = stored(components(open_.select("ca", "cb"), "ca", "cb"), "groups").select(F.col("node").alias("component"), F.col("component").alias("group"))
    rows = stored(_sized(label.select("node", "component", "n").join(groups, "component")), "open")
    large = rows.where(F.col("other_members") > DENSE)
    if not large.isEmpty():
        rows = rows.where(F.col("other_members") <= DENSE).unionByName(_buckets(large, nodes))
    blocks = lambda members, elements: F.greatest(F.lit(1), F.ceil(members / BLOCK), F.ceil(elements / (2500 * BLOCK))).cast("int")
    rows = rows.select("group", "node", "component", (F.col("component") != F.col("main")).alias("other"), blocks(F.col("other_members"), F.col("other_elements")).alias("others"), blocks(F.col("members"), F.col("elements")).alias("mains"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("other"), F.col("others")).otherwise(F.col("mains"))).cast("int"))
    sets = rows.select("node").distinct().join(texts, "node").mapInArrow(_sets(k), "node long, set binary")
    pair = lambda i, j, first: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(first).alias("first"))
    own, others = F.col("own"), F.col("others")
    of_main = F.transform(F.sequence(F.lit(0), others - 1), lambda i: pair(i, others + own, False))
    of_other = F.transform(F.sequence(F.lit(0), others + F.col("mains") - 1), lambda j: F.when(j >= own, pair(own, j, True)).otherwise(pair(j, own, False)))
    rows = rows.join(sets, "node").select("group", "component", "set", F.explode(F.when(F.col("other"), of_other).otherwise(of_main)).alias("x")).select("group", "component", "set", "x.*")
    return rows.groupBy("group", "i", "j").applyInArrow(_block_pair(percent), "a long, b long")
