"""Grouped prefix join on word n-gram sets (Jaccard similarity).

A document is its set of 3-word shingles (64-bit hashes). Documents with equal
sets collapse to one node. A node's shingles are ordered rarest first and its
prefix kept, long enough that two sets of the wanted similarity share a prefix
shingle. The order is by the count of a shingle's least frequent word, an upper
bound of the shingle's own frequency, taken from a table of fixed size over all
words of all documents. Nodes of equal prefix and size form one group; an
inverted index over groups, kept apart by size bands (sets of the wanted
similarity lie in the same or in neighbouring bands), gives group pairs,
filtered by size and position, then expanded to members. Members are compared
by parity bitmaps (their Hamming distance never exceeds the sets' difference,
so no link is lost), and what passes is verified exactly on the sets.

Components do not need all pairs of a large class of near copies. In the first
round a posting list gives a spanning forest of the pairs that pass the
bitmaps. Where all its pairs prove to be links, the list is done: whatever else
passes lies inside one component. Lists with a refuted pair come again: per
member the first partners of another component that are not yet refuted, more
of them in every round, until each such pair between different components has
been verified. So the components are those of all links. Posting lists longer
than ``BLOCK`` are dealt to pairs of blocks, so no task holds a whole hot list.

Edge cases: a text of fewer than three words is one shingle, its whole
sequence; null and empty texts have no shingles and link with nothing; repeated
rows belong to the same component; component_id is the smallest non-null id.
Hashes of 64 bits stand for shingles: the odds of a wrong comparison are about
|set|^2 / 2^64 a pair.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsight.llm.common import WordHashes, discard, gram_hashes, materialise, near_keys, slices, without, words
from jobsight.llm.components import connected_components

SHINGLE = 3
#: Slots of the word count table (4 MB), whatever the vocabulary.
COUNT_BITS = 20
_BLOCKS = 16                       # rows in which a partition hands over its table
_FAN_IN = 64
#: Bits of the smallest bitmap.
MIN_BITS = 512
#: Members of a posting list that are compared in one task's block.
BLOCK = 1000


# ------------------------------------------------------------ word count table

def _add_tables(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << COUNT_BITS, dtype=np.uint64)[:(1 << COUNT_BITS) // _BLOCKS]
    for data in rows["counts"]:
        total += np.frombuffer(data, dtype=np.uint32)
    low = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
    return pd.DataFrame({"part": [int(key[1])], "block": [int(key[0])], "counts": [low.tobytes()]})


def word_count_table(docs: DataFrame) -> np.ndarray:
    """Counts of all words of ``docs.text`` in 2^COUNT_BITS hashed slots (saturating),
    summed over the partitions in a tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for batch in slices(batches):
            h = hashes.of([w for t in batch.column(0).to_pylist() for w in words(t)])
            total += np.bincount((h >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        low = np.minimum(total, 2**32 - 1).astype(np.uint32).reshape(_BLOCKS, -1)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * _BLOCKS, pa.int64()), pa.array(range(_BLOCKS), pa.int32()),
             pa.array([x.tobytes() for x in low], pa.binary())], ["part", "block", "counts"])

    schema = "part bigint, block int, counts binary"
    counted = tables = materialise(docs.select("text").mapInArrow(run, schema), "word-counts")
    parts = (tables.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // _FAN_IN)
        tables = (tables.withColumn("part", F.expr(f"part DIV {_FAN_IN}"))
                  .groupBy("block", "part").applyInPandas(_add_tables, schema))
    out = np.zeros((_BLOCKS, (1 << COUNT_BITS) // _BLOCKS), dtype=np.uint64)
    for _, block, counts in tables.collect():             # fixed size
        out[block] += np.frombuffer(counts, dtype=np.uint32)
    discard(counted)
    return np.minimum(out.reshape(-1), 2**27).astype(np.uint32)


# ---------------------------------------------------------------- one document

def shingles(ws: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes ascending, slot of the word counts for each of its words)."""
    h = hashes.of(ws)
    k = min(SHINGLE, len(ws))
    s, first = np.unique(gram_hashes(h, k) if k else h, return_index=True)
    slots = (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
    return s, np.stack([slots[first + i] for i in range(k)]) if k else np.empty((0, 0), np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def overlap_needed(na: int, nb: int, percent: int) -> int:
    """Smallest intersection of a link: 100 i >= percent (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of a set: a power of two of bits, at least one a shingle (a set
    travels with each of its prefix shingles) and MIN_BITS, so that small sets,
    where few shingles decide, are told apart well."""
    bits = max(MIN_BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1,
                       bitorder="little").tobytes()


def far_apart(x: int, y: int, bits_x: int, bits_y: int, limit: int) -> bool:
    """Whether two parity bitmaps prove a difference above ``limit`` (the larger is folded)."""
    while bits_x > bits_y:
        bits_x //= 2
        x = x >> bits_x ^ x & ((1 << bits_x) - 1)
    while bits_y > bits_x:
        bits_y //= 2
        y = y >> bits_y ^ y & ((1 << bits_y) - 1)
    return (x ^ y).bit_count() > limit


def _describe(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Per document: doc, n, node (128-bit digest of its set), group key, prefix, bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            n, node, group, prefix, bits = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s, slots = shingles(words(text), hashes)
                n.append(len(s))
                if not len(s):
                    node.append(None), group.append(None), prefix.append(None), bits.append(None)
                    continue
                rare = counts[slots].min(axis=0).astype(np.uint64)
                order = np.argsort(rare << np.uint64(36) | s >> np.uint64(28), kind="stable")
                p = s[order[:prefix_length(len(s), percent)]].view(np.int64)
                node.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                group.append(np.uint64(xxhash.xxh3_64_intdigest(p.tobytes())).view(np.int64))
                prefix.append(p)
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.string()), pa.array(group, pa.int64()),
                 pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                ["doc", "n", "node", "grp", "prefix", "bits"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "text").mapInArrow(
        run, f"doc {kind}, n bigint, node string, grp bigint, prefix array<bigint>, bits binary")


# ------------------------------------------------------------- candidate pairs

class Member:
    __slots__ = ("n", "pos", "nid", "comp", "width", "bits", "old", "refuted")

    def __init__(self, n, pos, nid, comp, bits, old, refuted):
        self.n, self.pos, self.nid, self.comp, self.old = n, pos, nid, comp, old
        self.width, self.bits, self.refuted = len(bits) * 8, int.from_bytes(bits, "little"), frozenset(refuted or ())


def may_link(a: Member, b: Member, percent: int) -> bool:
    """Size, position and bitmap filters of a pair of one posting list; pairs of the
    older band meet in that band's own list."""
    if a.old and b.old or 100 * min(a.n, b.n) < percent * max(a.n, b.n):
        return False
    need = overlap_needed(a.n, b.n, percent)
    if min(a.pos, b.pos) + 1 + min(a.n - a.pos - 1, b.n - b.pos - 1) < need:
        return False
    return not far_apart(a.bits, b.bits, a.width, b.width, a.n + b.n - 2 * need)


def forest(members: list[Member], percent: int) -> Iterator[tuple]:
    """(a, b, False): pairs that pass the filters and connect all that any passing pair connects."""
    comps: list[list[Member]] = []
    for m in members:
        mine, rest = [m], []
        for c in comps:
            hit = next((x for x in c if may_link(x, m, percent)), None)
            if hit is None:
                rest.append(c)
            else:
                yield hit.nid, m.nid, False
                mine = c + mine
        comps = rest + [mine]


def partners(members: list[Member], percent: int, most: int) -> Iterator[tuple]:
    """(a, b, cut): for every member its first ``most`` passing, unrefuted partners of other
    components; cut where there are more."""
    for j, m in enumerate(members):
        found = 0
        for x in members[:j]:
            if x.comp != m.comp and x.nid not in m.refuted and may_link(x, m, percent):
                found += 1
                if found > most:
                    yield m.nid, m.nid, True
                    break
                yield x.nid, m.nid, False


def _candidates(entries: DataFrame, percent: int, most: int) -> DataFrame:
    """(token, band, a, b, cut) of all posting lists. ``entries``: token, band, x, y (block
    pair), grp, n, pos, nid, comp, old, bits, refuted. ``most`` 0: a spanning forest."""
    names = ["token", "band", "x", "y", "n", "pos", "nid", "comp", "old", "bits", "refuted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs_of(rows: list[tuple]) -> list[tuple]:
            members = [Member(n, pos, nid, comp, bits, old, refuted) for _, _, _, _, n, pos, nid, comp, old, bits, refuted in rows]
            found = partners(members, percent, most) if most else forest(members, percent)
            return [(rows[0][0], rows[0][1], a, b, cut) for a, b, cut in found]

        def batch_of(out: list) -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["token", "band", "a", "b", "cut"])

        held, out = [], []
        for batch in slices(batches, 1024):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:4] != row[:4]:
                    out += pairs_of(held)
                    held = []
                held.append(row)
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        if held:
            out += pairs_of(held)
        yield batch_of(out)

    dealt = (entries.select(*names).repartition("token", "band", "x", "y")
             .sortWithinPartitions("token", "band", "x", "y", "n", "nid"))
    return dealt.mapInArrow(run, "token bigint, band int, a bigint, b bigint, cut boolean")


def posting_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """(token, band, old, grp, n, pos, m): inverted index over groups, of the lists that hold
    two members of fitting sizes; ``m`` members in all. ``old``: the group's own band is
    the one below."""
    # few nodes share their prefix: the others are groups of their own, where they lie
    repeated = nodes.groupBy("grp").count().where("count > 1").select("grp")
    met = near_keys(nodes.select("grp", "n", "prefix"), repeated, "grp")
    groups = (met.where("NOT __near").select("grp", "n", "prefix", F.lit(1).cast("long").alias("members"))
              .unionByName(met.where("__near").groupBy("grp", "n").agg(F.first("prefix").alias("prefix"), F.count("*").alias("members"))))
    # one narrow row a posting, dealt once: by token, size and position packed, members
    postings = (groups.select("grp", "n", "members", F.posexplode("prefix").alias("pos", "token"))
                .select("token", "grp", F.expr("n * 4294967296 + pos").alias("at"), F.col("members").cast("int").alias("members")))
    of_token, of_list = Window.partitionBy("token"), Window.partitionBy("token", "band")
    width = math.log(100 / percent) * 1.001               # sizes of a link differ by less than one band
    own_band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")
    lists = (postings.withColumn("m", F.sum("members").over(of_token)).where("m > 1")
             .select("token", "grp", F.expr("at DIV 4294967296").alias("n"), F.expr("cast(at % 4294967296 AS INT)").alias("pos"), "members")
             .withColumn("old", F.explode(F.array(F.lit(False), F.lit(True))))
             .withColumn("band", own_band + F.col("old").cast("int")))
    return (lists.withColumn("m", F.sum("members").over(of_list)).withColumn("only_old", F.min("old").over(of_list))
            .where("m > 1 AND NOT only_old").drop("members", "only_old"))


def _entries(lists: DataFrame, nodes: DataFrame, comps: DataFrame | None, refuted: DataFrame | None) -> DataFrame:
    """Members of posting lists, long lists dealt to pairs of blocks; in later rounds only of
    lists that still span several components."""
    members = lists.join(nodes.select("grp", "n", "nid", "bits"), ["grp", "n"])
    if comps is None:
        members = members.withColumn("comp", F.col("nid")).withColumn("refuted", F.lit(None).cast("array<bigint>"))
    else:
        members = members.join(comps.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        spans = (members.groupBy("token", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .where("lo < hi").select("token", "band"))
        members = members.join(spans, ["token", "band"])
        both = refuted.select(F.col("a").alias("nid"), F.col("b").alias("other")).unionByName(
            refuted.select(F.col("b").alias("nid"), F.col("a").alias("other")))
        members = members.join(both.groupBy("nid").agg(F.collect_set("other").alias("refuted")), "nid", "left")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    side = F.expr(f"cast(pmod(xxhash64(nid), cast(ceil(m / {BLOCK}) AS INT)) AS INT)")
    return (members.withColumn("side", side).withColumn("other_side", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("x", F.least("side", "other_side")).withColumn("y", F.greatest("side", "other_side")))


# ------------------------------------------------------------------- verifying

def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(nid, items): the sets of ``wanted`` (nid, label, node), from the texts of their first documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            ids, out = [], []
            for nid, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                s, _ = shingles(words(text), hashes)
                if len(s) and xxhash.xxh3_128_hexdigest(s.tobytes()) == node:
                    ids.append(nid)
                    out.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["nid", "items"])

    # few texts are wanted: the others stay where they are
    near = near_keys(docs, wanted.withColumnRenamed("label", "doc"), "doc").where("__near OR doc IS NULL").drop("__near")
    return (near.join(wanted, near["doc"].eqNullSafe(wanted["label"])).select("nid", "node", "text")
            .mapInArrow(run, "nid bigint, items array<bigint>"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            lists = []
            for c in (2, 3):
                col = batch.column(c)
                values, ends = col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
                lists.append([values[ends[i]:ends[i + 1]] for i in range(batch.num_rows)])
            for x, y in zip(*lists):
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], ["a", "b", "link"])

    full = (pairs.join(sets.select(F.col("nid").alias("b"), F.col("items").alias("sb")), "b")
            .join(sets.select(F.col("nid").alias("a"), F.col("items").alias("sa")), "a"))
    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, link boolean")


# -------------------------------------------------------------------- operator

def jaccard_components(docs: DataFrame, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_shingles, component_id (smallest id reachable by links)."""
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    described = materialise(_describe(docs, word_count_table(docs), percent), "described")
    nodes = (described.where("n > 0").groupBy("node")
             .agg(F.min("doc").alias("label"), F.first("n").alias("n"), F.first("grp").alias("grp"),
                  F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
             .withColumn("nid", F.monotonically_increasing_id()))
    full = materialise(nodes, "nodes")
    short = materialise(described.select("doc", "n", "node"), "documents")
    discard(described)
    lists = materialise(posting_lists(full, percent), "lists")
    nodes = materialise(full.drop("prefix"), "nodes")
    discard(full)
    comps, tested, refuted, most = None, None, None, 0
    while True:
        found = materialise(_candidates(_entries(lists, nodes, comps, refuted), percent, most), "candidates")
        pairs = found.where("NOT cut").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        if not pairs.isEmpty():
            wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
                                 .join(nodes.select("nid", "label", "node"), "nid"), "wanted")
            sets = materialise(_sets(docs, wanted), "sets")
            checked = materialise(_verify(pairs, sets, percent), "checked")
            discard(wanted, sets, pairs)
            tested = checked if tested is None else tested.unionByName(checked)
            refuted = tested.where("NOT link").select("a", "b")
            before, comps = comps, connected_components(tested.where("link").select("a", "b"))
            discard(before)
        if tested is None:
            break
        # lists come again that stopped early, or (after the forest) that held a refuted pair
        again = found.where("cut").select("token", "band")
        if most == 0:
            ends = found.where("NOT cut").select("token", "band", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            again = ends.join(refuted, ["a", "b"]).select("token", "band")
        again = materialise(again.distinct(), "again")
        discard(found)
        if again.isEmpty():
            break
        before, lists = lists, materialise(lists.join(again, ["token", "band"]), "lists")
        discard(before, again)
        most = 8 * most or 4

    discard(lists)
    classes = nodes.select("node", "nid", "label")
    if comps is not None:
        classes = classes.join(comps.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        least = classes.groupBy("comp").agg(F.min("label").alias("component_id"))
        classes = classes.join(least, "comp")
    else:
        classes = classes.withColumn("component_id", F.col("label"))
    return (short.join(classes.select("node", "component_id"), "node", "left")
            .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of every component; a repeated row stays once.
    Rows without an id always stay. Decisions are taken by id: where one id stands for
    several texts and one of them belongs to another document, all its rows go."""
    gone = classes.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    kept = without(docs, gone, id_col)
    twice = materialise(classes.groupBy(id_col).count().where(f"count > 1 AND `{id_col}` IS NOT NULL").select(id_col), "repeated")
    if twice.isEmpty():
        return kept
    return kept.join(twice, id_col, "left_anti").select(docs.columns).unionByName(
        kept.join(twice, id_col, "left_semi").select(docs.columns).dropDuplicates([id_col, text_col]))
