"""MinHash near-duplicates with tensored banding.

Instead of one independent minhash tuple per table, two small collections of ``m`` tuples
each are computed and every pair (one of either) is a table key: m * m tables for 2 * m
tuples, about a square root of the minhash work. A pair of sets is a candidate if they agree
on some tuple of the first and some tuple of the second collection. Only tuples that two
classes or more share are combined, so texts that resemble nothing form no keys at all.
Candidates are verified on their full shingle sets.

Texts with equal shingle sets form a class and go on as one representative. Links come in
two rounds, so that a bucket of n never becomes n * n pairs. First each member is compared
with its buckets' hubs: the members whose tuples are shared most, such as the text that copies
were made from. Buckets whose other members then lie in one component are done. The members of
all others meet in a prefix join, which loses no link: with shingles ordered from rare to
common, two sets at the threshold share one of their first few, at places that leave enough
shingles behind them. Near copies just below the threshold differ in shingles that hardly
any other has, so they meet in none.

Before texts are fetched, every pair passes a bound from bitmaps of the sets, of 4 to 8 bits
a shingle: shingles whose bit the other set lacks are surely not in it. The bound is exact,
so no filter but the tables themselves can miss a link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import RangeHash, Scratch, arrow_limits, ascii_lower, matching_rows, mix64, slices, stored, utf8, words_of

WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False

ROWS = 2  # minhashes in a tuple
BITS = 4  # of a bitmap for each shingle, at least


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts on end, and the n + 1 bounds.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lowered. A text of
    fewer than ``width`` words, but not none, has its whole sequence as one shingle."""
    low = ascii_lower(data)
    lo, hi, first = words_of(low, bounds, WORD)
    words = RangeHash(low).of(lo, hi)
    n = np.diff(first)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(first[:-1] - ends[:-1], many) + np.arange(ends[-1])
    hashes = RangeHash(words).of(at, at + np.repeat(np.minimum(n, width), many))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[ends[:-1][many > 0]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[ends]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def bitmaps(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each set on end, and the n + 1 bounds: a power of two of 64-bit words, at least ``BITS`` bits a shingle.

    A shingle's bit is named by the leading bits of its hash; hashes are sorted in each set."""
    n = np.diff(ends)
    level = np.ceil(np.log2(np.maximum(n * BITS / 64, 1))).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(1 << level)])
    owner = np.repeat(np.arange(len(n)), n)
    place = hashes >> (58 - level).astype(np.uint64)[owner]
    word = starts[owner] + (place >> np.uint64(6)).astype(np.int64)
    out = np.zeros(starts[-1], np.uint64)
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first)
    return out, starts


def _halved(words: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width: neighbouring bits joined."""
    w = words | words >> np.uint64(1)
    for shift, mask in ((0, 0x5555555555555555), (1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        w = (w | w >> np.uint64(shift)) & np.uint64(mask)
    return w[0::2] | w[1::2] << np.uint64(32)


def signatures(docs: DataFrame, width: int, m: int, seed: int = 11) -> DataFrame:
    """Per row of docs (doc_id, own, key, text): doc_id, own, key, n (set size), s1 and s2 (a 128-bit hash of the set), tuples (2 m hashes), bits."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 63, 2 * m * ROWS, dtype=np.uint64)
    factor = rng.integers(0, 1 << 63, 2 * m * ROWS, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for lo, hi in slices(batch, bounds):
                hashes, ends = shingle_sets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], width)
                n = np.diff(ends)
                full = n > 0
                first = ends[:-1][full]
                sums = np.zeros((2, hi - lo), np.uint64)
                tuples = np.zeros((hi - lo, 2 * m), np.uint64)
                if len(first):
                    sums[0, full] = np.add.reduceat(hashes, first)
                    sums[1, full] = np.bitwise_xor.reduceat(mix64(hashes), first)
                    for t in range(2 * m):
                        h = np.full(len(first), t + 1, np.uint64)
                        for k in range(t * ROWS, t * ROWS + ROWS):
                            h = mix64(h ^ np.minimum.reduceat(mix64_fast(hashes ^ flip[k], factor[k]), first))
                        tuples[full, t] = h
                words, starts = bitmaps(hashes, ends)
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(_signed(x))) for at, x in ((np.arange(hi - lo + 1) * 2 * m, tuples.ravel()), (starts, words))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in ("doc_id", "own", "key")), pa.array(n, pa.int64()), pa.array(_signed(sums[0])), pa.array(_signed(sums[1])), *lists], ["doc_id", "own", "key", "n", "s1", "s2", "tuples", "bits"])

    return docs.select("doc_id", "own", "key", "text").mapInArrow(run, "doc_id long, own long, key long, n long, s1 long, s2 long, tuples array<long>, bits array<long>")


def mix64_fast(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    """One multiplication, its high half folded down: enough for inputs that are mixed already."""
    x *= factor
    x ^= x >> np.uint64(32)
    return x


def possible(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b, n_a, n_b, bits_a, bits_b) whose bitmaps leave the similarity possible. Sizes differ by less than a factor of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b")]
            wide = [np.diff(batch.column(c).offsets.to_numpy()) for c in ("bits_a", "bits_b")]
            keep = np.zeros(batch.num_rows, bool)
            for which in (wide[0] == wide[1], wide[0] > wide[1], wide[0] < wide[1]):
                rows = np.flatnonzero(which)
                if len(rows):
                    one, two = (batch.column(c).take(pa.array(rows)).flatten().to_numpy().view(np.uint64) for c in ("bits_a", "bits_b"))
                    one = _halved(one) if len(one) > len(two) else one
                    two = _halved(two) if len(two) > len(one) else two
                    at = np.concatenate([[0], np.cumsum(np.minimum(wide[0], wide[1])[rows])[:-1]])
                    apart = [np.add.reduceat(np.bitwise_count(x & ~y).astype(np.int64), at) for x, y in ((one, two), (two, one))]
                    both = np.minimum(sizes[0][rows] - apart[0], sizes[1][rows] - apart[1])
                    keep[rows] = (100 + percent) * both >= percent * (sizes[0] + sizes[1])[rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. texts: cls, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in ("text_a", "text_b"):
                coded = batch.column(c).dictionary_encode()  # a hub's text comes with each of its pairs
                data, bounds = utf8(coded.dictionary)
                parts = [shingle_sets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], width) for lo, hi in slices(coded.dictionary, bounds)]
                ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in parts]))]) if parts else np.zeros(1, np.int64)
                sides.append((coded.indices.to_numpy(), np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64), ends))
            keep = []
            for i in range(batch.num_rows):
                one, two = (h[e[k[i]] : e[k[i] + 1]] for k, h, e in sides)
                both = len(one) + len(two) - len(np.union1d(one, two))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _tokens(texts: DataFrame, width: int) -> DataFrame:
    """cls, n, token: the shingle hashes of each text. texts: cls, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for lo, hi in slices(batch, bounds):
                hashes, ends = shingle_sets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], width)
                n = np.diff(ends)
                cls = np.repeat(batch.column("cls")[lo:hi].to_numpy(), n)
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.repeat(n, n)), pa.array(_signed(hashes))], ["cls", "n", "token"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, n long, token long")


def prefix_pairs(texts: DataFrame, component: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """a, b of all pairs of ``texts`` (cls, text) that may reach the threshold and lie in different components. component: cls, component.

    Shingles are ordered by how many of the texts hold them, then by hash. Those of one text
    alone come first and need no join; of a set of n the first n - ceil(threshold * n) + 1
    count. Two sets meet where both hold a shingle among these, unless what is left
    behind its places is too little."""
    tokens = _tokens(texts, width)
    shared = tokens.groupBy("token").agg(F.count("*").alias("texts")).where("texts > 1")
    common = tokens.join(shared, "token").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "token"))).alias("common"))
    alone = F.col("n") - F.size("common")
    reach = F.floor(F.col("n") * (100 - percent) / 100) + 1
    heads = common.where(alone < reach).select("cls", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), (reach - alone).cast("int"))).alias("at", "x"))
    heads = heads.join(component, "cls").select("cls", "component", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("x.token").alias("token"))
    heads = scratch.stored(heads, "prefixes")
    one, two = (heads.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "component", "n", "at"))) for s in "ab")
    col = F.col
    larger = (col("n_a") > col("n_b")) | (col("n_a") == col("n_b")) & (col("cls_a") > col("cls_b"))
    both = F.least(col("n_a") - col("at_a"), col("n_b") - col("at_b"))  # this shingle and all behind it
    enough = (100 + percent) * both >= percent * (col("n_a") + col("n_b"))
    met = one.join(two, "token").where(larger & enough & (col("component_a") != col("component_b")))
    return met.select(col("cls_a").alias("a"), col("cls_b").alias("b")).distinct()


def _largest_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of the edges (a, b).

    Alternating large-star and small-star steps, each a grouping and a join; every round is a
    table in the shared folder."""
    scratch = Scratch()
    edges = scratch.stored(_largest_first(edges), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        before, edges = edges, scratch.stored(_largest_first(small), "edges")
        scratch.drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, m: int = 12) -> DataFrame:
    """Classes and components of near-duplicate documents.

    Per row of ``docs`` (doc_id, text; other columns are left out): doc_id, n_shingles (size
    of the set of ``width``-word shingles), component_id (the smallest doc_id reachable over
    links, its own included) and kept (doc_id = component_id). Two documents are linked if
    100 * intersection >= ``percent`` * union of their sets; links are confirmed on full sets.
    A direct link at the threshold t is missed with probability below 2 * (1 - t**2)**m, by
    all tables at once (5e-6 for t = 0.85 and m = 10, 9e-6 for 0.8 and 12; less for a higher
    similarity); no other filter misses one, but that sets are told apart by 64-bit hashes. Texts without words, and null texts, are linked with nothing; rows
    with one doc_id count as one document each and share a component if their texts are
    linked; rows without a doc_id are kept, alone and without a component; an empty table
    gives an empty result."""
    rows = _components_of_rows(docs.select("doc_id", F.col("doc_id").alias("own"), "text"), width, percent, m)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _components_of_rows(docs: DataFrame, width: int, percent: int, m: int) -> DataFrame:
    """doc_id, n, component_id, first of docs (doc_id, own, text): the component's smallest doc_id, and the doc_id of its row of the smallest own (null last), then doc_id."""
    arrow_limits(docs.sparkSession)
    scratch = Scratch()
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    sig = scratch.stored(signatures(docs, width, m).withColumn("cls", F.xxhash64("n", "s1", "s2")).drop("s1", "s2"), "signatures")
    rows = stored(sig.select("doc_id", "n", "cls"), "row-classes")
    named = F.struct(F.col("own").isNull().alias("none"), "own", "doc_id")
    classes = sig.where("n > 0 and doc_id is not null").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.min(named).alias("least"), *(F.first(c).alias(c) for c in ("tuples", "bits")))
    classes = scratch.stored(classes, "classes")
    scratch.drop(sig)

    members = scratch.stored(_buckets(classes, m, scratch), "members")
    # round 1: every member against its buckets' hubs
    pairs = members.where("cls <> hub").where(_sizes_fit("n", "hub_n", percent)).select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = scratch.stored(_bounded(pairs, classes, percent), "pairs")
    texts = scratch.stored(_class_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), classes, scratch), "texts")
    links = scratch.stored(verified(pairs, texts, width, percent), "links")
    near = components(links)

    # round 2: buckets with members that lie apart and have not been compared yet
    placed = members.where("cls <> hub").join(near.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    apart = scratch.stored(placed.join(open_keys, "key").select("cls", "component").distinct(), "apart")
    scratch.drop(members, pairs, texts)
    if not apart.isEmpty():
        texts = scratch.stored(_class_texts(docs, apart.select("cls"), classes, scratch), "texts")
        pairs = scratch.stored(_bounded(prefix_pairs(texts, apart, width, percent, scratch), classes, percent), "pairs")
        more = scratch.stored(verified(pairs, texts, width, percent), "links")
        near = components(links.union(more))

    # components are named by the smallest doc_id in them
    near = classes.select("cls", "rep", "least").join(near.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = near.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("least").getField("doc_id").alias("first"))
    found = stored(near.join(named, "component").select("cls", "component_id", "first"), "named")
    scratch.drop()
    return rows.join(found, "cls", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def _buckets(classes: DataFrame, m: int, scratch: Scratch) -> DataFrame:
    """key, cls, n, hub, hub_n: the members of all buckets of two or more, a bucket's hub being the member whose tuples are shared most.

    classes: cls, n, tuples."""
    tuples = classes.select("cls", "n", F.posexplode("tuples").alias("slot", "value"))
    shared = tuples.groupBy("value").agg(F.count("*").alias("held")).where("held > 1")
    side = lambda test: F.transform(F.filter("alive", test), lambda x: x.value)
    alive = tuples.join(shared, "value").groupBy("cls", "n").agg(F.collect_list(F.struct("slot", "value")).alias("alive"), F.sum("held").alias("score"))
    alive = alive.select("cls", "n", "score", side(lambda x: x.slot < m).alias("u"), side(lambda x: x.slot >= m).alias("v")).where("size(u) > 0 and size(v) > 0")
    keys = alive.select("cls", "n", "score", F.explode(F.flatten(F.transform("u", lambda x: F.transform("v", lambda y: F.xxhash64(x, y))))).alias("key"))
    keys = scratch.stored(keys, "keys")
    hubs = keys.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("score", "cls", "n")).alias("top")).where("size > 1")
    return keys.join(hubs, "key").select("key", "cls", "n", F.col("top.cls").alias("hub"), F.col("top.n").alias("hub_n"))


def _sizes_fit(one: str, two: str, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(one, two) * 100 >= F.greatest(one, two) * percent


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and bitmaps leave the similarity possible."""
    one, two = (classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab")
    return possible(pairs.join(one, "a").join(two, "b").where(_sizes_fit("n_a", "n_b", percent)), percent)


def _class_texts(docs: DataFrame, wanted: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """cls, text: one text of each wanted class. docs: key, text; wanted: cls; classes: cls, key."""
    wanted = scratch.stored(classes.join(wanted, "cls", "left_semi").select("key", "cls"), "wanted")
    held = matching_rows(docs.select("key", "text"), wanted.select("key"), "key")
    return held.dropDuplicates(["key"]).join(wanted, "key").select("cls", "text")


def _row_key(docs: DataFrame) -> Column:
    """A hash of a row's whole content, nulls told apart: equal rows, and only they but for chance, share it."""
    values = [F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*(F.col(f"`{c}`").isNull() for c in docs.columns), *values)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, m: int = 12) -> DataFrame:
    """``docs``, all columns, with exactly one row of each component of near-duplicate rows.

    Components are those of ``near_duplicates``, but of rows, whatever their doc_id: the row of
    the smallest doc_id stays (null last), among several the one of the least hash of the whole
    row, of equal rows one. Rows whose text has no words all stay."""
    key = _row_key(docs)
    found = _components_of_rows(docs.select(key.alias("doc_id"), F.col("doc_id").alias("own"), "text"), width, percent, m)
    found = stored(found.where("first is not null").select(F.col("doc_id").alias("__key"), (F.col("doc_id") == F.col("first")).alias("kept")), "rows")
    gone = stored(found.where("not kept").select("__key").distinct(), "gone")
    twice = stored(found.where("kept").groupBy("__key").count().where("count > 1").select("__key"), "twice")
    kept = docs.select(key.alias("__key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    left = matching_rows(kept, gone, "__key", "left_anti")
    if not twice.isEmpty():
        left = matching_rows(left, twice, "__key", "left_anti").union(matching_rows(left, twice, "__key").dropDuplicates(["__key"]))
    return left.select("__row.*")
