"""N-gram Jaccard join by vertical partitioning of the global shingle order.

The order is by hash, with shingles that many documents share last. It is
cut into fragments; a pair's overlap is counted per fragment and summed, as
long as the fragments to come can still lift it to the threshold. A partner
must share a shingle in the first quarter, early enough for what follows to reach
the threshold. Since shared passages stand last in the order, lists of
documents that only quote the same passage don't arise. Sets that are equal
form one class. Pairs with a few hubs of each list are tried first, so that large
groups of near copies become one component by a linear number of pairs; all
pairs across components that are then left are tried after that. A hub leaves
its list when it was tried, so short lists, which most are, end with their first round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lattica.llm.common import BROADCAST_ROWS, Scratch, components_of_few, doc_words, pieces, shingle_hashes, word_hashes

#: Shingles that repeat within a run of CHUNK of them go last in the order, the MOST_MARKED most frequent ones at most.
CHUNK, MOST_MARKED = 1 << 22, 1 << 21
#: Bits of the map that marks them; another shingle with the same bits goes last as well, alike in every set.
MAP_BITS = 26
FRAGMENTS = 4
#: Classes, of eight bytes each, that may be broadcast to filter the sets.
BROADCAST_NEEDED = 1_000_000
#: 64-bit words of a sketch: bit i is the parity of a set's shingles that fall on i.
SKETCH = 16
#: Rows of an Arrow batch: sets are wide, and batches lie outside the executors' heap.
BATCH_ROWS = 500
#: Hubs of a list, drawn by as many hashes, so that a group whose members are similar by chance becomes one component.
HUB_ROUNDS, HUBS = 2, 6


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, c, n, h): class (a hash of the set), set size, and the set as 64-bit integers in unsigned order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [np.unique(shingle_hashes(word_hashes(doc_words(t)), k)) for t in b.column("text").to_pylist()]
            raw = [s.tobytes() for s in sets]
            c = np.array([xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(c), pa.array([len(s) for s in sets], pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "c", "n", "h"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, c long, n long, h binary")


def first_of(n: int, percent: int) -> int:
    """How many of n shingles come first, so that a partner at the threshold must share one of them."""
    return n - -(-percent * n // 100) + 1


def shared_marks(sets: DataFrame, scratch: Scratch) -> np.ndarray:
    """Bit map of the shingles that several classes in a run of CHUNK shingles have. It has 2^MAP_BITS bits at any size of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # the classes of a task
        held, size = [], 0
        for b in chain(pieces(batches), [None]):
            for c, raw in zip(b.column("c").to_pylist(), b.column("h").to_pylist()) if b else ():
                if c not in seen:
                    seen.add(c)
                    held.append(np.frombuffer(raw, np.int64))
                    size += len(held[-1])
            if held and (b is None or size >= CHUNK):
                u, m = np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(u[m > 1]), pa.array(m[m > 1].astype(np.int32))], names=["t", "m"])

    found = sets.where("n > 0").select("c", "h").mapInArrow(run, "t long, m int").groupBy("t").agg(F.sum("m").alias("m"))
    found = scratch.save(found.select("t", F.least("m", F.lit(1 << 16)).cast("int").alias("m")))
    least, total = 2, 0
    for r in found.groupBy("m").count().orderBy(F.desc("m")).collect():  # at most 2^16 counts
        total += r["count"]
        if total > MOST_MARKED:
            least = r["m"] + 1
            break
    marks = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for part in found.where(F.col("m") >= least).select(F.col("t").bitwiseAND((1 << MAP_BITS) - 1).alias("b")).toArrow().column("b").chunks:
        b = part.to_numpy()
        np.bitwise_or.at(marks, b >> 3, (1 << (b & 7)).astype(np.uint8))
    scratch.drop(found)
    return marks


def is_shared(h: np.ndarray, marks: np.ndarray) -> np.ndarray:
    b = h & ((1 << MAP_BITS) - 1)
    return (marks[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0


def posts_of(sets: DataFrame, marks, percent: int) -> DataFrame:
    """(t, c, n, p, u): the shingles of which a partner must share one, with their places in the order; u is the number of the set's unmarked shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # the classes of a task
        for b in pieces(batches):
            ts, cs, ns, ps, us = [], [], [], [], []
            for c, n, raw in zip(b.column("c").to_pylist(), b.column("n").to_pylist(), b.column("h").to_pylist()):
                if n == 0 or c in seen:
                    continue
                seen.add(c)
                h = np.frombuffer(raw, np.int64)
                last = is_shared(h, marks.value)
                first = first_of(n, percent)
                ts.append(np.concatenate((h[~last][:first], h[last]))[:first])
                cs.append(np.full(first, c))
                ns.append(np.full(first, n, np.int32))
                ps.append(np.arange(first, dtype=np.int32))
                us.append(np.full(first, n - last.sum(), np.int32))
            if ts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ts, cs, ns, ps, us)], names=["t", "c", "n", "p", "u"])

    return sets.select("c", "n", "h").mapInArrow(run, "t long, c long, n int, p int, u int")


def sketch_of(h: np.ndarray) -> np.ndarray:
    """Where two sketches differ, a shingle stands in one set only, so the sets differ in at least as many shingles."""
    bits = np.bincount((h >> 32) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def fragments_of(sets: DataFrame, marks) -> DataFrame:
    """(c, n, s, k, f0, f1, ..): of each class, its sketch, its shingles by fragment (the first one for marked ones, the others hash ranges) and their numbers."""
    names = [f"f{i}" for i in range(FRAGMENTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for c, n, raw in zip(b.column("c").to_pylist(), b.column("n").to_pylist(), b.column("h").to_pylist()):
                h = np.frombuffer(raw, np.int64)
                frag = ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(FRAGMENTS - 1) >> np.uint64(32)).astype(np.int32) + 1
                frag[is_shared(h, marks.value)] = 0
                rows.append((c, n, sketch_of(h), np.bincount(frag, minlength=FRAGMENTS), *(h[frag == i] for i in range(FRAGMENTS))))
            cols = list(zip(*rows)) if rows else [()] * (4 + FRAGMENTS)
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * (2 + FRAGMENTS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["c", "n", "s", "k", *names])

    return sets.select("c", "n", "h").mapInArrow(run, "c long, n long, s array<long>, k array<long>, " + ", ".join(f"{x} array<long>" for x in names))


def verified(pairs: DataFrame, frags: DataFrame, percent: int, few: bool) -> DataFrame:
    """Pairs (a, b) of classes at or above the threshold, by partial overlaps summed fragment by fragment.

    A pair goes as soon as its overlap so far and the smaller sizes of all
    later fragments can't reach the threshold. One statement counts all
    fragments: nearly all pairs need the last one, and each join sends the
    sets anew. few: the pairs may be broadcast, so that only their classes are sent.
    """
    if few:
        frags = frags.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("c"))), "c", "left_semi")
    left, right = (frags.select(F.col("c").alias(x), *(F.col(f).alias(f"{f}{x}") for f in frags.columns if f not in ("c", "s"))) for x in "ab")
    room = [sum((F.least(F.col("ka")[j], F.col("kb")[j]) for j in range(i + 1, FRAGMENTS)), F.lit(0).cast("long")) for i in range(FRAGMENTS)]
    parts = F.array(*(F.struct(F.col(f"f{i}a").alias("x"), F.col(f"f{i}b").alias("y"), room[i].alias("room")) for i in range(FRAGMENTS)))
    reach = lambda most: 100 * most >= percent * (F.col("na") + F.col("nb") - most)
    # bound to a lambda's variable, an overlap is counted once; null, a pair that has gone, stays null
    step = lambda i, f: F.element_at(F.transform(F.array(i + F.size(F.array_intersect(f.x, f.y))), lambda now: F.when(reach(now + f.room), now)), 1)
    return pairs.join(left, "a").join(right, "b").where(F.aggregate(parts, F.lit(0).cast("long"), step).isNotNull()).select("a", "b")


def can_reach(percent: int, x: tuple[Column, Column, Column], y: tuple[Column, Column, Column]) -> Column:
    """Whether two sets (size, place, unmarked shingles) can be similar enough if their first common shingle stands at these places.

    What they share is at most what follows that place in either, and at most
    the smaller of their marked and of their unmarked parts.
    """
    (n, p, u), (m, q, v) = x, y
    return (100 + percent) * F.least(n - p, m - q, F.least(n - u, m - v) + F.least(u, v)) >= percent * (n + m)


def sketches_allow(percent: int, s: Column, r: Column, both: Column) -> Column:
    """Whether sets with these sketches and this sum of sizes can be similar enough: at the threshold they differ in (100 - percent) / (100 + percent) of it."""
    apart = sum((F.bit_count(s[i].bitwiseXOR(r[i])) for i in range(1, SKETCH)), F.bit_count(s[0].bitwiseXOR(r[0])))
    return (100 + percent) * apart <= (100 - percent) * both


def alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the sketches (c, n, s) of both allow, which loses no link."""
    left, right = (sketches.select(*(F.col(c).alias(x if c == "c" else f"{c}{x}") for c in ("c", "n", "s"))) for x in "ab")
    return pairs.join(left, "a").join(right, "b").where(sketches_allow(percent, F.col("sa"), F.col("sb"), F.col("na") + F.col("nb"))).select("a", "b")


def candidates(live: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list's rows across components that can be similar enough, but for those of its largest component with itself.

    Most pairs of a loose group of near copies are just below the threshold;
    sizes and places let them through, the sketches (c, s) hardly any.
    """
    slim = live.select("t", "c", "n", "p", "u", "comp").join(sketches, "c").repartition("t")  # dealt once, for all that follows
    per = slim.groupBy("t", "comp").agg(F.count("*").alias("m"))
    top = per.groupBy("t").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"))
    sides = [slim.select(*(F.col(c).alias(f"{c}{i}") for c in slim.columns)) for i in (1, 2)]
    left = sides[0].join(top.withColumnRenamed("t", "t1"), "t1").where("comp1 <> most")
    apart = (F.col("comp1") != F.col("comp2")) & ((F.col("comp2") == F.col("most")) | (F.col("comp1") < F.col("comp2")))
    near = can_reach(percent, *((F.col(f"n{i}"), F.col(f"p{i}"), F.col(f"u{i}")) for i in (1, 2)))
    near = near & sketches_allow(percent, F.col("s1"), F.col("s2"), F.col("n1") + F.col("n2"))
    return left.join(sides[1], (F.col("t1") == F.col("t2")) & apart & near).select(F.col("c1").alias("x"), F.col("c2").alias("y"))


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    component_id is the smallest doc_id reachable by links of at least
    percent/100 Jaccard between sets of k-word shingles. Null and empty texts
    have no shingles and no link. Equal sets are linked. Rows that repeat an
    id are rows of their own. A component whose ids are all null has a null
    component_id. Other columns are ignored; an empty table gives none.
    """
    out = jaccard_members(docs, "doc_id", k, percent)
    return out.select("doc_id", "n_shingles", "component_id")


def jaccard_members(docs: DataFrame, key: str, k: int = 5, percent: int = 75) -> DataFrame:
    """jaccard_classes with the name of the id column free, and comp, the component itself: null without shingles."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard", BATCH_ROWS)
    docs = docs.select(F.col(key).alias("doc_id"), "text")
    sets = scratch.save(sets_of(docs, k).withColumn("row", F.monotonically_increasing_id()))
    marks = spark.sparkContext.broadcast(shared_marks(sets, scratch))  # 2^MAP_BITS bits
    posts = posts_of(sets, marks, percent)
    # a class can come once a task; copies only make this filter let more through
    shared = scratch.save(posts.select("t").repartition("t").groupBy("t").agg(F.count("*").alias("m")).where("m > 1").select("t"))
    live = scratch.save(posts.join(shared, "t", "left_semi").distinct())
    scratch.drop(shared)
    # one row per class that has a partner: rows are picked by number, so that no set is shuffled
    needed = scratch.save(sets.select("c", "row").join(live.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.min("row").alias("row")).select("row"))
    few = needed.count() <= BROADCAST_NEEDED
    frags = scratch.save(fragments_of(sets.join(F.broadcast(needed) if few else needed, "row", "left_semi"), marks))
    members = scratch.save(sets.select("doc_id", F.when(F.col("n") > 0, F.col("c")).alias("c"), F.col("n").alias("n_shingles")))
    scratch.drop(sets, needed)
    marks.destroy()
    links, labels = None, None
    for step in range(HUB_ROUNDS + 1):
        rows = (live.where("stay") if step else live).select("t", "c", "n", "p", "u")
        rows = rows.withColumn("comp", F.col("c")) if labels is None else rows.join(labels, "c", "left").withColumn("comp", F.coalesce("component", "c")).drop("component")
        rows = rows.repartition("t")  # before the hubs are chosen: those of a part of a list are far wider than its rows
        # sets with few unmarked shingles stand in the middle of their group
        at = [F.struct(F.floor(10 * F.col("u") / F.col("n")), F.xxhash64("c", F.lit(step * HUBS + i))) for i in range(HUBS if step < HUB_ROUNDS else 0)]
        hubs = F.array(*(F.min_by(F.struct("c", "n", "p", "u", "comp"), x) for x in at))
        mixed = rows.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), hubs.alias("hubs")).where("lo <> hi").select("t", "hubs", "m")
        near = F.filter("hubs", lambda h: (h.comp != F.col("comp")) & can_reach(percent, (F.col("n"), F.col("p"), F.col("u")), (h.n, h.p, h.u)))["c"]
        # a hub is tried with all of its list now, so later rounds need pairs without it only
        stay = ~F.array_contains(F.col("hubs")["c"], F.col("c")) & (F.col("m") - F.size(F.array_distinct(F.col("hubs")["c"])) > 1)
        rows = rows.join(mixed, "t").withColumn("stay", stay if step < HUB_ROUNDS else F.lit(True)).drop("m")
        new = scratch.save(rows.withColumn("hubs", near if step < HUB_ROUNDS else F.lit(None)))  # only lists with several components go on
        scratch.drop(live)
        live = new
        pairs = live.select(F.explode("hubs").alias("x"), F.col("c").alias("y")) if step < HUB_ROUNDS else candidates(live, frags.select("c", "s"), percent)
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        # most share a shingle by chance: their sketches tell, and their sets needn't be sent
        pairs = scratch.save(alike(pairs, frags.select("c", "n", "s"), percent) if step < HUB_ROUNDS else pairs)
        n_pairs = pairs.count()
        if n_pairs == 0:  # of a hub round, this says nothing about pairs without a hub
            scratch.drop(pairs)
            continue
        new = verified(pairs, frags, percent, n_pairs <= BROADCAST_ROWS)
        old = [pairs, *(x for x in (links, labels) if x is not None)]
        links = scratch.save(new if links is None else links.union(new))
        labels = scratch.save(components_of_few(spark, links, scratch).withColumnRenamed("id", "c"))
        scratch.drop(*old)
    scratch.drop(live, frags)
    if labels is None:
        members = members.withColumn("comp", F.col("c"))
    else:
        members = members.join(labels, "c", "left").withColumn("comp", F.coalesce("component", "c"))
    least = members.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("low"))
    return members.join(least, "comp", "left").select("doc_id", "n_shingles", "comp", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its set size and component; see jaccard_classes."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS low FROM w UNION SELECT e.b, r.low FROM r JOIN e ON r.doc_id = e.a AND r.low < e.b)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.low) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
