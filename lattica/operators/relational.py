"""Column verbs, joins, aggregation, set operations and sampling over DataFrames.

All functions take and return DataFrames; only quantiles collects, counts of
ranges and a few values. Where the order of
rows matters, the caller names the columns that define it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lattica.sources.tables import saved

# ---------------------------------------------------------------- column verbs


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def copy(df: DataFrame, column: str, to: str) -> DataFrame:
    return df.withColumn(to, F.col(column))


def fill(df: DataFrame, to: str, value) -> DataFrame:
    """A constant column."""
    return df.withColumn(to, F.lit(value))


def convert(df: DataFrame, column: str, to: str, kind: str, delimiter: str = ",") -> DataFrame:
    """Casts to a type; `array` splits a string at the delimiter; a string that isn't of the type gives null."""
    if kind == "array":
        return df.withColumn(to, F.split(column, f"\\Q{delimiter}\\E"))
    return df.withColumn(to, F.col(column).try_cast(kind))


def filter_value(df: DataFrame, column: str, operator: str, value=None) -> DataFrame:
    """Rows whose column compares to a constant: is not empty, is empty, equals, not equals, greater, less, contains."""
    c = F.col(column)
    filled = c.isNotNull() & (F.length(c) > 0) if isinstance(df.schema[column].dataType, StringType) else c.isNotNull()
    tests = {
        "is not empty": lambda: filled, "is empty": lambda: ~filled, "equals": lambda: c == value, "not equals": lambda: c != value,
        "greater": lambda: c > value, "less": lambda: c < value, "contains": lambda: c.contains(value),
    }
    return df.where(tests[operator]())


def filter_columns(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows on which two columns agree."""
    return df.where(F.col(left) == F.col(right))


def where_column_equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def transform_series(df: DataFrame, column: str, fn) -> DataFrame:
    """Replaces a column by fn of it; fn maps a Column to a Column."""
    return df.withColumn(column, fn(F.col(column)))


def merge_concat(df: DataFrame, columns: Sequence[str], to: str, delimiter: str = ",") -> DataFrame:
    """Joins columns with a delimiter and drops them; nulls are skipped."""
    return df.withColumn(to, F.concat_ws(delimiter, *columns)).drop(*(c for c in columns if c != to))


def merge_json(df: DataFrame, columns: Sequence[str], to: str) -> DataFrame:
    """Packs columns into a JSON object and drops them; null fields are left out."""
    return df.withColumn(to, F.to_json(F.struct(*columns))).drop(*(c for c in columns if c != to))


def zip_columns(df: DataFrame, columns: Sequence[str], to: str) -> DataFrame:
    """One tuple column of several; of two arrays, an array of pairs."""
    if all(isinstance(df.schema[c].dataType, ArrayType) for c in columns):
        return df.withColumn(to, F.arrays_zip(*columns))
    return df.withColumn(to, F.struct(*columns))


def zip_dict(df: DataFrame, keys: str, values: str, to: str) -> DataFrame:
    """A map from a list of keys and a list of values."""
    return df.withColumn(to, F.map_from_arrays(keys, values))


def unzip(df: DataFrame, column: str, to: Sequence[str]) -> DataFrame:
    """Fields of a tuple column as columns of their own."""
    fields = df.schema[column].dataType.fieldNames()
    return df.withColumns({name: F.col(column)[f] for name, f in zip(to, fields)})


def spread_json(df: DataFrame, column: str, schema: str, keep: Sequence[str] = ("level",)) -> DataFrame:
    """Fields of a JSON column as columns, beside the kept ones; text that isn't JSON gives nulls."""
    return df.select(*keep, F.from_json(column, schema).alias("__json")).select(*keep, "__json.*")


def unroll(df: DataFrame, column: str) -> DataFrame:
    """One row per element of a list; rows with an empty or null list keep one row with null."""
    return df.withColumn(column, F.explode_outer(column))


def gen_id(df: DataFrame, columns: Sequence[str], to: str = "id") -> DataFrame:
    """md5 of the concatenated columns; null counts as the empty text."""
    return df.withColumn(to, F.md5(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))))


def gen_index(df: DataFrame, order: Sequence[Column], to: str = "id", within: Sequence[str] = ()) -> DataFrame:
    """Row number from 1 in a stated order, in each group of `within`.

    Without `within`, rows are ranked inside ranges of the order and shifted
    by the ranges' counts, so that no task holds all rows. Ranges are saved,
    as another reading may cut and merge them elsewhere.
    """
    if within:
        return df.withColumn(to, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))
    ranged = saved(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__rank", rank).join(F.broadcast(starts), "__part").withColumn(to, F.col("__start") + F.col("__rank")).drop("__part", "__rank", "__start")


def stable_uuid(df: DataFrame, columns: Sequence[str], to: str = "id") -> DataFrame:
    """A uuid drawn from the md5 of a row's natural key, so that reruns agree."""
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return df.withColumn(to, F.concat_ws("-", *parts))


def is_uuid(value: Column) -> Column:
    """Whether a text is a uuid, with or without dashes."""
    return value.rlike(r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$")


def up_to_level(df: DataFrame, level: int, column: str = "level") -> DataFrame:
    """Communities of a level and those above it."""
    return df.where(F.col(column) <= level)


def lookup(df: DataFrame, column: str, value, dashes: bool = True) -> DataFrame:
    """Entities by key, name or attribute; without dashes, ids are compared free of them."""
    if dashes:
        return df.where(F.col(column) == value)
    return df.where(F.replace(F.col(column), F.lit("-"), F.lit("")) == value.replace("-", ""))


def clean_strings(df: DataFrame, clean) -> DataFrame:
    """Applies clean (Column -> Column) to every string column."""
    return df.select(*(clean(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema))


def assign_levels(communities: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, level, index_id): communities first; levels are shifted by 1 if one of them is 0, and entities are level 0."""
    low = communities.agg(F.min(F.col("level").cast("int")).alias("low"))
    lifted = communities.crossJoin(F.broadcast(low)).select("id", (F.col("level").cast("int") + F.when(F.col("low") == 0, 1).otherwise(0)).alias("level"), F.lit(0).alias("kind"))
    both = lifted.unionByName(entities.select("id", F.lit(0).alias("level"), F.lit(1).alias("kind")))
    return gen_index(both, [F.col("kind"), F.col("level").desc(), F.col("id")], "index_id").withColumn("index_id", F.col("index_id") - 1).drop("kind")


# ---------------------------------------------------------------- id selectors


def id_range(low: int, high: int):
    return lambda c: (c >= low) & (c < high)


def id_array(ids: Sequence[int]):
    """Few ids, as literals; for many, use semi_join."""
    return lambda c: c.isin(list(ids))


def id_bitmap(bits: bytes):
    """Ids whose bit is set; the bitmap is read as unsigned bytes, lowest bit first."""
    table = F.array(*(F.lit(b) for b in bits))
    return lambda c: (c >= 0) & (c < 8 * len(bits)) & (F.call_function("shiftright", F.coalesce(F.get(table, F.shiftright(c, 3).cast("int")), F.lit(0)), (c % 8).cast("int")).bitwiseAND(1) == 1)


def id_not(a):
    return lambda c: ~a(c)


def id_and(a, b):
    return lambda c: a(c) & b(c)


def id_or(a, b):
    return lambda c: a(c) | b(c)


def id_xor(a, b):
    return lambda c: a(c) != b(c)


# ---------------------------------------------------------------- joins


def join_verb(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi join with differing key names: clashing columns get the suffixes _1 and _2, one key column of a shared name stays."""
    shared = left_key == right_key
    clash = (set(left.columns) & set(right.columns)) - ({left_key} if shared else set())
    a = left.withColumnsRenamed({c: f"{c}_1" for c in clash})
    b = right.withColumnsRenamed({c: f"{c}_2" for c in clash})
    if shared:
        return a.join(b, left_key, how)
    x, y = (f"{left_key}_1" if left_key in clash else left_key), (f"{right_key}_2" if right_key in clash else right_key)
    return a.join(b, a[x] == b[y], how)


def antijoin(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def semi_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    src, dst = (nodes.select(F.col("node").alias(x)) for x in ("src", "dst"))
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select(*edges.columns)


def details_by_end(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges and claims under each node they belong to: (node, kind, a, b); an edge counts at both ends, a claim at its subject."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), F.lit("edge").alias("kind"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))
    return ends.unionByName(claims.select("node", F.lit("claim").alias("kind"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))


def contained_sets(members: DataFrame) -> DataFrame:
    """(parent, child, level, size) from (level, community, member): communities whose members are a subset of those of a community one level above (level - 1).

    Memberships meet on the member, and the shared ones are counted; no pair
    of communities without a common member arises.
    """
    m = members.select("level", "community", "member").distinct()
    size = m.groupBy("level", "community").agg(F.count("*").alias("size"))
    child = m.select(F.col("level").alias("child_level"), F.col("community").alias("child"), "member")
    parent = m.select((F.col("level") + 1).alias("child_level"), F.col("community").alias("parent"), "member")
    shared = child.join(parent, ["child_level", "member"]).groupBy("child_level", "parent", "child").agg(F.count("*").alias("shared"))
    found = shared.join(size.select(F.col("level").alias("child_level"), F.col("community").alias("child"), "size"), ["child_level", "child"]).where("shared = size")
    return found.select("parent", "child", F.col("child_level").alias("level"), "size")


def overlapping_members(members: DataFrame) -> DataFrame:
    """(level, member, communities) for members in several communities of a level."""
    return members.groupBy("level", "member").agg(F.countDistinct("community").alias("communities")).where("communities > 1")


def last_wins(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last row of each key, as a dictionary filled in this order would hold it."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(c.desc() for c in order)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def map_ids(df: DataFrame, column: str, names: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """Looks a column up in (key, value); without an entry, null."""
    return df.join(names.select(F.col(key).alias(column), F.col(value).alias(to)), column, "left")


def touching_counts(units: DataFrame, edges: DataFrame, node) -> DataFrame:
    """(unit, relationships): how many of a unit's relationships (unit, edge ids) touch a node."""
    mine = edges.where((F.col("src") == node) | (F.col("dst") == node)).select("edge")
    return units.join(mine.withColumn("hit", F.lit(1)), "edge", "left").groupBy("unit").agg(F.count("hit").alias("relationships"))


# ---------------------------------------------------------------- aggregation

_AGGREGATES = {
    "any": lambda c, how: F.min(c), "array_agg": lambda c, how: F.sort_array(F.collect_list(c)), "array_agg_distinct": lambda c, how: F.sort_array(F.collect_set(c)),
    "string_concat": lambda c, how: F.array_join(F.sort_array(F.collect_list(F.col(c).cast("string"))), how or ","),
    "sum": lambda c, how: F.sum(c), "min": lambda c, how: F.min(c), "max": lambda c, how: F.max(c), "mean": lambda c, how: F.avg(c), "count": lambda c, how: F.count(c), "product": lambda c, how: F.product(c),
}


def aggregate(df: DataFrame, ops: Sequence[tuple], by: Sequence[str] = ()) -> DataFrame:
    """ops are (operation, column, name) or (operation, column, name, separator); a column may be used often.

    any gives the least value, and lists are sorted, so that reruns agree.
    Lists hold a group's values; they are for groups of a bounded size.
    """
    return df.groupBy(*by).agg(*(_AGGREGATES[op](column, rest[0] if rest else None).alias(name) for op, column, name, *rest in ops))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def top_communities(nodes: DataFrame) -> DataFrame:
    """(title, community): the largest community number of each title."""
    return nodes.groupBy("title").agg(F.max("community").alias("community"))


def distinct_lists(members: DataFrame, group: str, lists: Sequence[str]) -> DataFrame:
    """Distinct sorted values of list columns by group."""
    parts = [members.select(group, F.explode(c).alias(c)).groupBy(group).agg(F.sort_array(F.collect_set(c)).alias(c)) for c in lists]
    return reduce(lambda a, b: a.join(b, group, "full"), parts)


def collect_details(rows: DataFrame, group: str, key: str, fields: Sequence[str]) -> DataFrame:
    """(group, details): the rows of a community as structs, ordered by key; communities are of a bounded size."""
    return rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(key, *fields))).alias("details"))


def community_weights(members: DataFrame, group: str, unit: str) -> DataFrame:
    """(group, weight, share): distinct text units per community, and that number over the largest one."""
    counts = members.groupBy(group).agg(F.countDistinct(unit).alias("weight"))
    return counts.crossJoin(F.broadcast(counts.agg(F.max("weight").alias("__most")))).withColumn("share", F.col("weight") / F.col("__most")).drop("__most")


def community_matches(entities: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """The k communities that most of the selected entities (entity, communities) belong to; ties by rank, then id."""
    counts = entities.select(F.explode("communities").alias("community")).groupBy("community").agg(F.count("*").alias("matches"))
    return counts.join(ranks, "community").orderBy(F.desc("matches"), F.desc("rank"), "community").limit(k)


def level_counts(communities: DataFrame) -> DataFrame:
    return communities.groupBy("level").agg(F.countDistinct("community").alias("communities"))


def unique_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, first, index): distinct values, numbered from 0 by first appearance."""
    seen = df.groupBy(column).agg(F.min(order).alias("first"))
    return gen_index(seen, [F.col("first"), F.col(column)], "index").withColumn("index", F.col("index") - 1)


def allocate_levels(weights: DataFrame, k: int) -> DataFrame:
    """(level, weight, k): k shared in proportion to the weights, half to even, then evened out by 1 a level from the first on.

    A row per level goes through one window; levels are few.
    """
    all_ = Window.partitionBy()
    shares = weights.withColumn("k", F.bround(F.col("weight") / F.sum("weight").over(all_) * k).cast("int"))
    rest = F.lit(k) - F.sum("k").over(all_)
    rank, levels = F.row_number().over(Window.orderBy("level")) - 1, F.count("*").over(all_)
    whole, part = F.floor(F.abs(rest) / levels), F.abs(rest) % levels
    step = whole + F.when(rank < part, 1).otherwise(0)
    return shares.withColumn("k", (F.col("k") + F.signum(rest) * step).cast("int"))


def imbalance(groups: DataFrame, column: str) -> DataFrame:
    """(groups, rows, factor): number of groups times the squared sizes' sum over the squared number of rows."""
    sizes = groups.groupBy(column).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), (F.count("*") * F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("factor"))


def token_usage(calls: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Summed token counts of model calls."""
    return calls.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counts), F.count("*").alias("calls"))


def mean_percent(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Means of metrics over questions, in percent."""
    return rows.agg(*((F.avg(m) * 100).alias(m) for m in metrics))


# ---------------------------------------------------------------- order, sets, samples


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def quantiles(df: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, as columns q0, q1, ..; null over no rows.

    Values are counted and dealt by ranges; from the ranges' counts the driver
    knows which few hold the wanted places, and only these are put in order.
    """
    spark = df.sparkSession
    counts = df.select(F.col(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ranged = saved(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = sorted(ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row per range
    schema = ", ".join(f"q{i} double" for i in range(len(at)))
    if not sizes:
        return spark.createDataFrame([(None,) * len(at)], schema)
    total = sum(s.n for s in sizes)
    places = sorted({p for q in at for p in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
    start, wanted = 0, []
    for s in sizes:
        wanted += [(s.part, p, p - start) for p in places if start <= p < start + s.n]
        start += s.n
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    inside = ranged.where(F.col("part").isin(sorted({w[0] for w in wanted}))).withColumn("upto", upto)
    found = inside.join(F.broadcast(spark.createDataFrame(wanted, "part int, place long, here long")), "part").where("here < upto and here >= upto - n")
    value = {r.place: r.v for r in found.select("place", "v").collect()}

    def between(x: float) -> float:
        low, high = math.floor(x), math.ceil(x)
        return value[low] if value[low] == value[high] else (high - x) * value[low] + (x - low) * value[high]

    return spark.createDataFrame([tuple(between(q * (total - 1)) for q in at)], schema)


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows; columns are matched by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_columns(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """Columns side by side, row by row in stated orders."""
    return gen_index(left, left_order, "__row").join(gen_index(right, right_order, "__row"), "__row", "full").drop("__row")


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def id_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def hash_order(key: str, seed: int) -> Column:
    """A seeded order of rows by the md5 of their key; the same in every partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by seeded hash order."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def shuffle_rows(df: DataFrame, key: str, seed: int = 86) -> DataFrame:
    """All rows with their place in a seeded order."""
    return gen_index(df, [hash_order(key, seed), F.col(key)], "place")


def select_chunks(df: DataFrame, method: str, k: int, key: str, seed: int = 42) -> DataFrame:
    """Chunks by `top` (first by key) or `random`; `auto` (nearest to the mean embedding) is vector.nearest_to_mean."""
    return df.orderBy(key).limit(k) if method == "top" else sample_rows(df, k, key, seed)
