"""Token-budget context assembly.

Rows stand in a stated order; a budget is spent in that order. What stops at
the first overflow is a running sum; what packs batch after batch is a fold
over ranges of the costs, whose ends are then put together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import token_count
from lattica.sources.tables import saved


def first_overflow(rows: DataFrame, group: str, order: list[Column], cost: str, budget: int, header: int = 0) -> DataFrame:
    """Rows of each group, in order, before the first one whose running cost (from header on) is above the budget.

    Once a row overflows, none after it comes back, whatever its cost.
    """
    run = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = rows.withColumn("spent", F.sum(cost).over(run) + header)
    return spent.withColumn("__most", F.max("spent").over(run)).where(F.col("__most") <= budget).drop("__most")


def reduce_context(points: DataFrame, group: str, answer: str, score: str, key: str, budget: int, cost: str | None = None) -> DataFrame:
    """Points with an answer and a score above 0, by score, before the first that overflows; ties by key."""
    good = points.where((F.col(score) > 0) & F.col(answer).isNotNull())
    good = good.withColumn("tokens", F.col(cost) if cost else token_count(F.col(answer)))
    return first_overflow(good, group, [F.desc(score), F.asc(key)], "tokens", budget)


def table_context(rows: DataFrame, group: str, order: list[Column], columns: Sequence[str], budget: int, delimiter: str = "|") -> DataFrame:
    """(.., line, spent): a table of rows as delimited lines; its header is paid first."""
    header = delimiter.join(columns)
    line = F.concat_ws(delimiter, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    lines = rows.withColumn("line", line).withColumn("__tokens", token_count(F.col("line")))
    return first_overflow(lines, group, order, "__tokens", budget, len(header.split())).drop("__tokens")


def _next_starts(cost: np.ndarray, limit: float, most: int | None) -> np.ndarray:
    """For each row as the first of a batch, the row that opens the next one (the number of rows if none does)."""
    n = len(cost)
    at, known = np.arange(n), np.nan_to_num(cost)
    sums = np.concatenate(([0.0], np.cumsum(known)))
    if (known < 0).any():  # sums that fall again: row by row
        end = np.full(n, n)
        for i in range(n):
            end[i] = next((j for j in range(i + 1, n) if sums[j + 1] - sums[i] > limit), n)
    else:
        end = np.maximum(at + 1, np.searchsorted(sums[1:], sums[:-1] + limit, side="right"))
    unknown = np.minimum.accumulate(np.where(np.isnan(cost), at, n)[::-1])[::-1]  # a sum with a null cost overflows no more
    end = np.where(end >= unknown, n, end)
    return end if most is None else np.minimum(end, at + most)


def _first_break(state: tuple[int, float], before: np.ndarray, cost: np.ndarray, place: np.ndarray, budget: float, most: int | None) -> int:
    """Of the rows given by place, sum before and cost, the index of the first that overflows a batch (rows, spent); -1 if none does."""
    over = state[1] + before + cost > budget
    if most is not None:
        over |= state[0] + place + 1 > most
    return int(over.argmax()) if over.any() else -1


def _greedy(rows: DataFrame, group: str, order: Sequence[str], cost: str, budget: float, header: int = 0, most: int | None = None) -> DataFrame:
    """(group, *order, batch): rows in order, a batch closed by the row that would take it above the budget or beyond `most` rows.

    Ranges of the order are folded side by side: what enters a range from
    before only decides where its first batch opens, so each range tells how
    it ends for each of the few rows (a batch's worth) that may open it. The
    driver walks over these, range by range, and ranges are folded again from
    what enters them. No task holds more than a range.
    """
    keys = rows.select(group, *order, F.col(cost).cast("double").alias("__cost"))
    ranged = keys.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id())
    ranged = saved(ranged.withColumn("__part", F.shiftright("__at", 33)))
    folded = ranged.select("__part", "__at", "__cost", F.col(group).cast("string").alias("__group"))
    limit = float(budget - header)

    def segments(f: pd.DataFrame) -> list[tuple[int, int]]:
        code = pd.factorize(f["__group"], use_na_sentinel=False)[0]
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(f)]
        return list(zip(cuts, cuts[1:]))

    def ends(f: pd.DataFrame) -> pd.DataFrame:
        """The first group's possible openings and its whole (place -1), and how the last group ends (place -2)."""
        f = f.sort_values("__at")
        all_, parts, out = f["__cost"].to_numpy(float), segments(f), []

        def exits(c: np.ndarray):
            start, n = _next_starts(c, limit, most).tolist(), len(c)
            last, hops = list(range(n)), [0] * n
            for i in range(n - 1, -1, -1):
                if start[i] < n:
                    last[i], hops[i] = last[start[i]], hops[start[i]] + 1
            return lambda i: (n - last[i], header + float(c[last[i] :].sum()), hops[i])

        lo, hi = parts[0]
        c = all_[lo:hi]
        sums, place, leave = np.concatenate(([0.0], np.cumsum(np.nan_to_num(c)))), np.arange(len(c)), exits(c)
        if most is not None:
            may = place < most
        elif (c < 0).any():
            may = place >= 0
        else:  # a row without a cost overflows only after a batch that is above the budget by itself
            may = (place == 0) | ((sums[:-1] <= max(limit, 0.0)) & (c > 0))
        unknown = np.maximum.accumulate(np.isnan(c))
        for i in np.flatnonzero(may):
            rows_, spent, hops = leave(i)
            out.append((int(i), float("nan") if i and unknown[i - 1] else float(sums[i]), float(c[i]), rows_, spent, hops))
        out.append((-1, 0.0, 0.0, len(c), float(c.sum()), 0))
        if len(parts) > 1:
            lo, hi = parts[-1]
            out.append((-2, 0.0, 0.0, *exits(all_[lo:hi])(0)))
        found = pd.DataFrame(out, columns=["place", "before", "cost", "rows", "spent", "hops"])
        found.insert(0, "last", repr(f["__group"].iloc[-1]))
        found.insert(0, "first", repr(f["__group"].iloc[0]))
        found.insert(0, "part", f["__part"].iloc[0])
        return found

    told = folded.groupBy("__part").applyInPandas(ends, "part long, first string, last string, place long, before double, cost double, rows long, spent double, hops long").toPandas()
    enters, state, name = {}, None, None  # a range's (batch, rows, spent) where its first group began before
    for part, f in told.sort_values(["part", "place"]).groupby("part", sort=True):
        whole, opens = f[f["place"] == -1].iloc[0], f[f["place"] >= 0].reset_index(drop=True)
        if state is not None and name == whole["first"]:
            enters[int(part)] = state
            at = _first_break(state[1:], opens["before"].to_numpy(), opens["cost"].to_numpy(), opens["place"].to_numpy(), budget, most)
            state = (state[0], state[1] + int(whole["rows"]), state[2] + float(whole["spent"])) if at < 0 else (state[0] + 1 + int(opens["hops"][at]), int(opens["rows"][at]), float(opens["spent"][at]))
        else:
            state = (int(opens["hops"][0]), int(opens["rows"][0]), float(opens["spent"][0]))
        for _, r in f[f["place"] == -2].iterrows():
            state = (int(r["hops"]), int(r["rows"]), float(r["spent"]))
        name = whole["last"]

    def number(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__at")
        all_, batch = f["__cost"].to_numpy(float), np.zeros(len(f), np.int32)
        enter = enters.get(int(f["__part"].iloc[0]))
        for lo, hi in segments(f):
            c, opened = all_[lo:hi], np.zeros(hi - lo, np.int32)
            start, at, base = _next_starts(c, limit, most).tolist(), 0, 0
            if enter is not None:
                base, before = enter[0], np.concatenate(([0.0], np.cumsum(c)))[:-1]
                at = _first_break(enter[1:], before, c, np.arange(len(c)), budget, most)
                at = len(c) if at < 0 else at
                if at < len(c):
                    opened[at] = 1
            while at < len(c) and start[at] < len(c):
                at = start[at]
                opened[at] = 1
            batch[lo:hi], enter = base + np.cumsum(opened), None
        return pd.DataFrame({"__at": f["__at"], "batch": batch})

    numbered = folded.groupBy("__part").applyInPandas(number, "__at long, batch int")
    return ranged.select(group, *order, "__at").join(numbered, "__at").drop("__at")


def _with_batches(rows: DataFrame, packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with their batch, by keys that may be null."""
    other = packed.toDF(*(f"__k{i}" for i in range(len(keys))), "batch")
    return rows.join(other, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))).drop(*(f"__k{i}" for i in range(len(keys))))


def next_fit(rows: DataFrame, group: str, order: Sequence[str], cost: str, budget: int, header: int = 0, first_only: bool = False) -> DataFrame:
    """Adds `batch` from 0: an overflow closes a batch and opens the next; a batch is never empty, so an oversize row has one of its own.

    Ties of the order aren't allowed.
    """
    out = _with_batches(rows, _greedy(rows, group, order, cost, budget, header), [group, *order])
    return out.where("batch = 0") if first_only else out


def community_batches(reports: DataFrame, group: str, place: str, cost: str, budget: int, header: int = 0, single: bool = False) -> DataFrame:
    """Reports packed in order of place, each batch then ranked by (weight, rank) descending as `position`."""
    packed = next_fit(reports, group, [place], cost, budget, header, single)
    return packed.withColumn("position", F.row_number().over(Window.partitionBy(group, "batch").orderBy(F.desc("weight"), F.desc("rank"), place)))


def relation_chunks(relations: DataFrame, group: str, key: str, cost: str, budget: int) -> DataFrame:
    """Relations by degree_sum, packed into chunks; every relation is in one."""
    ranked = relations.withColumn("__down", -F.col("degree_sum"))
    return next_fit(ranked, group, ["__down", key], cost, budget).drop("__down")


def prompt_chunks(rows: DataFrame, group: str, place: str, text: str, budget: int) -> DataFrame:
    """Rows packed into prompts by their characters; a row above the budget is cut to it."""
    cut = rows.withColumn(text, F.substring(text, 1, budget)).withColumn("__n", F.length(text))
    return next_fit(cut, group, [place], "__n", budget).drop("__n")


def local_context(edges: DataFrame, group: str, cost: str, budget: int) -> DataFrame:
    """Edges of each community by degree, before the first that overflows, ties by their ends."""
    return first_overflow(edges, group, [F.desc("degree"), F.asc("src"), F.asc("dst")], cost, budget)


def mixed_context(parts: DataFrame, group: str, budget: int) -> DataFrame:
    """(group, child, report): the largest sub-communities are replaced by their reports until all fits.

    parts has (group, child, full, short): the tokens of a child's own context
    and of its report. If even all reports overflow, those that fit by size,
    largest child first, are kept.
    """
    order = Window.partitionBy(group).orderBy(F.desc("full"), "child")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parts.withColumns({"place": F.row_number().over(order), "saved_": F.sum(F.col("full") - F.col("short")).over(before), "all_": F.sum("full").over(Window.partitionBy(group)), "shorts": F.sum("short").over(before), "total_short": F.sum("short").over(Window.partitionBy(group))})
    # replaced: the first ones, as far as needed; a child is one if without it the rest is still too large
    needed = F.col("all_") - (F.col("saved_") - (F.col("full") - F.col("short"))) > budget
    fits = (F.col("total_short") <= budget) | (F.col("shorts") <= budget)
    return rows.where(fits).select(group, "child", needed.alias("report"))


def level_contexts(communities: DataFrame, hierarchy: DataFrame, budget: int) -> DataFrame:
    """(level, community, state): `local` if its own context fits, `mixed` if it must use reports below it, `trimmed` if it has none."""
    below = hierarchy.select(F.col("parent").alias("community")).distinct().withColumn("has", F.lit(True))
    state = F.when(F.col("tokens") <= budget, "local").when(F.col("has"), "mixed").otherwise("trimmed")
    return communities.join(below, "community", "left").select("level", "community", state.alias("state"))


def split_budget(most: int, community_share: float, text_share: float) -> dict[str, int]:
    """Tokens for communities, text units and the local tables; shares above 1 together are an error."""
    if community_share + text_share > 1:
        raise ValueError("shares of the budget are above 1")
    return {"community": int(most * community_share), "text": int(most * text_share), "local": int(most * (1 - community_share - text_share))}


def conversation_turns(turns: DataFrame, conversation: str, place: str, role: str, text: str, budget: int, most: int = 5, user: str = "user", newest_first: bool = True) -> DataFrame:
    """(conversation, qa, question, answer, tokens, spent): user turns with the answers that follow, newest first, before the first that overflows.

    What comes before the first user turn belongs to no question.
    """
    w = Window.partitionBy(conversation).orderBy(place)
    numbered = turns.withColumn("qa", F.sum(F.when(F.col(role) == user, 1).otherwise(0)).over(w)).where("qa > 0")
    said = F.struct(F.col(place).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    pairs = numbered.groupBy(conversation, "qa").agg(F.max(F.when(F.col(role) == user, F.col(text))).alias("question"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(role) != user, said))), lambda x: x.t), "\n").alias("answer"))
    pairs = pairs.withColumn("tokens", token_count(F.col("question")) + token_count(F.col("answer")))
    order = F.desc("qa") if newest_first else F.asc("qa")
    recent = pairs.withColumn("__r", F.row_number().over(Window.partitionBy(conversation).orderBy(order))).where(F.col("__r") <= most).drop("__r")
    return first_overflow(recent, conversation, [order], "tokens", budget)


def with_flag(candidates: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """All candidates with in_context: whether they are among the chosen."""
    flags = chosen.select(key).distinct().withColumn("in_context", F.lit(True))
    return candidates.join(flags, key, "left").withColumn("in_context", F.coalesce("in_context", F.lit(False)))


def examples_within(examples: DataFrame, place: str, cost: str, budget: int, least: int) -> DataFrame:
    """Few-shot examples in order while they fit, `least` of them in any case."""
    w = Window.orderBy(place)  # a handful of examples
    both = examples.withColumns({"spent": F.sum(cost).over(w), "__place": F.row_number().over(w)})
    return both.where((F.col("spent") <= budget) | (F.col("__place") <= least)).drop("__place")


def embedding_batches(texts: DataFrame, group: str, place: str, cost: str, most_texts: int = 16, most_tokens: int = 8191) -> DataFrame:
    """Texts in batches of at most so many texts and tokens, in order, greedily."""
    return _with_batches(texts, _greedy(texts, group, [place], cost, most_tokens, most=most_texts), [group, place])


def level_prompts(communities: DataFrame, level: str, summary: str, key: str, seed: int = 42) -> DataFrame:
    """(level, communities, sample): per level the number of communities and one summary by seeded hash."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return communities.groupBy(level).agg(F.count("*").alias("communities"), F.min_by(summary, h).alias("sample"))
