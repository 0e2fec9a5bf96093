"""Seeded samples, batches, and the greedy operators that walk a small table in order."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import order_key
from .ranks import numbered, with_sums

#: Items of a pool of demonstrations.
MOST_SHOTS = 20_000
#: Hexadecimal digits of a hash order that name a bucket.
HASH_DIGITS = 3


def sample_k(rows: DataFrame, k: int, seed: int, by: str, key: str, strict: bool = False) -> DataFrame:
    """k rows a group (all, if fewer, unless strict) in hash order."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order_key(seed, F.col(by), F.col(key)), key))
    if strict and (short := rows.groupBy(by).count().filter(F.col("count") < k).count()):
        raise ValueError(f"{short} groups have fewer than {k} rows")
    return rows.withColumn("rn", place).filter(F.col("rn") <= k)


def balanced_characters(rows: DataFrame, seed: int, chars: int | None = None, text: str = "text", by: str = "language", key: str = "doc_id") -> DataFrame:
    """Rows in hash order while the characters before them are below the budget: chars, or the smallest group's total."""
    rows = rows.withColumn("_len", F.length(text)).withColumn("_o", order_key(seed, F.col(by), F.col(key)))
    if chars is None:
        chars = rows.groupBy(by).agg(F.sum("_len").alias("t")).agg(F.min("t")).first()[0] or 0
    # Characters and rows of the order's buckets are summed ahead; buckets beyond the budget aren't ordered at all.
    rows = rows.withColumn("_b", F.substring("_o", 1, HASH_DIGITS))
    ahead = lambda c, over: F.coalesce(F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = Window.partitionBy(by).orderBy("_b")
    sums = rows.groupBy(by, "_b").agg(F.sum("_len").alias("_t"), F.count("*").alias("_c"))
    sums = sums.select(by, "_b", ahead("_t", buckets).alias("_chars"), ahead("_c", buckets).alias("_rows")).filter(F.col("_chars") < chars)
    own = Window.partitionBy(by, "_b").orderBy("_o", key)
    out = with_sums(rows, sums, [by, "_b"]).withColumn("_before", F.col("_chars") + ahead("_len", own)).withColumn("rn", F.col("_rows") + F.row_number().over(own))
    return out.filter(F.col("_before") < chars).drop("_before", "_len", "_o", "_b", "_chars", "_rows")


def interleave(rows: DataFrame, by: str = "language", place: str = "rn") -> DataFrame:
    """Round-robin over groups by place."""
    return rows.orderBy(place, by)


def batches(rows: DataFrame, strata: list[str], seed: int, size: int, key: str = "doc_id") -> DataFrame:
    """rows with `batch`: within each stratum dealt in turn, in hash order, over ceil(n / size) batches."""
    n = max(1, -(-rows.count() // size))
    salt = F.concat_ws("|", *[F.col(s).cast("string") for s in strata])
    placed = numbered(rows.withColumn("_o", order_key(seed, salt, F.col(key))), strata, ["_o", key], "_place")
    return placed.withColumn("batch", ((F.col("_place") - 1) % n).cast("int")).drop("_o", "_place")


def fixed_subset(rows: DataFrame, size: int, seed: int, bench: str, group: str, key: str, cover: str | None = None) -> DataFrame:
    """size rows a group by hash of seed, benchmark, group and key; with cover the first of each of its values goes before the others."""
    rows = rows.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(bench), F.col(group).cast("string"), F.col(key).cast("string")), 256))
    rank: list = ["_h", key]
    if cover:
        rows = rows.withColumn("_c", (F.row_number().over(Window.partitionBy(group, cover).orderBy("_h", key)) > 1).cast("int"))
        rank = ["_c", *rank]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*rank))).filter(F.col("_rn") <= size).drop("_rn", "_h", *(["_c"] if cover else []))


def holdout(rows: DataFrame, h: int, seed: int, by: str, key: str) -> DataFrame:
    """rows with `demo`: h of each group are demonstrations, the rest is scored; an error if nothing would be left."""
    if short := rows.groupBy(by).count().filter(F.col("count") <= h).count():
        raise ValueError(f"{short} groups have no more than {h} rows")
    placed = numbered(rows.withColumn("_o", order_key(seed, F.col(by), F.col(key))), [by], ["_o", key], "_place")
    return placed.withColumn("demo", F.col("_place") <= h).drop("_o", "_place")


def shots(examples: DataFrame, pool: DataFrame, k: int, seed: int, labels: list[str]) -> DataFrame:
    """(example_id, place, shot_id, label): k demonstrations for each example, balanced over labels, never of its own group. Examples are one
    row an id.

    Labels come in rounds: a first partial one of k mod L labels, then whole ones, each in a hash order of its own; the n-th time a
    label comes up it gives its n-th item in hash order. Labels that have run out are skipped.

    The pool goes to every task as one array, and an example's shots are picked within its row: only they become rows of their own.
    """
    if pool.limit(MOST_SHOTS + 1).count() > MOST_SHOTS:  # it is sent to every task
        raise ValueError(f"a pool of demonstrations holds at most {MOST_SHOTS} items")
    full, part = divmod(k, len(labels))
    held = pool.agg(F.collect_list(F.struct(F.col("item_id").alias("shot_id"), "label", F.col("group").alias("g"))).alias("_pool"))
    rows = examples.select("example_id", F.col("group").alias("_g")).crossJoin(F.broadcast(held))

    def turns(r: int) -> Column:
        salt = F.concat(F.col("example_id").cast("string"), F.lit(f"|{r}"))
        order = F.sort_array(F.array(*[F.struct(order_key(seed, salt, F.lit(x)).alias("o"), F.lit(i).alias("at")) for i, x in enumerate(labels)]))
        return F.slice(order, 1, part if part and r == 0 else len(labels))

    def first(label: str) -> Column:
        own = F.filter("_pool", lambda x: (x["label"] == label) & (x["g"] != F.col("_g")))
        keyed = F.transform(own, lambda x: F.struct(order_key(seed, F.col("example_id"), x["shot_id"]).alias("o"), x["shot_id"].alias("shot_id")))
        return F.slice(F.sort_array(keyed), 1, full + 1)

    rows = rows.select("example_id", F.concat(*[turns(r) for r in range(full + (part > 0))]).alias("_a"), F.array(*[first(x) for x in labels]).alias("_b"))
    nth = lambda x, i: F.size(F.filter(F.slice("_a", F.lit(1), i + 1), lambda y: y["at"] == x["at"]))
    rows = rows.select("example_id", "_b", F.transform("_a", lambda x, i: F.struct(x["at"].alias("at"), nth(x, i).alias("nth"))).alias("_n"))
    left = F.filter("_n", lambda x: x["nth"] <= F.size(F.get("_b", x["at"])))
    item = lambda x: F.get(F.get("_b", x["at"]), x["nth"] - 1)["shot_id"].alias("shot_id")
    names = F.array(*[F.lit(x) for x in labels])
    picks = F.transform(left, lambda x: F.struct(item(x), F.get(names, x["at"]).alias("label")))
    return rows.select("example_id", F.posexplode(picks).alias("_at", "x")).select("example_id", (F.col("_at") + 1).alias("place"), "x.shot_id", "x.label")


def complete_everywhere(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Keys that every group has."""
    n = rows.select(by).distinct().count()
    return rows.groupBy(key).agg(F.count_distinct(by).alias("_n")).filter(F.col("_n") == n).select(key)


# --- walks over classes of like rows -------------------------------------------------------------------------------------------------

#: Classes that a walk may be over.
MOST_CLASSES = 200_000


def _few(classes: DataFrame) -> DataFrame:
    if classes.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError(f"a walk is over at most {MOST_CLASSES} classes of like rows")
    return classes


def _wanted(share: dict, taken: int, have: np.ndarray, names: list) -> np.ndarray:
    """What each bucket lacks to its share of the rows taken so far, one row at least."""
    due = np.array([max(1, int(taken * share.get(x, 0))) for x in names])
    return np.maximum(0, due - have)


def greedy_diversity(rows: DataFrame, dims: list[str], target: int, quotas: dict[str, int], seed: int, floor: int = 25, length_share: dict | None = None, language_share: dict | None = None) -> DataFrame:
    """(doc_id, place): repeatedly the row that fills most gaps: sum over dims of what its value lacks to floor, plus 0.1 and 0.05 times
    the deficits of its length and language buckets; none of a source whose quota is full. Ties: hash order.

    Rows that agree in all of this are worth the same at any time, so the walk is over classes of them, each with its first rows in hash
    order (no more than target of a class can be taken); a step prices all classes at once from counts that are kept up to date.
    """
    extra = [(c, share or {}, weight) for c, share, weight in (("len_bucket", length_share, 0.1), ("lang_bucket", language_share, 0.05)) if c in rows.columns]
    key = [*dims, "source", *(c for c, _, _ in extra)]
    ordered = rows.withColumn("_o", order_key(seed, "greedy", F.col("doc_id")))
    first = Window.partitionBy(*key).orderBy("_o", "doc_id")
    kind, most = rows.schema["doc_id"].dataType.simpleString(), rows.limit(target + 1).count()
    heads = ordered.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= target)
    classes = _few(heads.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_o", "doc_id"))).alias("_held")))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(parts), ignore_index=True)
        held = [[(r["_o"], r["doc_id"]) for r in x] for x in table["_held"]]
        if most <= target:
            picks = [i for _, i in sorted(x for rows_ in held for x in rows_)]
            yield pd.DataFrame({"doc_id": picks, "place": range(1, len(picks) + 1)})
            return
        codes, names = {}, {}
        for c in key:
            codes[c], names[c] = pd.factorize(table[c], use_na_sentinel=False)
        have = {c: np.zeros(len(names[c]), int) for c in key}
        quota = np.array([quotas.get(x, 0) for x in names["source"]])
        left, picks = np.array([len(x) for x in held]), []
        while len(picks) < target:
            open_ = (left > 0) & (have["source"] < quota)[codes["source"]]
            if not open_.any():
                break
            worth = sum(np.maximum(0, floor - have[d])[codes[d]] for d in dims).astype(float)
            for c, share, weight in extra:
                worth = worth + weight * _wanted(share, len(picks), have[c], list(names[c]))[codes[c]]
            worth[~open_] = -1.0
            best = min(np.flatnonzero(worth == worth.max()).tolist(), key=lambda i: held[i][len(held[i]) - left[i]])
            picks.append(held[best][len(held[best]) - left[best]][1])
            left[best] -= 1
            for c in key:
                have[c][codes[c][best]] += 1
        yield pd.DataFrame({"doc_id": picks, "place": range(1, len(picks) + 1)})

    return classes.repartition(1).mapInPandas(lambda parts: walk(parts) if (parts := _some(parts)) else iter(()), f"doc_id {kind}, place int")


def _some(parts: Iterator[pd.DataFrame]) -> list[pd.DataFrame]:
    return [p for p in parts if len(p)]


def dealt(n: int, desire: dict[str, float], room: dict[str, int]) -> list[tuple[str, int]]:
    """How n like rows go to splits, in order: each to the split of largest desire, then of most room, which then desires one less.

    Desires fall by whole steps, so all picks above a level are known at once; only the last few are made one by one.
    """
    desire, room, out = dict(desire), dict(room), []
    above = lambda level: {s: min(room[s], max(0, math.ceil(desire[s] - level))) for s in desire}
    low, high = min(desire.values()) - n - 1, max(desire.values())
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if sum(above(middle).values()) <= n else (middle, high)
    for s, c in above(high).items():
        if c:
            out.append((s, c))
            desire[s], room[s], n = desire[s] - c, room[s] - c, n - c
    while n:
        s = max((s for s in desire if room[s] > 0), key=lambda s: (desire[s], room[s]))
        out.append((s, 1))
        desire[s], room[s], n = desire[s] - 1, room[s] - 1, n - 1
    return out


def stratified_plan(classes: list[tuple[tuple[str, ...], int]], sizes: dict[str, int]) -> list[list[tuple[str, int]]]:
    """For each class (labels, rows) the numbers of its rows that go to each split: the label with the fewest rows left is next, its classes in order."""
    n = sum(c for _, c in classes)
    totals = Counter()
    for labels, c in classes:
        totals.update(dict.fromkeys(labels, c))
    desire = {x: {s: t * size / n for s, size in sizes.items()} for x, t in totals.items()}
    room, left, plan = dict(sizes), dict(totals), [[] for _ in classes]
    open_ = set(range(len(classes)))
    while open_:
        rare = min((c, x) for x, c in left.items() if c > 0)[1]
        for i in sorted(i for i in open_ if rare in classes[i][0]):
            labels, c = classes[i]
            plan[i] = dealt(c, desire[rare], room)
            for s, k in plan[i]:
                room[s] -= k
                for x in labels:
                    desire[x][s] -= k
            for x in labels:
                left[x] -= c
            open_.remove(i)
    return plan


def iterative_stratification(rows: DataFrame, labels: list[str], sizes: dict[str, int], seed: int) -> DataFrame:
    """(doc_id, split): rarest remaining label first; its rows go to the split that most desires it, then has most room.

    Rows of equal labels are one class: the plan is made over classes (in hash order), and rows, numbered in hash order within their
    class, find their split by their number.
    """
    n = sum(sizes.values())
    tags = F.array(*[F.concat(F.lit(f"{x}="), F.coalesce(F.col(x).cast("string"), F.lit("null"))) for x in labels])
    tagged = rows.select("doc_id", tags.alias("_tags"), order_key(seed, "stratify", F.col("doc_id")).alias("_o"))
    tagged = tagged.withColumn("_class", F.concat_ws("\0", "_tags"))
    classes = _few(tagged.groupBy("_class", "_tags").agg(F.count("*").alias("n"))).orderBy(order_key(seed, "class", F.col("_class")), "_class").collect()
    if (found := sum(r["n"] for r in classes)) != n:
        raise ValueError(f"sizes sum to {n}, there are {found} rows")
    spans = []
    for r, parts in zip(classes, stratified_plan([(tuple(dict.fromkeys(r["_tags"])), r["n"]) for r in classes], sizes), strict=True):
        at = 0
        for s, k in parts:
            spans.append((r["_class"], at, at + k, s))
            at += k
    spans = rows.sparkSession.createDataFrame(spans, "c string, low int, high int, split string")
    numbers = numbered(tagged.drop("_tags"), ["_class"], ["_o", "doc_id"])
    return numbers.join(spans, (F.col("_class") == F.col("c")) & (F.col("rn") > F.col("low")) & (F.col("rn") <= F.col("high"))).select("doc_id", "split")


def scoring_rounds(batch_ids: list[int], gaps_after, score_batch, budget: int, give_up: int = 2) -> dict:
    """Batches until no gap is left, the budget of attempts is spent, or the gaps have not shrunk for give_up batches; then what is open is dead.

    score_batch(batch, most) attempts up to most rows and returns how many; gaps_after() gives {bin: gap}."""
    gaps, tried, stalled, used = gaps_after(), 0, 0, []
    for b in batch_ids:
        if not sum(gaps.values()) or tried >= budget or stalled >= give_up:
            break
        if not (got := score_batch(b, budget - tried)):
            continue
        tried += got
        used.append(b)
        new = gaps_after()
        stalled = 0 if sum(new.values()) < sum(gaps.values()) else stalled + 1
        gaps = new
    return {"attempted": tried, "batches": used, "dead": sorted(k for k, v in gaps.items() if v) if stalled >= give_up else [], "gaps": gaps}


def balanced_steps(sizes: dict[str, int], batch: int, steps: int) -> list[dict[str, int]]:
    """Rows of each language in each step: batch // L, and the remainder to languages in turn."""
    names = sorted(sizes)
    base, extra = divmod(batch, len(names))
    return [{x: base + ((i - s * extra) % len(names) < extra) for i, x in enumerate(names)} for s in range(steps)]


def least_loaded(work: dict[str, float], workers: int) -> list[list[str]]:
    """Names dealt to workers, largest work first, each to the worker with least so far; what is done counts as no work."""
    loads, out = [0.0] * workers, [[] for _ in range(workers)]
    for name in sorted(work, key=lambda x: -work[x]):
        i = loads.index(min(loads))
        loads[i] += work[name]
        out[i].append(name)
    return out


def batch_ranges(rows: DataFrame, strata: list[str], batch: str = "batch") -> DataFrame:
    """(strata, low, high): the least and largest number of a stratum's rows in a batch that has any."""
    counts = rows.groupBy(*strata, batch).agg(F.count("*").alias("_n"))
    return counts.groupBy(*strata).agg(F.min("_n").alias("low"), F.max("_n").alias("high"))
