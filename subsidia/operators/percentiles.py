"""Exact interpolated percentiles of groups of any size: value ranges are narrowed by histograms before anything is gathered."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Values of a group that one task may sort, and bins of a histogram.
HELD, BINS = 1 << 20, 4096


def percentiles(frame: DataFrame, by: Sequence[str], asked: Mapping[str, tuple[Column, float]], held: int = HELD, bins: int = BINS) -> DataFrame:
    """(by, names): for each name its column's percentile of finite values in each group, interpolated between ranks.

    A scan finds each group's number and range; as long as more than held values lie in a range, another counts them in
    bins, of which only those of the two ranks stay. A last one gathers what is left. The driver holds the bins of each
    group and name, so groups have to be few. Groups without a finite value have nulls.
    """
    spark, names = frame.sparkSession, list(asked)
    keys = [f"key{i}" for i in range(len(by))]
    rows = frame.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), *(x.cast("double").alias(n) for n, (x, _) in asked.items()))
    rows = rows.unpivot(keys, names, "name", "x") if keys else rows.unpivot([], names, "name", "x")
    good = rows.where(F.abs("x") < math.inf)
    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    where = [*keys, "name"]
    # by group and name: values under the range, values in it, the range
    state = {tuple(r[: len(where)]): [0, *r[len(where) :]] for r in good.groupBy(*where).agg(F.count("*"), F.min("x"), F.max("x")).collect()}
    ranks = {g: (s[1] - 1) * asked[g[-1]][1] for g, s in state.items()}

    def ranged(groups: list[tuple]) -> DataFrame:
        at = lambda g: [f(ranks[g]) - state[g][0] + 1 for f in (math.floor, math.ceil)]
        small = spark.createDataFrame([(*g, state[g][2], state[g][3], *at(g)) for g in groups], f"{kinds}name string, lo double, hi double, low int, high int")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in where]
        joined = good.alias("a").join(F.broadcast(small).alias("b"), same).select(*(F.col(f"a.{k}") for k in where), "x", "lo", "hi", "low", "high")
        return joined.where("x BETWEEN lo AND hi")

    open_range = lambda s: s[1] > held and s[3] / 2 - s[2] / 2 > 0
    wide = [g for g, s in state.items() if open_range(s)]
    while wide:
        bin_of = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        found: dict[tuple, list] = {g: [] for g in wide}
        for r in ranged(wide).groupBy(*where, bin_of.alias("bin")).agg(F.count("*"), F.min("x"), F.max("x")).collect():
            found[tuple(r[: len(where)])].append(r[len(where) :])
        for g in wide:
            part = sorted(found[g])
            upto = state[g][0] + np.cumsum([x[1] for x in part])
            first, last = (int(np.searchsorted(upto, k, "right")) for k in (math.floor(ranks[g]), math.ceil(ranks[g])))
            below = int(upto[first - 1]) if first else state[g][0]
            state[g] = [below, int(upto[last]) - below, part[first][2], part[last][3]]
            if first != last:  # neighbouring ranks in two bins: the greatest of one and the least of the other
                state[g] = [int(upto[first]) - 1, 2, part[first][3], part[last][2]]
        wide = [g for g in wide if open_range(state[g])]
    done = {g: [s[2 + f(ranks[g]) - s[0]] if s[1] == 2 else s[2] for f in (math.floor, math.ceil)] for g, s in state.items() if s[1] == 2 or s[2] == s[3]}
    if rest := [g for g in state if g not in done]:
        ordered = ranged(rest).groupBy(*where, "low", "high").agg(F.sort_array(F.collect_list("x")).alias("all"))
        for r in ordered.select(*where, F.expr("element_at(all, low)"), F.expr("element_at(all, high)")).collect():
            done[tuple(r[: len(where)])] = r[len(where) :]
    out: dict[tuple, dict[str, float]] = {}
    for g, (a, b) in done.items():
        out.setdefault(g[:-1], {})[g[-1]] = a + (b - a) * (ranks[g] - math.floor(ranks[g]))
    kinds = "".join(f"`{b}` {frame.schema[b].dataType.simpleString()}, " for b in by)
    return spark.createDataFrame([(*g, *(x.get(n) for n in names)) for g, x in out.items()], kinds + ", ".join(f"`{n}` double" for n in names))
