"""Exact grouped quantiles with bounded memory, for any distribution.

Spark's exact ``percentile`` keeps, per group, a map of distinct value ->
count; for continuous values in a huge group (a week holding a third of
all events) that map is the group itself.  Here no task ever holds more than
``small`` values of a group:

* a group whose open interval of candidates holds at most ``small`` values
  collects and sorts them (one aggregate, bounded) and reads the two ranks
  floor((n-1)p) and ceil((n-1)p) (linear interpolation, as pandas, NumPy and
  Spark's ``percentile``);
* a larger one is narrowed first: a quantile sketch of the candidates gives
  two of their own values that bracket the rank, one aggregate counts the
  candidates below, at, between and above them, and the interval becomes
  the part that holds the rank, or the rank is one of the two values.

The bracket is cut by rank, not by value, so skewed values, infinities and
repeated values cost no more rounds; every round keeps about 1/200 of the
candidates and drops at least the two values themselves, so it ends.  The
work is counted aggregates with map-side combining; the shuffle carries one
row per task and group.  Both paths (below and above ``small``) give the same
value, the exact quantile.

NULL and NaN are missing.  A group without values has NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.operators.common import attach_row
from tremor.session import materialize

GRID = 512                      # sketch quantiles; a bracket spans two or three steps
SMALL = 32_768                  # values of a group that one task may hold


def _attach(vals: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """State columns on every row: by scalar subquery for the global group,
    else by a null-safe equi-join (groups may have NULL keys)."""
    if not by:
        return attach_row(vals, state)
    s = state.select(*[F.col(c).alias(f"__k_{c}") for c in by], *[c for c in state.columns if c not in by])
    same = [vals[c].eqNullSafe(s[f"__k_{c}"]) for c in by]
    return vals.join(s, same).drop(*[f"__k_{c}" for c in by])


def present(col: str) -> Column:
    """The column as double, NULL where it is missing (NULL or NaN)."""
    value = F.col(col).cast("double")
    return F.when(~F.isnan(value), value)


def listed_quantile(col: str, p: float) -> Column:
    """Aggregate: the exact ``p`` quantile of a group of bounded size, from its
    sorted values."""
    x = F.sort_array(F.collect_list(present(col)))
    h = (F.size(x) - 1) * F.lit(float(p))
    k = F.greatest(F.floor(h), F.lit(0)).cast("int")
    a0, a1, frac = F.get(x, k), F.get(x, k + 1), h - F.floor(h)
    return F.when((frac <= 0) | a1.isNull() | (a0 == a1), a0).otherwise(a0 + frac * (a1 - a0))


def largest_group(df: DataFrame, col: str, by) -> int:
    """Most present values that a group has: one counted aggregate."""
    return df.groupBy(*by).agg(F.count(present(col)).alias("__n")).agg(F.max("__n")).first()[0] or 0


def exact_quantile(df: DataFrame, col: str, p: float, by, small: int = SMALL, out: str | None = None) -> DataFrame:
    """One row per group: the exact ``p`` quantile of ``col``; ``by=[]`` gives
    one global row.  A first aggregate counts the groups' values; where all
    have at most ``small`` a second one collects and sorts them, and nothing
    is written but the counts.  Else ``df`` is written once and narrowed."""
    by = list(by)
    out = out or f"q_{col}"
    src = df.select(*by, present(col).alias("__v"))
    h = (F.col("__n") - 1) * F.lit(float(p))
    counts = materialize(src.groupBy(*by).agg(F.count("__v").alias("__n")))
    if (counts.agg(F.max("__n")).first()[0] or 0) <= small:
        return src.groupBy(*by).agg(listed_quantile("__v", p).alias(out))
    vals = materialize(src)
    # interval (lo, hi) open and unbounded at first; below: values at or under lo
    state = counts.select(
        *by, F.col("__n"), F.greatest(F.floor(h), F.lit(0)).cast("long").alias("__k"), F.col("__n").alias("__c"),
        F.lit(0).cast("long").alias("__below"), F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi"),
        F.lit(None).cast("double").alias("__at"), F.lit(None).cast("double").alias("__next"))
    inside = ((F.col("__lo").isNull() | (F.col("__v") > F.col("__lo"))) & (F.col("__hi").isNull() | (F.col("__v") < F.col("__hi"))))
    known = vals.where(F.col("__v").isNotNull())
    open_state = ["__k", "__c", "__below", "__lo", "__hi"]

    rounds = 0
    while not (wide := state.where((F.col("__c") > small) & F.col("__at").isNull())).isEmpty():
        rounds += 1
        if rounds > 64:
            raise RuntimeError(f"quantile of {col} did not narrow")
        cand = _attach(known, wide.select(*by, *open_state), by).where(inside)
        grid = [i / GRID for i in range(GRID + 1)]
        sketch = cand.groupBy(*by, *open_state).agg(F.percentile_approx("__v", grid, 10 * GRID).alias("__g"))
        place = (F.col("__k") - F.col("__below") + F.lit(0.5)) / F.col("__c") * GRID
        cut = sketch.select(*by, *open_state,
                            F.element_at("__g", F.greatest(F.floor(place), F.lit(1)).cast("int")).alias("__a"),
                            F.element_at("__g", F.least(F.ceil(place) + 2, F.lit(GRID + 1)).cast("int")).alias("__b"))
        cut = materialize(cut)
        v, a, b = F.col("__v"), F.col("__a"), F.col("__b")
        counted = (_attach(known, cut, by).where(inside).groupBy(*by, *open_state, "__a", "__b").agg(
            F.count_if(v < a).alias("__lt"), F.count_if(v == a).alias("__ea"), F.count_if((v > a) & (v < b)).alias("__mid"),
            F.count_if((v == b) & (b > a)).alias("__eb"), F.count_if(v > b).alias("__gt"),
            F.min(F.when(v > a, v)).alias("__na"), F.min(F.when(v > b, v)).alias("__nb")))
        r = F.col("__k") - F.col("__below")
        e1 = F.col("__lt")
        e2 = e1 + F.col("__ea")
        e3 = e2 + F.col("__mid")
        e4 = e3 + F.col("__eb")
        part = F.when(r < e1, 0).when(r < e2, 1).when(r < e3, 2).when(r < e4, 3).otherwise(4)

        def pick(*choices):
            w = F.when(F.col("__p") == 0, choices[0])
            for i, c in enumerate(choices[1:], 1):
                w = w.when(F.col("__p") == i, c)
            return w

        none = F.lit(None).cast("double")
        after_a = F.when(r + 1 < e2, a).otherwise(F.coalesce("__na", "__hi"))
        after_b = F.when(r + 1 < e4, b).otherwise(F.coalesce("__nb", "__hi"))
        zero = F.lit(0).cast("long")
        below = F.col("__below")
        moved = counted.withColumn("__p", part).select(
            *by, "__k", pick(F.col("__lt"), zero, F.col("__mid"), zero, F.col("__gt")).alias("__c"),
            pick(below, below, below + e2, below, below + e4).alias("__below"),
            pick(F.col("__lo"), none, a, none, b).alias("__lo"), pick(a, none, b, none, F.col("__hi")).alias("__hi"),
            pick(none, a, none, b, none).alias("__at"), pick(none, after_a, none, after_b, none).alias("__next"))
        total = _attach(moved, state.select(*by, "__n"), by).select(*state.columns)
        rest = state.where(~((F.col("__c") > small) & F.col("__at").isNull()))
        state = materialize(rest.unionByName(total))

    left = state.where(F.col("__at").isNull() & (F.col("__c") > 0))
    lists = (_attach(known, left.select(*by, *open_state), by).where(inside).groupBy(*by, *open_state)
             .agg(F.sort_array(F.collect_list("__v")).alias("__x")))
    r = (F.col("__k") - F.col("__below")).cast("int")
    found = lists.select(*by, F.get("__x", r).alias("__a0"), F.coalesce(F.get("__x", r + 1), F.col("__hi")).alias("__a1"))
    done = state.where(F.col("__at").isNotNull()).select(*by, F.col("__at").alias("__a0"), F.col("__next").alias("__a1"))
    both = found.unionByName(done)
    if by:
        s = state.select(*by, "__n", "__k")
        b2 = both.select(*[F.col(c).alias(f"__k_{c}") for c in by], "__a0", "__a1")
        res = s.join(b2, [s[c].eqNullSafe(b2[f"__k_{c}"]) for c in by], "left")
    else:
        res = attach_row(state.select("__n", "__k"), both.agg(F.max("__a0").alias("__a0"), F.max("__a1").alias("__a1")))
    frac = h - F.col("__k")
    a0, a1 = F.col("__a0"), F.col("__a1")
    return res.select(*by, F.when((frac <= 0) | a1.isNull() | (a0 == a1), a0).otherwise(a0 + frac * (a1 - a0)).alias(out))
