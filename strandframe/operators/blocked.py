"""Running values along a chromosome in two levels, so that no task holds a whole one.

Positions fall into blocks of BLOCK bases. Each block is summarised, one window runs over the block summaries (at most
as many rows as a chromosome has blocks), and the row-level windows stay inside their block. `blocked` adds the block
once; several calls of `running` on it then share one shuffle, since the rows stay partitioned by group and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def blocked(df: DataFrame, pos: str) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(pos) / BLOCK))


def running(df: DataFrame, by: tuple, order: list, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, current: bool = True, following: tuple[str, str] | None = None) -> DataFrame:
    """Adds, to a table that is `blocked` by the first of `order`, running sums and maxima by output name.

    They run over the rows up to this one, without it unless `current`. A sum over nothing is 0, a max null.
    `following` (position, output) adds the next row's position, null for a group's last.
    Rows with a null in `by` or in the position are left out.
    """
    values = {k: (F.sum, v) for k, v in (sums or {}).items()} | {k: (F.max, v) for k, v in (maxima or {}).items()}
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_blk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    each = [f(v).alias(f"_s_{k}") for k, (f, v) in values.items()]
    base = [f(f"_s_{k}").over(before).alias(f"_b_{k}") for k, (f, _) in values.items()]
    rows = [f(v).over(upto).alias(f"_i_{k}") for k, (f, v) in values.items()]
    if following:
        each.append(F.min(following[0]).alias("_s_next"))
        base.append(F.lead("_s_next").over(Window.partitionBy(*by).orderBy("_blk")).alias("_b_next"))
        rows.append(F.lead(following[0]).over(inside).alias("_i_next"))
    blocks = df.groupBy(*by, "_blk").agg(*each).select(*by, "_blk", *base)
    both = df.select("*", *rows).join(blocks, [*by, "_blk"])
    out = {k: F.coalesce(f"_i_{k}", F.lit(0)) + F.coalesce(f"_b_{k}", F.lit(0)) if f is F.sum else F.greatest(f"_i_{k}", f"_b_{k}") for k, (f, _) in values.items()}
    if following:
        out[following[1]] = F.coalesce("_i_next", "_b_next")
    made = {f"_{p}_{k}" for p in "ib" for k in [*values, "next"]}
    return both.select(*[c for c in both.columns if c not in made and c not in out], *[v.alias(k) for k, v in out.items()])
