"""Content-stream state as windows: values that stay until set again, running moves, and matrices.

Each function takes the columns that name a sequence (a page) and those that order it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tree import cut


def so_far(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(value: Column, default: object, window) -> Column:
    """The last non-null value so far, or the default."""
    return F.coalesce(F.last(value, ignorenulls=True).over(window), F.lit(default))


def multiply(m: list[Column], n: list[Column]) -> list[Column]:
    """The product m * n of affine matrices (a, b, c, d, e, f): m first, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def apply_matrix(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def matrix_chain(matrices: Column) -> Column:
    """The product, in order, of an array of arrays of six numbers, each applied before what came so far."""
    at = lambda m: [m[i] for i in range(6)]
    identity = F.array(*(F.lit(float(x)) for x in (1, 0, 0, 1, 0, 0)))
    return F.aggregate(matrices, identity, lambda now, m: F.array(*multiply(at(m), at(now))))


def text_cursor(ops: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """ops (opcode, nums) with text state, text matrix and line origin as each op leaves them.

    Adds tc, tw, th, tl, font, fs, mode, rise; segment (a BT or Tm starts one), a, b, c, d, lm_e, lm_f; and line_segment
    (a move starts one). ops must have `name` for Tf. `'`, `"` and TD must have been expanded (see layout.expand_ops).
    """
    w = so_far(by, order)
    num = lambda i: F.get("nums", F.lit(i))
    when = lambda op, value: F.when(F.col("opcode") == op, value)
    ops = ops.select(
        "*",
        carried(when("Tc", num(0)), 0.0, w).alias("tc"),
        carried(when("Tw", num(0)), 0.0, w).alias("tw"),
        carried(when("Tz", num(0) / 100), 1.0, w).alias("th"),
        carried(when("TL", num(0)), 0.0, w).alias("tl"),
        F.last(when("Tf", F.col("name")), ignorenulls=True).over(w).alias("font"),
        carried(when("Tf", num(0)), 0.0, w).alias("fs"),
        carried(when("Tr", num(0)), 0.0, w).alias("mode"),
        carried(when("Ts", num(0)), 0.0, w).alias("rise"),
        F.last(F.when(F.col("opcode") == "BT", F.array(*(F.lit(float(x)) for x in (1, 0, 0, 1, 0, 0)))).when((F.col("opcode") == "Tm") & (F.size("nums") >= 6), F.col("nums")), ignorenulls=True).over(w).alias("start"),
        F.sum(F.when(F.col("opcode").isin("BT", "Tm"), 1).otherwise(0)).over(w).alias("segment"),
        F.sum(F.when(F.col("opcode").isin("BT", "Tm", "Td", "T*"), 1).otherwise(0)).over(w).alias("line_segment"),
    )
    part = lambda i, default: F.coalesce(F.get("start", F.lit(i)), F.lit(default))
    ops = ops.select("*", *(part(i, d).alias(n) for i, (n, d) in enumerate((("a", 1.0), ("b", 0.0), ("c", 0.0), ("d", 1.0), ("e0", 0.0), ("f0", 0.0)))))
    tx, ty = when("Td", num(0)), F.when(F.col("opcode") == "Td", num(1)).when(F.col("opcode") == "T*", -F.col("tl"))
    tx, ty = F.coalesce(tx, F.lit(0.0)), F.coalesce(ty, F.lit(0.0))
    inside = so_far([*by, "segment"], order)
    return ops.select(
        "*",
        (F.col("e0") + F.sum(tx * F.col("a") + ty * F.col("c")).over(inside)).alias("lm_e"),
        (F.col("f0") + F.sum(tx * F.col("b") + ty * F.col("d")).over(inside)).alias("lm_f"),
    ).drop("start", "e0", "f0")


def frames(ops: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """ops (opcode) with depth (of q), and values as each op leaves them: each the last non-null of its expression that Q has not taken back.

    A q opens a frame that ends at its Q, or never; a Q without a q changes nothing. Windows tell each op's frame (the last q at its
    depth), what was set so far inside that frame, and what was set around a frame when it was opened. Frames without
    a value look around themselves by pointer doubling: as many joins as the greatest depth has binary digits,
    on a row a frame. null by columns make one sequence.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    delta = F.when(F.col("opcode") == "q", 1).when(F.col("opcode") == "Q", -1).otherwise(0)
    keys = [f"_k{i}" for i in range(len(by))]
    rows = ops.select(*(F.struct(F.col(c)).alias(k) for c, k in zip(by, keys, strict=True)), F.struct("*").alias("_op"), (F.col("opcode") == "q").alias("_opens"), F.row_number().over(w).alias("_at"), F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"), *(v.alias(f"_{c}") for c, v in values.items()))
    w = so_far(keys, ["_at"])
    rows = rows.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w)))
    rows = rows.withColumn("_frame", F.coalesce(F.last(F.when(F.col("_opens"), F.col("_at")), ignorenulls=True).over(so_far([*keys, "depth"], ["_at"])), F.lit(0)))
    rows = rows.withColumn("_frame", F.when(F.col("depth") == 0, 0).otherwise(F.col("_frame")))
    inside = so_far([*keys, "_frame"], ["_at"])
    named = [f"_{c}" for c in values]
    rows = rows.select(*keys, "_op", "_at", "depth", "_opens", "_frame", *(F.last(c, ignorenulls=True).over(inside).alias(c) for c in named))
    before = Window.partitionBy(*keys).orderBy("_at")
    opened = rows.select(*keys, "_at", "_opens", "depth", F.coalesce(F.lag("_frame").over(before), F.lit(0)).alias("_top"), *(F.lag(c).over(before).alias(c) for c in named)).where("_opens")
    opened = cut(opened.select(*keys, F.col("_at").alias("_frame"), "depth", "_top", *named))
    left = opened.agg(F.max("depth")).first()[0] or 0
    while left > 1:
        up = opened.select(*keys, F.col("_frame").alias("_top"), F.col("_top").alias("_further"), *(F.col(c).alias(f"{c}_up") for c in named))
        opened = opened.join(up, [*keys, "_top"], "left").select(*keys, "_frame", "depth", F.coalesce("_further", F.lit(0)).alias("_top"), *(F.coalesce(c, f"{c}_up").alias(c) for c in named))
        opened = cut(opened)
        left = (left + 1) // 2
    around = opened.select(*keys, "_frame", *(F.col(c).alias(f"{c}_up") for c in named))
    return rows.join(around, [*keys, "_frame"], "left").select("_op.*", "depth", *(F.coalesce(f"_{c}", f"_{c}_up").alias(c) for c in values))


def graphics_state(ops: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """ops (opcode, nums, name) with line_width, line_cap, line_join, miter_limit, dash_array, dash_phase, intent, flatness and depth (of q) after each op.

    A Q gives back what was set at its q, see frames. dash_array is the op's nums without the last, which is dash_phase.
    """
    op, nums = F.col("opcode"), F.col("nums")
    number = lambda key: F.when(op == key, F.get(nums, F.lit(0)))
    values = {out: (number(key), F.lit(default)) for key, out, default in (("w", "line_width", 1.0), ("J", "line_cap", 0.0), ("j", "line_join", 0.0), ("M", "miter_limit", 10.0), ("i", "flatness", 0.0))}
    values["dash_array"] = F.when(op == "d", F.slice(nums, 1, F.greatest(F.size(nums) - 1, F.lit(0)))), F.array().cast("array<double>")
    values["dash_phase"] = F.when(op == "d", F.element_at(nums, -1)), F.lit(0.0)
    values["intent"] = F.when(op == "ri", F.col("name")), F.lit("RelativeColorimetric")
    found = frames(ops, by, order, {out: value for out, (value, _) in values.items()})
    return found.withColumns({out: F.coalesce(out, default) for out, (_, default) in values.items()})


def advance(widths: Column, codes: Column, fs: Column, tc: Column, tw: Column, th: Column) -> Column:
    """How far a string moves the cursor: th * sum(width / 1000 * fs + tc, and tw for a space)."""
    glyphs = F.aggregate(codes, F.lit(0.0), lambda s, c: s + F.coalesce(F.get(widths, c), F.lit(0.0)))
    spaces = F.size(F.filter(codes, lambda c: c == 32))
    return th * (glyphs / 1000 * fs + F.size(codes) * tc + spaces * tw)


def number_advance(amount: Column, fs: Column, th: Column) -> Column:
    """How far a number in TJ moves the cursor."""
    return -amount / 1000 * fs * th
