"""Grouped work that stays balanced when one key owns a large share of the rows.

A window partitioned by a hot key, or an exact median of it, would put all rows of that
key into one task.  The helpers here first check how large the largest group is (a
combinable count over the key columns only).  Bounded groups use plain windows and
aggregates; larger ones use ordered scans over chunks of a key and bracketed percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType
from pyspark.sql.window import Window

from skyloom.session import cut_lineage

# Groups up to this many rows fit one task; larger ones are split.
CHUNK_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; reads only the key columns and combines before the shuffle."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join one-row-per-key ``stats`` back to the rows of ``df``.

    The sides are never forced into a broadcast.  Rows of a hot key are all on the left
    side, where adaptive execution splits an oversized partition into several tasks and
    sends the single matching row of ``stats`` to each (``RUNTIME_CONF`` turns that on).
    """
    return df.join(stats, list(keys), "left")


def attach_few(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``attach`` for few keys of many rows: ``stats`` is stored once and broadcast when counted as small, so the rows stay where they are."""
    return attach(df, broadcast_if_small(cut_lineage(stats)), keys)


def group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Per-key aggregates written back on each row, without a window over the key."""
    return attach(df, df.groupBy(*keys).agg(*aggs), keys)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in ``order``: a combinable ``min_by``, not ``row_number``."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}")
                         for i, o in enumerate(order)])
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordered).alias("_best"))
    return top.select(*keys, *[F.col("_best")[c].alias(c) for c in rest]).select(*df.columns)


def nulls_last(col: Column | str) -> tuple[Column, Column]:
    """Two ordering columns that put NULL after every value inside a struct ordering."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull(), c


def exact_percentiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Column | str, float]],
                      hot_rows: int = CHUNK_ROWS, accuracy: int = 2000, largest: int | None = None,
                      also: Sequence[Column] = ()) -> DataFrame:
    """Exact linear-interpolation percentiles per key, for keys of any size.

    ``also`` adds plain aggregates, computed in the same pass where possible.

    When no group exceeds ``hot_rows`` this is Spark's exact ``percentile``, whose buffer is
    then bounded.  Callers whose groups are bounded by construction pass ``largest``.
    """
    keys, names = list(keys), list(wanted)
    cols = [F.col(c) if isinstance(c, str) else c for c, _ in wanted.values()]
    probs = [float(p) for _, p in wanted.values()]
    if (largest_group(df, keys) if largest is None else largest) <= hot_rows:
        return df.groupBy(*keys).agg(*[F.percentile(c, p).alias(n) for n, c, p in zip(names, cols, probs)], *also)
    vals = df.select(*keys, *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    out = _bracketed_percentiles(vals, keys, names, probs, accuracy)
    if not also:
        return out
    more = df.groupBy(*keys).agg(*also)
    return out.join(more, keys) if keys else out.crossJoin(F.broadcast(more))


def _bracketed_percentiles(vals: DataFrame, keys: list[str], names: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """Percentiles of very large groups.

    A sketch brackets every wanted rank, rows outside the bracket are only counted, and the
    order statistics are read by a spilling window from the distinct values inside.  Where a
    bracket misses its rank, all are widened eightfold and read again; the widest holds everything.
    """
    pieces = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_v{i}").alias("_v")) for i in range(len(names))])
    long = vals.select(*keys, F.explode(pieces).alias("_s")).select(*keys, "_s._i", "_s._v")
    margin = 4.0 / accuracy
    while True:
        out = cut_lineage(_read_brackets(long, keys, names, probs, accuracy, margin)[0])
        if margin >= 1 or out.filter("_missed").isEmpty():
            return out.drop("_missed")
        margin = min(1.0, 8 * margin)


def _read_brackets(long: DataFrame, keys: list[str], names: list[str], probs: list[float], accuracy: int, margin: float) -> tuple[DataFrame, DataFrame]:
    """(percentiles of all keys and ``_missed``, keys with a rank that lies outside its bracket); ``long`` is read for the sketch and for the ranks."""
    grid = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)})
    sketch = long.groupBy(*keys, "_i").agg(
        F.count("_v").alias("_m"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", grid, accuracy).alias("_q"))
    at = lambda q: grid.index(min(1.0, max(0.0, q))) + 1
    low = F.element_at(F.array(*[F.lit(at(p - margin)) for p in probs]), F.col("_i") + 1)
    high = F.element_at(F.array(*[F.lit(at(p + margin)) for p in probs]), F.col("_i") + 1)
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1)
    bracket = sketch.select(
        *keys, "_i", "_m", (prob * (F.col("_m") - 1)).alias("_rank"),
        F.when(prob <= margin, F.col("_min")).otherwise(F.element_at("_q", low)).alias("_lo"),
        F.when(prob >= 1 - margin, F.col("_max")).otherwise(F.element_at("_q", high)).alias("_hi"))
    # The rows stay where they are while the brackets are few: they are neither dealt by hot keys nor, as the seemingly smaller side, broadcast.
    bracket = cut_lineage(bracket)
    near = broadcast_if_small(bracket)
    placed = attach(long, near if near is not bracket else near.hint("merge"), [*keys, "_i"])
    # Equal values collapse before ranking: copies of one value cost one row, and so do all values below the bracket (as NULL).
    counted = placed.filter("_v <= _hi").groupBy(*keys, "_i", "_rank", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("_c").over(w))
    last = F.col("_cum") - 1
    first = last - F.col("_c") + 1
    lower, upper = F.floor("_rank"), F.ceil("_rank")
    picked = ranked.groupBy(*keys, "_i", "_rank").agg(
        F.max(F.when((first <= lower) & (last >= lower), F.col("_v"))).alias("_at_low"),
        F.max(F.when((first <= upper) & (last >= upper), F.col("_v"))).alias("_at_high"))
    value = F.col("_at_low") + (F.col("_at_high") - F.col("_at_low")) * (F.col("_rank") - F.floor("_rank"))
    found = bracket.select(*keys, "_i", "_m").join(picked, [*keys, "_i"], "left").withColumn("_val", value)
    absent = (F.col("_m") > 0) & (F.col("_at_low").isNull() | F.col("_at_high").isNull())
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_val"))).alias(n) for i, n in enumerate(names)], F.coalesce(F.bool_or(absent), F.lit(False)).alias("_missed"))
    return out, out.filter("_missed")


def median_by(df: DataFrame, keys: Sequence[str], *cols: str, largest: int | None = None) -> DataFrame:
    """Exact medians per key under the columns' own names."""
    return exact_percentiles(df, keys, {c: (c, 0.5) for c in cols}, largest=largest)


def pooled_medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str], low: float, high: float, weight: str, bins: int = 4096) -> DataFrame:
    """(keys..., _n, cols...): weighted counts and exact medians of values between ``low`` and ``high``, for rows that are dear to write.

    One pass counts ``bins`` bins per column, a second one ranks only the values of the bins that hold the
    middle, so what is exchanged is bounded by the bins and not by the rows; ``df`` is computed twice.
    """
    keys = list(keys)
    pieces = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).alias("_v")) for i, c in enumerate(cols)])
    long = df.select(*keys, F.col(weight).alias("_w"), F.explode(pieces).alias("_s")).select(*keys, "_w", "_s._i", "_s._v")
    # The bin rises with the value, whatever the rounding.
    at = F.floor((F.col("_v") - F.lit(low)) * F.lit(bins / (high - low)))
    long = long.withColumn("_b", F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int"))
    hist = cut_lineage(long.groupBy(*keys, "_i", "_b").agg(F.sum("_w").alias("_c")))
    per = Window.partitionBy(*keys, "_i")
    run = hist.withColumns({"_cum": F.sum("_c").over(per.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)), "_m": F.sum("_c").over(per)})
    lower, upper = F.floor((F.col("_m") - 1) / 2), F.ceil((F.col("_m") - 1) / 2)
    holds = lambda rank: (F.col("_cum") - F.col("_c") <= rank) & (F.col("_cum") > rank)
    middle = run.filter(holds(lower) | holds(upper)).select(*keys, "_i", "_b", "_m", (F.col("_cum") - F.col("_c")).alias("_before"))
    counted = long.join(broadcast_if_small(middle), [*keys, "_i", "_b"]).groupBy(*keys, "_i", "_b", "_m", "_before", "_v").agg(F.sum("_w").alias("_c"))
    inside = Window.partitionBy(*keys, "_i", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.col("_before") + F.sum("_c").over(inside))
    both = ranked.groupBy(*keys, "_i").agg(F.max("_m").alias("_m"), F.max(F.when(holds(lower), F.col("_v"))).alias("_lo"), F.max(F.when(holds(upper), F.col("_v"))).alias("_hi"))
    mid = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(0.5)
    return both.groupBy(*keys).agg(F.coalesce(F.max("_m"), F.lit(0)).alias("_n"), *[F.max(F.when(F.col("_i") == i, mid)).alias(c) for i, c in enumerate(cols)])


SAMPLES = 32  # sampled rows to a chunk


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType)


def range_starts(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int) -> tuple[DataFrame, int]:
    """(keys..., _starts) for keys of more than ``chunk_rows`` rows, and the greatest number of starts.

    ``_starts`` are the ordered first rows (structs of ``order``) of a key's second and later ranges.  A
    sample of ``SAMPLES`` rows to a range, chosen by hash and so the same in every run, is
    ranked per key; every so many ranks a range begins.  The sample of one key has ``SAMPLES`` /
    ``chunk_rows`` of its rows, which is why it may be gathered in one array.
    """
    keys = list(keys)
    rate = max(1, chunk_rows // SAMPLES)
    stride = -(-chunk_rows // rate)
    cols = [F.col(f"`{c}`") for c in (*keys, *order)]
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk_rows).drop("_n")
    sample = df.select(*cols).filter(F.pmod(F.xxhash64(*cols), F.lit(rate)) == 0)
    if keys:
        sample = sample.join(hot, keys, "left_semi")
    ranked = sample.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(*[F.col(f"`{o}`") for o in order]))).alias("_s"))
    # The window and the struct both put NULL before every value.
    starts = cut_lineage(ranked.select(*keys, F.filter("_s", lambda x, i: (i > 0) & (i % stride == 0)).alias("_starts")))
    return starts, starts.agg(F.max(F.size("_starts"))).first()[0] or 0


class OrderedScan:
    """Lag, lead, running sums and row numbers per key in ``order``.

    When every group has at most ``chunk_rows`` rows these are plain windows.  Otherwise a
    larger group is split at ``range_starts`` into chunks of about that many rows, however its
    values are spread and whatever their types; windows run per (key, chunk) and one summary
    row per chunk carries values across chunk borders.  Rows equal in the whole order are told
    apart by a hash of their other columns, so they are divided too; only rows that
    repeat every column share a chunk.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int = CHUNK_ROWS,
                 largest: int | None = None):
        self.keys, self.order, self.df = list(keys), list(order), df
        self.split = (largest_group(df, keys) if largest is None else largest) > chunk_rows
        if not self.split:
            return
        hashed = [f.name for f in df.schema.fields if f.name not in self.keys and _hashable(f.dataType)]
        self.df = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
        self.order.append("_tie")
        starts, most = range_starts(self.df, self.keys, self.order, chunk_rows)
        # Without keys there is a single row of starts.
        placed = attach(self.df, starts, self.keys) if self.keys else self.df.crossJoin(F.broadcast(starts))
        own = F.struct(*[F.col(f"`{o}`") for o in self.order])
        # Binary search: how many starts are not above the row.
        halves = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most.bit_length())))])
        chunk = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.coalesce(F.get("_starts", at + step - 1) <= own, F.lit(False)), at + step).otherwise(at))
        self.df = placed.withColumn("_chunk", F.coalesce(chunk, F.lit(0)).cast("long")).drop("_starts")

    @property
    def _part(self) -> list[str]:
        return [*self.keys, "_chunk"] if self.split else self.keys

    @property
    def window(self):
        return Window.partitionBy(*self._part).orderBy(*self.order)

    def lag(self, values: dict[str, str]) -> "OrderedScan":
        """``values`` maps output name to source column; the previous row's values."""
        return self._shift(values, forward=True)

    def lead(self, values: dict[str, str]) -> "OrderedScan":
        return self._shift(values, forward=False)

    def _shift(self, values: dict[str, str], forward: bool) -> "OrderedScan":
        move = F.lag if forward else F.lead
        if not self.split:
            self.df = self.df.withColumns({n: move(F.col(c)).over(self.window) for n, c in values.items()})
            return self
        packed = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
        order = F.struct(*self.order)
        border = F.max_by(packed, order) if forward else F.min_by(packed, order)
        w = Window.partitionBy(*self.keys).orderBy("_chunk")
        edge = self.df.groupBy(*self._part).agg(border.alias("_s")).select(*self._part, move("_s").over(w).alias("_edge"))
        out = self.df.withColumn("_local", move(packed).over(self.window)).join(edge, self._part, "left")
        keep = [c for c in self.df.columns if c not in values]
        got = F.coalesce("_local", "_edge")
        self.df = out.select(*keep, *[got[n].alias(n) for n in values])
        return self

    def running_sum(self, name: str, value: Column, inclusive: bool = True) -> "OrderedScan":
        rows = self.window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local = F.coalesce(F.sum(value).over(rows), F.lit(0))
        if not self.split:
            self.df = self.df.withColumn(name, local)
            return self
        w_chunk = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        offset = self.df.groupBy(*self._part).agg(F.sum(value).alias("_s")).select(
            *self._part, F.coalesce(F.sum("_s").over(w_chunk), F.lit(0)).alias("_off"))
        out = self.df.withColumn(name, local).join(offset, self._part, "left")
        self.df = out.withColumn(name, F.col(name) + F.col("_off")).drop("_off")
        return self

    def fill(self, values: dict[str, str], forward: bool = True) -> "OrderedScan":
        """Last (or next) non-NULL value of each source column, the row itself included.

        The next value is the last one in reversed order: a frame that ends at the current row
        grows with it, while one that starts there would be rebuilt for every row.
        """
        order = [F.col(o) if forward else F.col(o).desc() for o in self.order]
        rows = Window.partitionBy(*self._part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        local = {n: F.last(F.col(c), ignorenulls=True).over(rows) for n, c in values.items()}
        if not self.split:
            self.df = self.df.withColumns(local)
            return self
        key = F.struct(*self.order)
        take = F.max_by if forward else F.min_by
        before = Window.partitionBy(*self.keys).orderBy(F.col("_chunk") if forward else F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
        edge = self.df.groupBy(*self._part).agg(
            *[take(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"_e_{n}") for n, c in values.items()])
        edge = edge.select(*self._part, *[F.last(F.col(f"_e_{n}"), ignorenulls=True).over(before).alias(f"_f_{n}") for n in values])
        out = self.df.withColumns(local).join(edge, self._part, "left")
        self.df = out.withColumns({n: F.coalesce(n, f"_f_{n}") for n in values}).drop(*[f"_f_{n}" for n in values])
        return self

    def row_number(self, name: str) -> "OrderedScan":
        return self.running_sum(name, F.lit(1).cast("long"))

    def done(self) -> DataFrame:
        return self.df.drop("_chunk", "_tie") if self.split else self.df


def island_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, prev: dict[str, str],
               out: str, chunk_rows: int = CHUNK_ROWS, largest: int | None = None) -> DataFrame:
    """Gaps-and-islands: ``out`` counts from 1 and rises where ``breaks`` holds.

    ``prev`` names the lagged columns ``breaks`` may use (output name to source column).
    """
    scan = OrderedScan(df, keys, order, chunk_rows, largest).lag(prev)
    flag = F.when(F.coalesce(breaks, F.lit(False)), 1).otherwise(0).cast("long")
    # The flag uses window output, so it becomes a column before it is summed.
    scan.df = scan.df.withColumn("_flag", flag)
    scan.running_sum(out, F.col("_flag"))
    return scan.done().withColumn(out, F.col(out) + 1).drop("_flag", *prev)


def broadcast_if_small(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """Hint a broadcast only after counting the rows; a larger table joins by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition into the session's shuffle partitions ahead of a step that multiplies rows.

    Adaptive execution would otherwise merge the small input into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)
