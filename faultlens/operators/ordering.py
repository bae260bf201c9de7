"""Order-dependent operators that stay distributed when one group is huge.

A plain ``Window.partitionBy(g).orderBy(t)`` sends a whole group to one task; with a
group holding a third of all rows that task is the job.  These helpers split each
group into time buckets - refining any bucket that is itself too big - solve the
problem per bucket, and stitch buckets together with a small per-(group, bucket)
aggregate:

* :func:`top_n_per_group` - first N rows per group (cutoff bucket found from counts),
* :func:`running_rank` - row number within the group (bucket offsets + local rank),
* :func:`with_previous` - the previous row's values (local lag + carry from the
  previous non-empty bucket).

The per-(group, bucket) tables are materialised with ``checkpoint()`` (reliable, in
``spark.checkpoint.dir``) and broadcast only after their row count is checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.time import epoch_micros

BROADCAST_ROW_LIMIT = 2_000_000
BROADCAST_BYTES_KEY = "faultlens.broadcast.maxBytes"
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
DEFAULT_BUCKET_SECONDS = 3600
MAX_BUCKET_ROWS = 5_000_000          # rows one task may sort for one bucket
TIE_LEVELS = 8                       # rounds of cutting one instant by its tiebreak
BUCKET = ["_bucket", "_sub"]         # time bucket, and the start of a tiebreak range where an instant is cut


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: reliable checkpoint into the session's shared checkpoint folder."""
    return materialize_counted(df)[0]


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpoint and return the row count, observed during the checkpoint job itself."""
    done, seen = materialize_observed(df)
    return done, seen["rows"]


def materialize_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Checkpoint; the row count and any extra aggregate ``metrics`` are observed in the same job."""
    from faultlens.session import shared_dir
    shared_dir(df.sparkSession)
    obs = Observation("faultlens_observed")
    named = [F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]]
    done = df.observe(obs, *named).checkpoint(eager=True)
    seen = dict(obs.get)
    seen["rows"] = int(seen["rows"])
    return done, seen


def materialize_sized(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """As :func:`materialize_observed`, with ``bytes``: the size of all rows as JSON text, measured in the same job."""
    done, seen = materialize_observed(df, bytes=F.sum(F.octet_length(F.to_json(F.struct("*")))), **metrics)
    seen["bytes"] = int(seen["bytes"] or 0)
    return done, seen


def broadcast_budget(spark) -> int:
    """Bytes a broadcast side may take: ``faultlens.broadcast.maxBytes`` if set, else 64 MiB."""
    return int(spark.conf.get(BROADCAST_BYTES_KEY, str(DEFAULT_BROADCAST_BYTES)))


def maybe_broadcast(small: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT, rows: int | None = None,
                    size: int | None = None) -> DataFrame:
    """Broadcast a *materialised* side only when its measured size is within the limits.

    ``rows`` and ``size`` come from :func:`materialize_sized`; without them both are measured here, on the
    materialised data.  Beyond either limit the side is returned unhinted, so the join shuffles (and AQE may
    still split skewed partitions).
    """
    if rows is None or size is None:
        row = small.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
        rows, size = row[0], row[1] or 0
    if rows <= row_limit and size <= broadcast_budget(small.sparkSession):
        return F.broadcast(small)
    return small


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys match each other: rows with a NULL group or time are never lost.

    A null-safe comparison of plain columns is a hash or sort-merge join like an equality.
    """
    side = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(side, on, how).drop(*[f"__{k}" for k in keys])


def _adaptive_buckets(df: DataFrame, group_cols: list[str], ts_col: str, tiebreak: str, bucket_seconds: int,
                      max_bucket_rows: int, extra_aggs=()) -> tuple[DataFrame, DataFrame, dict]:
    """Buckets of at most about ``max_bucket_rows`` rows, in the order of (time, tiebreak).

    Rows get the start (epoch micros) of a ``bucket_seconds`` bucket; rows without a time share the
    NULL bucket, which sorts first as in a plain window.  Per-(group, bucket) counts are
    materialised; only buckets above the limit are cut into aligned finer buckets (minute, second,
    millisecond, microsecond), and only their rows are counted again.  An instant (or the NULL bucket) that
    is still above it is cut into ranges of an integer tiebreak, ``_sub``.  Starts sort in order
    across levels because finer buckets tile their parent.  Returns the bucketed rows, the
    materialised per-bucket stats (``_cnt`` plus ``extra_aggs``) and the stats' measured size.
    Without hot buckets this is one pass.
    """
    us = epoch_micros(F.col(ts_col))
    top = bucket_seconds * 1_000_000
    widths = [top] + [w for w in (60_000_000, 1_000_000, 1_000, 1) if w < top and top % w == 0]
    keys = [*group_cols, *BUCKET]
    whole = isinstance(df.schema[tiebreak].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    tie = F.col(tiebreak).cast("long") if whole else F.lit(None).cast("long")
    bounds = [F.min(tie).alias("_lo"), F.max(tie).alias("_hi")]

    def start(width: int) -> Column:
        return (us - F.pmod(us, F.lit(width))).cast("long")

    def stats(frame: DataFrame):
        return materialize_sized(frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"), *bounds, *extra_aggs),
                                 biggest=F.max("_cnt"))

    def recut(b, st, over, finer, settled, *extra):
        """Give the rows of the buckets ``over`` new ``finer`` bucket columns and count those rows again."""
        hot, size = materialize_sized(st.where(over).select(*keys, *extra, F.lit(True).alias("_hot")))
        if size["rows"] == 0:
            return None
        b = join_null_safe(b, maybe_broadcast(hot, rows=size["rows"], size=size["bytes"]), keys, "left")
        b = b.withColumn("_again", F.coalesce("_hot", F.lit(False)))
        b = b.withColumns({c: F.when(F.col("_again"), new).otherwise(F.col(c)) for c, new in finer.items()})
        settled.append(st.where(~over))
        again = stats(b.where("_again"))
        return b.select(*df.columns, *BUCKET), *again

    b = df.withColumns({"_bucket": start(widths[0]), "_sub": F.lit(None).cast("long")})
    st, seen = stats(b)
    settled: list[DataFrame] = []
    over = F.col("_cnt") > max_bucket_rows
    for width in widths[1:]:
        if (seen["biggest"] or 0) <= max_bucket_rows:
            break
        done = recut(b, st, over & F.col("_bucket").isNotNull(), {"_bucket": start(width)}, settled)
        if done is None:
            break
        b, st, seen = done
    parts = F.ceil(F.col("_cnt") / F.lit(max_bucket_rows))
    span = F.col("_hi").cast("double") - F.col("_lo").cast("double") + 1
    splittable = over & F.coalesce((F.col("_hi") > F.col("_lo")) & (span < F.lit(2.0 ** 62)), F.lit(False))
    if settled:
        st = reduce(DataFrame.unionByName, settled, st)
        settled = []
        st, seen = materialize_sized(st, biggest=F.max("_cnt"))
    for _ in range(TIE_LEVELS):
        if (seen["biggest"] or 0) <= max_bucket_rows:
            break
        step = F.greatest(F.ceil(span / parts), F.lit(1)).cast("long").alias("_step")
        finer = F.expr("_lo + ((cast(" + f"`{tiebreak}`" + " as long) - _lo) div _step) * _step")
        done = recut(b, st, splittable, {"_sub": finer}, settled, "_lo", step)
        if done is None:
            break
        b, st, seen = done
    if settled:
        st, seen = materialize_sized(reduce(DataFrame.unionByName, settled, st))
    return b, st.drop("_lo", "_hi"), seen


def _rows_before(group_cols: list[str]) -> Column:
    return F.coalesce(F.sum("_cnt").over(
        Window.partitionBy(*group_cols).orderBy(*BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def top_n_per_group(df: DataFrame, group_cols: list[str], ts_col: str, tiebreak: str, n: int,
                    bucket_seconds: int = DEFAULT_BUCKET_SECONDS, rank_col: str = "rank",
                    max_bucket_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """First ``n`` rows per group by (ts, tiebreak), with their rank; exact.

    1. rows per (group, bucket) - map-side combined, tiny shuffle (hot buckets refined);
    2. rows in earlier buckets per group -> keep buckets that start before rank n;
       buckets wholly inside the top n have at most n rows, the one cutoff bucket is
       trimmed by a group-limited window (partial limit runs before the shuffle);
    3. rank = rows before the bucket + rank inside it.
    """
    b, st, _ = _adaptive_buckets(df, group_cols, ts_col, tiebreak, bucket_seconds, max_bucket_rows)
    keep, seen = materialize_sized(st.withColumn("_before", _rows_before(group_cols))
                                   .where(F.col("_before") < n).select(*group_cols, *BUCKET, "_before"))
    kept = join_null_safe(b, maybe_broadcast(keep, rows=seen["rows"], size=seen["bytes"]), [*group_cols, *BUCKET])
    local = F.row_number().over(Window.partitionBy(*group_cols, *BUCKET).orderBy(ts_col, tiebreak))
    return (kept.withColumn("_rn", local)
            .where((F.col("_rn") <= n) & (F.col("_rn") + F.col("_before") <= n))
            .withColumn(rank_col, (F.col("_rn") + F.col("_before")).cast("int"))
            .drop("_rn", "_before", *BUCKET))


def running_rank(df: DataFrame, group_cols: list[str], ts_col: str, tiebreak: str,
                 bucket_seconds: int = DEFAULT_BUCKET_SECONDS, rank_col: str = "rank",
                 max_bucket_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """Row number within each group by (ts, tiebreak) without one task per group or bucket."""
    b, st, _ = _adaptive_buckets(df, group_cols, ts_col, tiebreak, bucket_seconds, max_bucket_rows)
    offsets, seen = materialize_sized(st.withColumn("_before", _rows_before(group_cols)).drop("_cnt"))
    local = F.row_number().over(Window.partitionBy(*group_cols, *BUCKET).orderBy(ts_col, tiebreak))
    return (join_null_safe(b, maybe_broadcast(offsets, rows=seen["rows"], size=seen["bytes"]), [*group_cols, *BUCKET])
            .withColumn(rank_col, (local + F.col("_before")).cast("long"))
            .drop("_before", *BUCKET))


def with_previous(df: DataFrame, group_cols: list[str], ts_col: str, tiebreak: str, cols: list[str],
                  bucket_seconds: int = DEFAULT_BUCKET_SECONDS, prefix: str = "prev_",
                  max_bucket_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """Adds ``prev_<c>`` for ``ts_col`` and each of ``cols``: the previous row of the group.

    NULL for the first row of a group.  The lag runs per (group, bucket); the first row
    of a bucket takes the last row of the previous non-empty bucket of its group.
    """
    carried = [ts_col, tiebreak, *[c for c in cols if c not in (ts_col, tiebreak)]]
    last = F.max(F.struct(*[F.col(c) for c in carried])).alias("_last")
    b, st, _ = _adaptive_buckets(df, group_cols, ts_col, tiebreak, bucket_seconds, max_bucket_rows, extra_aggs=[last])
    w_b = Window.partitionBy(*group_cols).orderBy(*BUCKET)
    carry, seen = materialize_sized(st.withColumn("_carry", F.lag("_last").over(w_b))
                                    .select(*group_cols, *BUCKET, "_carry"))
    w = Window.partitionBy(*group_cols, *BUCKET).orderBy(ts_col, tiebreak)
    prev = F.coalesce(F.lag(F.struct(*[F.col(c) for c in carried])).over(w), F.col("_carry"))
    side = maybe_broadcast(carry, rows=seen["rows"], size=seen["bytes"])
    out = join_null_safe(b, side, [*group_cols, *BUCKET]).withColumn("_prev", prev)
    for c in [ts_col, *cols]:
        out = out.withColumn(prefix + c, F.col("_prev")[c])
    return out.drop("_prev", "_carry", *BUCKET)


def global_order_number(df: DataFrame, order_cols: list[Column | str], col: str = "k",
                        num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in a total order, computed without one big task.

    Range-partition by the order, number rows inside each partition, and add the row
    counts of earlier partitions (one small row per partition, safe to broadcast).
    The order columns must form a unique key.
    """
    if num_partitions is None:
        # about a million rows per range partition, however many that takes
        df, rows = materialize_counted(df)
        num_partitions = max(1, -(-rows // 1_000_000))
    n = num_partitions
    # monotonically_increasing_id = (partition id << 33) + position inside the partition,
    # so after a local sort it is the in-partition rank; the checkpoint pins it down.
    ranged = materialize(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_cnt")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33) + F.lit(1)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(col, (local + F.col("_off")).cast("long")).drop("_pid", "_mid", "_off"))


def exact_median(df: DataFrame, value_col: str, key_cols: list[str]) -> Column:
    """Exact median (linear interpolation, like ``percentile(x, 0.5)``) as a scalar subquery,
    computed from global positions instead of one buffer holding every value.
    ``key_cols`` make the order unique."""
    vals = df.select(value_col, *key_cols).where(F.col(value_col).isNotNull())
    numbered = global_order_number(vals, [value_col, *key_cols], col="_k")
    n = numbered.agg(F.count(F.lit(1))).scalar()
    lo = F.floor((n + F.lit(1)) / F.lit(2))
    hi = F.floor(n / F.lit(2)) + F.lit(1)
    middle = numbered.where((F.col("_k") == lo) | (F.col("_k") == hi))
    return middle.agg(F.avg(value_col)).scalar()
