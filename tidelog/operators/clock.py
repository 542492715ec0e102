"""Vector clocks, as rows (key, node_id, cnt) and as maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.lsm import WRITE_BITS, probes


def counts(log: DataFrame) -> DataFrame:
    """key, node_id, cnt: every write increments its coordinator's count."""
    return log.groupBy("key", "node_id").agg(F.count(F.lit(1)).alias("cnt"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The greater count of every node."""
    return a.unionByName(b).groupBy("key", "node_id").agg(F.max("cnt").alias("cnt"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, a_descends, b_descends, conflict_compat and conflict_true of two sets of clocks.

    x descends y if no count of y's is greater and x has a greater one, or a
    node more (even with count 0).  Equal clocks don't descend from each other:
    conflict_compat counts them as a conflict, conflict_true doesn't.
    """
    both = a.withColumnRenamed("cnt", "x").join(b.withColumnRenamed("cnt", "y"), ["key", "node_id"], "full")
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    ad = ~F.bool_or(y > x) & (F.bool_or(x > y) | F.bool_or(F.col("y").isNull()))
    bd = ~F.bool_or(x > y) & (F.bool_or(y > x) | F.bool_or(F.col("x").isNull()))
    out = both.groupBy("key").agg(ad.alias("a_descends"), bd.alias("b_descends"), F.bool_or(~F.col("x").eqNullSafe(F.col("y"))).alias("differ"))
    compat = ~F.col("a_descends") & ~F.col("b_descends")
    return out.select("key", "a_descends", "b_descends", compat.alias("conflict_compat"), (compat & F.col("differ")).alias("conflict_true"))


def merge_maps(a: Column, b: Column) -> Column:
    """Pointwise maximum of two clocks given as maps."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def increment_map(clock: Column, node: str) -> Column:
    one = F.create_map(F.lit(node), F.coalesce(F.try_element_at(clock, F.lit(node)), F.lit(0)) + 1)
    return F.map_zip_with(clock, one, lambda _, x, y: F.coalesce(y, x))


def descends_maps(a: Column, b: Column) -> Column:
    """Whether the clock map a descends b (strictly)."""
    of = lambda m, k: F.try_element_at(m, k)
    none_greater = F.forall(F.map_keys(b), lambda k: F.coalesce(of(a, k), F.lit(0)) >= of(b, k))
    more = F.exists(F.map_keys(a), lambda k: of(b, k).isNull() | (of(a, k) > of(b, k)))
    return none_greater & more


def fold_writes(log: DataFrame) -> DataFrame:
    """node_id, key, seq, own_count, conflict_compat and conflict_true of every write (key, node_id, seq, client).

    A node takes the writes of a key in the order of seq.  A write with a
    client's clock (a map, or null) is compared with the clock that the node
    has, which then takes the greater counts and increments its own.  The fold
    has a closed form: counts of other nodes are running maxima of the clients'
    counts, and one's own after i writes is i more than the running maximum of
    (client's count - writes before it), 0 at least.  A write is compared on the
    names that clocks of its key at its node have, no others.
    """
    order = Window.partitionBy("node_id", "key").orderBy("seq")
    numbered = log.select("node_id", "key", "seq", "client", F.row_number().over(order).alias("i"))
    told = log.select("node_id", "key", F.explode(F.map_keys("client")).alias("n"))
    named = told.unionByName(log.select("node_id", "key", F.col("node_id").alias("n"))).distinct()
    each = numbered.join(named, ["node_id", "key"]).withColumn("k", F.try_element_at("client", F.col("n")))
    line = Window.partitionBy("node_id", "key", "n").orderBy("seq")
    until, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("k") - (F.col("i") - 1)
    own = F.col("n") == F.col("node_id")
    zero = F.lit(0).cast("bigint")
    had = F.when(own, F.when(F.col("i") > 1, F.col("i") - 1 + F.greatest(zero, F.max(ahead).over(before)))).otherwise(F.max("k").over(before))
    has = F.when(own, F.col("i") + F.greatest(zero, F.max(ahead).over(until)))
    rows = each.select("node_id", "key", "seq", "client", "k", had.alias("had"), has.alias("has"))
    x, y = F.coalesce("had", zero), F.coalesce("k", zero)
    node_descends = ~F.bool_or(F.col("k").isNotNull() & (y > x)) & F.bool_or(F.col("had").isNotNull() & (F.col("k").isNull() | (x > y)))
    client_descends = ~F.bool_or(F.col("had").isNotNull() & (x > y)) & F.bool_or(F.col("k").isNotNull() & (F.col("had").isNull() | (y > x)))
    out = rows.groupBy("node_id", "key", "seq").agg(
        F.max("has").alias("own_count"),
        F.bool_or(F.col("client").isNotNull()).alias("told"),
        (~node_descends & ~client_descends).alias("neither"),
        F.bool_or(~F.col("had").eqNullSafe(F.col("k"))).alias("differ"),
    )
    compat = F.col("told") & F.col("neither")
    return out.select("node_id", "key", "seq", "own_count", compat.alias("conflict_compat"), (compat & F.col("differ")).alias("conflict_true"))


def write_local(log: DataFrame) -> DataFrame:
    """What a node does with each write (key, node_id, seq, client and the log's columns), in one row a write.

    node_id, key, seq, own_count, conflict_compat, conflict_true, applied (its
    clock is newer than all that the node had), the entry as it is logged, and
    bits, those that it sets in the write path's filter.  Every write is logged
    and notified, with the vector clock merged and incremented; whether it shows
    in the memory table is for the clock to say.
    """
    clocks = fold_writes(log)
    before = Window.partitionBy("node_id", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    stamp = F.struct("physical_time", "logical_counter", "value")
    seen = log.select("node_id", "key", "seq", "value", "physical_time", "logical_counter", stamp.alias("c"), F.max(stamp).over(before).alias("best"))
    applied = (F.col("best").isNull() | (F.col("c") > F.col("best"))).alias("applied")
    entry = seen.select("node_id", "key", "seq", "value", "physical_time", "logical_counter", applied, probes(F.col("key"), WRITE_BITS).alias("bits"))
    return entry.join(clocks, ["node_id", "key", "seq"])
