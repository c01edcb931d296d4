"""References to records that do not exist: pending-orphan state per key.

Registrations, deletions and references of one key form a timeline. The state
of a key is the number of live parents and the references that wait for one.
A reference probes that state: it is an orphan if no parent is live. An arriving
parent resolves what waits, the deletion of the last one reopens it. The fold over
the timeline of an epoch is a running sum per key, sorted and spilled by Spark, so a key of
any size needs constant memory; hot keys are salted, their few parent
events repeated per salt. ``advance`` carries the state from epoch to epoch, ``replay`` does so over a whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.skew import salt, spread
from loomgraph.session import materialize

#: Salts per hot key.
SALTS = 64


def parent_events(registry: DataFrame, key: str, born: str, gone: str) -> DataFrame:
    """(``key``, ``ts``, ``delta``): +1 when a parent row begins to count, -1 when it ends.

    Rows with a null key or ``born`` never count, nor do rows that end before they begin. Rows stored
    more than once count once. ``gone`` null means still there.
    """
    r = registry.select(F.col(key).alias("key"), F.col(born).alias("b"), F.col(gone).alias("g")).filter("key is not null and b is not null and (g is null or g > b)").distinct()
    steps = r.select("key", F.explode(F.array(F.struct(F.col("b").alias("ts"), F.lit(1).alias("delta")), F.struct(F.col("g").alias("ts"), F.lit(-1).alias("delta")))).alias("e"))
    steps = steps.select("key", "e.ts", "e.delta").filter("ts is not null").groupBy("key", "ts").agg(F.sum("delta").alias("delta"))
    # only the moments at which the first parent comes or the last one goes matter
    live = F.sum("delta").over(Window.partitionBy("key").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    alive = steps.withColumn("_n", live).select("key", "ts", F.signum("_n").alias("now"), F.signum(F.col("_n") - F.col("delta")).alias("before"))
    return alive.select("key", "ts", (F.col("now") - F.col("before")).cast("int").alias("delta")).filter("delta <> 0")


def _timeline(refs: DataFrame, events: DataFrame, ref_cols: list[str], hot: list, state: DataFrame | None) -> DataFrame:
    nulls = [F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in ref_cols]
    parents = spread(events, "key", hot, SALTS).select("key", "salt", "ts", F.col("delta").cast("int").alias("delta"), *nulls)
    salted = refs.withColumn("salt", salt(F.hash(*ref_cols), F.col("key"), hot, SALTS))
    all_ = parents.unionByName(salted.select("key", "salt", "ts", F.lit(0).alias("delta"), *ref_cols))
    if state is not None:
        carried = spread(state.filter("live > 0"), "key", hot, SALTS)
        all_ = all_.unionByName(carried.select("key", "salt", F.lit(None).cast("timestamp").alias("ts"), F.col("live").cast("int").alias("delta"), *nulls))
    # nulls first: carried state comes before every event; parents come before references of the same moment
    w = Window.partitionBy("key", "salt").orderBy(F.col("ts").asc_nulls_first(), F.abs("delta").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return all_.withColumn("live", F.sum("delta").over(w))


def orphans(refs: DataFrame, events: DataFrame, ref_cols: list[str], hot: list = (), state: DataFrame | None = None) -> DataFrame:
    """References (``key``, ``ts`` and ``ref_cols``) for which no parent is live at ``ts``.

    A parent that begins at ``ts`` is live, one that ends at ``ts`` is not. A reference with a null key or a
    null ``ts`` has no live parent and comes out. Repeated references come out as often as they are stored.
    ``ref_cols`` must be unique per row for nothing but spreading hot keys. Empty tables give no rows or all references.
    """
    dated = refs.filter("key is not null and ts is not null")
    never = refs.filter("key is null or ts is null").select("key", "ts", *ref_cols)
    found = _timeline(dated, events, ref_cols, list(hot), state).filter("delta = 0 and live <= 0").select("key", "ts", *ref_cols)
    return found.unionByName(never)


def advance(live: DataFrame | None, pending: DataFrame | None, refs: DataFrame, events: DataFrame, by: list[str], ref_cols: list[str], hot: list = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One epoch of the incremental state: (live, pending, orphans found in the epoch).

    ``live`` (``key``, ``live``) and ``pending`` (``key``, ``by``, ``month``, ``n``, ``open``) are those of the epoch before, None at first;
    ``events`` and ``refs`` are those of this epoch, none of which may be older than the epoch before. References probe the
    live parents, those without one are added to ``pending``; parents that arrived close what waits for them, the deletion of the last one
    opens it again. Both tables grow with keys and months, not with references.
    """
    found = orphans(refs, events, ref_cols, hot, live)
    now = events.select("key", F.col("delta").cast("bigint").alias("live"))
    new = found.groupBy("key", *by, F.date_trunc("month", "ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    if live is not None:
        now = now.unionByName(live)
    if pending is not None:
        new = new.unionByName(pending.drop("open"))
    now = now.groupBy("key").agg(F.sum("live").alias("live"))
    new = new.groupBy("key", *by, "month").agg(F.sum("n").alias("n"))
    new = new.join(now.filter("live > 0"), "key", "left").select("key", *by, "month", "n", F.col("live").isNull().alias("open"))
    return now, new, found


def waiting(pending: DataFrame, by: list[str]) -> DataFrame:
    """Orphans per ``by`` and month they were made in: all so far, and those that wait for a parent now; resolved ones are out, reopened ones in."""
    return pending.groupBy(*by, "month").agg(F.sum("n").alias("n_orphans"), F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).alias("n_waiting"))


def epoch_of(ts: Column, bounds: list) -> Column:
    """Number of the epoch of a moment: how many of the ascending ``bounds`` are not after it; 0 for null."""
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= ts)), F.lit(0)) if bounds else F.lit(0)


def even_bounds(refs: DataFrame, epochs: int, ts: str = "ts") -> list:
    """Moments that cut the time of ``refs`` into equal epochs; none where no moment is known."""
    lo, hi = refs.agg(F.min(ts), F.max(ts)).first()
    return [lo + (hi - lo) * i / epochs for i in range(1, epochs)] if lo else []


def replay(refs: DataFrame, events: DataFrame, by: list[str], ref_cols: list[str], bounds: list, hot: list = (), keep_pending: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(orphans, pending) after all epochs that ``bounds`` cut: :func:`advance` from one to the next with the state written in between.

    References are written once, apart by epoch, and every epoch reads its own. The result is the same for all ``bounds``. Without
    ``keep_pending`` only the live parents are carried, which is all that later epochs need to find their orphans.
    """
    refs = materialize(refs.withColumn("_epoch", epoch_of(F.col("ts"), bounds)), "references", ("_epoch",))
    events = materialize(events.withColumn("_epoch", epoch_of(F.col("ts"), bounds)), "events", ("_epoch",))
    live = pending = found = None
    for i in range(len(bounds) + 1):
        at = F.col("_epoch") == i
        live, pending, new = advance(live, pending, refs.filter(at).drop("_epoch"), events.filter(at).drop("_epoch"), by, ref_cols, hot)
        if i < len(bounds):
            live = materialize(live, "live")
            if keep_pending:
                pending = materialize(pending, "pending")
        if not keep_pending:
            pending = None
        found = new if found is None else found.unionByName(new)
    return found, pending


def snapshot(refs: DataFrame, pending: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by`` columns and month of ``ts``: references, those that were orphans when made, and those of them that still wait or wait again.

    Columns: ``by``, ``month`` (timestamp, null for references without ``ts``), ``n_refs``, ``n_orphans``, ``n_unresolved``.
    """
    first = refs.groupBy(*by, F.date_trunc("month", "ts").alias("month")).agg(F.count(F.lit(1)).alias("n_refs"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "month"]]
    none = F.lit(0).cast("bigint")
    return (
        first.alias("a").join(waiting(pending, by).alias("b"), on, "left")
        .select(*[F.col(f"a.{c}").alias(c) for c in [*by, "month"]], "n_refs", F.coalesce("n_orphans", none).alias("n_orphans"), F.coalesce("n_waiting", none).alias("n_unresolved"))
    )
