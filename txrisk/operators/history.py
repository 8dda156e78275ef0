"""Per-user history features: velocity, distinct counts and running moments.

Every feature is a running sum over one ordered sequence per user. A transaction enters a window
as a positive entry and leaves it as a negative *expiry* entry, so a sliding window costs the same
for any number of rows in it. Ordinary users take one shuffle by user. Users with more than
`hot_rows` rows are cut into time slices, each headed by a carry row with the state so far.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from txrisk.functions import scalar as S
from txrisk.operators.prefix import dealt, rows_and_widths, slice_of, within_limit
from txrisk.operators.sketches import with_distinct_estimates
from txrisk.options import US, FeatureOptions

# Slice widths to choose from for a split user, in seconds.
SLICE_WIDTHS_S = [86_400, 3_600, 60, 1]

GROUPS = ("velocity", "distinct", "moments")

# kinds of entries in a user's sequence, in their order at equal times
CARRY, EXPIRY, TX = -1, 0, 1

EXACT = "decimal(38,0)"
# Sums are exact for amounts below these sizes, at 16 digits behind the point in windows and at 6 in the
# moments; larger amounts, of any size, are added up as doubles beside them.
WINDOW_EXACT, MOMENTS_EXACT = 1e12, 1e9


def history_features(tx: DataFrame, opts: FeatureOptions = FeatureOptions(),
                     groups: tuple[str, ...] = GROUPS, arrival: str | None = None) -> DataFrame:
    """`tx` plus the history columns of the asked groups.

    Rows of a user are taken in (ts_us, `arrival`) order, or (ts_us, transaction_id) without an
    arrival column: a row sees the rows before it and itself, as if they had arrived in turn.

    velocity: tx_count_1h, tx_count_24h, tx_sum_1h, tx_sum_24h
    distinct: unique_merchants_24h, unique_countries_7d
    moments:  prior_count, prior_sum, prior_sumsq, prior_fraud

    The distinct mode `hll` takes merged sketches per time slice instead of members (`sketches.with_distinct_estimates`).
    """
    if opts.distinct_mode == "hll" and "distinct" in groups:
        others = tuple(g for g in groups if g != "distinct")
        rest = history_features(tx, opts, others, arrival) if others else tx
        return with_distinct_estimates(rest, opts, arrival or "transaction_id")
    payload = tx.columns
    rows = tx.withColumns({
        **_window_parts(F.col("amount")),
        "seq": F.col(arrival) if arrival else F.col("transaction_id"),
    })
    count, hot = hot_users(tx, opts)
    if hot is None:
        return _windows(_entries(_neighbours(rows, ["user_id"], count, opts, groups), [], opts, groups, payload),
                        ["user_id"], opts, groups, payload)

    if within_limit(hot, opts.broadcast_rows):
        hot = F.broadcast(hot)
    cold_rows = rows.join(hot, "user_id", "left_anti")
    hot_rows = rows.join(hot, "user_id").withColumn("slice", slice_of("ts_us"))
    cold = _windows(_entries(_neighbours(cold_rows, ["user_id"], count, opts, groups), [], opts, groups, payload),
                    ["user_id"], opts, groups, payload)

    linked = hot_rows
    if _members(opts, groups):
        seen = hot_rows.unionByName(_edges(hot_rows, opts, groups), allowMissingColumns=True)
        linked = _neighbours(seen, ["user_id", "slice"], count, opts, groups).filter("edge is null")
    entries = _entries(linked, ["width"], opts, groups, payload).withColumn("slice", slice_of("at"))
    carried = entries.unionByName(_carry(entries, hot_rows, count, opts, groups), allowMissingColumns=True)
    carried = dealt(carried, ["user_id", "slice"], count, opts.task_rows)
    return cold.unionByName(_windows(carried, ["user_id", "slice"], opts, groups, payload))


def hot_users(tx: DataFrame, opts: FeatureOptions) -> tuple[int, DataFrame | None]:
    """The number of rows, and users above `hot_rows` rows with the slice `width` (micros) to cut them by; None if there are none.

    No width exceeds the shortest expiry, so an idle gap that ends a session always falls between
    two slices.
    """
    shortest = min(opts.merchant_ttl_s, opts.country_ttl_s, opts.moments_ttl_s)
    widths = [w * US for w in SLICE_WIDTHS_S if w <= shortest] or [US]
    return rows_and_widths(tx, ["user_id"], "ts_us", widths, opts.hot_rows, opts.slice_rows, opts.broadcast_rows)


def _members(opts: FeatureOptions, groups: tuple[str, ...]) -> dict[str, list[str]]:
    """What is looked up in the user's past and future, per group of features."""
    members = {}
    if "velocity" in groups:
        members["same"] = ["amount", "transaction_id"]
    if "distinct" in groups:
        members["merchant"] = ["merchant_id"]
        members["country"] = ["country"]
    return members


def _neighbours(rows: DataFrame, keys: list[str], count: int, opts: FeatureOptions, groups: tuple[str, ...]) -> DataFrame:
    """Times of the previous and next row with the same member (replayed transaction, merchant, country)."""
    columns = {}
    for name, cols in _members(opts, groups).items():
        w = Window.partitionBy(*keys, *cols).orderBy("ts_us", "seq")
        columns[f"prev_{name}"] = F.lag("ts_us").over(w)
        columns[f"next_{name}"] = F.lead("ts_us").over(w)
    return dealt(rows, keys, count, opts.task_rows).withColumns(columns)


def _edges(hot_rows: DataFrame, opts: FeatureOptions, groups: tuple[str, ...]) -> DataFrame:
    """For each slice and member the nearest occurrence in an earlier and in a later slice."""
    edges = None
    for cols in _members(opts, groups).values():
        w = Window.partitionBy("user_id", *cols).orderBy("slice")
        spans = hot_rows.groupBy("user_id", "slice", *cols).agg(
            F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
        both = (
            spans.withColumn("near", F.array(F.lag("hi").over(w), F.lead("lo").over(w)))
            .select("user_id", "slice", *cols, F.lit(True).alias("edge"), F.explode("near").alias("ts_us"))
            .filter("ts_us is not null")
        )
        edges = both if edges is None else edges.unionByName(both, allowMissingColumns=True)
    return edges


def _entries(rows: DataFrame, extra: list[str], opts: FeatureOptions, groups: tuple[str, ...],
             payload: list[str]) -> DataFrame:
    """One TX entry per row and one EXPIRY entry per window the row leaves.

    A row whose member is still in the window adds nothing, and a row whose member comes again
    before the window ends does not expire: a member counts once, from its latest occurrence.
    """
    windows = {}
    if "velocity" in groups:
        windows["in_short"] = ("same", opts.short_window_s)
        windows["in_long"] = ("same", opts.long_window_s)
    if "distinct" in groups and opts.distinct_mode == "sliding":
        windows["in_merchants"] = ("merchant", opts.merchant_ttl_s)
        windows["in_countries"] = ("country", opts.country_ttl_s)
    zero = F.lit(0).cast("bigint")
    ts = F.col("ts_us")
    keep = [c for c in payload if c != "user_id"]
    carried = [c for c in ("exact", "big", "prev_merchant", "prev_country") if c in rows.columns]

    def entry(kind: int, at: Column, deltas: dict[str, Column], full: bool) -> Column:
        body = F.struct(*[F.col(c) for c in keep])
        return F.struct(
            F.lit(kind).alias("kind"), at.alias("at"),
            *[deltas.get(n, zero).alias(n) for n in windows],
            (body if full else F.lit(None)).alias("body"),
        )

    fresh = {
        name: F.when(F.col(f"prev_{m}").isNull() | (ts - F.col(f"prev_{m}") > w * US), 1).otherwise(0).cast("bigint")
        for name, (m, w) in windows.items()
    }
    pieces = [entry(TX, ts, fresh, True)]
    for name, (m, w) in windows.items():
        leaves = F.col(f"next_{m}").isNull() | (F.col(f"next_{m}") - ts > w * US)
        pieces.append(F.when(leaves, entry(EXPIRY, ts + (w * US + 1), {name: F.lit(-1).cast("bigint")}, False)))
    return rows.select("user_id", *extra, *carried, "seq", F.inline(F.array_compact(F.array(*pieces))))


def _windows(entries: DataFrame, keys: list[str], opts: FeatureOptions, groups: tuple[str, ...],
             payload: list[str]) -> DataFrame:
    """The running sums, all on one sort by (time, kind, seq)."""
    ordered = Window.partitionBy(*keys).orderBy("at", "kind", "seq")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    is_tx = F.col("kind") == TX
    sliced = "slice" in keys

    def carry(name: str) -> Column:
        return F.when(F.col("kind") == CARRY, F.col(name)) if sliced else F.lit(None)

    out: dict[str, Column] = {}
    first: dict[str, Column] = {}
    ttls: dict[str, int] = {}
    if "velocity" in groups:
        for name, delta in (("1h", "in_short"), ("24h", "in_long")):
            first[f"n_{name}"] = F.sum(delta).over(upto)
            for part in ("exact", "big"):
                first[f"{part}_{name}"] = F.sum(F.coalesce(carry(f"{delta}_{part}"), _signed(delta, part))).over(upto)
            out[f"tx_count_{name}"] = F.col(f"n_{name}").cast("int")
            out[f"tx_sum_{name}"] = F.col(f"exact_{name}").cast("double") + F.col(f"big_{name}")
    if "distinct" in groups:
        if opts.distinct_mode == "sliding":
            first["n_merchants"] = F.sum("in_merchants").over(upto)
            first["n_countries"] = F.sum("in_countries").over(upto)
        else:
            ttls |= {"merchant": opts.merchant_ttl_s, "country": opts.country_ttl_s}
        out["unique_merchants_24h"] = F.col("n_merchants").cast("int")
        out["unique_countries_7d"] = F.col("n_countries").cast("int")
    if "moments" in groups:
        ttls["moments"] = opts.moments_ttl_s
        # a row's own share is computed once, below the windows
        entries = entries.withColumns({"label": F.col("body.label"), "amount": F.col("body.amount")})
        entries = entries.withColumns({f"own_{name}": value for name, value in _moments().items()})
        for name in _moments():
            first[f"c_{name}"] = F.sum(F.coalesce(carry(f"m_{name}"), F.when(is_tx, F.col(f"own_{name}")))).over(upto)
    if ttls:
        first["prev_tx"] = F.last(F.when(F.col("kind") != EXPIRY, F.col("at")), ignorenulls=True).over(before)
    df = entries.withColumns(first)

    def starts(ttl: int) -> Column:
        return is_tx & (F.col("prev_tx").isNull() | (F.col("at") - F.col("prev_tx") > ttl * US))

    if "moments" in ttls:
        own = {n: F.col(f"own_{n}") for n in _moments()}
        base = F.struct(*[(F.col(f"c_{n}") - own[n]).alias(n) for n in own])
        df = df.withColumn("base", F.last(F.when(starts(ttls["moments"]), base), ignorenulls=True).over(upto))
        for n in own:
            out[f"prior_{n}"] = F.col(f"c_{n}") - own[n] - F.coalesce(F.col(f"base.{n}"), F.lit(0))
        out["prior_sum"] = out["prior_sum"].cast("double") / S.UNITS + out.pop("prior_bigsum")
        out["prior_sumsq"] = out["prior_sumsq"].cast("double") / (float(S.UNITS) * S.UNITS) + out.pop("prior_bigsq")
    distinct = {m: n for m, n in (("merchant", "n_merchants"), ("country", "n_countries")) if m in ttls}
    if distinct:
        df = df.withColumns({
            f"since_{m}": F.last(F.coalesce(carry(f"since_{m}_carry"), F.when(starts(ttls[m]), F.col("at"))),
                                 ignorenulls=True).over(upto)
            for m in distinct
        })
        new = {m: F.when(is_tx & (F.col(f"prev_{m}").isNull() | (F.col(f"prev_{m}") < F.col(f"since_{m}"))), 1)
               .otherwise(0).cast("bigint") for m in distinct}
        df = df.withColumns({f"new_{m}": F.coalesce(carry(f"seen_{m}"), new[m]) for m in distinct})
        df = df.withColumns({f"all_{m}": F.sum(f"new_{m}").over(upto) for m in distinct})
        df = df.withColumns({
            f"old_{m}": F.last(F.when(starts(ttls[m]), F.col(f"all_{m}") - F.col(f"new_{m}")),
                               ignorenulls=True).over(upto)
            for m in distinct
        })
        df = df.withColumns({n: F.col(f"all_{m}") - F.coalesce(F.col(f"old_{m}"), F.lit(0))
                             for m, n in distinct.items()})
    fields = [F.col("user_id") if c == "user_id" else F.col(f"body.{c}").alias(c) for c in payload]
    return df.filter(is_tx).select(*fields, *[v.alias(k) for k, v in out.items()])


def _window_parts(amount: Column) -> dict[str, Column]:
    """An amount as an exact part and a part that only a double can hold; one of them is 0."""
    small = F.abs(amount) < WINDOW_EXACT
    return {"exact": F.when(small, amount).otherwise(0.0).cast("decimal(28,16)"), "big": F.when(small, 0.0).otherwise(amount)}


def _signed(delta: str, part: str) -> Column:
    """What an entry adds to a window's sum; its delta is 1, 0 or -1."""
    value, zero = F.col(part), F.lit(0).cast("decimal(28,16)") if part == "exact" else F.lit(0.0)
    return F.when(F.col(delta) > 0, value).when(F.col(delta) < 0, -value).otherwise(zero)


def _moments() -> dict[str, Column]:
    """A transaction's own share of the running moments; a missing fraud flag counts as 0."""
    amount = F.col("amount")
    small = F.abs(amount) < MOMENTS_EXACT
    units = F.round(F.when(small, amount).otherwise(0.0) * S.UNITS).cast("decimal(16,0)")
    return {
        "count": F.lit(1).cast("bigint"),
        "sum": units.cast(EXACT),
        "sumsq": (units * units).cast(EXACT),
        "bigsum": F.when(small, 0.0).otherwise(amount),
        "bigsq": F.when(small, 0.0).otherwise(amount * amount),
        "fraud": F.coalesce(F.col("label"), F.lit(0)).cast("bigint"),
    }


def _carry(entries: DataFrame, hot_rows: DataFrame, count: int, opts: FeatureOptions, groups: tuple[str, ...]) -> DataFrame:
    """The state of a split user at the head of each slice, from per-slice totals."""
    by_user = Window.partitionBy("user_id").orderBy("slice")
    upto = by_user.rowsBetween(Window.unboundedPreceding, 0)
    before = by_user.rowsBetween(Window.unboundedPreceding, -1)
    is_tx = F.col("kind") == TX
    deltas = [c for c in ("in_short", "in_long", "in_merchants", "in_countries") if c in entries.columns]
    sums = {d: F.sum(d) for d in deltas}
    sums |= {f"{d}_{part}": F.sum(_signed(d, part)) for d in deltas if d in ("in_short", "in_long") for part in ("exact", "big")}
    parts = entries
    own = {}
    if "moments" in groups:
        own = _moments()
        parts = parts.withColumns({"label": F.col("body.label"), "amount": F.col("body.amount")})
    totals = parts.groupBy("user_id", "slice").agg(
        F.min(F.when(is_tx, F.col("at"))).alias("lo"), F.max(F.when(is_tx, F.col("at"))).alias("hi"),
        *[v.alias(k) for k, v in sums.items()],
        *[F.sum(F.when(is_tx, v)).alias(f"m_{k}") for k, v in own.items()],
    )
    state = dealt(totals, ["user_id"], count, opts.task_rows).withColumn("prev_hi", F.last("hi", ignorenulls=True).over(before))

    def starts(ttl: int) -> Column:
        return F.col("lo").isNotNull() & (F.col("prev_hi").isNull() | (F.col("lo") - F.col("prev_hi") > ttl * US))

    ttls = {}
    if "distinct" in groups and opts.distinct_mode != "sliding":
        ttls = {"merchant": opts.merchant_ttl_s, "country": opts.country_ttl_s}
    for m, ttl in ttls.items():
        state = state.withColumn(f"since_{m}", F.last(F.when(starts(ttl), F.col("lo")), ignorenulls=True).over(upto))
    for m, ttl in ttls.items():
        member = _members(opts, groups)[m]
        w = Window.partitionBy("user_id", *member).orderBy("slice")
        spans = hot_rows.groupBy("user_id", "slice", *member).agg(F.max("ts_us").alias("span_hi"))
        new = (
            spans.withColumn("earlier", F.lag("span_hi").over(w))
            .join(state.select("user_id", "slice", f"since_{m}"), ["user_id", "slice"])
            .filter(F.col("earlier").isNull() | (F.col("earlier") < F.col(f"since_{m}")))
            .groupBy("user_id", "slice").agg(F.count("*").alias(f"new_{m}"))
        )
        state = state.join(new, ["user_id", "slice"], "left").na.fill(0, [f"new_{m}"])

    state = dealt(state, ["user_id"], count, opts.task_rows)
    running = {f"{k}_all": F.sum(k).over(upto) for k in [f"m_{n}" for n in own] + [f"new_{m}" for m in ttls]}
    state = state.withColumns(running)
    ends = {}
    for cols, ttl in [([f"m_{n}" for n in own], opts.moments_ttl_s)] + [([f"new_{m}"], t) for m, t in ttls.items()]:
        for c in cols:
            base = F.last(F.when(starts(ttl), F.col(f"{c}_all") - F.col(c)), ignorenulls=True).over(upto)
            ends[f"{c}_end"] = F.col(f"{c}_all") - F.coalesce(base, F.lit(0))
    state = state.withColumns(ends)
    return state.select(
        "user_id", "slice", F.lit(CARRY).alias("kind"), F.col("prev_hi").alias("at"),
        *[F.sum(k).over(before).alias(k) for k in sums],
        *[F.lag(f"m_{n}_end").over(by_user).alias(f"m_{n}") for n in own],
        *[F.lag(f"new_{m}_end").over(by_user).alias(f"seen_{m}") for m in ttls],
        *[F.lag(f"since_{m}").over(by_user).alias(f"since_{m}_carry") for m in ttls],
    ).filter("at is not null")
