"""The history features of a stream: one state per user, one output row per transaction, worked out on columns.

The state keeps what the batch operators derive from a user's past: totals per time bucket with the rows of each bucket, the
time of each transaction that may be replayed, the members seen since the last idle gap, and the running moments. The rows of
a user in a micro-batch are answered together: what the state adds to a window comes from bucket totals and the two buckets at
its edges, what the micro-batch adds from prefix sums over its own rows.

A row sees the rows of its window that are less than the retention older than the user's latest row so
far. That depends on the rows alone; when the state drops older ones, and how rows are cut into micro-batches, changes no result.
"""

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txrisk.operators.history import MOMENTS_EXACT, WINDOW_EXACT
from txrisk.options import US, FeatureOptions

HISTORY_FIELDS = [
    T.StructField("tx_count_1h", T.IntegerType()),
    T.StructField("tx_count_24h", T.IntegerType()),
    T.StructField("tx_sum_1h", T.DoubleType()),
    T.StructField("tx_sum_24h", T.DoubleType()),
    T.StructField("unique_merchants_24h", T.IntegerType()),
    T.StructField("unique_countries_7d", T.IntegerType()),
    T.StructField("prior_count", T.LongType()),
    T.StructField("prior_sum", T.DoubleType()),
    T.StructField("prior_sumsq", T.DoubleType()),
    T.StructField("prior_fraud", T.LongType()),
]

LONGS, DOUBLES, TEXTS = (T.ArrayType(t) for t in (T.LongType(), T.DoubleType(), T.StringType()))
USER_STATE = T.StructType([
    T.StructField("last_us", T.LongType()),
    T.StructField("count", T.LongType()),
    T.StructField("sum", T.StringType()),
    T.StructField("sumsq", T.StringType()),
    T.StructField("bigsum", T.DoubleType()),
    T.StructField("bigsq", T.DoubleType()),
    T.StructField("fraud", T.LongType()),
    T.StructField("merchants", T.LongType()),
    T.StructField("countries", T.LongType()),
    T.StructField("buckets", LONGS),
    T.StructField("bucket_rows", LONGS),
    T.StructField("bucket_exact", TEXTS),
    T.StructField("bucket_big", DOUBLES),
    T.StructField("bits", LONGS),
    T.StructField("expires_ms", T.LongType()),
])
KEY = T.StructType([T.StructField("key", T.LongType())])
#: Columns of numbers, one after the other, as bytes.
COLUMNS = T.StructType([T.StructField("columns", T.BinaryType())])

# Exact sums are whole numbers of 10^-16.
SCALE = 16
ONE = 10 ** SCALE
#: Entries of a part of a hashed map before the map is cut finer.
PART_ENTRIES = 512
#: Rows of a user that are kept as one entry; more are kept by bucket, then and from there on.
TOGETHER = 512
_ALL = (-1,)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def window_parts(amount: float) -> tuple[int, float]:
    """An amount as the batch operators add it up: an exact part and one that only a double holds."""
    if abs(amount) >= WINDOW_EXACT:
        return 0, amount
    return int(Decimal(repr(amount)).scaleb(SCALE).to_integral_value(ROUND_HALF_UP)), 0.0


def moment_parts(amount: float) -> tuple[int, float]:
    """The same for the moments, in millionths."""
    if abs(amount) >= MOMENTS_EXACT:
        return 0, amount
    return int(Decimal(repr(amount * US)).to_integral_value(ROUND_HALF_UP)), 0.0


def _hashes(values: pd.Series) -> np.ndarray:
    return pd.util.hash_array(values.fillna("\x00").to_numpy(dtype=object), categorize=False)


def _firsts(groups: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its (group, code)."""
    order = np.lexsort((np.arange(len(codes)), codes, groups))
    new = np.ones(len(codes), bool)
    new[1:] = (groups[order][1:] != groups[order][:-1]) | (codes[order][1:] != codes[order][:-1])
    out = np.zeros(len(codes), bool)
    out[order] = new
    return out


def _prefix(parts: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the exact parts, of any size, and of the others, before each place and after the last."""
    exact = np.zeros(len(parts) + 1, object)
    exact[1:] = list(accumulate(p[0] for p in parts))
    return exact, np.concatenate(([0.0], np.cumsum([p[1] for p in parts]))) if parts else np.zeros(1)


class _Sums:
    """Counts and sums of entries (time, weight, parts) that take effect in turn, over ranges of time."""

    def __init__(self, ts: np.ndarray, weights: np.ndarray, parts: list[tuple[int, float]]):
        self.ts, self.weights, self.parts = ts, weights, parts
        self.in_time = bool((np.diff(ts) >= 0).all() and (weights > 0).all())

    def between(self, upto: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Over the first `upto` entries with a time in [lo, hi]: their count, exact sum and other sum."""
        if self.in_time:
            exact, big = _prefix(self.parts)
            a, b = np.searchsorted(self.ts, lo, "left"), np.minimum(np.searchsorted(self.ts, hi, "right"), upto)
            a = np.minimum(a, b)
            return b - a, exact[b] - exact[a], big[b] - big[a]
        # the first `upto` entries are runs of 1, 2, 4, ... of them, each in time order
        distinct, rank = np.unique(self.ts, return_inverse=True)
        low, high = np.searchsorted(distinct, lo, "left"), np.searchsorted(distinct, hi, "right")
        span = len(distinct) + 1
        count, exact, big = np.zeros(len(upto), np.int64), np.zeros(len(upto), object), np.zeros(len(upto))
        place = np.arange(len(self.ts))
        for level in range(int(len(self.ts)).bit_length()):
            at = np.flatnonzero((upto >> level) & 1)
            if not len(at):
                continue
            key = (place >> level) * span + rank
            order = np.argsort(key, kind="stable")
            key = key[order]
            run = ((upto[at] >> (level + 1)) * 2) * span
            a, b = np.searchsorted(key, run + low[at], "left"), np.searchsorted(key, run + high[at], "left")
            b = np.maximum(a, b)
            weights = np.concatenate(([0], np.cumsum(self.weights[order])))
            e, g = _prefix([(self.parts[i][0] * int(self.weights[i]), self.parts[i][1] * float(self.weights[i])) for i in order])
            count[at] += weights[b] - weights[a]
            exact[at] += e[b] - e[a]
            big[at] += g[b] - g[a]
        return count, exact, big


class _HashedMap:
    """A map from 64-bit hashes to numbers, in parts by the hashes' first bits; a part is read and written as a whole.

    Only the parts that a call touches are read. `bits` grows with the map, so that parts stay small.
    """

    def __init__(self, state, bits: int | None):
        self.state, self.bits, self.fresh = state, bits or 0, bits is None
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.changed: set[int] = set()
        self.cleared = False

    def _part_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def _load(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        if part not in self.parts:
            stored = None if self.fresh else self.state.getValue((part,)) if self.state.containsKey((part,)) else None
            both = np.frombuffer(stored[0] if stored else b"", np.int64).reshape(2, -1)
            self.parts[part] = (both[0].view(np.uint64), both[1])
        return self.parts[part]

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its value) of each hash."""
        there, value = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        part = self._part_of(hashes)
        for p in np.unique(part):
            keys, values = self._load(int(p))
            own = np.flatnonzero(part == p)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes[own]), len(keys) - 1)
                there[own], value[own] = keys[at] == hashes[own], values[at]
        return there, value

    def put(self, hashes: np.ndarray, values: np.ndarray, keep_from: int | None = None) -> None:
        """Set values, the last one of equal hashes; in the parts it touches, values below `keep_from` go."""
        part = self._part_of(hashes)
        for p in np.unique(part):
            keys, old = self._load(int(p))
            own = part == p
            both, new = np.concatenate((keys, hashes[own])), np.concatenate((old, values[own]))
            distinct, last = np.unique(both[::-1], return_index=True)
            kept = new[::-1][last]
            if keep_from is not None:
                distinct, kept = distinct[kept >= keep_from], kept[kept >= keep_from]
            self.parts[int(p)] = (distinct, kept)
            self.changed.add(int(p))

    def clear(self) -> None:
        self.parts, self.changed = {}, set()
        self.cleared = self.cleared or not self.fresh
        self.fresh, self.bits = True, 0

    def flush(self) -> int:
        """Write what changed; returns the bits to keep."""
        if self.cleared:
            self.state.clear()
        largest = max((len(self.parts[p][0]) for p in self.changed), default=0)
        if largest > PART_ENTRIES:
            for p in range(1 << self.bits):
                self._load(p)
            keys, values = (np.concatenate([part[i] for part in self.parts.values()]) for i in (0, 1))
            if not self.fresh:
                self.state.clear()
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            self.bits = max(self.bits + 1, int(2 * len(keys) // PART_ENTRIES).bit_length())
            part = self._part_of(keys)
            self.parts = {int(p): (keys[part == p], values[part == p]) for p in np.unique(part)}
            self.changed = set(self.parts)
        for p in self.changed:
            keys, values = self.parts[p]
            self.state.updateValue((p,), (keys.tobytes() + values.tobytes(),))
        return self.bits


class HistoryProcessor(StatefulProcessor):
    """Rows of a user are taken in the order of `order`; a row sees the state before it and itself."""

    def __init__(self, opts: FeatureOptions, payload: list[str], order: list[str], bucket_s: int,
                 retention_s: int, idle_s: int | None):
        self.opts, self.payload, self.order = opts, payload, order
        self.bucket_us, self.retention_us = bucket_s * US, retention_s * US
        self.idle_ms = None if idle_s is None else idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.user = handle.getValueState("user", USER_STATE)
        self.rows = handle.getMapState("rows", KEY, COLUMNS)
        self.members = handle.getMapState("members", KEY, COLUMNS)
        self.merchants = handle.getMapState("merchants", KEY, COLUMNS)
        self.countries = handle.getMapState("countries", KEY, COLUMNS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Past transactions of a user, from a table: they only leave their state."""
        self._take(initialState, timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [part for part in rows if len(part)]
        if parts:
            yield self._take(parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A user who stayed away is forgotten."""
        for state in (self.user, self.rows, self.members, self.merchants, self.countries):
            state.clear()
        return iter([])

    def _take(self, rows: pd.DataFrame, timerValues) -> pd.DataFrame:
        """The history columns of a user's rows, and the state after them. The rows of one user in one micro-batch meet here;
        their number is bounded by the trigger's limit."""
        opts = self.opts
        known = self.user.get()
        last0, n0, s0, ss0, g0, gg0, f0, n_merchants, n_countries, expires = (
            (None, 0, 0, 0, 0.0, 0.0, 0, 0, 0, None) if known is None else
            (known[0], known[1], int(known[2]), int(known[3]), *known[4:9], known[14]))
        totals = {} if known is None else {b: (c, int(e), g) for b, c, e, g in zip(*known[9:13])}
        bits = (None, None, None) if known is None else known[13]
        # a state of three numbers keeps its rows by bucket
        together = known is None or (len(bits) > 3 and bits[3] == 0)
        members, merchants, countries = (_HashedMap(state, b) for state, b in zip((self.members, self.merchants, self.countries), bits))
        buckets = self._together(totals) if together else {}

        rows = self._sorted(rows)
        ts, amount = rows["ts_us"].to_numpy(np.int64), rows["amount"].to_numpy(np.float64)
        n = len(ts)
        parts = [window_parts(a) for a in amount.tolist()]
        upto_now = np.maximum.accumulate(ts if last0 is None else np.maximum(ts, last0))
        before = np.concatenate(([ts[0] if last0 is None else last0], upto_now[:-1]))
        gap = ts - before
        last = int(upto_now[-1])

        # a replay takes the place of the same transaction's earlier row, be it here or in the state
        member = _hashes(rows["transaction_id"]) * _ODD + pd.util.hash_array(amount.view(np.uint64), categorize=False)
        order = np.argsort(member, kind="stable")
        same = np.concatenate(([False], member[order][1:] == member[order][:-1])) if n else np.zeros(0, bool)
        old = np.full(n, -1)
        old[order[same]] = order[np.flatnonzero(same) - 1]
        there, old_ts = members.get(member)
        from_state = there & (old < 0) & np.isin(old_ts // self.bucket_us, np.array(sorted(totals), np.int64))
        gone_ts = np.where(old >= 0, ts[old], old_ts)
        replaced = np.flatnonzero((old >= 0) | from_state)
        turn = np.concatenate((replaced * 2, np.arange(n) * 2 + 1))
        in_turn = np.argsort(turn, kind="stable")
        entries = _Sums(np.concatenate((gone_ts[replaced], ts))[in_turn], np.concatenate((np.full(len(replaced), -1), np.ones(n, np.int64)))[in_turn],
                        [parts[i] for i in np.concatenate((replaced, np.arange(n)))[in_turn]])
        upto = np.searchsorted(turn[in_turn], np.arange(n) * 2 + 1, "right")
        oldest = upto_now - self.retention_us + 1
        out = {}
        state_upto = self._state_upto(buckets, totals, ts, True)
        for name, window in (("1h", opts.short_window_s), ("24h", opts.long_window_s)):
            lo = np.maximum(ts - window * US, oldest)
            count, exact, big = entries.between(upto, lo, ts)
            if totals:
                below = self._state_upto(buckets, totals, lo, False)
                late = lo > ts
                for i, own in enumerate((count, exact, big)):
                    own += np.where(late, 0, state_upto[i] - below[i])
            out[f"tx_count_{name}"] = count
            out[f"tx_sum_{name}"] = [int(e) / ONE + g for e, g in zip(exact, big.tolist())]
        out["unique_merchants_24h"], n_merchants = self._distinct(merchants, n_merchants, _hashes(rows["merchant_id"]), gap, opts.merchant_ttl_s)
        out["unique_countries_7d"], n_countries = self._distinct(countries, n_countries, _hashes(rows["country"]), gap, opts.country_ttl_s)
        moments, after = self._moments(rows, gap, (n0, s0, ss0, g0, gg0, f0))
        out |= moments

        together = self._keep_rows(buckets, totals, ts, amount, member, parts, old, from_state, old_ts, last, together)
        members.put(member, ts, keep_from=last - self.retention_us - self.bucket_us)
        kept_bits = [m.flush() for m in (members, merchants, countries)] + [0 if together else 1]
        if self.idle_ms is not None:
            if expires is not None:
                self.handle.deleteTimer(expires)
            expires = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(expires)
        held = sorted(totals)
        n1, s1, ss1, g1, gg1, f1 = after
        self.user.update((last, n1, str(s1), str(ss1), g1, gg1, f1, n_merchants, n_countries, held, [totals[b][0] for b in held],
                          [str(totals[b][1]) for b in held], [totals[b][2] for b in held], kept_bits, expires))
        return pd.DataFrame({**{c: rows[c] for c in self.payload}, **{f.name: out[f.name] for f in HISTORY_FIELDS}})

    def _sorted(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The rows by `order`; where its first column is enough, numbers without ties, the others are not looked at."""
        first = rows[self.order[0]]
        if first.dtype == np.int64:
            place = np.argsort(first.to_numpy(), kind="stable")
            if (np.diff(first.to_numpy()[place]) > 0).all():
                return rows.take(place).reset_index(drop=True)
        return rows.sort_values(self.order, kind="stable", ignore_index=True)

    def _together(self, totals: dict) -> dict[int, np.ndarray]:
        """The buckets of a user whose rows are kept as one entry."""
        stored = self.rows.getValue(_ALL) if totals else None
        every = np.frombuffer(stored[0] if stored else b"", np.int64).reshape(3, -1)
        own = every[0] // self.bucket_us
        return {b: every[:, own == b] for b in totals}

    def _bucket(self, buckets: dict[int, np.ndarray], totals: dict, b: int) -> np.ndarray:
        """(times, amounts, hashes) of a bucket's rows in time order, as three rows of 64-bit words."""
        if b not in buckets:
            stored = self.rows.getValue((b,)) if b in totals else None
            buckets[b] = np.frombuffer(stored[0] if stored else b"", np.int64).reshape(3, -1)
        return buckets[b]

    def _state_upto(self, buckets, totals, at: np.ndarray, inclusive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count and sums of the state's rows up to each time: the buckets before its own, and the rows of its own."""
        held = sorted(totals)
        ids = np.array(held, np.int64)
        exact, big = _prefix([totals[b][1:] for b in held])
        count = np.concatenate(([0], np.cumsum([totals[b][0] for b in held]))).astype(np.int64)
        own = at // self.bucket_us
        place = np.searchsorted(ids, own)
        out = [count[place], exact[place], big[place]]
        for b in np.unique(own):
            if b in totals:
                times, amounts, _ = self._bucket(buckets, totals, int(b))
                e, g = _prefix([window_parts(a) for a in amounts.view(np.float64).tolist()])
                mine = np.flatnonzero(own == b)
                k = np.searchsorted(times, at[mine], "right" if inclusive else "left")
                out[0][mine] += k
                out[1][mine] += e[k]
                out[2][mine] += g[k]
        return tuple(out)

    def _distinct(self, known: _HashedMap, count: int, codes: np.ndarray, gap: np.ndarray, ttl_s: int) -> tuple[np.ndarray, int]:
        """How many members were seen since the last gap of more than `ttl_s`, the row's own included."""
        session = np.cumsum(gap > ttl_s * US)
        new = _firsts(session, codes)
        if count and session[0] == 0:
            there, _ = known.get(codes[session == 0])
            new[session == 0] &= ~there
        seen = np.cumsum(new)
        starts = np.concatenate(([0], seen))[np.searchsorted(session, session, "left")]
        out = seen - starts + np.where(session == 0, count, 0)
        if session[-1] > 0:
            known.clear()
        fresh = codes[new & (session == session[-1])]
        if len(fresh):
            known.put(fresh, np.ones(len(fresh), np.int64))
        return out, int(out[-1])

    def _moments(self, rows: pd.DataFrame, gap: np.ndarray, start: tuple) -> tuple[dict, tuple]:
        """Count, sums and frauds of the rows before each one since the last long gap, and those after the last row."""
        parts = [moment_parts(a) for a in rows["amount"].tolist()]
        label = rows["label"].fillna(0).astype(np.int64).tolist()
        out = {"prior_count": [], "prior_sum": [], "prior_sumsq": [], "prior_fraud": []}
        n, s, ss, g, gg, f = start
        for (units, big), y, idle in zip(parts, label, (gap > self.opts.moments_ttl_s * US).tolist()):
            if idle:
                n, s, ss, g, gg, f = 0, 0, 0, 0.0, 0.0, 0
            out["prior_count"].append(n)
            out["prior_sum"].append(float(s) / US + g)
            out["prior_sumsq"].append(float(ss) / (float(US) * US) + gg)
            out["prior_fraud"].append(f)
            n, s, ss, g, gg, f = n + 1, s + units, ss + units * units, g + big, gg + big * big, f + y
        return out, (n, s, ss, g, gg, f)

    def _keep_rows(self, buckets, totals, ts, amount, member, parts, old, from_state, old_ts, last: int, together: bool) -> bool:
        """Put the rows into their buckets, take replaced ones out, and drop the buckets beyond the retention; returns
        whether the rows are kept as one entry."""
        before = last - self.retention_us
        replaced_here = np.zeros(len(ts), bool)
        replaced_here[old[old >= 0]] = True
        changed = set()
        for i in np.flatnonzero(from_state):
            b = int(old_ts[i]) // self.bucket_us
            rows = self._bucket(buckets, totals, b)
            at = np.flatnonzero((rows[0] == old_ts[i]) & (rows[2].view(np.uint64) == member[i]))[:1]
            if len(at):
                buckets[b] = np.delete(rows, at, axis=1)
                c, e, g = totals[b]
                totals[b] = (c - 1, e - parts[i][0], g - parts[i][1])
                changed.add(b)
        own = ts // self.bucket_us
        for b in np.unique(own[~replaced_here]).tolist():
            if (b + 1) * self.bucket_us <= before:
                continue
            new = np.flatnonzero((own == b) & ~replaced_here)
            both = np.concatenate((self._bucket(buckets, totals, b), np.stack((ts[new], amount[new].view(np.int64), member[new].view(np.int64)))), axis=1)
            buckets[b] = both[:, np.argsort(both[0], kind="stable")]
            c, e, g = totals.get(b, (0, 0, 0.0))
            totals[b] = (c + len(new), e + sum(parts[i][0] for i in new), g + sum(parts[i][1] for i in new))
            changed.add(b)
        for b in [b for b in totals if (b + 1) * self.bucket_us <= before]:
            if not together and self.rows.containsKey((b,)):
                self.rows.removeKey((b,))
            del totals[b]
            changed.discard(b)
        if together:
            if sum(c for c, _, _ in totals.values()) <= TOGETHER:
                every = [buckets[b] for b in totals]
                self.rows.updateValue(_ALL, (np.concatenate(every, axis=1).tobytes() if every else b"",))
                return True
            if self.rows.containsKey(_ALL):
                self.rows.removeKey(_ALL)
            changed = set(totals)
        for b in changed:
            self.rows.updateValue((b,), (buckets[b].tobytes(),))
        return False

    def close(self) -> None:
        pass


def history_stream(tx: DataFrame, opts: FeatureOptions = FeatureOptions(), order: tuple[str, ...] = ("ts_us", "transaction_id"),
                   bucket_s: int = 3600, retention_s: int = 7 * 86400, idle_s: int | None = 30 * 86400,
                   past: DataFrame | None = None) -> DataFrame:
    """The columns of `history_features` on a stream; needs the RocksDB state store.

    `order` sorts a user's rows within a micro-batch: by time, or by ("offset",) for the order
    of arrival, as a user's messages share a partition. No row is dropped for being late; its window holds what is
    less than `retention_s` older than the user's latest row. A user without rows for `idle_s` of processing time is
    forgotten; None keeps all users. `past`, a table with the same columns, is taken into the state of a new query first.
    """
    payload = tx.columns
    schema = T.StructType([tx.schema[c] for c in payload] + HISTORY_FIELDS)
    return tx.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=HistoryProcessor(opts, payload, list(order), bucket_s, retention_s, idle_s),
        outputStructType=schema, outputMode="Append", timeMode="none" if idle_s is None else "ProcessingTime",
        initialState=None if past is None else past.select(*payload).groupBy("user_id"))
