"""Readings that cannot be genuine: spikes, stuck values, impossible values.

Per source one isolation forest scores every reading on level, difference,
wick, seasonal and run-length features, all in units of the source's own usual
movement; explicit physical limits apply beside it. A reading whose score reaches
``ODD`` is found, if the exact check that follows holds: a close or volume stands
above (or below) what comes before and what comes after, a stretch is longer
than the source's usual ones, and a reading is not the first of its stretch.

The forest is the source's, also where the source is cut into shards: what is
usual is counted over all shards, and a sample of POOL readings (the lowest by a
hash of ``ingest_seq`` over all shards) is what it is fitted on. Every shard
fits the same forest from them and scores its own readings.

Defined cases: rows without symbol or timestamp have no place in a source's
history and are judged by the physical limits only; null and NaN values are missing and
never a fault; volume 0 is an untraded bar; deliveries repeated unchanged get
the same verdict, and deliveries of the same time with other values are held
against the same neighbours; an empty table gives an empty result; columns
beyond those needed are ignored.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.forest import cleaned
from barlake.operators.timeshards import with_shards

#: The forest score from which a reading is odd, and from which one is left out of what the forest is fitted on.
ODD, DOUBTFUL = 0.72, 0.6
#: Readings of a source that its forest is fitted on.
POOL = 512
#: Features: level and difference of closes that are left again, wick, volume over both sides and, where it is left again, over its hour's, runs of closes and volumes; and the groups trees are made for.
GROUPS = ((0, 1), (2,), (3, 4), (5, 6))
WIDTH = 7
#: A stretch's feature rises by this for each reading beyond the source's longest usual stretch; volumes, whose tails are short, count by so many units for each spread.
RUN_UNIT, VOLUME_UNIT = 12.0, 1.6
#: No source's log volumes are taken to vary less than this.
CALM_VOLUME = 0.4
#: A price that differs from both sides by this factor is taken out before its neighbours are compared.
FAR = np.log(3.0)
#: No stretch of up to so many equal readings is ever called stuck.
SHORT_RUN = 5
#: Run lengths of a source end where so many times their scale lies empty: chance leaves such a gap in about one sticky source of 100.
GAP = 5.0
#: Stretches that hold more of a source's readings than this, and are more than FEW_RUNS, are its habit. Scales are taken from at least BACKED runs.
HABIT, FEW_RUNS, BACKED = 0.25, 3, 10
#: Readings on each side that a shard needs: the widest window is 31, the longest tested run 2 * 24.
HALO = 64
AROUND, BESIDE, WIDEST = 31, 7, 3
#: How much of the distance from the medians of both sides counts as height, which finds faults side by side that point both ways; ordinary closes wander further from those medians than from their neighbours.
OVER_SIDES = 0.75

#: Statistics of a source that is cut come from histograms of its shards, with bins of this width in logarithms.
BIN = 0.01
STEPS, CLOSE_RUNS, VOLUME_RUNS, HOURS = 0, 1, 2, 3

FIELDS = ["ingest_seq", "symbol", "timestamp", "open", "high", "low", "close", "volume"]
VERDICT = "ingest_seq long, symbol string, score double, impossible boolean, spike boolean, stuck boolean"


def impossible() -> Column:
    """A value beyond physical limits or an impossible order of values; missing values break no rule."""
    num = {c: F.when(~F.isnan(c), F.col(c)) for c in ("open", "high", "low", "close", "volume")}
    o, h, l, c, v = (num[k] for k in ("open", "high", "low", "close", "volume"))
    inf = float("inf")
    rules = [x <= 0 for x in (o, h, l, c)] + [v < 0, h < l, c > h, c < l, o > h, o < l] + [x == inf for x in (h, l, c, v)]
    return F.coalesce(F.greatest(*[F.coalesce(r, F.lit(False)) for r in rules]), F.lit(False))


def _median(windows: np.ndarray) -> np.ndarray:
    """Row medians that skip NaN; rows of NaN only give NaN."""
    ordered = np.sort(windows, axis=1)
    n = np.sum(~np.isnan(ordered), axis=1)
    at, last = np.arange(len(ordered)), windows.shape[1] - 1
    mid = 0.5 * (ordered[at, np.maximum(n - 1, 0) // 2] + ordered[at, np.minimum(n // 2, last)])
    return np.where(n > 0, mid, np.nan)


def _beside(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` values before and the ``k`` after each place."""
    pad = np.concatenate([np.full(k, np.nan), x, np.full(k, np.nan)])
    w = np.lib.stride_tricks.sliding_window_view(pad, k)
    return w[: len(x)], w[k + 1 : k + 1 + len(x)]


def _moves(x: np.ndarray) -> tuple[float, np.ndarray]:
    """Usual absolute step, over all and around each place (0 where there is none)."""
    if len(x) < 2:
        return 1e-5, np.zeros(len(x))
    step = np.abs(np.diff(x, prepend=np.nan))
    half = AROUND // 2
    w = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(half, np.nan), step, np.full(half, np.nan)]), AROUND)
    return max(float(np.nanmedian(step)), 1e-5), np.nan_to_num(_median(w))


def _bumps(x: np.ndarray) -> np.ndarray:
    """Height above (or depth below) both neighbours of the best group of up to WIDEST places, 0 if none is left again."""
    n = len(x)
    best = np.zeros(n)
    for width in range(1, WIDEST + 1):
        if n < width + 2:
            break
        w = np.lib.stride_tricks.sliding_window_view(x, width + 2)
        before, after, inside = w[:, 0], w[:, -1], w[:, 1:-1]
        rise = np.minimum(inside.min(axis=1) - before, inside.min(axis=1) - after)
        fall = np.minimum(before - inside.max(axis=1), after - inside.max(axis=1))
        size = np.maximum(rise, fall)
        size = np.where(np.abs(before - after) < 0.5 * size, size, 0.0)
        for k in range(width):
            part = best[1 + k : 1 + k + len(size)]
            np.maximum(part, size, out=part)
    return best


def _usual_run(length: np.ndarray, many: np.ndarray) -> int:
    """The longest run that a source usually has, from how ``many`` of its runs have each ``length`` (ascending).

    The body of the lengths ends at the first gap wider than GAP times their
    scale, the scale being that of lengths without memory (of all runs, and of
    the longer ones alone, as sources have quiet times). However many stretches
    lie beyond, they do not move it, unless they hold more than HABIT of the readings.
    """
    if not len(length):
        return 1
    runs, rows = np.cumsum(many), np.cumsum(many * length)
    scale = np.zeros(len(length))
    for least in (0, 1, SHORT_RUN):
        beyond = np.maximum(length - least, 0)
        n = np.maximum(np.cumsum(np.where(beyond > 0, many, 0)), 1)
        mean, square = np.cumsum(many * beyond) / n, np.cumsum(many * beyond**2) / n
        backed = (mean > 1) & ((n >= BACKED) | (least == 0))
        own = 1 / np.log(mean[backed] / (mean[backed] - 1))
        if least:  # a habit of much the same length is no long tail
            own = np.minimum(own, np.sqrt(np.maximum(square - mean**2, 0.0))[backed])
        scale[backed] = np.maximum(scale[backed], own)
    gap = np.diff(length) > GAP * scale[:-1]
    few = (runs[-1] - runs[:-1] <= FEW_RUNS) | (rows[-1] - rows[:-1] <= HABIT * rows[-1])
    end = np.flatnonzero(gap & few & (length[1:] > SHORT_RUN))
    return int(length[end[0] if len(end) else -1])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Length of each place's run of equal values, whether it is the run's first, and the longest run usual here."""
    if not len(x):
        return np.zeros(0, int), np.zeros(0, bool), 1
    first = np.concatenate([[True], x[1:] != x[:-1]])
    size = np.diff(np.append(np.flatnonzero(first), len(x)))
    return np.repeat(size, size), first, _usual_run(*np.unique(size, return_counts=True))


def _two_sided(x: np.ndarray) -> np.ndarray:
    """Distance in the same direction from the medians of both sides."""
    left, right = (_median(w) for w in _beside(x, BESIDE))
    left, right = np.where(np.isnan(left), right, left), np.where(np.isnan(right), left, right)
    return np.nan_to_num(np.maximum(np.minimum(x - left, x - right), np.minimum(left - x, right - x)))


def _two_sided_at(x: np.ndarray, places: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``_two_sided`` of values ``y`` that stand at ``at`` instead of what ``x`` has there; ``places``: where ``x`` counts."""
    pad = np.concatenate([np.full(BESIDE, np.nan), x[places], np.full(BESIDE, np.nan)])
    i, j = np.searchsorted(places, at), np.searchsorted(places, at, side="right")
    k = np.arange(BESIDE)
    left, right = _median(pad[i[:, None] + k]), _median(pad[j[:, None] + BESIDE + k])
    left, right = np.where(np.isnan(left), right, left), np.where(np.isnan(right), left, right)
    return np.nan_to_num(np.maximum(np.minimum(y - left, y - right), np.minimum(left - y, right - y)))


def _runs_at(x: np.ndarray, places: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many readings equal to ``y`` stand directly before and after ``at``; ``places``: where ``x`` counts."""
    z = x[places]
    size, first, _ = _runs(z)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(z)), 0))
    i, j = np.searchsorted(places, at), np.searchsorted(places, at, side="right")
    p, q = np.maximum(i - 1, 0), np.minimum(j, len(z) - 1)
    before = np.where((i > 0) & (z[p] == y), p - begin[p] + 1, 0)
    after = np.where((j < len(z)) & (z[q] == y), begin[q] + size[q] - q, 0)
    return before, after


@dataclass
class Usual:
    """What is usual for a source: step of log closes, longest runs of closes and volumes, spread and hour medians of log volumes."""

    step: float
    runs: tuple[float, float]
    spread: float
    hours: np.ndarray

    def flat(self) -> list[float]:
        return [self.step, *map(float, self.runs), self.spread, *map(float, self.hours)]

    @classmethod
    def of(cls, flat) -> Usual:
        return cls(flat[0], (flat[1], flat[2]), flat[3], np.asarray(flat[4:]))


@dataclass
class Raw:
    """Readings before they are put into their source's units; all arrays are aligned.

    ``level`` and ``bump``: distance of the log close from its surroundings and
    height over both neighbours; ``apart``: distance of a close that is far from
    both sides, else 0; ``local``: usual step around; ``wick``; ``beside``: height of
    the log volume over both sides; ``log_volume`` (NaN: untraded); ``hour``; ``held``:
    lengths of the runs of closes and volumes; ``later``: whether a reading is not its run's first.
    """

    level: np.ndarray
    bump: np.ndarray
    apart: np.ndarray
    local: np.ndarray
    wick: np.ndarray
    beside: np.ndarray
    log_volume: np.ndarray
    hour: np.ndarray
    held: tuple[np.ndarray, np.ndarray]
    later: tuple[np.ndarray, np.ndarray]

    def take(self, at: np.ndarray) -> Raw:
        return Raw(*[x[at] for x in (self.level, self.bump, self.apart, self.local, self.wick, self.beside, self.log_volume, self.hour)], *[tuple(x[at] for x in p) for p in (self.held, self.later)])

    def flat(self) -> np.ndarray:
        return np.column_stack([self.level, self.bump, self.apart, self.local, self.wick, self.beside, self.log_volume, self.hour, *self.held, *self.later])

    @classmethod
    def of(cls, flat: np.ndarray) -> Raw:
        c = flat.T
        return cls(*c[:7], c[7].astype(int), (c[8], c[9]), (c[10] > 0, c[11] > 0))

    def stuck(self, usual: Usual) -> np.ndarray:
        """Readings after the first of a stretch longer than any the source usually has."""
        return np.logical_or.reduce([(held > max(SHORT_RUN, most)) & later for held, later, most in zip(self.held, self.later, usual.runs)])

    def points(self, usual: Usual) -> np.ndarray:
        """The features, in units of what is usual."""
        here = np.maximum(usual.step, self.local)
        far = self.apart > 0
        jump = np.where(far, np.maximum(self.bump / here, self.apart / usual.step), self.bump / here)
        level = np.where(far, jump, np.minimum(self.level / here, jump))
        burst = self.beside / usual.spread
        season = np.minimum(np.nan_to_num((self.log_volume - usual.hours[self.hour]) / usual.spread), burst)
        runs = []
        for held, most in zip(self.held, usual.runs):
            most = max(SHORT_RUN, most)
            runs.append(np.where(held > most, 1 + RUN_UNIT * (held - most), held / most))
        volumes = [VOLUME_UNIT * x for x in (burst, season)]
        return np.column_stack([level, jump, self.wick / here, *volumes, *runs]).clip(-1e3, 1e3)


def measure(us: np.ndarray, o: np.ndarray, h: np.ndarray, l: np.ndarray, c: np.ndarray, v: np.ndarray, bad: np.ndarray) -> tuple[Raw, Usual, np.ndarray]:
    """One source's readings, given in order of time and delivery, measured; what is usual among them; the places of first deliveries.

    ``bad``: impossible by themselves; they are no neighbours to others.
    """
    n = len(us)
    head = np.concatenate([[True], us[1:] != us[:-1]])
    of = np.cumsum(head) - 1
    rep = np.flatnonzero(head)
    with np.errstate(all="ignore"):
        lo, lh, ll, lc, lv = (np.where(x > 0, np.log(np.where(x > 0, x, 1.0)), np.nan) for x in (o, h, l, c, v))
    R = len(rep)
    bump, apart, level, local = np.zeros(R), np.zeros(R), np.zeros(R), np.zeros(R)

    # Closes that trade and are not impossible; those far from both sides leave before the neighbours are compared.
    cr, vr = lc[rep], v[rep]
    seen = np.flatnonzero(~np.isnan(cr) & ~(vr == 0) & ~bad[rep])
    away = _two_sided(cr[seen])
    gone = away > FAR
    apart[seen[gone]] = away[gone]
    calm = seen[~gone]
    step, around = _moves(cr[calm])
    bump[calm] = np.maximum(_bumps(cr[calm]), OVER_SIDES * away[~gone])
    if len(calm) > 1:
        mid = _median(np.concatenate(_beside(cr[calm], BESIDE), axis=1))
        level[calm] = np.abs(np.nan_to_num(cr[calm] - mid))
    place = np.searchsorted(calm, np.arange(R)).clip(0, max(len(calm) - 1, 0))
    local = around[place] if len(calm) else local

    # Other values delivered for the same time: held against the neighbours of the first delivery.
    bumps, aparts, levels = bump[of], apart[of], level[of]
    other = np.flatnonzero(~head & ~np.isnan(lc) & (lc != cr[of]) & ~bad)
    if len(other) and len(calm) > 1:
        at = of[other]
        i = np.searchsorted(calm, at)
        p = np.where(i > 0, cr[calm[np.maximum(i - 1, 0)]], np.nan)
        j = np.where((i < len(calm)) & (calm[np.minimum(i, len(calm) - 1)] == at), i + 1, i)
        q = np.where(j < len(calm), cr[calm[np.minimum(j, len(calm) - 1)]], np.nan)
        y = lc[other]
        with np.errstate(all="ignore"):
            size = np.maximum(np.minimum(y - p, y - q), np.minimum(p - y, q - y))
            size = np.nan_to_num(np.where(np.abs(p - q) < 0.5 * size, size, 0.0))
        near = np.abs(y - cr[at]) < 0.5 * np.maximum(np.maximum(bump[at], apart[at]), 1e-9)
        bumps[other] = np.where(near, bump[at], np.maximum(size, 0.0))
        aparts[other] = np.where(near, apart[at], 0.0)
        levels[other] = np.where(near, level[at], bumps[other])

    # Wicks: the high above, the low below everything else the bar shows.
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        top, low = np.nanmax([lo, lc], axis=0), np.nanmin([lo, lc], axis=0)
    wick = np.where(bad, 0.0, np.maximum(np.nan_to_num(lh - top), np.nan_to_num(low - ll)))

    # Volumes: height over both sides, and the hour of the day.
    vl = lv[rep]
    traded = np.flatnonzero(~np.isnan(vl))
    beside = np.zeros(R)
    hour = (us // 3_600_000_000 % 24).astype(int)
    spread, hours = CALM_VOLUME, np.zeros(24)
    if len(traded):
        x = vl[traded]
        beside[traded] = _two_sided(x)
        spread = max(float(np.median(np.abs(x - np.median(x)))), CALM_VOLUME)
        at_hour = hour[rep][traded]
        hours = np.array([np.median(x[at_hour == k]) if np.any(at_hour == k) else 0.0 for k in range(24)])
    sides, logs = np.where(v == v[rep][of], beside[of], 0.0), np.where(v == v[rep][of], vl[of], np.nan)
    other = np.flatnonzero(~head & (v > 0) & (v != v[rep][of]))
    if len(other) and len(traded):
        sides[other], logs[other] = _two_sided_at(vl, traded, of[other], lv[other]), lv[other]

    # Runs of equal closes of traded bars, and of traded volumes.
    held, later, runs = [], [], []
    for values, own in ((c, np.flatnonzero(~np.isnan(c[rep]) & ~(vr == 0) & ~bad[rep])), (v, np.flatnonzero(vr > 0))):
        size, first, most = _runs(values[rep][own])
        long, goes_on = np.ones(R), np.zeros(R, bool)
        long[own], goes_on[own] = size, ~first
        long, goes_on = long[of], goes_on[of] & (values == values[rep][of])
        # Another value delivered for the same time goes on with a run, or does not, in place of the first delivery's.
        other = np.flatnonzero(~head & (values > 0) & ~(v == 0) & ~bad & (values != values[rep][of]))
        if len(other) and len(own):
            before, after = _runs_at(values[rep], own, of[other], values[other])
            long[other], goes_on[other] = before + 1 + after, before > 0
        held.append(long)
        later.append(goes_on)
        runs.append(float(most))
    return Raw(levels, bumps, aparts, local[of], wick, sides, logs, hour, tuple(held), tuple(later)), Usual(step, tuple(runs), spread, hours), rep


def _lot(seq: np.ndarray) -> np.ndarray:
    """A number per reading by which samples are drawn, the lowest first."""
    return (seq.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)


def sample(seq: np.ndarray, raw: Raw, among: np.ndarray) -> tuple[np.ndarray, Raw]:
    """The POOL readings of lowest lot among the given places, with their lots."""
    lot = _lot(seq[among])
    pick = np.lexsort((seq[among], lot))[:POOL]
    return lot[pick], raw.take(among[pick])


def pool_of(drawn: Raw, usual: Usual) -> np.ndarray:
    """What a forest is fitted on: drawn readings that are not stuck, so that many stuck ones do not become its norm."""
    return drawn.points(usual)[~drawn.stuck(usual)]


def judge(raw: Raw, usual: Usual, pool: np.ndarray, bad: np.ndarray, seed: int, odd: float = ODD) -> dict[str, np.ndarray]:
    """Score and verdicts: what the forest finds odd, less the shapes that are genuine; ``bad`` is impossible whatever its score."""
    points = raw.points(usual)
    scores = cleaned(pool, seed, GROUPS, DOUBTFUL).scores(points) if len(pool) else np.zeros((len(points), len(GROUPS)))
    leaves, wick, burst, run = (scores >= odd).T
    spike = (leaves & (points[:, 1] > 0)) | (wick & (points[:, 2] > 0)) | (burst & (points[:, 3] > 0))
    return {"score": scores.max(axis=1), "impossible": bad, "spike": spike & ~bad, "stuck": run & raw.stuck(usual) & ~bad}


def _ordered(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of time and delivery; seq, time, open, high, low, close, volume, impossible and own in it."""
    seq = pc.fill_null(table["ingest_seq"], -1).to_numpy()
    rest = [table[k].to_numpy() for k in ("_us", "open", "high", "low", "close", "volume", "_bad", "_own")]
    order = np.lexsort((seq, rest[0]))
    return order, [x[order] for x in (seq, *rest)]


def _count(table: pa.Table) -> pa.Table:
    """One shard's part of its source's histograms (kind, key, n) and its readings of lowest lot. What crosses a border counts where it begins."""
    table = table.combine_chunks()
    _, (seq, us, o, h, l, c, v, bad, own) = _ordered(table)
    raw, _, rep = measure(us, o, h, l, c, v, bad)
    lot, drawn = sample(seq, raw, rep[own[rep]])
    us, c, v, bad, own = (x[rep] for x in (us, c, v, bad, own))
    parts = []
    with np.errstate(all="ignore"):
        seen = np.flatnonzero((c > 0) & ~(v == 0) & ~bad)
        step = np.abs(np.diff(np.log(c[seen])))
        step = step[own[seen[1:]] & (step <= FAR)]
        parts.append((np.full(len(step), STEPS), np.round(np.log(np.maximum(step, 1e-5)) / BIN)))
        traded = np.flatnonzero((v > 0) & own)
        parts.append((HOURS + us[traded] // 3_600_000_000 % 24, np.round(np.log(v[traded]) / BIN)))
    for kind, x, at in ((CLOSE_RUNS, c, np.flatnonzero(~np.isnan(c) & ~(v == 0) & ~bad)), (VOLUME_RUNS, v, np.flatnonzero(v > 0))):
        size, first, _ = _runs(x[at])
        parts.append((np.full(np.count_nonzero(first & own[at]), kind), size[first & own[at]]))
    pairs, n = np.unique(np.concatenate([np.column_stack(p) for p in parts]).clip(-1e9, 1e9).astype(np.int64), axis=0, return_counts=True)
    return pa.table({"symbol": table["symbol"][:1], "_shard": table["_shard"][:1], "kind": [pairs[:, 0]], "key": [pairs[:, 1]], "n": [n.astype(np.int64)], "lot": [lot.astype(np.int64)], "drawn": [drawn.flat().ravel()]})


def _middle(key: np.ndarray, n: np.ndarray) -> float:
    """The median of ``key`` with multiplicity ``n``."""
    order = np.argsort(key, kind="stable")
    return float(key[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]) if len(key) else 0.0


def _merge(table: pa.Table) -> pa.Table:
    """What is usual for a source and what its forest is fitted on, for each of its shards."""
    kind, key, n, lot, drawn = (np.concatenate([x.values.to_numpy() for x in table[k]]) for k in ("kind", "key", "n", "lot", "drawn"))
    pairs, at = np.unique(np.column_stack([kind, key]), axis=0, return_inverse=True)
    (kind, key), n = pairs.T, np.bincount(at.ravel(), weights=n).astype(np.int64)
    runs = tuple(float(_usual_run(key[kind == k], n[kind == k])) for k in (CLOSE_RUNS, VOLUME_RUNS))
    steps, volumes, logs = kind == STEPS, kind >= HOURS, key * BIN
    step = max(np.exp(_middle(logs[steps], n[steps])), 1e-5) if steps.any() else 1e-5
    spread = max(_middle(np.abs(logs[volumes] - _middle(logs[volumes], n[volumes])), n[volumes]), CALM_VOLUME)
    usual = Usual(step, runs, spread, np.array([_middle(logs[kind == HOURS + k], n[kind == HOURS + k]) for k in range(24)]))
    # Lots differ between readings unless an ``ingest_seq`` is repeated; drawn values then settle the order.
    drawn = drawn.reshape(len(lot), -1)
    pick = np.lexsort((*drawn.T[::-1], lot))[:POOL]
    pool = pool_of(Raw.of(drawn[pick]), usual)
    each = lambda x: pa.array([x] * len(table), pa.list_(pa.float64()))
    return pa.table({"symbol": table["symbol"], "_shard": table["_shard"], "usual": each(usual.flat()), "pool": each(pool.ravel())})


def _group(flagged_only: bool, odd: float):
    def run(table: pa.Table, whole: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order, (seq, us, o, h, l, c, v, bad, own) = _ordered(table)
        raw, usual, rep = measure(us, o, h, l, c, v, bad)
        if len(whole):
            usual, pool = Usual.of(whole["usual"][0].values.to_numpy()), whole["pool"][0].values.to_numpy().reshape(-1, WIDTH)
        else:
            pool = pool_of(sample(seq, raw, rep)[1], usual)
        got = judge(raw, usual, pool, bad, zlib.crc32(table["symbol"][0].as_py().encode("utf-8", "surrogatepass")), odd)
        keep = own
        if flagged_only:
            keep = keep & (got["impossible"] | got["spike"] | got["stuck"])
        at = np.flatnonzero(keep)
        back = table.select(["ingest_seq", "symbol"]).take(pa.array(order[at]))
        for k in ("score", "impossible", "spike", "stuck"):
            back = back.append_column(k, pa.array(got[k][at]))
        return back

    return run


def mark_spikes(bars: DataFrame, flagged_only: bool = False, target_rows: int = 50_000, odd: float = ODD) -> DataFrame:
    """Score and verdicts of every delivered row, or only of the rows found at fault.

    One shuffle by (symbol, shard). A source of more than ``target_rows`` rows is
    cut by time, each shard with ``HALO`` readings of its neighbours. What is usual
    for it (step, run lengths, spread and hours of volumes) and the readings its forest
    is fitted on then come from all its shards first, in a shuffle of such sources
    alone, and are joined to each. Rows without symbol or time never enter the shuffle.
    """
    rows = bars.select(*FIELDS).withColumn("_bad", impossible())
    placed = F.col("symbol").isNotNull() & F.col("timestamp").isNotNull()
    nan = F.lit(float("nan"))
    sharded = with_shards(rows.where(placed), "symbol", "timestamp", target_rows, HALO)
    ready = sharded.select(
        "ingest_seq", "symbol", "_shard", "_own", "_cut", "_bad", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("_us"),
        *[F.coalesce(c, nan).alias(c) for c in ("open", "high", "low", "close", "volume")],
    )
    lists = "kind array<long>, key array<long>, n array<long>, lot array<long>, drawn array<double>"
    counts = ready.where("_cut").groupBy("symbol", "_shard").applyInArrow(_count, f"symbol string, _shard int, {lists}")
    usual = counts.groupBy("symbol").applyInArrow(_merge, "symbol string, _shard int, usual array<double>, pool array<double>")
    judged = ready.drop("_cut").groupBy("symbol", "_shard").cogroup(usual.groupBy("symbol", "_shard")).applyInArrow(_group(flagged_only, odd), VERDICT)
    alone = rows.where(~placed).select(
        "ingest_seq", "symbol", F.when(F.col("_bad"), 1.0).otherwise(0.0).alias("score"), F.col("_bad").alias("impossible"), F.lit(False).alias("spike"), F.lit(False).alias("stuck")
    )
    return judged.unionByName(alone.where("impossible") if flagged_only else alone)
