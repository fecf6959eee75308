"""Sweeps as arrays: numbering and summaries of many sweeps of a sorted partition at once.

Spark partitions, shuffles and sorts the points; a task passes over its sorted rows with
numpy, some ten thousand rows at a time.  A sweep with a NULL or NaN, or longer than
``LONGEST`` points, is handed back for the plain window functions of ``curves``.  In ranges
of time (``of_ranges``) so are the sweeps at both ends of a range, which may go on beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from helioframe.config import SETTINGS
from helioframe.functions.smoothing import quadratic_fit_weights

#: Points of a sweep that is summarised in memory, and points taken at once.
LONGEST, BATCH = 500_000, 65_536

STATS = (
    "cell_id long, n_points long, v_span double, i_span double, all_night boolean, neg_ratio double, spike_count long, "
    "spike_score double, hysteresis_index double, n_unphysical long, us_min long, us_max long"
)
PARAMETERS = (
    "n long, voc_cross double, compat_cross double, jsc_cross double, v_nearest double, j_nearest double, v_near5 double, "
    "j_near5 double, spans_zero boolean, best struct<smooth:double,Voltage_V:double,J:double>"
)
NUMBERS = ["us", "pt", "Voltage_V", "Current_A", "cell_id"]


#: Direction, turns and rows of a device so far.
State = dict[str | None, tuple[bool, int, int]]


def local_numbers(cell: str, direction: str, state: State | None = None):
    """Number the turns to Reverse of each device of a partition (sorted by time, devices mixed).

    Adds ``local_no`` (turns so far, the first row's not counted), ``row_no`` and ``rev``.
    ``direction`` may be a text or whether it is Reverse; ``state`` shows how the devices end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: State = {} if state is None else state
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(batch.schema.get_field_index(cell)).dictionary_encode(null_encoding="encode")
            way = batch.column(batch.schema.get_field_index(direction))
            rev = pc.fill_null(way if pa.types.is_boolean(way.type) else pc.equal(way, "Reverse"), False).to_numpy(zero_copy_only=False)
            codes = names.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            r, c = rev[order], codes[order]
            start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            size = np.diff(np.append(start, n))
            cells = [names.dictionary[int(k)].as_py() for k in c[start]]
            known = [last.get(name) for name in cells]
            before = np.append(False, r[:-1])
            before[start] = [s is None or s[0] for s in known]  # the first row of all is no turn
            total = np.cumsum(r & ~before)
            gone = np.append(0, total)[start]  # turns of the devices sorted before
            no = total - np.repeat(gone - [s[1] if s else 0 for s in known], size)
            at = np.arange(n) - np.repeat(start - [s[2] if s else 0 for s in known], size)
            for name, end in zip(cells, (start + size - 1).tolist(), strict=True):
                last[name] = (bool(r[end]), int(no[end]), int(at[end]) + 1)
            back = np.empty(n, dtype=np.int64)
            back[order] = np.arange(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(no[back]), pa.array(at[back]), pa.array(rev)], [*batch.schema.names, "local_no", "row_no", "rev"])

    return run


def _first(value: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value at the first marked row of each sweep, and whether there is one."""
    at = np.flatnonzero(mark)
    k = np.searchsorted(at, start)
    found = (k < len(at)) & (np.append(at, len(mark))[k] < end)
    rows = np.where(found, np.append(at, 0)[k], 0)
    return value[rows], found


def _stats(c: dict, start: np.ndarray, size: np.ndarray, gid: np.ndarray) -> list[pa.Array]:
    v, i, rev, night = c["Voltage_V"], c["Current_A"], c["rev"], c["is_night"]
    top, least = np.maximum.reduceat, np.minimum.reduceat
    i_span = top(i, start) - least(i, start)
    step = np.abs(np.diff(i, prepend=0.0))
    spike = step / (i_span[gid] + 1e-12) > SETTINGS.spike_relative
    spike[start] = False
    minus = (i < 0) & (v < 0.5)
    power = v * i
    best_rev, best_fwd = top(np.where(rev, power, -np.inf), start), top(np.where(rev, -np.inf, power), start)
    both = np.isfinite(best_rev) & np.isfinite(best_fwd)
    with np.errstate(invalid="ignore"):
        index = np.abs(best_rev - best_fwd) / np.maximum(np.abs(best_rev), 1e-12)
    count = lambda x: np.add.reduceat(x.astype(np.int64), start)
    return [
        pa.array(top(c["cell_id"], start)), pa.array(size), pa.array(top(v, start) - least(v, start)), pa.array(i_span),
        pa.array(np.logical_and.reduceat(night, start)), pa.array(count(minus) / size), pa.array(count(spike)), pa.array(count(spike) / size),
        pa.array(np.where(both, index, 0.0), mask=~both), pa.array(count(minus)), pa.array(least(c["us"], start)), pa.array(top(c["us"], start)),
    ]


def _parameters(c: dict, start: np.ndarray, size: np.ndarray, gid: np.ndarray) -> list[pa.Array]:
    order = np.lexsort((c["Voltage_V"], gid))  # stable: equal voltages stay in order of time
    v, j = c["Voltage_V"][order], (c["Current_A"] * 1000.0 / SETTINGS.cell_area_cm2)[order]
    p, n, end = v * j, len(v), start + size
    inner = np.arange(n) - start[gid]
    follows = np.append(gid[1:] == gid[:-1], False)
    v1, j1 = np.append(v[1:], 0.0), np.append(j[1:], 0.0)
    turn_j, turn_v = follows & (np.sign(j) != np.sign(j1)), follows & (np.sign(v) != np.sign(v1))
    with np.errstate(divide="ignore", invalid="ignore"):
        v_at_j0, j_at_v0 = v - j * (v1 - v) / (j1 - j), j - v * (j1 - j) / (v1 - v)
    crossed = [_first(*x, start, end) for x in ((v_at_j0, turn_j & (v > 0.1)), (v_at_j0, turn_j), (j_at_v0, turn_v))]
    # Rows are in voltage order, so stable sorts settle equal distances as voltage, time and number do.
    near_j, near_v = np.lexsort((np.abs(j), gid)), np.lexsort((np.abs(v), gid))
    five = np.minimum(size, 5)

    def mean(x):
        total = np.zeros(len(start))
        for k in range(5):
            total += np.where(k < five, x[np.minimum(start + k, n - 1)], 0.0)
        return total / five

    level = np.zeros(n)
    half = np.where(size >= 11, 5, 4)
    for h in (4, 5):
        weights = quadratic_fit_weights(h)
        fit = lambda row, w: sum((float(w[k + h]) * p[row + k] for k in range(-h, h + 1)), 0.0)  # noqa: B023, E731
        mine = np.flatnonzero((half == h) & (size >= 10))
        if not len(mine):
            continue
        rows = np.flatnonzero(((half == h) & (size >= 10))[gid] & (inner >= h) & (inner < (size - h)[gid]))
        level[rows] = fit(rows, weights[0])
        for full, first, x0 in ((start[mine] + h, start[mine], np.arange(-h, 0)), (end[mine] - h - 1, end[mine] - h, np.arange(1, h + 1))):
            a, b, bend = (fit(full, w)[:, None] for w in weights)
            level[first[:, None] + np.arange(h)] = a + b * x0 + bend * x0 * x0
    top = np.maximum.reduceat(level, start)
    rows = np.zeros(len(start), dtype=np.int64)
    hits = np.flatnonzero(level == top[gid])
    rows[gid[hits][::-1]] = hits[::-1]  # the first of equal ones stays
    short = size < 10
    best = pa.StructArray.from_arrays([pa.array(level[rows]), pa.array(v[rows]), pa.array(j[rows])], ["smooth", "Voltage_V", "J"], mask=pa.array(short))
    least, most = np.minimum.reduceat(v, start), np.maximum.reduceat(v, start)
    return [
        pa.array(size), *[pa.array(x, mask=~found) for x, found in crossed], pa.array(v[near_j[start]]), pa.array(j[near_v[start]]),
        pa.array(mean(v[near_j])), pa.array(mean(j[near_v])), pa.array((least <= 0) & (most >= 0)), best,
    ]


def summaries(schema: pa.Schema):
    """One row a sweep from rows sorted by ``group`` (a hash of the sweep's key); ``done`` is false for those handed back."""

    def summarise(t: pa.Table) -> pa.RecordBatch:
        codes = pc.fill_null(t.column("cell_name").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        curve = t.column("curve").to_numpy()
        known = [t.column(name).combine_chunks() for name in NUMBERS]
        numbers = {name: pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for name, x in zip(NUMBERS, known, strict=True)}
        order = np.lexsort((numbers["pt"], numbers["us"], curve, codes, t.column("group").to_numpy()))
        c = {name: x[order] for name, x in numbers.items()}
        c |= {name: pc.fill_null(t.column(name).combine_chunks(), False).to_numpy(zero_copy_only=False)[order] for name in ("rev", "is_night")}
        codes, curve = codes[order], curve[order]
        odd = codes < 0
        for x in known:
            odd |= pc.is_null(x).to_numpy(zero_copy_only=False)[order]
        odd |= pc.is_null(t.column("rev")).to_numpy()[order]
        for name in ("Voltage_V", "Current_A"):
            odd |= ~np.isfinite(c[name])
        same = (codes[1:] == codes[:-1]) & (curve[1:] == curve[:-1])
        start = np.flatnonzero(np.append(True, ~same))
        size = np.diff(np.append(start, len(curve)))
        done = ~np.logical_or.reduceat(odd, start) & (size <= LONGEST)
        keys = t.select(["cell_name", "curve"]).take(pa.array(order[start])).combine_chunks()
        if not done.all():  # the rest alone
            rows = np.repeat(done, size)
            c = {name: x[rows] for name, x in c.items()}
            size = size[done]
            start = np.cumsum(size) - size
        got = []
        if len(start) and len(size):
            gid = np.repeat(np.arange(len(size)), size)
            got = [*_stats(c, start, size, gid), *_parameters(c, start, size, gid)]
        back = pa.array(np.cumsum(done) - 1, mask=~done)
        fields = [schema.field(k) for k in range(3, len(schema))]
        got = [x.take(back).cast(f.type) for x, f in zip(got, fields, strict=True)] if got else [pa.nulls(len(done), f.type) for f in fields]
        flat = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (keys.column(k) for k in (0, 1))]
        return pa.RecordBatch.from_arrays([*flat, pa.array(done), *got], schema=schema)

    def handed_back(t: pa.Table) -> pa.RecordBatch:
        keys = t.select(["cell_name", "curve"]).group_by(["cell_name", "curve"]).aggregate([]).combine_chunks()
        flat = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (keys.column(name) for name in ("cell_name", "curve"))]
        rest = [pa.nulls(keys.num_rows, schema.field(k).type) for k in range(3, len(schema))]
        return pa.RecordBatch.from_arrays([*flat, pa.array([False] * keys.num_rows), *rest], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, skipped = [], 0, None
        for batch in batches:
            if skipped is not None:  # the rest of a group that is too long
                same = int(np.searchsorted(batch.column(0).to_numpy(), skipped, "right"))
                if same:
                    yield handed_back(pa.Table.from_batches([batch.slice(0, same)]))
                batch = batch.slice(same)
                if not batch.num_rows:
                    continue
                skipped = None
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < BATCH:
                continue
            t = pa.Table.from_batches(held)
            group = t.column(0).to_numpy()
            cut = int(np.searchsorted(group, group[-1], "left"))
            if cut:
                yield summarise(t.slice(0, cut))
            tail = t.slice(cut).combine_chunks()
            held, rows = tail.to_batches(), tail.num_rows
            if rows > LONGEST:
                yield handed_back(tail)
                held, rows, skipped = [], 0, group[-1]
        if rows:
            yield summarise(pa.Table.from_batches(held))

    return run


def _shapes(c: dict, start: np.ndarray, size: np.ndarray, gid: np.ndarray, points: int) -> pa.Array:
    """Normalised currents on a grid of each branch, as ``curves.shape_vectors`` does; NULL where it has no row."""
    v, i, end = c["Voltage_V"], c["Current_A"], start + size
    inner = np.arange(len(v)) - start[gid]
    far = np.abs(v - v[start][gid])
    hits = np.flatnonzero(far == np.maximum.reduceat(far, start)[gid])
    turn = np.zeros(len(start), dtype=np.int64)
    turn[gid[hits][::-1]] = inner[hits][::-1]  # the first of equal ones stays
    v_lo, i_lo = np.minimum.reduceat(v, start), np.minimum.reduceat(i, start)
    v_span, i_span = np.maximum.reduceat(v, start) - v_lo, np.maximum.reduceat(i, start) - i_lo
    ok = (size >= 10) & (turn >= 2) & (turn <= size - 3) & (v_span > 0) & (i_span > 0)
    if not ok.any():
        return pa.nulls(len(start), pa.list_(pa.float64()))
    t = turn[gid]
    rows = np.concatenate([np.flatnonzero(ok[gid] & side) for side in (inner <= t, inner >= t)])
    line = 2 * gid[rows] + (np.arange(len(rows)) >= np.count_nonzero(ok[gid] & (inner <= t)))
    x, y = ((z - lo[gid])[rows] / span[gid][rows] for z, lo, span in ((v, v_lo, v_span), (i, i_lo, i_span)))
    order = np.lexsort((x, line))
    line, x, y = line[order], x[order], y[order]
    at = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (x[1:] != x[:-1])))
    y = np.add.reduceat(y, at) / np.diff(np.append(at, len(y)))  # the mean of equal voltages
    line, x = line[at], x[at]
    opens = np.append(True, line[1:] != line[:-1])
    closes = np.append(opens[1:], True)
    last = points - 1
    g0 = np.where(opens, 0, np.ceil(x * last)).astype(np.int64)
    g1 = np.where(closes, last, np.append(np.ceil(x[1:] * last) - 1, 0)).astype(np.int64)
    k = np.repeat(np.arange(len(x)), g1 - g0 + 1)  # the point below each grid position
    pos = np.tile(np.arange(points), 2 * np.count_nonzero(ok))
    x1, y1 = np.append(x[1:], 0.0), np.append(y[1:], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = pos / float(last)
        flat = np.where(closes[k] | (g < x[k]), y[k], y[k] + ((y1 - y) / (x1 - x))[k] * (g - x[k]))
    ends = np.append(0, np.cumsum(ok) * 2 * points)
    return pc.if_else(pa.array(ok), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.scalar(None, pa.list_(pa.float64())))


#: What a row of ``of_ranges`` is: a sweep, a point handed back, a step of the night, the end of a device.
SWEEP, POINT, STEP, END = range(4)


def of_ranges(schema: pa.Schema, first_cell: str | None, shape_points: int = 0, every_cell: bool = False):
    """Number and summarise the sweeps of a range of time (sorted by time, devices mixed).

    A sweep that lies within the range gives a row; one that may begin before or go on after
    it, has a NULL or NaN or is too long gives back its points.  Steps are the changes of
    current between night points of the first device, or of ``every_cell``, ends the turns and
    directions of a device that the ranges after it need.  What ``schema`` has no column for
    (``sweep``, ``directions``, ``step``) is not made.
    """
    kinds = {name: schema.field(name).type for name in schema.names}

    def batch(kind: int, names: pa.Array, no: np.ndarray, **given: pa.Array) -> pa.RecordBatch:
        n = len(names)
        cols = {"kind": pa.array(np.full(n, kind, dtype=np.int32)), "cell_name": names, "local_no": pa.array(no, pa.int64()), **given}
        return pa.RecordBatch.from_arrays([cols[k].cast(t) if k in cols else pa.nulls(n, t) for k, t in kinds.items()], schema=schema)

    def struct(kind: str, arrays) -> pa.Array:
        fields = list(kinds[kind])
        return pa.StructArray.from_arrays([a.cast(f.type) for a, f in zip(arrays, fields, strict=True)], fields=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: State = {}
        heads: dict[str, bool] = {}  # direction of the first row of each device
        too_long: dict[str, int] = {}  # sweeps of which points are handed back already

        def flush(t: pa.Table, final: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            t = t.combine_chunks()
            column = {name: t.column(name).combine_chunks() if t.num_rows else pa.array([], t.schema.field(name).type) for name in t.schema.names}
            names = column["cell_name"].dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            codes, no = codes[order], column["local_no"].to_numpy()[order]
            other = np.append(codes[1:] != codes[:-1], True)  # the last row of a device
            start = np.append(0, np.flatnonzero(other | np.append(no[1:] != no[:-1], True))[:-1] + 1)
            size = np.diff(np.append(start, len(codes)))
            newest = other[start + size - 1]
            code, number = codes[start], no[start]
            known = names.dictionary.to_pylist()
            given = np.array([too_long.get(name, -1) for name in known])[code] == number
            back = (number == 0) | given | (size > LONGEST)
            odd = np.zeros(len(codes), dtype=bool)
            for name in (*NUMBERS, "way"):
                if column[name].null_count:
                    odd |= column[name].is_null().to_numpy(zero_copy_only=False)[order]
            c = {name: pc.fill_null(column[name], 0).to_numpy(zero_copy_only=False)[order] for name in NUMBERS}
            c |= {name: column[name].to_numpy(zero_copy_only=False)[order] for name in ("rev", "is_night")}
            for name in ("Voltage_V", "Current_A"):
                odd |= ~np.isfinite(c[name])
            if final:
                back |= newest
                kept = np.zeros(len(start), dtype=bool)
            else:
                for k in np.flatnonzero(newest & back & (number > 0)).tolist():
                    too_long[known[code[k]]] = int(number[k])
                kept = newest & ~back
            back |= ~kept & np.logical_or.reduceat(odd, start)
            done = ~back & ~kept
            out = []
            if back.any():
                rows = order[np.repeat(back, size)]
                p = {name: x.take(pa.array(rows)) for name, x in column.items()}
                out.append(batch(POINT, p["cell_name"], p["local_no"], point=struct("point", [p[f.name] for f in kinds["point"]])))
            if done.any():
                rows = np.repeat(done, size)
                c = {name: x[rows] for name, x in c.items()}
                n, at = size[done], code[done]
                first = np.cumsum(n) - n
                gid = np.repeat(np.arange(len(n)), n)
                cells, more = names.dictionary.take(pa.array(at)), {}
                if shape_points:
                    more["shape"] = _shapes(c, first, n, gid, shape_points)
                if "sweep" in kinds:
                    more["sweep"] = struct("sweep", [*_stats(c, first, n, gid), *_parameters(c, first, n, gid)])
                if "directions" in kinds:
                    ways = column["ScanDirection"].dictionary_encode()
                    many = max(1, len(ways.dictionary))
                    seen = np.unique(gid * many + pc.fill_null(ways.indices, 0).to_numpy(zero_copy_only=False)[order][rows])  # none is null
                    ends = np.searchsorted(seen, np.arange(len(n) + 1) * many)
                    more["directions"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ways.dictionary.take(pa.array(seen % many)))
                out.append(batch(SWEEP, cells, number[done], **more))
                if "step" in kinds and (every_cell or first_cell in known):
                    mine = c["is_night"] if every_cell else c["is_night"] & (at == known.index(first_cell))[gid]
                    night = np.flatnonzero(mine)
                    if len(night):
                        i, g = c["Current_A"][night], gid[night]
                        begins = np.append(True, g[1:] != g[:-1])
                        step = pa.array(np.abs(np.diff(i, prepend=0.0)), mask=begins)
                        out.append(batch(STEP, cells.take(pa.array(g)), number[done][g], step=step))
            return out, t.take(pa.array(order[np.repeat(kept, size)]))

        held: list[pa.RecordBatch] = []
        rows, old = 0, 0
        for b in local_numbers("cell_name", "way", state)(batches):
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            for k in np.flatnonzero(column("row_no").to_numpy() == 0).tolist():
                heads[column("cell_name")[k].as_py()] = column("rev")[k].as_py()
            if column("us").null_count:  # counted only
                b = b.filter(column("us").is_valid())
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < max(BATCH, old):
                continue
            out, rest = flush(pa.Table.from_batches(held), False)
            yield from out
            held, rows, old = rest.combine_chunks().to_batches(), 0, rest.num_rows
        if held and sum(b.num_rows for b in held):
            yield from flush(pa.Table.from_batches(held), True)[0]
        if state:
            cells = sorted(state)
            end = struct("end", [pa.array([x(name) for name in cells]) for x in (lambda m: state[m][1], lambda m: heads[m], lambda m: state[m][0])])
            yield batch(END, pa.array(cells, pa.string()), np.zeros(len(cells), dtype=np.int64), end=end)

    return run
