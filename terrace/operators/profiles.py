"""Groups of profiles, in numpy: what a task tells of its batches of profiles, and what follows from all tasks'.

A volume's state is a dict. ``turn``; the centres ``c, plain, lengths`` (values, whether there is one, levels of each);
``low, high``, the extremes of finite values by level; ``known``, members and hash of each group in the turn before. For
medians also, by group and level: ``lo, hi``, the window in which the median is looked for, ``take``, whether the
window's values are wanted or their numbers by bins, ``open``, whether it is not found yet, ``middle``, it once found,
``density``, distinct values to a unit around the last one. Windows only say where to look: each pass counts what lies
below them, so a window that misses costs a pass and never a result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers that all windows of a volume count by bins, and values that they send, about.
COUNTS, VALUES = 1 << 18, 1 << 19
#: What tasks need of a state.
SENT = ("c", "plain", "lengths", "lo", "hi", "take", "open")
#: Bytes that a task holds for all volumes that it has met, before it sends them.
HELD = 64 << 20

Told = dict[str, np.ndarray]


def bins_of(windows: int) -> int:
    """Bins of a window."""
    return min(max(COUNTS // windows, 8), 256)


def most_of(windows: int) -> int:
    """Values of a window that are sent to find a median among them; a window of more is counted by bins."""
    return min(max(VALUES // windows, 64), 8192)


def packed(p: pa.ListArray, kind: type) -> tuple[pa.Array, pa.Array]:
    """Profiles as bytes of ``kind`` and, where they have nulls, the places of these."""
    flat, cuts = p.flatten(), np.concatenate([[0], np.cumsum(p.value_lengths().to_numpy())])
    size = np.dtype(kind).itemsize
    filled = (flat.fill_null(0) if flat.null_count else flat).to_numpy(zero_copy_only=False).astype(kind)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(p), [None, pa.py_buffer((cuts * size).astype(np.int64)), pa.py_buffer(filled)])
    holes: list[bytes | None] = [None] * len(p)
    if flat.null_count:
        empty = np.asarray(flat.is_null())
        for i, (start, stop) in enumerate(zip(cuts, cuts[1:])):
            if empty[start:stop].any():
                holes[i] = empty[start:stop].tobytes()
    return values.cast(pa.binary()), pa.array(holes, pa.binary())


def matrix(p: pa.Array, holes: pa.Array, kind: type, levels: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """A row of ``levels`` values for each profile, where there is one, and their lengths; both None where all are whole and of all levels."""
    p = p.cast(pa.large_binary())
    cuts = np.frombuffer(p.buffers()[1], np.int64)[p.offset : p.offset + len(p) + 1]
    values = np.frombuffer(p.buffers()[2], np.uint8)[cuts[0] : cuts[-1]].view(kind)
    lengths = np.diff(cuts) // np.dtype(kind).itemsize
    if holes.null_count == len(holes) and (lengths == levels).all():
        return values.reshape(-1, levels).astype(float), None, None
    x, there = np.zeros((len(p), levels)), np.arange(levels) < lengths[:, None]
    x[there] = values
    for i in np.flatnonzero(np.asarray(holes.is_valid())):
        there[i, : lengths[i]] &= ~np.frombuffer(holes[i].as_py(), bool)
    x[~there] = 0
    return x, there, lengths


def nearest(x: np.ndarray, there: np.ndarray | None, lengths: np.ndarray | None, state: dict, absolute: bool) -> np.ndarray:
    """The first of the centres nearest to each profile; one that can't be compared (nulls, another length) comes first, NaN last."""
    c, levels = state["c"], x.shape[1]
    d, turned = np.zeros((len(c), len(x))), np.ascontiguousarray(x.T)
    step = np.empty_like(d)
    with np.errstate(invalid="ignore", over="ignore"):
        for at in range(levels):  # in the order of levels
            np.subtract(turned[at], c[:, at, None], out=step)
            d += np.abs(step, out=step) if absolute else np.multiply(step, step, out=step)
    unknown = np.isnan(d)
    near = np.argmin(np.where(unknown, np.inf, d), axis=0)
    if unknown.any():
        late = unknown[near, np.arange(len(x))] & ~unknown.all(axis=0)
        near[late] = np.argmin(unknown[:, late], axis=0)
    if there is None and state["plain"].all():
        return near
    whole = np.ones(len(x), bool) if there is None else there.sum(axis=1) == lengths
    sizes = np.full(len(x), levels) if lengths is None else lengths
    apart = ~(whole & (state["plain"].sum(axis=1) == state["lengths"])[:, None] & (sizes == state["lengths"][:, None]))
    return np.where(apart.any(axis=0), np.argmax(apart, axis=0), near)


def told(x: np.ndarray, there: np.ndarray | None, lengths: np.ndarray | None, marks: np.ndarray, state: dict, medians: bool) -> Told:
    """What one batch of profiles of one volume adds."""
    k, levels = state["c"].shape
    group = nearest(x, there, lengths, state, medians)
    out: Told = {"members": np.bincount(group, minlength=k), "hash": np.zeros(k, np.uint64), "levels": np.zeros(k, np.int64), "n": np.zeros((k, levels), np.int64)}
    if medians:
        size = bins_of(k * levels) if (state["open"] & ~state["take"]).any() else 0
        out |= {name: np.zeros((k, levels), np.int64) for name in ("counted", "below", "inside", "negative", "zero")} | {"bins": np.zeros((k, levels, size), np.int64), "over": np.zeros((k, levels), bool)}
    else:
        out["sum"] = np.zeros((k, levels))
    at, value = [np.zeros(0, np.int64)], [np.zeros(0)]
    for j in np.flatnonzero(out["members"]):
        mine = group == j
        part, has = x[mine], None if there is None else there[mine]
        out["hash"][j] = marks[mine].sum(dtype=np.uint64)
        out["levels"][j] = levels if lengths is None else lengths[mine].max()
        out["n"][j] = len(part) if has is None else has.sum(axis=0)
        if not medians:
            with np.errstate(invalid="ignore", over="ignore"):
                out["sum"][j] = part.sum(axis=0)
            continue
        if has is not None:
            part = np.where(has, part, np.nan)
        lo, hi, take = state["lo"][j], state["hi"][j], state["take"][j]
        inside = (part >= lo) & (part <= hi) & state["open"][j]
        out["counted"][j] = np.count_nonzero(part == part, axis=0)
        out["below"][j], out["inside"][j] = np.count_nonzero(part < lo, axis=0), np.count_nonzero(inside, axis=0)
        if ((lo <= 0) & (hi >= 0) & state["open"][j]).any():
            out["negative"][j], out["zero"][j] = np.count_nonzero(inside & (part < 0), axis=0), np.count_nonzero(inside & (part == 0), axis=0)
        if take.any():
            row, lev = np.nonzero(inside & take)
            at.append(j * levels + lev)
            value.append(part[row, lev])
        if size:
            counts = inside & ~take
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                bin = (part / 2 - lo / 2) * (size / (hi / 2 - lo / 2))
            bin = np.clip(np.where(counts & (bin == bin), bin, 0), 0, size - 1).astype(np.int64) + np.arange(levels) * size
            out["bins"][j] = np.bincount(bin[counts], minlength=levels * size).reshape(levels, size)
    if medians:
        made = np.concatenate(at)
        out |= distinct(made, np.concatenate(value), np.ones(len(made), np.int64))
    return out


def distinct(at: np.ndarray, value: np.ndarray, times: np.ndarray) -> Told:
    """Equal values of a window once, sorted, with their number."""
    order = np.lexsort((value, at))
    at, value, times = at[order], value[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (value[1:] != value[:-1])])) if len(at) else np.zeros(0, np.int64)
    return {"at": at[new], "value": value[new], "times": np.add.reduceat(times, new) if len(at) else times}


def merged(parts: list[Told]) -> Told:
    """What several batches or tasks tell, in their order. Windows that turn out to hold too many values give them up."""
    if len(parts) == 1:
        return parts[0]
    apart = ("at", "value", "times")
    how = {"levels": np.maximum.reduce, "over": np.logical_or.reduce}
    out = {name: how.get(name, np.add.reduce)([p[name] for p in parts]) for name in parts[0] if name not in apart}
    if "at" in parts[0]:
        all_of = distinct(*(np.concatenate([p[name] for p in parts]) for name in apart))
        over = out["over"] | (np.bincount(all_of["at"], minlength=out["over"].size).reshape(out["over"].shape) > max(2 * most_of(out["over"].size), 4096))
        keep = ~over.ravel()[all_of["at"]]
        out |= {name: values[keep] for name, values in all_of.items()} | {"over": over}
    return out


def by_volume(batch: pa.RecordBatch) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The rows of each volume in a batch."""
    codes = batch.column("brick_id").dictionary_encode()
    if len(codes.dictionary) == 1:
        yield codes.dictionary[0].as_py(), batch
        return
    places, code = np.argsort(np.asarray(codes.indices), kind="stable"), np.sort(np.asarray(codes.indices))
    for which, part in zip(codes.dictionary.to_pylist(), np.split(places, np.flatnonzero(np.diff(code)) + 1)):
        yield which, batch.take(pa.array(part))


def gathered(batches: Iterator[pa.RecordBatch], of, join, task: int) -> Iterator[tuple[object, int, bytes]]:
    """``of`` each volume's rows of each batch, joined by ``join``: a row for each volume; more where it holds too much."""
    held, size, n = {}, 0, 0

    def sent():
        nonlocal n
        for brick, parts in held.items():
            yield brick, (task << 24) + n, pickle.dumps(join(parts))
        n += 1

    for batch in batches:
        for brick, rows in by_volume(batch):
            made = of(brick, rows)
            if made is None:
                continue
            parts = held.setdefault(brick, [])
            parts.append(made)
            size += sum(v.nbytes if isinstance(v, np.ndarray) else 1024 for v in made.values())
            if len(parts) == 16:
                parts[:] = [join(parts)]
        if size > HELD:
            held = {brick: [join(parts)] for brick, parts in held.items()}
            size = sum(v.nbytes if isinstance(v, np.ndarray) else 1024 for parts in held.values() for v in parts[0].values())
            if size > HELD // 2:
                yield from sent()
                held, size = {}, 0
    yield from sent()


def drawn(parts: list[dict], k: int) -> dict:
    """Of several parts' first profiles by the hash of their place the first ``k``, and the extremes of all."""
    first = sorted((f for p in parts for f in p["first"]), key=lambda f: f[0])[:k]
    levels = max(len(p["low"]) for p in parts)
    ends = {name: of([np.pad(p[name], (0, levels - len(p[name])), constant_values=empty) for p in parts]) for name, of, empty in (("low", np.minimum.reduce, np.inf), ("high", np.maximum.reduce, -np.inf))}
    return {"first": first, "n": sum(p["n"] for p in parts)} | ends


def first_of(rows: pa.RecordBatch, kind: type, k: int) -> dict:
    """``drawn`` of one batch of one volume."""
    levels = int(pc.max(pc.binary_length(rows.column("p"))).as_py()) // np.dtype(kind).itemsize
    x, there, _ = matrix(rows.column("p"), rows.column("holes"), kind, levels)
    finite = np.isfinite(x) if there is None else np.isfinite(x) & there
    at = pc.sort_indices(pa.Table.from_batches([rows.select(["h", "row", "col"])]), [("h", "ascending"), ("row", "ascending"), ("col", "ascending")], null_placement="at_start").slice(0, k)
    first = []
    for i in at.to_pylist():
        p, holes = np.frombuffer(rows.column("p")[i].as_py(), kind).astype(float), rows.column("holes")[i].as_py()
        place = tuple((v is not None, v) for v in (rows.column(c)[i].as_py() for c in ("h", "row", "col")))
        first.append((place, p, np.zeros(len(p), bool) if holes is None else np.frombuffer(holes, bool)))
    return {"first": first, "n": len(x), "low": np.where(finite, x, np.inf).min(axis=0), "high": np.where(finite, x, -np.inf).max(axis=0)}


def started(d: dict, rounds: int, medians: bool) -> dict:
    """The state of a volume whose first profiles are the centres."""
    k, levels = len(d["first"]), len(d["low"])
    c, plain, lengths = np.zeros((k, levels)), np.zeros((k, levels), bool), np.array([len(p) for _, p, _ in d["first"]])
    for j, (_, p, holes) in enumerate(d["first"]):
        c[j, : len(p)], plain[j, : len(p)] = np.where(holes, 0, p), ~holes
    none = ~np.isfinite(d["low"])
    state = {"turn": 0, "c": c, "plain": plain, "lengths": lengths, "known": None, "n": d["n"], "low": np.where(none, 0, d["low"]), "high": np.where(none, 0, d["high"]), "done": rounds <= 1}
    return state | looked_for(state | {"density": np.zeros((k, levels))}, np.full((k, levels), np.inf)) if medians else state


def looked_for(state: dict, span: np.ndarray) -> dict:
    """Windows of a turn: ``span`` around the last medians, everywhere where that is not finite."""
    c, low, high, most = state["c"], state["low"], state["high"], most_of(state["c"].size)
    warm = np.isfinite(c) & np.isfinite(span) & state["plain"]
    with np.errstate(invalid="ignore"):
        lo, hi = (np.where(warm, np.clip(c + s, low, high), end) for s, end in ((-span, low), (span, high)))
        take = np.where(warm, (hi - lo) * state["density"] <= most / 2, state["n"] <= most)
    return {"lo": lo, "hi": hi, "take": take, "open": np.ones(c.shape, bool), "middle": np.full(c.shape, np.nan), "density": state["density"]}


def stepped(state: dict, t: Told, rounds: int, medians: bool, fine: float) -> dict:
    """The state after a pass: narrower windows, or the next turn's centres. ``fine`` is the spacing of values beside 1."""
    known = (t["members"], t["hash"])
    if state["known"] is not None and all(map(np.array_equal, state["known"], known)):
        return state | {"done": True}  # no profile has moved
    if not medians:
        with np.errstate(divide="ignore", invalid="ignore"):
            return turned(state, t, t["sum"] / t["n"], known, rounds)
    low, high, levels = state["low"], state["high"], state["c"].shape[1]
    lo, hi, take, middle, density = (state[name].copy() for name in ("lo", "hi", "take", "middle", "density"))
    still, cuts = state["open"] & (t["members"] > 0)[:, None], np.searchsorted(t["at"], np.arange(lo.size + 1))
    for w in map(tuple, np.argwhere(still)):
        lev, a, b, inside = w[1], lo[w], hi[w], t["inside"][w]
        rank, found = t["counted"][w] // 2 - t["below"][w], None
        if not t["counted"][w]:
            found = np.nan
        elif rank < 0 and a <= low[lev]:
            found = -np.inf
        elif rank >= inside and b >= high[lev]:
            found = np.inf
        elif rank < 0:
            lo[w], hi[w], take[w] = max(low[lev], a - 16 * (b - a)) if b > a else low[lev], a, False
        elif rank >= inside:
            lo[w], hi[w], take[w] = b, min(high[lev], b + 16 * (b - a)) if b > a else high[lev], False
        elif a == b:
            found = a
        elif 0 <= rank - t["negative"][w] < t["zero"][w]:
            found = 0.0  # narrower windows around many zeros would come to an end last
        elif take[w] and t["over"][w]:
            take[w] = False
        elif take[w]:
            part = slice(*cuts[w[0] * levels + lev :][:2])
            found = t["value"][part][np.searchsorted(np.cumsum(t["times"][part]), rank, "right")]
            with np.errstate(over="ignore"):
                density[w] = len(t["value"][part]) / (b - a)
        else:
            here, size = t["bins"][w], t["bins"].shape[2]
            at = int(np.searchsorted(np.cumsum(here), rank, "right"))
            slack = 4 * np.spacing(max(abs(a), abs(b)))
            x, y = (2 * (a / 2 + (b / 2 - a / 2) * (i / size)) for i in (at, at + 1))
            lo[w], hi[w] = x, y = max(a, x - slack), min(b, y + slack)
            # So narrow a window holds few distinct values, however often each.
            take[w] = here[at] <= most_of(lo.size) or y - x <= 1024 * fine * max(abs(x), abs(y)) or not y - x < b - a
        if found is not None:
            middle[w], still[w] = found, False
    state = state | {"lo": lo, "hi": hi, "take": take, "open": still, "middle": middle, "density": density}
    return state if still.any() else turned(state, t, middle, known, rounds)


def turned(state: dict, t: Told, new: np.ndarray, known: tuple, rounds: int) -> dict:
    """The state with the new centres; a group without members keeps its own."""
    has, turn = t["members"] > 0, state["turn"] + 1
    lengths = np.where(has, t["levels"], state["lengths"])
    plain = np.where(has[:, None], t["n"] > 0, state["plain"])
    c = np.where(has[:, None], np.where(plain, new, 0), state["c"])
    out = state | {"turn": turn, "c": c, "plain": plain, "lengths": lengths, "known": known, "done": turn >= rounds - 1}
    if "density" not in state:
        return out
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return out | looked_for(out, np.maximum(3 * np.abs(c - state["c"]), most_of(c.size) / 16 / state["density"]))
