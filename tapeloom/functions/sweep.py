"""Best levels of many books at once: levels as intervals of time, swept in whole arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Rows worked on at a time; a group of more rows is worked on alone.
ROWS = 1 << 18
#: Bits of an interval's number beside its price in a key.
PLACE = 30
TOP_PRICE = (1 << 32) - 1


def covered(first: np.ndarray, end: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """For each of n moments the largest key of the intervals [first, end) that hold it, -1 where none does.

    The reverse of a sparse table of maxima: an interval is two overlapping blocks of a power of two moments, so it is noted twice;
    from the longest blocks down, each block hands its maximum to its halves. That takes n log n steps, all on whole arrays.
    """
    if not len(key):
        return np.full(n, -1, np.int64)
    power = np.frexp((end - first).astype(np.float64))[1] - 1
    order = np.argsort(power, kind="stable")
    first, end, key = first[order], end[order], key[order]
    bounds = np.searchsorted(power[order], np.arange(int(power.max()) + 2))
    above = None
    for k in range(int(power.max()), -1, -1):
        own, width = slice(bounds[k], bounds[k + 1]), 1 << k
        here = np.full(n, -1, np.int64) if above is None else above.copy()
        if above is not None:  # blocks of twice the width begin where their first half does
            np.maximum(here[width:], above[:-width], out=here[width:])
        np.maximum.at(here, first[own], key[own])
        np.maximum.at(here, end[own] - width, key[own])
        above = here
    return above


def best_levels(group: np.ndarray, side: np.ndarray, price: np.ndarray, seq: np.ndarray, shares: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The best level of both sides after each event. Rows are changes of levels by group and seq; side 0 is the bid.

    Returns the first row of each event (changes of one group and seq) and bid_px, ask_px, bid_sz, ask_sz, bid_ct, ask_ct after it; 0 for an empty side.
    """
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    starts = np.flatnonzero(new_group | np.concatenate(([True], seq[1:] != seq[:-1])))
    event = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(seq))))
    number = np.cumsum(new_group) - 1
    last = np.append(event[np.flatnonzero(new_group)[1:]], len(starts))[number]  # the first event of the next group
    order = np.lexsort((event, price, side, number))
    side, price, number, event, last = side[order], price[order], number[order], event[order], last[order]
    new = np.concatenate(([True], (number[1:] != number[:-1]) | (side[1:] != side[:-1]) | (price[1:] != price[:-1])))
    level = np.cumsum(new) - 1

    def running(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x)
        return total - (total - x)[new][level]

    size, count = running(shares[order]), running(orders[order])
    end = np.where(np.append(new[1:], True), last, np.append(event[1:], 0))
    out = {}
    for s, name in ((0, "bid"), (1, "ask")):
        own = np.flatnonzero((side == s) & (count > 0) & (end > event))
        key = (price[own] if s == 0 else TOP_PRICE - price[own]) << PLACE | np.arange(len(own))
        best = covered(event[own], end[own], key, len(starts))
        there = best >= 0
        at = own[best[there] & ((1 << PLACE) - 1)]
        for column, values in (("px", price), ("sz", size), ("ct", count)):
            x = np.zeros(len(starts), np.int64)
            x[there] = values[at]
            out[f"{name}_{column}"] = x
    return starts, out


def by_groups(keys: int, work: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs `work` on whole groups of rows that are equal in their first `keys` columns and stand together: many small groups at a time, or one large one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, floor = 0, ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < floor:
                continue
            table = pa.Table.from_batches(held)
            changed = np.zeros(max(rows - 1, 0), bool)
            for i in range(keys):
                x = table.column(i).to_numpy()
                changed |= x[1:] != x[:-1]
            cuts = np.flatnonzero(changed)
            whole = int(cuts[-1]) + 1 if len(cuts) else 0
            if whole:
                yield from work(table.slice(0, whole)).to_batches()
            held = table.slice(whole).combine_chunks().to_batches()
            rows -= whole
            floor = max(ROWS, 2 * rows)  # a group that goes on is looked at again when it has doubled
        if rows:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return run
