"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many documents.

One symbol of every document is inserted in each round, last symbols first. A round reads the
transform and the common-prefix lengths of the last one from sequential files, finds the place of each new
suffix by the stable order of symbols, and writes both anew. Documents belong to groups whose
suffixes stand apart; a suffix ends with a terminator of its own, so no match runs over an end.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

END = 0  # terminators in the transform; symbols are 1 and above


class Column:
    """An array in a file, read and written from front to back."""

    def __init__(self, folder: str, name: str, kind: type):
        self.path, self.kind = os.path.join(folder, name), kind

    def read(self) -> np.ndarray:
        return np.fromfile(self.path, self.kind)

    def write(self, values: np.ndarray) -> None:
        values.astype(self.kind, copy=False).tofile(self.path)


def _order(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Positions by group, then symbol, then position."""
    first = np.argsort(symbols, kind="stable")
    return first[np.argsort(group[first], kind="stable")]


def _widen(values: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """values with new ones put in, which then stand at the places `at`."""
    out = np.empty(len(values) + len(at), values.dtype)
    old = np.ones(len(out), bool)
    old[at] = False
    out[old], out[at] = values, new
    return out


def repeated(texts: np.ndarray, lengths: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """For each document and start, whether its next `least` symbols also start elsewhere in its group.

    texts: documents as rows of symbols of 1 to 65535, padded at the right; lengths: of each;
    group: of each, ascending from 0 and below 65536. Returns a boolean array of the shape of texts.
    """
    n, most = texts.shape
    marks = np.zeros((n, most), bool)
    if not n or least > most:
        return marks
    cap = min(least, 255)
    groups = int(group[-1]) + 1
    members = np.bincount(group, minlength=groups)
    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = Column(folder, "transform", np.uint16), Column(folder, "prefixes", np.uint8)
        last = np.where(lengths > 0, texts[np.arange(n), np.maximum(lengths - 1, 0)], END)
        bwt.write(last)
        lcp.write(np.zeros(n, np.uint8))
        at = np.arange(n)  # of each document's newest suffix
        held = group.astype(np.uint16)  # the groups of all suffixes in their order
        for j in range(1, int(lengths.max(initial=0)) + 1):
            symbols, common = bwt.read(), lcp.read()
            order = _order(symbols, held)
            active = np.flatnonzero(lengths >= j)
            waits = np.zeros(len(symbols), bool)
            waits[at[active]] = True
            owner = np.empty(len(symbols), np.int64)
            owner[at[active]] = active
            turn = np.flatnonzero(waits[order])  # new suffixes, in their order
            who = owner[order[turn]]
            size = np.bincount(held, minlength=groups)
            ended = np.bincount(held[symbols == END], minlength=groups)
            grown = np.cumsum(np.concatenate([[0], np.bincount(group[active], minlength=groups)[:-1]]))
            shift = grown + members - ended  # from an entry's turn to the place of the suffix that it begins
            place = turn + shift[group[who]]
            # common prefixes: one more than the least between the two entries, if they hold the same symbol
            again = np.unique(np.concatenate([turn, turn + 1]))
            again = again[again < len(order)]
            again = again[symbols[order[again]] != END]
            p, q = order[again], order[np.maximum(again - 1, 0)]
            same = (again > 0) & (symbols[p] == symbols[q]) & (held[p] == held[q])
            value = np.zeros(len(again), np.int64)
            if same.any():
                bounds = np.stack([q[same] + 1, p[same] + 1], axis=1)[::-1].ravel()
                value[same] = 1 + np.minimum.reduceat(np.append(common, 0), bounds)[::2][::-1].astype(np.int64)
            where = again + shift[held[p]]
            nexts = np.where(lengths[who] > j, texts[who, np.maximum(lengths[who] - j - 1, 0)], END)
            symbols = _widen(symbols, place, nexts.astype(np.uint16))
            common = _widen(common, place, np.zeros(len(place), np.uint8))
            common[where] = np.minimum(value, cap)
            held = np.repeat(np.arange(groups, dtype=np.uint16), size + np.bincount(group[active], minlength=groups))
            at[who] = place
            bwt.write(symbols)
            lcp.write(common)
        symbols, common = bwt.read(), lcp.read()
    near = common >= least if least <= cap else common >= cap
    near |= np.append(near[1:], False)
    # walk every document back from its terminator
    order = _order(symbols, held)
    ended = np.bincount(held[symbols == END], minlength=groups)
    step = np.empty(len(symbols), np.int64)
    step[order] = np.arange(len(order)) + (members - ended)[held[order]]
    first = np.concatenate([[0], np.cumsum(np.bincount(held, minlength=groups))[:-1]])
    inside = np.arange(n) - np.concatenate([[0], np.cumsum(members)[:-1]])[group]
    now = first[group] + inside
    for j in range(1, int(lengths.max(initial=0)) + 1):
        live = np.flatnonzero(lengths >= j)
        now[live] = step[now[live]]
        marks[live, lengths[live] - j] = near[now[live]]
    return marks
