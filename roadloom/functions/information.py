"""The maximal information coefficient of counted cells.

For a grid of x columns and q rows the mutual information, divided by the logarithm of the smaller of both,
says how much of one axis the other tells; the coefficient is the largest such value over all grids of
up to B cells. Rows are cut into parts of equal weight, and the best columns are found by a dynamic
program over clumps, the runs of values that no best column would cut; then the axes change places.
"""

from __future__ import annotations

import numpy as np


def equal_parts(weights: np.ndarray, parts: int) -> np.ndarray:
    """The part of each weight when they are dealt in order into parts as equal as whole weights allow."""
    total, done, part, held = float(weights.sum()), 0.0, 0, 0.0
    aim, out = total / parts, np.empty(len(weights), np.int64)
    for i, w in enumerate(weights.tolist()):
        if held and abs(held + w - aim) >= abs(held - aim):
            part, held = part + 1, 0.0
            aim = (total - done) / max(1, parts - part)
        out[i], held, done = part, held + w, done + w
    return out


def clumps(table: np.ndarray) -> np.ndarray:
    """The clump of each value (line of a table of counts by row of the grid): values whose points are all in one row join those beside."""
    home = np.where((table > 0).sum(axis=1) == 1, table.argmax(axis=1), -1)
    new = np.ones(len(table), bool)
    new[1:] = (home[1:] != home[:-1]) | (home[1:] < 0)
    return np.cumsum(new) - 1


def _x_log_x(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n * np.log2(np.maximum(n, 1e-300)), 0.0)


def _merged(table: np.ndarray, group: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table, np.flatnonzero(np.append(True, group[1:] != group[:-1])), axis=0)


def best_columns(table: np.ndarray, most: int) -> np.ndarray:
    """Mutual information in bits with the rows of the best 2, 3, ... most columns of consecutive lines of a table of counts."""
    upto = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table, axis=0)])
    whole = upto.sum(axis=1)
    gain = -_x_log_x(np.maximum(whole[None] - whole[:, None], 0.0))
    for row in upto.T:
        gain += _x_log_x(np.maximum(row[None] - row[:, None], 0.0))
    gain[np.tril_indices(len(whole))] = -np.inf
    n = whole[-1]
    own = -_x_log_x(upto[-1] / n).sum()  # entropy of the rows
    best, out = gain[0], []
    for _ in range(2, most + 1):
        best = np.maximum(best, (best[:, None] + gain).max(axis=0))
        out.append(own + best[-1] / n)
    return np.array(out)


def coefficient(x: np.ndarray, y: np.ndarray, n: np.ndarray, alpha: float = 0.6, finer: int = 15, most_cells: int | None = None) -> float:
    """MIC of cells (x, y: places of the values in their order, n: how many points).

    Grids have up to max(points ** alpha, 4) cells and no more than most_cells; clumps are joined to
    ``finer`` times as many as there are columns.
    """
    total = float(n.sum())
    if total <= 0:
        return 0.0
    _, x = np.unique(x, return_inverse=True)
    _, y = np.unique(y, return_inverse=True)
    cells = max(total**alpha, 4.0)
    cells = int(cells if most_cells is None else min(cells, most_cells))
    best = 0.0
    for a, b in ((x, y), (y, x)):
        weight = np.bincount(b, n)
        for rows in range(2, cells // 2 + 1):
            row = equal_parts(weight, rows)
            found = int(row[-1]) + 1
            if found < 2:
                continue
            table = np.zeros((int(a.max()) + 1, found))
            np.add.at(table, (a, row[b]), n)
            most = cells // rows
            table = _merged(table, clumps(table))
            if len(table) > finer * most:
                table = _merged(table, equal_parts(table.sum(axis=1), finer * most))
            if len(table) < 2:
                continue
            got = best_columns(table, most)
            best = max(best, float((got / np.log2(np.minimum(np.arange(2, most + 1), rows))).max()))
    return min(best, 1.0)
