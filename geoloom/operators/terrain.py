"""Terrain kernels on one tile as NumPy arrays (NaN is nodata), from the published algorithms.

Fill, flow and line-of-sight steps are inherently sequential within a tile; everything here works tile by tile, on the
tile with its overlap.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Offsets (row, col) of the eight neighbours, clockwise from east.
EIGHT = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def gaussian(z: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Smoothing out to three sigmas over the cells with a value."""
    half = max(1, int(np.ceil(3 * sigma)))
    weight = np.exp(-np.arange(-half, half + 1) ** 2 / (2 * sigma * sigma))
    known = ~np.isnan(z)

    def spread(a: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            padded = np.pad(a, [(half, half) if k == axis else (0, 0) for k in (0, 1)])
            n = a.shape[axis]
            a = sum(w * np.take(padded, np.arange(k, k + n), axis=axis) for k, w in enumerate(weight))
        return a

    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(known, spread(np.where(known, z, 0.0)) / spread(known.astype(float)), np.nan)


def fill_depressions(z: np.ndarray) -> np.ndarray:
    """Smallest surface above ``z`` from which every cell drains to the edge or to nodata (priority-flood, Barnes et al. 2014)."""
    rows, cols = z.shape
    known = ~np.isnan(z)
    out, done = z.copy(), ~known
    heap: list[tuple[float, int, int]] = []
    outlet = np.zeros_like(known)
    outlet[[0, -1], :] = outlet[:, [0, -1]] = True
    beside = np.pad(~known, 1)
    for dr, dc in EIGHT:
        outlet |= beside[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols]
    for r, c in zip(*np.nonzero(outlet & known), strict=True):
        heapq.heappush(heap, (float(z[r, c]), int(r), int(c)))
        done[r, c] = True
    while heap:
        level, r, c = heapq.heappop(heap)
        for dr, dc in EIGHT:
            a, b = r + dr, c + dc
            if 0 <= a < rows and 0 <= b < cols and not done[a, b]:
                done[a, b] = True
                out[a, b] = max(out[a, b], level)
                heapq.heappush(heap, (float(out[a, b]), a, b))
    return out


def _gradient_parts(z: np.ndarray) -> dict[str, np.ndarray]:
    """The eight neighbours; a missing one counts as the centre."""
    rows, cols = z.shape
    padded = np.pad(z, 1, constant_values=np.nan)
    names = ("e", "se", "s", "sw", "w", "nw", "n", "ne")
    near = {n: padded[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols] for n, (dr, dc) in zip(names, EIGHT, strict=True)}
    return {n: np.where(np.isnan(a), z, a) for n, a in near.items()}


def slope(z: np.ndarray, pixel: float = 30.0) -> np.ndarray:
    """Degrees, by Horn's (1981) third-order differences."""
    p = _gradient_parts(z)
    dx = ((p["ne"] + 2 * p["e"] + p["se"]) - (p["nw"] + 2 * p["w"] + p["sw"])) / (8 * pixel)
    dy = ((p["sw"] + 2 * p["s"] + p["se"]) - (p["nw"] + 2 * p["n"] + p["ne"])) / (8 * pixel)
    return np.degrees(np.arctan(np.hypot(dx, dy)))


def profile_curvature(z: np.ndarray, pixel: float = 30.0) -> np.ndarray:
    """Zevenbergen and Thorne (1987); 0 on flat ground."""
    p, h = _gradient_parts(z), pixel
    d, e = ((p["w"] + p["e"]) / 2 - z) / h**2, ((p["n"] + p["s"]) / 2 - z) / h**2
    f = (p["ne"] + p["sw"] - p["nw"] - p["se"]) / (4 * h**2)
    g, k = (p["e"] - p["w"]) / (2 * h), (p["n"] - p["s"]) / (2 * h)
    steep = g * g + k * k
    with np.errstate(invalid="ignore", divide="ignore"):
        curve = -2 * (d * g * g + e * k * k + f * g * k) / steep
    return np.where(np.isnan(z), np.nan, np.where(steep > 0, curve, 0.0))


def flow_direction(z: np.ndarray) -> np.ndarray:
    """Index into EIGHT of the steepest descent (O'Callaghan and Mark 1984), -1 for none; equals go to the first."""
    rows, cols = z.shape
    padded = np.pad(z, 1, constant_values=np.nan)
    best, to = np.zeros(z.shape), np.full(z.shape, -1)
    for k, (dr, dc) in enumerate(EIGHT):
        drop = (z - padded[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols]) / np.hypot(dr, dc)
        better = np.nan_to_num(drop, nan=-1.0) > best
        best, to = np.where(better, drop, best), np.where(better, k, to)
    return to


def flow_accumulation(z: np.ndarray) -> np.ndarray:
    """Number of cells that drain through each cell, itself included; cells are taken from the highest down."""
    rows, cols = z.shape
    to = flow_direction(z).ravel()
    offset = np.array([dr * cols + dc for dr, dc in EIGHT])
    acc = np.where(np.isnan(z), 0.0, 1.0).ravel()
    flat = z.ravel()
    for cell in np.argsort(-np.where(np.isnan(flat), -np.inf, flat), kind="stable"):
        if to[cell] >= 0:
            acc[cell + offset[to[cell]]] += acc[cell]
    return np.where(np.isnan(z), np.nan, acc.reshape(z.shape))


#: Forms by (number of lower, number of higher) directions, after Jasiewicz and Stepinski (2013): 1 flat, 2 peak, 3 ridge,
#: 4 shoulder, 5 spur, 6 slope, 7 hollow, 8 footslope, 9 valley, 10 pit. Rows are lower counts 0 to 8.
FORMS = (
    (1, 1, 1, 8, 8, 9, 9, 9, 10),
    (1, 1, 8, 8, 8, 9, 9, 9, 0),
    (1, 4, 6, 6, 7, 7, 9, 0, 0),
    (4, 4, 6, 6, 6, 7, 0, 0, 0),
    (4, 4, 5, 6, 6, 0, 0, 0, 0),
    (3, 3, 5, 5, 0, 0, 0, 0, 0),
    (3, 3, 3, 0, 0, 0, 0, 0, 0),
    (3, 3, 0, 0, 0, 0, 0, 0, 0),
    (2, 0, 0, 0, 0, 0, 0, 0, 0),
)


def geomorphons(z: np.ndarray, search: int = 100, threshold: float = 1.0, skip: int = 0, pixel: float = 30.0) -> np.ndarray:
    """Ten land forms from the lines of sight in eight directions.

    In each direction the largest elevation angle and the smallest are sought over ``search`` cells; a direction is
    higher if the zenith angle is less than the nadir angle by more than ``threshold`` degrees, lower if greater.
    """
    rows, cols = z.shape
    lower, higher = np.zeros(z.shape, np.int64), np.zeros(z.shape, np.int64)
    for dr, dc in EIGHT:
        step = np.hypot(dr, dc) * pixel
        most, least = np.full(z.shape, -np.inf), np.full(z.shape, np.inf)
        for k in range(1 + skip, min(search, max(rows, cols)) + 1):
            r0, r1 = max(0, -k * dr), min(rows, rows - k * dr)
            c0, c1 = max(0, -k * dc), min(cols, cols - k * dc)
            if r0 >= r1 or c0 >= c1:
                break
            here = np.s_[r0:r1, c0:c1]
            angle = np.degrees(np.arctan((z[r0 + k * dr : r1 + k * dr, c0 + k * dc : c1 + k * dc] - z[here]) / (k * step)))
            most[here], least[here] = np.fmax(most[here], angle), np.fmin(least[here], angle)
        seen = np.isfinite(most)
        zenith, nadir = 90 - np.where(seen, most, 0.0), 90 + np.where(seen, least, 0.0)
        higher += seen & (nadir - zenith > threshold)
        lower += seen & (zenith - nadir > threshold)
    return np.where(np.isnan(z), np.nan, np.array(FORMS, float)[lower, higher])


def label(mask: np.ndarray) -> np.ndarray:
    """Number of each cell's 4-connected component (0 off the mask): smallest labels spread until they stand still."""
    numbers = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        near = np.where(mask, numbers, mask.size + 2)
        padded = np.pad(near, 1, constant_values=mask.size + 2)
        low = np.minimum.reduce([near, padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
        low = np.where(mask, low, 0)
        flat = np.r_[0, low.ravel()]
        low = flat[low]  # follow the label's own cell
        if (low == numbers).all():
            return numbers
        numbers = low


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    """The mask without components of fewer cells than ``least``."""
    numbers = label(mask)
    count = np.bincount(numbers.ravel(), minlength=numbers.max() + 1)
    return mask & (count[numbers] >= least)


def thin(mask: np.ndarray) -> np.ndarray:
    """One-cell-wide lines by the two sub-iterations of Zhang and Suen (1984)."""
    out = mask.astype(np.uint8)
    while True:
        changed = False
        for odd in (False, True):
            p = np.pad(out, 1)
            n = [p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]]
            total = sum(a.astype(int) for a in n)
            turns = sum(((n[k] == 0) & (n[(k + 1) % 8] == 1)).astype(int) for k in range(8))
            first, second = (n[0] * n[2] * n[6], n[0] * n[4] * n[6]) if odd else (n[0] * n[2] * n[4], n[2] * n[4] * n[6])
            gone = (out == 1) & (total >= 2) & (total <= 6) & (turns == 1) & (first == 0) & (second == 0)
            if gone.any():
                out[gone] = 0
                changed = True
        if not changed:
            return out.astype(bool)


def ridges(forms: np.ndarray, ridge_size: int = 30, acc: np.ndarray | None = None, max_acc: float = 2) -> np.ndarray:
    """1 on ridges: classes 1 to 3 in components of ``ridge_size`` or more, thinned and without single cells; with an
    accumulation instead those of them with less than ``max_acc``."""
    with np.errstate(invalid="ignore"):
        mask = without_small((forms > 0) & (forms < 4), ridge_size)
        if acc is not None:
            return (mask & (np.maximum(np.nan_to_num(acc, nan=0.0), 0) < max_acc)).astype(float)
    return without_small(thin(mask), 2).astype(float)
