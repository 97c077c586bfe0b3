"""Convex hulls: the monotone chain, over points and over arrays of points."""

from __future__ import annotations

import numpy as np


def convex_hull(points) -> list[tuple[float, float]]:
    """Counter-clockwise from the lowest-leftmost point, without points on edges."""
    pts = sorted({(float(x), float(y)) for x, y in points})
    if len(pts) < 3:
        return pts

    def chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return chain(pts)[:-1] + chain(pts[::-1])[:-1]


def hull_points(xy: np.ndarray) -> np.ndarray:
    """convex_hull of an array of points (n, 2); most points inside are dropped in array operations first."""
    if len(xy) > 16:
        x, y = xy[:, 0], xy[:, 1]
        at = [int(f(v)) for f, v in ((np.argmin, x), (np.argmin, x + y), (np.argmin, y), (np.argmax, x - y), (np.argmax, x), (np.argmax, x + y), (np.argmax, y), (np.argmin, x - y))]
        frame = convex_hull(xy[at].tolist())  # what lies strictly inside this is no corner of the whole
        if len(frame) > 2:
            inside = np.ones(len(xy), dtype=bool)
            for (ax, ay), (bx, by) in zip(frame, frame[1:] + frame[:1]):
                inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0
            xy = xy[~inside]
    return np.array(convex_hull(xy.tolist()), dtype=np.float64).reshape(-1, 2)
