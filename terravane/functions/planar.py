"""Plane geometry on numpy arrays: shapes from text, how two shapes relate, and areas put together.

Relations follow from where the parts of one shape lie with respect to the other: its lines are cut where they meet the
lines of the other, so that every piece lies inside, outside or on the rim as a whole, and its middle tells which. Areas are
put together in horizontal slabs between all corners and crossings, in which no two edges cross: an area is the set of spans
between edges where a condition on both shapes holds. Spans between the same two edges are one piece, so a result is a set of
trapezoids that share rims but no inside. Self-crossing rings are read by the even-odd rule.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

OUT, RIM, IN = 0, 1, 2
RELATIONS = ("intersects", "within", "contains", "covers", "covered_by", "crosses", "touches", "overlaps")
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")

Ring = np.ndarray
Polygon = list[Ring]


@dataclass
class Shape:
    """Points, lines and polygons (outer ring first) of one geometry."""

    points: np.ndarray = field(default_factory=lambda: np.empty((0, 2)))
    lines: list[np.ndarray] = field(default_factory=list)
    polygons: list[Polygon] = field(default_factory=list)

    @property
    def dimension(self) -> int:
        return 2 if self.polygons else 1 if self.lines else 0 if len(self.points) else -1

    def chains(self) -> list[np.ndarray]:
        return self.lines + [np.vstack([r, r[:1]]) for p in self.polygons for r in p]

    def corners(self) -> np.ndarray:
        return np.vstack([self.points, *self.chains()])

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        chains = self.chains()
        if not chains:
            return np.empty((0, 2)), np.empty((0, 2))
        a, b = np.vstack([c[:-1] for c in chains]), np.vstack([c[1:] for c in chains])
        real = (a != b).any(axis=1)
        return a[real], b[real]

    def ends(self) -> np.ndarray:
        """Rim of the lines: end points that belong to an odd number of lines."""
        tips = [p for line in self.lines for p in (line[0], line[-1])]
        if not tips:
            return np.empty((0, 2))
        at, n = np.unique(np.array(tips), axis=0, return_counts=True)
        return at[n % 2 == 1]

    def box(self) -> tuple[float, float, float, float] | None:
        c = self.corners()
        return (*c.min(axis=0), *c.max(axis=0)) if len(c) else None


def _closed(ring: list) -> Ring:
    r = np.array(ring, float)[:, :2]
    return r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r


def _add(shape: Shape, kind: str, c: list) -> None:
    if kind == "POINT" and len(c):
        shape.points = np.vstack([shape.points, np.array(c, float)[None, :2]])
    elif kind == "LINESTRING" and len(c) > 1:
        shape.lines.append(np.array(c, float)[:, :2])
    elif kind == "POLYGON" and c and len(c[0]) >= 3:
        shape.polygons.append([_closed(r) for r in c if len(r) >= 3])
    elif kind.startswith("MULTI"):
        for part in c:
            _add(shape, kind[5:], part)


def _nested(text: str) -> list:
    """The brackets of well-known text as lists; a bracket of bare numbers is a list of positions."""
    made, stack, at = [], [], 0
    for m in re.finditer(r"[()]|[^()]+", text):
        t = m.group()
        if t == "(":
            stack.append(made)
            made = []
        elif t == ")":
            inner, made = made, stack.pop()
            made.append(inner)
        elif _NUMBER.search(t):
            made += [[float(x) for x in _NUMBER.findall(p)] for p in t.split(",") if p.strip()]
        at = m.end()
    return made[0] if made and at else []


def _wkt(shape: Shape, text: str) -> None:
    m = re.match(r"\s*(?:SRID\s*=\s*\d+\s*;)?\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*(?:ZM|Z|M)?\s*(\(.*\))\s*$", text, re.IGNORECASE | re.DOTALL)
    if not m:
        return
    multi, kind, parts = bool(m.group(1)), m.group(2).upper(), _nested(m.group(3))
    if kind == "POINT":
        for p in parts:
            _add(shape, kind, p[0] if isinstance(p[0], list) else p)
    else:
        for p in parts if multi else [parts]:
            _add(shape, kind, p)


def _geojson(shape: Shape, g: dict | None) -> None:
    g = g or {}
    kind = str(g.get("type", ""))
    if kind == "Feature":
        _geojson(shape, g.get("geometry"))
    elif kind == "FeatureCollection":
        for f in g.get("features") or []:
            _geojson(shape, f)
    elif kind == "GeometryCollection":
        for part in g.get("geometries") or []:
            _geojson(shape, part)
    else:
        _add(shape, kind.upper(), g.get("coordinates") or [])


@lru_cache(4_096)
def read(text: str | None) -> Shape:
    """Shape of GeoJSON or well-known text; unreadable and empty text gives a shape of nothing."""
    shape = Shape()
    try:
        if text and text.lstrip().startswith("{"):
            _geojson(shape, json.loads(text))
        elif text:
            _wkt(shape, text)
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):
        return Shape()
    return shape if np.isfinite(shape.corners()).all() else Shape()


def _off(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each point to each segment."""
    d = b - a
    t = np.clip(((p[:, None] - a) * d).sum(axis=2) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
    return np.hypot(*np.moveaxis(p[:, None] - (a + t[..., None] * d), 2, 0))


def _inside(p: np.ndarray, polygon: Polygon) -> np.ndarray:
    """Even-odd over all rings; points on a rim may come out either way."""
    hit = np.zeros(len(p), bool)
    for r in polygon:
        a, b = r, np.roll(r, -1, axis=0)
        spans = (a[:, 1] > p[:, 1, None]) != (b[:, 1] > p[:, 1, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 0] + (p[:, 1, None] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        hit ^= (spans & (p[:, 0, None] < x)).sum(axis=1) % 2 == 1
    return hit


def where(p: np.ndarray, shape: Shape, tol: float) -> np.ndarray:
    """OUT, RIM or IN for each point: in an area, on a line but at none of its ends, at one of the points."""
    code = np.zeros(len(p), int)
    if not len(p):
        return code
    if len(shape.points):
        code[(np.abs(p[:, None] - shape.points).max(axis=2) <= tol).any(axis=1)] = IN
    for line in shape.lines:
        code[(_off(p, line[:-1], line[1:]) <= tol).any(axis=1)] = IN
    ends = shape.ends()
    if len(ends):
        code[(np.abs(p[:, None] - ends).max(axis=2) <= tol).any(axis=1)] = RIM
    for polygon in shape.polygons:
        rim = np.zeros(len(p), bool)
        for r in polygon:
            rim |= (_off(p, r, np.roll(r, -1, axis=0)) <= tol).any(axis=1)
        code = np.maximum(code, np.where(rim, RIM, np.where(_inside(p, polygon), IN, OUT)))
    return code


def _meets(a: Shape, b: Shape, tol: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Points where the lines of a meet those of b, and the places along each segment of a where it has to be cut."""
    (p, q), (r, s) = a.segments(), b.segments()
    cuts = [[0.0, 1.0] for _ in range(len(p))]
    if not len(p) or not len(r):
        return np.empty((0, 2)), [np.array(c) for c in cuts]
    d, e = (q - p)[:, None], (s - r)[None]
    gap = r[None] - p[:, None]
    cross = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    lengths = np.hypot(d[..., 0], d[..., 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * e[..., 1] - gap[..., 1] * e[..., 0]) / cross
        u = (gap[..., 0] * d[..., 1] - gap[..., 1] * d[..., 0]) / cross
    slack_t, slack_u = tol / lengths, tol / np.hypot(e[..., 0], e[..., 1])
    hit = (np.abs(cross) > 1e-14 * lengths * np.hypot(e[..., 0], e[..., 1])) & (t >= -slack_t) & (t <= 1 + slack_t) & (u >= -slack_u) & (u <= 1 + slack_u)
    found = []
    for i, j in zip(*np.nonzero(hit)):
        cuts[i].append(float(np.clip(t[i, j], 0, 1)))
        found.append(p[i] + cuts[i][-1] * (q[i] - p[i]))
    for ends in (r, s):  # corners of b on lines of a, which also cuts where both run along each other
        for j, i in zip(*np.nonzero(_off(ends, p, q) <= tol)):
            w = q[i] - p[i]
            cuts[i].append(float(np.clip(((ends[j] - p[i]) * w).sum() / (w * w).sum(), 0, 1)))
            found.append(ends[j])
    return np.array(found).reshape(-1, 2), [np.unique(c) for c in cuts]


def _pieces(a: Shape, cuts: list[np.ndarray], tol: float) -> np.ndarray:
    """Middles of the pieces of a's lines."""
    p, q = a.segments()
    out = []
    for x, y, c in zip(p, q, cuts):
        long_enough = np.diff(c) * np.hypot(*(y - x)) > 4 * tol
        mid = ((c[1:] + c[:-1]) / 2)[long_enough]
        out.append(x + mid[:, None] * (y - x))
    return np.vstack(out) if out else np.empty((0, 2))


def _within_each(a: Shape) -> np.ndarray:
    """A point inside each polygon: the middle of its widest span at a height between corners."""
    out = []
    for polygon in a.polygons:
        ys = np.unique(np.concatenate([r[:, 1] for r in polygon]))
        best, at = 0.0, None
        for y in (ys[1:] + ys[:-1]) / 2:
            xs = np.sort(np.concatenate([_crossings(r, y) for r in polygon]))
            for x0, x1 in zip(xs[::2], xs[1::2]):
                if x1 - x0 > best:
                    best, at = x1 - x0, ((x0 + x1) / 2, y)
        if at is not None:
            out.append(at)
    return np.array(out).reshape(-1, 2)


def _crossings(r: Ring, y: float) -> np.ndarray:
    a, b = r, np.roll(r, -1, axis=0)
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[spans], b[spans]
    return a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])


def relate(a: Shape, b: Shape) -> dict[str, bool]:
    """Which of RELATIONS hold between a and b; none for a shape of nothing."""
    no = dict.fromkeys(RELATIONS, False)
    box_a, box_b = a.box(), b.box()
    if box_a is None or box_b is None or box_a[0] > box_b[2] or box_b[0] > box_a[2] or box_a[1] > box_b[3] or box_b[1] > box_a[3]:
        return no
    tol = 1e-12 * max(1.0, *(abs(v) for v in (*box_a, *box_b)))
    for one, other, names in ((a, b, ("within", "covered_by")), (b, a, ("contains", "covers"))):
        if one.dimension == 0 and len(one.points) == 1 and other.dimension > 0 and not len(other.points):  # a point and lines or areas
            code = where(one.points, other, tol)[0]
            held = {"intersects"} | (set(names) if code == IN else {"touches", names[1]})
            return {k: code != OUT and k in held for k in RELATIONS}
    nodes, cuts_a = _meets(a, b, tol)
    _, cuts_b = _meets(b, a, tol)
    in_b = np.concatenate([where(_pieces(a, cuts_a, tol), b, tol), where(a.points, b, tol)])
    in_a = np.concatenate([where(_pieces(b, cuts_b, tol), a, tol), where(b.points, a, tol)])
    heart_a, heart_b = where(_within_each(a), b, tol), where(_within_each(b), a, tol)
    da, db = a.dimension, b.dimension
    insides = bool((heart_a == IN).any() or (heart_b == IN).any())
    if da < 2:
        insides |= bool((in_b == IN).any())
    if db < 2:
        insides |= bool((in_a == IN).any())
    if da == 2 and db == 2:
        insides |= bool((in_b == IN).any() or (in_a == IN).any())
    along = da == 1 and db == 1 and bool((in_b == IN).any())
    if da == 1 and db == 1 and not insides and len(nodes):
        insides = bool(((where(nodes, a, tol) == IN) & (where(nodes, b, tol) == IN)).any())
    meets = insides or bool(len(nodes) or (in_b != OUT).any() or (in_a != OUT).any())
    if not meets:
        return no
    covered = bool((in_b != OUT).all()) and (da <= db) and not (da == 2 and ((in_a == IN).any() or (heart_a == OUT).any()))
    covers = bool((in_a != OUT).all()) and (db <= da) and not (db == 2 and ((in_b == IN).any() or (heart_b == OUT).any()))
    a_out, b_out = bool((in_b == OUT).any()), bool((in_a == OUT).any())
    crosses = (insides and a_out if da < db else insides and b_out if db < da else da == 1 and insides and not along)
    overlaps = da == db and (insides and not covered and not covers if da == 2 else along and a_out and b_out if da == 1 else insides and a_out and b_out)
    return {
        "intersects": True, "within": covered and insides, "contains": covers and insides, "covers": covers, "covered_by": covered,
        "crosses": bool(crosses), "touches": not insides and max(da, db) > 0, "overlaps": bool(overlaps),
    }


def _breaks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights of all corners and crossings of the edges."""
    d = b - a
    out = [a[:, 1], b[:, 1]]
    for i in range(len(a) - 1):
        e, gap = d[i + 1 :], a[i + 1 :] - a[i]
        cross = d[i, 0] * e[:, 1] - d[i, 1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * e[:, 1] - gap[:, 1] * e[:, 0]) / cross
            u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / cross
        hit = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        out.append(a[i, 1] + t[hit] * d[i, 1])
    return np.unique(np.concatenate(out))


def combine(a: list[Polygon], b: list[Polygon], keep: Callable[[bool, bool], bool]) -> list[Ring]:
    """Pieces of the plane where ``keep(in a, in b)`` holds; a and b are unions of their polygons. keep(False, False) must not hold."""
    edges = [(p, q, k, side) for side, many in enumerate((a, b)) for k, polygon in enumerate(many) for r in polygon for p, q in zip(r, np.roll(r, -1, axis=0)) if p[1] != q[1]]
    if not edges:
        return []
    low = np.array([p if p[1] < q[1] else q for p, q, _, _ in edges])
    high = np.array([q if p[1] < q[1] else p for p, q, _, _ in edges])
    owner = [(side, k) for _, _, k, side in edges]
    slope = (high[:, 0] - low[:, 0]) / (high[:, 1] - low[:, 1])
    at = lambda i, y: low[i, 0] + (y - low[i, 1]) * slope[i]
    ys = _breaks(low, high)
    made: list[Ring] = []
    going: dict[tuple[int, int], float] = {}

    def close(pair: tuple[int, int], y0: float, y1: float) -> None:
        i, j = pair
        ring = [(at(i, y0), y0), (at(j, y0), y0), (at(j, y1), y1), (at(i, y1), y1)]
        ring = [p for n, p in enumerate(ring) if p != ring[n - 1]]
        if len(ring) >= 3:
            made.append(np.array(ring))

    for y0, y1 in zip(ys[:-1], ys[1:]):
        mid = (y0 + y1) / 2
        here = np.flatnonzero((low[:, 1] <= y0) & (high[:, 1] >= y1))
        order = here[np.argsort(low[here, 0] + (mid - low[here, 1]) * slope[here], kind="stable")]
        inside: tuple[set, set] = (set(), set())
        spans, start, held = set(), -1, False
        for e in order:
            side, k = owner[e]
            inside[side].symmetric_difference_update({k})
            now = keep(bool(inside[0]), bool(inside[1]))
            if now and not held:
                start = int(e)
            elif held and not now:
                spans.add((start, int(e)))
            held = now
        for pair in [p for p in going if p not in spans]:
            close(pair, going.pop(pair), y0)
        for pair in spans:
            going.setdefault(pair, y0)
    for pair, y0 in going.items():
        close(pair, y0, float(ys[-1]))
    return made


OVERLAYS: dict[str, Callable[[bool, bool], bool]] = {
    "intersection": lambda x, y: x and y, "union": lambda x, y: x or y, "difference": lambda x, y: x and not y, "symmetric_difference": lambda x, y: x != y,
}


def ring_area(r: Ring) -> float:
    x, y = r[:, 0], r[:, 1]
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def total_area(pieces: list[Ring]) -> float:
    return float(sum(map(ring_area, pieces)))


def to_geojson(pieces: list[Ring]) -> str:
    return json.dumps({"type": "MultiPolygon", "coordinates": [[np.vstack([r, r[:1]]).tolist()] for r in pieces]})


def crossing_itself(shape: Shape) -> bool:
    """Whether two edges of one polygon cross away from their ends."""
    for polygon in shape.polygons:
        a, b = np.vstack(polygon), np.vstack([np.roll(r, -1, axis=0) for r in polygon])
        d = b - a
        for i in range(len(a) - 1):
            e, gap = d[i + 1 :], a[i + 1 :] - a[i]
            cross = d[i, 0] * e[:, 1] - d[i, 1] * e[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = (gap[:, 0] * e[:, 1] - gap[:, 1] * e[:, 0]) / cross
                u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / cross
            if ((t > 1e-12) & (t < 1 - 1e-12) & (u > 1e-12) & (u < 1 - 1e-12)).any():
                return True
    return False


def buffered(shape: Shape, radius: float, corners: int = 32) -> list[Ring]:
    """Pieces of all places at most ``radius`` away, rounded off by ``corners`` points a circle; corners must be even."""
    angles = np.arange(corners) * (2 * np.pi / corners)
    parts: list[Polygon] = [[p + radius * np.stack([np.cos(angles), np.sin(angles)], axis=1)] for p in shape.points]
    half = np.arange(corners // 2 + 1) * (2 * np.pi / corners)
    for p, q in zip(*shape.segments()):
        turn = np.arctan2(*(q - p)[::-1])
        arc = lambda c, start: c + radius * np.stack([np.cos(start + half), np.sin(start + half)], axis=1)
        parts.append([np.vstack([arc(q, turn - np.pi / 2), arc(p, turn + np.pi / 2)])])
    return combine(parts + shape.polygons, [], OVERLAYS["union"])
