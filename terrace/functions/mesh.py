"""Delaunay triangles of a few points in one task, with exact decisions."""

from __future__ import annotations

from fractions import Fraction

Point = tuple[float, float]
_OUT = -1  # the vertex beyond the hull
_ORIENT_ERROR, _CIRCLE_ERROR = 4e-16, 2e-15


def orient(a: Point, b: Point, c: Point) -> int:
    """1 if a, b, c turn left, -1 if right, 0 if they are in line."""
    p, q = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    d = p - q
    if abs(d) <= _ORIENT_ERROR * (abs(p) + abs(q)):
        (ax, ay), (bx, by), (cx, cy) = ((Fraction(v[0]), Fraction(v[1])) for v in (a, b, c))
        d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def _lifted(a, b, c, d):
    """Determinant that is positive if d lies in the circle of a, b, c, and the size of its terms."""
    rows = [(p[0] - d[0], p[1] - d[1]) for p in (a, b, c)]
    total = size = 0
    for i in range(3):
        (x, y), (u, v), (s, t) = rows[i], rows[(i + 1) % 3], rows[(i + 2) % 3]
        lift = x * x + y * y
        total += lift * (u * t - v * s)
        size += lift * (abs(u * t) + abs(v * s))
    return total, size


def in_circle(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether d lies in the circle through a, b, c, which turn left.

    Points on one circle are told apart as if each were lifted by an infinitely small
    height of its own, far smaller for each point further on in the order of (x, y). So
    the triangles of any set of points are unique, whatever else is triangulated with them.
    """
    total, size = _lifted(a, b, c, d)
    if abs(total) > _CIRCLE_ERROR * size:
        return total > 0
    total, _ = _lifted(*((Fraction(p[0]), Fraction(p[1])) for p in (a, b, c, d)))
    if total:
        return total > 0
    # A lifted d is further out; a lifted corner makes room for d on the side of the corners opposite.
    signs = {d: -1, a: orient(d, b, c), b: orient(a, d, c), c: orient(a, b, d)}
    for point in sorted(signs):
        if signs[point]:
            return signs[point] > 0
    return False


class Mesh:
    """Triangles as a table from each directed edge to the corner on its left; hull edges have the corner ``_OUT`` outside."""

    def __init__(self, points: list[Point]) -> None:
        self.points = points
        self.apex: dict[tuple[int, int], int] = {}
        order = list(range(len(points)))
        third = next((k for k in order[2:] if orient(points[0], points[1], points[k])), None)
        if third is None:
            return
        a, b, c = (0, 1, third) if orient(points[0], points[1], points[third]) > 0 else (1, 0, third)
        for u, v, w in ((a, b, c), (b, a, _OUT), (c, b, _OUT), (a, c, _OUT)):
            self._add(u, v, w)
        self.last = (a, b)
        for k in order[2:]:
            if k != third:
                self._insert(k)

    def _add(self, u: int, v: int, w: int) -> None:
        self.apex[u, v], self.apex[v, w], self.apex[w, u] = w, u, v

    def _conflict(self, u: int, v: int, w: int, p: Point) -> bool:
        if _OUT in (u, v, w):
            while w != _OUT:
                u, v, w = v, w, u
            a, b = self.points[u], self.points[v]
            side = orient(a, b, p)
            return side > 0 or (side == 0 and min(a, b) < p < max(a, b))
        return in_circle(self.points[u], self.points[v], self.points[w], p)

    def _find(self, p: Point) -> tuple[int, int, int]:
        """A triangle whose circle holds p: walk towards it from the last one made."""
        u, v = self.last
        w = self.apex[u, v]
        while w != _OUT:
            for a, b in ((u, v), (v, w), (w, u)):
                if orient(self.points[a], self.points[b], p) < 0:
                    u, v, w = b, a, self.apex[b, a]
                    break
            else:
                return u, v, w
        return u, v, w

    def _insert(self, k: int) -> None:
        p, apex = self.points[k], self.apex
        u, v, w = self._find(p)
        for a, b in ((u, v), (v, w), (w, u)):
            del apex[a, b]
        todo, made = [(u, v), (v, w), (w, u)], []
        while todo:
            a, b = todo.pop()
            c = apex.get((b, a))
            if c is None:  # both sides of the edge are gone
                continue
            if self._conflict(b, a, c, p):
                for x, y in ((b, a), (a, c), (c, b)):
                    del apex[x, y]
                todo += [(a, c), (c, b)]
            else:
                made.append((a, b))
        for a, b in made:
            # An edge whose other side went later is inside the hole.
            if (b, a) in apex:
                self._add(a, b, k)
                if _OUT not in (a, b):
                    self.last = (a, b)

    def triangles(self) -> list[tuple[int, int, int]]:
        """Corners of each triangle, turning left, least first."""
        return [(u, v, w) for (u, v), w in self.apex.items() if w != _OUT and _OUT not in (u, v) and u < v and u < w]


def circle(a: Point, b: Point, c: Point) -> tuple[float, float, float]:
    """Centre and radius of the circle through three points not in line, as near as doubles come."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    if not d:
        return a[0], a[1], float("inf")
    x, y = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return a[0] + x, a[1] + y, (x * x + y * y) ** 0.5


def hull(points: list[Point]) -> list[Point]:
    """Corners of the convex hull, turning left; points within its edges are none."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    out: list[Point] = []
    for part in (points, points[::-1]):
        start = len(out)
        for p in part:
            while len(out) - start >= 2 and orient(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        out.pop()
    return out
