"""Small graphs in the notation u>v:w,  slots parted by commas and _ for null; brute force."""

from __future__ import annotations

from collections import defaultdict

from pathforge.schema import EDGES

CENT = 100


def parse(text: str) -> dict[tuple[str, str], list[int | None]]:
    out = {}
    for part in text.split():
        ends, weights = part.rsplit(":", 1)
        u, v = ends.split(">")
        slots = [None if w == "_" else round(float(w) * CENT) for w in weights.split(",")]
        out[u, v] = slots + [None] * (8 - len(slots))
    return out


def frame(spark, edges: dict):
    return spark.createDataFrame([(u, v, *w) for (u, v), w in edges.items()], EDGES).coalesce(1)


def graph(spark, text: str):
    return frame(spark, parse(text))


def brute(edges: dict, min_points: int = 2) -> list[tuple[int, str]]:
    """(cost, path) of all source-to-sink paths, in order."""
    out, into, names = defaultdict(list), set(), set()
    for (u, v), w in edges.items():
        out[u].append((v, w))
        into.add(v)
        names |= {u, v}
    found = []

    def walk(v, cost, path, n):
        if v not in out:
            if n >= min_points:
                found.append((cost, path))
            return
        for x, slots in out[v]:
            for i, w in enumerate(slots):
                if w is not None:
                    walk(x, cost + w, f"{path}>{i}:{x}", n + 1)

    for s in sorted(names - into):
        walk(s, 0, s, 1)
    return sorted(found)
