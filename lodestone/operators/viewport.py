"""Which tiles a screen shows: selection, cover by loaded tiles, prefetch."""
from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiling import Bbox, tile_rect

TILE_PIXELS, PREFETCH, DEEPER = 512, 12, 2
Key = tuple[int, int, int]


def select_tiles(tiles: DataFrame, root: Bbox, view: Bbox, width_px: float) -> DataFrame:
    """Tiles to draw, by a rule on each row: it overlaps the view, is a leaf or at most 512 px wide, and its parent is
    wider than that (a parent that is a leaf has no children). tiles: z, tx, ty, is_leaf."""
    px = F.lit((root.max_x - root.min_x) / (view.max_x - view.min_x) * width_px) / F.pow(F.lit(2.0), F.col("z"))
    rect = tiles.select("*", *tile_rect(root, F.col("z"), F.col("tx"), F.col("ty")))
    seen = (F.col("min_x") < view.max_x) & (F.col("max_x") > view.min_x) & (F.col("min_y") < view.max_y) & (F.col("max_y") > view.min_y)
    return rect.where(seen & (F.col("is_leaf") | (px <= TILE_PIXELS)) & ((F.col("z") == 0) | (2 * px > TILE_PIXELS))).select("z", "tx", "ty", "is_leaf")


def _ancestors(t: Key):
    z, x, y = t
    while z > 0:
        z, x, y = z - 1, x >> 1, y >> 1
        yield z, x, y


def _below(t: Key, depth: int):
    z, x, y = t
    n = 1 << depth
    return [(z + depth, x * n + i, y * n + j) for i in range(n) for j in range(n)]


def cover_tiles(wanted: Iterable[Key], loaded: set[Key]) -> list[Key]:
    """What can be drawn now: a wanted tile, else its nearest loaded ancestor, else loaded descendants up to two
    levels deeper; nothing under a chosen ancestor."""
    chosen: set[Key] = set()
    for t in wanted:
        if t in loaded:
            chosen.add(t)
        elif up := next((a for a in _ancestors(t) if a in loaded), None):
            chosen.add(up)
        else:
            first = [d for d in _below(t, 1) if d in loaded]
            rest = [d for d in _below(t, 2) if d in loaded and (d[0] - 1, d[1] >> 1, d[2] >> 1) not in first]
            chosen.update(first + rest)
    return sorted(t for t in chosen if not any(a in chosen for a in _ancestors(t)))


def prefetch(shown: Iterable[Key], known: set[Key], loaded: set[Key] = frozenset(), cap: int = PREFETCH) -> list[Key]:
    """Likely next tiles: parents, then the ring of neighbours, then children."""
    shown = list(shown)
    rings = [[(z - 1, x >> 1, y >> 1) for z, x, y in shown if z], [(z, x + i, y + j) for z, x, y in shown for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], [c for t in shown for c in _below(t, 1)]]
    skip = set(shown) | set(loaded)
    return [t for t in dict.fromkeys(t for ring in rings for t in ring) if t in known and t not in skip][:cap]


def camera_bounds(center: tuple[float, float], scale: float, size: tuple[float, float]) -> Bbox:
    """What a camera sees: `size` pixels around the centre, `scale` pixels a unit."""
    w, h = size[0] / scale / 2, size[1] / scale / 2
    return Bbox(center[0] - w, center[1] - h, center[0] + w, center[1] + h)


def fitted(box: Bbox, size: tuple[float, float], margin: float = 0.0) -> tuple[tuple[float, float], float]:
    """The camera (centre, scale) that shows all of a box, with a margin as a share of the screen."""
    w, h = max(box.max_x - box.min_x, 1e-12), max(box.max_y - box.min_y, 1e-12)
    return ((box.min_x + box.max_x) / 2, (box.min_y + box.max_y) / 2), min(size[0] / w, size[1] / h) * (1 - margin)


class TileCache:
    """Loaded tiles within a budget of bytes: the least recently used leaves first; failed tiles may be asked for again
    after `retry` seconds, and what a later view no longer wants is not taken in."""

    def __init__(self, budget: int = 384 << 20, retry: float = 2.0):
        self.budget, self.retry, self.kept, self.used, self.failed, self.wanted = budget, retry, OrderedDict(), 0, {}, None

    def want(self, keys: Iterable[Key], now: float) -> list[Key]:
        """What to load for a view; anything else that arrives later is stale."""
        self.wanted = set(keys)
        for k in self.wanted & self.kept.keys():
            self.kept.move_to_end(k)
        return sorted(k for k in self.wanted - self.kept.keys() if now - self.failed.get(k, -self.retry) >= self.retry)

    def put(self, key: Key, size: int, value=None) -> bool:
        if self.wanted is not None and key not in self.wanted:
            return False
        if key in self.kept:
            self.used -= self.kept.pop(key)[0]
        self.kept[key], self.used = (size, value), self.used + size
        while self.used > self.budget and len(self.kept) > 1:
            self.used -= self.kept.popitem(last=False)[1][0]
        return True

    def fail(self, key: Key, now: float) -> None:
        self.failed[key] = now
