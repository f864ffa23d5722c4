"""Colours of clusters and of heat maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The palette of cluster ids, in order (red, green, blue).
PALETTE = (
    (230, 25, 75), (60, 180, 75), (255, 225, 25), (0, 130, 200), (245, 130, 48), (145, 30, 180), (70, 240, 240), (240, 50, 230), (210, 245, 60), (250, 190, 212),
    (0, 128, 128), (220, 190, 255), (170, 110, 40), (255, 250, 200), (128, 0, 0), (170, 255, 195), (128, 128, 0), (255, 215, 180), (0, 0, 128), (128, 128, 128),
)


def colour(cluster_id: Column) -> Column:
    """"r,g,b" of a cluster id, which wraps round the palette."""
    names = F.array(*[F.lit(",".join(map(str, c))) for c in PALETTE])
    return F.element_at(names, (F.pmod(cluster_id, F.lit(len(PALETTE))) + 1).cast("int"))


def blend(share: float) -> tuple[int, int, int]:
    """white at 0, red at 1."""
    other = round(255 * (1 - min(1.0, max(0.0, share))))
    return 255, other, other
