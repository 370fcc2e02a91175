"""Connected components of cells on a grid.

Each tile is labelled by itself with a union-find over its cells. Cells at a tile's border meet
their neighbours across it by an equality join, and the labels so linked are contracted by joins
and aggregations with a checkpoint a round. Tiles are of fixed size, so no task's input grows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions.geometry import POLYGON
from geostrata.operators.scale import checkpointed, heavy_join

TILE = 256


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v) of edges (u, v): each node that is not the least of its component, and that least node.

    Alternating contraction: nodes are linked to their least neighbour, greater neighbours first,
    then lesser ones, until nothing changes.
    """
    edges, before = checkpointed(edges.where("u <> v").distinct()), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lowest.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges
        before = now


def tile_labels(x: np.ndarray, y: np.ndarray, eight: bool) -> np.ndarray:
    """For each cell, the index of the first cell (by x, y) of its component."""
    order = np.lexsort((y, x))
    place = {cell: k for k, cell in enumerate(zip(x[order].tolist(), y[order].tolist(), strict=True))}
    parent = list(range(len(order)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for (cx, cy), k in place.items():
        for near in ((cx - 1, cy), (cx, cy - 1), *(((cx - 1, cy - 1), (cx - 1, cy + 1)) if eight else ())):
            if (other := place.get(near)) is not None:
                a, b = root(k), root(other)
                parent[max(a, b)] = min(a, b)
    labels = np.zeros(len(order), np.int64)
    labels[order] = order[[root(k) for k in range(len(order))]]
    return labels


def components(cells: DataFrame, x: str = "x", y: str = "y", keys: list[str] = (), connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """(keys..., x, y, label): label is the component's least "x:y" of its tiles' first cells.

    cells are distinct set cells. keys part layers, such as years. connectivity is 8 or 4.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    keys, eight = list(keys), connectivity == 8
    own = cells.select(*keys, F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).withColumns({"tx": F.floor(F.col("x") / tile).cast("long"), "ty": F.floor(F.col("y") / tile).cast("long")})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        first = tile_labels(pdf.x.to_numpy(), pdf.y.to_numpy(), eight)
        xs, ys = pdf.x.to_numpy()[first], pdf.y.to_numpy()[first]
        return pdf.assign(lx=xs, ly=ys)

    schema = ", ".join([*[f"{k} {t}" for k, t in own.dtypes if k in keys], "x long, y long, tx long, ty long, lx long, ly long"])
    local = own.groupBy(*keys, "tx", "ty").applyInPandas(label, schema).withColumn("node", F.struct(*keys, "lx", "ly"))
    local = checkpointed(local)
    border = local.where(((F.col("x") % tile).isin(0, tile - 1, 1 - tile, -1)) | ((F.col("y") % tile).isin(0, tile - 1, 1 - tile, -1)))
    steps = [(1, 0), (0, 1), *([(1, 1), (1, -1)] if eight else [])]
    beside = border.select(*keys, "tx", "ty", "node", F.explode(F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in steps])).alias("n"))
    beside = beside.select(*keys, F.col("n.x").alias("x"), F.col("n.y").alias("y"), F.col("tx").alias("ox"), F.col("ty").alias("oy"), F.col("node").alias("other"))
    seams = border.join(beside, [*keys, "x", "y"]).where("tx <> ox OR ty <> oy").select(F.col("node").alias("u"), F.col("other").alias("v"))
    roots = contracted(seams)
    found = local.join(roots, local["node"] == roots["u"], "left").withColumn("root", F.coalesce("v", "node"))
    return found.select(*keys, "x", "y", F.concat_ws(":", F.col("root.lx").cast("string"), F.col("root.ly").cast("string")).alias("label"))


def with_sizes(labelled: DataFrame, keys: list[str] = ()) -> DataFrame:
    """labelled with size, the cells of each cell's component; a huge component's cells stay where they are."""
    held = checkpointed(labelled)
    return heavy_join(held, held.groupBy(*keys, "label").agg(F.count("*").alias("size")), [*keys, "label"], "size")


def at_least(labelled: DataFrame, least: int, keys: list[str] = ()) -> DataFrame:
    """Cells of components of ``least`` cells or more."""
    return with_sizes(labelled, keys).where(F.col("size") >= least)


def summaries(labelled: DataFrame, cell_area: float = 900.0, keys: list[str] = ()) -> DataFrame:
    """A row a component: cells, area and bounding box, the vectors' attributes."""
    return labelled.groupBy(*keys, "label").agg(F.count("*").alias("cells"), (F.count("*") * cell_area).alias("area"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), (F.max("x") + 1).alias("xmax"), (F.max("y") + 1).alias("ymax"))


def rings_of_edges(ax: list[int], ay: list[int], bx: list[int], by: list[int]) -> list[list[tuple[int, int]]]:
    """Closed rings of directed unit edges with the inside on their left; where four edges meet, a ring turns left, so that cells that touch at a corner have rings of their own."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for edge in sorted(zip(ax, ay, bx, by, strict=True), reverse=True):
        out.setdefault(edge[:2], []).append(edge[2:])
    rings = []
    for start in sorted(out):
        while out[start]:
            ring, at = [start], out[start].pop()
            while at != start:
                dx, dy = at[0] - ring[-1][0], at[1] - ring[-1][1]
                ring.append(at)
                turns = [(at[0] - dy, at[1] + dx), (at[0] + dx, at[1] + dy), (at[0] + dy, at[1] - dx)]
                at_next = next(t for t in turns if t in out[at])
                out[at].remove(at_next)
                at = at_next
            corners = [p for k, p in enumerate(ring) if (p[0] - ring[k - 1][0], p[1] - ring[k - 1][1]) != (ring[(k + 1) % len(ring)][0] - p[0], ring[(k + 1) % len(ring)][1] - p[1])]
            rings.append([*corners, corners[0]])
    return rings


def ring_sum(ring: list[tuple[int, int]]) -> int:
    """Twice the signed area."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def outlines(labelled: DataFrame, size: float = 1.0, keys: list[str] = ()) -> DataFrame:
    """(keys..., label, polygons): each component's outline along its cells' borders, as polygons with holes.

    Edges between two cells of a component cancel by an aggregation; what is left of a component, its
    outline, is chained in one call, as it is one value of the result. Cells of a component that touch
    at a corner only are polygons of their own. size is a cell's width.
    """
    keys = list(keys)
    x, y = F.col("x"), F.col("y")
    sides = [(x, y, x + 1, y, 1), (x + 1, y, x + 1, y + 1, 1), (x, y + 1, x + 1, y + 1, -1), (x, y, x, y + 1, -1)]
    edges = labelled.select(*keys, "label", F.explode(F.array(*[F.struct(a.alias("ax"), b.alias("ay"), c.alias("bx"), d.alias("by"), F.lit(s).alias("way")) for a, b, c, d, s in sides])).alias("e"))
    outer = edges.select(*keys, "label", "e.*").groupBy(*keys, "label", "ax", "ay", "bx", "by").agg(F.sum("way").alias("way")).where("way <> 0")

    def chain(names, pdf: pd.DataFrame) -> pd.DataFrame:
        back = pdf.way.to_numpy() < 0
        a, b = pdf[["ax", "ay"]].to_numpy(), pdf[["bx", "by"]].to_numpy()
        a, b = np.where(back[:, None], b, a), np.where(back[:, None], a, b)
        rings = rings_of_edges(a[:, 0].tolist(), a[:, 1].tolist(), b[:, 0].tolist(), b[:, 1].tolist())
        shells = [[r] for r in rings if ring_sum(r) > 0]
        for hole in (r for r in rings if ring_sum(r) < 0):
            # the middle of the cell to the left of the hole's first edge is inside the polygon, and in the smallest shell around it
            (px, py), (qx, qy) = hole[:2]
            dx, dy = (qx > px) - (qx < px), (qy > py) - (qy < py)
            mx, my = px + dx / 2 - dy / 2, py + dy / 2 + dx / 2
            around = [s for s in shells if sum((u[1] > my) != (v[1] > my) and mx < u[0] for u, v in zip(s[0], s[0][1:], strict=False)) % 2]
            min(around, key=lambda s: ring_sum(s[0])).append(hole)
        polygons = [[[{"x": px * size, "y": py * size} for px, py in r] for r in s] for s in shells]
        return pd.DataFrame([[*names, polygons]], columns=[*keys, "label", "polygons"])

    kinds = dict(labelled.dtypes)
    return outer.groupBy(*keys, "label").applyInPandas(chain, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "label")) + f", polygons array<{POLYGON}>")
