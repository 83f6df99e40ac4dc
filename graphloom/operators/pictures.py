"""Pictures of graphs: services and their connections as a flowchart, small graphs as SVG."""

from __future__ import annotations

import html

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .analytics import service_connections
from .exports import mermaid_id

#: Rounds of the layout by the number of nodes.
ROUNDS = ((100, 300), (500, 150))
LAST_ROUNDS = 50


def architecture(graph: Graph, members: DataFrame) -> DataFrame:
    """(part, row): the lines of a flowchart of communities (uid, community) with their sizes, and of the calls
    and imports between them."""
    quote = F.replace("community", F.lit('"'), F.lit("'"))
    nodes = members.groupBy("community").agg(F.count(F.lit(1)).cast("string").alias("n"))
    node = F.concat(F.lit("  "), mermaid_id(F.col("community")), F.lit('["'), quote, F.lit(" ("), "n", F.lit(' symbols)"]'))
    edge = F.concat(F.lit("  "), mermaid_id(F.col("a")), F.lit(" -->|"), F.col("n").cast("string"), F.lit(" edges| "), mermaid_id(F.col("b")))
    rows = service_connections(graph, members).select(F.lit("connection").alias("part"), edge.alias("row"))
    return nodes.select(F.lit("service").alias("part"), node.alias("row")).unionByName(rows)


def layout(n: int, edges: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Places of n nodes in the unit square, by springs along edges (pairs of indices) and repulsion elsewhere,
    begun on a circle and cooled evenly: the same graph always gives the same places."""
    if n == 0:
        return np.zeros((0, 2))
    rounds = rounds if rounds is not None else next((r for most, r in ROUNDS if n <= most), LAST_ROUNDS)
    angle = 2 * np.pi * np.arange(n) / n
    at = 0.5 + 0.4 * np.stack([np.cos(angle), np.sin(angle)], axis=1)
    far = 1 / np.sqrt(n)
    edges = np.asarray(edges, dtype=np.int64).reshape(-1, 2)
    for step in range(rounds):
        gap = at[:, None, :] - at[None, :, :]
        near = np.maximum((gap**2).sum(axis=2), 1e-9)
        move = (gap * (far**2 / near)[:, :, None]).sum(axis=1)
        pull = at[edges[:, 0]] - at[edges[:, 1]]
        pull *= np.linalg.norm(pull, axis=1, keepdims=True) / far
        np.add.at(move, edges[:, 0], -pull)
        np.add.at(move, edges[:, 1], pull)
        size = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1e-9)
        at = at + move / size * np.minimum(size, 0.1 * (1 - step / rounds))
    low, high = at.min(axis=0), at.max(axis=0)
    return (at - low) / np.maximum(high - low, 1e-9)


def svg(graph: Graph, *kinds: str, most: int = 2000, width: int = 800) -> str:
    """A small graph as a picture. The layout compares all nodes with each other on the driver, so a graph of more
    than ``most`` symbols is refused; export it, or draw its communities by ``architecture``."""
    rows = graph.symbols.select("uid", "name").orderBy("uid").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a picture has {most} symbols at most")
    place = {r["uid"]: i for i, r in enumerate(rows)}
    pairs = graph.inner(*kinds).distinct().orderBy("src", "dst").collect()  # at most most² pairs, as ends are symbols
    edges = np.array([(place[p["src"]], place[p["dst"]]) for p in pairs if p["src"] != p["dst"]], dtype=np.int64).reshape(-1, 2)
    at = np.round(layout(len(rows), edges) * (width - 40) + 20, 1)
    lines = [f'<line x1="{at[a][0]}" y1="{at[a][1]}" x2="{at[b][0]}" y2="{at[b][1]}" stroke="#999"/>' for a, b in edges]
    dots = [f'<g><circle cx="{x}" cy="{y}" r="4"/><text x="{x + 6}" y="{y}">{html.escape(r["name"] or "")}</text></g>' for r, (x, y) in zip(rows, at, strict=True)]
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{width}">', *lines, *dots, "</svg>"])
