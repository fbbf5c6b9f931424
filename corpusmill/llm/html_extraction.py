"""Main text of web pages by minimum cut.

A page's blocks are the nodes of a graph. A classifier's log odds give each its terminal capacity (to content if positive, else to
boilerplate); edges between neighbours in page order, the stronger the nearer they are in the element tree, and between successive blocks of one
parent make it costly to label them differently. The minimum cut, found by maximum flow, is the cheapest labelling.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import page_blocks

#: Capacities are whole numbers of hundredths of log odds, so that flows are exact.
UNIT = 100
#: What it costs to part neighbours in page order that are siblings; each further step in the tree divides it. And to part successive blocks of one parent.
NEIGHBOURS, SAME_PARENT = 1.5, 0.5


def _max_flow(preference: list[int], edges: dict[int, dict[int, int]], nodes: list[int]) -> set[int]:
    """The nodes on the content side of the minimum cut with the fewest of them, by Dinic's algorithm."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {v: dict(edges[v]) for v in nodes}
    room[source], room[sink] = {}, {}
    for v in nodes:
        a, b = (source, v) if preference[v] > 0 else (v, sink)
        room[a][b], room[b][a] = abs(preference[v]), 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            for u, left in room[v].items():
                if left and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if sink not in level:
            return {v for v in level if v >= 0}
        path, ways, tried = [source], {v: list(room[v]) for v in level}, dict.fromkeys(level, 0)
        while path:
            v = path[-1]
            if v == sink:
                steps = list(zip(path, path[1:]))
                sent = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= sent
                    room[b][a] += sent
                del path[next(i for i, (a, b) in enumerate(steps) if not room[a][b]) + 1 :]
                continue
            while tried[v] < len(ways[v]):
                u = ways[v][tried[v]]
                if room[v][u] and level.get(u, -1) == level[v] + 1:
                    path.append(u)
                    break
                tried[v] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1  # a dead end is not tried again


def cut(preference: list[int], edges: dict[int, dict[int, int]]) -> set[int]:
    """The content nodes of the cheapest labelling; of equally cheap ones that with the fewest content nodes.

    A node whose preference outweighs all its edges has the preferred label in every minimum cut; it is set first and its edges become
    its neighbours' preferences. Maximum flow decides the rest.
    """
    wish, left = list(preference), {v: dict(edges.get(v, {})) for v in range(len(preference))}
    chosen, waiting = set(), list(left)
    while waiting:
        v = waiting.pop()
        if v not in left or abs(wish[v]) <= sum(left[v].values()):
            continue
        side = wish[v] > 0
        if side:
            chosen.add(v)
        for u, weight in left.pop(v).items():
            del left[u][v]
            wish[u] += weight if side else -weight
            waiting.append(u)
    return chosen | _max_flow(wish, left, list(left)) if left else chosen


def _edges(nodes: list[page_blocks.Node], blocks: list[page_blocks.Block]) -> dict[int, dict[int, int]]:
    edges: dict[int, dict[int, int]] = {i: {} for i in range(len(blocks))}

    def join(i: int, j: int, weight: float) -> None:
        if amount := round(UNIT * weight):
            edges[i][j] = edges[j][i] = edges[i].get(j, 0) + amount

    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            join(i - 1, i, NEIGHBOURS / (1 + max(0, page_blocks.distance(nodes, blocks[i - 1].node, b.node) - 2)))
        parent = nodes[b.node].parent
        if parent in last:
            join(last[parent], i, SAME_PARENT)
        last[parent] = i
    return edges


def main_text(page: str | None) -> str:
    """The blocks of a page that the minimum cut labels content, in page order, one a line."""
    nodes, blocks = page_blocks.parse(page or "")
    page_blocks.score(nodes, blocks)
    kept = cut([round(UNIT * b.score) for b in blocks], _edges(nodes, blocks))
    return "\n".join(b.text for i, b in enumerate(blocks) if i in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch["html"]]
        yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def html_extraction(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page, one row for each row, repeated ones too, without a shuffle.

    A null or empty page has an empty text. White space within a block (as str.split takes it, no-break spaces included) becomes one space, a
    line break in markup too; the cells of a table's row are one block. Pages of any length are taken whole. Other columns are not
    read; empty tables give no rows.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(spark.read.parquet(f"{sf_dir}/pages.parquet"))
