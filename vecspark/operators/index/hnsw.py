"""Layered proximity graphs, one for each shard of bounded size, kept as rows and searched where they lie.

A shard's graph is made in bulk: candidates come from blocked matrix products, each node keeps up to M (2M on the
ground layer) diverse ones, links go both ways, and layers thin out by a factor of M. A search descends greedily and
then widens to a beam of ``ef`` candidates; shards answer alone and their answers are merged by distance and id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...errors import InvalidParameter
from ...functions.distance import np_distance
from ...operators.topk import ranked, small

GRAPH = "shard int, node int, level int, id {id}, vector array<float>, links array<array<int>>"


def _layer(x: np.ndarray, nodes: np.ndarray, most: int, candidates: int, space: str) -> dict[int, list[int]]:
    """Links among ``nodes``: diverse nearest ones, made mutual, and the nearest most of them kept."""
    links: dict[int, dict[int, float]] = {int(n): {} for n in nodes}
    take = min(candidates + 1, len(nodes))
    for at in range(0, len(nodes), 512):
        part = nodes[at : at + 512]
        d = np_distance(space, x[part], x[nodes])
        near = np.argpartition(d, take - 1, axis=1)[:, :take]
        for row, n in enumerate(part):
            order = near[row][np.argsort(d[row][near[row]], kind="stable")]
            order = order[nodes[order] != n]
            c = nodes[order]
            between, own, chosen = np_distance(space, x[c], x[c]), d[row][order], []
            for i in range(len(c)):
                if len(chosen) >= most // 2:
                    break
                if all(between[i, j] > own[i] for j in chosen):
                    chosen.append(i)
            for i in [*chosen, *[i for i in range(len(c)) if i not in chosen][: max(0, most // 4 - len(chosen))]]:
                links[int(n)][int(c[i])] = links[int(c[i])][int(n)] = float(own[i])
    return {n: sorted(v, key=lambda m, v=v: (v[m], m))[:most] for n, v in links.items()}


def make_graph(x: np.ndarray, M: int = 16, ef_construction: int = 200, space: str = "l2", seed: int = 100) -> tuple[np.ndarray, list[dict[int, list[int]]]]:
    """Level of each row and the links of each layer."""
    rng = np.random.default_rng(seed)
    top = max(1, int(math.log(max(len(x), 2)) / math.log(max(M, 2))))
    levels = np.minimum((-np.log(rng.uniform(1e-12, 1, len(x))) / math.log(max(M, 2))).astype(int), top)
    layers = [_layer(x, np.flatnonzero(levels >= n), 2 * M if n == 0 else M, min(ef_construction, 2 * M + 16), space) for n in range(int(levels.max()) + 1)] if len(x) else []
    return levels, layers


def search_graph(x: np.ndarray, levels: np.ndarray, layers: list[dict[int, list[int]]], q: np.ndarray, k: int, ef: int, space: str) -> list[tuple[float, int]]:
    """The k nearest rows found, as (distance, row), in order."""
    far = lambda rows: np_distance(space, q[None, :], x[rows])[0]
    entries = [int(np.flatnonzero(levels == levels.max())[0])]
    for layer in range(len(layers) - 1, -1, -1):
        width = max(ef, k) if layer == 0 else 4
        seen = set(entries)
        d = far(entries)
        open_ = [(float(a), e) for a, e in zip(d, entries)]
        best = [(-a, -e) for a, e in open_]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            a, node = heapq.heappop(open_)
            if len(best) >= width and a > -best[0][0]:
                break
            new = [n for n in layers[layer][node] if n not in seen]
            if not new:
                continue
            seen.update(new)
            for b, n in zip(far(new).tolist(), new):
                if len(best) < width or b < -best[0][0]:
                    heapq.heappush(open_, (b, n))
                    heapq.heappush(best, (-b, -n))
                    if len(best) > width:
                        heapq.heappop(best)
        entries = [-n for _, n in best]
    return sorted((-a, -n) for a, n in best)[:k]


def build(docs: DataFrame, M: int = 16, ef_construction: int = 200, space: str = "l2", shard_rows: int = 20_000) -> DataFrame:
    """Graph rows of ``docs(id, vector)``: rows are dealt by hash of id into shards of about shard_rows."""
    id_type = docs.schema["id"].dataType.simpleString()
    shards = max(1, math.ceil(docs.count() / shard_rows))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        levels, layers = make_graph(np.stack(pdf["vector"].to_numpy()).astype("f4"), M, ef_construction, space)
        links = [[layers[n][i] for n in range(levels[i] + 1)] for i in range(len(pdf))]
        return pd.DataFrame({"shard": pdf["shard"], "node": np.arange(len(pdf), dtype="i4"), "level": levels.astype("i4"), "id": pdf["id"], "vector": pdf["vector"], "links": links})

    dealt = docs.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "vector")
    return dealt.groupBy("shard").applyInPandas(graph, GRAPH.format(id=id_type))


def search(queries: DataFrame, graph: DataFrame, k: int, ef: int = 10, space: str = "l2") -> DataFrame:
    """``query_id, rank, id, distance``; every shard answers every query, so the query side is a small one."""
    if not small(queries, "qvec", 16 << 20):
        raise InvalidParameter("more than 16 MB of query vectors: search them in parts")
    q = queries.select("query_id", "qvec").toPandas()
    qm = [np.asarray(v, "f8") for v in q["qvec"]]
    id_type, q_type = (f.dataType.simpleString() for f in (graph.schema["id"], queries.schema["query_id"]))

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        x, levels = np.stack(pdf["vector"].to_numpy()).astype("f8"), pdf["level"].to_numpy()
        layers: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max()) + 1)]
        for node, links in enumerate(pdf["links"]):
            for n, own in enumerate(links):
                layers[n][node] = [int(i) for i in own]
        rows = [(qid, pdf["id"].iloc[n], d) for qid, v in zip(q["query_id"], qm) for d, n in search_graph(x, levels, layers, v, k, ef, space)]
        return pd.DataFrame(rows, columns=["query_id", "id", "distance"])

    hits = graph.groupBy("shard").applyInPandas(ask, f"query_id {q_type}, id {id_type}, distance double")
    return ranked(hits, k)


