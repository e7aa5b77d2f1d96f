"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Equal vectors become one node, so a vector that a third of all rows share costs
one node. Nodes go to the cell of their nearest centroid (fitted on a bounded
sample; every node is indexed) and inside a cell to shards of bounded size.
One task per shard builds a graph and stores it as flat neighbour arrays.

A query visits the shards of its home cell first. Another cell is visited only
if it may hold something nearer: no vector of a cell is farther from its centroid
than the cell's radius, so by the triangle inequality of angles a cell beyond
the k-th angle found plus its radius cannot. Skipping such cells loses nothing;
what recall is lost is lost inside graphs. Results are merged; scores are cosines
of the original vectors in double precision, whatever the graph was searched with.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provscan.llm.scratch import Scratch

LINKS = 16  #: neighbours a node keeps above the ground layer; twice as many on it
EF_BUILD, EF_SEARCH = 64, 128
SHARD_NODES = 8192
CELLS = 1024  #: centroids at most; larger cells have several shards
SAMPLE_PER_CELL = 32  #: different vectors a centroid is fitted on, at most
SAMPLE_VALUES = 1 << 23  #: numbers in that sample, at most
BLOCK_QUERIES = 8192  #: queries that one task answers from one shard
SLACK = 1e-3  #: radians by which angles in single precision may be off
_ROWS = 256


class Graph:
    """Layers of neighbour lists over unit vectors. Node i's level is drawn from a fixed sequence."""

    def __init__(self, vectors: np.ndarray, grounds: np.ndarray | None = None, upper: list[dict[int, np.ndarray]] | None = None, entry: int = 0):
        self.vectors = vectors
        n = len(vectors)
        self.ground = grounds if grounds is not None else np.full((n, 2 * LINKS), -1, np.int32)
        self.upper = upper if upper is not None else []
        self.entry = entry

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """``vectors``: float32 rows of length 1.

        Nodes count as inserted in a drawn order: each is linked to diverse ones
        of its EF_BUILD nearest among those before it on its layers, and they to
        it. As a shard is bounded, the nearest are found exactly, by blocks.
        """
        graph = cls(vectors)
        n = len(vectors)
        rng = np.random.default_rng(11)
        order = rng.permutation(n)
        levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(int), 8)
        for level in range(int(levels.max(initial=-1)), -1, -1):
            members = order[levels[order] >= level]
            links = graph._layer(members)
            if level:
                graph.upper.insert(0, {int(v): x[x >= 0] for v, x in zip(members, links)})
            else:
                graph.ground[members, : links.shape[1]] = links
            if level == levels.max(initial=0):
                graph.entry = int(members[0]) if len(members) else 0
        return graph

    def _layer(self, members: np.ndarray) -> np.ndarray:
        """Neighbours (padded with -1) of each member of a layer, members in the order of their insertion."""
        own = self.vectors[members]
        n, most = len(members), 2 * LINKS
        sources, targets = [], []
        for low in range(0, n, _ROWS):
            high = min(low + _ROWS, n)
            sims = own[low:high] @ own[:high].T
            sims[np.arange(high)[None, :] >= np.arange(low, high)[:, None]] = -np.inf
            wide = min(EF_BUILD, high)
            near = np.argpartition(-sims, wide - 1, axis=1)[:, :wide] if wide < high else np.tile(np.arange(high), (high - low, 1))
            near, found = _by_similarity(near, np.take_along_axis(sims, near, 1))
            chosen = _diverse(own, near, found, LINKS)
            row, column = np.nonzero(chosen >= 0)
            sources.append(row + low)
            targets.append(chosen[row, column])
        a, b = np.concatenate(sources), np.concatenate(targets)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])  # no pair comes twice: b was inserted before a
        sims = np.einsum("ij,ij->i", own[a], own[b])
        order = np.lexsort((b, -sims, a))
        a, b, sims = a[order], b[order], sims[order]
        place = np.arange(len(a)) - np.searchsorted(a, np.arange(n))[a]
        out = np.full((n, most), -1, np.int64)
        counts = np.bincount(a, minlength=n)
        few = (counts[a] <= most)
        out[a[few], place[few]] = b[few]
        wide = 4 * most
        many = np.flatnonzero(counts > most)
        at = np.full(n, -1)
        at[many] = np.arange(len(many))
        held = np.flatnonzero((at[a] >= 0) & (place < wide))
        near, found = np.full((len(many), wide), -1, np.int64), np.full((len(many), wide), -np.inf, np.float32)
        near[at[a[held]], place[held]], found[at[a[held]], place[held]] = b[held], sims[held]
        for low in range(0, len(many), _ROWS // 2):
            part = slice(low, low + _ROWS // 2)
            out[many[part]] = _diverse(own, near[part], found[part], most)
        return np.where(out >= 0, members[out], -1).astype(np.int32)

    def _walk(self, q, entries: list[tuple[float, int]], ef: int, neighbours) -> list[tuple[float, int]]:
        """Best-first search of one layer: up to ``ef`` (similarity, node), best first."""
        vectors, seen = self.vectors, np.zeros(len(self.vectors), bool)
        seen[[v for _, v in entries]] = True
        best = list(entries)
        heapq.heapify(best)
        open_ = [(-s, v) for s, v in entries]
        heapq.heapify(open_)
        while open_:
            s, v = heapq.heappop(open_)
            if len(best) >= ef and -s < best[0][0]:
                break
            near = np.asarray(neighbours(v), np.int64)
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            sims = vectors[near] @ q
            if len(best) >= ef:
                good = sims > best[0][0]
                near, sims = near[good], sims[good]
            for x, u in zip(sims.tolist(), near.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (x, u))
                elif x > best[0][0]:
                    heapq.heapreplace(best, (x, u))
                else:
                    continue
                heapq.heappush(open_, (-x, u))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, ef: int = EF_SEARCH) -> list[int]:
        """Nodes found near a unit vector, best first."""
        at = [(float(self.vectors[self.entry] @ q), self.entry)]
        for lists in reversed(self.upper):
            at = self._walk(q, at, 1, lambda v, c=lists: c[v])
        return [v for _, v in self._walk(q, at, ef, lambda v: self.ground[v][self.ground[v] >= 0])]

    def flat(self) -> dict[str, bytes]:
        """The graph as flat arrays."""
        nodes = [np.array(sorted(c), np.int32) for c in self.upper]
        links = [c[v] for c in self.upper for v in sorted(c)]
        return {
            "ground": self.ground.tobytes(),
            "upper_sizes": np.array([len(x) for x in nodes], np.int32).tobytes(),
            "upper_nodes": np.concatenate(nodes).tobytes() if nodes else b"",
            "upper_offsets": np.cumsum([0, *map(len, links)]).astype(np.int32).tobytes(),
            "upper_links": np.concatenate(links).astype(np.int32).tobytes() if links else b"",
        }

    @classmethod
    def read(cls, vectors: np.ndarray, row: dict, entry: int) -> Graph:
        sizes, nodes, offsets, links = (np.frombuffer(row[k], np.int32) for k in ("upper_sizes", "upper_nodes", "upper_offsets", "upper_links"))
        upper, at = [], 0
        for size in sizes:
            upper.append({int(nodes[i]): links[offsets[i] : offsets[i + 1]] for i in range(at, at + size)})
            at += size
        return cls(vectors, np.frombuffer(row["ground"], np.int32).reshape(len(vectors), -1), upper, entry)


def _by_similarity(near: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(vectors: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """[row, most]: of each row's candidates, best first (similarity -inf: none), those nearer to the row than to
    any chosen before; topped up with the nearest passed over; -1 where there are no more."""
    rows, wide = near.shape
    among = vectors[near] @ vectors[near].transpose(0, 2, 1)
    valid = sims > -np.inf
    closest = np.full((rows, wide), -2, np.float32)
    chosen, taken = np.zeros((rows, wide), bool), np.zeros(rows, int)
    for i in range(wide):
        fits = (closest[:, i] < sims[:, i]) & valid[:, i] & (taken < most)
        chosen[:, i] = fits
        taken += fits
        np.maximum(closest, among[:, i], out=closest, where=fits[:, None])
    first = np.argsort(np.where(chosen, 0, wide) + np.where(valid, 0, 2 * wide) + np.arange(wide), axis=1)[:, :most]
    out = np.where(np.take_along_axis(valid, first, 1), np.take_along_axis(near, first, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors.astype(np.float64)
    scaled /= np.abs(scaled).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosines(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision of rows and a vector."""
    a, b = vectors.astype(np.float64), q.astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max()
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))


_INDEX = "shard int, dim int, entry int, vectors binary, ids binary, id_offsets binary, ground binary, upper_sizes binary, upper_nodes binary, upper_offsets binary, upper_links binary"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, np.float64).reshape(len(column), -1)


def _build_shard(table: pa.Table) -> pa.Table:
    order = np.argsort([ids[0] for ids in table["ids"].to_pylist()], kind="stable")
    table = table.take(pa.array(order))
    vectors = _matrix(table["v"])
    graph = Graph.build(_unit(vectors))
    ids = table["ids"].to_pylist()
    row = {
        "shard": table["shard"][0].as_py(),
        "dim": vectors.shape[1],
        "entry": graph.entry,
        "vectors": vectors.tobytes(),
        "ids": np.array([i for x in ids for i in x], np.int64).tobytes(),
        "id_offsets": np.cumsum([0, *map(len, ids)]).astype(np.int32).tobytes(),
        **graph.flat(),
    }
    kinds = {"shard": pa.int32(), "dim": pa.int32(), "entry": pa.int32()}
    return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})


def _search_shard(k: int, ef: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if len(index) and len(queries):
            row = index.slice(0, 1).to_pylist()[0]
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            ids, offsets = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_offsets"], np.int32)
            graph = Graph.read(_unit(vectors), row, row["entry"])
            wanted = _matrix(queries["v"])
            for query, q, unit in zip(queries["query_id"].to_pylist(), wanted, _unit(wanted)):
                nodes = np.array(graph.search(unit, max(ef, k + 1)))
                hits = [(-s, i) for s, v in zip(cosines(vectors[nodes], q).tolist(), nodes) for i in ids[offsets[v] : offsets[v + 1]].tolist() if i != query]
                found += [(query, i, -s) for s, i in heapq.nsmallest(k, hits)]
        columns = list(zip(*found)) if found else [(), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()))})

    return run


def usable(v: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())


class Cells:
    """Centroids (unit rows) that split the vectors, and what is in their cells; small enough to travel with every task."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.radius = np.zeros(len(centroids))  # greatest angle of a node to its centroid
        self.first = np.zeros(len(centroids), np.int64)  # number of a cell's first shard
        self.parts = np.zeros(len(centroids), np.int64)  # shards of a cell

    @classmethod
    def fit(cls, vectors: np.ndarray, cells: int) -> Cells:
        """Spherical k-means, from centroids spread over the sample by farthest-first choice."""
        units = _unit(vectors)
        chosen, nearest = [0], units @ units[0]
        while len(chosen) < min(cells, len(units)):
            chosen.append(int(np.argmin(nearest)))
            nearest = np.maximum(nearest, units @ units[chosen[-1]])
        centroids = units[chosen]
        for _ in range(10):
            owner = np.argmax(units @ centroids.T, axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, owner, units)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centroids)
        return cls(centroids.astype(np.float32))

    def angles(self, units: np.ndarray) -> np.ndarray:
        """[row, cell] in radians."""
        return np.arccos(np.clip((units @ self.centroids.T).astype(np.float64), -1, 1))


def _placed_batches(cells: Cells):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                angles = cells.angles(_unit(_matrix(pa.chunked_array([batch.column(0)]))))
                own = np.argmin(angles, axis=1)
                arrays = [pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own]), *batch.columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", "angle", "v", "ids"])

    return run


def _route_batches(cells: Cells, home: bool):
    """(query_id, v, worst, shard): the shards of the home cell, or of those others that may hold what is nearer than ``worst``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = cells.angles(_unit(_matrix(pa.chunked_array([batch.column(1)]))))
            own = np.argmin(angles, axis=1)
            visits = np.arange(angles.shape[1])[None, :] == own[:, None]
            if not home:
                worst = np.arccos(np.clip(batch.column(2).to_numpy(zero_copy_only=False), -1, 1))
                visits = ~visits & (angles - cells.radius <= worst[:, None] + SLACK)
            row, cell = np.nonzero(visits & (cells.parts > 0))
            parts = cells.parts[cell]
            shard = np.repeat(cells.first[cell], parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            taken = batch.take(pa.array(np.repeat(row, parts)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shard.astype(np.int32))], names=["query_id", "v", "worst", "shard"])

    return run


def index(df: DataFrame, k: int, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Cells]:
    """(table of one graph per shard, cells) over every usable row.

    Of rows with equal vectors the node keeps the k + 1 least ids, all that a
    search for k can return. Centroids are fitted on at most SAMPLE_PER_CELL
    different vectors a cell, those of least hash.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = _vectors(df, id_col, vector_col).distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    nodes = scratch.write(rows.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    n = nodes.count()
    wanted = min(CELLS, -(-n // SHARD_NODES))
    size = min(wanted * SAMPLE_PER_CELL, max(SAMPLE_VALUES // max(1, _length(nodes)), 1))
    sample = nodes.select("v").orderBy(F.xxhash64("v"), "v").limit(size).toArrow()
    cells = Cells.fit(_matrix(sample["v"]), wanted) if n else Cells(np.zeros((0, 1), np.float32))
    placed = scratch.write(nodes.mapInArrow(_placed_batches(cells), "cell int, angle double, v array<double>, ids array<long>"), "placed")
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # at most CELLS rows
        cells.parts[r["cell"]], cells.radius[r["cell"]] = -(-r["n"] // SHARD_NODES), r["radius"]
    cells.first = np.cumsum(cells.parts) - cells.parts
    shards = max(1, int(cells.parts.sum()))
    look = lambda x: F.get(F.array(*map(F.lit, x.tolist())), F.col("cell"))
    number = look(cells.first) + F.pmod(F.xxhash64("v"), look(cells.parts)) if n else F.lit(0)
    # One task a shard: a range per number, which adaptive execution does not pack together.
    spread = placed.select(number.cast("int").alias("shard"), "v", "ids").repartitionByRange(min(shards, 100_000), "shard")
    return scratch.write(spread.groupBy("shard").applyInArrow(_build_shard, _INDEX), "index"), cells


def _length(nodes: DataFrame) -> int:
    first = nodes.select(F.size("v")).first()
    return first[0] if first else 1


def _searched(graphs: DataFrame, asked: DataFrame, k: int, ef: int) -> DataFrame:
    """(query_id, vec_id, score): each row of ``asked`` (query_id, v, shard) looked up in its shard, in blocks of queries."""
    sizes = asked.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks"))
    blocks = graphs.join(sizes, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).drop("blocks")
    cut = asked.join(sizes, "shard").select("query_id", "v", "shard", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"))
    met = blocks.groupBy("shard", "block").cogroup(cut.groupBy("shard", "block"))
    return met.applyInArrow(_search_shard(k, ef), "query_id long, vec_id long, score double")


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, ef: int = EF_SEARCH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found among ``df`` for each row of ``queries``.

    Nearest first, ties to the smaller id; rows with a query's own id are no
    candidates for it. Rows with a null id, and vectors that are null, zero or
    hold null or non-finite components, take no part; so do vectors whose
    length is not that of most. Repeated rows count once. With no candidates a
    query has no rows; empty tables give an empty result.
    """
    scratch = Scratch(df.sparkSession, "hnsw")
    common = _vectors(df, id_col, vector_col).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = common[0]["d"] if common else 0
    same = F.size(F.col(vector_col)) == dim
    graphs, cells = index(df.where(same), k, scratch, id_col, vector_col)
    wanted = _vectors(queries.where(same), id_col, vector_col).distinct().withColumnRenamed("vec_id", "query_id")
    schema = "query_id long, v array<double>, worst double, shard int"
    none = F.lit(-1.0).alias("worst")
    asked = scratch.write(wanted.select("query_id", "v", none).mapInArrow(_route_batches(cells, True), schema), "home-queries")
    home = scratch.write(_searched(graphs, asked, k, ef), "home")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # The k-th score so far; a query that found fewer must look everywhere.
    kth = ranked(home).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    open_ = wanted.join(kth, "query_id", "left").select("query_id", "v", F.coalesce("kth", F.lit(-1.0)).alias("worst"))
    more = scratch.write(open_.mapInArrow(_route_batches(cells, False), schema), "other-queries")
    return ranked(home.unionByName(_searched(graphs, more, k, ef))).select("query_id", "rank", "vec_id", "score")
