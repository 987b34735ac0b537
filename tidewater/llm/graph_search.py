"""Approximate nearest neighbours: a hierarchical navigable small-world graph
per shard, stored as flat neighbour arrays, shard results merged.

Equal vectors are one node: the node carries the smallest ids of its rows, as
many as a result can use, gathered through salted top-k steps, so ties come out
by id and a vector with a third of all rows is harmless.  Nodes are first parted
by dimension and by the binary exponent of their norm, then dealt to shards of
about ``shard_rows`` by a hash; each shard's graph is built by one task (bounded
by the shard size) and written to the shared folder.

Largest inner product is turned into nearness on a sphere: vectors get one more
component that brings them to the largest norm of their shard, queries get zero
there.  Norms in a shard differ by a factor of two at most and are scaled by a
power of two, so neither the added component nor single precision hides the
differences between neighbours, whatever the norms in other shards.

Queries are written once, in blocks.  A task takes one block through one group
of shards (there are at most ``groups`` groups), reading graphs and block from
the shared folder, and keeps the best ``k`` of each query, scored exactly in
double precision; the results of the groups are merged by rank.

Recall is measured in every run: ``checked`` queries, those with the smallest
hashes, are compared with all vectors and searched with every beam width of
``beams``.  All queries are searched with the smallest width that found ``aim``
of these true neighbours (the more shards, the fewer of a query's neighbours are
in one, and the narrower the beam may be), or else with the widest.  If that
finds less than ``recall`` of them, all queries are compared with all vectors,
block by block and shard by shard, and these exact results are returned.

Shards are built and searched in tasks of a given number: their rows are few and
small, and adaptive execution would put what is planned by size into one task.

Insertion and search work on batches: a beam of ``ef`` nodes per query is kept
in arrays, and the best unexpanded nodes of all queries are expanded together.

Defined results: null or empty vectors, zero vectors and vectors with a null,
infinite or NaN component take no part, neither as query nor as candidate; rows
with a null id likewise; queries are compared with vectors of their own
dimension only; with fewer candidates than ``k`` all are returned; repeated
rows (equal id and vector) count once; rows that share an id but not the vector
are separate: each is a query with ranks of its own, and a candidate for the
others under that id; a product beyond double precision is infinite; an empty
table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.shared import filesystem, materialise, scratch

_LOW = np.float32(-np.inf)


def beam(vec: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best nodes of one layer for each query, best first: ids (-1: none), scores.

    *links*: neighbour array (nodes, degree), -1 where empty; *entry*: (queries, e).
    """
    count, n = len(queries), len(vec)
    seen = np.zeros((count, n + 1), bool)
    seen[:, n] = True  # where -1 points
    out_id, out_score = np.full((count, ef), -1, np.int64), np.full((count, ef), _LOW, np.float32)
    rows = np.arange(count)
    ids, score = _fresh(vec, queries, entry.copy(), seen, rows)
    ids, score, opened = _best(ids, score, np.zeros(ids.shape, bool), ef)
    while True:
        waiting = np.where(opened, _LOW, score)
        pick = np.argpartition(-waiting, min(wide, waiting.shape[1]) - 1, axis=1)[:, :wide]
        chosen = np.take_along_axis(waiting, pick, 1) > _LOW
        done = ~chosen.any(axis=1)
        if done.any():
            out_id[rows[done], : ids.shape[1]], out_score[rows[done], : ids.shape[1]] = ids[done], score[done]
            keep = ~done
            if not keep.any():
                break
            rows, ids, score, opened, pick, chosen = rows[keep], ids[keep], score[keep], opened[keep], pick[keep], chosen[keep]
        np.put_along_axis(opened, pick, True, 1)
        at = np.where(chosen, np.take_along_axis(ids, pick, 1), -1)
        near = np.where((at >= 0)[:, :, None], links[at], -1).reshape(len(rows), -1)
        new, fresh = _fresh(vec, queries[rows], near, seen, rows)
        ids, score, opened = _best(np.concatenate((ids, new), 1), np.concatenate((score, fresh), 1), np.concatenate((opened, np.zeros(new.shape, bool)), 1), ef)
    order = np.argsort(-out_score, axis=1, kind="stable")
    return np.take_along_axis(out_id, order, 1), np.take_along_axis(out_score, order, 1)


def _fresh(vec, queries, near, seen, rows):
    """Nodes that a query has not seen, once each, with their scores."""
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[seen[rows[:, None], near]] = -1
    seen[rows[:, None], near] = True
    score = np.matmul(vec[near], queries[:, :, None])[:, :, 0]
    score[near < 0] = _LOW
    return near, score


def _best(ids, score, opened, ef):
    if ids.shape[1] > ef:
        top = np.argpartition(-score, ef - 1, axis=1)[:, :ef]
        ids, score, opened = (np.take_along_axis(x, top, 1) for x in (ids, score, opened))
    opened = opened | (score == _LOW)
    return ids, score, opened


def diverse(vec: np.ndarray, ids: np.ndarray, score: np.ndarray, degree: int) -> np.ndarray:
    """Choose up to *degree* of each row's candidates: a candidate nearer to a
    chosen one than to the centre waits; free places go to those that waited."""
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    own = vec[ids]
    between = np.matmul(own, own.transpose(0, 2, 1))
    valid = (ids >= 0) & (score > _LOW)
    taken = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        blocked = (taken & (between[:, c] > score[:, c, None])).any(axis=1)
        taken[:, c] = valid[:, c] & ~blocked & (taken.sum(axis=1) < degree)
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    first = np.argsort(rank, axis=1)[:, :degree]
    out = np.where(np.take_along_axis(valid, first, 1), np.take_along_axis(ids, first, 1), -1)
    if out.shape[1] < degree:
        out = np.concatenate((out, np.full((len(out), degree - out.shape[1]), -1)), 1)
    return out


class Graph:
    """Layers of neighbour arrays over one matrix of vectors; node numbers are
    row numbers, sorted so that the nodes of layer l are the first size[l]."""

    def __init__(self, vec: np.ndarray, links: list[np.ndarray]):
        self.vec, self.links = vec, links

    @classmethod
    def build(cls, vec: np.ndarray, degree: int = 16, ef: int = 64, batch: int = 256) -> Graph:
        """Layer sizes fall by the degree; rows are expected in random order."""
        n, sizes = len(vec), [len(vec)]
        while sizes[-1] > 2 * degree:
            sizes.append(max(1, sizes[-1] // degree))
        graph = cls(vec, [])
        for size in reversed(sizes):  # the sparsest layer first
            width = 2 * degree if size == n else degree
            links = np.full((size, width), -1, np.int64)
            ready = 1
            while ready < size:
                new = np.arange(ready, min(size, ready + min(batch, ready)))
                entry = graph.descend(vec[new], 8) if graph.links else np.zeros((len(new), 1), np.int64)
                entry = np.where(entry < ready, entry, 0)
                ids, score = beam(vec[:ready], links[:ready], vec[new], entry, ef)
                links[new, :degree] = diverse(vec, ids, score, degree)
                _link_back(vec, links, new)
                ready = new[-1] + 1
            graph.links.insert(0, links)
        return graph

    def descend(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """Entry nodes after the layers that exist so far."""
        entry = np.zeros((len(queries), 1), np.int64)
        for links in reversed(self.links):
            entry, _ = beam(self.vec[: len(links)], links, queries, np.where(entry < len(links), entry, 0), ef)
        return np.where(entry < 0, 0, entry)

    def search(self, queries: np.ndarray, k: int, ef: int = 96) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(queries), 1), np.int64)
        for links in reversed(self.links[1:]):
            entry, _ = beam(self.vec[: len(links)], links, queries, entry, 8)
            entry = np.where(entry < 0, 0, entry)
        ids, score = beam(self.vec, self.links[0], queries, entry, max(ef, k))
        return ids[:, :k], score[:, :k]


def _link_back(vec, links, new) -> None:
    """Add the reverse links of the new nodes; full lists are chosen anew."""
    source = np.repeat(new, links.shape[1])
    target = links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    offers = np.full((len(nodes), count.max() if len(count) else 0), -1, np.int64)
    offers[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
    width = links.shape[1]
    every = np.concatenate((links[nodes], offers), 1)
    every = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)
    filled = (every >= 0).sum(axis=1)
    room = filled <= width
    links[nodes[room]] = every[room][:, :width]
    for a in range(0, int((~room).sum()), 1024):
        part = np.flatnonzero(~room)[a : a + 1024]
        own = every[part][:, : filled[part].max()]
        score = np.matmul(vec[own], vec[nodes[part]][:, :, None])[:, :, 0]
        score[own < 0] = _LOW
        links[nodes[part]] = diverse(vec, own, score, width)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part, v as array<double>."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def _nodes(usable: DataFrame, per_node: int, salts: int = 64) -> DataFrame:
    """(v, ids): distinct vectors with the smallest *per_node* ids, sorted."""
    one = usable.groupBy("id", "v").agg(F.lit(1).alias("one")).select("id", "v")
    keyed = one.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    part = keyed.withColumn("place", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).where(F.col("place") <= per_node)
    top = part.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= per_node)
    return top.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


class ShardFile:
    """A shard as written by its building task."""

    def __init__(self, blob: bytes):
        data = np.load(io.BytesIO(blob))
        self.exact, self.ids, self.id_at, self.scale = data["exact"], data["ids"], data["id_at"], float(data["scale"])
        self.graph = Graph(data["vec"], [data[f"links{i}"] for i in range(sum(x.startswith("links") for x in data.files))])

    @staticmethod
    def make(exact: np.ndarray, ids: list, exponent: int, degree: int, ef: int) -> bytes:
        scaled = np.ldexp(exact, -exponent)
        square = (scaled * scaled).sum(axis=1)
        lift = np.sqrt(np.maximum(0.0, square.max() - square))
        vec = np.concatenate((scaled, lift[:, None]), 1).astype(np.float32)
        graph = Graph.build(vec, degree, ef)
        blob = io.BytesIO()
        np.savez(blob, vec=vec, exact=exact, scale=exponent, ids=np.concatenate(ids), id_at=np.cumsum([0, *map(len, ids)]), **{f"links{i}": x.astype(np.int32) for i, x in enumerate(graph.links)})
        return blob.getvalue()

    def near(self, own: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of *own* and nodes found for them through the graph."""
        size = np.abs(own).max(axis=1, keepdims=True)
        lifted = np.concatenate((own / size, np.zeros((len(own), 1))), 1).astype(np.float32)
        found, _ = self.graph.search(lifted, k, ef)
        row, col = np.nonzero(found >= 0)
        return row, found[row, col]

    def nearest(self, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparison with all nodes; of equal scores the smallest ids."""
        rows, nodes = [], []
        first = self.ids[self.id_at[:-1]]
        for q, score in enumerate(own @ self.exact.T):
            least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
            best = np.flatnonzero(~(score < least))
            best = best[np.lexsort((first[best], -score[best]))[:k]]
            rows.append(np.full(len(best), q)), nodes.append(best)
        return np.concatenate(rows), np.concatenate(nodes)

    def candidates(self, ids: np.ndarray, own: np.ndarray, k: int, ef: int, exactly: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, vec_id, score) of what is found, its own row left out."""
        row, node = self.nearest(own, k + 1) if exactly else self.near(own, k + 1, ef)
        with np.errstate(over="ignore", invalid="ignore"):
            score = (self.exact[node] * own[row]).sum(axis=1)
        same = (self.exact[node] == own[row]).all(axis=1)
        count = self.id_at[node + 1] - self.id_at[node]
        place = np.repeat(self.id_at[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        row, score, same, vec_id = np.repeat(row, count), np.repeat(score, count), np.repeat(same, count), self.ids[place]
        other = ~(same & (vec_id == ids[row]))
        return row[other], vec_id[other], score[other]


def _best_of(row, vec_id, score, k: int):
    """The *k* best of each row, of equal scores the smaller ids."""
    order = np.lexsort((vec_id, -score, row))
    row, vec_id, score = row[order], vec_id[order], score[order]
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.empty(0, np.int64)
    keep = np.arange(len(row)) - np.repeat(start, np.diff(np.concatenate((start, [len(row)])))) < k
    return row[keep], vec_id[keep], score[keep]


def search(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, shard_rows: int = 8192, degree: int = 16,
    ef_build: int = 128, ef: int = 192, block_rows: int = 512, groups: int = 64, checked: int = 64, recall: float = 0.9, beams: tuple[int, ...] = (24, 48, 96), aim: float = 0.97,
    most_tasks: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id, score: the *k* nearest found of each row whose id
    is divisible by *every*, among all other rows."""
    spark = vectors.sparkSession
    folder = scratch(spark, "graph")
    usable = _usable(vectors, id_col, vec_col)
    top = F.array_max(F.transform("v", F.abs))
    exponent = F.floor(F.log2("top") + 0.5 * F.log2(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("top")) * (x / F.col("top"))))).cast("int")
    nodes = _nodes(usable, k + 1).withColumn("top", top).select("v", "ids", F.size("v").alias("dim"), exponent.alias("e"))
    nodes = materialise(nodes, "nodes")
    shards = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / shard_rows)).cast("int").alias("shards")
    classes = materialise(nodes.groupBy("dim", "e").agg(shards), "classes")

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dim, e, shard = key
        frame = frame.iloc[np.random.default_rng(int(shard)).permutation(len(frame))]
        blob = ShardFile.make(np.array(frame["v"].tolist(), np.float64), frame["ids"].tolist(), int(e), degree, ef_build)
        _write(folder, f"{dim}/{e}-{shard}.npz", blob)
        return pd.DataFrame({"dim": [dim], "e": [e], "shard": [shard]})

    placed = nodes.join(classes, ["dim", "e"]).withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    parts = classes.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    placed = placed.repartition(min(most_tasks, 2 * parts), "dim", "e", "shard")
    index = materialise(placed.groupBy("dim", "e", "shard").applyInPandas(build, "dim int, e int, shard int"), "graph-index")
    # the shards of a dimension by exponent: as many entries as exponents, 2,100 at most
    known = classes.join(index.select("dim", "e").distinct(), ["dim", "e"]).groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("e", "shards"))).alias("classes"), F.least(F.lit(groups), F.sum("shards")).cast("int").alias("groups"))
    known = materialise(known, "dims")

    queries = usable.where(F.col("id") % every == 0).groupBy("id", "v").agg(F.lit(1).alias("one"))
    queries = materialise(queries.select("id", "v", F.size("v").alias("dim"), F.xxhash64("id", "v").alias("h")), "queries")

    def keep_block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        name, dim, block = key
        blob = io.BytesIO()
        np.savez(blob, id=frame["id"].to_numpy(), h=frame["h"].to_numpy(), v=np.array(frame["v"].tolist(), np.float64))
        _write(folder, f"{dim}/{name}-{block}.npz", blob.getvalue())
        return pd.DataFrame({"name": [name], "dim": [dim], "block": [block]})

    def hits(asked: DataFrame, name: str, widths: list[int]) -> DataFrame:
        """The best of each query and beam width; width 0 compares with all vectors."""
        count = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        dealt = asked.join(count, "dim").withColumn("block", F.pmod(F.xxhash64("h", F.lit(3)), F.col("blocks")).cast("int")).withColumn("name", F.lit(name))
        blocks = materialise(dealt.groupBy("name", "dim", "block").applyInPandas(keep_block, "name string, dim int, block int"), "blocks")
        tasks = blocks.join(known, "dim").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        tasks = tasks.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths])))
        tasks = tasks.repartition(max(1, min(most_tasks, tasks.count())))

        def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for block, dim, sizes, group, of, width in zip(frame["block"], frame["dim"], frame["classes"], frame["group"], frame["groups"], frame["width"]):
                    data = np.load(io.BytesIO(_read(folder, f"{dim}/{name}-{block}.npz")))
                    ids, own, h = data["id"], data["v"], data["h"]
                    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                    every_shard = [(c["e"], n) for c in sizes for n in range(c["shards"])]
                    for e, n in every_shard[group::of]:
                        blob = _read(folder, f"{dim}/{e}-{n}.npz", missing_ok=True)
                        if blob is None:  # no vector fell into this shard
                            continue
                        shard = ShardFile(blob)
                        for a in range(0, len(ids), 128):
                            row, vec_id, score = shard.candidates(ids[a : a + 128], own[a : a + 128], k, width, width == 0)
                            best = tuple(np.concatenate(x) for x in zip(best, (row + a, vec_id, score)))
                        best = _best_of(*best, k)
                    row, vec_id, score = best
                    yield pd.DataFrame({"query_id": ids[row], "h": h[row], "vec_id": vec_id, "score": score, "width": np.full(len(row), width, np.int32)})

        found = tasks.mapInPandas(look_up, "query_id long, h long, vec_id long, score double, width int")
        rank = F.row_number().over(Window.partitionBy("query_id", "h", "width").orderBy(F.desc("score"), "vec_id"))
        return materialise(found.withColumn("rank", rank).where(F.col("rank") <= k), "hits")

    widths = sorted({ef, *(w for w in beams if w < ef)})
    sample = materialise(queries.orderBy("h", "id").limit(checked), "checked")
    tried = hits(sample, "checked", [0, *widths])
    true = tried.where("width = 0")
    last = true.groupBy("query_id", "h").agg(F.min("score").alias("least"))
    good = tried.where("width > 0").join(last, ["query_id", "h"]).where(F.col("score") >= F.col("least"))
    good = {r["width"]: r["count"] for r in good.groupBy("width").count().collect()}
    wanted = true.count()
    width = next((w for w in widths if good.get(w, 0) >= aim * wanted), ef)
    if good.get(width, 0) < recall * wanted:
        width = 0
    found = hits(queries, "asked", [width])
    return found.select("query_id", "rank", "vec_id", "score")


def _write(folder: str, name: str, blob: bytes) -> None:
    fs, root = filesystem(folder)
    fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(blob)


def _read(folder: str, name: str, missing_ok: bool = False) -> bytes | None:
    fs, root = filesystem(folder)
    try:
        with fs.open_input_file(f"{root}/{name}") as f:
            return f.read()
    except FileNotFoundError:
        if missing_ok:
            return None
        raise
