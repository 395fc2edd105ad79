"""Approximate nearest neighbours (operator 10): a robust-pruned directed graph
in each shard, greedy beam search over every shard.

Equal vectors are one node with its ``k + 1`` smallest ids, so copies cost nothing
and ties go to the smaller id. Nodes are dealt to shards of about ``SHARD`` by a hash. In a
shard, points enter the graph in batches: a greedy search from the medoid
proposes neighbours, robust pruning keeps the nearest one and drops those it
covers (``ALPHA`` times nearer to it than to the point), and the kept neighbours get
links back, pruned alike once their lists are full. The largest inner product is
the nearest in the usual lifted space, where every vector has one more
component that brings it to the largest norm and a query has 0 there.

Queries are taken in blocks; a task searches one shard's graph for one block with
a beam of ``BEAM``, and scores what it found in double precision on the original
vectors. The best ``k`` of all shards are the result.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do null ids or vectors of another length than the most frequent
one; rows that share an id are one (the smaller vector holds); fewer than ``k`` candidates are all
returned; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.session import shared_path

from .common import file_system, qualified, saved, ship, table

SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA, BATCH, QUERY_BLOCK = 4096, 32, 64, 96, 1.2, 128, 512


def valid(vectors: DataFrame) -> DataFrame:
    rows = vectors.select("vec_id", "embedding").where(
        "vec_id IS NOT NULL AND embedding IS NOT NULL "
        "AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
        "AND exists(embedding, x -> x <> 0)")
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("embedding") == (size.d if size else -1))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: int, beam: int, step: int = 4):
    """Greedy search for a batch of queries side by side: ids and inner products
    of the ``beam`` best nodes each (-1 and -inf where fewer were reached)."""
    b, n = len(queries), len(x)
    ids = np.full((b, beam), -1)
    ip = np.full((b, beam), -np.inf, np.float32)
    done = np.ones((b, beam), bool)
    ids[:, 0], ip[:, 0], done[:, 0] = entry, queries @ x[entry], False
    seen = np.zeros((b, n + 1), bool)  # the last column stands for "no node"
    seen[:, [entry, n]] = True
    rows = np.arange(b)
    live = rows
    while len(live):
        open_ip = np.where(done[live], -np.inf, ip[live])
        pick = np.argpartition(-open_ip, min(step, beam) - 1, axis=1)[:, :step]
        good = np.take_along_axis(open_ip, pick, 1) > -np.inf
        nodes = np.where(good, np.take_along_axis(ids[live], pick, 1), -1)
        done[live[:, None], pick] = True
        near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[live[:, None], near]] = n
        seen[live[:, None], near] = True
        width = int((near < n).sum(1).max(initial=0))
        if width:
            near = np.sort(near, axis=1)[:, :width]
            got = np.einsum("bwd,bd->bw", x[np.minimum(near, n - 1)], queries[live]).astype(np.float32)
            got[near == n] = -np.inf
            all_ip = np.concatenate([ip[live], got], 1)
            top = np.argpartition(-all_ip, beam - 1, axis=1)[:, :beam]
            ip[live] = np.take_along_axis(all_ip, top, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(near == n, -1, near)], 1), top, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], near == n], 1), top, 1)
        live = live[(~done[live]).any(1)]
    order = np.argsort(-ip, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(ip, order, 1)


def robust_prune(x: np.ndarray, point: int, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """The diverse neighbours of ``point`` among ``near`` (squared distances; all lifted norms are equal)."""
    near = np.unique(near[(near >= 0) & (near != point)])
    v = x[near]
    d = ((v - x[point]) ** 2).sum(1)
    order = np.argsort(d, kind="stable")
    near, v, d = near[order], v[order], d[order]
    sq = (v * v).sum(1)
    between = sq[:, None] + sq[None, :] - 2 * (v @ v.T)
    open_, kept = np.ones(len(near), bool), []
    for i in range(len(near)):
        if open_[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            open_ &= alpha * alpha * between[i] > d
    return near[kept]


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0):
    """Links (node x 2 * degree, -1 for none) and entry node of one shard."""
    n = len(x)
    rng = np.random.default_rng(seed)
    links = np.full((n, 2 * degree), -1, np.int32)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    if n > 1:
        few = min(degree // 2, n - 1)
        random = rng.integers(0, n - 1, (n, few))
        links[:, :few] = random + (random >= np.arange(n)[:, None])
    order = rng.permutation(n)
    for i in range(0, n, BATCH):
        batch = order[i:i + BATCH]
        found, _ = beam_search(x, links, x[batch], entry, min(beam, max(1, n)))
        back: dict[int, list[int]] = {}
        for p, ids in zip(batch, found):
            kept = robust_prune(x, p, np.concatenate([ids, links[p]]), degree, alpha)
            links[p] = -1
            links[p, :len(kept)] = kept
            for q in kept:
                back.setdefault(int(q), []).append(int(p))
        for q, more in back.items():
            own = np.unique(np.concatenate([links[q][links[q] >= 0], more]))
            if len(own) > 2 * degree:
                own = robust_prune(x, q, own, degree, alpha)
            links[q] = -1
            links[q, :len(own)] = own
    return links, entry


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, norm * norm - (x.astype(np.float64) ** 2).sum(1)))
    return np.concatenate([x, rest[:, None].astype(np.float32)], axis=1).astype(np.float32)


def build_index(vectors: DataFrame, k: int = 20, shard: int = SHARD) -> DataFrame:
    """Graph files of all valid vectors; returns ``shard, path`` (a row per shard)."""
    import pyarrow as pa
    spark = vectors.sparkSession
    ship(spark)
    w = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = (vectors.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
             .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))  # k + 1 at most
    nodes = saved(nodes, "op10-nodes")
    size = nodes.agg(F.count("*").alias("n"), F.max(F.aggregate(
        "embedding", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))).alias("sq")).first()
    shards, norm = max(1, -(-size.n // shard)), float(size.sq or 0.0) ** 0.5
    folder = qualified(spark, shared_path(spark, "op10-graphs"))

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows.shard.iloc[0])
        rows = rows.assign(first=[int(i[0]) for i in rows.ids]).sort_values("first")
        x = np.stack(rows.embedding.to_numpy()).astype(np.float32)
        links, entry = build(lift(x, norm), seed=number)
        data = {"x": x.ravel(), "links": links.ravel(), "entry": np.array([entry]),
                "ids": np.concatenate([np.asarray(i, np.int64) for i in rows.ids]),
                "n_ids": np.array([len(i) for i in rows.ids])}
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        name = f"graph-{number:06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{at}/{name}") as f, pa.ipc.new_stream(
                f, pa.schema([(c, pa.list_(pa.from_numpy_dtype(v.dtype))) for c, v in data.items()])) as out:
            out.write_table(pa.table({c: pa.array([v]) for c, v in data.items()}))
        return pd.DataFrame({"shard": [number], "path": [f"{folder}/{name}"]})
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(min(shards, 10_000), "shard")  # work, not bytes, is what these tasks share
    return saved(dealt.groupBy("shard").applyInPandas(make, "shard int, path string"), "op10-index")


def load(path: str) -> dict[str, np.ndarray]:
    import pyarrow as pa
    fs, at = file_system(path)
    with fs.open_input_stream(at) as f:
        got = pa.ipc.open_stream(f).read_all()
    return {c: got[c].chunk(0).flatten().to_numpy() for c in got.column_names}


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest of every query (vec_id, embedding)."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    todo = (queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
            .agg(F.collect_list("vec_id").alias("q"), F.flatten(F.collect_list("embedding")).alias("x")))  # a block
    shards = index.count()
    work = (todo.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))))
            .join(index, "shard").repartition(min(shards * blocks, 10_000) or 1, "shard", "block"))  # a task or so each
    # a shard number may be missing if no node fell to it; the join leaves it out

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            g = load(r.path)
            ids, counts = g["ids"], g["n_ids"]
            first = np.cumsum(counts) - counts
            x = g["x"].reshape(len(counts), -1)
            links = g["links"].reshape(len(counts), -1)
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1).max())
            own, q = np.asarray(r.q, np.int64), np.asarray(r.x, np.float32).reshape(len(r.q), -1)
            lifted, flat = lift(x, norm), np.concatenate([q, np.zeros((len(q), 1), np.float32)], axis=1)
            for i in range(0, len(q), BATCH):
                near, _ = beam_search(lifted, links, flat[i:i + BATCH], int(g["entry"][0]), min(max(beam, k + 1), len(x)))
                for j, nodes in enumerate(near):
                    nodes = nodes[nodes >= 0]
                    score = (x[nodes].astype(np.float64) * q[i + j].astype(np.float64)).sum(1)
                    each = counts[nodes]
                    at = np.repeat(first[nodes] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                    vec, score = ids[at], np.repeat(score, each)
                    keep = vec != own[i + j]
                    vec, score = vec[keep], score[keep]
                    top = np.lexsort((vec, -score))[:k]
                    out.append(pd.DataFrame({"query_id": own[i + j], "vec_id": vec[top], "score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64"})
    found = work.groupBy("shard", "block").applyInPandas(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op10_ann(spark, sf_dir):
    """The 20 nearest found of every vector whose id is divisible by 20."""
    vectors = saved(valid(table(spark, sf_dir, "embeddings")), "op10-vectors")
    return search(build_index(vectors), vectors.where("vec_id % 20 = 0"))
