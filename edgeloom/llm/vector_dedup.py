"""Operator 8: near-duplicate vectors on a robust-pruned flat graph.

* Equal vectors are folded into one node first, by partial aggregation.
* Nodes go to their ``NEAREST_CENTRES`` nearest clusters, so shards overlap; centres
  come from a bounded sample and lie at least ``APART`` from each other (so a dense
  group has one centre, not many), every vector is indexed.  Clusters keep about
  ``CLUSTER_ROWS`` nodes at every size of the table: as long as some hold more than
  ``SPLIT_ROWS``, those are clustered again on centres of their own, which stay in a
  table and are joined to blocks of their nodes.
* A cluster that can't be split (a dense group) and is beyond ``BLOCK`` nodes is cut
  into blocks by hash, and each pair of blocks is a shard: no group has more than two
  blocks.
* Each shard links every node to its robust-pruned nearest candidates; the
  adjacency lists of a node from all its shards are united.
* All nodes are queries: greedy descent from the shard's medoid, then expansion
  over neighbours within a slack below the threshold.  Cosines are computed in
  double precision, and only pairs at or above the threshold count.
* Every shard audits its recall on queries that have links, against brute force, and
  widens the slack where it is too low; :func:`recall` audits a result against all rows.

A pair that shares several clusters is counted in the smallest of them only, so
shards return one number and one representative per node, never pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are kept, as are vectors of different lengths
among each other; vectors are scaled by a power of two first, so no size over- or
underflows; a row without ``vec_id`` links with nothing, has a null component and is
kept; repeated rows are vectors of their own (rows that share a ``vec_id`` get one row
each); an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.runtime import cut, ship, stored, table
from edgeloom.operators.components import components

THRESHOLD = 0.9
#: Mean nodes a cluster, before overlap.
CLUSTER_ROWS = 250
#: Clusters of the first level (and of each cluster that is split again).
MAX_CLUSTERS = 4096
SAMPLE_PER_CLUSTER = 16
NEAREST_CENTRES = 2
#: Largest cosine between two centres.
APART = 0.9
#: Clusters beyond this are clustered again.
SPLIT_ROWS = 16 * CLUSTER_ROWS
#: Nodes of such a cluster in one task.
SPLIT_BLOCK = 20_000
BLOCK = 2000
CANDIDATES = 32
DEGREE = 16
ALPHA = 1.2
NEAREST = 4
SLACK = 0.1
AUDITED = 32
_STEP = 64


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to at most one; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


# ---- nodes and shards -----------------------------------------------------------


def valid_vectors(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    big = F.lit(float("inf"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0)).filter(fine & F.exists(x, lambda v: v != 0))


def centres_of(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """At most k unit centres of unit vectors, no two of them nearer than ``APART``."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(6):
        own = np.concatenate([(x[a : a + 1024] @ c.T).argmax(axis=1) for a in range(0, len(x), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    alive = np.ones(len(c), bool)
    for i in range(len(c)):
        if alive[i]:
            alive[i + 1 :] &= c[i + 1 :] @ c[i] < APART
    return c[alive]


def wanted_sample(clusters: int) -> int:
    return clusters * max(SAMPLE_PER_CLUSTER, min(64, 20_000 // clusters))


def train_centres(nodes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centres by vector length, from at most SAMPLE_PER_CLUSTER * MAX_CLUSTERS vectors, in one flat array."""
    clusters = min(MAX_CLUSTERS, max(1, n // CLUSTER_ROWS))
    want = wanted_sample(clusters)
    picked = nodes.filter(F.pmod(F.xxhash64("node", F.lit("centre")), F.lit(1 << 30)) < min(1.0, 1.2 * want / max(n, 1)) * (1 << 30))
    rows = picked.select("embedding").limit(int(1.5 * want) + 1).toArrow().column(0).combine_chunks()
    size = np.diff(rows.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
    out = {}
    for d in np.unique(size).tolist():
        x = unit(matrix(rows.filter(pa.array(size == d))))
        out[d] = centres_of(x, max(1, round(clusters * len(x) / len(rows))))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centres of each row, in ascending order of their numbers."""
    k = min(NEAREST_CENTRES, len(c))
    parts = [np.argpartition(-(x[a : a + 256] @ c.T), k - 1, axis=1)[:, :k] for a in range(0, len(x), 256)]
    return np.sort(np.concatenate(parts or [np.zeros((0, k), np.int64)]), axis=1)


_SHARD = "dim long, cluster long, node long, weight long, embedding array<{}>"


def sharded(nodes: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(dim, cluster, node, weight, embedding): a row for each cluster of a node."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)  # at most MAX_CLUSTERS vectors
    kind = nodes.schema["embedding"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(2)], np.int64)
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                c = shared.value.get(d)
                own = nearest(unit(matrix(part.column(2))), c) if c is not None else np.zeros((part.num_rows, 1), np.int64)
                yield _members(part, d, own)

    return nodes.select("node", "weight", "embedding").mapInArrow(run, _SHARD.format(kind))


def _members(part: pa.RecordBatch | pa.Table, d: int, own: np.ndarray) -> pa.RecordBatch | pa.Table:
    rows = part.take(pa.array(np.repeat(np.arange(len(own)), own.shape[1])))
    columns = [pa.array(np.full(rows.num_rows, d), pa.int64()), pa.array(own.ravel(), pa.int64()), rows.column("node"), rows.column("weight"), rows.column("embedding")]
    return type(part).from_arrays(columns, ["dim", "cluster", "node", "weight", "embedding"])


def refined(shards: DataFrame, limit: int) -> DataFrame:
    """``shards`` with the clusters beyond ``limit`` nodes clustered again, as long as that makes them smaller.

    The centres of a split cluster come from a bounded sample of it, one task a cluster,
    and are joined to blocks of ``SPLIT_BLOCK`` of its nodes: none of this grows in one task.
    A cluster that kept three quarters of what it was split from is a dense group and stays.
    """
    key, settled = ["dim", "cluster"], shards.limit(0)
    shards = shards.withColumn("was", F.lit(1 << 58))
    want = F.lit(wanted_sample(max(1, min(MAX_CLUSTERS, limit // CLUSTER_ROWS))))
    while True:
        size = shards.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("was").alias("was"))
        size = cut(size.filter((F.col("n") > limit) & (4 * F.col("n") <= 3 * F.col("was"))).select(*key, "n"))
        if size.isEmpty():
            return settled.unionByName(shards.drop("was"))
        sample = shards.join(size, key).filter(F.pmod(F.xxhash64("node", F.lit("split")), F.lit(1 << 30)) < F.least(F.lit(1.0), want / F.col("n")) * (1 << 30))
        made = sample.select(*key, "n", "embedding").groupBy(*key).applyInArrow(_own_centres(CLUSTER_ROWS), "dim long, cluster long, centres array<double>")
        splits = cut(made.filter(F.size("centres") > NEAREST_CENTRES * F.col("dim")).join(size, key).withColumn("blocks", F.ceil(F.col("n") / SPLIT_BLOCK).cast("int")))
        settled = stored(settled.unionByName(shards.drop("was").join(splits.select(*key), key, "left_anti")), "settled")
        again = shards.join(splits.select(*key, "blocks"), key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
        centres = splits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "block", "centres", "n")
        kind = shards.schema["embedding"].dataType.elementType.simpleString()
        parts = again.groupBy(*key, "block").cogroup(centres.groupBy(*key, "block")).applyInArrow(_to_own_centres, _SHARD.format(kind) + ", was long")
        shards = stored(parts.dropDuplicates([*key, "node"]), "split")


def _own_centres(cluster_rows: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        d, n = key[0].as_py(), group.column("n")[0].as_py()
        c = centres_of(unit(matrix(group.column("embedding"))), max(2, min(MAX_CLUSTERS, n // cluster_rows)))
        return pa.table({"dim": pa.array([d]), "cluster": pa.array([key[1].as_py()]), "centres": pa.array([c.ravel()], pa.list_(pa.float64()))})

    return run


def _to_own_centres(key: tuple, group: pa.Table, centres: pa.Table) -> pa.Table:
    d, cluster = key[0].as_py(), key[1].as_py()
    own = nearest(unit(matrix(group.column("embedding"))), centres.column("centres")[0].values.to_numpy().reshape(-1, d))
    with np.errstate(over="ignore"):
        fresh = np.uint64(0x9E3779B97F4A7C15) * (own.astype(np.uint64) + np.uint64(1)) ^ np.uint64(cluster & (1 << 64) - 1) * np.uint64(0xC2B2AE3D27D4EB4F)
    out = _members(group.select(["node", "weight", "embedding"]), d, (fresh >> np.uint64(1)).astype(np.int64))
    return out.append_column("was", pa.array(np.full(out.num_rows, centres.column("n")[0].as_py()), pa.int64()))


def in_blocks(shards: DataFrame) -> DataFrame:
    """Adds i, j, block: clusters of several blocks are repeated for each pair of blocks."""
    size = cut(shards.groupBy("dim", "cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    rows = shards.join(size, ["dim", "cluster"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


# ---- the graph -------------------------------------------------------------------


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row of unit vectors: the pruned candidates and the very nearest."""
    m = len(x)
    k = min(CANDIDATES, m - 1)
    if k <= 0:
        return [np.zeros(0, np.int64) for _ in range(m)]
    out: list[np.ndarray] = []
    for a in range(0, m, 256):
        s = x[a : a + 256] @ x.T
        rows = np.arange(len(s))
        s[rows, rows + a] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        cand = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1), 1)
        dist = 2 - 2 * np.take_along_axis(s, cand, 1)  # squares of distances
        among = x[cand]
        apart = 2 - 2 * (among @ among.transpose(0, 2, 1))
        alive, chosen = np.ones((len(s), k), bool), np.zeros((len(s), k), bool)
        for _ in range(min(DEGREE, k)):
            some = np.flatnonzero(alive.any(axis=1))
            if not len(some):
                break
            pick = alive[some].argmax(axis=1)
            chosen[some, pick] = True
            alive[some] &= ALPHA**2 * apart[some, pick] > dist[some]
            alive[some, pick] = False
        chosen[:, :NEAREST] = True
        out += [cand[r, chosen[r]] for r in rows]
    return out


def _build(group: pa.Table) -> pa.Table:
    ids = group.column("node").to_numpy()
    lists = robust_prune(unit(matrix(group.column("embedding"))))
    return pa.table({"node": pa.array(ids), "near": pa.array([ids[n] for n in lists], pa.list_(pa.int64()))})


# ---- the search ------------------------------------------------------------------


class Graph:
    """Adjacency of a shard's rows, walked both ways: the neighbours of v are ``to[at[v] : at[v + 1]]``."""

    def __init__(self, ids: np.ndarray, lists: pa.ChunkedArray) -> None:
        lists = lists.combine_chunks()
        flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        order = np.argsort(ids)
        place = np.searchsorted(ids[order], flat)
        known = ids[order][np.minimum(place, len(ids) - 1)] == flat
        a, b = np.repeat(np.arange(len(ids)), size)[known], order[place[known]]
        code = np.unique(np.concatenate((a * len(ids) + b, b * len(ids) + a)))
        self.to = code % len(ids)
        self.at = np.searchsorted(code // len(ids), np.arange(len(ids) + 1))

    def steps(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all neighbours of all of ``v``: the position in ``v``, and the neighbour."""
        n = self.at[v + 1] - self.at[v]
        begin = np.repeat(self.at[v] - np.concatenate(([0], np.cumsum(n)))[:-1], n)
        return np.repeat(np.arange(len(v)), n), self.to[begin + np.arange(len(begin))]


def greedy(x: np.ndarray, graph: Graph, queries: np.ndarray, start: int) -> np.ndarray:
    """For each query the node at which descent from ``start`` ends."""
    at = np.full(len(queries), start)
    score = x[queries] @ x[start]
    todo = np.arange(len(queries))
    while len(todo):
        q, v = graph.steps(at[todo])
        if not len(q):
            return at
        s = np.einsum("pd,pd->p", x[queries[todo[q]]], x[v])
        order = np.lexsort((s, q))
        last = order[np.append(q[order][1:] != q[order][:-1], True)]  # the best neighbour of each query
        better = s[last] > score[todo[q[last]]] + 1e-12
        todo, pick = todo[q[last][better]], last[better]
        at[todo], score[todo] = v[pick], s[pick]
    return at


def expand(x: np.ndarray, graph: Graph, queries: np.ndarray, starts: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, node, cosine) of all nodes met by walking over nodes at or above ``floor``."""
    m = len(x)
    seen = np.zeros((len(queries), m), bool)
    rows = np.arange(len(queries))
    seen[rows, starts] = seen[rows, queries] = True
    q, v = np.nonzero(seen)
    out = []
    while len(q):
        s = np.concatenate([np.einsum("pd,pd->p", x[queries[q[a : a + 20_000]]], x[v[a : a + 20_000]]) for a in range(0, len(q), 20_000)])
        out.append((q, v, s))
        q, v = q[s >= floor], v[s >= floor]
        fresh = np.zeros_like(seen)
        for a in range(0, len(q), 10_000):
            p, to = graph.steps(v[a : a + 10_000])
            fresh[q[a : a + 10_000][p], to] = True
        fresh &= ~seen
        seen |= fresh
        q, v = np.nonzero(fresh)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _search(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        ids, weight = group.column("node").to_numpy(), group.column("weight").to_numpy()
        block = group.column("block").to_numpy()
        raw = scaled(matrix(group.column("embedding")))
        norm = np.linalg.norm(raw, axis=1)
        x = raw / norm[:, None]
        m = len(x)
        lists = group.column("clusters").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        of = np.full((m, int(size.max())), -1, np.int64)  # -1 is no cluster; rows are short
        of[np.repeat(np.arange(m), size), np.arange(len(lists.flatten())) - np.repeat(lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), size)] = lists.flatten().to_numpy()
        here = group.column("cluster")[0].as_py()
        split = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        graph = Graph(ids, group.column("near"))
        medoid = int((x @ x.mean(axis=0)).argmax())

        def found(queries: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
            q, v, s = expand(x, graph, queries, greedy(x, graph, queries, medoid), floor)
            q = queries[q]
            keep = (s >= threshold - 1e-9) & (q != v)
            q, v = q[keep], v[keep]
            exact = np.einsum("pd,pd->p", raw[q], raw[v]) / (norm[q] * norm[v]) >= threshold
            return q[exact], v[exact]

        def first_shared(q: np.ndarray, v: np.ndarray) -> np.ndarray:
            """The smallest cluster that both nodes of a pair are in."""
            best = np.full(len(q), np.iinfo(np.int64).max)
            for a in range(of.shape[1]):
                for b in range(of.shape[1]):
                    same = (of[q, a] == of[v, b]) & (of[q, a] >= 0)
                    best[same] = np.minimum(best[same], of[q[same], a])
            return best

        tried = np.unique(np.linspace(0, m - 1, min(m, 8 * AUDITED)).astype(int))
        linked = (x[tried] @ x.T >= threshold).sum(axis=1) - 1
        audit, truth = tried[linked > 0][:AUDITED], int(linked[linked > 0][:AUDITED].sum())
        floor = threshold - SLACK
        while floor > -1 and truth and len(found(audit, floor)[0]) < 0.99 * truth:
            floor -= 0.1

        links, label = np.zeros(m, np.int64), np.arange(m)
        for a in range(0, m, _STEP):
            q, v = found(np.arange(a, min(m, a + _STEP)), floor)
            if split:
                cross = block[q] != block[v]
                q, v = q[cross], v[cross]
            mine = first_shared(q, v) == here
            q, v = q[mine], v[mine]
            np.add.at(links, q, weight[v])
            while len(q) and (label[q] != label[v]).any():
                low = np.minimum(label[q], label[v])
                np.minimum.at(label, label[q], low)
                np.minimum.at(label, label[v], low)
                label = label[label]
        while (label != label[label]).any():
            label = label[label]
        hit = np.flatnonzero((links > 0) | (label != np.arange(m)))
        return pa.table({"node": pa.array(ids[hit], pa.int64()), "links": pa.array(links[hit], pa.int64()), "root": pa.array(ids[label[hit]], pa.int64())})

    return run


# ---- the operator ------------------------------------------------------------------


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all rows of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    h = [F.when(F.col("vec_id").isNotNull(), x) for x in (F.xxhash64("embedding"), F.xxhash64(F.lit("second"), "embedding"))]
    keyed = valid_vectors(vectors.filter("vec_id is not null")).select("vec_id", h[0].alias("h1"), h[1].alias("h2"), "embedding")
    nodes = stored(
        keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")), "nodes"
    )
    rows = stored(refined(stored(sharded(nodes, train_centres(nodes, nodes.count())), "members"), SPLIT_ROWS), "clusters")
    of = rows.groupBy("node").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))  # a few for each node
    shards = stored(in_blocks(rows.join(of, "node")), "shards")
    built = shards.groupBy("dim", "cluster", "i", "j").applyInArrow(_build, "node long, near array<long>")
    near = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    searched = shards.join(near, "node").groupBy("dim", "cluster", "i", "j").applyInArrow(_search(threshold), "node long, links long, root long")
    found = cut(searched)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = nodes.select("h1", "h2", "node", "weight").join(links, "node", "left").join(labels, "node", "left")
    out = vectors.select("vec_id", h[0].alias("h1"), h[1].alias("h2")).join(of, ["h1", "h2"], "left")
    count = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
    out = out.select("vec_id", count.cast("bigint").alias("n_links"), F.coalesce("component", "node", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def recall(vectors: DataFrame, result: DataFrame, queries: int = 200, threshold: float = THRESHOLD) -> float:
    """Links found over links there are, for about ``queries`` vectors against all rows, in blocks."""
    ship(vectors.sparkSession)
    good = valid_vectors(vectors)
    n = good.count()
    picked = good.filter(F.pmod(F.xxhash64("vec_id", F.lit("audit")), F.lit(1 << 30)) < min(1.0, queries / max(n, 1)) * (1 << 30)).limit(2 * queries)
    rows = [(r["vec_id"], r["embedding"]) for r in picked.select("vec_id", "embedding").collect()]
    if not rows:
        return 1.0
    shared = vectors.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(0)))
            q = unit(np.array([e for _, e in shared.value], np.float64))
            hits = (q @ x.T >= threshold).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in shared.value], pa.int64()), pa.array(hits, pa.int64())], ["vec_id", "hits"])

    truth = good.select("embedding").mapInArrow(run, "vec_id long, hits long").groupBy("vec_id").agg((F.sum("hits") - 1).alias("truth"))
    row = truth.join(result, "vec_id").agg(F.sum("truth").alias("t"), F.sum(F.least("truth", "n_links")).alias("f")).first()
    return 1.0 if not row["t"] else row["f"] / row["t"]


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r(id, seen) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a
), c AS (
  SELECT id, min(seen) AS component_id FROM r GROUP BY id
)
SELECT c.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.id = c.component_id AS kept
FROM c LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = c.id
"""
