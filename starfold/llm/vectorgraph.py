"""Near-duplicate vectors with a robust-pruned flat graph.

Equal vectors are one node. Nodes go to the shards of their nearest centroids, several
each, so that shards overlap; centroids closer than the links sought are one shard, and
a shard too large for a task is cut into blocks, two to a task. Every task prunes its
nearest-neighbour lists robustly (a neighbour that a nearer one leads to is left out); the lists of all
tasks are united. Groups that close links of the united lists hold together over several
shards become a shard of their own, whose pairs are all compared. Every node then searches its tasks' part of the graph: greedily from the
medoids and from itself, and, once near, through everything within a widened range. Candidates
are verified in double precision and counted in one of the tasks that hold the pair.

The vectors whose id is divisible by ``AUDIT`` are compared with all vectors, and the recall is the mean
over those that have links; below ``RECALL`` nodes join more shards and the work is done again. Where
that would cost as much as comparing all pairs, or where no audited vector has a link, all pairs are
compared, in blocks.

Edge cases: vectors that are NULL, empty, zero, without an id, or hold NULL or non-finite
components link with nothing and are their own component; vectors of different lengths
never link; rows that repeat a vector link with each other; no rows give no rows; labels and
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import keep
from starfold.llm.graph import components

#: Vectors that centroids are fitted on, at most; ids divisible by this are audited, so many vectors at once.
SAMPLE, AUDIT, AUDIT_BLOCK = 8_192, 50, 1_024
#: Members a shard should have, shards at most, members of a block, shards of a node in the first try.
SHARD, MOST_SHARDS, BLOCK, OVERLAP = 2_048, 512, 2_048, 3
#: Centroids with at least this cosine are one shard.
TOGETHER = 0.6
#: Nearest neighbours looked at, neighbours kept, slack of the pruning rule, beam of the search.
NEAREST, DEGREE, ALPHA, BEAM = 48, 24, 1.2, 24
#: The search goes through everything this much below the sought cosine.
WIDER = 0.05
RECALL = 0.98


def unit_rows(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of equally long lists, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sound(v):
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0)


def centroids(x: np.ndarray, k: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Spherical k-means."""
    dice = np.random.default_rng(seed)
    c = x[dice.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def _merged(c: np.ndarray) -> np.ndarray:
    """Shard number of each centroid: those closer than ``TOGETHER`` share one."""
    up = list(range(len(c)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in zip(*np.nonzero(np.triu(c @ c.T >= TOGETHER, 1))):
        up[root(int(a))] = root(int(b))
    return np.array([root(k) for k in range(len(c))])


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of every row of ``x`` (unit rows) after pruning, with the reverse ones."""
    n = len(x)
    near = min(NEAREST, n - 1)
    if near <= 0:
        return [np.zeros(0, dtype=np.int64) for _ in range(n)]
    edges = []
    for at in range(0, n, 256):
        s = x[at : at + 256] @ x.T
        rows = np.arange(len(s))
        s[rows, at + rows] = -2
        c = np.argpartition(-s, near - 1, axis=1)[:, :near]
        d = 1 - np.take_along_axis(s, c, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(c, order, axis=1), np.take_along_axis(d, order, axis=1)
        between = 1 - np.matmul(x[c], x[c].transpose(0, 2, 1))
        alive = np.ones(c.shape, dtype=bool)
        for _ in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            edges.append(np.stack([at + rows[some], c[rows, pick][some]], axis=1))
            alive &= ALPHA * between[rows, pick] > d
            alive[rows, pick] = False
    both = np.concatenate(edges)
    both = np.unique(np.concatenate([both, both[:, ::-1]]), axis=0)
    return np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, n)))


def search(x: np.ndarray, lists: list[np.ndarray], least: float, rows_at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) of rows of ``x`` whose cosine is near ``least`` or above, block by block of queries."""
    n = len(x)
    width = max(1, max((len(v) for v in lists), default=1))
    table = np.full((n, width), -1, dtype=np.int64)
    for k, v in enumerate(lists):
        table[k, : len(v)] = v
    parts = max(1, n // 64)
    dice = np.random.default_rng(n)
    heads = dice.choice(n, size=min(parts, n), replace=False)
    home = (x @ x[heads].T).argmax(axis=1)
    medoids = []
    for h in range(len(heads)):
        own = np.flatnonzero(home == h)
        if len(own):
            medoids.append(own[(x[own] @ x[own].sum(axis=0)).argmax()])
    medoids = np.array(medoids)
    for start in range(0, n, rows_at_once):
        q = np.arange(start, min(n, start + rows_at_once))
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), dtype=bool)
        first = x[q] @ x[medoids].T
        take = min(BEAM - 1, len(medoids))
        top = np.argpartition(-first, take - 1, axis=1)[:, :take]
        beam = np.full((len(q), BEAM), -1, dtype=np.int64)
        sims = np.full((len(q), BEAM), -2.0, dtype=x.dtype)
        beam[:, :take], sims[:, :take] = medoids[top], np.take_along_axis(first, top, axis=1)
        # the query's own node starts too: no medoid need lie in a group whose lists stay inside it
        beam[:, take], sims[:, take] = q, 1
        seen[rows[:, None], beam[:, : take + 1]] = True
        opened = np.zeros_like(seen)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        a, b = np.nonzero(sims >= least - WIDER)
        hits.append((a, beam[a, b]))
        for _ in range(4 * BEAM):
            closed = (beam < 0) | opened[rows[:, None], np.maximum(beam, 0)]
            rank = np.where(closed, -3.0, sims)
            pick = rank.argmax(axis=1)
            live = rank[rows, pick] > -2
            if not live.any():
                break
            r = rows[live]
            node = beam[r, pick[live]]
            opened[r, node] = True
            near = table[node]
            good = (near >= 0) & ~seen[r[:, None], np.maximum(near, 0)]
            i, j = np.nonzero(good)
            to, by = near[i, j], r[i]
            seen[by, to] = True
            s = np.einsum("ij,ij->i", x[q[by]], x[to])
            close = s >= least - WIDER
            hits.append((by[close], to[close]))
            fresh = np.full((len(r), width), -2.0, dtype=x.dtype)
            fresh[i, j] = s
            all_s = np.concatenate([sims[r], fresh], axis=1)
            all_n = np.concatenate([beam[r], near], axis=1)
            best = np.argpartition(-all_s, BEAM - 1, axis=1)[:, :BEAM]
            sims[r], beam[r] = np.take_along_axis(all_s, best, axis=1), np.take_along_axis(all_n, best, axis=1)
        by, to = (np.concatenate([h[k] for h in hits]) for k in (0, 1))
        out = [(by, to)]
        while len(by):  # widen: open every close node that is not yet open
            shut = ~opened[by, to]
            by, to = by[shut], to[shut]
            opened[by, to] = True
            nexts = []
            for at in range(0, len(by), 2048):
                near = table[to[at : at + 2048]]
                i, j = np.nonzero(near >= 0)
                key = np.unique(by[at : at + 2048][i] * n + near[i, j])
                qq, nn = key // n, key % n
                new = ~seen[qq, nn]
                qq, nn = qq[new], nn[new]
                seen[qq, nn] = True
                s = np.einsum("ij,ij->i", x[q[qq]], x[nn])
                close = s >= least - WIDER
                nexts.append((qq[close], nn[close]))
            by, to = (np.concatenate([p[k] for p in nexts]) if nexts else np.zeros(0, dtype=np.int64) for k in (0, 1))
            out.append((by, to))
        yield q[np.concatenate([o[0] for o in out])], np.concatenate([o[1] for o in out])


def all_pairs(x: np.ndarray, least: float, rows_at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``search``, by comparison of all rows of ``x`` (a little below ``least``, for single precision)."""
    for start in range(0, len(x), rows_at_once):
        a, b = np.nonzero(x[start : start + rows_at_once] @ x.T >= least - 1e-3)
        yield start + a, b


def _assign(nodes: DataFrame, shards: dict[int, tuple[np.ndarray, np.ndarray]], overlap: int) -> DataFrame:
    """``nodes`` (cid, v, many) with ``shards``: sorted numbers of the shards each belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            length = np.array([len(r) for r in v])
            out: list = [None] * len(v)
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                if int(d) not in shards:
                    for i in at:
                        out[i] = [0]
                    continue
                c, number = shards[int(d)]
                s = unit_rows(v.take(pa.array(at))) @ c.T
                k = min(overlap, s.shape[1])
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                for i, row in zip(at, best):
                    out[i] = sorted({int(x) for x in number[row]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=["cid", "v", "many", "shards"])

    return nodes.select("cid", "v", "many").mapInArrow(run, "cid long, v array<float>, many long, shards array<long>")


def _placed(nodes: DataFrame) -> DataFrame:
    """A row per task of each node: length, shard, blocks i and j of the task, own block."""
    each = nodes.withColumn("shard", F.explode("shards")).withColumn("length", F.size("v"))
    parts = each.groupBy("length", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    return (
        each.join(parts, ["length", "shard"])
        .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .drop("other", "parts")
    )


_TASK = ("length", "shard", "i", "j")


def _lists(placed: DataFrame, least: float) -> DataFrame:
    """cid, near, close: the united neighbour lists of the whole graph, and the part of them near ``least`` or above."""

    def build(key, members):
        cid = members.column("cid").to_numpy()
        x = unit_rows(members.column("v").combine_chunks()).astype(np.float32)
        lists = robust_prune(x)
        close = [v[x[v] @ x[k] >= least - WIDER] for k, v in enumerate(lists)]
        kind = pa.list_(pa.int64())
        return pa.table({
            "cid": pa.array(cid), "near": pa.array([cid[v] for v in lists], kind), "close": pa.array([cid[v] for v in close], kind),
        })

    made = placed.select(*_TASK, "cid", "v").groupBy(*_TASK).applyInArrow(build, "cid long, near array<long>, close array<long>")
    united = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "close")]
    return made.groupBy("cid").agg(*united)


def _bridged(assigned: DataFrame, lists: DataFrame) -> DataFrame:
    """``assigned`` with one more shard (numbers below -1) for groups that close links connect and no shard holds whole."""
    linked = components(lists.select(F.col("cid").alias("a"), F.explode("close").alias("b")))
    group = keep(assigned.select("cid", "shards").join(linked.withColumnRenamed("node", "cid"), "cid"), "linked")
    size = group.groupBy("component").agg(F.count("*").alias("size"))
    held = group.withColumn("shard", F.explode("shards")).groupBy("component", "shard").agg(F.count("*").alias("held"))
    most = held.groupBy("component").agg(F.max("held").alias("most"))
    split = size.join(most, "component").filter("most < size").select("component")
    own = group.join(split, "component").select("cid", (-F.shiftrightunsigned("component", 2) - 2).alias("own_shard"))
    shards = F.when(F.col("own_shard").isNull(), F.col("shards")).otherwise(F.concat(F.array("own_shard"), "shards"))
    return assigned.join(own, "cid", "left").select("cid", "v", "many", shards.alias("shards"))


def _searched(placed: DataFrame, lists: DataFrame | None, least: float) -> DataFrame:
    """cid, found (linked vectors counted in one task), root (least node linked in that task); without lists all pairs of a task are compared."""

    every = lists is None

    def run(key, members):
        shard, i, j = (k.as_py() for k in key[1:])
        cid, many = members.column("cid").to_numpy(), members.column("many").to_numpy()
        own = members.column("own").to_numpy()
        exact = unit_rows(members.column("v").combine_chunks())
        homes = members.column("shards").to_pylist()
        width = max(len(h) for h in homes)
        home = np.full((len(homes), width), -1, dtype=np.int64)
        for k, h in enumerate(homes):
            home[k, : len(h)] = h
        found = np.zeros(len(cid), dtype=np.int64)
        up = np.arange(len(cid))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        if every or shard < -1:
            pairs = all_pairs(exact.astype(np.float32), least)
        else:
            place = {c: k for k, c in enumerate(cid.tolist())}
            near = [np.array([place[c] for c in row if c in place], dtype=np.int64) for row in members.column("near").to_pylist()]
            pairs = search(exact.astype(np.float32), near, least)
        for a, b in pairs:
            for at in range(0, len(a), 65_536):
                x, y = a[at : at + 65_536], b[at : at + 65_536]
                s = np.einsum("ij,ij->i", exact[x], exact[y])
                ok = (s >= least) & (x != y)
                x, y = x[ok], y[ok]
                # a pair counts in the first shard both are in, in the task of its two blocks; shards that compare all come first
                shared = (home[x][:, :, None] == home[y][:, None, :]) & (home[x] != -1)[:, :, None]
                first = np.where(shared.any(axis=2), home[x], np.iinfo(np.int64).max).min(axis=1)
                ok = (first == shard) & (np.minimum(own[x], own[y]) == i) & (np.maximum(own[x], own[y]) == j)
                x, y = x[ok], y[ok]
                found += np.bincount(x, weights=many[y], minlength=len(cid)).astype(np.int64)
                star = np.full(len(cid), len(cid), dtype=np.int64)
                np.minimum.at(star, x, y)
                for k in np.flatnonzero(star < len(cid)):
                    up[root(int(k))] = root(int(star[k]))
                for k, m in zip(x.tolist(), y.tolist()):
                    if up[k] != up[m]:
                        up[root(k)] = root(m)
        roots = np.array([root(k) for k in range(len(cid))], dtype=np.int64)
        return pa.table({"cid": pa.array(cid), "found": pa.array(found), "root": pa.array(cid[roots])})

    rows = placed if every else placed.join(lists.select("cid", "near"), "cid")
    return rows.groupBy(*_TASK).applyInArrow(run, "cid long, found long, root long")


def _recall(nodes: DataFrame, counted: DataFrame, least: float) -> float | None:
    """Mean share of its links that the search found, over the audited nodes that have links; ``None`` if none has.

    Audited nodes are compared with every node, ``AUDIT_BLOCK`` of them in a pass, so the driver holds one block.
    """
    audited = nodes.filter("audited").select("cid", "v")
    parts = -(-audited.count() // AUDIT_BLOCK)
    share, n = 0.0, 0
    for part in range(parts):
        queries = audited.filter(F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(parts)) == part).toArrow()
        if not queries.num_rows:
            continue
        true = nodes.select("cid", "v", "many").mapInArrow(_brute(queries, least), "cid long, true long")
        true = true.groupBy("cid").agg(F.sum("true").alias("true")).filter(F.col("true") > 0)
        row = true.join(counted.select("cid", "found"), "cid").agg(F.sum(F.least("true", "found") / F.col("true")).alias("s"), F.count("*").alias("n")).first()
        share, n = share + (row["s"] or 0.0), n + row["n"]
    return share / n if n else None


def _brute(queries: pa.Table, least: float):
    """Counts the links of ``queries`` (cid, v) with the rows it is given."""
    length = np.array([len(r) for r in queries.column("v")])
    by_length = {}
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        by_length[int(d)] = (
            queries.column("cid").to_numpy()[at], unit_rows(queries.column("v").combine_chunks().take(pa.array(at)))
        )

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            v, many, cid = batch.column("v"), batch.column("many").to_numpy(), batch.column("cid").to_numpy()
            size = np.array([len(r) for r in v])
            for d, (names, q) in by_length.items():
                every = np.flatnonzero(size == d)
                for k in range(0, len(every), BLOCK):
                    at = every[k : k + BLOCK]
                    hit = (q @ unit_rows(v.take(pa.array(at))).T >= least) & (names[:, None] != cid[at][None, :])
                    for name, n in zip(names.tolist(), (hit @ many[at]).tolist()):
                        total[name] = total.get(name, 0) + n
        yield pa.RecordBatch.from_pydict({
            "cid": pa.array(list(total), pa.int64()), "true": pa.array(list(total.values()), pa.int64()),
        })

    return brute


def _counted(assigned: DataFrame, lists: DataFrame | None, least: float) -> tuple[DataFrame, DataFrame]:
    """What each task found, and the links of each node."""
    found = keep(_searched(keep(_placed(assigned), "placed"), lists, least), "found")
    return found, keep(found.groupBy("cid").agg(F.sum("found").alias("found")), "counted")


def near_duplicates(embeddings: DataFrame, least: float = 0.9) -> tuple[DataFrame, float]:
    """vec_id, n_links, component_id, kept of every row of ``embeddings`` (vec_id, embedding); and the measured recall.

    The recall is at least ``RECALL``; it is 1 where all pairs were compared.
    """
    v = F.col("embedding").cast("array<float>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("cid", F.when(_sound(F.col("v")) & F.col("vec_id").isNotNull(), F.xxhash64("v")))
    rows = keep(rows, "vectors")
    nodes = keep(
        rows.filter("cid IS NOT NULL").groupBy("cid", "v").agg(
            F.count("*").alias("many"), F.min("vec_id").alias("first"), F.max(F.col("vec_id") % AUDIT == 0).alias("audited")
        ),
        "nodes",
    )
    n = nodes.count()
    recall = 1.0
    if n:
        sample = nodes.orderBy(F.xxhash64("cid", F.lit(1))).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        length = np.array([len(r) for r in sample])
        overlap = OVERLAP
        while True:
            k = min(MOST_SHARDS, -(-n * overlap // SHARD))
            shards = {}
            for d in np.unique(length):
                x = unit_rows(sample.take(pa.array(np.flatnonzero(length == d))))
                c = centroids(x, k)
                shards[int(d)] = (c, _merged(c))
            assigned = keep(_assign(nodes, shards, overlap), "assigned")
            lists = keep(_lists(_placed(assigned), least), "graph")
            found, counted = _counted(_bridged(assigned, lists), lists, least)
            recall = _recall(nodes, counted, least)
            if recall is not None and recall >= RECALL:
                break
            overlap *= 2
            if recall is None or overlap * SHARD >= n:
                found, counted = _counted(_assign(nodes, {}, 1), None, least)
                recall = 1.0
                break
        member = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
        of = nodes.select("cid", "first", "many").join(member, "cid", "left").withColumn("c", F.coalesce("component", "cid"))
        named = of.join(of.groupBy("c").agg(F.min("first").alias("component_id")), "c").join(counted, "cid")
        named = named.select("cid", "component_id", (F.col("found") + F.col("many") - 1).alias("n_links"))
        out = rows.select("vec_id", "cid").join(named, "cid", "left")
    else:
        out = rows.select("vec_id", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("n_links"))
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    ), recall
