"""Centroid clustering by ball k-means, exact in integers.

A cluster is a ball: its centroid and a radius that no member exceeds. Another cluster is a neighbour if half
the distance of the centroids is within that radius; no other can win a member. Neighbours in rising distance cut
the ball into a stable core, whose members stay, and annuli; a member of the n-th annulus is compared, exactly, with
the nearest n neighbours only. Radii come from the pass before, enlarged by how far the centroid has moved since,
so a round is one pass; sums are kept up to date by the vectors that have moved.

Distances, comparisons with half distances and means are integers, so the results equal those of the plain
iteration, ties included. Bounds on radii are floating, with a margin that only ever adds neighbours.

Edge cases: vectors that are null, of another length or with a null or non-finite component go. Fewer vectors than
clusters give as many clusters as vectors; an empty table gives an empty result. Equal vectors and repeated
rows fall into one cluster. Among equal ids, which null ids follow, the smaller vector is the earlier start.
Columns other than id and vector are not read, so their names cannot clash. Squared distances, and their sums,
that exceed 64 bits are null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, staged
from .vector_blocks import Block, Changes, Rounds, as_long, integers, quantised, sha256, squared, valid

#: Relative room for rounding of radii and of distances of centroids.
MARGIN = 1e-9


@dataclass(frozen=True)
class Balls:
    """Centroids, and of each its neighbours in rising distance with these distances squared."""

    centroids: np.ndarray
    neighbours: list[np.ndarray]
    apart: list[np.ndarray]


def balls(centroids: list[list[int]], radii: list[float], width: int) -> Balls:
    """Neighbours by radii: ``radii`` bound the distance of every member."""
    points = integers(centroids, width)
    between = squared(points, points)
    neighbours, apart = [], []
    for j, r in enumerate(radii):
        near = [i for i in range(len(centroids)) if i != j and math.sqrt(between[j, i]) * (1 - MARGIN) <= 2 * r * (1 + MARGIN)]
        near.sort(key=lambda i: (between[j, i], i))
        neighbours.append(np.array(near, np.int64))
        apart.append(between[j, near])
    return Balls(points, neighbours, apart)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of every vector, by comparing all."""
    d = squared(x, centroids)
    labels = d.argmin(1).astype(np.int64)
    return labels, d[np.arange(len(x)), labels]


def reassigned(x: np.ndarray, labels: np.ndarray, b: Balls) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid, from the clusters that the vectors are in."""
    out, least = labels.copy(), None
    for j in np.unique(labels).tolist():
        members = np.flatnonzero(labels == j)
        own = squared(x[members], b.centroids[j : j + 1])[:, 0]
        # The annulus: how many neighbours are no farther than twice the vector's distance. 0 is the stable core.
        annulus = np.searchsorted(b.apart[j], 4 * own, side="right")
        best, label = own.copy(), np.full(len(members), j)
        for t, i in enumerate(b.neighbours[j][: annulus.max()].tolist()):
            asked = np.flatnonzero(annulus > t)
            d = squared(x[members[asked]], b.centroids[i : i + 1])[:, 0]
            won = (d < best[asked]) | ((d == best[asked]) & (i < label[asked]))
            best, d = (best.astype(object), d) if d.dtype == object else (best, d)
            best[asked[won]], label[asked[won]] = d[won], i
        if least is None:
            least = np.zeros(len(x), best.dtype)
        if best.dtype == object:
            least = least.astype(object)
        out[members], least[members] = label, best
    return out, least


def ball_kmeans(
    df: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, dim: int = 64, id: str = "vec_id", vector: str = "embedding", block_rows: int = 4096
) -> DataFrame:
    """Per valid vector: id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Starts are the vectors whose ids have the least sha256 of ``seed:id``. The rounds end early when no vector moves,
    as later ones would change nothing.
    """
    spark = df.sparkSession
    kept = valid(df.select(id, vector), vector, dim)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")), 256)
    starts = kept.orderBy(order.asc_nulls_last(), vector).limit(clusters).collect()
    centroids = quantised(np.array([r[vector] for r in starts], np.float64).reshape(-1, dim), scale).tolist()
    kind = kept.schema[id].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"`{id}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    with Scratch(spark) as scratch:
        passes = Rounds(kept, scratch, dim, scale, dim, block_rows)
        counts, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
        radii = [math.inf] * len(centroids)
        for done in range(rounds):
            found = balls(centroids, radii, dim)

            def visit(block: Block, changes: Changes, found: Balls = found) -> bytes:
                if block.memory is None:
                    labels, d = nearest(block.x, found.centroids)
                    changes.add(labels, block.x, 1)
                else:
                    before = np.frombuffer(block.memory, np.int32).astype(np.int64)
                    labels, d = reassigned(block.x, before, found)
                    moved = np.flatnonzero(labels != before)
                    changes.add(before[moved], block.x[moved], -1)
                    changes.add(labels[moved], block.x[moved], 1)
                for j in np.unique(labels).tolist():
                    changes.reach(j, float(d[labels == j].max()))
                return labels.astype(np.int32).tobytes()

            totals = passes.step(visit)
            for j, t in totals.items():
                counts[j] += t.n
                sums[j] = [a + b for a, b in zip(sums[j], t.v, strict=True)]
            moved = [[s // counts[j] for s in sums[j]] if counts[j] else centroids[j] for j in range(len(centroids))]
            drifts = [math.sqrt(sum((a - b) ** 2 for a, b in zip(old, new, strict=True))) for old, new in zip(centroids, moved, strict=True)]
            radii = [(math.sqrt(totals[j].far) if j in totals else 0.0) + drifts[j] for j in range(len(centroids))]
            settled = moved == centroids
            centroids = moved
            if settled:
                break

        found = balls(centroids, radii, dim)

        def last(block: Block, found: Balls = found) -> list[pa.Array]:
            if block.memory is None:
                labels, d = nearest(block.x, found.centroids)
            else:
                labels, d = reassigned(block.x, np.frombuffer(block.memory, np.int32).astype(np.int64), found)
            return [pa.array(labels, pa.int32()), as_long(d)]

        assigned = staged(passes.rows_of(last, "cluster int, distance long", ["cluster", "distance"]), "ball-assigned")
        # One row a cluster.
        inertia = {r["cluster"]: None if r["missing"] else int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.max(F.col("distance").isNull()).alias("missing")).collect()}
        whole = None if None in inertia.values() else sum(inertia.values())
        fits = lambda v: v if v is not None and v < 1 << 63 else None
        facts = spark.createDataFrame([(j, fits(v), fits(whole), sha256([centroids[j]])) for j, v in sorted(inertia.items())] or [], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return scratch.kept(assigned.join(F.broadcast(facts), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "ball-result")
