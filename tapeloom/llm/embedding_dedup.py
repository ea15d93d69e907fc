"""Embedding near-dedup: epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import connected_components, joined_counted, joined_wide, least_reached, running_totals, written

#: Vectors in a block, leading principal dimensions that are gridded, vectors compared at once, and intervals that make one of the level above.
BLOCK, DIMS, LEAF, FAN = 512, 6, 64, 8


def _unit(x: np.ndarray) -> np.ndarray:
    """The rows of x at length one; scaled by their largest component first, as squares of 1e200 or 1e-200 are no numbers."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _principal(vectors: DataFrame, n: int, sample: int) -> dict[int, np.ndarray]:
    """For each length of the `n` vectors, its leading principal directions, from about `sample` unit vectors.

    Any orthonormal directions give the same links; these only make the grid prune well.
    """
    rows = vectors.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 20)) < F.lit(math.ceil(sample / max(n, 1) * (1 << 20)))).select("v").toPandas()["v"]
    out = {}
    for dim, own in rows.groupby(rows.map(len)):
        x = _unit(np.stack(own.to_numpy()))
        out[int(dim)] = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:DIMS].T
    return out


def _near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """grp, i, j (i <= j): the pairs of blocks whose boxes are at most eps apart.

    The blocks of a group are a sequence in grid order. FAN intervals of it make one of the level above, with the box around them; from the
    top, the pairs of near intervals are split into the pairs of their parts, and pairs that are far apart go
    with all that lies below them. A level is two joins of such pairs with the parts of their intervals.
    """
    box = [F.min(F.col("lo")[k]).alias(f"lo{k}") for k in range(DIMS)] + [F.max(F.col("hi")[k]).alias(f"hi{k}") for k in range(DIMS)]
    top, width = blocks.agg(F.max("block")).first()[0] or 0, 1
    while width <= top:
        width *= FAN
    pairs = blocks.select("grp").distinct().select("grp", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    while width > 1:
        width //= FAN
        parts = blocks.groupBy("grp", F.expr(f"block div {width}").alias("at")).agg(*box).withColumn("up", F.expr(f"at div {FAN}"))
        side = lambda n: parts.select("grp", F.col("up").alias(n), F.col("at").alias(f"{n}_at"), *[F.col(f"{x}{k}").alias(f"{x}{k}_{n}") for x in ("lo", "hi") for k in range(DIMS)])  # noqa: B023, E731
        gap = [F.greatest(F.lit(0.0), F.col(f"lo{k}_i") - F.col(f"hi{k}_j"), F.col(f"lo{k}_j") - F.col(f"hi{k}_i")) for k in range(DIMS)]
        pairs = pairs.join(side("i"), ["grp", "i"]).join(side("j"), ["grp", "j"]).where("i_at <= j_at").where(sum(g * g for g in gap) <= eps * eps)
        pairs = pairs.select("grp", F.col("i_at").alias("i"), F.col("j_at").alias("j"))
    return pairs


def _far(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether the boxes around the rows of a and b are more than eps apart."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(gap @ gap) > eps * eps


def _join(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, near: np.ndarray, i: int, j: int, limit: float, eps: float) -> None:
    """Marks in `near` the pairs of rows of x and y with cosine >= limit, halving the intervals until one is far or small."""
    if _far(px, py, eps):
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        near[i : i + len(x), j : j + len(y)] = x @ y.T >= limit
        return
    cut_x = [(0, len(x))] if len(x) <= LEAF else [(0, len(x) // 2), (len(x) // 2, len(x))]
    cut_y = [(0, len(y))] if len(y) <= LEAF else [(0, len(y) // 2), (len(y) // 2, len(y))]
    for a, b in cut_x:
        for c, d in cut_y:
            _join(x[a:b], px[a:b], y[c:d], py[c:d], near, i + a, j + c, limit, eps)


def embedding_classes(vectors: DataFrame, limit: float = 0.98, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of every row of `vectors`: vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, they have the same length and their cosine, in double
    precision, is `limit` or more. On unit vectors that is a distance of at most sqrt(2 - 2 limit), the grid's
    cell size. Equal vectors stand for one, with their number. The vectors of a label are sorted by
    their cells on the leading principal directions and cut into blocks; the sequence of blocks is joined
    with itself by halving it into intervals, from the whole sequence down, leaving out pairs of intervals whose boxes are far
    apart; inside a pair of blocks the same goes on. A pair of blocks gives each vector's number
    of links and the smallest vector it reaches, not the pairs.

    Vectors that are null, empty, zero or hold null or non-finite components have no links, as have those with a null label;
    rows with a null vec_id are not linked; rows that share a vec_id are vectors of their own, linked by their components only;
    an empty table gives no rows.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * limit)) + 1e-9
    v = F.col(vector_col)
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"), fine.alias("fine"))
    good = given.where(F.col("fine") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    same = ["grp", "h1", "h2"]
    good = good.select("vec_id", F.xxhash64("label", F.size("v")).alias("grp"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    kinds = written(good.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()))
    counted = kinds.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    axes = _principal(kinds, counted["kinds"], sample)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = []
            for x in b["v"]:
                axis = axes.get(len(x))
                q = (_unit(x) @ axis).tolist() if axis is not None else []
                p.append(q + [0.0] * (DIMS - len(q)))
            yield b.assign(p=p)

    kind = kinds.schema["v"].dataType.simpleString()
    placed = kinds.select("node", "grp", "v", "n").mapInPandas(project, f"node long, grp long, v {kind}, n long, p array<double>")
    order = [f"c{k}" for k in range(DIMS)]
    placed = placed.select("*", *[F.floor(F.col("p")[k] / eps).alias(c) for k, c in enumerate(order)], F.lit(1).cast("long").alias("one"))
    placed = running_totals(placed, ["grp"], [*order, "node"], {"one": "nth"})
    number = "<f4" if kind == "array<float>" else "<f8"

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values([*order, "node"])
        p, x = np.stack(b["p"].to_numpy()), np.stack(b["v"].to_numpy())
        return pd.DataFrame([{"grp": b["grp"].iloc[0], "block": b["block"].iloc[0], "size": len(b), "nodes": b["node"].to_numpy("<i8").tobytes(), "weights": b["n"].to_numpy("<i8").tobytes(), "x": x.astype(number).tobytes(), "p": p.astype("<f8").tobytes(), "lo": p.min(axis=0).tolist(), "hi": p.max(axis=0).tolist()}])

    cut = placed.select("grp", F.expr(f"nth div {BLOCK}").alias("block"), "node", "v", "n", "p", *order)
    blocks = written(cut.groupBy("grp", "block").applyInPandas(pack, "grp long, block long, size long, nodes binary, weights binary, x binary, p binary, lo array<double>, hi array<double>"))
    pairs = written(_near_blocks(blocks.select("grp", "block", "lo", "hi"), eps))
    many = pairs.count()
    both = pairs
    for side in ("i", "j"):
        both = joined_wide(both, blocks.select("grp", F.col("block").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("size", "nodes", "weights", "x", "p")]), ["grp", side], many)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unpack(size, nodes, weights, x, p):
            return np.frombuffer(nodes, "<i8"), np.frombuffer(weights, "<i8"), _unit(np.frombuffer(x, number).reshape(size, -1)), np.frombuffer(p, "<f8").reshape(size, -1)

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                nodes_i, w_i, x_i, p_i = unpack(r.size_i, r.nodes_i, r.weights_i, r.x_i, r.p_i)
                nodes_j, w_j, x_j, p_j = unpack(r.size_j, r.nodes_j, r.weights_j, r.x_j, r.p_j)
                near = np.zeros((r.size_i, r.size_j), bool)
                _join(x_i, p_i, x_j, p_j, near, 0, 0, limit, eps)
                if r.i == r.j:
                    np.fill_diagonal(near, False)
                    near |= near.T
                root_i, root_j = least_reached(near, nodes_i, nodes_j)
                out.append(pd.DataFrame({"node": nodes_i, "links": near @ w_j, "root": root_i}))
                if r.i != r.j:
                    out.append(pd.DataFrame({"node": nodes_j, "links": w_i @ near, "root": root_j}))
            if out:
                yield (one := pd.concat(out))[one["links"] > 0].astype("int64")

    found = written(both.mapInPandas(link, "node long, links long, root long"))
    reps = kinds.select("node", "rep")
    classes = written(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(reps, "node"))
    firsts = classes.groupBy("component").agg(F.min("rep").alias("first"), F.count("*").alias("n"))
    classes = joined_counted(classes.select("component", "node"), firsts, ["component"], classes.count()).select("node", "first")
    facts = kinds.select(*same, "n", "node", "rep").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(classes, "node", "left")
    facts = facts.select(*same, "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id"))
    known = joined_counted(good.select("vec_id", *same), facts, same, counted["rows"]).select("vec_id", "n_links", "component_id")
    rest = given.where(~F.col("fine") | F.col("label").isNull() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_query(spark, sf_dir: str) -> DataFrame:
    return embedding_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
