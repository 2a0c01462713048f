"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are compared only within a label (and length). Equal vectors are first
made one, with their count. The first principal coordinate cuts a label into
strips no narrower than the largest distance of a link, so that only a strip
and its neighbours can hold links; a strip is cut into tiles of about ``TILE``
rows. A pair of tiles is one group: leading principal dimensions are multiplied
first, what is left is bounded by the product of suffix norms, and pairs that
cannot reach the threshold are dropped; survivors are decided in double
precision on the given numbers. A group returns one row per vector, its links
counted and its local component, never pairs.

Null, zero or non-finite vectors and null labels link with nothing. Repeated
rows count as vectors of their own. A null vec_id links with nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqpanel.functions.checkpoints import checkpointed
from eqpanel.llm.common import table
from eqpanel.llm.components import components

THRESHOLD = 0.93
TILE = 1500
LEAD = 16
ROWS = 256


def _axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by vector length, from the second moments of all rows."""

    def moments(frames):
        for f in frames:
            for d, part in f.groupby("d"):
                x = np.array(part["embedding"].tolist(), np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                m = x.T @ x
                yield pd.DataFrame({"d": int(d), "place": np.arange(m.size), "v": m.ravel()})

    sums = vectors.select("d", "embedding").mapInPandas(moments, "d int, place long, v double").groupBy("d", "place").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, part in sums.groupby("d"):
        _, axes = np.linalg.eigh(part.sort_values("place")["v"].to_numpy().reshape(d, d))
        out[int(d)] = axes[:, ::-1].copy()
    return out


def _linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float):
    """(i, j) of linked rows of a and b, in chunks of rows of a."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    pa, pb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    rest = lambda p: np.sqrt(np.maximum(np.cumsum(p[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
    ra, rb = rest(pa), rest(pb)
    d = pa.shape[1]
    for at in range(0, len(a), ROWS):
        lead = min(LEAD, d)
        dots = pa[at : at + ROWS, :lead] @ pb[:, :lead].T
        bound = dots + (np.outer(ra[at : at + ROWS, lead], rb[:, lead]) if lead < d else 0)
        i, j = np.nonzero(bound >= threshold - 1e-9)
        done = dots[i, j]
        i += at
        while lead < d and len(i):
            to = min(lead + LEAD, d)
            done = done + np.einsum("ij,ij->i", pa[i, lead:to], pb[j, lead:to])
            live = done + (ra[i, to] * rb[j, to] if to < d else 0) >= threshold - 1e-9
            i, j, done, lead = i[live], j[live], done[live], to
        exact = np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j]) >= threshold
        yield i[exact], j[exact]


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = rows.select("vec_id", "embedding", "label")
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    good = rows.filter(usable)
    classes = checkpointed(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("d", F.size("embedding")))
    axes = _axes(classes)
    width = 1.001 * math.sqrt(2 - 2 * threshold)

    def first(frames):
        for f in frames:
            strip = [int(math.floor(np.dot(v, axes[len(v)][:, 0]) / np.linalg.norm(v) / width)) for v in (np.asarray(x, np.float64) for x in f["embedding"])]
            yield f.assign(strip=strip)

    striped = checkpointed(classes.mapInPandas(first, "label int, embedding array<float>, rep long, copies long, d int, strip int"))
    counts = striped.groupBy("label", "d", "strip").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    tiled = striped.join(counts, ["label", "d", "strip"]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    tiles = counts.select("label", "d", "strip", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = tiles.select("label", "d", F.explode(F.array("strip", F.col("strip") + 1)).alias("strip"), F.col("strip").alias("s0"), F.col("part").alias("p0"))
    pairs = near.join(tiles.withColumnRenamed("part", "p1"), ["label", "d", "strip"]).filter("strip > s0 or p1 >= p0")
    pair = F.xxhash64("label", "d", "s0", "p0", "strip", "p1")
    sides = pairs.select("label", "d", F.col("s0").alias("strip"), F.col("p0").alias("part"), pair.alias("pair"), F.lit(0).alias("side")).unionByName(
        pairs.filter("strip > s0 or p1 > p0").select("label", "d", "strip", F.col("p1").alias("part"), pair.alias("pair"), F.lit(1).alias("side"))
    )
    dealt = tiled.join(sides, ["label", "d", "strip", "part"]).select("pair", "side", "rep", "copies", "embedding")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f.side == 0], f[f.side == 1]
        x = np.array(a["embedding"].tolist(), np.float64)
        alone = not len(b)
        y = x if alone else np.array(b["embedding"].tolist(), np.float64)
        if not len(x):
            return pd.DataFrame({"rep": [], "n": [], "root": []})
        ids = a["rep"].to_numpy() if alone else np.concatenate([a["rep"], b["rep"]])
        copies = a["copies"].to_numpy() if alone else np.concatenate([a["copies"], b["copies"]])
        n, root, kept, shift = np.zeros(len(ids), np.int64), ids.copy(), [], 0 if alone else len(x)
        for i, j in _linked(x, y, axes[x.shape[1]], threshold):
            j = j + shift
            i, j = i[i != j], j[i != j]
            np.add.at(n, i, copies[j])
            if not alone:
                np.add.at(n, j, copies[i])
            kept.append((i.astype(np.int32), j.astype(np.int32)))
        i, j = (np.concatenate(k) for k in zip(*kept, strict=True))
        while True:
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            if (low == root).all():
                break
            root = low
        return pd.DataFrame({"rep": ids, "n": n, "root": root})[n > 0]

    found = checkpointed(dealt.groupBy("pair").applyInPandas(compare, "rep long, n long, root long"))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    answer = classes.select("label", "embedding", "rep", "copies").join(links, "rep", "left").join(joined, "rep", "left")
    ok = good.join(answer, ["label", "embedding"]).select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    bad = rows.filter(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ok.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
