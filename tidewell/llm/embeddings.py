"""Embedding near-duplicates by collision counting over sorted projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Written
from tidewell.llm.components import connected_components
from tidewell.llm.simhash import labels, whole_groups

#: Projections whose windows are counted, half a window in standard deviations of a pair at the threshold; cells above this are parted.
COUNTED, HALF, CELL = 24, 1.6, 2048
NO_ID = (1 << 63) - 1


class Calibration:
    """Numbers of projections, cells and collisions that find a pair at the threshold with the wanted probability."""

    def __init__(self, n: int, threshold: float, recall: float):
        angle = math.acos(threshold)
        agree = 1 - angle / math.pi  # one projection puts both of a pair at the threshold on one side
        self.bits = max(4, min(30, math.ceil(math.log2(max(2, n))) - 1))
        self.tables = max(1, math.ceil(math.log((1 - recall) / 2) / math.log(1 - agree**self.bits)))
        self.spread = math.sqrt(2 - 2 * threshold)  # deviation of a projection's difference for that pair
        self.half = HALF * self.spread
        inside = math.erf(HALF / math.sqrt(2))
        tail, self.least = 0.0, 0
        for k in range(COUNTED + 1):  # the most collisions to ask for, so that at most a quarter of the loss is here
            tail += math.comb(COUNTED, k) * inside**k * (1 - inside) ** (COUNTED - k)
            if tail > (1 - recall) / 4:
                self.least = k
                break
        self.window = 4 * self.spread  # of the projection that a cell is sorted by


def _axes(seed: int, dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept): links of cosine threshold or more between all rows, whatever their other columns.

    n_links counts the other rows linked directly, component_id is the smallest id reachable, kept tells whether it is the row's
    own. A vector that is null, empty, zero or holds a null or non-finite component links with nothing. Vectors of
    different lengths don't link. Repeated rows link with each other. A null id links but never names a component
    unless all of it is null. An empty table gives no rows.

    Signs of many one-dimensional projections give each vector a cell in each of several tables; a cell is sorted by
    one more projection, and a window around each vector gives its partners there. Collisions of a pair in windows of
    COUNTED further projections are counted, and pairs with the calibrated count are verified in double precision.
    A pair is taken in the first table that has both in one cell, so no pair is shuffled: tasks return sums of links and a
    spanning forest. Equal vectors are one class. A cell of over CELL classes is parted into pairs of blocks. Numbers of tables and
    projections follow the number of classes and the wanted recall at the threshold.
    """
    vec = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(vec, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, vec).alias("v"))
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))))
    classes = Written(rows.where("v is not null").groupBy("h").agg(F.coalesce(F.min("id"), F.lit(NO_ID)).alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "vectors").df
    number = classes.count()
    c = Calibration(number, threshold, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            at = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                x = flat[at[own][:, None] + np.arange(dim)]
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                p = unit @ _axes(seed, dim, c.tables * (c.bits + 1))
                sign = p[:, : c.tables * c.bits].reshape(-1, c.tables, c.bits) > 0
                codes = (sign << np.arange(c.bits)).sum(axis=2).astype(np.uint32)
                for t in range(c.tables):
                    key = ((np.int64(dim) * 1009 + t) << 31) | codes[:, t].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(p[:, c.tables * c.bits + t]), *(b.column(i).take(pa.array(own)) for i in (0, 1)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary())],
                        names=["key", "value", "rep", "n", "vec", "codes"],
                    )

    placed = Written(classes.select("rep", "n", "v").mapInArrow(place, "key long, value double, rep long, n long, vec binary, codes binary"), "cells").df
    full = placed.groupBy("key").agg(F.count("*").alias("m")).where(f"m > {CELL}")
    sized = placed.join(full, "key", "left").withColumn("blocks", F.expr(f"cast(ceil(coalesce(m, 1) / {CELL // 2}) as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(rep), case when m is null then 1 else blocks end) as int)"))
    meet = sized.withColumn("other", F.expr("explode(case when m is null then array(0) else sequence(0, blocks - 1) end)"))
    cells = meet.select(F.expr("case when m is null then key else xxhash64(key, least(block, other), greatest(block, other)) end").alias("cell"), "value", "rep", "n", "vec", "codes", "key", "block", F.expr("m is not null and block <> other").alias("mixed"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, value, rep, n, vec, codes, key, block, mixed in whole_groups(batches, 4 * CELL):
            order = np.lexsort((value, cell))
            cell, value, rep, n, key, block, mixed = (x[order] for x in (cell, value, rep, n, key, block, mixed))
            size = np.array([len(v) for v in vec])[order]
            code = np.frombuffer(b"".join(codes[order]), np.uint32).reshape(len(order), -1)
            table = (key >> 31) % 1009
            x = np.zeros((len(order), int(size.max()) // 8))
            for s in np.unique(size):
                own = size == s
                x[own, : s // 8] = np.frombuffer(b"".join(vec[order][own])).reshape(own.sum(), -1)
            # numerator and norms as they are: the verified cosine is that of the input
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                odd = ~np.isfinite(norm) | (norm < 1e-140)
            if odd.any():
                x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            unit = x / norm[:, None]
            p = (unit @ _axes(seed + 1, x.shape[1], COUNTED)).astype(np.float32)
            links, a, b = np.zeros(len(order), np.int64), [], []
            i, step = np.arange(len(order)), 0
            while len(i):
                step += 1
                i = i[i + step < len(order)]
                j = i + step
                near = (cell[i] == cell[j]) & (value[j] - value[i] <= c.window)
                i, j = i[near], j[near]
                pick = ~mixed[i] | (block[i] != block[j])
                q, r = i[pick], j[pick]
                many = (np.abs(p[q] - p[r]) <= c.half).sum(axis=1) >= c.least
                q, r = q[many], r[many]
                first = (code[q] == code[r]).argmax(axis=1) == table[q]
                q, r = q[first], r[first]
                close = np.einsum("ij,ij->i", x[q], x[r]) / (norm[q] * norm[r]) >= threshold
                q, r = q[close], r[close]
                if len(q):
                    np.add.at(links, q, n[r])
                    np.add.at(links, r, n[q])
                    a.append(q)
                    b.append(r)
            if a:
                label = labels(len(order), np.concatenate(a), np.concatenate(b))
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[label[at]]), pa.array(links[at])], names=["a", "b", "n"])

    found = Written(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "a long, b long, n long"), "links").df
    linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("far"))
    component = connected_components(found, "a", "b").withColumnRenamed("node", "rep")
    grouped = classes.select("h", "rep", "n").join(linked, "rep", "left").join(component, "rep", "left")
    grouped = grouped.select("h", "n", F.coalesce("far", F.lit(0)).alias("far"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "h").join(grouped, "h", "left")
    lone = F.col("h").isNull()
    whole = F.when(lone, F.col("id")).otherwise(F.nullif("component", F.lit(NO_ID)))
    return out.select(F.col("id").alias(id_col), F.when(lone, 0).otherwise(F.col("n") - 1 + F.col("far")).cast("long").alias("n_links"), whole.alias("component_id"), (F.col("id") == whole).alias("kept"))
