"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut, release, small_batches, stored
from .textkit import freed

#: Vectors of one side that are compared at once; a larger bucket is compared block by block.
BLOCK = 4096
#: Rows that are handled at once, and pairs of small buckets; buckets of more than ``SMALL`` rows are multiplied as matrices.
CHUNK_ROWS, CHUNK_PAIRS, SMALL = 4096, 16_384, 48
#: Unlike vectors that a bucket should hold besides a given one, which sets the number of projections.
CROWD = 0.05


def collision(distance: float, width: float) -> float:
    """Probability that one projection, quantised to ``width``, has two vectors of this distance in one cell."""
    r = width / distance
    return erf(r / sqrt(2)) - sqrt(2 / pi) / r * (1 - exp(-r * r / 2))


def layout(rows: int, cosine: float, width: float, miss: float) -> tuple[int, int]:
    """Projections and tables for ``rows`` vectors of one label: pairs at ``cosine`` share no bucket with probability ``miss`` at most."""
    near, far = collision(max(1e-3, sqrt(max(0.0, 2 - 2 * cosine))), width), collision(sqrt(2), width)
    projections = max(2, ceil(log(max(rows, 2) / CROWD) / -log(far)))
    return projections, max(1, ceil(log(miss) / log(1 - near**projections)))


def _keys(unit: np.ndarray, salt: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """Bucket of each vector in each table: a hash of ``salt``, the table and the quantised random projections."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((unit.shape[1], tables * projections))
    b = rng.uniform(0, width, tables * projections)
    cell = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(unit), tables, projections)
    h = salt.view(np.uint64)[:, None] ^ (np.arange(tables, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(unit.shape[1]))
    for j in range(projections):
        h = (h ^ cell[:, :, j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _units(flat: np.ndarray, dim: int) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that no square overflows or vanishes."""
    x = flat.astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dim(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each dimension and their unit vectors."""
    dims = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        part = column if len(rows) == len(column) else column.take(pa.array(rows))
        yield rows, _units(part.flatten().to_numpy(zero_copy_only=False), dim)


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join rows that pairs link; ``parent`` holds each row's smallest linked row before and after."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    miss: float = 1e-4,
    tables: int | None = None,
    projections: int | None = None,
    width: float = 1.4,
    seed: int = 7,
) -> DataFrame:
    """Link vectors of one label whose cosine in double precision is at least ``cosine``.

    Vectors are normalised and, in each of ``tables`` tables, bucketed by
    ``projections`` random projections quantised to ``width``. Unless given, both
    follow from the largest label's number of vectors: buckets hold few unlike
    vectors at any size, and a pair at ``cosine`` shares none with probability
    ``miss``, a closer pair with a smaller one. Only bucket keys are shuffled
    for all vectors; the vectors themselves go to buckets of two or more. There
    all are compared exactly, blocks of ``BLOCK`` at a time, and a pair counts
    only in the first table that its vectors share. Equal vectors are one
    class, compared once. A bucket gives link counts and a spanning forest,
    never its pairs.

    Returns ``id_col``, n_links (other rows linked directly), component_id (the
    smallest id reachable) and kept, one row per vector. Vectors that are null,
    empty, zero or hold null or non-finite components, and those without a label
    or id, link with nothing. Rows that repeat a vector link with each other;
    rows of one id with unlike vectors are vectors of their own. Other columns
    are ignored; an empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    element = element if element in ("float", "double") else "double"
    size = F.size("v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{element}>").alias("v"), F.col(f"`{label_col}`").cast("string").alias("label"))
    usable = F.coalesce((size > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    # Zeros of either sign are one.
    good = base.where(usable).select("id", F.transform("v", lambda x: x + F.lit(0).cast(element)).alias("v"), "label")
    marks = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(seed), "label", "v").alias("h2")]
    classes = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = stored(classes.select("*", *marks, F.xxhash64("label").alias("salt"), F.monotonically_increasing_id().alias("cid")), "vectors")
    rows = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    wanted = layout(rows, cosine, width, miss)
    projections = projections or wanted[0]
    if tables is None:
        near = collision(max(1e-3, sqrt(max(0.0, 2 - 2 * cosine))), width)
        tables = max(1, ceil(log(miss) / log(1 - near**projections)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt, cid = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for at, unit in _by_dim(batch.column(2)):
                keys = _keys(unit, salt[at], tables, projections, width, seed)
                yield pa.RecordBatch.from_arrays([pa.array(keys.T.reshape(-1)), pa.array(np.tile(cid[at], tables))], ["key", "cid"])

    entries = classes.select("cid", "salt", "v").mapInArrow(freed(hashed), "key long, cid long")
    met = entries.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    met = met.select("key", "cid", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = met.join(classes.select("cid", "salt", "label", "weight", "v"), "cid")
    # A member of block i goes to each pair of blocks that has i; small buckets have the pair (0, 0) alone.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "salt", "label", "weight", "v")
    group = ["key", "i", "j"]
    placed = placed.repartition(*group).sortWithinPartitions(*group)

    def settled(rows: pa.Table) -> pa.RecordBatch:
        """Link counts and forest of whole buckets."""
        key, i, j, block, cid, salt, weight = (rows[c].to_numpy() for c in (*group, "block", "cid", "salt", "weight"))
        label = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True])))
        bucket = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        links, parent = np.zeros(len(key), dtype=np.int64), np.arange(len(key))
        for at, unit in _by_dim(rows["v"].combine_chunks()):
            begin = np.concatenate(([0], np.flatnonzero(np.diff(bucket[at])) + 1))
            many = np.diff(begin, append=len(at))

            def note(a: np.ndarray, b: np.ndarray, at=at, unit=unit) -> None:
                same = label[at[a]] == label[at[b]]
                a, b = a[same], b[same]
                if not len(a):
                    return
                used, back = np.unique(np.concatenate((a, b)), return_inverse=True)
                keys = _keys(unit[used], salt[at[used]], tables, projections, width, seed)
                ka, kb = keys[back[: len(a)]], keys[back[len(a) :]]
                first = (ka == kb).argmax(axis=1)
                here = ka[np.arange(len(a)), first] == key[at[a]]
                a, b = at[a[here]], at[b[here]]
                links[:] += np.bincount(a, weights=weight[b], minlength=len(key)).astype(np.int64)
                links[:] += np.bincount(b, weights=weight[a], minlength=len(key)).astype(np.int64)
                _merge(parent, a, b)

            small = many <= SMALL
            # All pairs of small buckets in one row: each vector with those after it.
            start, count = np.repeat(begin[small], many[small]), np.repeat(many[small], many[small])
            row = start + np.arange(len(start)) - np.repeat(np.cumsum(many[small]) - many[small], many[small])
            after = count - 1 - (row - start)
            done = np.concatenate(([0], np.cumsum(after)))
            lo = 0
            while lo < len(row):
                hi = max(lo + 1, int(np.searchsorted(done, done[lo] + CHUNK_PAIRS, side="right")) - 1)
                a = np.repeat(row[lo:hi], after[lo:hi])
                b = a + 1 + np.arange(len(a)) - np.repeat(done[lo:hi] - done[lo], after[lo:hi])
                apart = (i[at[a]] != j[at[a]]) & (block[at[a]] == block[at[b]])
                near = (np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine) & ~apart
                note(a[near], b[near])
                lo = hi
            for g in np.flatnonzero(~small).tolist():
                part = np.arange(begin[g], begin[g] + many[g])
                one, two = i[at[part[0]]], j[at[part[0]]]
                left, right = part[block[at[part]] == one], part[block[at[part]] == two]
                for lo in range(0, len(left), 256):
                    a, b = np.nonzero(unit[left[lo : lo + 256]] @ unit[right].T >= cosine)
                    if one == two:
                        later = b > a + lo
                        a, b = a[later], b[later]
                    note(left[a + lo], right[b])
        use = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(cid[use]), pa.array(cid[parent[use]]), pa.array(links[use])], ["cid", "root", "links"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < CHUNK_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            last = [rows[c][-1].as_py() for c in group]
            open_ = np.logical_and.reduce([rows[c].to_numpy() == x for c, x in zip(group, last, strict=True)])
            end = int(open_.argmax())
            if end:
                yield settled(rows.slice(0, end))
            held = rows.slice(end).combine_chunks().to_batches()
        if held and sum(map(len, held)):
            yield settled(pa.Table.from_batches(held))

    found = cut(placed.mapInArrow(freed(compare), "cid long, root long, links long"))
    parts = cut(connected_components(found, "cid", "root").select(F.col("node").alias("cid"), "component"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("cid", "rep", "weight", "h1", "h2").join(counts, "cid", "left").join(parts, "cid", "left")
    known = known.select("h1", "h2", "rep", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"))
    known = cut(known)
    release(found, parts, classes)
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = known.join(least, "component").select("h1", "h2", "n", "component_id")
    members = good.select("id", *marks).join(named, ["h1", "h2"]).select("id", "n", "component_id")
    lone = base.where(~usable).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component_id"))
    both = members.union(lone)
    return both.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
