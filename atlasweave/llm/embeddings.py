"""Near-duplicate embeddings: tiles of PCA-ordered vectors, compared leading dimensions first.

Unit vectors are rotated onto the principal axes of the whole table. Vectors of a label are laid out along
the first axis and cut into tiles with a bounding box in the leading axes; a cosine of t means a
distance of at most sqrt(2 - 2t), so tiles whose boxes are further apart are never compared. Inside a pair of
tiles products accumulate over the leading axes; what the remaining axes can add is at most the product
of the two suffix norms, and a pair stops as soon as this bound cannot reach the threshold. What is left is
decided by the cosine of the vectors as given, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasweave.llm.components import components
from atlasweave.llm.frames import plain, saved

THRESHOLD = 0.93
TILE = 1024
LEADING = 8
#: Pairs whose remaining products are computed at once: 65,536 x 64 doubles are 32 MB.
PAIRS = 65_536
#: Rounding of a sum of products of unit vectors stays far below this.
SLACK = 1e-9


def _valid(vector) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension count, the axes (columns) of all unit vectors, largest variance first.

    Every task adds up its outer products; what meets is one d x d matrix per task and dimension, summed in 16 groups.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, unit in _by_dimension(batch.column(0)):
                sums[d] = sums.get(d, 0) + unit[1].T @ unit[1]
        for d, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([total.tobytes()])], ["d", "total"])

    def merge(key, parts):
        total = sum(np.frombuffer(x) for x in parts["total"])
        return parts.head(1)[["d"]].assign(total=total.tobytes())

    part = vectors.select("vector").mapInArrow(add, "d long, total binary").withColumn("k", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
    part = part.groupBy("d", "k").applyInPandas(merge, "d long, total binary")
    whole: dict[int, np.ndarray] = {}
    for row in part.collect():  # at most 16 matrices for each dimension count
        whole[row.d] = whole.get(row.d, 0) + np.frombuffer(row.total).reshape(row.d, row.d)
    return {d: np.linalg.eigh(total)[1][:, ::-1].copy() for d, total in whole.items()}


def _by_dimension(column: pa.Array) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(dimension, (positions in the batch, unit vectors))."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.r_[0, lengths.cumsum()]
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        matrix = flat[starts[at][:, None] + np.arange(d)]
        matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # no square overflows or vanishes
        yield d, (at, matrix / np.linalg.norm(matrix, axis=1, keepdims=True))


def _split(z: np.ndarray, rows: np.ndarray, tile: int) -> Iterator[np.ndarray]:
    """Halves along the widest leading axis until a tile is small enough."""
    if len(rows) <= tile:
        yield rows
        return
    lead = z[rows, :LEADING]
    rows = rows[np.argsort(lead[:, np.argmax(np.ptp(lead, axis=0))], kind="stable")]
    yield from _split(z, rows[: len(rows) // 2], tile)
    yield from _split(z, rows[len(rows) // 2 :], tile)


_TILE_SCHEMA = "label string, d int, tile long, low array<double>, high array<double>, ids binary, copies binary, vectors binary"


def _tiles(axes: dict[int, np.ndarray], tile: int):
    """Rows sorted by (label, d, first axis) into tiles; at most eight tiles' rows are held."""

    def emit(label: str, d: int, ids: np.ndarray, copies: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        z = unit @ axes[d]
        for rows in _split(z, np.arange(len(ids)), tile):
            lead = z[rows, :LEADING]
            row = {"label": label, "d": d, "tile": int(ids[rows].min()), "low": lead.min(0).tolist(), "high": lead.max(0).tolist(), "ids": ids[rows].tobytes(), "copies": copies[rows].tobytes(), "vectors": unit[rows].tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("label", pa.string()), ("d", pa.int32()), ("tile", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            labels = batch.column(0).to_pylist()
            ids, copies = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            units: list = [None] * batch.num_rows
            for d, (at, unit) in _by_dimension(batch.column(3)):
                for k, i in enumerate(at.tolist()):
                    units[i] = (d, unit[k])
            for label, one, n, (d, unit) in zip(labels, ids, copies, units, strict=True):
                if held and ((label, d) != now or len(held) >= 8 * tile):
                    yield from emit(*now, *(np.array(x) for x in zip(*held, strict=True)))
                    held = []
                now = (label, d)
                held.append((one, n, unit))
        if held:
            yield from emit(*now, *(np.array(x) for x in zip(*held, strict=True)))

    return run


def _near_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in a, j in b) whose cosine reaches the threshold."""
    d = a.shape[1]
    za, zb = a @ axes, b @ axes
    done = min(LEADING, d)
    rest = lambda z, k: np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", z[:, :k], z[:, :k])))
    product = za[:, :done] @ zb[:, :done].T
    i, j = np.nonzero(product + rest(za, done)[:, None] * rest(zb, done)[None, :] >= threshold - SLACK)
    product = product[i, j]
    while done < d and len(i):
        more = min(d, 2 * done)
        for s in range(0, len(i), PAIRS):
            p = slice(s, s + PAIRS)
            product[p] += np.einsum("ij,ij->i", za[i[p], done:more], zb[j[p], done:more])
        done = more
        keep = product + rest(za, done)[i] * rest(zb, done)[j] >= threshold - SLACK
        i, j, product = i[keep], j[keep], product[keep]
    sure = np.zeros(len(i), bool)
    for s in range(0, len(i), PAIRS):
        p = slice(s, s + PAIRS)
        sure[p] = np.einsum("ij,ij->i", a[i[p]], b[j[p]]) >= threshold
    return i[sure], j[sure]


def _compare(axes: dict[int, np.ndarray], threshold: float):
    """Pairs of tiles to (id, links, root): what a vector gains in links, and the first vector the tile pair connects it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                d, left, right, *cells = (batch.column(c)[row].as_py() for c in range(9))
                ids_a, n_a, ids_b, n_b = (np.frombuffer(x, np.int64) for x in cells[:4])
                a, b = (np.frombuffer(x).reshape(-1, d) for x in cells[4:])
                i, j = _near_pairs(a, b, axes[d], threshold)
                if left == right:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                links_a = np.bincount(i, n_b[j], len(a)).astype(np.int64)
                links_b = np.bincount(j, n_a[i], len(b)).astype(np.int64)
                node_i, node_j = ids_a[i], ids_b[j]
                nodes, code = np.unique(np.r_[node_i, node_j], return_inverse=True)
                p, q = code[: len(i)], code[len(i) :]
                root = np.arange(len(nodes))
                while True:
                    new = root.copy()
                    np.minimum.at(new, p, root[q])
                    np.minimum.at(new, q, root[p])
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                gained = np.zeros(len(nodes), np.int64)
                np.add.at(gained, np.searchsorted(nodes, ids_a[links_a > 0]), links_a[links_a > 0])
                np.add.at(gained, np.searchsorted(nodes, ids_b[links_b > 0]), links_b[links_b > 0])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(gained), pa.array(nodes[root])], ["id", "links", "root"])

    return run


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Rows are compared when their labels are equal and not null and their vectors have equally many
    dimensions. Null, zero and non-finite vectors and null labels link with nothing. Equal vectors of a label are
    compared once and count as linked with each other. Ids are integers; a row with a null id is compared too and
    gets the component of its class, which is a number of at least 2**62 if no row of the class has an id; its kept is null.
    """
    source = plain(vectors, id=id_col, vector=vector_col, label=label_col).withColumn("label", F.col("label").cast("string"))
    good = source.where(F.col("label").isNotNull() & _valid(F.col("vector")))
    apart = source.where(~(F.col("label").isNotNull() & F.coalesce(_valid(F.col("vector")), F.lit(False))))
    ones = saved(good.groupBy("label", "vector").agg(F.coalesce(F.min("id"), F.min(F.xxhash64("label", "vector").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62)))).cast("long").alias("one"), F.count("*").alias("copies")))
    axes = principal_axes(ones)
    first = {d: axis[:, 0].tolist() for d, axis in axes.items()}
    place = F.lit(0.0)
    for d, axis in first.items():
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        along = F.aggregate(F.arrays_zip(F.col("vector").alias("v"), F.array(*map(F.lit, axis)).alias("w")), F.lit(0.0), lambda s, x: s + x["v"].cast("double") * x["w"])
        place = F.when(F.size("vector") == d, along / norm).otherwise(place)
    ordered = ones.select("label", "one", "copies", "vector", F.size("vector").alias("d"), place.alias("place"))
    parts = max(1, -(-ones.count() // (4 * tile)))
    ordered = ordered.repartitionByRange(parts, "label", "d", "place", "one").sortWithinPartitions("label", "d", "place", "one")
    tiles = saved(ordered.select("label", "one", "copies", "vector").mapInArrow(_tiles(axes, tile), _TILE_SCHEMA))
    box = tiles.select("label", "d", "tile", "low", "high")
    other = box.select(*(F.col(c).alias(f"{c}_b") for c in box.columns))
    gap = F.aggregate(
        F.arrays_zip("low", "high", "low_b", "high_b"), F.lit(0.0),
        lambda s, x: s + F.pow(F.greatest(F.lit(0.0), x["low"] - x["high_b"], x["low_b"] - x["high"]), 2),
    )
    meet = (F.col("label") == F.col("label_b")) & (F.col("d") == F.col("d_b")) & (F.col("tile") <= F.col("tile_b")) & (gap <= 2 - 2 * threshold + SLACK)
    pairs = box.join(other, meet).select("d", "tile", "tile_b")
    load = lambda s: tiles.select(F.col("tile").alias(f"t{s}"), *(F.col(c).alias(f"{c}{s}") for c in ("ids", "copies", "vectors")))
    pairs = pairs.join(load("1"), F.col("tile") == F.col("t1")).join(load("2"), F.col("tile_b") == F.col("t2"))
    found = pairs.select("d", "tile", "tile_b", "ids1", "copies1", "ids2", "copies2", "vectors1", "vectors2")
    found = saved(found.mapInArrow(_compare(axes, threshold), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "one")
    classes = components(found.select("id", "root")).withColumnRenamed("node", "one")
    named = ones.join(links, "one", "left").join(classes, "one", "left")
    named = saved(named.select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("root", "one").alias("component_id")))
    linked = good.join(named, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("id", "n_links", "component_id")
    alone = apart.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id") == F.col("component_id"))
