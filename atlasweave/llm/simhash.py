"""SimHash near-duplicates: fingerprints of word shingles, linked through signatures with one deleted bit.

Two 64-bit fingerprints that differ in at most three bits agree up to one bit on one of their two
halves. Every fingerprint is indexed under each half with each single bit deleted (64 signatures);
equal signatures are the candidates, verified by the full distance. A bucket that outgrows its bound
is not capped: its members are indexed again under deletion variants of the half that the signature
leaves open, and once more, after which a signature leaves eleven bits free and its bucket fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasweave.llm.components import components
from atlasweave.llm.frames import plain, saved

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints of a bucket that one task compares with each other; 2048 = 2 ** 11 always holds a third-level bucket.
BUCKET = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the UTF-8 text; A-Z lower-cased, ASCII white space separates words; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts, ends, strict=True)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp, text_hash): the fingerprint of each whole text as a signed long, and a hash of the text as it is; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = plain(docs, id=id_col, text=text_col).select("id", text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], ["id", "fp", "text_hash"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long, text_hash long")


def _deletions(region: int, fixed: int) -> list[tuple[int, int]]:
    """(mask, bits still open) of each half of ``region`` less one bit, on top of the bits already fixed."""
    bits = [b for b in range(64) if region >> b & 1]
    halves = [sum(1 << b for b in part) for part in (bits[: len(bits) // 2], bits[len(bits) // 2 :])]
    return [(fixed | half & ~(1 << b), region & ~half) for half in halves for b in range(64) if half >> b & 1]


@cache
def _level(level: int) -> dict[int, list[tuple[int, int]]]:
    """For each mask of the level before, its masks on this level; all by the same rule."""
    if level == 1:
        return {0: _deletions((1 << 64) - 1, 0)}
    return {fixed: _deletions(region, fixed) for masks in _level(level - 1).values() for fixed, region in masks}


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def signatures(fps: DataFrame, level: int = 1) -> DataFrame:
    """(mask, value, fp): each fingerprint under its deletion variants; later levels take (fp, mask) of overfull buckets."""
    if level == 1:
        masks = F.array(*(F.lit(_signed(m)) for m, _ in _level(1)[0]))
        return fps.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow = {_signed(k): np.array([_signed(m) for m, _ in v]) for k, v in _level(level).items()}
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fp, mask = (batch.column(i).slice(start, 4096).to_numpy() for i in (0, 1))
                masks = np.array([follow[m] for m in mask.tolist()])
                fp = np.repeat(fp, masks.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(masks.ravel()), pa.array(masks.ravel() & fp), pa.array(fp)], ["mask", "value", "fp"])

    return fps.select("fp", "mask").mapInArrow(run, "mask long, value long, fp long")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a signed number it would count the bits of the absolute value


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member of a bucket with the first member that links can reach inside the bucket."""
    near = _differing(fps[:, None], fps[None, :]) <= distance
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _link_buckets(distance: int, bucket: int):
    """Streams rows sorted by (mask, value, fp); yields links, and the members of buckets beyond the bound with their mask."""

    def out(overfull: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), overfull)), pa.array(a), pa.array(b)], ["overfull", "a", "b"])

    def compare(fps: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(bounds)
        for size in np.unique(sizes[sizes > 1]).tolist():
            firsts = bounds[:-1][sizes == size]
            if size <= 16:
                i, j = np.triu_indices(size, 1)
                for part in np.array_split(firsts, max(1, len(firsts) * len(i) // 500_000)):
                    a, b = fps[part[:, None] + i[None, :]].ravel(), fps[part[:, None] + j[None, :]].ravel()
                    hit = _differing(a, b) <= distance
                    if hit.any():
                        yield out(False, a[hit], b[hit])
            else:
                for first in firsts.tolist():
                    a, b = _forest(fps[first : first + size], distance)
                    if len(a):
                        yield out(False, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, beyond = [np.empty(0, np.int64)] * 3, None
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(3)]
            if not len(new[0]):
                continue
            mask, value, fps = (np.concatenate(x) for x in zip(held, new, strict=True))
            if beyond is not None:
                stay = int(((mask == beyond[0]) & (value == beyond[1])).sum())  # sorted: they come first
                if stay:
                    yield out(True, fps[:stay], mask[:stay])
                mask, value, fps = mask[stay:], value[stay:], fps[stay:]
                if not len(fps):
                    held = [mask, value, fps]
                    continue
                beyond = None
            bounds = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
            last = int(bounds[-1])
            full = np.flatnonzero(np.diff(bounds) > bucket)
            for k in full.tolist():
                yield out(True, fps[bounds[k] : bounds[k + 1]], mask[bounds[k] : bounds[k + 1]])
            small = np.delete(np.arange(len(bounds) - 1), full)
            for part in np.split(small, np.flatnonzero(np.diff(small) > 1) + 1) if len(small) else []:
                yield from compare(fps, bounds[part[0] : part[-1] + 2])
            held = [mask[last:], value[last:], fps[last:]]
            if len(held[0]) > bucket:
                beyond = (int(held[0][0]), int(held[1][0]))
                yield out(True, held[2], held[0])
                held = [x[:0] for x in held]
        if 1 < len(held[2]):
            yield from compare(held[2], np.array([0, len(held[2])]))

    return run


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints of ``fps`` (column fp) within ``distance`` bits, and no others.

    They span the same classes as all pairs within the distance would; a dense bucket gives a
    star of its members instead of all its pairs. ``distance`` is at most 3.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one deleted bit find up to three differing bits")
    links, level, members = None, 1, fps
    while True:
        found = signatures(members, level).repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        found = saved(found.mapInArrow(_link_buckets(distance, bucket if level < 3 else max(bucket, BUCKET)), "overfull boolean, a long, b long"))
        here = found.where("not overfull").select("a", "b")
        links = here if links is None else links.unionByName(here)
        members = found.where("overfull").select(F.col("a").alias("fp"), F.col("b").alias("mask"))
        if level == 3 or members.isEmpty():
            return links.distinct()
        level += 1


def _classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """``simhash_groups`` with the hash of each text and the root of its class, which tells classes apart that share their smallest id."""
    prints = saved(fingerprints(docs, id_col, text_col, shingle, seed))
    firsts = saved(prints.groupBy("fp").agg(F.min("id").alias("first")))
    classes = components(fingerprint_links(firsts.select("fp"), distance, bucket))
    rooted = firsts.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = saved(rooted)
    smallest = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = saved(rooted.join(smallest, "root").select("fp", "root", "component_id"))
    return prints.join(named, "fp").select("id", "fp", "text_hash", "root", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component_id): every row with its fingerprint and the smallest id that links can reach.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id take part and
    get the smallest id of their class, or null if it has none; repeated rows share a class.
    """
    return _classes(docs, id_col, text_col, distance, shingle, seed, bucket).select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, one document of each class kept: the one with the smallest id (once, if the row repeats).

    An id can stand for texts of several classes: the text tells which row stays, and within a class the smallest hash of a
    text breaks the tie. Rows with a null id cannot be named as the one that stays; they are kept.
    """
    groups = _classes(docs, id_col, text_col, **options)
    stay = saved(groups.where("id = component_id").groupBy(F.col("id").alias("_stay"), "root").agg(F.min("text_hash").alias("_hash")).select("_stay", "_hash"))
    named = docs.where(docs[id_col].isNotNull()).withColumn("_text_hash", F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    kept = named.join(stay, (F.col(id_col) == F.col("_stay")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    kept = kept.dropDuplicates([id_col, "_text_hash"]).drop("_text_hash")
    return kept.unionByName(docs.where(docs[id_col].isNull()))
