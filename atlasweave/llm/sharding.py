"""Shards of nearly equal bytes by sampled splitters.

A sample of keys, each drawn in proportion to the size of its record, gives quantile boundaries; records
are range-partitioned by them. Exact sums then show which ranges are overfull: a range of several keys is cut
again at the quantiles of its own sample, and the range of one key larger than its share of a shard is cut into
pieces by record. The ranges, a bounded number of them, are dealt to the shards, largest first. Equal texts have one
key, so they stay in one shard unless they alone exceed it.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasweave.llm.frames import plain, saved

SHARDS = 8
#: Ranges for each shard; the shards differ by about one of the smallest ranges.
RANGES = 128
#: Sampled keys for each range.
OVERSAMPLING = 24
#: A range is overfull beyond this many times its share.
OVERFULL = 1.5
_SEED = 20_231


def _hit(rate: Column, salt: int) -> Column:
    """True for a share ``rate`` of the records, drawn by a hash so that a repeated task draws the same."""
    return F.pmod(F.xxhash64("row", "key", F.lit(salt)), F.lit(1 << 40)) < rate * (1 << 40)


def _ranged(records: DataFrame, splitters: list[int]) -> DataFrame:
    """``records`` with ``range``, the number of splitters up to the key: those of a shorter prefix, and those of its own prefix that are not above it."""
    lists: list[list[int]] = [[] for _ in range(1 << _PREFIX)]
    for s in splitters:
        lists[(s >> (64 - _PREFIX)) + (1 << (_PREFIX - 1))].append(s)
    rows, before = [], 0
    for prefix, part in enumerate(lists):
        rows.append((prefix - (1 << (_PREFIX - 1)), before, part))
        before += len(part)
    prefixes = records.sparkSession.createDataFrame(rows, "prefix long, before int, here array<long>")  # 1024 rows
    found = records.withColumn("prefix", F.shiftright("key", 64 - _PREFIX)).join(F.broadcast(prefixes), "prefix")
    return found.withColumn("range", F.col("before") + F.size(F.filter("here", lambda s: s <= F.col("key")))).drop("prefix", "before", "here")


_PREFIX = 10


def _boundaries(ranged: DataFrame, cuts: dict[int, int], sums: dict[int, int], salt: int) -> list[list[int]]:
    """New splitters for each range in ``cuts`` (range: number of parts): quantiles of a sample of its keys by size."""
    rates = ranged.sparkSession.createDataFrame([(part, n * OVERSAMPLING / max(1, sums[part])) for part, n in cuts.items()], "range int, rate double")
    drawn = ranged.join(F.broadcast(rates), "range").where(_hit(F.least(F.lit(1.0), F.col("rate") * F.col("size")), salt))
    keys: dict[int, list[int]] = {}
    for row in drawn.select("range", "key").collect():  # about OVERSAMPLING keys for each range that is made
        keys.setdefault(row["range"], []).append(row["key"])
    return [sorted(found)[:: max(1, len(found) // cuts[part])] for part, found in keys.items()]


def _deal(atoms: list[tuple[int, tuple[int, int]]], shards: int) -> dict[tuple[int, int], int]:
    """Largest first, each to the shard that holds least."""
    heap = [(0, s) for s in range(shards)]
    where = {}
    for size, atom in sorted(atoms, key=lambda x: (-x[0], x[1])):
        held, shard = heapq.heappop(heap)
        where[atom] = shard
        heapq.heappush(heap, (held + size, shard))
    return where


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row: size is the UTF-8 bytes of the text plus one (null: none plus one).

    Shards have nearly equal sums of size; ``slot`` numbers the rows of a shard without gaps. Null and empty texts share
    a key; rows with a null id and repeated rows are records like any other. What the driver sees are sampled keys and
    the sums of ranges, both bounded by ``shards * ranges``.
    """
    source = plain(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    records = saved(source.select(
        "id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("key"), F.xxhash64("id", F.monotonically_increasing_id()).alias("row"),
    ))
    total = records.agg(F.sum("size")).first()[0] or 0
    share = max(1.0, total / (shards * ranges))
    splitters: list[int] = []
    sums, salt = {0: total}, _SEED
    for _ in range(4):  # a later round only meets ranges that sampling left uneven
        ends = [*splitters, None]
        wide = {part: max(2, round(size / share)) for part, size in sums.items() if size > OVERFULL * share and not (0 < part < len(ends) and ends[part] == splitters[part - 1] + 1)}
        if not wide:
            break
        found = set(splitters)
        for keys in _boundaries(_ranged(records, splitters), wide, sums, salt):
            found.update(keys)
            found.update(k + 1 for k, n in Counter(keys).items() if n > 1 and k < (1 << 63) - 1)  # a key that fills ranges gets one of its own
        if len(found) == len(splitters):
            break
        splitters, salt = sorted(found), salt + 1
        sums = {r["range"]: r["size"] for r in _ranged(records, splitters).groupBy("range").agg(F.sum("size").alias("size")).collect()}
    limit = total / shards
    # overfull ranges are numbered in pieces; they are also dealt in pieces where one key exceeds a shard
    pieces = {part: -(-size // max(1, int(share))) for part, size in sums.items() if size > OVERFULL * share}
    apart = {part for part in pieces if sums[part] > limit}
    piece = F.lit(0).cast("long")
    if pieces:
        counts = F.create_map(*(F.lit(x) for pair in pieces.items() for x in pair))
        piece = F.coalesce(F.pmod(F.col("row"), F.try_element_at(counts, F.col("range")).cast("long")), F.lit(0).cast("long"))
    placed = _ranged(records, splitters).withColumn("piece", piece.cast("int"))
    units = placed.groupBy("range", "piece").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    atoms: dict[tuple[int, int], int] = {}
    for u in units:
        atom = (u["range"], u["piece"] if u["range"] in apart else -1)
        atoms[atom] = atoms.get(atom, 0) + u["size"]
    shard_of = _deal([(size, atom) for atom, size in atoms.items()], shards)
    base, taken = [], [0] * shards
    for u in sorted(units, key=lambda u: (u["range"], u["piece"])):
        shard = shard_of[(u["range"], u["piece"] if u["range"] in apart else -1)]
        base.append((u["range"], u["piece"], shard, taken[shard]))
        taken[shard] += u["rows"]
    spark = docs.sparkSession
    starts = spark.createDataFrame(base, "range int, piece int, shard int, first long")  # one row per range or piece
    order = Window.partitionBy("range", "piece").orderBy("key", "id", "row")
    numbered = placed.withColumn("nth", F.row_number().over(order) - 1)
    out = numbered.join(F.broadcast(starts), ["range", "piece"])
    return out.select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> None:
    """``docs`` as Parquet folders ``shard=0`` and so on. Ids must be unique, as they carry the assignment to the rows."""
    where = assign_shards(docs, id_col, text_col, shards).select(F.col("id").alias("_id"), "shard", "slot")
    docs.join(where, docs[id_col] == F.col("_id")).drop("_id").write.partitionBy("shard").parquet(path)
