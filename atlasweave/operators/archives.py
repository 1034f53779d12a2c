"""Names and budgets of archives of any size: what fits, under which name, and a manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import safe_entry_name
from ..session import written
from .sequences import in_order, joined, running_total


def _stem(name: Column) -> tuple[Column, Column]:
    """A name without its extension, and the extension with its dot; a name that begins with its only dot has none."""
    pattern = r"(?s)^(.+)(\.[^.]*)\z"
    return F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), name), F.regexp_extract(name, pattern, 2)


def _numbered_name(name: Column, number: Column) -> Column:
    stem, ext = _stem(name)
    return F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), ext)


def _literal_numbers(names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Names that look numbered, as in ``plan (3).pdf``, beside the name they would be numbers of: (keys, _parent, _number, _child, _first)."""
    stem, ext = _stem(F.col(name))
    pattern = r"(?s)^(.*) \(([1-9][0-9]{0,17})\)\z"
    base, number = F.regexp_extract(stem, pattern, 1), F.regexp_extract(stem, pattern, 2).try_cast("long")
    found = names.select(*keys, F.concat(base, ext).alias("_parent"), number.alias("_number"), F.col(name).alias("_child"), "_first", base.alias("_base"), ext.alias("_ext"))
    return found.where("_number >= 2 and (_base <> '' or _ext = '')").drop("_base", "_ext")


def _meet(blockers: DataFrame, keys: list[str]) -> DataFrame:
    """Each literal number of a name with the turn (``_turn``) at which numbering comes to it, and whether it is skipped there.

    Turn k of a name would take number k + 1, and one more for each number skipped before. A number is skipped if its literal came
    earlier, that is, behind ``_before`` turns with less than k of them. The numbers of a name stream by in ascending order.
    """
    kept = [c for c in blockers.columns if c not in ("_number", "_before")]
    dealt = blockers.repartition(*keys).sortWithinPartitions(*keys, "_number").select(*kept, "_number", "_before")
    n_keys = len(keys)
    at = [kept.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, skipped = None, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in at]
            turns, flags = [], []
            for row, (number, before) in enumerate(zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())):
                key = tuple(columns[i][row] for i in range(n_keys))
                if key != now:
                    now, skipped = key, 0
                turns.append(number - 1 - skipped)
                flags.append(turns[-1] > before)
                skipped += flags[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(turns, pa.int64()), pa.array(flags, pa.bool_())], [*kept, "_turn", "_skipped"])

    types = {f.name: f.dataType.simpleString() for f in blockers.schema}
    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "_turn long, _skipped boolean"]))


def unique_entry_names(entries: DataFrame, archive: list[str], name: str = "name", order: str = "seq") -> DataFrame:
    """Add ``entry``: the name made unique within its archive, in the order of ``order``, which is unique there.

    A name that is taken gets the next free number, as in ``plan (2).pdf``. Only two things take such a number: the turns of
    the name itself, and an entry that is literally called so and came before. So turns are counted by a distributed running
    total, in which the literal entries take part as marks, and the numbers follow from the turn and the marks passed. Whether a literal
    entry finds its own name taken is known once the shorter name is numbered: rounds go on until that settles, one for each level of
    ``x (2) (2)``. No archive and no name is gathered in a task. Null names have null entries.
    """
    keys = [*archive, name]
    names = entries.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    literal = _literal_numbers(names, archive, name)
    parents = names.select(*archive, F.col(name).alias("_parent"), F.col("_n").alias("_times"))
    literal = written(joined(literal, parents, [*archive, "_parent"]))
    clashing = not literal.isEmpty()
    involved = names.where("_n > 1").select(*keys)
    if clashing:
        both = literal.select(*archive, F.explode(F.array("_parent", "_child")).alias(name))
        involved = involved.union(both.select(*keys)).distinct()
    rows = joined(entries, involved.withColumn("_involved", F.lit(True)), keys, "left")
    free = rows.where("_involved is null").drop("_involved").withColumn("entry", F.col(name))
    turning = rows.where("_involved").drop("_involved").withColumn("_weight", F.lit(1).cast("long"))
    if not clashing:
        ranked = running_total(in_order(turning, keys, order), keys, F.col("_weight"), "_rank")
        entry = F.when(F.col("_rank") == 1, F.col(name)).otherwise(_numbered_name(F.col(name), F.col("_rank")))
        return free.unionByName(ranked.withColumn("entry", entry).select(*free.columns))
    marks = literal.select(*archive, F.col("_parent").alias(name), F.col("_first").alias(order), F.lit(0).cast("long").alias("_weight"), "_number", "_child", "_times")
    ranked = running_total(in_order(turning.unionByName(marks, allowMissingColumns=True), keys, order), keys, F.col("_weight"), "_rank")
    ranked = written(ranked)
    marks = ranked.where("_weight = 0").select(*keys, "_number", "_child", "_times", "_rank")
    taken = written(marks.select(*keys).limit(0).withColumn("_taken", F.lit(1)))  # names whose first entry finds them taken
    while True:
        seen = joined(marks, taken, keys, "left").withColumn("_taken", F.coalesce("_taken", F.lit(0)))
        before = F.greatest(F.col("_rank") - 1 + F.col("_taken"), F.lit(0))
        met = written(_meet(seen.withColumn("_before", before).drop("_rank"), keys))
        reached = F.col("_turn") <= F.col("_times") - 1 + F.col("_taken")
        now = met.where(~F.col("_skipped") & reached).select(*archive, F.col("_child").alias(name), F.lit(1).alias("_taken")).select(*keys, "_taken")
        settled = now.select(*keys).exceptAll(taken.select(*keys)).isEmpty() and taken.select(*keys).exceptAll(now.select(*keys)).isEmpty()
        taken = written(now)
        if settled:
            break
    turns = joined(ranked.where("_weight = 1"), taken, keys, "left").withColumn("_turn", F.col("_rank") - 1 + F.coalesce("_taken", F.lit(0)))
    passed = met.where("_skipped").select(*keys, "_turn", F.lit(1).cast("long").alias("_weight"))
    numbered = turns.drop("_part", "_row", "_rank", "_taken", "_number", "_child", "_times").withColumn("_weight", F.lit(0).cast("long"))
    marked = numbered.unionByName(passed, allowMissingColumns=True)
    # a number is skipped before the turn that comes to it takes the next one
    counted = running_total(in_order(marked, keys, "_turn", F.col("_weight").desc()), keys, F.col("_weight"), "_passed").where("_weight = 0")
    entry = F.when(F.col("_turn") == 0, F.col(name)).otherwise(_numbered_name(F.col(name), F.col("_turn") + 1 + F.col("_passed")))
    return free.unionByName(counted.withColumn("entry", entry).select(*free.columns))


def _chosen(ordered: DataFrame, archive: list[str], max_bytes: int, max_file: int) -> DataFrame:
    """``_row`` of the files that a greedy fit takes.

    A round settles an archive until half of what was left is used up. Until then every file of at most that half fits, so a
    running total of these tells, for each larger file, whether it fits; the first one that does ends the round, as does the small file
    that passes the half. Files beyond what is left drop out. So rounds are no more than the budget has binary digits.
    """
    open_ = ordered.where(F.col("bytes") <= max_file).select(*archive, "_part", "_row", "bytes").withColumn("_left", F.lit(max_bytes).cast("long"))
    chosen = None
    while True:
        small = F.col("bytes") * 2 <= F.col("_left")
        run = running_total(open_, archive, F.when(small, F.col("bytes")).otherwise(F.lit(0).cast("long")), "_small").withColumn("_is_small", small)
        fits = ~F.col("_is_small") & (F.col("bytes") <= F.col("_left") - F.col("_small"))
        ends = F.when(fits | (F.col("_is_small") & (F.col("_small") * 2 > F.col("_left"))), F.col("_row"))
        run = written(run.withColumn("_ends", ends))
        end = run.groupBy(*archive).agg(F.min("_ends").alias("_end"))
        run = joined(run.drop("_ends"), end, archive)
        taken = run.where((F.col("_is_small") & (F.col("_end").isNull() | (F.col("_row") <= F.col("_end")))) | (~F.col("_is_small") & (F.col("_row") == F.col("_end"))))
        chosen = taken.select("_row") if chosen is None else chosen.unionByName(taken.select("_row"))
        used = taken.groupBy(*archive).agg(F.sum("bytes").alias("_used"))
        rest = joined(run.where(F.col("_row") > F.col("_end")), used, archive).withColumn("_left", F.col("_left") - F.col("_used"))
        open_ = written(rest.where("bytes <= _left").select(*archive, "_part", "_row", "bytes", "_left"))
        if open_.isEmpty():
            return chosen


def archive_budget(
    files: DataFrame, archive: list[str], max_bytes: int = K.MAX_ARCHIVE_BYTES, max_file: int = K.MAX_FILE_BYTES, max_files: int | None = None,
) -> DataFrame:
    """Which files fit, in the order of ``seq``: one that would exceed the total is skipped, later and smaller ones are kept.

    Adds note, running (bytes taken so far), files_included, files_selected and total_bytes. With ``max_files``, an archive of more
    files is refused: one row, the first file's, says so. An archive may hold any number of files.
    """
    ordered = in_order(files.withColumn("bytes", F.col("bytes").cast("long")), archive, "seq")
    sizes = ordered.groupBy(*archive).agg(F.count("*").alias("files_selected"), F.min("_row").alias("_head"))
    refused = None
    if max_files is not None:
        refused = joined(ordered, sizes.where(F.col("files_selected") > max_files), archive).where("_row = _head")
        ordered = joined(ordered, sizes.where(F.col("files_selected") <= max_files).select(*archive), archive, "left_semi") if archive else ordered
        ordered = written(ordered)
    chosen = _chosen(ordered, archive, max_bytes, max_file).withColumn("_fits", F.lit(True))
    noted = ordered.join(chosen, "_row", "left").withColumn(
        "note",
        F.when(F.col("bytes").isNull(), "skipped: request failed")
        .when(F.col("bytes") > max_file, f"skipped: larger than the {max_file // 1024 // 1024} MB per-file limit")
        .when(F.col("_fits").isNull(), "skipped: the archive reached its total size limit")
        .otherwise("included"),
    )
    noted = written(noted)
    own = F.when(F.col("_fits"), F.col("bytes")).otherwise(F.lit(0).cast("long"))
    totals = noted.groupBy(*archive).agg(F.count("_fits").alias("files_included"), F.count("*").alias("files_selected"), F.sum(own).alias("total_bytes"))
    out = [*files.columns, "note", "running", "files_included", "files_selected", "total_bytes"]
    found = joined(running_total(noted, archive, own, "running"), totals, archive).select(*out)
    if refused is None:
        return found
    none = F.lit(None).cast("long")
    said = F.lit(f"refused: a single download is limited to {max_files} files")
    return found.unionByName(refused.withColumns({"note": said, "running": none, "files_included": F.lit(0).cast("long"), "files_selected": none, "total_bytes": none}).select(*out))


def download_manifest(assets: DataFrame, archive: list[str], max_files: int | None = None) -> DataFrame:
    """Where each selected file went and why not, with archive totals on every row.

    Expects seq, asset_id, asset_kind, filename, url, source_page and bytes. Skipped files keep no name.
    """
    df = archive_budget(assets, archive, max_files=max_files)
    columns = [*archive, "entry", "url", "source_page", "bytes", "status", "note", "files_included", "files_selected", "total_bytes"]
    folder = F.when(F.col("asset_kind") == "geo", "geo-data").otherwise("images")
    fallback = F.concat(F.lit("asset-"), F.col("seq").cast("string"))
    df = df.withColumn("name", F.when(F.col("note") == "included", safe_entry_name(F.col("filename"), fallback)))
    named = unique_entry_names(df, archive).withColumn("entry", F.when(F.col("entry").isNotNull(), F.concat_ws("/", folder, "entry")))
    return named.withColumn("status", F.when(F.col("note") == "included", "included").otherwise("skipped")).select(columns)
