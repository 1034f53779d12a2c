"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

Each paragraph's digest is added to one cell in each of three sub-tables: a count, the XOR of digests and the XOR of
check sums. Cells of two versions subtract, so what both have vanishes, and peeling recovers the
rest: a cell left with one digest names it, and taking it out of its other cells frees more. Where a table
is too small to peel, the pair is sketched again GROWTH times as large; only cells in use are rows, so a large table costs no more. Everything is aggregates over
(document, cell) rows, placed by document once and never moved after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasweave.llm.frames import plain, saved

#: Cells of the first sketch, three sub-tables together, and how much larger each retry is.
CELLS, GROWTH = 24, 32
#: Peeling steps of one attempt; each takes one of the three sub-tables.
STEPS = 6
#: A paragraph has at most LONGEST characters; from SOFT characters on, some blanks between words end it too.
LONGEST, SOFT = 256, 96
#: Digests that one task sketches.
TASK_DIGESTS = 400_000
#: Documents of a range that one task pairs with their successors; beyond RANGES ranges, ranges grow instead.
RANGE_ROWS, RANGES, QUANTILES = 1500, 200_000, 256
_LAST = (1 << 63) - 1


def _paragraph_pattern() -> str:
    """A stretch up to the end of a sentence or line; else up to a blank that the letters beside it choose; else LONGEST characters."""
    sentence = r"[.!?](?=\s)|[。！？]|(?=\n|$)"
    chosen_blank = r"(?<=[ans])(?=\s[a-e])"
    return rf"[^\n]{{1,{SOFT}}}?(?:{sentence})|[^\n]{{{SOFT},{LONGEST}}}?(?:{sentence}|{chosen_blank})|[^\n]{{1,{LONGEST}}}"


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs: trimmed stretches that are not blank, cut by one rule at every length.

    Cuts follow from the text itself, so texts that share a passage share its paragraphs from their first common cut on.
    """
    cut = F.regexp_extract_all(text, F.lit(_paragraph_pattern()), F.lit(0))
    return F.array_distinct(F.transform(F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.xxhash64(p)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **derived: Column) -> DataFrame:
    """(id, text, next_text): each row with the text of the row that follows by id, the last one with the first.

    Rows with equal ids follow by a hash of the text; null ids come last; null texts count as empty. Ranges of ids are quantiles,
    subdivided evenly; the first row of each range also visits the range before it, so texts are shuffled once. Columns
    ``derived`` from "text" come along, as ``name`` and ``next_name``, and are computed once for each row.
    """
    source = plain(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    source = source.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(_LAST)))
    count, *bounds = source.agg(F.count("*"), F.percentile_approx("key", [i / QUANTILES for i in range(1, QUANTILES)], 10_000)).first()
    bounds = sorted(set(bounds[0] or []))
    edges = [-(1 << 63), *bounds]
    rows = max(RANGE_ROWS, -(-count // RANGES))
    parts = max(1, -(-count // (rows * len(edges))))
    width = [max(1, (high - low) // parts) for low, high in zip(bounds, bounds[1:])] if len(bounds) > 1 else []
    coarse = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<bigint>"), lambda b: b <= F.col("key")))
    low, step = F.get(F.lit(edges), coarse), F.get(F.lit([_LAST, *width, _LAST] if bounds else [_LAST]), coarse)
    fine = F.when((coarse > 0) & (step < _LAST), F.least(F.lit(parts - 1).cast("long"), F.expr("0L") + F.floor((F.col("key") - low) / step))).otherwise(F.lit(0))
    source = source.withColumn("range", coarse.cast("long") * parts + fine).withColumn("tie", F.xxhash64("text"))
    firsts = source.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("first"))
    by_range = Window.orderBy("range")  # one row per range
    firsts = saved(firsts.withColumn("before", F.coalesce(F.lag("range").over(by_range), F.max("range").over(Window.partitionBy()))))
    placed = source.join(F.broadcast(firsts), "range")  # at most RANGES rows
    visits = F.array(F.struct("range", F.lit(False).alias("guest")))
    guest = F.array(F.struct(F.col("before").alias("range"), F.lit(True).alias("guest")))
    here = F.when(F.col("first") == F.struct("key", "tie"), F.concat(visits, guest)).otherwise(visits)
    kept = ("id", "key", "tie", "text", *derived)
    placed = placed.select("id", "key", "tie", "text", *(c.alias(n) for n, c in derived.items()), here.alias("here"))
    placed = placed.select(*kept, F.explode("here").alias("visit")).select(*kept, "visit.range", "visit.guest")
    ordered = Window.partitionBy("range").orderBy("guest", "key", "tie")
    both = ("text", *derived)
    return placed.withColumns({f"next_{c}": F.lead(c).over(ordered) for c in both}).where("not guest").select("id", *both, *(f"next_{c}" for c in both))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(key: Column, sub: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(sub)), F.lit(cells // 3)).cast("int")


_KEYS = ("row", "pair", "sub", "cell")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Cells add up: counts as numbers, digests and check sums by XOR; empty cells disappear."""
    out = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return out.where("n <> 0 or key <> 0 or check <> 0")


def sketch(versions: DataFrame, cells: int, *keys: str) -> DataFrame:
    """Non-empty cells (keys, sub, cell, n, key, check) of rows with an array ``digests``."""
    one = versions.select(*keys, F.explode("digests").alias("key"))
    spread = F.explode(F.array(*(F.struct(F.lit(s).alias("sub"), _cell(F.col("key"), s, cells).alias("cell")) for s in range(3))))
    rows = one.select(*keys, "key", _check(F.col("key")).alias("check"), F.lit(1).cast("long").alias("n"), spread.alias("at"))
    return _sums(rows.select(*keys, "at.sub", "at.cell", "n", "key", "check"), *keys, "sub", "cell")


def _peel_state(cells: DataFrame, size: int) -> DataFrame:
    """The cells that peeling leaves, and a row with sub -1 for each digest that it recovers."""
    state = cells.select(*_KEYS, F.lit(0).cast("long").alias("found"), "n", "key", "check")
    for step in range(STEPS):
        sub = step % 3
        pure = (F.col("sub") == sub) & (F.abs("n") == 1) & (F.col("check") == _check(F.col("key")))
        kept = F.struct("sub", "cell", "found", "n", "key", "check")
        gone = [
            F.struct(F.lit(o).alias("sub"), _cell(F.col("key"), o, size).alias("cell"), F.lit(0).cast("long").alias("found"), (-F.col("n")).alias("n"), "key", "check")
            for o in range(3) if o != sub
        ]
        named = F.struct(F.lit(-1).alias("sub"), F.lit(0).alias("cell"), F.col("key").alias("found"), "n", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))
        rows = state.select("row", "pair", F.explode(F.when(pure, F.array(named, *gone)).otherwise(F.array(kept))).alias("x")).select("row", "pair", "x.*")
        state = _sums(rows, *_KEYS, "found")
    return state


def _peel(cells: DataFrame, size: int) -> DataFrame:
    """(row, pair, plus, minus, stuck): digests recovered on either side, and cells that are left."""
    named = F.col("sub") < 0
    return _peel_state(cells, size).groupBy("row", "pair").agg(
        F.count_if(named & (F.col("n") > 0)).alias("plus"), F.count_if(named & (F.col("n") < 0)).alias("minus"), F.count_if(~named).alias("stuck"),
    )


def _subtracted(pairs: DataFrame, cells: int) -> DataFrame:
    """The cells of ``a`` less those of ``b``; rows placed by (row, pair) are not moved."""
    both = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("a").alias("digests")), F.struct(F.lit(-1).alias("sign"), F.col("b").alias("digests"))))
    sides = pairs.select("row", "pair", both.alias("x")).select("row", "pair", "x.sign", "x.digests")
    parts = sketch(sides, cells, "row", "pair", "sign")
    return _sums(parts.select(*_KEYS, (F.col("n") * F.col("sign")).alias("n"), "key", "check"), *_KEYS)


def differences(pairs: DataFrame, cells: int = CELLS, growth: int = GROWTH) -> DataFrame:
    """(row, pair, plus, minus, cells): how many digests only ``a`` and only ``b`` have, for rows (row, pair, a, b) of digest arrays.

    A pair whose table can't be peeled is sketched again, ``growth`` times larger, until it can; ``cells`` is the size that
    could. Pairs without a difference have no cells and no row. Pairs are spread by the number of their digests.
    """
    total = pairs.agg(F.sum(F.size("a").cast("long") + F.size("b"))).first()[0] or 0
    parts = max(1, min(RANGES, -(-total // TASK_DIGESTS)))
    placed = pairs.repartition(parts, "row", "pair")
    todo, done = placed, None
    while True:
        peeled = saved(_peel(_subtracted(todo, cells), cells))
        good = peeled.where("stuck = 0").select("row", "pair", "plus", "minus", F.lit(cells).cast("long").alias("cells"))
        done = good if done is None else done.unionByName(good)
        stuck = peeled.where("stuck > 0").select("row", "pair")
        if stuck.isEmpty():
            return done
        todo = placed.join(stuck.repartition(parts, "row", "pair").hint("shuffle_hash"), ["row", "pair"], "left_semi")
        cells *= growth


def recovered(pairs: DataFrame, cells: int) -> DataFrame:
    """(row, pair, digest, side): the differing digests themselves, as far as ``cells`` cells can be peeled; side is 1 for ``a``."""
    state = _subtracted(pairs, cells)
    return _peel_state(state, cells).where("sub < 0").select("row", "pair", F.col("found").alias("digest"), F.col("n").cast("int").alias("side"))


def fingerprint_text(digested: DataFrame, column: str, cells: int = CELLS) -> DataFrame:
    """(row, fingerprint): the first sketch as text: cells, paragraphs, then cell:count:digest:check of each non-empty cell."""
    parts = sketch(digested.select("row", F.col(column).alias("digests")), cells, "row")
    word = F.concat_ws(":", F.hex(F.col("sub") * (cells // 3) + F.col("cell")), F.hex("n"), F.hex("key"), F.hex("check"))
    listed = parts.groupBy("row").agg(F.array_join(F.sort_array(F.collect_list(word)), ",").alias("listed"))  # at most ``cells`` words
    return listed.select("row", F.lower(F.col("listed")).alias("fingerprint"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_cells, next_cells) of every row.

    The edited text has its last quarter of code points replaced by the first as many of the next document. Likeness is
    1 less the share of recovered differences among the paragraphs of both; two texts without paragraphs have 1. Equal
    texts have equal fingerprints; a text without paragraphs has the fingerprint of an empty table. Fingerprints have CELLS
    cells; ``edited_cells`` and ``next_cells`` are the sizes at which the differences could be peeled, 0 where there were none.
    """
    texts = with_next(docs, id_col, text_col, own=paragraph_digests(F.col("text")))
    n = F.char_length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / 4).cast("int")), F.col("next_text").substr(F.lit(1), F.floor(n / 4).cast("int")))
    digested = texts.withColumn("edited", edited).select(
        "id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "own", paragraph_digests(F.col("edited")).alias("changed"), F.col("next_own").alias("next"),
        F.xxhash64("id", F.monotonically_increasing_id()).alias("row"),
    )
    digested = saved(digested)
    both = F.explode(F.array(*(F.struct(F.lit(pair).alias("pair"), F.col("own").alias("a"), F.col(other).alias("b")) for pair, other in ((0, "changed"), (1, "next")))))
    found = differences(digested.select("row", both.alias("x")).select("row", "x.*"))
    per_row = found.groupBy("row").agg(*(F.sum(F.when(F.col("pair") == p, value)).alias(f"{name}{p}") for p in (0, 1) for name, value in (("d", F.col("plus") + F.col("minus")), ("cells", F.col("cells")))))
    placed = digested.repartition("row")
    own = fingerprint_text(placed, "own")
    changed = fingerprint_text(placed, "changed").withColumnRenamed("fingerprint", "edited_fingerprint")
    out = digested.select("id", "row", "n_chars", "edited_sha256", *(F.size(c).alias(f"n_{c}") for c in ("own", "changed", "next")))
    out = out.join(per_row, "row", "left").join(own, "row", "left").join(changed, "row", "left")

    def near(d: str, other: str) -> Column:
        total = F.col("n_own") + F.col(other)
        return F.when(total == 0, F.lit(1.0)).otherwise(1 - F.coalesce(d, F.lit(0)) / total)

    whole = lambda c, size: F.concat_ws("|", F.lit(str(CELLS)), F.col(size).cast("string"), F.coalesce(c, F.lit("")))
    return out.select(
        "id", "n_chars", "edited_sha256", whole("fingerprint", "n_own").alias("fingerprint"), whole("edited_fingerprint", "n_changed").alias("edited_fingerprint"),
        near("d0", "n_changed").alias("near_edited"), near("d1", "n_next").alias("near_next"),
        F.coalesce("cells0", F.lit(0).cast("long")).alias("edited_cells"), F.coalesce("cells1", F.lit(0).cast("long")).alias("next_cells"),
    )
