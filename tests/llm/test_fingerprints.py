"""Likeness of fingerprints against exact set differences, and the cutting of paragraphs at every length."""

import random

from pyspark.sql import functions as F

from atlasweave.llm import sketches

SF = "/root/testdata/sf0.001"


def digests(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", sketches.paragraph_digests(F.col("text")).alias("d")).collect()
    return [set(r.d) for r in sorted(rows, key=lambda r: r.n)]


def test_likeness_equals_the_exact_set_differences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    texts = [t for _, t in source]
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, following)]
    own, changed, after = (digests(spark, x) for x in (texts, edited, following))
    like = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
    got = {r.id: r for r in sketches.compare_with_edits(docs).collect()}
    assert len(got) == len(source)
    for (doc_id, text), a, b, c in zip(source, own, changed, after):
        row = got[doc_id]
        assert abs(row.near_edited - like(a, b)) < 1e-12 and abs(row.near_next - like(a, c)) < 1e-12
        assert (row.edited_cells == 0) == (a == b) and (row.next_cells == 0) == (a == c)
        if len(text) > 400:
            assert row.near_edited > row.near_next


def test_one_cutting_rule_at_every_length(spark):
    rng = random.Random(5)
    plain = " ".join("".join(rng.choice("abcdenorst") for _ in range(rng.randint(2, 9))) for _ in range(900))  # no sentence ends
    short, longer, shifted = plain[:299], plain[:3000], "Something new is put here before it " + plain[:3000]
    solid, ideographs = "x" * 5000, "字" * 90 + "。" + "文" * 90 + "。"
    a, b, c, d, e = digests(spark, [short, longer, shifted, solid, ideographs])
    assert len(a & b) >= len(a) - 1 and len(a) >= 2  # only the cut end differs
    assert len(b & c) >= len(b) - 6  # cuts fall into step again after an insertion
    assert len(d) == 2 and len(e) == 2  # pieces of 256 x and a rest; one for each sentence
    one, two = digests(spark, ["First. Second! Third?\n\n  \nFourth", "Second! First. Third? Fourth"])
    assert one == two and len(one) == 4


def test_rows_without_text_and_an_empty_table(spark):
    schema = "doc_id long, text string"
    rows = sketches.compare_with_edits(spark.createDataFrame([(1, None), (2, "")], schema)).collect()
    assert [(r.n_chars, r.near_edited, r.near_next, r.edited_cells) for r in rows] == [(0, 1.0, 1.0, 0)] * 2
    assert sketches.compare_with_edits(spark.createDataFrame([], schema)).collect() == []
