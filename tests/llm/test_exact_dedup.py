from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from dayglass.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = set()
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.add((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_groups_match_brute_force(awkward):
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    got = exact_dedup.exact_groups(awkward, digest_all=True).drop("rows").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_candidates_alone_are_hashed(awkward):
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_groups(awkward).collect()}
    assert got[1] and got[3] and got[9] is None and got[5] is None


def test_equal_prefix_and_length_are_not_enough(spark):
    texts = ["p" * 300 + "a", "p" * 300 + "b", "p" * 300 + "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df).collect()}
    assert got == {0: (2, 2), 1: (1, 1), 2: (2, 2)}


def test_filter_marks_every_survivor(spark):
    n = 20_000
    df = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % n).alias("text"))
    got = exact_dedup.exact_groups(df)
    assert got.where("group_size = 2").count() == 2 * n and got.where("kept").count() == n


def test_documents_that_stay(awkward, nothing):
    got = exact_dedup.drop_exact_copies(awkward)
    assert got.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(["2", "4", "5", "6", "None", "8", "9", "10"])
    assert exact_dedup.drop_exact_copies(nothing).count() == 0
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_query_gives_a_row_for_each_row(spark, tmp_path):
    from dayglass.llm.catalog import QUERIES

    rows = [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "c"), (4, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[:4] for r in QUERIES["op5_exact_dedup"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(1, 2, 3, False)] * 2 + [(2, 2, 3, True), (3, 3, 1, True)] + [(4, 4, 2, True)] * 2
