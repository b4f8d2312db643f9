from __future__ import annotations

import re

import pytest

from dayglass.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, width=10):
    own, hit, named = words(text), set(), set()
    for key, item in items:
        test = words(item)
        size = min(width, len(test))
        runs = {tuple(test[i : i + size]) for i in range(len(test) - size + 1)} if test else set()
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in runs:
                hit |= set(range(i, i + size))
                named.add(str(key))
    return len(own), len(hit), sorted(named)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "Three FOUR five"),
    (3, None),
    (4, "..."),
    (5, "ünï"),
    (10, "two three four five six seven eight nine ten eleven twelve thirteen"),
    (10, "two three four five six seven eight nine ten eleven twelve thirteen"),
]
DOCS = [
    (1, "x One, two three; four five six seven eight nine ten eleven twelve thirteen y", 0, "a"),
    (2, "three-four-five three four five six", 1, "b"),
    (3, None, 2, None),
    (4, "", 3, "d"),
    (5, "ünï ünïx ÜNÏ", 4, "e"),
    (6, "nothing here", 5, "f"),
    (6, "nothing here", 5, "f"),
    (None, "three four five", 6, "g"),
    (7, "three " * 20_000 + "four five", 7, "h"),
]


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, _hit_id int, spans string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_WINDOWS, 0])
def test_hits_match_brute_force(spark, bound, monkeypatch):
    """Both ways of meeting the test windows: broadcast, and shuffled with hashes alone."""
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", bound)
    docs, items = tables(spark)
    got = decontamination.contamination(docs, items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted(
        (str(d[0]), *brute(d[1], ITEMS)) for d in DOCS
    )


def test_removal(spark):
    docs, items = tables(spark)
    kept = decontamination.remove_documents(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 6]
    cut = decontamination.remove_spans(docs, items)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "x y" and texts[2] == "six" and texts[3] is None and texts[6] == "nothing here"
    assert cut.count() == len(DOCS)


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    none = decontamination.contamination(docs, items.limit(0)).collect()
    assert len(none) == len(DOCS) and all(r.n_hit == 0 for r in none)
    assert decontamination.remove_documents(docs, items.limit(0)).count() == len(DOCS)


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_WINDOWS, 0])
def test_no_text_moves(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", bound)
    docs, items = tables(spark)
    seen = {}
    plain = decontamination.materialise

    def record(df, label):
        seen[label] = df
        return plain(df, label)

    monkeypatch.setattr(decontamination, "materialise", record)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # or Spark would broadcast so small a table by itself
    try:
        decontamination.contamination(docs, items)
        plan = seen["test-meetings"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert ("BroadcastExchange" in plan) == (bound > 0)
    if not bound:
        assert "Exchange hashpartitioning(_length" in plan
    # the windows that travel are numbers
    assert {t for c, t in seen["test-meetings"].dtypes if c != "_id"} <= {"bigint", "int"}


def test_equal_hashes_do_not_count(spark, monkeypatch):
    """Hits are verified by their words: with one hash for all windows the result is the same."""
    monkeypatch.setattr(decontamination, "_hashes", lambda words_: decontamination.F.transform(words_, lambda w: decontamination.F.lit(7).cast("long")))
    docs, items = tables(spark)
    docs = docs.where("length(coalesce(text, '')) < 1000")
    got = decontamination.contamination(docs, items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted(
        (str(d[0]), *brute(d[1], ITEMS)) for d in DOCS if len(d[1] or "") < 1000
    )
