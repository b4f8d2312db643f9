from __future__ import annotations

from pyspark.sql import functions as F

from dayglass.llm import chat

TURNS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"),
    (1, 1, "assistant", "a\\<|end|>\n<|user|>\n\\\\[x]<\\"),
    (1, 2, "user", None),
    (2, 1, "assistant", ""),
    (2, 0, None, "no role"),
    (3, 0, "we|>ird\n", "text"),
    (3, 0, "assistant", "tie"),
    (3, 0, "assistant", "tie"),
    (None, 5, "user", "no conversation"),
    (4, None, "assistant", "no turn"),
    (5, 0, "user", "x" * 300_000),
    (6, 0, "end", "a control word as a role"),
    (6, 1, "\\end", "the same behind a backslash"),
    (6, 2, "End", "<|end|>\n"),
    (6, 3, "|end|", ""),
]


def read_back(done):
    return done.select(
        "tree",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
        "formatted",
    ).collect()


def test_threads_read_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    got = read_back(chat.format_trees(chat.threads(df)))
    want = {}
    for c, t, role, text in TURNS:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert {r.tree: [tuple(t) for t in r.turns] for r in got} == {c: [t[1:] for t in sorted(v)] for c, v in want.items()}
    for r in got:
        assert r.learned == "".join(t[2] for t in sorted(want[r.tree]) if t[1] == "assistant")
        body = r.formatted
        assert "</s>" not in body and "[INST]" not in body
        assert body.count("<|end|>") == len(want[r.tree])
    assert chat.format_trees(chat.threads(df.limit(0))).count() == 0


# a tree with two branches, an orphan, and a circle
NODES = [
    ("t", 1, None, "user", "root", 1.0),
    ("t", 2, 1, "assistant", "good", 5.0),
    ("t", 3, 1, "assistant", "poor", 1.0),
    ("t", 4, 2, "user", "more", 0.0),
    ("t", 5, 3, "user", "worse", -1.0),
    ("t", 6, 99, "user", "orphan", 9.0),
    ("c", 1, 2, "user", "round", 1.0),
    ("c", 2, 1, "user", "round", 1.0),
]


def test_branches_are_ranked(spark):
    df = spark.createDataFrame(NODES, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.rank, tuple(t.text for t in r.turns)) for r in (
        chat.format_trees(df, branches=9).select("rank", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    )}
    assert got == {(1, ("orphan",)), (2, ("root", "good", "more")), (3, ("root", "poor", "worse"))}
    assert chat.format_trees(df, branches=1).count() == 1


def test_long_threads(spark):
    rows = [("t", i, i - 1 if i else None, "user", str(i), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    (got,) = read_back(chat.format_trees(df))
    assert [t.text for t in got.turns] == [str(i) for i in range(300)]
