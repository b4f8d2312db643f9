from __future__ import annotations

import random
import re
from collections import Counter

from dayglass.llm import quality_rules as rules


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines),
        len(lines) - len(set(lines)), len(inside),
    )


def bits(measures):
    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words = measures
    failed = (
        n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 50 * n_lines,
        word_chars < 2 * n_words, word_chars > 40 * n_words, n_words > 100_000,
    )
    return sum(1 << b for b, f in enumerate(failed) if f)


def shown(rows):
    return sorted((str(r["_id"]), *[r[m] for m in rules.MEASURES], r["failures"]) for r in rows)


def expected(texts):
    return sorted((str(k), *brute(t), bits(brute(t))) for k, t in texts)


def test_awkward_rows(awkward, nothing):
    got = rules.ledger(awkward).collect()
    assert shown(got) == expected([(r.doc_id, r.text) for r in awkward.collect()])
    assert rules.ledger(nothing).count() == 0 and rules.ablations(rules.ledger(nothing)).count() == 0
    kept = rules.keep(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(r.doc_id) for r in awkward.collect() if not bits(brute(r.text)) & 63
    )


def test_repeats_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["a b c", "a b c a b c", "a a a a", "a a a", "x " * 500, "a b c d a b c", "ab c d a bc d ab c d"]
    for n in range(60):
        vocabulary = [f"w{i}" for i in range(rng.choice([2, 4, 30, 3000]))]
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 120))]
        texts.append(rng.choice(["\n", "\n\n", " \n"]).join(lines + rng.sample(lines, len(lines) // 3)))
    rows = list(enumerate(texts))
    got = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert shown(got) == expected(rows)


def test_policies_and_ablations(spark):
    rows = [(i, b) for i, b in enumerate([0, 0, 1, 2, 3, 4, 5, 8, 64, 127])]
    ledger = spark.createDataFrame(rows, "_id long, failures long")
    got = {(r.policy, r.version, r.rule): r for r in rules.ablations(ledger).collect()}
    for (name, version), members in rules.POLICIES.items():
        mask = rules.policy_mask((name, version))
        for rule in members:
            r = got[name, version, rule]
            assert r.n_docs == len(rows) and r.n_kept == sum(not b & mask for _, b in rows)
            assert r.n_failed == sum(bool(b & rules.BIT[rule]) for _, b in rows)
            assert r.n_alone == sum(b & mask == rules.BIT[rule] for _, b in rows)
    named = ledger.select(rules.failed_rules(ledger.failures).alias("r")).collect()
    assert named[6].r == ["few_words", "many_symbols"] and named[-1].r == list(rules.RULES)


def test_no_python_on_executors(awkward):
    plan = rules.ledger(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
