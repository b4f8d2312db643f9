from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dayglass.llm import graph, simhash


def unsigned(n):
    return n & (1 << 64) - 1


def brute_print(text, width=3):
    words = (text or "").lower() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    runs = [words[i : i + width] for i in range(len(words) - width + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints, reach):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    order = sorted(prints)
    for i, a in enumerate(order):
        for b in order[:i]:
            if bin(unsigned(a ^ b)).count("1") <= reach:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_fingerprints(awkward):
    got = simhash.near_duplicates(awkward).collect()
    texts = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{brute_print(t):016x}") for i, t in texts)
    component = {r.doc_id: r.component_id for r in got}
    assert component[1] == component[2] == 1 and component[3] == component[4] == component[10] == 3
    assert component[None] is None and component[6] == 6


@pytest.mark.parametrize("crowded", [256, 3, 0])
@pytest.mark.parametrize("reach", [0, 1, 2])
def test_links_match_brute_force(spark, reach, crowded):
    rng = random.Random(reach)
    prints = {0, -1}
    for _ in range(25):  # clusters, some sharing a whole half
        base = rng.getrandbits(64)
        prints |= {base}
        for _ in range(12):
            flips = rng.choice([range(64), range(32), range(32, 64)])
            value = base
            for b in rng.sample(flips, rng.randint(1, 4)):
                value ^= 1 << b
            prints.add(value)
    prints = {p - (1 << 64) if p >> 63 and p > 0 else p for p in prints}
    df = spark.createDataFrame([(p,) for p in prints], "_fp long")
    got = {tuple(sorted(r)) for r in simhash.links(df, reach, crowded).collect()}
    order = sorted(prints)
    want = {(a, b) for i, b in enumerate(order) for a in order[:i] if bin(unsigned(a ^ b)).count("1") <= reach}
    assert got == want


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    rng.shuffle(chain)
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}}
    assert graph.components(df.limit(0)).count() == 0


def test_one_of_each_component_stays(awkward, nothing):
    got = simhash.drop_near_copies(awkward)
    assert got.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(["1", "3", "5", "6", "None", "8", "9"])
    assert simhash.drop_near_copies(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


def test_query_matches_brute_force(spark):
    from dayglass.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    roots = brute_roots(set(prints.values()), 2)
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], d), d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_near_dedup"](spark, sf).collect()}
    assert got == {d: (f"{p:016x}", least[roots[p]]) for d, p in prints.items()}


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def grouped(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("block", "faced"), [(simhash.BLOCK, simhash.FACED), (3, simhash.FACED), (3, 7)])
def test_similar_links_match_brute_force(spark, block, faced):
    """Families whose members share bands by the dozen, with members at, above and below 0.8."""
    rng = random.Random(7)
    sets = set()
    for _ in range(4):
        base = [rng.getrandbits(64) for _ in range(90)]
        for k in range(40):
            kept = rng.sample(base, 90 - k)
            sets.add(frozenset(kept + [rng.getrandbits(64) for _ in range(k % 15)]))
        sets.add(frozenset(base[:72]))  # 72 of 90: exactly 0.8
        sets.add(frozenset(base))
    sets = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    rows = [(i, simhash.band_keys(s).tolist(), s.view(np.int64).tolist()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "_node long, _keys array<long>, _set array<long>").cache()
    links = simhash.similar_links(df.select("_node", "_keys"), lambda n: df.join(n, "_node"), 0.8, block, faced).collect()
    members = [set(s.tolist()) for s in sets]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if jaccard(members[a], members[b]) >= 0.8}
    assert {tuple(sorted(r)) for r in links} <= want
    assert grouped(range(len(sets)), links) == grouped(range(len(sets)), want)


def test_near_copies_match_exact_components(spark):
    """The pipeline's stage against exact similarity, with a family that crowds band values."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = [f"w{i}" for i in range(400)]
    rows += [(10**6 + k, " ".join(words[: 400 - k % 3] + [f"own{k}"])) for k in range(300)]
    sets = {d: set(simhash.shingles(t, 5)) for d, t in rows}
    order = sorted(sets)
    same = [(a, b) for i, b in enumerate(order) for a in order[:i] if jaccard(sets[a], sets[b]) >= 0.8 or not sets[a] | sets[b]]
    want = set(grouped(order, same).values())
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


def test_near_copies_among_texts_with_one_common_passage(spark):
    """A family of 3 000 near copies, and as many texts that share a passage but are no copies."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(140)]
    passage = [f"p{i}" for i in range(110)]
    rows, copies = [], 3_000
    for k in range(copies):
        words = list(base)
        if k:
            words[rng.randrange(140)] = f"edit{k}"
        rows.append((k, " ".join(words)))
    for k in range(copies):
        own = [f"own{k}x{i}" for i in range(32)]
        rows.append((10_000 + k, " ".join(own[:16] + passage + own[16:])))
    rows += [(20_000 + k, " ".join([f"own{k}x{i}" for i in range(16)] + passage + [f"own{k}x{i}" for i in range(16, 32)] + ["end"])) for k in range(5)]
    got = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == {0} | {10_000 + k for k in range(copies)}


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_prefixes_of_similar_sets_meet(similarity):
    rng = random.Random(2)
    for _ in range(3_000):
        universe = rng.sample(range(1000), rng.randint(1, 40))
        a = {x for x in universe if rng.random() < 0.95}
        b = {x for x in universe if rng.random() < 0.95}
        if a and b and jaccard(a, b) >= similarity:
            first = [set(sorted(x)[: simhash.prefix_length(len(x), similarity)]) for x in (a, b)]
            assert first[0] & first[1]
            # and the first element they share leaves room for all others
            least = min(a & b)
            places = [np.array([sorted(x).index(least)]) for x in (a, b)]
            assert simhash._room(places[0], np.array([len(a)]), places[1], np.array([len(b)]), similarity).all()
