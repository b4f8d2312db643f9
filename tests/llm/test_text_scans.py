from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from dayglass.llm import licence_scan, substring_dedup, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def reference(vocabulary, **options):
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, **options))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


ODD = ["", "a", " a", "  a  b ", "▁x", "<s> </s><0x0A>", "\n\n", "🙂🙃 한国 x", "\x00\x01", "a" * 300, "ſſſ ﷽ b"]


def test_counts_are_the_tokenizer_s(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD
    vocabulary = token_counts.piece_scores(PATH)
    counter, wanted = token_counts.UnigramCounter(vocabulary), reference(vocabulary, byte_fallback=True)
    assert [counter.count(t) for t in texts] == [wanted(t) for t in texts]
    fewer = [p for p in vocabulary if not p[0].startswith("<0x")]
    counter, wanted = token_counts.UnigramCounter(fewer), reference(fewer)
    assert [counter.count(t) for t in texts[:80] + ODD] == [wanted(t) for t in texts[:80] + ODD]


def test_ties_go_to_the_longest_last_piece():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0)]
    counter, wanted = token_counts.UnigramCounter(vocabulary), reference(vocabulary)
    for text in ("ab", "abab", "aab", "ba", "zab", "abz zz"):
        assert counter.count(text) == wanted(text)


def test_counts_of_awkward_rows(awkward, nothing):
    got = token_counts.token_counts(awkward, PATH).collect()
    counter = token_counts.UnigramCounter(token_counts.piece_scores(PATH))
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted(
        (str(r.doc_id), counter.count(r.text)) for r in awkward.collect()
    )
    assert token_counts.token_counts(nothing, PATH).count() == 0


def test_licences(spark, awkward, nothing):
    mit = licence_scan.KNOWN[5][1]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ,")),
        (2, "text\nlicensed under the apache licence version 2.0\nAll rights reserved!\nall rights reserved"),
        (3, mit + " And more."),
        (4, None),
        (5, "(c) nobody"),
        (6, "MIT"),
        (6, "All Rights Reserved"),
        (6, "All Rights Reserved"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.licence or "", tuple(r.line_licences), r.n_licence_lines) for r in licence_scan.licence_scan(df).collect())
    assert got == [
        (1, "MIT", ("MIT",), 1),
        (2, "", ("Apache-2.0", "all-rights-reserved"), 3),
        (3, "", (), 0),
        (4, "", (), 0),
        (5, "", (), 0),
        (6, "", (), 0),
        (6, "all-rights-reserved", ("all-rights-reserved",), 1),
        (6, "all-rights-reserved", ("all-rights-reserved",), 1),
    ]
    assert licence_scan.licence_scan(awkward).count() == awkward.count()
    assert licence_scan.licence_scan(nothing).count() == 0


def test_repeated_lines_go(spark, awkward, nothing):
    line = "one two three four five six"
    rows = [
        (3, f"own words of the third one\n{line.upper()}!\nshort line", 1),
        (1, f"{line}\nshort line\n{line}", 2),
        (None, line, 3),
        (4, None, 4),
        (5, "", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, _removed int")
    done = {r._id: r for r in substring_dedup.line_dedup(df).drop("_row").collect()}
    assert done[1]._cleaned == f"{line}\nshort line" and done[3]._cleaned == "own words of the third one\nshort line"
    assert done[None]._cleaned == "" and done[4]._cleaned is None and done[5]._cleaned == ""
    (cut,) = done[3]._removed
    assert (cut.line, cut.start, cut.length, cut.first) == (1, 27, 28, 1)
    assert rows[0][1][cut.start : cut.start + cut.length] == f"{line.upper()}!"
    kept = substring_dedup.drop_repeated(df)
    assert kept.columns == df.columns and kept.count() == 5
    assert substring_dedup.drop_repeated(nothing).count() == 0
    assert substring_dedup.drop_repeated(awkward).select(F.count("*")).first()[0] == awkward.count()


def test_lines_of_rows_that_share_an_id(spark):
    line = "one two three four five six"
    rows = [(1, line), (2, f"{line}\nfirst text"), (2, "the only place of these own words\nsecond text"), (2, f"{line}!!\nthird")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in substring_dedup.drop_repeated(df).collect())
    assert got == [(1, line), (2, "first text"), (2, rows[2][1]), (2, "third")]


def test_licence_files_as_published(spark):
    mit, isc = licence_scan.KNOWN[5][1], licence_scan.KNOWN[6][1]
    body = isc[isc.index("THE SOFTWARE") :]
    files = {
        "MIT": "MIT License\n\nCopyright (c) 2021 Some One\n\n" + mit.replace("of this software", "of\nthis software"),
        "ISC": "ISC License\n\nCopyright (c) 2004 Some One\n\nPermission to use, copy, modify, and/or distribute this software for any\n"
        "purpose with or without fee is hereby granted, provided that the above\n"
        "copyright notice and this permission notice appear in all copies.\n\n" + body,
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not "
        "distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "GPL-3.0-or-later": "/* SPDX-License-Identifier: GPL-3.0-or-later */",
    }
    df = spark.createDataFrame(list(files.items()), "doc_id string, text string")
    assert {r.doc_id: r.licence for r in licence_scan.licence_scan(df).collect()} == {n: n for n in files}


def test_licences_wrapped_anew(spark):
    """Every known text in lines of any width, a copyright line in front."""
    import textwrap

    long = [(n, t) for n, t in licence_scan.KNOWN if len(t) > 600]
    rows = [
        (f"{n}|{w}|{i}", "Copyright (c) 2020, Some One\n\n" + "\n\n".join(textwrap.fill(p, w) for p in t.split("\n\n")))
        for i, (n, t) in enumerate(long)
        for w in range(60, 99, 2)
    ]
    found = licence_scan.licence_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(found) == len(rows) >= 60 and all(r.licence == r.doc_id.split("|")[0] for r in found)


def test_whole_texts_by_digest(spark):
    """Licence files as a Debian system publishes them, where there is one, also wrapped anew."""
    import textwrap
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    if not all((folder / f).exists() for f in names):
        pytest.skip("no licence files here")
    texts = {n: (folder / f).read_text() for f, n in names.items()}
    rows = list(texts.items()) + [("MPL-2.0", textwrap.fill(texts["MPL-2.0"], 91)), ("GPL-3.0", texts["GPL-3.0"].upper())]
    found = licence_scan.licence_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(found) == len(rows) and all(r.licence == r.doc_id for r in found)
