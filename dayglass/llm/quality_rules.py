"""Quality rules as a ledger of failure bits: every rule is evaluated once, policies come later.

One pass over the texts writes a row for each document: what was measured, and a number
whose bit b is set where rule b fails. A policy is a versioned set of rules, so applying
one, or asking what a rule costs, is arithmetic on those bits and reads no text again.
Ablations first count the distinct failure patterns, of which there are at most
2 ** len(RULES), whatever the number of documents.

Only columns of the DataFrame API; no Python runs on the executors.

Repeated windows are found inside a row: the hash of each window of three words keeps its
high bits and carries its place in the low ones, so one sort of plain numbers brings equal
windows together in order of place. Neighbours count as equal only if their words are.

Defined results: a null, empty or blank text has no words, fails ``few_words`` and is not
kept. Repeated rows and ties of ids give a row each, null ids too. Whole texts are
measured, however long: a text is one row, and its work grows with n log n of its words.
An empty table gives no rows. Columns other than the id and the text pass through ``keep``
untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.common import packed, unpacked

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 3

# Rule names in order of their bits; the order is part of the ledger's format and only grows.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 40 * n_words",
    "many_words": "n_words > 100000",
}
BIT = {name: 1 << b for b, name in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")

# Policies by (name, version): the rules whose failure rejects a document.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): BASE,
    ("standard", 1): (*BASE, "many_symbols", "repeated_lines"),
    ("standard", 2): (*BASE, "many_symbols", "repeated_lines", "short_words", "long_words"),
    ("strict", 1): tuple(RULES),
}
DEFAULT = ("standard", 2)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def policy_mask(policy: tuple[str, int] = DEFAULT) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _once(df: DataFrame, **found: Column) -> DataFrame:
    """Add columns through a generator: lambdas that read them never see, and rerun, what made them."""
    made = F.struct(*[c.alias(n) for n, c in found.items()])
    return df.select("*", F.inline(F.array(made)))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words of ``_words`` inside windows of three that occur twice or more."""
    # the places need as many low bits as the number of words has; the hash keeps the rest
    sized = _once(df, _low=F.expr("shiftleft(1L, cast(length(bin(size(_words))) as int)) - 1L"))

    def key(i: Column) -> Column:
        window = F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])
        return window.bitwiseAND(F.bitwise_not("_low")).bitwiseOR(i.cast("long"))

    last = F.size("_words") - WINDOW
    keys = F.when(last > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), key))
    ordered = _once(sized, _keys=F.sort_array(F.coalesce(keys, F.array().cast("array<bigint>"))))

    def neighbour(rows: str, same) -> Column:
        """The elements of a sorted array that equal the one before or after."""

        def either(x: Column, i: Column) -> Column:
            after, before = (F.coalesce(same(x, F.get(rows, i + k)), F.lit(False)) for k in (1, -1))
            return after | before

        return F.filter(rows, either)

    def same_hash(x: Column, other: Column) -> Column:
        return x.bitwiseXOR(other).bitwiseAND(F.bitwise_not("_low")) == 0

    def same_words(x: Column, other: Column) -> Column:
        a, b = (v.bitwiseAND(F.col("_low")).cast("int") for v in (x, other))
        return reduce(Column.__and__, [F.get("_words", a + k) == F.get("_words", b + k) for k in range(WINDOW)], same_hash(x, other))

    # few windows have an equal hash beside them; only these compare their words
    near = _once(ordered, _near=neighbour("_keys", same_hash)).drop("_keys")
    places = F.transform(neighbour("_near", same_words), lambda x: x.bitwiseAND(F.col("_low")))
    placed = _once(near, _places=F.sort_array(places))
    # a window adds the words up to the next repeated window, all of its own at most
    own = F.transform(
        "_places", lambda p, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW).cast("long")))
    )
    return placed.withColumn("n_repeat_words", F.aggregate(own, F.lit(0).cast("long"), lambda n, k: n + k))


def measure(df: DataFrame, text: Column) -> DataFrame:
    """Add the columns named in ``MEASURES``, all of type long."""
    source = df.withColumn("_said", F.coalesce(text, F.lit("")))
    lines = F.filter(F.split("_said", "\n", -1), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)
    words = F.regexp_extract_all("_said", F.lit(WORD), F.lit(0))
    counted = _repeat_words(_once(source, _words=words, _lines=lines))
    found = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count("_said", F.lit(SYMBOL)),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.col("n_repeat_words"),
    }
    return counted.select(*[F.col(c) for c in df.columns], *[v.cast("long").alias(n) for n, v in found.items()])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``_row`` with all its columns, the measures, and ``failures``."""
    measured = measure(packed(docs, id_col, text_col), F.col("_text"))
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    return measured.withColumn("failures", reduce(Column.bitwiseOR, bits)).drop("_text")


def rejected(policy: tuple[str, int] = DEFAULT) -> Column:
    """Whether a ledger row breaks a rule of the policy."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy))) != 0


def failed_rules(failures: Column) -> Column:
    """The names behind failure bits, in order of the bits."""
    named = F.array(*[F.when(failures.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in BIT.items()])
    return F.array_compact(named)


def keep(docs: DataFrame, policy: tuple[str, int] = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, all their columns."""
    return unpacked(ledger(docs, id_col, text_col).where(~rejected(policy)))


def ablations(rows: DataFrame, policies: dict[tuple[str, int], tuple[str, ...]] | None = None) -> DataFrame:
    """What each rule of each policy does, from a ledger's ``failures`` alone.

    Per (``policy``, ``version``, ``rule``): ``n_docs``, ``n_kept`` under the whole policy,
    ``n_failed`` by the rule, ``n_alone`` that no other rule of the policy rejects (what
    leaving it out would bring back).
    """
    patterns = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("_n"))
    known = [
        F.struct(
            F.lit(name).alias("policy"), F.lit(version).alias("version"), F.lit(rule).alias("rule"),
            F.lit(BIT[rule]).cast("long").alias("_bit"), F.lit(sum(BIT[r] for r in rules)).cast("long").alias("_mask"),
        )
        for (name, version), rules in (policies or POLICIES).items()
        for rule in rules
    ]
    met = F.col("failures").bitwiseAND(F.col("_mask"))

    def docs_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0)).cast("long")

    return patterns.select("failures", "_n", F.inline(F.array(*known))).groupBy("policy", "version", "rule").agg(
        F.sum("_n").cast("long").alias("n_docs"),
        docs_where(met == 0).alias("n_kept"),
        docs_where(met.bitwiseAND(F.col("_bit")) != 0).alias("n_failed"),
        docs_where(met == F.col("_bit")).alias("n_alone"),
    )
