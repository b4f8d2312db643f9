"""Registered queries of the training-data operators, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.llm import (
    chat,
    decontamination,
    exact_dedup,
    hard_negatives,
    licence_scan,
    packing,
    quality,
    quality_rules,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
    whitening,
)
from dayglass.llm.common import table
from dayglass.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it has no exact counterpart in plain SQL."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(tune(spark), sf_dir)

        run.__doc__, run.__name__ = f.__doc__, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query(
    "op1_chat_formatting",
    r"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), shown AS (
      SELECT *, 2 + length(role) + (role = 'end')::INTEGER + length(regexp_replace(role, '[^<\[|\\]', '', 'g')) + 3 + length(text)
        + length(regexp_replace(text, '[^<\[|\\]', '', 'g')) + 8 AS chars
      FROM rows
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM shown GROUP BY conv_id
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what its formatted text reads back as."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                        F.lit(role).alias("role"), F.lit(probe).alias("text"),
                    )
                    for i, role in enumerate(("user", "assistant"))
                ]
            )
        )
    )
    done = chat.format_trees(chat.threads(turns.unionByName(extra)))
    read = done.select(
        F.col("tree").alias("conv_id"),
        chat.read_turns(F.col("formatted")).alias("_turns"),
        chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("_learned"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, reach=2)


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op5_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    WINDOW same AS (PARTITION BY t)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of every document, digests included."""
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    # a row for each input row, those that repeat id and text as well
    copies = groups.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return copies.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _known_sql() -> str:
    texts = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licence_scan.KNOWN)
    digests = ", ".join(f"('{n}', '{d}')" for n, d in licence_scan.DIGESTS)
    return f"""
      SELECT min(licence) AS licence, digest FROM (
        SELECT licence, sha256({licence_scan.canonical_sql("t")}) AS digest FROM (VALUES {texts}) k(licence, t)
        UNION ALL SELECT * FROM (VALUES {digests}) f(licence, digest)) GROUP BY 2
    """


@query(
    "op6_licence_scan",
    f"""
    WITH known AS ({_known_sql()}
    ), whole AS (
      SELECT doc_id, sha256({licence_scan.canonical_sql("text")}) AS digest FROM documents
    ), lines AS (
      SELECT doc_id, sha256({licence_scan.canonical_sql("line")}) AS digest
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
    ), found AS (
      SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences, count(*) AS n
      FROM lines JOIN known USING (digest) GROUP BY 1
    )
    SELECT doc_id, whole.digest AS text_digest, coalesce(licence, '') AS licence,
           coalesce(line_licences, '') AS line_licences, coalesce(n, 0) AS n_licence_lines
    FROM whole LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document is or holds."""
    found = licence_scan.licence_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "text_digest",
        F.coalesce("licence", F.lit("")).alias("licence"),
        F.array_join("line_licences", ",").alias("line_licences"),
        "n_licence_lines",
    )


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document."""
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op8_benchmark_decontamination",
    r"""
    WITH low AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents
    ), d AS (
      SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low
    ), b AS (
      SELECT item_id, w, len(w) AS n, least(len(w), 10) AS k FROM (
        SELECT item_id, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark)
    ), g AS (
      SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
      FROM (SELECT item_id, w, k, unnest(range(1, n - k + 2)) AS i FROM b WHERE n > 0)
    ), sizes AS (
      SELECT DISTINCT k FROM g
    ), grams AS (
      SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
    ), hits AS (
      SELECT doc_id, i, k, item_id FROM grams JOIN g USING (k, gram)
    ), covered AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1
    ), named AS (
      SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and test items of every document."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op9_substring_dedup",
    r"""
    WITH cut AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^.!?\n\x{3002}\x{FF01}\x{FF1F}]*[.!?\n\x{3002}\x{FF01}\x{FF1F}]+|[^.!?\n\x{3002}\x{FF01}\x{FF1F}]+') AS u
      FROM documents
    ), tiles AS (
      SELECT r, doc_id, i, x, sum(length(x)) OVER (PARTITION BY r ORDER BY i) - length(x) AS pos,
             array_to_string(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') AS words
      FROM (SELECT r, doc_id, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS i FROM cut)
    ), units AS (
      SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS place,
             greatest(len(string_split(words, ' ')), length(replace(words, ' ', '')) // 8) AS w
      FROM tiles WHERE words <> ''
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, place) AS k FROM units
    ), runs AS (
      SELECT r, min(pos) AS start, max(pos + length(x)) AS stop,
             sum(CASE WHEN w >= 3 THEN w ELSE 0 END) AS weight
      FROM (SELECT *, place - row_number() OVER (PARTITION BY r ORDER BY place) AS run FROM ranked WHERE k > 1)
      GROUP BY r, run
    ), gone AS (
      SELECT r, start, stop FROM runs WHERE weight >= 20
    ), kept AS (
      SELECT r, string_agg(x, '' ORDER BY i) AS t
      FROM tiles ANTI JOIN gone ON tiles.r = gone.r AND tiles.pos >= gone.start AND tiles.pos < gone.stop GROUP BY r
    ), spans AS (
      SELECT r, count(*) AS n, sum(stop - start) AS chars,
             string_agg(start::BIGINT || '+' || (stop - start)::BIGINT, ',' ORDER BY start) AS spans
      FROM gone GROUP BY r
    )
    SELECT doc_id, coalesce(n, 0) AS n_removed, coalesce(chars, 0)::BIGINT AS removed_chars, coalesce(spans, '') AS removed_spans,
           sha256(coalesce(kept.t, '')) AS cleaned_sha256
    FROM cut LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages removed from every document because an earlier document or place has them."""
    done = substring_dedup.passage_dedup(table(spark, sf_dir, "documents"))
    removed = F.coalesce("_removed", F.array().cast(done.schema["_removed"].dataType))
    spans = F.transform(removed, lambda u: F.concat(u["start"].cast("string"), F.lit("+"), u["length"].cast("string")))
    return done.select(
        F.col("_id").alias("doc_id"),
        F.size(removed).cast("long").alias("n_removed"),
        F.aggregate(removed, F.lit(0).cast("long"), lambda n, u: n + u["length"]).alias("removed_chars"),
        F.array_join(spans, ",").alias("removed_spans"),
        F.sha2(F.coalesce("_cleaned", F.lit("")).cast("binary"), 256).alias("cleaned_sha256"),
    )


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the eight leading components, whitened."""
    found = whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query(
    "op12_hard_negatives",
    """
    WITH e AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
    ), p AS (
      SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
    )
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
           other AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, against all vectors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("_id") % 50 == 0)


@query(
    "op13_quality_rules",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
      FROM documents
    ), windows AS (
      SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
    ), again AS (
      SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1
    ), covered AS (
      SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM windows JOIN again USING (r, g)) GROUP BY r
    ), m AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM d LEFT JOIN covered USING (r)
    ), f AS (
      SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
        + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
        + 32 * (word_chars > 40 * n_words)::BIGINT + 64 * (n_words > 100000)::BIGINT) AS failures
      FROM m
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (failures & 3) <> 0 AS base_failed, (failures & 63) = 0 AS kept, failures
    FROM f
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, failure bits and verdicts of every document."""
    found = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality_rules.rejected(("base", 1)).alias("base_failed"),
        (~quality_rules.rejected()).alias("kept"),
        "failures",
    )
