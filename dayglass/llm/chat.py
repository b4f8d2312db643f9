"""Chat formatting: root-to-leaf paths of reply trees as one conversation each.

Only columns of the DataFrame API; no Python runs on the executors. Ancestors are found
by joining the table of links with itself, each round doubling how far a link reaches,
so a thread of n turns takes log2(n) rounds.

The template opens a turn with ``<|role|>`` and a line break, and ends it with
``<|end|>`` and a line break. Inside texts and roles a backslash is doubled and ``<``,
``[`` and ``|`` are followed by one, so no control string of this or a similar template
can stand in a text, and ``unescape`` gives every text back. A role that is the control
word ``end`` itself gets a single backslash in front, which nothing else has.

Defined results: a null text or role counts as empty. A reply to a node that is not
there starts a tree of its own. Nodes that repeat an id in a tree are told apart by
order of role and text only in ``threads``; ``paths`` asks for distinct ids. Nodes on a
circle of replies have no root and so no path. An empty table gives no rows. Columns
other than the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass.session import materialise

END = "<|end|>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[|])", r"$1\\")


def unescape(text: Column) -> Column:
    shut = F.regexp_replace(text, r"([<\[|])\\", "$1")
    return F.replace(shut, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.when(role == "end", F.lit("\\end")).otherwise(escape(role))


def unescape_role(role: Column) -> Column:
    return F.when(role == "\\end", F.lit("end")).otherwise(unescape(role))


def threads(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as a reply tree: every row replies to the one before it.

    Gives (``tree``, ``node``, ``parent``, ``role``, ``text``, ``score``). Rows that share
    a turn follow each other by role and text.
    """
    order = Window.partitionBy("tree").orderBy("_turn", "role", "text")
    rows = turns.select(
        F.col(conv_col).alias("tree"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    node = F.row_number().over(order).cast("long")
    numbered = rows.select("tree", node.alias("node"), "role", "text")
    before = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", before.alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of each tree: (``tree``, ``leaf``, ``rank``, ``node``, ``place``).

    A path scores the sum of its nodes' scores; of equal ones the smaller leaf id comes
    first. ``place`` counts from 0 at the root.
    """
    held = nodes.select("tree", "node", "parent", "score")
    ids = held.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    known = held.join(ids, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")), "left")
    # up: an ancestor ``far`` steps away, null past the root; total: scores of the steps between
    jump = materialise(
        known.select("tree", "node", F.col("_n").alias("up"), F.lit(1).cast("long").alias("far"), F.col("score").alias("total")),
        "chat-links",
    )
    size = held.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    rounds, levels, current = max(0, int(size - 1).bit_length()), [jump], jump
    for _ in range(rounds):
        if current.where("up is not null").isEmpty():
            break
        right = current.select(
            F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"),
            F.col("far").alias("_far"), F.col("total").alias("_total"),
        )
        # nodes whose link is past the root already are done
        still = current.where("up is not null")
        met = still.join(right, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("up") == F.col("_n")), "left")
        current = materialise(
            current.where("up is null").unionByName(met.select(
                "tree", "node", F.col("_up").alias("up"),
                (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"),
                (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"),
            )),
            "chat-links",
        )
        levels.append(current)
    parents = jump.where("up is not null").select(F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    leaves = current.where("up is null").join(
        parents, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti"
    )
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    chosen = ranked.select("tree", F.col("node").alias("leaf"), "rank", F.col("far").alias("_depth"), "node", F.lit(0).cast("long").alias("_away"))
    # from the farthest reach to the nearest, each known member adds one ancestor
    for k in range(len(levels) - 1, -1, -1):
        right = levels[k].where("up is not null").select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        met = chosen.join(right, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
        more = met.select("tree", "leaf", "rank", "_depth", F.col("_up").alias("node"), (F.col("_away") + 2**k).alias("_away"))
        chosen = materialise(chosen.unionByName(more), "chat-members")
    place = F.col("_depth") - 1 - F.col("_away")
    return chosen.select("tree", "leaf", "rank", "node", place.alias("place"))


def format_paths(nodes: DataFrame, chosen: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per path: ``formatted`` text and ``loss_spans``, the code points (start, length) of learned texts."""
    member = chosen.select(
        F.col("tree").alias("_t"), F.col("node").alias("_n"), "leaf", "rank", "place"
    )
    joined = nodes.join(member, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    head = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>\n"))
    body = escape(F.col("text"))
    turns = joined.select(
        "tree", "leaf", "rank", "place", "role", head.alias("_head"), body.alias("_body"),
    ).withColumn("_turn", F.concat("_head", "_body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    opened = turns.withColumn("_start", F.coalesce(F.sum(F.char_length("_turn")).over(before), F.lit(0)))
    span = F.struct(
        (F.col("_start") + F.char_length("_head")).cast("long").alias("start"),
        F.char_length("_body").cast("long").alias("length"),
    )
    learned = F.when(F.col("role") == learn_role, span)
    # one conversation is one value in the end, so its turns meet in one place
    whole = opened.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("place", "_turn"))).alias("_turns"),
        F.sort_array(F.collect_list(learned)).alias("loss_spans"),
    )
    return whole.select("tree", "leaf", "rank", F.array_join("_turns._turn", "").alias("formatted"), "loss_spans")


def format_trees(nodes: DataFrame, branches: int = 1, learn_role: str = "assistant") -> DataFrame:
    """Rank the branches of every tree and format the best ones."""
    return format_paths(nodes, paths(nodes, branches), learn_role)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as (``role``, ``text``), unescaped."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, r"^<\|([\s\S]*?)\|>\n", 1)
        text = F.substr(p, F.char_length(role) + 6, F.char_length(p))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(cut, "")
