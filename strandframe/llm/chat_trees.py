"""Chat formatting from reply trees.

Messages form trees: each names its parent. Self-joins that double their reach carry, for every message, the sum of
scores and the length of its way to the root, in as many rounds as the longest way has binary digits. A branch (root to
leaf) is ranked by the mean score of its messages; only the chosen ones are then expanded into their messages, by the
same jumps, and formatted, each as one conversation.

A turn is written `### <role>: <text></turn>` and a line break. Inside texts and roles the escape sign `\\` becomes
`\\\\`, `</turn>` becomes `\\e` and `###` becomes `\\h` (in roles also `:` `\\c`), so control strings stand only where the
template puts them, and reading back restores every text exactly. The loss mask, `loss_spans`, names the characters of
the formatted text that are trained on: the (escaped) texts of assistant turns, as starts from 0 and lengths.

Defined results: a null text or role is empty; a message whose parent is null or missing is a root; ties of branches
go to the least leaf; messages with a null id are dropped from trees, since nothing can refer to them; repeated ids
count once (least role and text); rows with a null tree belong to none and are dropped, but rows with a null conv_id are
one conversation; cycles have no root and give no branch; empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

END, MARK = "</turn>", "###"
LOSS_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit(END), F.lit("\\e")), F.lit(MARK), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """Left to right: pairs of escape signs are split off first, so what follows a single one is its letter."""
    part = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\e"), F.lit(END)), F.lit("\\h"), F.lit(MARK)), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def format_turns(turns: Column) -> Column:
    """Text of an array of structs with role and text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(MARK + " "), escape(t["role"], True), F.lit(": "), escape(t["text"]), F.lit(END + "\n"))), "")


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that `format_turns` wrote."""
    parts = F.split(formatted, END + "\n", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(x: Column) -> Column:
        at = F.locate(": ", x)
        return F.struct(unescape(F.substring(x, F.lit(len(MARK) + 2), at - len(MARK) - 2)).alias("role"), unescape(F.substring(x, at + 2, F.length(x))).alias("text"))

    return F.transform(turns, turn)


def branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, rank, score, node and depth of the messages on the `best` branches of every tree.

    `messages` has tree, node, parent, score.
    """
    nodes = cut(messages.where(F.col("node").isNotNull()).groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score")))
    known = nodes.select("tree", F.col("node").alias("parent"), F.col("node").alias("up"))
    # from each message to the one 2 ** round above it (up, null beyond the root), and what lies on that way
    ways = cut(nodes.join(known, ["tree", "parent"], "left").select("tree", "node", "up", F.col("score").alias("sum"), F.lit(1).cast("long").alias("length")))
    jumps, limit = [], nodes.count()
    while 1 << len(jumps) <= limit:
        jump = ways.where("up is not null")
        if jump.isEmpty():
            break
        jumps.append(jump.select("tree", "node", "up"))
        above = ways.select("tree", F.col("node").alias("up"), F.col("up").alias("top"), F.col("sum").alias("more"), F.col("length").alias("further"))
        longer = jump.join(above, ["tree", "up"]).select("tree", "node", F.col("top").alias("up"), (F.col("sum") + F.col("more")).alias("sum"), (F.col("length") + F.col("further")).alias("length"))
        ways = cut(ways.where("up is null").unionByName(longer))
    # what has no root by now is in a cycle or below one
    leaves = ways.where("up is null").join(nodes.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    scored = leaves.select("tree", F.col("node").alias("leaf"), (F.col("sum") / F.col("length")).alias("score"), "length")
    ranked = cut(scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("rank") <= best))
    paths = ranked.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        # the path is known at every 2 ** (k + 1)-th message; these jumps add those between
        step = paths.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        paths = cut(paths.unionByName(step))
    return paths.join(ranked, ["tree", "leaf"]).select("tree", "leaf", "rank", "score", "node", (F.col("length") - 1 - F.col("back")).alias("depth"))


def conversations(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, rank, score, formatted and loss_spans of the `best` branches; `messages` also has role and text."""
    chosen = branches(messages, best)
    said = messages.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("turn"))
    turns = chosen.join(said, ["tree", "node"]).select("tree", "leaf", "rank", "score", "depth", "turn.role", escape(F.col("turn.text")).alias("_text"), F.concat(F.lit(MARK + " "), escape(F.col("turn.role"), True), F.lit(": ")).alias("_head"))
    whole = F.concat("_head", "_text", F.lit(END + "\n"))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("_from", F.coalesce(F.sum(F.length(whole)).over(before), F.lit(0)) + F.length("_head"))
    # one conversation is one row by definition of the output
    item = F.struct("depth", whole.alias("part"), (F.col("role") == LOSS_ROLE).alias("loss"), F.col("_from").alias("start"), F.length("_text").cast("long").alias("length"))
    rows = placed.groupBy("tree", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(item)).alias("parts"))
    spans = F.transform(F.filter("parts", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return rows.select("tree", "leaf", "rank", "score", F.array_join(F.transform("parts", lambda t: t["part"]), "").alias("formatted"), spans.alias("loss_spans"))


def linear(rows: DataFrame) -> DataFrame:
    """Reply trees of one branch from conv_id, turn, role and text: each turn answers the one before it.

    A tree is named by its conv_id as text, by the empty text where that is null.
    """
    named = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "turn", "role", "text")
    nth = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    df = named.withColumn("node", F.row_number().over(nth).cast("long"))
    return df.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def digest(formatted: DataFrame) -> DataFrame:
    """The figures of every linear conversation, read back out of its formatted text and its loss mask."""
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = formatted.select("tree", "formatted", loss.alias("_loss"), let(read_turns(F.col("formatted")), lambda t: t).alias("turns"))
    all_ = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    df = read.select("tree", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_.cast("binary"), 256).alias("turns_sha256"), "_loss", F.length("formatted").cast("long").alias("formatted_chars"))
    return df.select(F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"), "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
