"""Chat formatting of reply trees. Native: DataFrame functions only.

Messages form trees by their parent. Iterative self-joins double the hop that every message knows:
after n rounds it knows its ancestor 2^n above, until the root is reached, so that a path of any length
takes a logarithmic number of rounds, and a round joins only the messages whose root is still unknown.
A message's state is a few numbers, never its whole path; scores add up along the way. Branches are
ranked by score per tree. The hops, longest first, then lead from the chosen leaves to every message of
their paths, and the text is joined once, to these.

The template is ``<turn ROLE>TEXT</turn>`` and a line feed per message. Within role and text, ``&``,
``<`` and ``>`` become ``&amp;``, ``&lt;`` and ``&gt;``, so no text can hold a control string, and
undoing that gives the exact text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, with_row_key

OPEN, OPENED, CLOSE = "<turn ", ">", "</turn>\n"
TRAINED_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def one_an_id(messages: DataFrame) -> DataFrame:
    """id, parent, score, a row an id; see best_paths() for which of several it is."""
    order = F.struct(F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"), F.col("parent").isNotNull().alias("p"), "parent")
    best = messages.filter("id is not null").groupBy("id").agg(F.max(order).alias("m"))
    return cut(best.select("id", "m.parent", F.col("m.s").alias("score")))


def best_steps(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """The messages of each tree's best paths: root, rank, leaf, score, pos (from the root, 0), id.

    See best_paths(); here a path of any length is rows, not an array. unique: no id is null or there twice.
    """
    if not unique:
        messages = one_an_id(messages)
    known = messages.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    nodes = cut(messages.join(known, "parent", "left").select(
        "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    nobody = F.lit(None).cast(nodes.schema["id"].dataType)
    replied = nodes.filter("up is not null").select(F.col("up").alias("id")).distinct()
    closed = nodes.filter("up is null").select("id", F.col("id").alias("root"), "score", F.lit(0).alias("depth"))
    still_open, before, hops = nodes.filter("up is not null"), None, []
    while (n_open := still_open.count()) and n_open != before:
        far = 1 << len(hops)
        hops.append(still_open.select("id", "up"))
        upper = closed.select(F.col("id").alias("up"), nobody.alias("up2"), "root", F.col("score").alias("score2"), "depth").unionByName(
            still_open.select(F.col("id").alias("up"), F.col("up").alias("up2"), nobody.alias("root"), F.col("score").alias("score2"), F.lit(None).cast("int").alias("depth")))
        further = cut(still_open.join(upper, "up").select(
            "id", F.col("up2").alias("up"), "root", (F.col("score2") + F.col("score")).alias("score"), (F.col("depth") + far).alias("depth")))
        closed = closed.unionByName(further.filter("root is not null").drop("up"))
        still_open, before = further.filter("root is null").select("id", "up", "score"), n_open
    leaves = closed.join(replied, "id", "left_anti")
    order = Window.partitionBy("root").orderBy(F.desc("score"), "id")
    best = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches)
    steps = cut(best.select("root", "rank", F.col("id").alias("leaf"), "score", F.col("depth").alias("pos"), "id"))
    for i in reversed(range(len(hops))):
        above = steps.filter(F.col("pos") >= 1 << i).join(hops[i], "id")
        above = above.select("root", "rank", "leaf", "score", (F.col("pos") - (1 << i)).alias("pos"), F.col("up").alias("id"))
        steps = cut(steps.unionByName(above))
    return steps


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best root-to-leaf paths of each tree: root, rank, leaf, score, path (ids from the root on).

    messages: id, parent, score. A message without a parent, or whose parent is not there, is a root.
    Scores add up (null: 0); ties go to the smaller leaf. Messages on a circle of replies, or below
    one, belong to no tree and to no path, nor does a message without an id. Of rows with the same id
    one is taken: the highest score, then one with a parent, then the largest parent. An empty table
    has no paths; other columns are not read.
    """
    steps = best_steps(messages, branches).groupBy("root", "rank", "leaf", "score")
    return steps.agg(F.sort_array(F.collect_list(F.struct("pos", "id")))["id"].alias("path"))


def format_paths(paths: DataFrame, messages: DataFrame, trained_roles=TRAINED_ROLES) -> DataFrame:
    """Each chosen path as one conversation: root, rank, leaf, score, formatted, loss_spans.

    messages: id, role, text (nulls: empty; of rows with the same id the first by role and text, nulls
    first). loss_spans has (start, end) in code points of formatted,
    end exclusive, for the text of every message whose role is trained.
    """
    return format_steps(paths.select("root", "rank", "leaf", "score", F.posexplode("path").alias("pos", "id")), messages, trained_roles)


def format_steps(steps: DataFrame, messages: DataFrame, trained_roles=TRAINED_ROLES, unique: bool = False) -> DataFrame:
    """format_paths() of paths that are rows, as best_steps() gives them; unique: no id is there twice."""
    texts = messages.select("id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts if unique else texts.groupBy("id").agg(F.min(F.struct("role", "text")).alias("m")).select("id", "m.*")
    turn = steps.join(texts, "id").select(
        "root", "rank", "leaf", "score", "pos", F.col("role").isin(*trained_roles).alias("trained"),
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(OPENED)).alias("head"), escape(F.col("text")).alias("body"))
    turns = turn.groupBy("root", "rank", "leaf", "score").agg(F.sort_array(F.collect_list(F.struct("pos", "head", "body", "trained"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(t["trained"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return turns.select("root", "rank", "leaf", "score", formatted.alias("formatted"), F.aggregate("turns", begin, step)["spans"].alias("loss_spans"))


def threads(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Plain conversations as reply trees: every row answers the one before it.

    Rows go by turn, then role, then text, nulls first, and repeated ones stay. A row without a
    conversation id is a conversation of its own. id and parent are (row of such a one, conversation,
    position).
    """
    base, key = with_row_key(turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")))
    lone = F.when(F.col("conv").isNull(), F.col(key))
    numbered = base.withColumn("lone", lone).withColumn("n", F.row_number().over(Window.partitionBy("lone", "conv").orderBy("turn", "role", "text")))
    node = lambda n: F.struct("lone", "conv", n.alias("n"))
    return numbered.select(
        node(F.col("n")).alias("id"), F.when(F.col("n") > 1, node(F.col("n") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_conversations(turns: DataFrame, trained_roles=TRAINED_ROLES, **columns: str) -> DataFrame:
    """Conversations formatted: conv_id, formatted, loss_spans, one row each.

    Null roles and texts are empty; rows without a conversation id are conversations of one turn; ids
    may be of any type that sorts. An empty table gives an empty result; other columns are not read.
    """
    messages = cut(threads(turns, **columns))
    done = format_steps(best_steps(messages.select("id", "parent", "score"), unique=True), messages, trained_roles, unique=True)
    return done.select(F.col("root.conv").alias("conv_id"), "formatted", "loss_spans")


def read_back(formatted: Column) -> Column:
    """The messages of a formatted conversation: array of (role, text)."""
    parts = F.split(formatted, F.lit(CLOSE))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def message(part: Column) -> Column:
        split_at = F.instr(part, OPENED)
        return F.struct(
            unescape(F.substring(part, F.lit(len(OPEN) + 1), split_at - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(part, split_at + 1, F.length(part))).alias("text"))

    return F.transform(parts, message)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["start"] + 1, s["end"] - s["start"])), ""))
