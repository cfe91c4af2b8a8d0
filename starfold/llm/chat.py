"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by ``parent_id``. Ancestor tables (1, 2, 4, ... steps up) come from
iterative self-joins; the same tables, from the widest step down, enumerate the messages
of every root-to-leaf path. Every round is written, so the joins grow with the
logarithm of the depth and no plan holds more than one round. Branches are ranked by their mean score and each chosen path becomes
one conversation. Only ids travel through the joins; texts join the chosen paths.

Template: ``<turn role>text</turn>`` and a line feed per turn. Texts and roles write ``&`` as ``&amp;`` and
``<`` as ``&lt;`` (roles also ``>`` as ``&gt;``), so no text holds a control string and
a reader gets every text back. The loss mask lists the assistant texts' places.

Edge cases: a NULL text or role is empty; rows that repeat a place in a conversation
follow one another, ordered by role and text; a message whose parent is missing is a root;
messages on a cycle, and those below one, belong to no path; no messages give no conversations; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from starfold.llm.common import keep, release

#: The role whose texts are learned.
LEARNED = "assistant"
_HEAD, _TAIL = 7, 8  # "<turn " + ">" and "</turn>" + line feed
_TURN = r"<turn ([^<>]*)>([^<]*)</turn>\n"


def escape(text, role: bool = False):
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;")) if role else out


def unescape(text):
    out = F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def unescape_text(text):
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def chains(conversations: DataFrame) -> DataFrame:
    """Messages (tree_id, msg_id, parent_id, role, text, score) of linear conversations: each turn answers the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    place = F.row_number().over(w).cast("long")
    return rows.select(
        F.col("conv_id").alias("tree_id"),
        place.alias("msg_id"),
        F.when(place > 1, place - 1).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def paths(messages: DataFrame) -> DataFrame:
    """Every root-to-leaf path of ``messages``: tree_id, leaf, msg_id, up (steps from the leaf)."""
    same = lambda a, b: a.eqNullSafe(b)
    nodes = messages.select("tree_id", "msg_id", "parent_id")
    known = nodes.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"))
    step = nodes.join(known, same(F.col("tree_id"), F.col("t")) & (F.col("parent_id") == F.col("m"))).select(
        "tree_id", F.col("msg_id").alias("low"), F.col("m").alias("high")
    )
    steps = [keep(step, "chat-step")]
    parents = steps[0].select(F.col("tree_id").alias("t"), F.col("high").alias("m")).distinct()
    leaf = nodes.join(parents, same(F.col("tree_id"), F.col("t")) & (F.col("msg_id") == F.col("m")), "left_anti")
    left = steps[0].count()
    while left:
        a = steps[-1]
        b = a.select(F.col("tree_id").alias("t"), F.col("low").alias("mid"), F.col("high").alias("top"))
        twice = a.join(b, same(F.col("tree_id"), F.col("t")) & (F.col("high") == F.col("mid"))).select(
            "tree_id", "low", F.col("top").alias("high")
        )
        steps.append(keep(twice, "chat-step"))
        before, left = left, steps[-1].count()
        if left == before:  # what is left climbs for ever: it hangs on a cycle and has no root
            endless = steps[-1].select(F.col("tree_id").alias("t"), F.col("low").alias("m")).distinct()
            leaf = leaf.join(endless, same(F.col("tree_id"), F.col("t")) & (F.col("msg_id") == F.col("m")), "left_anti")
            break
    found = leaf.select("tree_id", F.col("msg_id").alias("leaf"), "msg_id", F.lit(0).cast("long").alias("up"))
    for k in range(len(steps) - 2, -1, -1):
        s = steps[k].withColumnRenamed("tree_id", "t")
        higher = found.join(s, same(F.col("tree_id"), F.col("t")) & (F.col("msg_id") == F.col("low"))).select(
            "tree_id", "leaf", F.col("high").alias("msg_id"), (F.col("up") + (1 << k)).alias("up")
        )
        wider, found = found, keep(found.unionByName(higher), "chat-paths")
        if k < len(steps) - 2:
            release(wider, steps[k + 1])
    return found


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Formatted conversations of the ``best`` paths of each tree (all by default).

    Returns tree_id, leaf, rank, formatted and loss_spans (first code point and end of
    each assistant text).
    """
    on_path = paths(messages)
    said = messages.select(
        F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "role", "text", "score"
    )
    full = on_path.join(said, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("m")))
    role, text = escape(F.col("role"), role=True), escape(F.col("text"))
    turn = F.struct(
        (-F.col("up")).alias("at"),
        F.concat(F.lit("<turn "), role, F.lit(">"), text, F.lit("</turn>\n")).alias("out"),
        F.length(role).alias("r"),
        F.length(text).alias("n"),
        (F.col("role") == LEARNED).alias("learned"),
    )
    one = full.groupBy("tree_id", "leaf").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.avg("score").alias("score")
    )
    if best is not None:
        w = Window.partitionBy("tree_id").orderBy(F.desc_nulls_last("score"), "leaf")
        one = one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= best)
    else:
        one = one.withColumn("rank", F.lit(None).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<first:bigint,end:bigint>>)").alias("spans"))

    def placed(state, t):
        first = state["at"] + _HEAD + t["r"]
        span = F.array(F.struct(first.alias("first"), (first + t["n"]).alias("end")))
        return F.struct(
            (first + t["n"] + _TAIL).alias("at"),
            F.when(t["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return one.select(
        "tree_id",
        "leaf",
        "rank",
        F.array_join(F.col("turns.out"), "").alias("formatted"),
        F.aggregate("turns", start, placed)["spans"].alias("loss_spans"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from formatted conversations."""
    roles = F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(1)), unescape)
    texts = F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(2)), unescape_text)
    lost = F.transform(
        "loss_spans",
        lambda s: unescape_text(F.substring(F.col("formatted"), (s["first"] + 1).cast("int"), (s["end"] - s["first"]).cast("int"))),
    )
    turns = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    loss = F.array_join("lost", "")
    return formatted.select(
        F.col("tree_id").alias("conv_id"), roles.alias("roles"), texts.alias("texts"), lost.alias("lost"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id",
        F.size("texts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: A conversation whose texts look like control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def with_probe(conversations_: DataFrame) -> DataFrame:
    """``conversations_`` and a conversation of two turns that say the probe text."""
    turn = F.col("id")
    probe = conversations_.sparkSession.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        turn.alias("turn"),
        F.when(turn == 0, "user").otherwise(LEARNED).alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return conversations_.select("conv_id", "turn", "role", "text").unionByName(probe)


#: The query op5 in SQL.
SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
              + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')))::bigint AS formatted_chars
FROM t GROUP BY conv_id
"""
