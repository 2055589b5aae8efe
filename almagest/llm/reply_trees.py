"""Chat formatting from reply trees.

Messages form trees by parent. Rounds of self-joins, over ids, parents and scores alone,
climb from every message to its root; a path ends where a message has no reply. Paths of a
tree are ranked by their score (the sum over their messages), and the best `per_tree` get
their members by the same joins downwards and are formatted, each as one conversation.

Template. A turn is `[INST] text [/INST]` for a user, `text</s>` after `<s>` for an
assistant, `<<SYS>>text<</SYS>>` for a system, and `<<ROLE>>name<</ROLE>>text<</SYS>>` for
any other role. Texts and names are escaped so that no control string can appear in them:
backslashes are doubled, and a backslash goes after the first character of every control
string. Undoing is one rule: a backslash goes and the character after it stays. The loss
mask is the list of stretches (code points) of assistant texts.

Defined cases. A null text or role is an empty one. Messages that are repeated in full
count once; messages whose parent is missing, null or themselves are roots, and messages
in a cycle have no root and are not reached. Ties of the score go to the smaller leaf id.
Conversations by turn are trees without branches: the order is turn, role, text, and
repeated turns all stay. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from almagest.llm.common import settled

# fixed control strings of the template
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
_CONTROL_RE = "(" + "|".join(re.escape(c) for c in CONTROL) + ")"
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|<<SYS>>(?P<system>.*?)<</SYS>>"
    r"|<<ROLE>>(?P<role>.*?)<</ROLE>>(?P<other>.*?)<</SYS>>",
    re.DOTALL,
)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(?=" + _CONTROL_RE + r")(.)", r"$2\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a formatted conversation."""
    out = []
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        kind = next(k for k in ("user", "assistant", "system", "other") if m[k] is not None)
        role = unescape(m["role"]) if kind == "other" else kind
        out.append((role, unescape(m[kind]), m.start(kind), m.end(kind)))
    if at != len(text):
        raise ValueError(f"no turn at {at}")
    return out


def by_turn(conversations: DataFrame) -> DataFrame:
    """Messages (conv_id, msg, parent, role, text, score) of conversations in turns.

    The number of a turn in its conversation is its message id, the one before its parent.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("msg", F.row_number().over(order).cast("long") - 1)
    return numbered.select(
        "conv_id", "msg", F.when(F.col("msg") > 0, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def _once(messages: DataFrame, *fields: str) -> DataFrame:
    """(conv_id, msg, one): the row that counts of those with one id.

    That of the highest score (null: 0), then of the smallest parent (null first), role and
    text. `fields` is a beginning of minus (the negative score), parent, role, text; fewer of
    them choose the same row, as what they leave out only decides between rows equal so far.
    """
    values = {
        "minus": -F.coalesce("score", F.lit(0.0)),
        "parent": F.col("parent"),
        "role": F.coalesce("role", F.lit("")),
        "text": F.coalesce("text", F.lit("")),
    }
    return messages.groupBy("conv_id", "msg").agg(F.min(F.struct(*[values[f].alias(f) for f in fields])).alias("one"))


def _climbed(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves (conv_id, msg, score, depth) with the sums of their paths, and the jumps.

    Table k of the jumps holds (conv_id, msg, up) for the messages with an ancestor 2**k
    replies above. A message starts as a stretch of itself that hangs on its parent; every
    round joins the stretches that have not reached their root with those they hang on, so
    their length doubles. Rows are of fixed size, and there are as many as messages.

    Of the stretches that can still reach a root, one is a single reply longer than the
    round's length, as all its ancestors are messages too: a round that brings none to its
    root leaves only messages in cycles or below them, and they are dropped.
    """
    ids = settled(_once(messages, "minus", "parent").select("conv_id", "msg", "one.parent", (-F.col("one.minus")).alias("score")), "tree-ids")
    known = ids.select(F.col("conv_id").alias("k_conv"), F.col("msg").alias("k_msg"))
    there = F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("parent") == F.col("k_msg"))
    up = F.when(F.col("k_msg").isNotNull() & (F.col("parent") != F.col("msg")), F.col("parent"))
    first = ids.join(known, there, "left").select("conv_id", "msg", "score", up.alias("up"), F.lit(1).cast("long").alias("depth"))
    first = settled(first, "tree-steps")
    # a stretch that has reached its root waits in `whole`; only the others are joined again
    whole, state = first.where("up IS NULL"), first.where("up IS NOT NULL")
    parents = state.select(F.col("conv_id").alias("p_conv"), F.col("up").alias("p_msg")).distinct()
    jumps = []
    while not state.isEmpty():
        jumps.append(state.select("conv_id", "msg", "up"))
        top = whole.unionByName(state).select(
            F.col("conv_id").alias("t_conv"), F.col("msg").alias("t_msg"), F.col("up").alias("t_up"), F.col("score").alias("t_score"), F.col("depth").alias("t_depth")
        )
        longer = settled(
            state.join(top, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("up") == F.col("t_msg"))).select(
                "conv_id", "msg", (F.col("score") + F.col("t_score")).alias("score"), F.col("t_up").alias("up"), (F.col("depth") + F.col("t_depth")).alias("depth")
            ),
            "tree-stretches",
        )
        arrived = longer.where("up IS NULL")
        if arrived.isEmpty():
            break
        whole, state = whole.unionByName(arrived), longer.where("up IS NOT NULL")
    leaves = whole.join(parents, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("msg") == F.col("p_msg")), "left_anti")
    return leaves.select("conv_id", "msg", "score", "depth"), jumps


def steps(messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, score, pos, msg): the messages of ranked root-to-leaf paths.

    Rounds of self-joins over ids, parents and scores alone. They first climb from every
    message to its root, then descend from the chosen leaves only: with the longest jumps
    first, every listed message adds the one that its jump leads to, so that each ancestor
    is listed once and the rows joined are at most twice the rows listed.
    """
    leaves, jumps = _climbed(messages)
    order = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "msg")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if per_tree is not None:
        ranked = ranked.where(F.col("rank") <= per_tree)
    listed = settled(ranked.select("conv_id", F.col("msg").alias("leaf"), "rank", "score", (F.col("depth") - 1).alias("pos"), "msg"), "tree-leaves")
    for k, jump in reversed(list(enumerate(jumps))):
        to = jump.select(F.col("conv_id").alias("j_conv"), F.col("msg").alias("j_msg"), "up")
        met = listed.join(to, F.col("conv_id").eqNullSafe(F.col("j_conv")) & (F.col("msg") == F.col("j_msg")))
        added = met.select("conv_id", "leaf", "rank", "score", (F.col("pos") - (1 << k)).alias("pos"), F.col("up").alias("msg"))
        listed = listed.unionByName(settled(added, "tree-members"))
    return listed


def paths(messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, score, path): root-to-leaf paths, ranked within their conversation."""
    members = F.array_sort(F.collect_list(F.struct("pos", "msg")))["msg"]
    return steps(messages, per_tree).groupBy("conv_id", "leaf", "rank", "score").agg(members.alias("path"))


def formatted(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, leaf, rank, text, loss): one formatted text per path, with its loss mask.

    `chosen` are rows of `steps`, or of `paths`.
    """
    if "path" in chosen.columns:
        chosen = chosen.select("conv_id", "leaf", "rank", F.posexplode("path").alias("pos", "msg"))
    members = chosen.select(F.col("conv_id").alias("s_conv"), "leaf", "rank", "pos", F.col("msg").alias("s_msg"))
    once = _once(messages, "minus", "parent", "role", "text").select("conv_id", "msg", "one.role", "one.text")
    turns = members.join(once, F.col("s_conv").eqNullSafe(F.col("conv_id")) & (F.col("s_msg") == F.col("msg")))
    role = F.coalesce("role", F.lit(""))
    body = escape(F.coalesce("text", F.lit("")))
    before = (
        F.when(role == "user", "[INST] ").when(role == "assistant", "<s>").when(role == "system", "<<SYS>>")
        .otherwise(F.concat(F.lit("<<ROLE>>"), escape(role), F.lit("<</ROLE>>")))
    )
    after = F.when(role == "user", " [/INST]").when(role == "assistant", "</s>").otherwise("<</SYS>>")
    parts = turns.select("conv_id", "leaf", "rank", "pos", (role == "assistant").alias("learn"), before.alias("before"), body.alias("body"), after.alias("after"))
    turn = F.struct("pos", "learn", "before", "body", "after")
    whole = parts.groupBy("conv_id", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["before"], t["body"], t["after"])), "")

    def sizes(t: Column) -> Column:
        a = F.char_length(t["before"]).cast("long")
        b = F.char_length(t["body"]).cast("long")
        return F.struct(t["learn"].alias("learn"), a.alias("a"), b.alias("b"), (a + b + F.char_length(t["after"])).alias("all"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + t["a"]).alias("start"), (acc["at"] + t["a"] + t["b"]).alias("end"))
        spans = F.when(t["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + t["all"]).alias("at"), spans.alias("spans"))

    loss = F.aggregate(F.transform("turns", sizes), start, add, lambda acc: acc["spans"])
    return whole.select("conv_id", "leaf", "rank", text.alias("text"), loss.alias("loss"))


def read_back(written: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from their text and loss mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                values = (
                    len(turns),
                    hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode()).hexdigest(),
                    len(learned),
                    hashlib.sha256(learned.encode()).hexdigest(),
                    len(text),
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    rows = written.select(F.col("conv_id").cast("long").alias("conv_id"), "text", "loss")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_SQL_SIZE = (
    r"length(regexp_replace(replace({0}, '\', '\\'), '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>)', '#\1', 'g'))"
)
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_SQL_SIZE.format("text")} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
    ELSE 25 + {_SQL_SIZE.format("role")} END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
