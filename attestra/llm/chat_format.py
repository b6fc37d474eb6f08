"""Operator 1, chat formatting: reply trees, best branch, one template.

Messages form reply trees. Every node's depth and the score of its path come from pointer doubling: in round k each
node joins the node 2**k steps above it, so a path of length n needs log2(n) self-joins. The leaves of a tree are
ranked by the mean score of their paths, and the chosen ones are walked back by the same jumps, one join a level.

Defined results: null text or role is empty; equal scores go to the smaller leaf id; a message whose parent is
absent (or null) is a root; a repeated message id keeps the smallest (role, text, score); messages with a null tree
id form one tree; each message with a null id is one of its own, which none can answer, with a null leaf_id, and comes
after others of equal score; messages on a cycle have no root and are left out; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import let, read_table, running, written


@dataclass(frozen=True)
class Template:
    """start role sep text end, for each turn. An escape character goes after the first character of any control
    string inside a role or text, and before itself, so that no control string is left there and unescape() gives
    the text back."""

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.sep, self.end, *self.others)

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        heads = "|".join(rf"\Q{c[0]}\E(?=\Q{c[1:]}\E)" for c in self.controls)
        return F.regexp_replace(out, f"({heads})", "$1\\\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\([\s\S])", "$1")


TEMPLATE = Template()


def _message_table(messages: DataFrame) -> DataFrame:
    """tree_id, msg_id and parent_id become structs, which are equal also where what they hold is null; msg_id's second
    field tells messages without an id apart, a parent's is null."""
    clean = messages.select(
        F.struct(F.col("tree_id").alias("id")).alias("tree_id"), "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"), "parent_id")
    one = F.min(F.struct("role", "text", "score", "parent_id"))
    known = clean.where("msg_id is not null").groupBy("tree_id", "msg_id").agg(one.alias("m")).select("tree_id", "msg_id", F.lit(None).cast("string").alias("own"), "m.*")
    said = F.sha2(F.to_json(F.struct("role", "text", "score", "parent_id")), 256)
    bare = clean.where("msg_id is null").withColumn("own", said)
    copy = F.row_number().over(Window.partitionBy("tree_id", "own").orderBy("own")).cast("string")
    bare = bare.withColumn("own", F.concat_ws(":", "own", copy))
    out = known.unionByName(bare.select(*known.columns))
    parent = F.when(F.col("parent_id").isNotNull(), F.struct(F.col("parent_id").cast(messages.schema["msg_id"].dataType).alias("id"), F.lit(None).cast("string").alias("own")))
    return out.select("tree_id", F.struct(F.col("msg_id").alias("id"), "own").alias("msg_id"), parent.alias("parent_id"), "role", "text", "score")


def chosen_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """messages (_message_table's columns) as (tree_id, leaf_id, rank, pos, msg_id): the root-to-leaf
    paths of the best leaves of each tree (all with best=None), pos from 0 at the root."""
    nodes = messages.select("tree_id", "msg_id", "parent_id", "score")
    ids = nodes.select("tree_id", F.col("msg_id").alias("parent_id"), F.lit(1).alias("known"))
    # up: the node 2**k above; steps, total: length and score of the stretch from the node up to, not including, it
    level = nodes.join(ids, ["tree_id", "parent_id"], "left").select(
        "tree_id", "msg_id", F.when(F.col("known").isNotNull(), F.col("parent_id")).alias("up"), F.lit(1).alias("steps"), F.col("score").cast("double").alias("total"))
    level = written(level, "chat-up")
    ended = level.where("up is null")
    open_rows = level.where("up is not null")
    jumps = [open_rows]
    left = open_rows.count()
    rounds = left.bit_length() + 1  # what doubling leaves after that hangs on a cycle
    while left and len(jumps) <= rounds:
        above = ended.unionByName(open_rows).select("tree_id", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        level = open_rows.join(above, ["tree_id", "up"]).select(
            "tree_id", "msg_id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("total") + F.col("total2")).alias("total"))
        level = written(level, "chat-up")
        ended = ended.unionByName(level.where("up is null"))
        open_rows = level.where("up is not null")
        jumps.append(open_rows)
        left = open_rows.count()
    parents = jumps[0].select("tree_id", F.col("up").alias("msg_id")).distinct()
    leaves = ended.join(parents, ["tree_id", "msg_id"], "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc(F.col("total") / F.col("steps")), F.asc_nulls_last("msg_id.id"), "msg_id.own")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    front = ranked.select("tree_id", F.col("msg_id").alias("leaf_id"), "rank", (F.col("steps") - 1).alias("pos"), "msg_id")
    for k in range(len(jumps) - 1, -1, -1):  # from far to near: each place on the path is reached once
        up = jumps[k].select("tree_id", "msg_id", "up")
        more = front.join(up, ["tree_id", "msg_id"]).select("tree_id", "leaf_id", "rank", (F.col("pos") - 2**k).alias("pos"), F.col("up").alias("msg_id"))
        front = written(front.unionByName(more), "chat-path") if k else front.unionByName(more)
    return front


def format_conversations(messages: DataFrame, best: int | None = 1, template: Template = TEMPLATE, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree_id, leaf_id, rank, formatted, spans): one row for each chosen path. spans has, for each turn, the code
    points [start, end) of its text in formatted and whether the loss covers it."""
    messages = _message_table(messages)
    paths = chosen_paths(messages, best)
    turns = paths.join(messages.select("tree_id", "msg_id", "role", "text"), ["tree_id", "msg_id"])
    head = F.concat(F.lit(template.start), template.escape(F.col("role")), F.lit(template.sep))
    turns = turns.select("tree_id", "leaf_id", "rank", "pos", F.col("role").isin(*loss_roles).alias("loss"), head.alias("head"), template.escape(F.col("text")).alias("body"))
    tail = len(template.end)
    before = Window.partitionBy("tree_id", "leaf_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + tail
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start)
    turn = F.struct("pos", F.concat("head", "body", F.lit(template.end)).alias("piece"), "start", (F.col("start") + F.length("body")).alias("end"), "loss")
    rows = turns.groupBy("tree_id", "leaf_id", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.select(
        F.col("tree_id.id").alias("tree_id"), F.col("leaf_id.id").alias("leaf_id"), "rank",
        F.concat_ws("", F.col("turns.piece")).alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["loss"].alias("loss"))).alias("spans"))


def parse_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    cut = F.split(formatted, rf"\Q{template.start}\E", -1)

    def turn(piece: Column) -> Column:
        parts = F.split(piece, rf"\Q{template.sep}\E", 2)
        body = parts[1]
        return F.struct(template.unescape(parts[0]).alias("role"), template.unescape(F.substring(body, F.lit(1), F.length(body) - len(template.end))).alias("text"))

    return let(cut, lambda pieces: F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn))


def masked_text(formatted: Column, spans: Column, template: Template = TEMPLATE) -> Column:
    """All text of a formatted conversation that its loss mask covers, unescaped, read by the mask's places. Each place is
    looked up in the turn that it lies in, so long conversations are not walked through anew for each."""

    def turns(pieces: Column) -> Column:
        after = running(F.transform(pieces, lambda p: F.length(p) + len(template.start)))  # where the next piece starts
        return F.zip_with(pieces, after, lambda p, n: F.struct(p.alias("piece"), (n - len(template.start) - F.length(p)).alias("at")))

    def read(turns: Column) -> Column:
        def text(span: Column, i: Column) -> Column:
            turn = F.get(turns, i + 1)
            return F.when(span["loss"], template.unescape(F.substring(turn["piece"], (span["start"] - turn["at"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")))).otherwise("")

        return F.concat_ws("", F.transform(spans, text))

    return let(let(F.split(formatted, rf"\Q{template.start}\E", -1), turns), read)


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -1, read back from their formatted text."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"select -1L conv_id, stack(2, 0L, 'user', '{PROBE}', 1L, 'assistant', '{PROBE}') as (turn, role, text)")
    rows = rows.unionByName(probe)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    chain = rows.withColumn("msg_id", F.row_number().over(order).cast("long"))
    chain = chain.select(F.col("conv_id").alias("tree_id"), "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))
    out = format_conversations(chain)
    out = out.withColumn("turns", parse_turns(F.col("formatted")))
    out = out.withColumn("loss", masked_text(F.col("formatted"), F.col("spans")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in TEMPLATE.controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP1_SQL = f"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), t as (
  select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    sum(length({_sql_escape("role")}) + length({_sql_escape("text")}) + {len(TEMPLATE.start + TEMPLATE.sep + TEMPLATE.end)}) as formatted_chars
  from r group by conv_id)
select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars from t
"""
