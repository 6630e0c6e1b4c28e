"""Chat formatting: logs of conversations folded into their final messages, rendered by a template, and read back.

A log has a row for each event of a conversation, ordered by seq:

    message     a message begins (role, and text if it is whole already)
    delta       its text goes on
    edit        its text is the given one from here on
    regenerate  its text begins anew, and the messages that began after it, up to here, go
    remove      it goes

Events are dealt by conversation and message and folded in order of seq: a message's text is what came from its last
message, edit or regenerate event on. Which messages a regenerate event takes away is told by a running greatest over the
conversation, in order of the messages' beginnings. It and the messages' numbers run over blocks of seq, so that a
conversation of any length is dealt over tasks; only whole texts of one message, and PART messages in one row, lie together.

Rendered, a turn stands between its role's marks. A control string (a mark) in a text or role gets a backslash before it,
and one that is taken away again, so backslashes of the text stay as they are and marks are the control strings with
none before. The loss mask is a list of spans: where in the row the assistant's texts stand, escaped.

Null text, role or kind: empty, empty and message. A null conversation is one of its own. Events of equal seq, repeated
rows too, are taken in order of kind, message and text, and a row that repeats "message" begins its message once. Events
of a message that never begins are left out, as is a conversation whose messages all go. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotmere.llm.shared import saved, workspace

#: What a turn of each role begins and ends with; other roles' turns name the role in their first line.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<role>", "</role>")
CONTROL = [m for pair in (*MARKS.values(), OTHER) for m in pair]
#: Numbers of seq that are folded together; messages of a row of the output, at most.
BLOCK, PART = 1024, 256

_ANY = "|".join(re.escape(m) for m in CONTROL)
_RESETS = ("message", "edit", "regenerate")


# ---------------------------------------------------------------- the fold


def events(conversations: DataFrame) -> DataFrame:
    """Each row of (conv_id, turn, role, text) as an event that begins a message. Rows that are equal, or share their turn, begin one each."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("seq"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.groupBy("conv_id", "seq", "role", "text").agg(F.count(F.lit(1)).alias("many"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "many")))
    return rows.select("conv_id", "seq", F.lit("message").alias("kind"), F.concat_ws(" ", F.coalesce(F.col("seq").cast("string"), F.lit("-")), "role", F.sha2("text", 256), F.lpad(F.col("copy").cast("string"), 12, "0")).alias("message"), "role", "text")


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, number long from 1, message, role, text) from events (conv_id, seq long, kind, message, role, text); numbers may skip."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    event = log.select("conv_id", "seq", kind.alias("kind"), F.coalesce("message", F.lit("")).alias("message"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.struct("seq", "kind", "text")))
    begins = F.when(F.col("kind") == "message", F.struct("seq", F.coalesce("role", F.lit("")).alias("role")))
    grouped = event.groupBy("conv_id", "message").agg(
        F.min(begins).alias("begins"), at(*_RESETS).alias("reset"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("cut"),
        F.max(F.col("kind") == "remove").alias("removed"), F.collect_list(F.when(F.col("kind").isin(*_RESETS, "delta"), F.struct("seq", "kind", "text"))).alias("log"),
    )
    left = F.array_sort(F.filter("log", lambda e: (e >= F.col("reset"))))
    text = F.array_join(F.transform(left, lambda e: F.when((e["kind"] == "message") & (e > F.col("reset")), "").otherwise(e["text"])), "")
    found = grouped.filter("begins is not null").select("conv_id", "message", F.col("begins.seq").alias("seq"), F.col("begins.role").alias("role"), "cut", "removed", text.alias("text"))
    found = found.withColumn("block", F.floor(F.col("seq") / BLOCK))
    # the greatest cut of all messages that began before, and how many they are: over blocks, then within a block
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("conv_id", "block").agg(F.max("cut").alias("c"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.select(F.col("conv_id").alias("conv"), F.col("block").alias("in_block"), F.max("c").over(before).alias("cut_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    found = found.join(blocks, F.col("conv_id").eqNullSafe(F.col("conv")) & F.col("block").eqNullSafe(F.col("in_block")))
    inside = Window.partitionBy("conv_id", "block").orderBy("seq", "message")
    earlier = Window.partitionBy("conv_id", "block").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("number", F.col("n_before") + F.row_number().over(inside)).withColumn("gone", F.greatest("cut_before", F.max("cut").over(earlier)) > F.col("seq"))
    return found.filter(~F.coalesce("gone", F.lit(False)) & ~F.col("removed")).select("conv_id", "number", "message", "role", "text")


# ---------------------------------------------------------------- rendering


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"({_ANY})", r"\\$1")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, part long, formatted, loss array of (start, length)): up to PART turns a row, characters counted from 0."""
    role, pairs = F.col("role"), [(F.lit(r), *map(F.lit, marks)) for r, marks in MARKS.items()]
    pick = lambda i, other: F.coalesce(*(F.when(role == p[0], p[i]) for p in pairs), F.lit(other))
    known = role.isin(*MARKS)
    line = F.regexp_replace(F.regexp_replace(escaped(role), "&", "&amp;"), "\n", "&#10;")
    head = F.concat(pick(1, OTHER[0]), F.lit(" "), F.when(known, "").otherwise(F.concat(line, F.lit("\n"))))
    body = escaped(F.col("text"))
    turn = F.struct("number", head.alias("head"), body.alias("body"), F.concat(F.lit(" "), pick(2, OTHER[1]), F.lit("\n")).alias("tail"), (role == "assistant").alias("trained"))
    turns = messages.select("conv_id", F.floor((F.col("number") - 1) / PART).alias("part"), turn.alias("t")).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("t"))
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + F.length(t["tail"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def step(so_far, t):
        span = F.struct((so_far["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))
        return F.struct((so_far["at"] + size(t)).alias("at"), F.when(t["trained"], F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"]).alias("spans"))

    loss = F.aggregate("t", start, step)["spans"]
    return turns.select("conv_id", "part", F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], t["tail"])), "").alias("formatted"), loss.alias("loss"))


# ---------------------------------------------------------------- reading back

_TURN = re.compile("|".join(f"{re.escape(a)} (?P<t{i}>(?s:.*?)) {re.escape(b)}\n" for i, (a, b) in enumerate((*MARKS.values(), OTHER))))
_ESCAPED = re.compile(rf"\\({_ANY})")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a row's text."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        text, at = m[m.lastgroup], m.end()
        role = [*MARKS, None][int(m.lastgroup[1:])]
        if role is None:
            line, _, text = text.partition("\n")
            role = unescaped(line.replace("&#10;", "\n").replace("&amp;", "&"))
        yield role, unescaped(text)


def digests(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from what render returns.

    A conversation's rows come to one task in order, as a digest needs them, and are read one at a time.
    """

    class State:
        def __init__(self, conv):
            self.conv, self.turns, self.chars, self.size = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, formatted, loss):
            for role, text in parsed(formatted):
                self.turns += 1
                self.all.update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescaped(formatted[span["start"] : span["start"] + span["length"]])
                self.chars += len(text)
                self.loss.update(text.encode())
            self.size += len(formatted)

        def row(self):
            return self.conv, self.turns, self.all.hexdigest(), self.chars, self.loss.hexdigest(), self.size

    kind = rendered.schema["conv_id"].dataType.simpleString()

    def read(batches):
        state, done, arrow = None, [], None
        for batch in batches:
            arrow = batch.column(0).type
            for conv, formatted, loss in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or conv != state.conv:
                    done += [state.row()] if state else []
                    state = State(conv)
                state.add(formatted, loss)
            if len(done) >= 5000:
                yield out(done, arrow)
                done = []
        if state:
            yield out([*done, state.row()], arrow)

    def out(rows, arrow):
        kinds = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    dealt = rendered.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations and of one, -7, whose texts are control strings: folded, rendered to a file, read back."""
    spark = conversations.sparkSession
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    both = conversations.select("conv_id", "turn", "role", "text").union(planted)
    return digests(saved(render(fold(events(both))), f"{workspace(spark, 'chat')}/rendered"))
