"""Chat formatting: finished messages folded from event logs, rendered by a template, and read back, in DataFrame functions only.

A log has one row an event: (conv_id, seq, kind, message, role, text). ``message``
numbers the messages of a conversation in the order in which they are opened.
Kinds:

* ``open`` begins a message of a role, with the text it has at once;
* ``delta`` appends to a message;
* ``edit`` replaces a message's text, later deltas append to the new one;
* ``regenerate`` takes a message's text back and all messages opened after it.

The log is dealt out by conversation and sorted by sequence: an event is void if a
later regeneration names a smaller message, and a message's text is what follows
its last edit or regeneration. Nothing else decides, so the order in which rows
arrive does not matter. Events of one sequence number do not void each other;
those of one message are taken in order of kind, role and text.

The template writes ``<s>``, then for each message its mark, its text and
``</s>``. Inside texts one backslash is put into every control string, behind its
first character; a string that has backslashes there already gets one more, so
taking one out again gives the text back, whatever it holds. Control strings never
reach over a text's end, as none has ``<`` or ``[`` but at its start.

The loss mask is spans of bytes of the UTF-8 output: the texts of the loss roles,
without marks. Byte offsets, as code points could be cut out of long outputs only
by counting from their start each time.

Null texts and roles are empty; a message without an ``open`` event has the first
role that an event of it names; events without a message, or of another kind, are
ignored; a null conversation is one of its own. Repeated ``open`` or ``delta``
rows are repeated text, as two equal tokens in a stream are. An empty log gives no
rows. A conversation is one row of output, so it must fit into one (2 GB); on the
way there its events lie in one partition, in sorts that spill. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<s>", "</s>"
MARKS = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
LOSS = ("assistant",)
#: Characters of a delta in ``replayed`` logs.
DELTA = 256

_ROLE = r"[A-Za-z0-9.*_+%-]*"  # what url_encode leaves
REST = rf"/?s>|/?INST\]|SYS\]|ROLE={_ROLE}\]"
_MARK = rf"^\[(?:SYS|/?INST|ROLE={_ROLE})\]"


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({REST})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({REST})", "$1$2$3")


def mark(role: Column) -> Column:
    out = F.concat(F.lit("[ROLE="), F.url_encode(role), F.lit("]"))
    for name, sign in MARKS.items():
        out = F.when(role == name, sign).otherwise(out)
    return out


def _role(sign: Column) -> Column:
    out = F.url_decode(F.regexp_extract(sign, rf"^\[ROLE=({_ROLE})\]$", 1))
    for name, known in MARKS.items():
        out = F.when(sign == known, name).otherwise(out)
    return out


def folded(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the messages that a log leaves."""
    known = log.select("conv_id", "seq", "kind", "message", "role", "text").filter(F.col("kind").isin("open", "delta", "edit", "regenerate") & F.col("message").isNotNull())
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    live = known.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later)).filter("cut IS NULL OR message <= cut")
    events = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", _text("text").alias("text"))))
    told = live.groupBy("conv_id", "message").agg(events.alias("events"))
    reset = F.array_max(F.transform(F.filter("events", lambda e: e["kind"].isin("edit", "regenerate")), lambda e: e["seq"]))
    opened = F.filter("events", lambda e: (e["kind"] == "open") & e["role"].isNotNull())
    named = F.filter("events", lambda e: e["role"].isNotNull())
    kept = F.filter("events", lambda e: F.col("reset").isNull() | (e["seq"] > F.col("reset")) | ((e["seq"] == F.col("reset")) & (e["kind"] == "edit")))
    out = told.withColumn("reset", reset).withColumn("role", _text(F.coalesce(F.get(opened, 0)["role"], F.get(named, 0)["role"])))
    return out.select("conv_id", "message", "role", F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))


def rendered(messages: DataFrame, loss: tuple[str, ...] = LOSS) -> DataFrame:
    """(conv_id, formatted, loss_spans) of messages; spans are (start, end) in bytes, from 0."""
    pieces = messages.select("conv_id", "message", _text("role").alias("role"), mark(_text("role")).alias("mark"), escaped(_text("text")).alias("body"))
    size = F.octet_length("mark") + F.octet_length("body") + len(END)
    by = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("end", F.sum(size.cast("long")).over(by) + (len(START) - len(END)))
    piece = F.struct("message", "mark", "body", F.col("role").isin(*loss).alias("loss"), (F.col("end") - F.octet_length("body")).alias("start"), "end")
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    text = F.concat(F.lit(START), F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"], F.lit(END))), ""))
    spans = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return whole.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def turns(formatted: Column) -> Column:
    """The (role, text) of each message, read back from an output."""
    parts = F.split(F.substr(formatted, F.lit(len(START) + 1)), END)

    def one(part: Column) -> Column:
        sign = F.regexp_extract(part, _MARK, 0)
        return F.struct(_role(sign).alias("role"), unescaped(F.substr(part, F.length(sign) + 1)).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), one)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    raw = formatted.cast("binary")
    return F.transform(spans, lambda s: unescaped(F.substr(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string")))


def digests(outputs: DataFrame) -> DataFrame:
    """Figures of each output, read back from it: number and sha256 of its turns, length and sha256 of what is under the loss mask."""
    read = outputs.withColumn("turns", turns(F.col("formatted"))).withColumn("loss", F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(body, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def replayed(table: DataFrame, delta: int = DELTA) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as the log of a server that streamed them.

    Every text comes in deltas. One user text in two is posted with a slip and
    then edited; of one answer in four a draft comes first, is read and answered,
    and is then regenerated, so that the answer to it goes too. Equal turn numbers
    are taken in order of role and text.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table.select("conv_id", F.row_number().over(by).alias("at"), _text("role").alias("role"), _text("text").alias("text"))
    own = F.col("at").cast("long") * 2
    event = lambda kind, text, message=own, role=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), message.alias("message"), role.alias("role"), text.alias("text"))
    empty = F.lit("")
    parts = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{delta}}}"), F.lit(0))
    deltas = F.transform(parts, lambda p: event("delta", p))
    slip = F.reverse(_text(F.get(parts, 0)))
    chance = F.pmod(F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("at").cast("string"))), F.lit(4))
    edited = F.concat(F.array(event("open", empty, role=F.col("role")), event("delta", slip), event("edit", empty)), deltas)
    drafted = [event("open", slip, role=F.col("role")), event("open", empty, own + 1, F.lit("user")), event("delta", slip, own + 1), event("regenerate", empty)]
    plain = F.concat(F.array(event("open", empty, role=F.col("role"))), deltas)
    events = F.when((F.col("role") == "user") & (chance < 2), edited).when((F.col("role") == "assistant") & (chance == 0), F.concat(F.array(*drafted), deltas)).otherwise(plain)
    out = rows.select("conv_id", "at", F.posexplode(events).alias("k", "e"))
    return out.select("conv_id", F.expr("shiftleft(CAST(at AS BIGINT), 32) + k").alias("seq"), "e.*")


def formatted(log: DataFrame, loss: tuple[str, ...] = LOSS) -> DataFrame:
    """(conv_id, formatted, loss_spans) of the conversations of a log."""
    return rendered(folded(log), loss)
