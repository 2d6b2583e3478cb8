"""Chat formatting against a sequential fold, the escape's round trip, and edges of logs."""

import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import chat

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[ROLE=tool]", "[", "<", "\\", "\\\\", "s>", "INST]", "a", "é😀", "\n", " "]
LOG = "conv_id long, seq long, kind string, message long, role string, text string"


def text(r, n=6):
    return "".join(r.choice(PIECES) for _ in range(r.randint(0, n)))


def conversation(r, conv):
    """Events of a conversation, and the messages that they leave, in order."""
    log, state, seq = [], {}, 0

    def add(kind, message, role=None, body=None):
        nonlocal seq
        seq += r.randint(1, 3)
        log.append((conv, seq, kind, message, role, body))

    for _ in range(r.randint(1, 25)):
        kind = r.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate"])
        if kind == "open" or not state:
            m = max(state, default=0) + r.randint(1, 2)
            state[m] = [r.choice(["user", "assistant", "system", "tool x]", ""]), text(r)]
            add("open", m, state[m][0], state[m][1])
            continue
        m, body = r.choice(sorted(state)), text(r)
        add(kind, m, None, body if kind != "regenerate" else None)
        if kind == "delta":
            state[m][1] += body
        elif kind == "edit":
            state[m][1] = body
        else:
            state[m][1] = ""
            for later in [k for k in state if k > m]:
                del state[later]
    return log, [state[m] for m in sorted(state)]


def test_fold_equals_a_sequential_one(spark):
    r, log, want = random.Random(12), [], {}
    for conv in range(120):
        events, messages = conversation(r, conv)
        log += events
        want[conv] = messages
    r.shuffle(log)
    out = {x["conv_id"]: x for x in chat.formatted(spark.createDataFrame(log, LOG).repartition(5)).withColumn("read", chat.turns(F.col("formatted"))).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(out) == set(want)
    for conv, messages in want.items():
        assert [list(t) for t in out[conv]["read"]] == messages
        assert out[conv]["loss"] == [b for role, b in messages if role == "assistant"]
        raw = out[conv]["formatted"].encode()
        assert all(raw[s["end"] :].startswith(b"</s>") for s in out[conv]["loss_spans"])
        assert out[conv]["formatted"].count("</s>") == len(messages)


def test_escape_round_trip(spark):
    r = random.Random(3)
    texts = [text(r, 14) for _ in range(3000)] + [p * k for p in PIECES for k in (1, 2, 3)] + ["<\\" * 2000 + "s>", "[ROLE=" * 3000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").withColumn("e", chat.escaped(F.col("t"))).withColumn("u", chat.unescaped(F.col("e"))).collect()
    for x in rows:
        assert x["u"] == x["t"]
        assert not any(c in x["e"] for c in ("</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[ROLE=tool]"))


def test_digests_of_replayed_turns(spark):
    table = [(1, 0, "user", "a\n</s>"), (1, 1, "assistant", "b" * 5000), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 1, "user", ""), (None, 0, "user", "no id"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 5, "assistant", "é" * 700)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit("clash"), "message": F.lit(1), "at": F.lit(2), "kind": F.lit(3), "formatted": F.lit(4)})
    rows = {x["conv_id"]: x for x in chat.digests(chat.formatted(chat.replayed(df))).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t, r or "", b or "") for c, t, r, b in table if c == conv))
        assert rows[conv]["n_turns"] == len(own)
        assert rows[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{b}\n" for _, r, b in own).encode()).hexdigest()
        loss = "".join(b for _, r, b in own if r == "assistant")
        assert (rows[conv]["loss_chars"], rows[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_replayed_logs_hold_edits_and_regenerations(spark):
    df = spark.createDataFrame([(k, t, "user" if t % 2 == 0 else "assistant", f"text {k} {t}") for k in range(40) for t in range(4)], "conv_id long, turn long, role string, text string")
    kinds = {x["kind"]: x["count"] for x in chat.replayed(df).groupBy("kind").count().collect()}
    assert min(kinds[k] for k in ("open", "delta", "edit", "regenerate")) > 0


def test_odd_events(spark):
    log = [
        (1, 5, "delta", 1, None, "late"), (1, 1, "delta", 1, "tool", "early "), (1, 2, "shout", 1, "user", "ignored"), (1, 3, "delta", None, "user", "ignored"),
        (2, 1, "open", 1, None, None), (2, 2, "open", 1, "user", "x"), (2, 2, "delta", 1, None, "y"), (2, 2, "delta", 1, None, "y"), (2, 2, "regenerate", 0, None, None),
    ]
    rows = {x["conv_id"]: (x["role"], x["text"]) for x in chat.folded(spark.createDataFrame(log, LOG)).filter("message = 1").collect()}
    assert rows == {1: ("tool", "early late"), 2: ("user", "yyx")}


def test_empty_log(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], LOG))).collect() == []
    assert chat.replayed(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.formatted(chat.replayed(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
