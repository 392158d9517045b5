import hashlib
import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscope.llm import chat
from tabscope.llm.chat import budgeted_windows, conversation_digests, read_loss, read_turns
from tabscope.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string"


def talks(seed=2):
    r = random.Random(seed)
    rows = []
    for conv in range(25):
        n = r.choice([1, 2, 5, 9, 60])
        for turn in range(n):
            role = "system" if turn == 0 and conv % 3 == 0 else ["user", "assistant"][turn % 2]
            words = r.choices(["plain", "é水", "x<|y", "<\\|", "<|im_end|>", "a.b", "\n", "\\", "😀", "<"], k=r.choice([0, 3, 40, 120]))
            rows.append((conv, turn, role, " ".join(words)))
    rows += [(90, 0, "assistant", None), (91, 0, None, "no role"), (92, 0, "system", "s " * 3000), (92, 1, "user", "u"), (92, 2, "assistant", "a " * 5000)]
    rows += [(93, 0, "odd\\n\nrole<|\\", "t"), (94, 5, "assistant", "b"), (94, 5, "assistant", "b"), (94, 5, "user", "a"), (None, None, "user", "n"), (None, 1, "assistant", "m")]
    return rows


def want(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("per_block, budget, history", [(256, 1024, 256), (3, 120, 40), (256, 50, 0)])
def test_read_back_equals_the_turns(spark, monkeypatch, per_block, budget, history):
    monkeypatch.setattr(chat, "TURNS_PER_BLOCK", per_block)
    rows = talks()
    windows = budgeted_windows(spark.createDataFrame(rows, SCHEMA), budget, history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in conversation_digests(windows).collect()}
    assert got == want(rows)


def test_windows_keep_the_budget_the_system_turn_and_history(spark):
    rows = [(1, 0, "system", "be kind")]
    rows += [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "w " * (i % 13)) for i in range(1, 200)]
    df = spark.createDataFrame(rows, SCHEMA)
    windows = budgeted_windows(df, 100, 30).select(
        "*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("said")
    ).orderBy("window").collect()
    texts = [t for *_, t in rows]
    seen = []
    for w in windows:
        assert w.n_tokens <= 100 and w.turns[0].role == "system"
        fresh = w.turns[w.n_repeated :]
        context = [t.text for t in w.turns[: w.n_repeated]]
        first = texts.index(fresh[0].text)
        if first:
            assert context[0] == "be kind"
            # The longest run of turns before the span within the history.
            tokens, run = 0, []
            for t in reversed(texts[1:first]):
                n = len(t.split()) + 4
                if tokens + n > 30:
                    break
                tokens, run = tokens + n, [t, *run]
            assert context[1:] == run
        assert w.said == [t.text for t in fresh if t.role == "assistant"]
        seen += [t.text for t in fresh]
    assert seen == texts and len(windows) > 10


@pytest.mark.parametrize("system, turn", [(704, 64), (513, 64), (900, 64), (1000, 20), (1020, 4), (40, 700), (300, 800), (1100, 30), (0, 64)])
def test_only_a_turn_beyond_it_breaks_the_budget(spark, system, turn):
    """Turns of one length, system turns between half the budget and beyond it."""
    rows = [(1, 0, "system", "s " * (system - 4))] if system else []
    rows += [(1, i, "user" if i % 2 else "assistant", "w " * (turn - 4 - i % 3)) for i in range(1, 41)]
    windows = budgeted_windows(spark.createDataFrame(rows, SCHEMA), 1024, 256).collect()
    over = [w for w in windows if w.n_tokens > 1024]
    if system + turn <= 1024:
        assert not over
    # What is over holds the system turn and one turn, or is the system turn; where that is beyond the budget
    # alone, spans are a quarter of it.
    most = 256 if system >= 1024 else turn
    assert all(w.n_repeated <= 1 and w.n_tokens <= system + most for w in over)
    assert sum(len(w.loss) for w in windows) == 20
    if system == 704:
        assert max(w.n_tokens for w in windows) > 900 and any(w.n_repeated > 1 for w in windows)


def test_query_equals_its_sql(spark, tmp_path):
    rows = [r for r in talks() if r[0] is not None and r[0] != 93]
    rows += [(200, i, "user" if i % 2 else "assistant", "word " * (i % 50)) for i in range(300)]
    for conv, words in ((201, 700), (202, 900), (203, 1018), (204, 1500)):
        rows += [(conv, 0, "system", "s " * words)] + [(conv, i, "assistant", "w " * (i % 90)) for i in range(1, 60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op4_chat_windows"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    asked = con.execute(SQL["op4_chat_windows"])
    names = [d[0] for d in asked.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(asked.fetchall())
    marks = got.filter("conv_id = -1").first()
    assert (marks.n_turns, marks.loss_chars) == (2, len("<|im_end|><|im_start|>assistant ok"))


ESCAPED = st.text(st.sampled_from("<|\\n>a\n"), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(ESCAPED, ESCAPED), min_size=1, max_size=40))
def test_escapes_are_reversible(spark, pairs):
    df = spark.createDataFrame(pairs, "role string, text string")
    safe = df.select(
        chat.unescape_role(chat.escape_role(F.col("role"))).alias("role"),
        chat.unescape(chat.escape(F.col("text"))).alias("text"),
        chat.escape(F.col("text")).alias("inside"),
        chat.escape_role(F.col("role")).alias("name"),
    ).collect()
    assert [(r.role, r.text) for r in safe] == pairs
    assert not any("<|" in r.inside or "<|" in r["name"] or "\n" in r["name"] for r in safe)


def test_empty_and_extra_columns(spark):
    assert conversation_digests(budgeted_windows(spark.createDataFrame([], SCHEMA))).collect() == []
    df = spark.createDataFrame([(1, 0, "assistant", "x", 5)], SCHEMA + ", tokens int")
    assert conversation_digests(budgeted_windows(df)).first().loss_chars == 1
