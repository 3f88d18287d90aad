import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sectorlake.llm import chat_format, queries

ROWS = "conv_id bigint, turn bigint, role string, text string, n_turns int, segments string"
nasty = st.text(st.sampled_from(list("<|>\\endsy[/]INST \n$1日")), max_size=30)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "<|end|>\n"])), st.one_of(st.none(), nasty)), max_size=20))
def test_round_trip(spark, rows):
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    made = chat_format.format_conversations(spark.createDataFrame([(*r, 1, "s") for r in rows], ROWS))
    got = {r["conv_id"]: r for r in made.select("conv_id", "n_turns", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    want = {}
    for c, _, r, x in sorted(rows, key=lambda r: (r[0], r[1])):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    assert all(r["loss"] == "".join(x for role, x in want[c] if role == "assistant") for c, r in got.items())


def test_states(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "user", "u"), (3, 0, "assistant", "a"), (4, 0, "tool", None), (None, 0, "user", "u"), (5, 1, "user", "x"), (5, 1, "user", "x")]
    made = chat_format.format_conversations(spark.createDataFrame([(*r, 1, "s") for r in rows], ROWS))
    got = {r["conv_id"]: (r["valid"], r["first_bad_turn"], r["n_turns"]) for r in made.collect()}
    assert got == {1: (True, None, 3), 2: (False, 1, 2), 3: (False, 0, 1), 4: (False, 0, 1), None: (True, None, 1), 5: (False, 1, 2)}


def test_query_adds_the_control_conversation(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (got,) = queries.op10_chat_format(spark, str(tmp_path)).collect()
    text = queries.CONTROL_TURN
    assert got["conv_id"] == -1 and got["n_turns"] == 2 and got["loss_chars"] == len(text)
    assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
