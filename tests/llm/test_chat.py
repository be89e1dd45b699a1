import random
from collections import defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera.llm import chat as C

SCHEMA = "conv_id bigint, turn int, role string, text string"
BITS = ["[INST]", "[/INST]", "</s>", "<s>", "[ROLE]", "[AS] ", "[/ROLE]", "[OUT] ", "\\", "<", "[", "[\\INST]", "<\\\\/s>", "s>", " ", "\n", "é", "😀", "$1", "word", ""]
RULES = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def conversations(rows):
    by = defaultdict(list)
    for n, (conv, turn, role, text) in enumerate(rows):
        by[conv if conv is not None else ("alone", n)].append(((turn is not None, turn or 0), role or "", text or ""))
    return [sorted(turns) for turns in by.values()]


def judged(turns):
    before = None
    for n, (_, role, _) in enumerate(turns):
        if role not in RULES.get(before, set()):
            return n
        before = role
    return None


@pytest.mark.parametrize("seed", range(3))
def test_formatted_text_reads_back_exactly(spark, seed):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool[/ROLE]", "[AS] x", "", None]
    rows = [(i % 70 if i % 9 else None, rng.choice([0, 1, 2, 3, None]), rng.choice(roles), rng.choice([None, "".join(rng.choices(BITS, k=rng.randint(0, 9)))])) for i in range(500)]
    made = C.render(spark.createDataFrame(rows, SCHEMA))
    found = made.select("formatted", "segments", "broken_turn", "valid", C.read_turns(F.col("formatted")).alias("turns"), C.loss_text(F.col("segments")).alias("learned")).collect()
    key = lambda turns, learned, broken: (turns, learned, -1 if broken is None else broken)
    got = sorted(key([(t["role"], t["text"]) for t in r["turns"]], r["learned"], r["broken_turn"]) for r in found)
    want = sorted(key([t[1:] for t in turns], "".join(t[2] for t in turns if t[1] == "assistant"), judged(turns)) for turns in conversations(rows))
    assert got == want
    for r in found:
        assert r["valid"] == (r["broken_turn"] is None) and r["formatted"] == "".join(s["text"] for s in r["segments"])
        for s in r["segments"][2::3]:  # bodies; a foreign role's holds one string of its own between name and text
            assert sum(s["text"].count(c) for c in C.INSTRUCT.controls) <= 1 and not any(c in s["text"] for c in C.INSTRUCT.controls if c != "[AS]")


def test_states(spark):
    talks = ["su", "sua", "ua", "uau", "uaua", "a", "us", "ss", "uu", "s", "uaa", "suasu", "x"]
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(i, n, names[c], "t") for i, talk in enumerate(talks) for n, c in enumerate(talk)]
    found = {talks[r["id"]]: (r["valid"], r["complete"], r["broken_turn"]) for r in C.render(spark.createDataFrame(rows, SCHEMA)).collect()}
    good, done = (True, False, None), (True, True, None)
    assert found == {
        "su": good, "sua": done, "ua": done, "uau": good, "uaua": done, "s": good, "a": (False, False, 0), "x": (False, False, 0), "us": (False, False, 1), "ss": (False, False, 1),
        "uu": (False, False, 1), "uaa": (False, False, 2), "suasu": (False, False, 3),
    }


def test_loss_flags_and_marks(spark):
    rows = [(1, 0, "user", "hi [/INST]"), (1, 1, "assistant", "yes</s>"), (1, 2, "tool", None)]
    (r,) = C.render(spark.createDataFrame(rows, SCHEMA)).collect()
    assert r["formatted"] == "<s>[INST] hi [\\/INST] [/INST][OUT] yes<\\/s></s>[ROLE]tool[AS]  [/ROLE]"
    assert [s["text"] for s in r["segments"] if s["loss"]] == ["yes<\\/s>"]


def test_edge_rows_and_foreign_columns(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 0, "user", "a"), (None, 0, "user", "a"), (2, None, "user", "x" * 300_000), (2, 1, "assistant", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "formatted": F.lit("f"), "segments": F.lit(0), "t": F.lit(1), "alone": F.lit(2)})
    found = C.render(df).select("id", F.size(C.read_turns(F.col("formatted"))).alias("n"), "complete").collect()
    assert sorted(((r["id"] or 0, r["n"], r["complete"]) for r in found)) == [(0, 1, False), (0, 1, False), (1, 2, False), (2, 2, True)]
    assert C.render(df.limit(0)).collect() == []


def test_own_template(spark):
    own = C.Template("", {"q": C.Mark("<ask> ", "</ask>"), "a": C.Mark("<say> ", "</say>", True)}, ("<who>", "<did> ", "</who>"), "0", {"0": {"q": "1"}, "1": {"a": "0"}}, frozenset({"0"}))
    (r,) = C.render(spark.createDataFrame([(1, 0, "q", "<say>"), (1, 1, "a", "</ask>")], SCHEMA), own).collect()
    assert r["formatted"] == "<ask> <\\say></ask><say> <\\/ask></say>" and r["complete"]


@pytest.mark.parametrize("marks", [("[INST]x", " [/INST]"), ("INST ", "[/INST]"), ("[A][B]", "[/INST]"), ("[ROLE]", "[/INST]"), ("[/ROLE]", "[C]")])
def test_ambiguous_templates_are_refused(marks):
    with pytest.raises(ValueError):
        C.Template("<s>", {"user": C.Mark(*marks)}, ("[ROLE]", "[AS] ", " [/ROLE]"), "a", {"a": {}}, frozenset())


def test_query_is_native_and_holds_the_hostile_conversation(spark):
    df = C.query(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    hostile = {r["conv_id"]: r for r in df.collect()}[-1]
    assert (hostile["n_turns"], hostile["loss_chars"], hostile["complete"]) == (2, len(C.HOSTILE), True)
