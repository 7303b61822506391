from __future__ import annotations

from quern.llm import preferences as P


def show(turns):
    return "".join(f"<|im_start|>{r}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in turns)


def mask(turns):
    at, out = 0, []
    for r, t in turns:
        begin = at + len(f"<|im_start|>{r}\n")
        at += len(show([(r, t)]))
        if r == "assistant":
            out.append(f"{begin}:{at}")
    return ",".join(out)


def plain(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return (n, show(a[:n]), show(a[n:]), show(b[n:]), mask(a[n:]), mask(b[n:]))


CASES = [
    ([("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")]),
    ([("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "yes")]),
    ([("user", "hi")], [("user", "hi"), ("assistant", "x"), ("user", "é<|im_end|>"), ("assistant", "日")]),
    ([("system", "s"), ("user", "a")], [("user", "a")]),
    ([], [("user", "a")]),
    ([], []),
    ([("user", "hi")], [("assistant", "hi")]),
]


def test_pairs_against_plain_version(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CASES)], f"id int, chosen {P.TURNS}, rejected {P.TURNS}").repartition(2)
    got = {r.id: tuple(r)[1:] for r in P.preference_pairs(df).collect()}
    assert got == {i: plain(a, b) for i, (a, b) in enumerate(CASES)}


def test_odd_turns(spark):
    rows = [(1, 0, "user", "q", 5), (1, 1, None, None, 5), (1, 1, None, None, 5), (2, 0, "user", "", 6), (2, None, "assistant", "early", 6), (None, 0, "user", "lost", 7), (4, 0, "assistant", "alone", 8)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chosen int").repartition(3)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in P.gather_turns(turns).collect()}
    assert got[1] == [("user", "q"), ("user", ""), ("user", "")]
    assert got[2] == [("assistant", "early"), ("user", "")]
    assert got[None] == [("user", "lost")]
    pairs = {r.conv_id: r for r in P.preference_pairs(P.swapped_replies(P.gather_turns(turns))).collect()}
    assert pairs[1].n_prompt_turns == 3 and pairs[1].chosen == "" == pairs[1].rejected
    assert pairs[2].n_prompt_turns == 1 and pairs[2].chosen == show([("user", "")]) and pairs[2].rejected == ""
    assert pairs[4].rejected == "" and pairs[4].chosen_mask == mask([("assistant", "alone")])
    assert len(pairs) == 4
    assert P.preference_pairs(P.swapped_replies(P.gather_turns(turns.where("false")))).collect() == []
    null = spark.createDataFrame([(1, None, None)], f"id int, chosen {P.TURNS}, rejected {P.TURNS}")
    assert tuple(P.preference_pairs(null).first())[1:] == (0, "", "", "", "", "")


def test_columns_named_as_results_and_marks_in_roles(spark):
    a, b = [("us<|er\nx", "q"), ("assistant", "a")], [("us<|er\nx", "q"), ("assistant", "b")]
    df = spark.createDataFrame([(1, a, b, "mine", 5, "m")], f"id int, chosen {P.TURNS}, rejected {P.TURNS}, prompt string, n_prompt_turns int, chosen_mask string")
    got = P.preference_pairs(df)
    assert got.columns == ["id", *P.RESULTS]
    want = plain(*([(r.replace("<|", "< |").replace("\n", " "), t) for r, t in x] for x in (a, b)))
    assert tuple(got.first())[1:] == want


def test_turns_without_a_conversation_are_their_own(spark):
    turns = spark.createDataFrame([(None, i, "user", f"t{i}") for i in range(20)], "conv_id long, turn long, role string, text string").repartition(3)
    got = P.gather_turns(turns).collect()
    assert len(got) == 20 and all(len(r.turns) == 1 for r in got)


def test_long_conversations_and_texts(spark):
    long = [("user" if i % 2 == 0 else "assistant", f"turn {i} é") for i in range(20_000)]
    wide = [("user", "q"), ("assistant", "日 <|x " * 200_000)]
    df = spark.createDataFrame([(0, long, long[:3] + [("assistant", "other")]), (1, wide, wide[:1])], f"id int, chosen {P.TURNS}, rejected {P.TURNS}")
    got = {r.id: tuple(r)[1:] for r in P.preference_pairs(df).collect()}
    assert got[0] == plain(long, long[:3] + [("assistant", "other")])
    assert got[1] == plain(wide, wide[:1])


def test_no_python_on_the_main_path(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    plan = P.preference_pairs(P.swapped_replies(P.gather_turns(turns)))._jdf.queryExecution().toString()
    assert "Python" not in plan.split("Physical Plan")[1].replace("PythonRDD", "") or "LogicalRDD" in plan
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan
