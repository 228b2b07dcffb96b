from spanwright.llm.defects import SuffixAutomaton, defect, defects, language, refuses, unclosed

Q = "How do I move the visit #393 to 14:13?"
OK = "Open the visit #393 in the planner and choose the slot at 14:13."


def test_suffix_automaton_against_brute_force():
    import random

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randrange(12))] for _ in range(2))
        subs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        for least in (1, 3):
            hit = {k for i in range(len(b)) for j in range(i + least, len(b) + 1) if tuple(b[i:j]) in subs for k in range(i, j)}
            assert SuffixAutomaton(a).covered(b, least) == len(hit)


def test_each_defect():
    assert defect(Q, OK, None) is None
    for a in (None, "", " \n", "​", " ", "N/A", "<empty>", '""', "-", "...", "[]", "None"):
        assert defect(Q, a, OK) == "empty_answer", repr(a)
    for a in ("I'm sorry, but I can’t help with that request.", "Leider muss ich das ablehnen.", "Malheureusement, je ne peux pas vous aider.", "Lo siento, pero debo rechazar esta petición."):
        assert defect(Q, a, OK) == "refusal" and defect(Q, a, a) is None or language(a) != "en"
    assert defect("Can #1 be stopped?", "Parcel #1 cannot be stopped, sorry about that.", None) is None
    for a in (Q, "> " + Q, Q.upper(), "You asked: " + Q, Q + "\n" + Q, "How  do I move the visit #393 to 14:13 ??"):
        assert defect(Q, a, OK) == "copied_question", a
    assert defect(Q, Q + " " + OK, OK) is None
    assert defect("Repeat this sentence exactly: " + OK, OK, OK) is None
    assert defect(Q, "Öffnen Sie den Termin #393 im Planer und wählen Sie die Zeit 14:13.", OK) == "other_language"
    assert defect("Translate into German: " + OK, "Öffnen Sie den Termin #393 im Planer und wählen Sie die Zeit 14:13.", None) is None
    for a in ("Open the visit #393 in the pl", "Open the visit #393 in the planner and", "Open the visit…", "Open the visit #393 [", '{"a": [1, {"b": "x', "1. Open it.\n2. Choose the sl"):
        assert defect(Q, a, OK) == "truncated_answer", a
    assert defect("What is 2 times 745.20?", "Multiply 745.", None) == "truncated_answer"
    for q, a in (("Give only the bare value.", "588.22"), ("Give only the bare value.", "#12, held"), ("Answer without any sentence.", "- a\n- b"), ("Return JSON.", '{"a": [1]}'), ("Is it so?", "Yes"), (Q, "```\nx = 1\n```")):
        assert defect(q, a, None) is None, a
    assert unclosed('a "b (c" d (') and not unclosed('a "b (c" d')
    assert not refuses(None)


def test_frame(spark):
    rows = [("a", Q, None, OK), ("a", Q, None, OK), ("b", Q, OK, None), (None, Q, None, None), ("c", None, "Open the", None), ("d", Q, OK * 20000, None)]
    df = spark.createDataFrame(rows, "id string, q string, a string, e string").selectExpr("*", "1 as _d", "2 as defect")
    assert sorted(map(tuple, defects(df, "id", "q", "a", "e").collect())) == [("a", "empty_answer"), ("c", "truncated_answer")]
    assert defects(df.limit(0), "id", "q", "a", "e").count() == 0
