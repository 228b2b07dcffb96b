"""Texts of one form, which differ in digits that no pattern tells from a 9, are read once, and each gets what it gets alone."""

import random

from pyspark.sql import functions as F

from spanwright.llm import personal as P

PARTS = ["+", "(", ")", "0", "1", "01", "10", "5", "23", "456", "7890", "12345", "-", ".", " ", " ", "/", ", ", "\n", "x", "ext. ", "é", " ", "٣", "SSN ", "order ", "tel: ", "a1", "_0", "Ring ", " Road", "@", "b.c", "²", ":", "😀"]


def some(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(1, 14))) for _ in range(n)]


def other_digits(text, r):
    """Another text of the same form, if the dice give one."""
    new = "".join(r.choice("0123456789") if c in "0123456789" and r.random() < 0.5 else c for c in text)
    return new if P.same(new) == P.same(text) else text


def test_a_form_is_read_once(monkeypatch):
    texts = [f"Crate {i} of order {i}-77 goes to row 7{i % 10} now." for i in range(200, 800)]
    lex, seen, told = P.Lexicon(texts), [], []
    own = P.candidates
    monkeypatch.setattr(P, "candidates", lambda text, hint: seen.append(text) or own(text, hint))
    assert P.Finder(lex).find(texts) == [[]] * len(texts) and len(seen) == 1
    read = P._told
    monkeypatch.setattr(P, "_told", lambda texts, times, t: told.extend(times) or read(texts, times, t))
    assert P.Lexicon(texts).total["crate"] == 600 and told == [600]


def test_one_form_one_reading():
    r, n = random.Random(2), 0
    for t in some(20_000, 1):
        u = other_digits(t, r)
        hint = P.hinted(t)
        assert P.hinted(u) == hint and P.candidates(u, hint) == P.candidates(t, hint), (t, u)
        n += u != t and bool(P.candidates(t, hint))
    assert n > 200


def test_items_are_those_of_each_text(monkeypatch):
    r = random.Random(3)
    texts = [f"My name is {a} {b}, SSN 968-02-{i}." for i, (a, b) in enumerate([("Ada", "Novak"), ("Elif", "Sato"), ("Bruno", "Rossi")] * 5, 2700)]
    for t in some(600, 4):
        texts += [t, other_digits(t, r), f"{t}; my name is Ada Novak or {other_digits(t, r)}"]
    lex = P.Lexicon(texts)
    got = P.Finder(lex).find(texts)
    monkeypatch.setattr(P, "same", str.encode)
    own = P.Lexicon(texts)
    assert (lex.total, lex.odds, lex.shapes, lex.before, lex.after, lex.plain) == (own.total, own.odds, own.shapes, own.before, own.after, own.plain)
    assert P.Finder(lex).find(texts) == got and sum(map(len, got)) > 500


def test_equal_segments_in_some_texts_of_a_form():
    """The second number has no cue of its own, and its shape speaks against it: it is an item only where it is the first one again."""
    texts = [f"SSN {a} was given. The crate is late. Again {b} came up." for a, b in [("968-02-2766", "968-02-2766"), ("968-02-2766", "968-02-2767"), ("868-02-2766", "868-02-2766"), ("968-02-2766", "868-02-2766")]]
    assert len({P.same(t) for t in texts}) == 1
    lex = P.Lexicon(texts)
    lex.shapes = {"999-99-9999": {"identity_number": -3.5}}
    for some_ in (texts, texts[::-1]):
        f = P.Finder(lex)
        for _ in range(2):
            assert [len(x) for x in f.find(some_)] == ([2, 1, 2, 1] if some_ is texts else [1, 2, 1, 2])


def test_forms_of_both_engines(spark):
    texts = some(5_000, 5)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_replace("t", P.SAME_AS_9, "9").alias("f")).collect()
    assert all(r["f"].encode() == P.same(r["t"]) for r in got)
    assert P.same("(030) 1-212 10.1 a1 x0") == b"(099) 1-999 99.1 a9 x9"


def test_screens_of_numbers_lose_none():
    """No phone or identity number stands in a text that a screen leaves out."""
    n = 0
    for t in some(20_000, 6) + [f"{a}{b}" for a in ("", " ", "x", "-", "(", "#", "é", "\n") for b in ("QQ 12 34 56 C", "968-02-2766", "00765205B", "ZZ-00043850", "00-5232541-5", "0 00 00 22 876 009 00", "00 510 984 007", "1-415-555-0101", "1 (617) 555-0149", "020 7946 0356", "01.99.00.58.79", "+4 9")]:
        phone, number = bool(P._PHONE.search(t)), bool(P._ID_FORM.search(t))
        assert phone <= bool(P._SCREEN_PHONE.search(t)) and number <= bool(P._SCREEN_ID.search(t)), t
        n += phone or number
    assert n > 200
