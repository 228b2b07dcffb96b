import random
from collections import Counter

from pyspark.sql import functions as F

from spanwright.llm.personal import Finder, Lexicon, fit, formed, personal, redacted

GIVEN = ["Ada", "Bruno", "Celine", "Dmitri", "Elif", "Farah"]
SUR = ["Novak", "Okafor", "Petrov-Lind", "Quigley", "Rossi", "Sato"]
NOISE = ["The Harbor Ledger tariff comes to 12.40 for 9 crates.", "Where is parcel 1234-56-7890?", "Is gateway 10.0.14.17 part of the Blue Kiln rollout?", "lookup@v77 returned nothing for PX-30121, why?", "Meter 555-27 reports more.", "Route this to the Silver Reed team, case #593333."]


def texts():
    out = list(NOISE) * 3
    for i, g in enumerate(GIVEN):
        for j, s in enumerate(SUR):
            out.append([f"My name is {g} {s} and parcel 1234-56-7890 never arrived.", f"Customer {g} {s} called.", f"Contact: {g} {s} | x", f"agent note: spoke to {g} {s} re it"][(i + j) % 4])
    return out


def kinds(text, f):
    return Counter(k for _, _, k in f.find([text])[0])


def test_forms():
    one = {
        "email": ["a.b+c@mail.example", "A_B@MAIL.EXAMPLE.COM", "a-b [at] mail.example", "a_b at mail dot example", "x @ y.test", "mailto:q@w.test"],
        "phone": ["+49 30 23125 655", "+16175550152", "(617) 555-0149", "305.555.0140 ext. 12", "1-415-555-0101", "07700 900 729", "020 7946 0356", "030/23125-002", "01.99.00.58.79", "+33 1 99 00 90 96"],
        "identity_number": ["SSN 968-02-2766", "ssn:958087256", "social security number is 974 06 5690", "NINO QQ996336D", "NI number QQ 29 99 33 D", "Steuer-ID 00 510 984 007", "passport no. X00783917", "passport number: ZZ-00043850", "DNI 00765205B", "Ausweisnummer L0X863666", "national ID 00-5232541-5", "numéro de sécurité sociale 0 00 00 22 876 009 00"],
        "street_address": ["753 Saltmarsh Road, Apt 5, Dunhollow 00871", "Flat 24, 93 Copper Kettle Road, Tarnsee", "553 Plumstone Lane\nSaint-Orval, 00438", "Plumstoneweg 6b, 00534 Rivemont", "Am Bellwetherufer 46, Rivemont", "48 bis, rue Saltmarsh, 00925 Quillstead", "44 avenue du Millrace, 00341 Marrowford", "Calle Willowbend 25, 3º B, 00146 Kestrelby", "Avenida Elderberry, 20, Eastvale", "389b Copperkettle St."],
    }
    for kind, xs in one.items():
        for x in xs:
            for t in (x, f"see {x}, please.", f'{{"a": "{x}", "order": "PX-12345"}}'):
                assert [k for _, _, k in formed(t)] == [kind], t
    for t in NOISE + ["order 968-02-2766", "code 4155-27-084", "version 10.72.2", "at 12:30 on 2025-03-08"]:
        assert formed(t) == [], t


def test_names():
    lex = Lexicon(texts())
    assert {"ada", "novak", "lind", "sato"} <= lex.names and not {"harbor", "blue", "parcel"} & lex.names
    f = Finder(lex)
    for t in ("Regards,\nAda Novak", "Two people share 1: Mr. Novak and elif sato.", "name=DMITRI ROSSI;tel=1", "Quigley, Farah called", "ask B. Okafor", "Frau Dr. Petrov-Lind", '{"owner": "ada sato"}', "Ulla Brandvold and Zed were here; my name is Ulla Brandvold"):
        want = 2 if "Two" in t or "Ulla" in t else 1
        assert kinds(t, f)["person_name"] == want, t
    for t in (*NOISE, "Ada", "ada.novak@mail.example", ""):
        assert kinds(t, f)["person_name"] == 0, t


def test_skip_edges_carry_labels():
    lex = Lexicon(texts())
    t = "My name is Vorn Halbeck. x; VORN HALBECK said so, and vorn halbeck again."
    got = [t[lo:hi] for lo, hi, k in Finder(lex).find([t])[0] if k == "person_name"]
    assert got[:2] == ["Vorn Halbeck", "VORN HALBECK"]


def test_field_without_planted_words():
    """Product names, places, weekdays and interface words are no persons; names with a title, a cue or an initial are, seen before or not."""
    f = Finder(Lexicon(texts()))
    for t in ("We moved from Visual Studio to the new one.", "The Golden Gate Bridge", "Monday Morning", "Request Handler: Connection Pool", "Opened in New York on Tuesday Evening.", "Error In Payment Gateway", "Quarterly Review, Finance Team"):
        assert kinds(t, f)["person_name"] == 0, t
    for t in ("My name is Ulla Brandvold.", "Frau Brandvold rief an.", "Dear Dr. Zeph Arkwright, thanks", "Kind regards, Ulla Brandvold"):
        assert kinds(t, f)["person_name"] == 1, t


def test_equal_and_similar_tokens_share_labels():
    f = Finder(Lexicon(texts()))
    # the second number has no cue of its own; the third is an order's, far from any cue, but the same number
    t = "SSN 968022766 was given." + " The crate is late." * 40 + " Again 968-02-2766 came up."
    assert kinds(t, f)["identity_number"] == 2
    t = "My name is Vorn Halbeck." + " It was late again." * 300 + " V. Halbeck called; so did Vorn Halbek."
    got = [t[lo:hi] for lo, hi, k in f.find([t])[0] if k == "person_name"]
    assert got[:2] == ["Vorn Halbeck", "V. Halbeck"]


def test_screen_equals_the_field():
    r = random.Random(4)
    lex = Lexicon(texts())
    words = [*GIVEN, *SUR, "parcel", "The", "Harbor", "ledger", "Mr.", "de", "called", "Vorn", "B.", "regards,", "12", "ada", "sato", "x", "and", "customer", "Ulla's"]
    some = [" ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(r.randint(1, 12))) for _ in range(3_000)]
    assert Finder(lex).find(some) == Finder(lex, screen=False).find(some)


def test_frame(spark):
    rows = [("t", "1", x, None) for x in texts()] + [("u", "2", "Mr. Novak, a@b.test, Mr. Novak", "x 1-415-555-0101"), ("u", "3", None, ""), ("u", "2", "Mr. Novak, a@b.test, Mr. Novak", "x 1-415-555-0101"), ("u", "4", "word " * 50_000 + "q@w.test", None)]
    df = spark.createDataFrame(rows, "t string, s string, a string, b string").selectExpr("*", "1 as field", "2 as _t")
    fields = {"in": F.col("a"), "out": F.col("b")}
    got = personal(df, ["t", "s"], fields).filter("t = 'u'").distinct().collect()
    assert sorted(map(tuple, got)) == [("u", "2", "in", "email", 1), ("u", "2", "in", "person_name", 1), ("u", "2", "in", "person_name", 2), ("u", "2", "out", "phone", 1), ("u", "4", "in", "email", 1)]
    text = personal(df, ["t", "s"], fields, with_text=True).filter("s = '2'").distinct().collect()
    assert sorted((r["field"], r["text"]) for r in text) == [("in", "[PERSON_NAME], [EMAIL], [PERSON_NAME]"), ("out", "x [PHONE]")]
    assert personal(df.limit(0), ["t", "s"], fields).count() == 0
    assert redacted(None, []) is None


def test_fit_reads_all_texts(spark):
    """A name whose only cues stand in 3 of 30,000 texts is known, and the fit over a table equals the one over a list."""
    rare = [f"My name is Zorvath Quillby and parcel {i} is late." for i in range(3)]
    all_ = [*(f"Crate {i} comes to the harbor." for i in range(30_000)), *rare, *texts()]
    lex = fit(spark.createDataFrame([(t,) for t in [*all_, *rare, None, ""]], "_t string").repartition(5))
    assert {"zorvath", "quillby"} <= lex.names and lex.total["crate"] == 30_000
    own = Lexicon(all_)
    assert lex.odds == {w: x for w, x in own.odds.items() if own.total[w] > 1} and (lex.shapes, lex.before, lex.after, lex.plain) == (own.shapes, own.before, own.after, own.plain)
