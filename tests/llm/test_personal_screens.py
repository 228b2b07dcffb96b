"""What saves time in finding personal items changes nothing that is found: hints of cues, candidates looked for once, a pattern without backtracking."""

import re

from spanwright.llm import personal as P

TEXTS = ["My name is Ann Lee, write to ann.lee@mail.example or call 212-555-0132.", "KUNDIN: Jana Köhler wohnt am Ring 4, 10115 Berlin.", "The crate stands in row 4.", "Best regards, Jon Doe", "signed order 1234-5678-901 at 07:15", "(issued to Mia Roth) x dot y at mail dot example"]


def test_candidates_are_looked_for_once(monkeypatch):
    lex, seen = P.Lexicon(TEXTS), []
    own = P.candidates
    monkeypatch.setattr(P, "candidates", lambda text, hint: seen.append(text) or own(text, hint))
    P.Finder(lex).find(TEXTS)
    assert sorted(seen) == sorted(TEXTS)


def test_every_cue_is_hinted():
    cues = "my name is|this is|spoke to|spoke with|issued to|belongs to|customer|contact|contact:|recipient|recipient\":|owner:|name=|mein name ist|ich heiße|je m'appelle|je m’appelle|mon nom est|me llamo|mi nombre es|regards|kind regards,|best regards,|sincerely,|signed,|grüße,|cordialement,|saludos,|kunde|kundin|client|cliente".split("|")
    for cue in cues:
        for told in (cue, cue.upper().replace("SS", "ẞ"), cue.replace("s", "ſ")):
            for text in (f"{told} Ann Lee", f"3-{told}s Ann", f"x: {told}"):
                assert not P.NAME_CUE.search(text) or P.hinted(text) & P.TOLD, text
        assert P.NAME_CUE.search(f"{cue} Ann Lee"), cue


def test_addresses_without_backtracking():
    slow = re.compile(P._EMAIL.pattern.replace("++", "+").replace("*+)+", "*)+"), re.I)
    assert slow.pattern != P._EMAIL.pattern
    parts = ["ann", "b-c", "x+y", ".", "@", " at ", " dot ", "[at]", "(dot)", " ", "mailto:", "d3", "-", "Ⅷ", "é"]
    n = 0
    for i in range(20_000):
        text, k = "", i * 2654435761 % (1 << 32) + (i << 32)
        for _ in range(9):
            text, k = text + parts[k % len(parts)], k // len(parts)
        want = [m.span() for m in slow.finditer(text)]
        assert [m.span() for m in P._EMAIL.finditer(text)] == want, text
        n += bool(want)
    assert n > 100
