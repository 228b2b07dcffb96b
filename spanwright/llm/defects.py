"""Defects of question-answer pairs: empty, truncated, refusing, copied and wrong-language answers.

Method: a suffix automaton over the words of the question is traversed with the answer, which measures how much of the answer
stands in the question; automata of refusal phrases, a stack of delimiters and votes of stop words settle the other defects.

An answer gets the first defect of this order that holds: ``empty_answer`` (null, blank, or only a stand-in for nothing), ``refusal`` (a
refusal phrase, unless the expected answer has one), ``copied_question`` (all its words but a short lead-in stand in the question, in
stretches of at least three, and they are most of it, unless the question asks for repetition or the answer is a bare value), ``other_language`` (stop words vote for
another language than those of the question, unless the question names a language to answer in or asks for repetition),
``truncated_answer`` (ends within a sentence, a list, a number or an open delimiter; what has itself the form of a bare value or structure is complete,
and so is a bare list of values if the question asks for one).

Defined results: rows with a null id give none; repeated rows of an id give one row, with the first defect of that order; a null question counts as empty
text; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ["empty_answer", "refusal", "copied_question", "other_language", "truncated_answer"]

# What stands for nothing, refusal phrases, requests, lead-ins and stop words, in lower case with straight apostrophes.
NOTHING = ["n/a", "na", "none", "null", "nil", "nan", "empty", "undefined", "tbd", "todo", "no answer", "no response", "no output", "not available", "nothing", "keine antwort", "keine", "nichts", "aucune", "aucune réponse", "rien", "ninguna", "nada", "sin respuesta", "vacío", "leer", "vide"]
REFUSALS = [
    "can't help with", "cannot help with", "can't help you", "cannot help you", "can not help", "unable to help", "not able to help", "won't help", "can't assist", "cannot assist", "can not assist", "unable to assist", "not able to assist", "can't provide", "cannot provide", "can not provide", "unable to provide", "not able to provide", "won't be able to", "will not be able to", "unable to comment", "can't comment", "cannot comment", "must refuse", "have to refuse", "i refuse", "have to decline", "must decline", "i decline", "beyond what i'm allowed", "beyond what i am allowed", "i'm not allowed", "i am not allowed", "can't answer", "cannot answer", "unable to answer", "not able to answer", "can't share", "cannot share", "not able to share", "can't comply", "cannot comply", "can't discuss", "cannot discuss", "can't fulfill", "cannot fulfill", "against my guidelines", "i can't do that", "i cannot do that", "i'd rather not", "not something i can", "not something i am able", "isn't something i can",
    "darf ich nicht", "ich darf nicht", "kann ich nicht helfen", "kann ich ihnen nicht", "ich kann nicht helfen", "kann dabei nicht helfen", "kann ich leider nicht", "ich kann ihnen nicht", "ich kann ihnen dabei nicht", "kann ich nicht beantworten", "frage nicht beantworten", "anfrage nicht beantworten", "kann ich keine", "ich kann diese", "muss ich ablehnen", "ablehnen", "nicht in der lage", "ist mir nicht möglich", "nicht weiterhelfen",
    "ne peux pas", "ne puis pas", "ne suis pas en mesure", "dois refuser", "dois décliner", "ne m'est pas possible", "pas autorisé à", "refuse de répondre", "suis dans l'impossibilité",
    "no puedo", "no me es posible", "debo rechazar", "tengo que rechazar", "no estoy en condiciones", "no estoy autorizado", "no me está permitido", "debo negarme", "me niego",
]
REPEAT = r"\b(repeat|echo|copy|quote|restate|recite|verbatim|word for word|wiederhol\w*|zitier\w*|wörtlich|répét\w*|répèt\w*|recopi\w*|mot pour mot|repit\w*|repet\w*|copia|palabra por palabra)\b"
LANGUAGE = r"\b(translat\w*|übersetz\w*|tradu\w*|(?:in|into|to|auf|ins|en|al) (?:english|german|french|spanish|englisch|deutsch|deutsche|französisch|spanisch|englische|französische|spanische|anglais|allemand|français|espagnol|inglés|alemán|francés|español))\b"
BARE = r"\b(bare|only|just|json|yaml|xml|csv|list|without any sentence|without a sentence|one word|single word|yes or no|number|value|code|nur|liste|wert|seulement|uniquement|valeur|solo|sólo|valor|lista)\b"
LEAD_IN = 4
STOP_WORDS = {
    "en": "the of and to in is was were are that for it with as at by be this which not from an or but has have had will can its after than into because how what why when where who do does did been if then them they you your before could should would there a i me my us our your so no up out about between during each other some such more most over under again once these those i'm it's two three four".split(),
    "de": "der die das und ist nicht mit dem den in ein eine einen einer des im zu auf für von wird wurde werden sich bei nach aus als auch noch dass weil wie warum wo wer welche welchen zur zum am an er sie es wir ihr haben hat war sind dann danach zuerst über vor kann lange was liefen zwei drei vier".split(),
    "fr": "le la les des du de et est une un dans que qui pour pas par sur au aux avec ce cette se sont été a ont il elle nous vous ne plus parce puis en deux comment pourquoi quels combien où d'abord ensuite l' s' n' leur avant après reste avait était trois quatre".split(),
    "es": "el la los las de del y es en que un una por con no se su al para como más pero sus le ya o fue ha han está porque cuando qué cómo cuánto dónde quién hicieron luego primero después si dos les son a antes usted tres cuatro".split(),
}

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ENDS = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*$")
_LIST = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+\S")
_CUT = re.compile(r"(?:…|\.\.\.|[-–—,;:(\[{/&+])$")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def plain(text: str) -> str:
    return text.replace("’", "'").replace("​", "").replace("﻿", "").lower()


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


class SuffixAutomaton:
    """All substrings of a word sequence."""

    def __init__(self, seq: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for w in seq:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.size.append(self.size[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.size[p] + 1 == self.size[q]:
                    self.link[cur] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.size.append(self.size[p] + 1)
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
                    self.link[q] = self.link[cur] = copy
            last = cur

    def covered(self, seq: list[str], least: int) -> int:
        """Words of ``seq`` in stretches of at least ``least`` words that stand in the automaton's sequence."""
        at = n = 0
        upto = total = 0
        for i, w in enumerate(seq):
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.size[at]
            if w in self.next[at]:
                at = self.next[at][w]
                n += 1
            if n >= least:
                total += i + 1 - max(upto, i + 1 - n)
                upto = i + 1
        return total


@lru_cache(maxsize=1)
def _refusals() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in REFUSALS:
        a.add_word(p, p)
    a.make_automaton()
    return a


def refuses(text: str | None) -> bool:
    return bool(text) and next(_refusals().iter(" ".join(plain(text).split())), None) is not None


_STOPS = {lang: frozenset(ws) for lang, ws in STOP_WORDS.items()}
_REPEAT, _LANGUAGE, _BARE = (re.compile(p, re.I) for p in (REPEAT, LANGUAGE, BARE))


_SHARE = {w: 1 / sum(w in stops for stops in _STOPS.values()) for w in frozenset().union(*_STOPS.values())}
_LETTERS = {"de": re.compile("[äöüß]"), "es": re.compile("[ñ¿¡áíóú]"), "fr": re.compile("[çœêèàâîôû]")}


def votes(text: str) -> dict[str, float]:
    """Stop words by language, each shared among the languages that have it, and a vote for words with a language's own letters."""
    ws = [part for w in words(text) for part in (w, w.split("'")[0] + "'") if "'" in w or part == w]
    out = {lang: sum(_SHARE[w] for w in ws if w in stops) for lang, stops in _STOPS.items()}
    for lang, letters in _LETTERS.items():
        out[lang] += sum(bool(letters.search(w)) for w in ws) / 2
    return out


def language(text: str, lead: float = 0.5) -> str | None:
    """The language with most votes, if it leads by ``lead``."""
    v = sorted(votes(text).items(), key=lambda x: -x[1])
    return v[0][0] if v[0][1] >= v[1][1] + lead else None


def unclosed(text: str) -> bool:
    """Whether a bracket, a fence or a double quote stays open; quoted strings hide brackets."""
    stack: list[str] = []
    for part in re.findall(r'```|\\.|["()\[\]{}]', text):
        if part in ('"', "```"):
            if stack and stack[-1] == part:
                stack.pop()
            elif part not in stack:
                stack.append(part)
        elif stack and stack[-1] == '"':
            continue
        elif part in "([{":
            stack.append(part)
        elif part in _PAIRS and stack and stack[-1] == _PAIRS[part]:
            stack.pop()
    return bool(stack)


def truncated(question: str, answer: str) -> bool:
    a = answer.rstrip()
    if unclosed(a):
        return True
    if a.endswith(("```", "}", "]")):
        return False
    last = a.split()[-1]
    if re.fullmatch(r"\D*\d+[.,]", last) and re.search(re.escape(last) + r"\d", question):
        return True  # within a number of the question
    if _CUT.search(a) or re.search(r"(?:^|\n)\s*(?:[-*•]|\d+[.)])\s*$", a):
        return True  # a bare marker is no item
    lines = [x for x in a.split("\n") if x.strip()]
    listed = [bool(_LIST.match(x)) for x in lines]
    asked = bool(_BARE.search(question))
    if any(listed):
        items = [x.strip() for x, is_item in zip(lines, listed) if is_item]
        stops = [bool(_ENDS.search(x)) for x in items]
        # A list whose other items end with a stop breaks off if its last doesn't.
        return not listed[-1] and not _ENDS.search(a) or (len(items) > 1 and all(stops[:-1]) and not stops[-1])
    if _ENDS.search(a):
        return False
    # What ends without a stop is whole only as a bare value, or as a bare list of values where one was asked for.
    return not (_value(a) or asked and _bare_list(a))


_ANY_STOP = frozenset().union(*_STOPS.values())


def _value(a: str) -> bool:
    """One to three words of which one holds a digit, or a yes or no."""
    ws = words(a)
    return bool(ws) and len(ws) <= 3 and (any(any(c.isdigit() for c in w) for w in ws) or ws[0] in ("yes", "no", "ja", "nein", "oui", "non", "sí", "si", "true", "false", "ok"))


def _bare_list(a: str) -> bool:
    """Values divided by commas, semicolons, bars or line ends, each of a few words and none ending with a stop word, as a sentence's parts would."""
    parts = [words(x) for x in re.split(r"[,;|\n]|: ", a)]
    return all(ws and len(ws) <= 4 and ws[-1] not in _ANY_STOP for ws in parts)


def defect(question: str | None, answer: str | None, expected: str | None) -> str | None:
    q, a = question or "", answer or ""
    bare = plain(a).strip().strip("<>[](){}\"'`*_.-–—… \t\n").strip()
    if not bare or bare in NOTHING:
        return "empty_answer"
    if refuses(a) and not refuses(expected):
        return "refusal"
    ws, qs = words(a), words(q)
    asks_repeat = bool(_REPEAT.search(q))
    if qs and len(ws) > 2 and not asks_repeat:
        copied = SuffixAutomaton(qs).covered(ws, min(3, len(qs)))
        own = len(ws) - copied
        if own <= min(LEAD_IN, len(ws) // 3) and copied >= 0.7 * len(qs) and not (_BARE.search(q) and any(c in a for c in "{[,\n") and own):
            return "copied_question"
    if not asks_repeat and not _LANGUAGE.search(q):
        theirs, mine = language(q) or language(expected or "", 2), language(a, 2)
        if theirs and mine and theirs != mine:
            return "other_language"
    return "truncated_answer" if truncated(q, a) else None


def defects(df: DataFrame, case: str, question: str, answer: str, expected: str) -> DataFrame:
    """Rows (``case``, ``defect``) of the defective cases."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, qs, as_, es = (c.to_pylist() for c in b.columns)
            out = [(i, DEFECTS.index(d)) for i, q, a, e in zip(ids, qs, as_, es) if (d := defect(q, a, e))]
            if out:
                yield pa.RecordBatch.from_pydict({case: pa.array([x[0] for x in out], b.schema[0].type), "_d": pa.array([x[1] for x in out], pa.int32())})

    kind = df.schema[case].dataType.simpleString()
    rows = df.filter(F.col(case).isNotNull()).select(case, question, answer, expected)
    found = rows.mapInArrow(work, f"`{case}` {kind}, _d int")
    return found.groupBy(case).agg(F.min("_d").alias("_d")).select(case, F.element_at(F.array(*[F.lit(x) for x in DEFECTS]), F.col("_d") + 1).alias("defect"))
