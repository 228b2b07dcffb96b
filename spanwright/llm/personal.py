"""Personal information inside free text: found and replaced by typed placeholders.

Method: a skip-chain conditional random field over the tokens of each text. A token is a word, or a candidate segment: a stretch that has the form of
an e-mail address, phone number, identity number or street address. Words are labelled O, B or I (of a person's name), segments O or one of the four types, so
that all five types are labels of one field.

Node potentials. Of a word: the log-odds of being part of a name, its shape, titles, cue phrases, and the log-odds of names behind the word before and in
front of the word after. Of a segment: its form, the cue before it (an identity number's name; an order, invoice, version, which speak against it), and
the log-odds of its shape of digits and letters being of a type. Chain potentials bind neighbours by what separates them. Skip potentials bind
repeated and similar tokens of a text: equal words but for accents and possessives, words one letter apart, an initial and the given name before the
same surname, segments of the same digits or letters. All tokens of such a group share one variable, so that a label that is plain in one place
reaches all others, however long the text. Loopy belief propagation alternates exact passes along the chain with messages from and to these
variables until they stop changing, for many texts at once in padded arrays; the labels are then the best sequence under the last messages.

Fit. All distinct texts are labelled by cue phrases. Log-odds come from these labels, then once more from the field's own labels there; feature weights are
then fitted on these by penalised logistic regression, given the neighbours' labels. Words that the texts hold once stand in for those they don't hold.
Chain and skip potentials are set. All rows are then labelled.

Texts that differ in digits only, and not in a digit that a form asks for by its value, have one form (``same``): equal candidates, words and labels. The fit reads each form
once, with the number of distinct texts of it; the labels of a form hold for all its texts, but for the types of segments that are equal in some of them only.

A text goes around the field only if it has no segment and no word that could be part of a name under the highest potentials that its neighbours,
repetitions and the chain allow, in which case the field labels none.

Defined results: null and empty texts hold nothing; texts of any length are read whole; a repeated item counts each time; a name is at least
two of given name, initial, surname and title, whatever their letter case; repeated rows give equal results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.session import Scratch

KEPT_BYTES = 64_000_000  # of forms, each with FORM_BYTES besides
FORM_BYTES = 200
KEPT_WORDS = 200_000
KEPT_COUNTS = 500_000
ROUNDS = 100  # of messages, where these don't come to rest before
REST = 1e-3
TYPES = ["email", "phone", "identity_number", "street_address", "person_name"]
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}

# Forms and cue words.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir madam frau herr fräulein mme mlle monsieur madame m señor señora señorita sr sra srta don doña dott ing".split())
NAME_CUES = r"""my\ name\ is|this\ is|spoke\ (?:with|to)|issued\ to|belongs\ to|customer|contact:?|recipient"?:?|owner"?:|name=|mein\ name\ ist|ich\ heiße|je\ m['’]appelle|mon\ nom\ est|me\ llamo|mi\ nombre\ es|(?:kind\ |best\ )?regards,?|sincerely,?|signed,?|grüße,?|cordialement,?|saludos,?|kunde|kundin|client|cliente"""
PARTICLES = {"de", "van", "von", "der", "den", "del", "la", "le", "du", "da", "di", "bin", "al"}

_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_NAME_AFTER_CUE = re.compile(
    rf"""(?:(?<=[\s(\["|;:])|^)(?i:{NAME_CUES})[\s:"]*((?:(?i:{"|".join(sorted(TITLES))})\.?\s+)?(?:{_CAP}\.?(?:,?[ ]|$|(?=\W))){{1,4}})""", re.X
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")

_TOWN = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
# Possessive, as what stands behind a run of such characters never begins with one of them.
_EMAIL = re.compile(
    r"(?:mailto:)?[\w+-]++(?:(?:\.|\sdot\s|\s?[\[({]dot[\])}]\s?)[\w+-]++)*(?:\s?@\s?|\s?[\[({](?:at|@)[\])}]\s?|\sat\s(?=[\w-]+\sdot\s))[\w-]++(?:(?:\.|\sdot\s|\s?[\[({]dot[\])}]\s?)[a-z][\w-]*+)+", re.I
)
_ID_CUE = r"(?:ssn|social\ security(?:\ (?:number|no\.?))?|nino|ni\ (?:number|no\.?)|national\ insurance(?:\ (?:number|no\.?))?|tax\ (?:id|number|no\.?)|tin|itin|steuer-?id(?:nummer)?|steuernummer|steueridentifikationsnummer|passport(?:\ (?:number|no\.?|nr\.?))?|reisepass(?:nummer)?|passeport(?:\ (?:n°|numéro))?|pasaporte|dni|nie|nif|ausweis(?:nummer|nr\.?)?|personalausweis(?:nummer)?|national\ id(?:entity)?(?:\ (?:card|number))*|identity\ (?:card|number)(?:\ (?:number|no\.?))?|id\ card(?:\ (?:number|no\.?))?|num[ée]ro\ de\ s[ée]curit[ée]\ sociale|n°\ de\ s[ée]curit[ée]\ sociale|num[ée]ro\ fiscal|sozialversicherungsnummer|n[úu]mero\ de\ (?:la\ )?seguridad\ social)"
_ID_AFTER_CUE = re.compile(rf"\b{_ID_CUE}(?:\s*(?:is|ist|est|es|lautet|number|no\.|nr\.|:|=|\#)\s*|\s+)*\s*((?=[A-Z0-9-]*[ .-]?[A-Z0-9]*\d)[A-Z0-9]{{1,12}}(?:[ .-]?(?=[A-Z]?\d|[A-Z]\b)[A-Z0-9]{{1,9}}){{0,8}})", re.I | re.X)
_ID_FORM = re.compile(
    r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-CEGHJ-PQR-TW-Z]{2}\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?[A-D]|\d{8}[A-HJ-NP-TV-Z]|[A-Z]{2}-\d{8}|\d{2}-\d{7}-\d|\d\ \d{2}\ \d{2}\ \d{2}\ \d{3}\ \d{3}\ \d{2}|\d{2}\ \d{3}\ \d{3}\ \d{3})(?![\w-])", re.X
)
_NOT_ID = re.compile(r"(?:order|invoice|version|gateway|code|build|ticket|parcel|case|ref(?:erence)?|meter|bestellung|sendung|rechnung|commande|facture|colis|pedido|factura|paquete)\W{0,6}(?:no\.?|nr\.?|number|#)?\W{0,4}$", re.I)
_KIND = r"(?:street|st\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|court|ct\.?|terrace|boulevard|blvd\.?|drive|way|place|square|close|crescent|row|gardens|mews|hill|quay)"
_UNIT = r"(?:flat|apt\.?|apartment|unit|suite|ste\.?|room|floor)\s?\#?\d+\w?"
_PLACE = rf"(?:,\s*|\s*(?:\n|\\n)\s*|[ ]+(?=\d{{5}}\b))(?:\d{{5}}[ ]+{_TOWN}|{_TOWN},?[ ]\d{{5}}\b|{_TOWN}(?=\W|$))"
_STREET_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_ADDRESS = re.compile(
    rf"""(?<![\w#-])(?:
      (?:{_UNIT},?\s+)?\d{{1,5}}[a-z]?\s+(?:(?!{_KIND}\s){_STREET_NAME}\s+){{1,3}}?{_KIND}(?![\w-])(?:,?\s*{_UNIT})?(?P<a>{_PLACE})?
    | (?:(?:am|an\ der|an\ den|auf\ der|auf\ dem|im|in\ der|zum|zur)\s+)?[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer|ring|damm|steig)\s+\d{{1,4}}\s?[a-z]?\b(?P<b>{_PLACE})?
    | \d{{1,4}}(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|av\.|boulevard|chemin|allée|impasse|quai)\s+(?:(?:de\ la|de\ l['’]|des|du|de|d['’])\s*)?{_STREET_NAME}(?P<c>{_PLACE})?
    | (?:calle|avenida|avda\.|plaza|paseo|camino|carretera|c/)\s+(?:(?:de\ la|de\ los|del|de)\s+)?{_STREET_NAME}(?:\s(?=[^\W\d_a-zß-öø-ÿ]){_STREET_NAME})?,?\s+(?:n[.º°]\s?)?\d{{1,4}}(?:,\s*\d+\s?[ºª°]\.?\s?\w{{0,3}})?(?P<d>{_PLACE})?
    )""",
    re.I | re.X,
)
_EXT = r"(?:,?\s*(?:ext\.?|extension|x|durchwahl|poste|extensión)\s*\d{1,6}\b)?"
_PHONE = re.compile(
    rf"""(?<![\w#+./-])(?:
      \+\d{{1,3}}(?:[\s./-]?\(?\d{{1,5}}\)?){{2,6}}(?!\d)
    | (?:1[-.\s])?(?:\(\d{{3}}\)\s?|\d{{3}}[-.\s])\d{{3}}[-.\s]\d{{4}}
    | 0\d{{4}}\s\d{{3}}\s\d{{3}} | 0\d{{2,3}}\s\d{{3,4}}\s\d{{4}} | 0\d{{9,10}}
    | 0\d(?:[.\s]\d{{2}}){{4}}
    | \(?0\d{{1,4}}\)?\s?[/-]\s?\d{{3,8}}(?:[-\s]\d{{1,5}})?
    )(?![\w]|[-.]\d){_EXT}""",
    re.I | re.X,
)
# Words and characters without which a form can't stand in a text; only such texts are searched for it.
_ADDRESS_WORDS = frozenset("street st road rd lane ln avenue ave av court ct terrace boulevard blvd drive way place square close crescent row gardens mews hill quay platz weg allee gasse ufer ring damm steig str straße strasse rue chemin allée impasse quai calle avenida avda plaza paseo camino carretera c".split())
_ADDRESS_ENDS = ("straße", "strasse", "str", "weg", "platz", "allee", "gasse", "ufer", "ring", "damm", "steig")
_ID_WORDS = frozenset("ssn social nino ni national tax tin itin steuer steuer-id steueridentifikationsnummer steuernummer passport reisepass reisepassnummer passeport pasaporte dni nie nif ausweis ausweisnummer ausweisnr personalausweis personalausweisnummer identity id sécurité securite numéro numero número sozialversicherungsnummer seguridad".split())
# These begin with a set of characters, which is what the search is quick for; what stands before is looked at behind it. Without the second and third no phone or identity number begins.
_SCREEN_NUMBER = re.compile(r"[+(\dA-Z](?:(?<=[+(])\d|(?<![\w-].)(?:(?<=0)\d|(?<=\d)(?:\d{1,2}[-. ]\d|[- ]\d|\d{7}[A-Z])|(?<=[A-Z])[A-Z][ -]?\d{2}))")
_SCREEN_PHONE = re.compile(r"[+(\d](?<![\w#+./-].)(?:(?<=[+(0])\d|(?<=1)[-.\s]|(?<=\d)\d\d[-.\s]\d{3}[-.\s])")
_SCREEN_ID = re.compile(r"[\dA-Z](?<![\w-].)(?:(?<=\d)(?:\d\d-\d\d-|\d{7}[A-Z]|\d-\d{7}-| \d\d \d\d |\d \d{3} \d{3})|(?<=[A-Z])[A-Z](?: ?\d\d|-\d{8}))")
_PHONE_CUE = re.compile(r"(?:phone|tel(?:efon|éfono|ephone)?|téléphone|mobile|cell|handy|móvil|portable|fax|call(?:ed)?(?:\ back)?(?:\ on|\ at)?|ruf\w*|anruf\w*|appel\w*|llam\w*|whatsapp|sms)\W{0,3}(?:no\.?|nr\.?|number|is|ist|est|es|:|=|on|at|under|unter|au|al)?\W{0,3}$", re.I | re.X)
_ID_BEFORE = re.compile(rf"\b{_ID_CUE}(?:\s*(?:is|ist|est|es|lautet|number|no\.|nr\.|:|=|\#)\s*|\s+)*\W*$", re.I | re.X)
PLACED, CUED, TOLD = 2, 4, 8
# Of each cue for names a stretch of letters, which stands within one word.
_TOLD_WORDS = "name this spoke issued belongs customer contact recipient owner heiße appelle nom llamo nombre regards sincerely signed grüße cordialement saludos kunde kundin client".split()
_TOLD_WORD = re.compile("|".join(_TOLD_WORDS), re.I)
NAME_CUE = re.compile(rf"(?i:(?:^|(?<=\W))(?:{NAME_CUES})[\s:\"]*)", re.X)

# Potentials that are set. A segment's: of its form, by type; a cue for it; a word that speaks against it; a shape's log-odds are bounded by ODDS.
FORM = {"email": 4.0, "phone": 3.0, "identity_number": 3.0, "street_address": 4.0}
CUE, AGAINST, ODDS = 3.0, -9.0, 2.0
# Weights of a word's features before they are fitted.
FEATURES = {"odds": 1.0, "capital": 0.8, "lower": -1.6, "new_capital": -0.6, "new_lower": -1.6, "short": -1.5, "initial": 0.3, "particle": -2.0, "before": 1.0, "after": 1.0, "titled": 2.5, "cue": 5.0}
TITLE, TITLE_ALONE, NONE = 2.5, -0.5, -20.0
NEW = -0.6
CONTEXT = 2.0  # bound of the log-odds of contexts
_F = {k: i for i, k in enumerate(FEATURES)}


# Digits that no pattern tells from a 9, for Python and Java. By its value _PHONE alone asks for a digit: for a 0 or 1 behind no word character, the 0 before a digit, the 1 before
# a hyphen, full stop or space; so does _SCREEN_NUMBER for a 0.
SAME_AS_9 = r"""[2-8]|(?<=[0-9A-Za-z_])[01]|1(?![^0-9A-Za-z_,:;"'})\]/#])|0(?![^A-Za-z_ .,:;"'})\]/#-])"""
_OWN_DIGIT = re.compile(rb"""(?<![0-9A-Za-z_])(?:1(?=[^0-9A-Za-z_,:;"'})\]/#])|0(?=[^A-Za-z_ .,:;"'})\]/#-]))""")
_TO_9 = bytes.maketrans(b"012345678", b"9" * 9)


def same(text: str) -> bytes:
    """The form of a text: its UTF-8 with 9 for each digit of ``SAME_AS_9``."""
    raw = text.encode("utf-8", "surrogatepass")
    out = raw.translate(_TO_9)
    own = [m.start() for m in _OWN_DIGIT.finditer(raw)] if b"0" in raw or b"1" in raw else []
    if own:
        out = bytearray(out)
        for i in own:
            out[i] = raw[i]
    return bytes(out)


def hints(word: str) -> int:
    """What a word hints at by itself: an address, an identity number, a cue for a name."""
    low = word.lower().rstrip(".")
    return (TOLD if _TOLD_WORD.search(word) else 0) | (PLACED if low in _ADDRESS_WORDS or low.endswith(_ADDRESS_ENDS) else 0) | (CUED if low in _ID_WORDS or low.startswith(("steuer", "ausweis")) else 0)


def hinted(text: str) -> int:
    """What the words of a text hint at."""
    hint = 0
    for w in _WORD.findall(text):
        hint |= hints(w)
    return hint


def shape(text: str) -> str:
    """The form of a number: digits as 9, letters as a."""
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", text))


class Segment:
    """A candidate: where it stands, and its potentials as each type (``scores``)."""

    __slots__ = ("lo", "hi", "scores", "key")

    def __init__(self, text: str, lo: int, hi: int, scores: dict[str, float]) -> None:
        self.lo, self.hi, self.scores = lo, hi, scores
        own = text[lo:hi].lower()
        digits = "".join(c for c in own if c.isdigit())
        self.key = ("n", digits) if ("phone" in scores or "identity_number" in scores) else ("t", re.sub(r"[\W_]+", "", own))


def candidates(text: str, hint: int) -> list[tuple[int, int, dict[str, float]]]:
    """The stretches of a text that have a form, with the potentials that form and cue give them as each type, in the order of their precedence."""
    out: list[tuple[int, int, dict[str, float]]] = []
    if "@" in text or " dot " in text or " DOT " in text or "at]" in text or "at)" in text or "at}" in text or "AT]" in text or "AT)" in text or "AT}" in text:
        for m in _EMAIL.finditer(text):
            out.append((*m.span(), {"email": FORM["email"]}))
    if hint & CUED:
        for m in _ID_AFTER_CUE.finditer(text):
            if sum(c.isdigit() for c in m[1]) >= 5:
                out.append((*m.span(1), {"identity_number": FORM["identity_number"] + CUE}))
    if _SCREEN_NUMBER.search(text):
        for m in _PHONE.finditer(text) if _SCREEN_PHONE.search(text) else ():
            n = sum(c.isdigit() for c in re.split(r"ext|x", m[0], flags=re.I)[0])
            if 8 <= n <= 15:
                front = text[max(0, m.start() - 24) : m.start()]
                against = AGAINST if _NOT_ID.search(front) else 0.0
                scores = {"phone": FORM["phone"] + against + (CUE if _PHONE_CUE.search(front) else 0.0)}
                if _ID_FORM.fullmatch(m[0]):
                    scores = {"phone": scores["phone"] - FORM["phone"], "identity_number": FORM["identity_number"] + against}
                out.append((*m.span(), scores))
        for m in _ID_FORM.finditer(text) if _SCREEN_ID.search(text) else ():
            against = AGAINST if _NOT_ID.search(text[max(0, m.start() - 24) : m.start()]) else 0.0
            out.append((*m.span(), {"identity_number": FORM["identity_number"] + against}))
    if hint & PLACED:
        for m in _ADDRESS.finditer(text):
            out.append((*m.span(), {"street_address": FORM["street_address"]}))
    return out


def segments(text: str, hint: int | None = None, shapes: dict[str, dict[str, float]] | None = None, offers: list | None = None) -> tuple[list[Segment], str]:
    """Candidate segments of a text (``offers``: its candidates where known), in their order, and the text with them blanked out. Of overlapping ones the first found stays, unless its potentials speak against it."""
    if offers is None:
        offers = candidates(text, hinted(text) if hint is None else hint)
    found: list[Segment] = []
    for lo, hi, scores in offers:
        if shapes and ("phone" in scores or "identity_number" in scores):
            told = shapes.get(shape(text[lo:hi]))
            if told:
                scores = {k: v + told.get(k, 0.0) for k, v in scores.items()}
        over = [f for f in found if f.lo < hi and lo < f.hi]
        kept = next((k for k, f in enumerate(over) if max(f.scores.values()) > 0), None)
        for f in over[:kept]:
            found.remove(f)
        if kept is None:
            found.append(Segment(text, lo, hi, scores))
    found.sort(key=lambda f: f.lo)
    for f in found:
        text = text[: f.lo] + "\x00" * (f.hi - f.lo) + text[f.hi :]
    return found, text


def formed(text: str) -> list[tuple[int, int, str]]:
    """Segments whose own potentials make them items, without the rest of the field."""
    return [(f.lo, f.hi, max(f.scores, key=f.scores.get)) for f in segments(text)[0] if max(f.scores.values()) > 0]


def _parts(word: str) -> list[str]:
    return [p for p in re.split(r"[-'’]", word.lower().rstrip(".")) if p]


def _folded(word: str) -> str:
    low = word.lower().rstrip(".")
    for end in ("'s", "’s"):
        low = low.removesuffix(end)
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def _odds(yes: float, all_: float, base: float) -> float:
    return float(np.clip(np.log((yes + 0.5) / (max(0.0, all_ - yes) + 0.5)) - base, -CONTEXT, CONTEXT))


class Lexicon:
    """What the field knows of words, contexts, shapes and weights; fitted on texts (see the module's text)."""

    def __init__(self, texts: list[str] | None = None, over: Callable | None = None) -> None:
        """``over``, instead of ``texts``: runs a reading function over the forms of all distinct texts and gives its tally's rows and the regression's sums."""
        own = Counter(same(t).decode("utf-8", "surrogatepass") for t in dict.fromkeys(texts or []))

        def local(read: Callable) -> tuple[list, Callable]:
            t = Tally()
            read(list(own), list(own.values()), t)
            rows = list(t.rows())
            x, yes, all_ = _arrays([r for r in rows if r[0] == "x"])
            return [r for r in rows if r[0] != "x"], lambda w: _sums(x, yes, all_, w)

        over = over or local
        name: Counter[str] = Counter()
        total: Counter[str] = Counter()
        seen: dict[str, Counter[str]] = defaultdict(Counter)
        for kind, key, yes, all_ in over(_told)[0]:
            if kind == "w":
                name[key.decode()], total[key.decode()] = yes, all_
            else:
                form, told = key.decode().split("\x1f")
                seen[form][told] = all_
        # A shape's log-odds of each type against the other cues.
        self.shapes = {k: {x: float(np.clip(np.log((c[x] + 1.0) / (sum(c.values()) - c[x] + 1.0)), -ODDS, ODDS)) for x in ("phone", "identity_number")} for k, c in seen.items()}
        self._weigh(np.array(list(FEATURES.values())))
        self.before: dict[str, float] = {}
        self.after: dict[str, float] = {}
        self._learn(name, total)
        for last in (False, True):
            self._relearn(*over(partial(_relabelled, lex=self, last=last)), name, total, last)

    def _learn(self, name: Counter[str], total: Counter[str]) -> None:
        self.total = total
        self.odds = {w: float(np.clip(np.log((name[w] + 0.3) / (max(0, n - name[w]) + 0.3)), -8, 4)) for w, n in total.items() if w not in TITLES and w not in PARTICLES}
        self.names = frozenset(w for w, x in self.odds.items() if x > 0)
        self.known: dict[str, tuple] = {}
        self.kind: dict[str, tuple] = {}

    def _relearn(self, rows: list, sums: Callable, name: Counter[str], total: Counter[str], last: bool) -> None:
        of: dict[str, dict[str, tuple[int, int]]] = defaultdict(dict)
        for kind, key, yes, all_ in rows:
            of[kind][key.decode()] = (yes, all_)
        n_name, n_all = of["n"].get("", (0, 0))
        base = float(np.log((n_name + 1.0) / (n_all - n_name + 1.0)))
        self.before = {w: _odds(yes, n, base) for w, (yes, n) in of["f"].items()}
        self.after = {w: _odds(yes, n, base) for w, (yes, n) in of["b"].items()}
        again = {w: n for w, (_, n) in of["a"].items()}
        self._learn(Counter({w: max(name[w], again.get(w, 0)) for w in {*name, *again}}), total)
        if last:
            self._weigh(_fitted(sums, np.array(list(FEATURES.values()))))

    def _weigh(self, weights: np.ndarray) -> None:
        # Two new words with capitals and nothing else are no name, however many of the sample's single words are.
        weights[_F["new_capital"]] = min(weights[_F["new_capital"]], NEW)
        self.weights, self.plain = weights, weights.tolist()
        self.known, self.kind = {}, {}

    def score(self, word: str) -> float | None:
        known = [self.odds[p] for p in _parts(word) if p in self.odds and self.total[p] > 1]
        return sum(known) / len(known) if known else None

    def word(self, w: str) -> tuple:
        """(lower case, title, initial, capital, features, their weighted sum, spelling that groups go by) of a word."""
        got = self.known.get(w)
        if got is None:
            low = w.lower().rstrip(".")
            ini = len(low) == 1 and w[0].isupper() and w.endswith(".")
            title = low in TITLES and (len(low) > 1 or w.endswith(".")) and (w[0].isupper() or w.endswith(".")) and not (ini and low != "m")
            f = np.zeros(len(FEATURES))
            upper = w[0].isupper()
            x = None if ini or title else self.score(w)
            if ini and not title:
                f[_F["initial"]] = 1
            elif low in PARTICLES:
                f[_F["particle"]] = 1
            elif not title:
                if x is not None:
                    f[_F["odds"]], f[_F["capital" if upper else "lower"]] = x, 1 if upper or x < 1 else 0.4
                else:
                    f[_F["new_capital" if upper else "new_lower"]] = 1
                    f[_F["short"]] = len(low) <= 2
            if len(self.known) > KEPT_WORDS:
                self.known = {}
            got = self.known[w] = (low, title, ini, upper, f.tobytes(), float(f @ self.weights), _folded(low))
        return got


class Tally:
    """Counts by kind and key that add up over texts: words as part of a cued name and in all (w), cues by shape (s); by the field's labels words of names (a), words in front
    of and behind capitals (f, b), capitals (n), and features with their offset (x): of how many (all) how many are names (yes)."""

    def __init__(self) -> None:
        self.yes: Counter = Counter()
        self.all: Counter = Counter()

    def rows(self) -> Iterator[tuple[str, bytes, int, int]]:
        for k, n in self.all.items():
            if k[0] == "x":
                key = np.append(np.frombuffer(k[1]), k[3])
                key[_EXTRA] = k[2]
                yield "x", key.tobytes(), self.yes[k], n
            else:
                yield k[0], k[1].encode(), self.yes[k], n


_EXTRA = [_F["before"], _F["after"], _F["titled"], _F["cue"]]


def _told(texts: list[str], times: list[int], t: Tally) -> None:
    """What cue phrases say of words and shapes, in texts that stand for so many (``times``) each."""
    known: dict[str, int] = {}
    count: Counter[str] = Counter()
    for text, n in zip(texts, times):
        words, hint = _WORD.findall(text), 0
        for w in words:
            h = known.get(w)
            if h is None:
                if len(known) > KEPT_WORDS:
                    known = {}
                h = known[w] = hints(w)
            hint |= h
        found, masked = segments(text, hint)
        for w in _WORD.findall(masked) if found else words:
            count[w] += n
        for m in _NAME_AFTER_CUE.finditer(masked) if hint & TOLD else ():
            for p in [p for w in _WORD.findall(m[1]) for p in _parts(w) if len(p) > 1]:
                t.yes["w", p] += n
        for f in found:
            if "phone" in f.scores or "identity_number" in f.scores:
                front = text[max(0, f.lo - 40) : f.lo]
                told = "against" if _NOT_ID.search(front[-24:]) else "identity_number" if _ID_BEFORE.search(front) else "phone" if _PHONE_CUE.search(front) else None
                if told:
                    t.all["s", f"{shape(text[f.lo : f.hi])}\x1f{told}"] += n
    for w, n in count.items():
        for p in _parts(w):
            if len(p) > 1:
                t.all["w", p] += n


def _relabelled(texts: list[str], times: list[int], t: Tally, lex: Lexicon, last: bool) -> None:
    """What the field's own labels say of words and contexts, and of features at last; ``times`` as above."""
    # What goes around the field has no names under it, and says nothing of contexts.
    screen = Finder(lex)
    some = [(Doc(x, lex, *told), c) for x, c in zip(texts, times) if (told := screen.possible(x))]
    for (d, c), y in zip(some, _labels([d for d, _ in some])):
        n, y = len(d.words), y.tolist()
        for i in range(n):
            if d.segment[i] is not None:
                continue
            is_name = bool(y[i] > 0)
            if is_name:
                for p in _parts(d.words[i]):
                    if len(p) > 1:
                        t.all["a", p] += c
            if d.upper[i] and not d.title[i]:
                keys = [("n", "")]
                if i and d.trans[i] != 2 and not y[i - 1]:
                    keys.append(("f", d.words[i - 1]))
                if i + 1 < n and d.trans[i + 1] != 2 and not y[i + 1]:
                    keys.append(("b", d.words[i + 1]))
                for k in keys:
                    t.all[k] += c
                    t.yes[k] += c * is_name
            if last and not d.title[i]:
                left, right = (y[i - 1] if i else 0), (y[i + 1] if i + 1 < n else 0)
                off = _AS_NAME[d.trans[i]][left] + (_BEFORE[d.trans[i + 1]][right] if i + 1 < n and right < 2 else 0.0)
                k = ("x", d.facts[i][4], d.extra[i], off)
                t.all[k] += c
                t.yes[k] += c * is_name


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with their offset, how many are names, how many there are, of a tally's rows of features."""
    x = np.frombuffer(b"".join(r[1] for r in rows)).reshape(len(rows), len(FEATURES) + 1)
    return x, np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)


def _sums(x: np.ndarray, yes: np.ndarray, all_: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the logistic regression at ``w``, in one array."""
    f = x[:, :-1]
    p = 1 / (1 + np.exp(-np.clip(f @ w + x[:, -1], -30, 30)))
    return np.append(f.T @ (all_ * p - yes), (f * (all_ * p * (1 - p))[:, None]).T @ f)


def _fitted(sums: Callable, start: np.ndarray, strength: float = 25.0) -> np.ndarray:
    """Weights of the penalised logistic regression: Newton steps; the penalty (``strength`` observations) pulls to ``start``. Rounded, as sums depend on their order."""
    w, n = start.copy(), len(start)
    for _ in range(25):
        s = sums(w)
        grad = s[:n] + strength * (w - start)
        step = np.linalg.solve(s[n:].reshape(n, n) + strength * np.eye(n), grad)
        size = np.abs(step).max()
        w = w - step * min(1.0, 1.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return np.round(w, 6)


_NO_WORD, _NO_EXTRA = ("\x00", False, False, False, None, 0.0, "\x00"), (0.0, 0.0, 0.0, 0.0)


class Doc:
    """The tokens of a text, their potentials, and the groups that skip potentials bind."""

    def __init__(self, text: str, lex: Lexicon, hint: int | None = None, offers: list | None = None) -> None:
        if hint is None:
            hint = hinted(text)
        found, masked = segments(text, hint, lex.shapes, offers)
        self.text, self.masked = text, masked
        tokens: list[tuple[int, int, tuple, Segment | None]] = [(f.lo, f.hi, _NO_WORD, f) for f in found]
        for m in _WORD.finditer(masked):
            w, (lo, hi) = m[0], m.span()
            if w[-1] == "." and not (len(w) == 2 and w[0].isupper()) and w[:-1].lower() not in TITLES:
                w, hi = w[:-1], hi - 1
            tokens.append((lo, hi, lex.known.get(w) or lex.word(w), None))
        if found:
            tokens.sort(key=lambda t: t[0])
        n = len(tokens)
        self.at = at = [t[:2] for t in tokens]
        self.segment = segment = [t[3] for t in tokens]
        facts = [t[2] for t in tokens]
        self.words = words = [f[0] for f in facts]
        self.title, self.initial, self.upper = title, _, upper = [f[1] for f in facts], [f[2] for f in facts], [f[3] for f in facts]
        # What separates a token from the one before: 0 space, 1 comma, 2 other; 3: it is a segment.
        self.trans = trans = [2] * n
        cues = {m.end() for m in NAME_CUE.finditer(masked)} if n and hint & TOLD else ()
        for i, (lo, _, _, s) in enumerate(tokens):
            if s is not None:
                trans[i] = 3
            elif i:
                gap = masked[end:lo]
                if gap == " ":
                    trans[i] = 0
                else:
                    trans[i] = 0 if gap == "" or gap.isspace() and "\n" not in gap else 1 if gap.strip() == "," else 2
            end = at[i][1]
        w = lex.plain
        wb, wa, wt, wc = w[_F["before"]], w[_F["after"]], w[_F["titled"]], w[_F["cue"]]
        get_before, get_after = lex.before.get, lex.after.get
        part: list[float] = []
        extra: list[tuple[float, float, float, float]] = []
        for i, f in enumerate(facts):
            if segment[i] is not None:
                part.append(NONE)
                extra.append(_NO_EXTRA)
                continue
            before = get_before(words[i - 1], 0.0) if i and trans[i] != 2 and segment[i - 1] is None else 0.0
            titled = 1.0 if i and title[i - 1] and trans[i] == 0 else 0.0
            after = get_after(words[i + 1], 0.0) if i + 1 < n and trans[i + 1] < 2 else 0.0
            cue = 1.0 if at[i][0] in cues else 0.0
            extra.append((before, after, titled, cue))
            part.append(TITLE_ALONE if title[i] else f[5] + wb * before + wa * after + wt * titled + wc * cue)
        first = part[:]
        if any(title):
            for i in range(n - 1):
                if title[i] and segment[i + 1] is None and (upper[i + 1] or part[i + 1] > 0):
                    first[i] += TITLE + 0.5
        self.unary = np.array([[0.0] * n, first, part]).T.reshape(n, 3)
        self.facts, self.extra = facts, extra
        self.groups = self._groups(n)

    def _groups(self, n: int) -> list[list[int]]:
        folded = [f[6] for f in self.facts]
        # Without repeated words, and without two segments or two words that may be one letter apart, there are none.
        long = {w for u, w in zip(self.upper, folded) if u and len(w) >= 6}
        if len(set(folded)) == n and len(long) < 2:
            return []
        count = Counter(folded)
        same: dict[object, list[int]] = defaultdict(list)
        similar: dict[str, str] = {}
        for i in range(n):
            s = self.segment[i]
            if s is not None:
                same[s.key].append(i)
                continue
            w = folded[i]
            if len(w) > 2 and (count[w] > 1 or w in long):
                same["w", w].append(i)
                if self.upper[i] and len(w) >= 6:
                    similar.setdefault(w, w)
            # An initial, and a given name with it, before the same surname.
            if i + 1 < n and count[folded[i + 1]] > 1 and self.segment[i + 1] is None and self.trans[i + 1] == 0 and w and (self.initial[i] or self.upper[i]):
                same["i", w[0], folded[i + 1]].append(i)
        if len(similar) > 1:  # words one letter apart are one group
            forms: dict[str, str] = {}
            up = similar

            def top(w: str) -> str:
                while up[w] != w:
                    w = up[w]
                return w

            # Words one letter apart have their first or their last half letters in common.
            halves = Counter(k for w in up for k in ((0, w[: len(w) // 2 - 1]), (1, w[-(len(w) // 2 - 1) :])))
            for w in list(up):
                if halves[0, w[: len(w) // 2 - 1]] < 2 and halves[1, w[-(len(w) // 2 - 1) :]] < 2 and not any(abs(len(v) - len(w)) == 1 for v in up):
                    continue
                for k in {w, *(w[:j] + w[j + 1 :] for j in range(len(w)))}:
                    other = forms.setdefault(k, w)
                    a, b = top(w), top(other)
                    if a != b:
                        up[b] = a
            for w in up:
                if top(w) != w:
                    same["w", top(w)] += same.pop(("w", w), [])
        return [g for g in same.values() if len(g) > 1]

    def apart(self) -> bool:
        """Whether in no text of this one's form two segments are equal."""
        found = [s for s in self.segment if s is not None]
        if len(found) < 2:
            return True
        nines = self.text.encode("utf-8", "surrogatepass").translate(_TO_9).decode("utf-8", "surrogatepass")
        return len({Segment(nines, s.lo, s.hi, s.scores).key for s in found}) == len(found)

    def types(self) -> dict[int, str | None]:
        """The type of each segment: its potentials and, of equal segments, those of all through their shared variable; None: no item."""
        if not any(self.segment[g[0]] is not None for g in self.groups):
            return {i: max(FORM, key=lambda k: s.scores.get(k, NONE)) if max(s.scores.values()) > 0 else None for i, s in enumerate(self.segment) if s is not None}
        names = [None, *FORM]
        own = {i: np.array([0.0, *(s.scores.get(k, NONE) for k in FORM)]) for i, s in enumerate(self.segment) if s is not None}
        final = {i: v.copy() for i, v in own.items()}
        for g in self.groups:
            if self.segment[g[0]] is not None:
                to = np.array([_through(own[i]) for i in g])
                for i, m in zip(g, to):
                    final[i] += _through(to.sum(0) - m)
        return {i: names[int(v.argmax())] for i, v in final.items()}

    def decode(self, labels: np.ndarray) -> list[tuple[int, int, str]]:
        segs: list[list[int]] = []
        for i, y in enumerate(labels):
            if y == 2 and segs and segs[-1][-1] == i - 1:
                segs[-1].append(i)
            elif y:
                segs.append([i])
        merged: list[list[int]] = []
        for s in segs:
            plain = [i for i in s if not self.title[i] and not self.initial[i]]
            if merged and self.trans[s[0]] == 1 and merged[-1][-1] == s[0] - 1 and not any(self.title[i] for i in s):
                before = merged[-1]
                # A surname alone, a comma, and a given name or initials.
                if sum(not self.title[i] for i in before) == 1 and not any(self.title[i] for i in before) and len(plain) <= 1:
                    merged[-1] = before + s
                    continue
            merged.append(s)
        out = [(*self.at[i], kind) for i, kind in self.types().items() if kind]
        for s in merged:
            named = sum(not self.title[i] and not self.initial[i] for i in s)
            if named and len(s) >= 2:
                out.append((self.at[s[0]][0], self.at[s[-1]][1], "person_name"))
        return sorted(out)


# Chain potentials by separation: rows from O, B, I to O, B, I. The last: to a segment, of which only O's column counts.
_CHAIN = np.array(
    [
        [[0.5, -0.7, -9.0], [-0.4, -2.5, 1.6], [0.2, -2.5, 0.6]],
        [[0.3, -0.5, -9.0], [0.2, 0.2, -9.0], [0.3, -0.3, -9.0]],
        [[0.3, -0.5, -9.0], [0.0, -0.3, -9.0], [0.3, -0.3, -9.0]],
        [[0.3, -9.0, -9.0], [0.0, -9.0, -9.0], [0.4, -9.0, -9.0]],
    ]
)
# What the chain adds to a token as part of a name: by the label in front, by the one behind (O or B).
_AS_NAME = [[float(max(c[left, 1], c[left, 2]) - c[left, 0]) for left in range(3)] for c in _CHAIN]
_BEFORE = [[float(c[2, right] - c[0, right]) for right in range(2)] for c in _CHAIN]
# What the chain can add to a name of two or more tokens at most, a token, against O throughout: at the start and end of a text B to I gains 1.1, each further I 0.1.
_MOST_CHAIN = 0.6
_SKIP = 2.4


def _through(x: np.ndarray) -> np.ndarray:
    """A message through a skip potential."""
    new = _logsum(x[..., :, None] + _SKIP * np.eye(x.shape[-1]), -2)
    return new - new.mean(-1, keepdims=True)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def propagate(docs: list[Doc]) -> list[np.ndarray]:
    """Labels of the tokens of texts of similar length: loopy belief propagation, then the best sequence."""
    n, width = len(docs), max(len(d.words) for d in docs)
    node = np.zeros((n, width, 3))
    node[:, :, 1:] = NONE
    pair = np.zeros((n, width), np.int8) + 2
    token, group, k = [], [], 0
    for j, d in enumerate(docs):
        m = len(d.words)
        node[j, :m], pair[j, :m] = d.unary, d.trans
        for g in d.groups:
            if d.segment[g[0]] is None:
                token += [j * width + i for i in g]
                group += [k] * len(g)
                k += 1
    e, g = np.array(token, np.int64), np.array(group, np.int64)
    message = np.zeros((len(e), 2))  # from a group's variable to a token: of being none, of being part of a name
    seen = node
    for r in range(ROUNDS if len(e) else 0):
        seen = node + _spread(e, message, n, width)
        fwd, bwd = np.zeros_like(seen), np.zeros_like(seen)
        for t in range(1, width):
            fwd[:, t] = _logsum((seen[:, t - 1] + fwd[:, t - 1])[:, :, None] + _CHAIN[pair[:, t]], 1)
            fwd[:, t] -= fwd[:, t].max(1, keepdims=True)
        for t in range(width - 2, -1, -1):
            bwd[:, t] = _logsum((seen[:, t + 1] + bwd[:, t + 1])[:, None, :] + _CHAIN[pair[:, t + 1]], 2)
            bwd[:, t] -= bwd[:, t].max(1, keepdims=True)
        flat = (seen + fwd + bwd).reshape(-1, 3)[e]
        # What a token tells its group: its belief without what the group told it; then what the others tell the token.
        to = _through(np.stack([flat[:, 0], _logsum(flat[:, 1:], 1)], 1) - message)
        all_ = np.zeros((k, 2))
        np.add.at(all_, g, to)
        new = _through(all_[g] - to)
        if r >= 8:
            new = (new + message) / 2
        moved = np.abs(new - message).max()
        message = new
        if moved < REST:
            break
    if len(e):
        seen = node + _spread(e, message, n, width)
    best, back = seen[:, 0].copy(), np.zeros((n, width, 3), np.int8)
    for t in range(1, width):
        x = best[:, :, None] + _CHAIN[pair[:, t]]
        back[:, t] = x.argmax(1)
        best = x.max(1) + seen[:, t]
    y = np.zeros((n, width), np.int8)
    y[:, -1] = best.argmax(1)
    for t in range(width - 1, 0, -1):
        y[:, t - 1] = back[np.arange(n), t, y[:, t]]
    return [y[j, : len(d.words)] for j, d in enumerate(docs)]


def _spread(e: np.ndarray, message: np.ndarray, n: int, width: int) -> np.ndarray:
    both = np.zeros((n * width, 2))
    np.add.at(both, e, message)
    return both.reshape(n, width, 2)[:, :, [0, 1, 1]]


def _labels(docs: list[Doc]) -> list[np.ndarray]:
    """Labels of texts of any length, taken in groups of similar length."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(docs)
    order = sorted((i for i, d in enumerate(docs) if d.words), key=lambda i: (bool(docs[i].groups), len(docs[i].words)))
    i = 0
    while i < len(order):
        first = docs[order[i]]
        j, limit = i, max(8, len(first.words) * 3 // 2)
        while j < len(order) and j - i < 2000 and len(docs[order[j]].words) <= limit and bool(docs[order[j]].groups) == bool(first.groups):
            j += 1
        for k, y in zip(order[i:j], propagate([docs[k] for k in order[i:j]])):
            out[k] = y
        i = j
    return out


class Finder:
    """Items of texts; texts of one form are read once while it is kept."""

    def __init__(self, lex: Lexicon, screen: bool = True) -> None:
        self.lex, self.known, self.size, self.screen = lex, {}, 0, screen

    def _facts(self, w: str) -> tuple[int, float, float, float, bool, str, bool]:
        """(hint, own weighted sum, what it can add to a word behind, to one in front, whether a title, spelling that groups go by, whether a capital) of a word."""
        bare = w[:-1] if w.endswith(".") and not (len(w) == 2 and w[0].isupper()) and w[:-1].lower() not in TITLES else w
        low, title, _, upper, _, s, folded = self.lex.word(bare)
        wt = self.lex.plain
        if len(self.lex.kind) > KEPT_WORDS:
            self.lex.kind.clear()
        got = self.lex.kind[w] = (hints(w), s, max(0.0, wt[_F["before"]] * self.lex.before.get(low, 0.0)), max(0.0, wt[_F["after"]] * self.lex.after.get(low, 0.0)), title, folded, upper)
        return got

    def _hopeless(self, facts: list[tuple], text: str, hint: int) -> bool:
        """Whether no token can gain by being part of a name: its own sum, its neighbours, a cue, its groups and the chain at their highest.

        A group's message favours a label by ``_SKIP`` at most; a token is in two groups at most.
        """
        n = len(facts)
        bound = _MOST_CHAIN + (max(0.0, self.lex.plain[_F["cue"]]) if hint & TOLD and NAME_CUE.search(text) else 0.0)
        names = [f[5] for f in facts]
        once = len(set(names)) == n
        count = {} if once else Counter(names)
        long = None  # whether two words may be one letter apart; looked at if it matters
        last = 0.0
        for i, f in enumerate(facts):
            if f[4]:
                return False
            s = f[1] + last + bound
            if i + 1 < n:
                s += facts[i + 1][3]
                if not once and f[6] and count[names[i + 1]] > 1:
                    s += _SKIP
            if s > -_SKIP:
                if s > 0 or (not once and count[names[i]] > 1):
                    return False
                if f[6] and len(f[5]) >= 6:
                    if long is None:
                        long = sum(f[6] and len(f[5]) >= 6 for f in facts) > 1
                    if long:
                        return False
            last = f[2]
        return True

    def possible(self, text: str) -> tuple[int, list] | None:
        """The hints of a text's words and its candidates, or None if it can't hold an item."""
        get = self.lex.kind.get
        facts = [get(w) or self._facts(w) for w in _WORD.findall(text)]
        hint = 0
        for f in facts:
            hint |= f[0]
        offers = candidates(text, hint)
        if self.screen and not offers and not hint & (PLACED | CUED) and self._hopeless(facts, text, hint):
            return None
        return hint, offers

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        if self.size > KEPT_BYTES:
            self.known, self.size = {}, 0
        forms = [same(t) if t else b"" for t in texts]
        fresh = {k: t for t, k in zip(texts, forms) if k and k not in self.known}
        todo: list[tuple[bytes, Doc, tuple]] = []
        for k, t in fresh.items():
            told = self.possible(t)
            self.known[k] = []
            self.size += len(k) + FORM_BYTES
            if told is not None:
                todo.append((k, Doc(t, self.lex, *told), told))
        for (k, d, told), y in zip(todo, _labels([d for _, d, _ in todo])):
            self.known[k] = d.decode(y) if d.apart() else (told, y)
        out, own = [], {}
        for t, k in zip(texts, forms):
            items = self.known[k] if t else []
            if isinstance(items, tuple):  # what segments are equal differs by text
                told, y = items
                items = own[t] = own.get(t) or Doc(t, self.lex, *told).decode(y)
            out.append(items)
        return out


def redacted(text: str | None, items: list[tuple[int, int, str]]) -> str | None:
    if not items:
        return text
    out, at = [], 0
    for lo, hi, kind in items:
        out += [text[at:lo], PLACEHOLDER[kind]]
        at = hi
    return "".join([*out, text[at:]])


def fit(texts: DataFrame) -> Lexicon:
    """Fits on all distinct texts (column ``_t``), read by form. Counts add up in partitions, then by key; the driver gets words that stand in the texts more than once, contexts, shapes
    and sums of the regression."""
    spark = texts.sparkSession
    scratch = Scratch(spark, "fit")
    own = texts.filter("_t <> ''").distinct()
    own = scratch.keep(own.groupBy(F.regexp_replace("_t", SAME_AS_9, "9").alias("_t")).agg(F.count(F.lit(1)).alias("n")))

    def over(read: Callable) -> tuple[list, Callable]:
        sent = spark.sparkContext.broadcast(read)

        def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = Tally()
            for b in parts:
                sent.value(b.column(0).to_pylist(), b.column(1).to_pylist(), t)
                if len(t.all) > KEPT_COUNTS:
                    yield _batch(t)
                    t = Tally()
            yield _batch(t)

        rows = own.mapInArrow(count, "kind string, key binary, yes bigint, n bigint").groupBy("kind", "key").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n"))
        # A word that stands there once is as one that doesn't.
        rows = scratch.keep(rows.filter("kind <> 'w' or n > 1"))
        features = rows.filter("kind = 'x'")

        def sums(w: np.ndarray) -> np.ndarray:
            def part(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = sum((_sums(*_arrays([(None, *r.values()) for r in b.to_pylist()]), w) for b in parts), np.zeros(len(w) * (len(w) + 1)))
                yield pa.RecordBatch.from_pydict({"s": pa.array([out.tolist()])})

            return np.sum([r["s"] for r in features.select("key", "yes", "n").mapInArrow(part, "s array<double>").collect()] or [np.zeros(len(w) * (len(w) + 1))], axis=0)

        return [(r["kind"], bytes(r["key"]), r["yes"], r["n"]) for r in rows.filter("kind <> 'x'").collect()], sums

    return Lexicon(over=over)


def _batch(t: Tally) -> pa.RecordBatch:
    kind, key, yes, n = zip(*t.rows()) if t.all else ((), (), (), ())
    return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.string()), "key": pa.array(key, pa.binary()), "yes": pa.array(yes, pa.int64()), "n": pa.array(n, pa.int64())})


def personal(df: DataFrame, keys: list[str], fields: dict[str, Column], with_text: bool = False) -> DataFrame:
    """Rows (``keys``, ``field``, ``pii_type``, ``seq``) of the items in the named texts; with ``with_text`` instead (``keys``, ``field``, ``text``), all texts redacted."""
    flat = df.select(*keys, *[c.alias(f"_f{i}") for i, c in enumerate(fields.values())])
    n = len(fields)
    some = None
    for i in range(n):
        part = flat.select(F.col(f"_f{i}").alias("_t"))
        some = part if some is None else some.unionByName(part)
    lex = fit(some)
    sent = df.sparkSession.sparkContext.broadcast(Finder(lex))  # a worker keeps it, with the forms it knows, from task to task
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
    names = list(fields)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for b in parts:
            cols: list[list] = [[] for _ in range(4)]
            for i, name in enumerate(names):
                texts = b.column(len(keys) + i).to_pylist()
                for row, (t, items) in enumerate(zip(texts, f.find(texts))):
                    if with_text:
                        if t is not None:
                            for c, v in zip(cols, (row, name, redacted(t, items), None)):
                                c.append(v)
                        continue
                    seen: Counter[str] = Counter()
                    for _, _, kind in items:
                        seen[kind] += 1
                        for c, v in zip(cols, (row, name, kind, seen[kind])):
                            c.append(v)
            at = pa.array(cols[0], pa.int64())
            out = {k: b.column(j).take(at) for j, k in enumerate(keys)} | {"field": pa.array(cols[1], pa.string())}
            out |= {"text": pa.array(cols[2], pa.string())} if with_text else {"pii_type": pa.array(cols[2], pa.string()), "seq": pa.array(cols[3], pa.int64())}
            if len(at):
                yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", field string, " + ("text string" if with_text else "pii_type string, seq bigint")
    return flat.mapInArrow(work, schema)
