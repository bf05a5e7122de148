"""Problem 6: personal information in free text, found and replaced by typed placeholders.

Semi-Markov conditional random field. Format rules, the name lexicon and titles propose candidate segments of bounded
length; a segment is scored as a whole by its form, its lexicon kinds, and the words around it; everything else is
outside at score 0. Dynamic programming over all candidates of a text chooses boundaries and types jointly. The
weights are fitted here, by gradient ascent on the conditional likelihood of SENTENCES generated examples (a documented
bound): filled phrases of our own with their segments known, and phrases that look alike but hold nothing personal.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.session import arrow_map, table

KINDS = ("email", "phone", "national_id", "address", "name")
SENTENCES, EPOCHS, RATE, DECAY = 3600, 15, 0.25, 1e-4
#: Longest name in tokens.
LONGEST = 4
#: Name parts are broadcast with the model; more than this is refused.
LEXICON_ROWS = 1_000_000

_EMAIL = re.compile(r"[^\W_](?:[\w.%+-]*[\w%+-])?@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_NUMBER = re.compile(r"(?<![\w.,/:+-])(?:\(?\+?\d|\+\(?\d)(?:[ ./()-]{0,2}\d){6,17}(?![\w])(?!\.\d)(?!-\w)")
_CODE = re.compile(r"(?<![\w.,/:#=-])(?:[A-Z]{1,3}[ -]?\d(?:[ -]?\d){4,9}(?:[ -]?[A-Z])?|\d{2} ?\d{6} ?[A-Z] ?\d{3}|\d{7,8}[ -]?[A-Z])(?![\w-])")
_CODE_FOLDED = re.compile(_CODE.pattern, re.I)
_CAP = "[^\\W\\d_a-zß-öø-ÿ][\\w’-]*"
_POSTAL = rf"(?:, ?(?:[A-Z]{{1,2}}-)?\d{{4,5}} {_CAP}(?: {_CAP})?)"
# fixed values: words that make a street
_STREETS = (
    ("en", rf"\d{{1,5}}[a-z]? (?:{_CAP} ){{1,3}}(?:Street|Lane|Road|Avenue|Drive|Square|Court|Close|Terrace|Way|Place|Hill|Mews|Crescent|Gardens|Grove|Row|Boulevard|(?:St|Rd|Ave|Ln|Blvd)\.?)(?!\w)"),
    ("de", r"[^\W\d_][^\W\d_-]*(?:straße|strasse|weg|gasse|platz|allee|ufer|ring|damm)\s\d{1,4}(?: ?[a-z]\b)?"),
    ("de2", rf"(?:{_CAP}[ -])(?:Straße|Strasse|Weg|Gasse|Platz|Allee|Ufer|Ring|Damm)\s\d{{1,4}}(?: ?[a-z]\b)?"),
    ("fr", rf"\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|impasse|allée|chemin|quai)(?: (?:de la|de l’|de l'|du|des|de|d’))?(?: ?{_CAP}){{1,3}}"),
    ("it", rf"(?:Via|Viale|Piazza|Corso|Largo|Rua)(?: (?:della|delle|dei|del|di|da|do|dos))?(?: {_CAP}){{1,3}},? ?\d{{1,4}}"),
    ("en2", rf"(?:{_CAP} ){{1,3}}(?:Street|Lane|Road|Avenue|Drive|Square|Court|Terrace|Mews|Crescent|Gardens) \d{{1,4}}[a-z]?(?!\w)"),
    ("es", rf"(?:Calle|Avenida|Plaza|Paseo|Camino)(?: (?:de las|de los|de la|del|de))?(?: {_CAP}){{1,3}}, ?\d{{1,4}}"),
)
_STREET = {k: re.compile(f"(?<!\\w){p}") for k, p in _STREETS}
_STREET_FOLDED = {k: re.compile(f"(?<!\\w){p}", re.I) for k, p in _STREETS}
_ZIP, _ZIP_FOLDED = re.compile(_POSTAL), re.compile(_POSTAL.replace(_CAP, r"[^\W\d_][\w’-]*"), re.I)
# fixed values: what a street name holds, in lower case; titles, and words that are no part of a name
_HINTS = {
    "en": (" Street", " Lane", " Road", " Avenue", " Drive", " Square", " Court", " Close", " Terrace", " Way", " Place", " Hill", " Mews", " Crescent", " Gardens", " Grove", " Row", " Boulevard", " St", " Rd", " Ave", " Ln", " Blvd"),
    "en2": (" Street ", " Lane ", " Road ", " Avenue ", " Drive ", " Square ", " Court ", " Terrace ", " Mews ", " Crescent ", " Gardens "),
    "it": ("Via ", "Viale ", "Piazza ", "Corso ", "Largo ", "Rua "),
    "de": "straße |strasse |weg |gasse |platz |allee |ufer |ring |damm ".split("|"),
    "de2": "Straße |Strasse |Weg |Gasse |Platz |Allee |Ufer |Ring |Damm ".split("|"),
    "fr": " rue | avenue | boulevard | place | impasse | allée | chemin | quai ".split("|"),
    "es": "Calle |Avenida |Plaza |Paseo |Camino ".split("|"),
}
_HINTS_FOLDED = {k: [h.lower() for h in hs] for k, hs in _HINTS.items()}
_STREET_WORD = re.compile(r"(?:Street|Lane|Road|Avenue|Drive|Square|Court|Close|Terrace|Way|Place|Hill|Mews|Crescent|Gardens|Grove|Row|Boulevard|Calle|Avenida|Plaza|Paseo|Camino|Via|Viale|Piazza|Straße|Strasse|Weg|Gasse|Platz|Allee|Ring)\b")
_STREET_LINK = (" du ", " la ", "del ", "las ", "los ", "des ")
TITLES = frozenset("dr prof mr mrs sra sr dra srta m hr fr st ms miss mx mme mlle madame monsieur herr herrn frau señor señora doña don sir lady".split())
NOT_NAMES = frozenset(
    # function words and words that open sentences and lines, in the four languages
    "the a an and or but if when while until before after since as at by for from in into of on to with without not no nobody everyone "
    "he she it they we you i this that these those my our your his her their what why how who which where here there please dear hi hello "
    "is are was were do does did ask tell call ring see meet note send write speak talk forward contact compared according every user all "
    "der die das den dem des ein eine einen einem und oder aber wenn weil seit mit von zu zum zur bei auf an für laut nach bitte im am "
    "wir ich sie er es ihr niemand warum siehe wer was wie wo hallo liebe lieber sehr mein unser "
    "le la les un une des du de au aux et ou mais si quand avec sans sur dans pour par selon après avant je tu il elle nous vous on ne "
    "voir pourquoi qui que personne cher chère bonjour merci mon notre "
    "el los las una del al y o pero cuando con sin sobre para por según tras desde en yo tú nosotros nadie véase quién qué hola gracias mi "
    "mail e-mail email tel tél telefon phone mobile fax address adresse anschrift dirección street".split()
)
_AFTER_TITLE = re.compile(r"\.?[ \t]+(?=[^\W\d_])")
_CAPITAL = re.compile(_CAP)
_PLAIN = "[^\\W\\d_a-zß-öø-ÿ][^\\W\\d_A-ZÀ-ÖØ-Þ]{2,}(?![\\w’-])"
_CAPITALS = re.compile(rf"(?<![\w’'.-]){_PLAIN}(?= (?:[^\W\d_a-zß-öø-ÿ]\. )?{_PLAIN})")
_IS_PLAIN = re.compile(rf"(?:{_PLAIN}|.\.)\.?")
_ANY = re.compile(r"[^\W\d_][\w’-]*")
_TOKEN = re.compile(r"[^\W\d_][\w’-]*\.?|,")
_LAST_WORDS = re.compile(r"(\w+)?\W*?(\w+|[—–])?[^\w—–]*$")
_NEXT_WORD = re.compile(r"\s*(\w+|[^\w\s])?")


def _around(text: str, start: int, end: int) -> tuple[str, str, str, bool]:
    """(second word before, word before, what follows, whether a line or sentence begins here)."""
    m = _LAST_WORDS.search(text, max(0, start - 28), start)
    two, one = (m.group(1) or "").lower(), (m.group(2) or "").lower()
    k = start - 1
    while k >= 0 and text[k] in " \t\"'“„«(":
        k -= 1
    first = k < 0 or text[k] in ".!?\n。]:|*-—" and not (text[k] == "." and one in _DOTTED)
    if k < 0 or text[k] == "\n":
        two = one = "^"
    line = text.find("\n", end)
    n = _NEXT_WORD.match(text, end, line if line >= 0 else len(text))
    return two, one, (n.group(1) or "$").lower(), first


_DOTTED = frozenset("dr prof mr mrs sra sr dra srta m hr fr st".split())


class Lexicon:
    def __init__(self, rows: list[tuple[str, str]]):
        self.kind: dict[str, str] = {}
        for part, kind in rows:
            if part:
                old = self.kind.get(part)
                self.kind[part] = "B" if old and old != kind[0].upper() else kind[0].upper()
        self.folded = {k.lower(): v for k, v in self.kind.items()}
        ends: dict[str, int] = {}
        for part, kind in self.kind.items():
            if kind == "F" and len(part) > 4:
                ends[part[-3:].lower()] = ends.get(part[-3:].lower(), 0) + 1
        self.endings = {e for e, n in ends.items() if n >= 3}

    def of(self, word: str, folded: bool) -> str:
        if len(word) == 2 and word[1] == "." or len(word) == 1:
            return "I"
        word = word.rstrip(".")
        kind = self.folded.get(word.lower()) if folded else self.kind.get(word)
        if kind:
            return kind
        if word.lower() in NOT_NAMES or word.lower() in TITLES:
            return "W"
        return "E" if word[-3:].lower() in self.endings and len(word) > 4 else "U"


def _names(text: str, lexicon: Lexicon, folded: bool, out: list) -> None:
    anchors, titled = {}, set()
    known = lexicon.folded if folded else lexicon.kind
    for m in (_ANY if folded else _CAPITAL).finditer(text):
        word = m.group()
        if word in known or folded and word.lower() in known:
            anchors.setdefault(m.start())
        elif word.lower() in TITLES and not (len(word) == 1 and m.start() in titled) and (n := _AFTER_TITLE.match(text, m.end())) and (folded or text[n.end()].isupper()):
            anchors[n.end()] = None
            titled.add(n.end())
    if not folded:
        # two or more capitalised words in a row may be a person that the lexicon does not know
        for m in _CAPITALS.finditer(text):
            if m.start() not in anchors:
                anchors[m.start()] = None
    if not anchors:
        return
    seen = set()
    for at in anchors:
        # the tokens of the line around the anchor that may belong to a name
        left = text.rfind("\n", 0, at) + 1
        left = max(left, at - 48)
        right = text.find("\n", at)
        right = min(len(text) if right < 0 else right, at + 64)
        tokens = [m.span() for m in _TOKEN.finditer(text, left, right)]
        here = next((k for k, t in enumerate(tokens) if t[0] == at), None)
        if here is None:
            continue
        for i in range(here, max(-1, here - LONGEST), -1):
            if i < here and (tokens[i + 1][0] - tokens[i][1] > 1 or at in titled):
                break
            for j in range(here, min(len(tokens), i + LONGEST + 1)):
                if j > here and tokens[j][0] - tokens[j - 1][1] > 1:
                    break
                span = tokens[i : j + 1]
                words = [text[a:b] for a, b in span]
                if words[0] == "," or len([w for w in words if w != ","]) > LONGEST:
                    break
                if j > here and words[-1] != "," and not folded and not words[-1][0].isupper():
                    break
                if not folded and not words[0][0].isupper():
                    break
                if words[-1] == ",":
                    continue
                start, end = span[0][0], span[-1][1]
                if text[end - 1] == "." and len(words[-1]) != 2:
                    end -= 1
                elif text[end - 1] == "." and len(words) > 1:
                    pass
                if (start, end) in seen:
                    continue
                seen.add((start, end))
                kinds = ["," if w == "," else lexicon.of(w, folded) for w in words]
                if "W" in kinds:
                    break
                if all(k in "UE,I" for k in kinds) and start not in titled and (folded or at != start or not 2 <= sum(k in "UE" for k in kinds) <= 3 or not all(map(_IS_PLAIN.fullmatch, words))):
                    continue
                out.append((start, end, "name", _name_features(text, start, end, words, kinds, start in titled, lexicon, folded, tokens, i, j)))
                if text[span[-1][1] - 1] == "." and len(words[-1]) != 2:
                    break


def _name_features(text, start, end, words, kinds, title, lexicon, folded, tokens, i, j) -> list[str]:
    shape = "".join(kinds)
    two, one, after, first = _around(text, start, end)
    before_kind = after_kind = "-"
    if i and tokens[i][0] - tokens[i - 1][1] <= 1 and text[tokens[i - 1][0] : tokens[i - 1][1]] != ",":
        w = text[tokens[i - 1][0] : tokens[i - 1][1]]
        before_kind = lexicon.of(w, folded) if folded or w[0].isupper() else "l"
        if before_kind == "U" and folded:
            before_kind = "l"
    if j + 1 < len(tokens) and text[end : end + 1] == " " and tokens[j + 1][0] - end == 1:
        w = text[tokens[j + 1][0] : tokens[j + 1][1]]
        after_kind = lexicon.of(w, folded) if folded or w[0].isupper() else "l"
        if after_kind == "U" and folded:
            after_kind = "l"
    elif text[end : end + 2] == ", " and j + 2 < len(tokens):
        w = text[tokens[j + 2][0] : tokens[j + 2][1]]
        after_kind = "," + (lexicon.of(w, folded) if folded or w[0].isupper() else "l")
    common = any(w.rstrip(".").lower() in COMMON for w in words)
    t = "T" if title else "n"
    lone = len(kinds) == 1
    out = [f"s={shape}", f"s={shape}{t}", f"b={before_kind}{shape[0]}", f"a={after_kind}{shape[-1]}", f"n={len(kinds)}{t}", f"f={folded}{shape}"]
    if all(k in "UEI" for k in kinds) and not title:
        line = text[text.rfind("\n", 0, start) + 1 : start].lstrip()
        digits = (text[max(0, start - 2) : start].rstrip()[-1:].isdigit(), text[end : end + 3].lstrip(", ")[:1].isdigit())
        out += [f"ud={digits}", f"uh={line[:1] == '#'}", f"ul={_STREET_WORD.search(text, start, end) is not None}{text[max(0, start - 4) : start] in _STREET_LINK}"]
        out += [f"up={one}", f"ux={after}", f"ub={first}{one in NOT_NAMES}{after in NOT_NAMES}", f"uu={first}{shape}"]
    if lone:
        out += [f"c={common}{first}{t}", f"p={one}", f"x={after}", f"cx={common}{after}", f"cp={common}{one}", f"la={common}{after_kind}{t}"]
    return out


# fixed values: name parts that are also common words
COMMON = frozenset("mark april rose grant may will grace frank hope dean august june summer faith joy jack bill rob art max pat sue ray ruby iris lily violet daisy ivy olive jasmin".split())


def _form(s: str) -> str:
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))


def _numbers(text: str, folded: bool, out: list) -> None:
    spans = {m.span() for m in _NUMBER.finditer(text)}
    for m in (_CODE_FOLDED if folded else _CODE).finditer(text):
        if sum(c.isdigit() for c in m.group()) >= 5:
            spans.add(m.span())
    for start, end in spans:
        s = text[start:end]
        two, one, after, _ = _around(text, start, end)
        form = _form(s.upper())
        digits = sum(c.isdigit() for c in s)
        letters = any(c.isalpha() for c in s)
        lead = s[0] if s[0] in "+(" else s[:2] if s[0] == "0" else "A" if s[0].isalpha() else "9"
        groups = "-".join(str(len(g)) for g in re.findall(r"[A-Z0-9]+", form))
        base = [f"F={form}", f"g={groups}", f"d={digits}{letters}", f"l={lead}{letters}", f"sep={''.join(sorted(set(re.findall(r'[^A-Z0-9]', form))))}{lead}", f"p={one}", f"q={two}", f"x={after}", f"pl={one}{letters}"]
        for kind in ("phone", "national_id"):
            out.append((start, end, kind, base))


def _addresses(text: str, folded: bool, out: list) -> None:
    low = text.lower() if folded else text
    matches: dict[tuple[int, int], str] = {}
    for kind, hints in (_HINTS_FOLDED if folded else _HINTS).items():
        pattern = (_STREET_FOLDED if folded else _STREET)[kind]
        for hint in hints:
            at = low.find(hint)
            while at >= 0:
                for m in pattern.finditer(text, max(0, at - 80), min(len(text), at + 110)):
                    matches.setdefault(m.span(), kind)
                at = low.find(hint, at + 1)
    for (start, end), kind in matches.items():
        two, one, after, _ = _around(text, start, end)
        rest = (_ZIP_FOLDED if folded else _ZIP).match(text, end)
        base = [f"k={kind}", f"kf={kind}{folded}", f"p={one}"]
        out.append((start, end, "address", [*base, f"z=no{rest is not None}", f"x={after}"]))
        if rest:
            out.append((start, rest.end(), "address", [*base, "z=yes"]))
            # the second word of a town may already be the next sentence
            head, _, tail = rest.group().rpartition(" ")
            if re.search(r"\d \S+$", head):
                out.append((start, rest.end() - len(tail) - 1, "address", [*base, "z=one"]))


def candidates(text: str, lexicon: Lexicon) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of every segment that may hold personal information."""
    out: list = []
    folded = text.islower() or text.isupper()
    if "@" in text:
        for m in _EMAIL.finditer(text):
            tail = m.group().rpartition(".")[2]
            out.append((*m.span(), "email", [f"t={len(tail)}{tail.isalpha()}", f"p={text[max(0, m.start() - 1) : m.start()]}", "e"]))
    _numbers(text, folded, out)
    _addresses(text, folded, out)
    _names(text, lexicon, folded, out)
    return out


def _scored(cands, weights) -> list[tuple[int, int, str, float]]:
    get = weights.get
    return [(s, e, kind, get(kind, 0.0) + sum(get(f"{kind}|{f}", 0.0) for f in feats)) for s, e, kind, feats in cands]


def decode(text: str, lexicon: Lexicon, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best set of segments that do not overlap."""
    cands = candidates(text, lexicon)
    if not cands:
        return []
    scored = sorted((c for c in _scored(cands, weights) if c[3] > 0), key=lambda c: (c[1], c[0]))
    ends, best, taken = [-1], [0.0], [None]
    import bisect

    for s, e, kind, w in scored:
        k = bisect.bisect_right(ends, s) - 1
        if best[k] + w > best[-1]:
            ends.append(e), best.append(best[k] + w), taken.append((s, e, kind, k))
    found, k = [], len(ends) - 1
    while k > 0:
        s, e, kind, before = taken[k]
        found.append((s, e, kind))
        k = before
    return found[::-1]


def _gradient(cands, gold: set, weights) -> dict[int, float]:
    """Expected minus observed count of each candidate, by the forward-backward sums of the lattice."""
    scored = _scored(cands, weights)
    order = sorted(range(len(scored)), key=lambda k: (scored[k][1], scored[k][0]))
    cuts = sorted({0, *(c[0] for c in scored), *(c[1] for c in scored)})
    index = {p: k for k, p in enumerate(cuts)}
    by_end: dict[int, list[int]] = {}
    for k in order:
        by_end.setdefault(index[scored[k][1]], []).append(k)

    def add(a: float, b: float) -> float:
        hi, lo = (a, b) if a > b else (b, a)
        return hi + math.log1p(math.exp(lo - hi)) if hi > -1e300 else hi

    fwd = [0.0] * len(cuts)
    for p in range(1, len(cuts)):
        v = fwd[p - 1]
        for k in by_end.get(p, ()):
            v = add(v, fwd[index[scored[k][0]]] + scored[k][3])
        fwd[p] = v
    bwd = [0.0] * len(cuts)
    by_start: dict[int, list[int]] = {}
    for k in order:
        by_start.setdefault(index[scored[k][0]], []).append(k)
    for p in range(len(cuts) - 2, -1, -1):
        v = bwd[p + 1]
        for k in by_start.get(p, ()):
            v = add(v, bwd[index[scored[k][1]]] + scored[k][3])
        bwd[p] = v
    total = fwd[-1]
    return {k: math.exp(min(0.0, fwd[index[s]] + w + bwd[index[e]] - total)) - ((s, e, kind) in gold) for k, (s, e, kind, w) in enumerate(scored)}


def _invented(rng: random.Random, lexicon: Lexicon) -> str:
    return "".join(rng.choice(["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "dr", "fl", "gr", "pl", "tr"]) + rng.choice("aeiouy") for _ in range(rng.randint(2, 3))).capitalize() + rng.choice(["quist", "owski", "bane", "yard", "grove", "eard", "son", "sen", "mann", "ez", "wood", "ner"])


# phrases of the generated examples, written for this purpose; {N} a name, {G} a given name alone, {P} a phone, {I} an
# identity number, {A} an address, {E} an email address, {T} titled family name, {w} any word, {W} any capitalised
# word, {C} a name part that is a common word
PHRASES = (
    # names
    "Speak to {N} before the {w} ends.", "I had lunch with {G}.", "{N} presents the {w} on Monday.", "Contact person: {N}", "Regards, {N}", "{G} is on holiday.", "The contract was signed by {N}.",
    "Forward it to {N}, who knows more.", "{G} and {N} shared a desk.", "Minutes taken by {N}.", "Hi {G}, is the {w} done?", "Dear {N}, thank you.", "{N} asked for the {w}.", "{N}: no objections", "{N}",
    "She works for {N} now.", "my neighbour {G} has a {w}", "Author: {N}", "{G} likes the {w}.", "The {w} belongs to {G}.", "{N} and {N} disagree.", "cc {N}", "– {N}", "Owner {N}, deputy {N}.",
    "Bitte mit {N} sprechen.", "{G} ist krank.", "Den Vertrag hat {N} unterschrieben.", "Mit freundlichen Grüßen {N}", "Frag doch {G}.", "Let {G} know about the {w}.", "{G}, could you look at it?", "I talked with {G} about the {w}.", "Question {G} about it.", "— {G}", "cc: {G}", "The visit of {G} was {w}.", "Besuch bei {G} {w}.", "Vertretung: {N}",
    "Merci de prévenir {N}.", "{G} arrive mardi.", "Dossier suivi par {N}.", "Hay que avisar a {N}.", "{G} llega el martes.", "Firmado por {N}.",
    # names after a title
    "{T} approved the {w}.", "We owe {T} an answer.", "Good morning, {T}.", "The office of {T} is closed.", "Sehr geehrter {T}, danke.", "{T} kommt später.", "Chère {T}, merci.", "Estimado {T}, gracias.", "Hablé con {T} ayer.", "On attend {T}.",
    # numbers to call
    "You can reach me at {P}.", "Mobile {P}", "Phone: {P}", "Office line {P}, ask for me.", "Dial {P} for help.", "Meine Nummer lautet {P}.", "Handy: {P}", "Appelez le {P}.", "Tél. {P}", "Mi teléfono es {P}.", "Llame al {P} mañana.", "WhatsApp {P}", "Text {P} when you arrive.", "number={P}", "(home) {P}",
    # numbers of identity
    "Passport number {I}", "SSN {I} is on record.", "Insurance number: {I}", "National ID {I}", "His tax id is {I}.", "Personalausweis Nr. {I}", "Steuer-ID {I}", "Sozialversicherungsnummer {I} fehlt.", "Numéro de passeport {I}", "NIF {I}", "Numéro fiscal : {I}", "Pasaporte {I}", "El DNI es {I}.", "The card shows {I} on its back.", "{I} was read out.", "id card {I}", "She spelled {I} for us.",
    # addresses
    "Send the invoice to {A}.", "My home is at {A}.", "Office: {A}", "Address: {A}", "She moved to {A} in spring.", "Lieferung an {A}", "Anschrift: {A}", "J'habite {A}.", "Livrer au {A}.", "Vivo en {A}.", "Dirección: {A}", "Visit {A} today.", "The shop at {A} is open.", "Ship to {A}, thanks.", "At {A}, ring twice.", "Pick it up at {A}, first door.",
    # mail
    "Write to {E} for the {w}.", "Mail {E}", "from {E} to {E}", "<{E}>", "Kontakt: {E}", "Envoyez à {E}.", "user={E};x=1", "({E})", "{E} bounced.",
    # what only looks like it
    "{C} the file as {w}.", "{C} the {w} please.", "In {C} we {w} again.", "{C} you check?", "{C} {w} is {w}.", "A {C} {w}.", "The {C} release.", "{C} was cold.", "Every {C} the {w} runs.", "{C} or {C}?", "{C} and {C} were {w}.", "Both {C} and {C} {w} went out.", "{C} and {C} {w} came late.", "Our {C} {w} has {w}.", "{C} be.", "Since {C} nothing {w}.", "{C} {w} and {C} {w}.",
    "Release 4.11.7.2 replaces 4.9.03.", "Build 2024-06-30 took 340 ms.", "ISBN 978 0 306 40615 7", "commit 9f8e7d6c5b4a39281706", "from 192.168.10.254 to 10.1.0.7", "read 88 120 450 rows", "part no. AB-4471", "error 5023311 in {w}", "at 09:15:30 on 2023-01-17", "ports 443 8080 22", "room B-204, ticket QX-2290", "{W} {W} is a {w}.", "The {W} {W} {w}.", "{W} and {W} {W}.", "see {W} {W} for the {w}", "## {W} {W}", "# {W} {W} {w}", "{W} {W}:", "{W} {W} {W}", "{W} {w} {W}.", "On {W} {W} the {w} failed.", "set a = b 112233 445566", "git@{w} in /opt/{w}", "order job-7781203", "a total of 1 250 300 500",
)

_WORDS = "note backup report slow quick list plan week cache index review old new summary window today later ready table draft meeting green silent brittle".split()
_CAPS = "Project Chapter Release Review Monday Market North Data Cloud Open Source Big River Blue Station Central Python Table Budget Lieferung Rechnung Montag Abteilung Bericht Haus Projet Réunion Chapitre Proyecto Reunión Informe Winter Annual Summary General Meeting Home Page Main Menu".split()


def _filled(rng: random.Random, lexicon: Lexicon, given: list[str], family: list[str]) -> tuple[str, set]:
    plain = [g for g in given if g.lower() not in COMMON] or given
    common = [g for g in given if g.lower() in COMMON] or ["Mark", "April", "Rose", "May"]
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHKLMNPQRSTWXYZ") for _ in range(n))

    def last() -> str:
        return rng.choice(family) if rng.random() < 0.7 and family else _invented(rng, lexicon)

    def first() -> str:
        return rng.choice(given) if given else "Anna"

    def name() -> tuple[str, str]:
        if rng.random() < 0.12:
            # both parts unknown, no title
            return "", f"{_invented(rng, lexicon)[: rng.randint(5, 7)].capitalize()} {_invented(rng, lexicon)}"
        title = rng.choice(["Dr. ", "Prof. ", "Mr. ", "Mrs. ", "Ms ", "Mme ", "Herr ", "Frau ", "Sra. ", "Sr. ", "M. "])
        form = rng.random()
        if form < 0.42:
            return "", f"{first()} {last()}"
        if form < 0.54:
            return "", f"{rng.choice(family) if family else last()}, {first()}"
        if form < 0.6:
            return "", f"{first()} {upper(1)}. {rng.choice(family) if family else last()}"
        if form < 0.64:
            return "", f"{upper(1)}. {rng.choice(family) if family else last()}"
        if form < 0.68:
            return "", f"{rng.choice(family) if family else last()} {first()}"
        if form < 0.76:
            return title, f"{upper(1)}. {last()}"
        if form < 0.82:
            return title, f"{upper(1)}. {upper(1)}. {last()}"
        if form < 0.92:
            return title, f"{first()} {last()}"
        return title, f"{_invented(rng, lexicon)[:6].capitalize()} {_invented(rng, lexicon)}"

    def number() -> str:
        return rng.choice([f"+{digits(2)} {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+{digits(2)}/{digits(2)}/{digits(8)}", f"+{digits(2)} {digits(4)} {digits(6)}", f"0{digits(2)} {digits(5)} {digits(3)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"00{digits(1)}.{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(4)} {digits(3)} {digits(3)}", f"+{digits(2)} (0){digits(2)} {digits(5)}-{digits(3)}", f"+{digits(11)}", f"0{digits(2)}/{digits(7)}", f"+34 6{digits(2)} {digits(3)} {digits(3)}"])

    def identity() -> str:
        return rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(2)} {digits(4)}", f"{upper(2)}{digits(6)}{rng.choice('ABCD')}", f"{upper(2)} {digits(2)} {digits(2)} {digits(2)} {rng.choice('ABCD')}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"QQ{digits(6)}{rng.choice('ABCD')}", f"QQ {digits(2)} {digits(2)} {digits(2)} {rng.choice('ABCD')}", f"{upper(2)}{digits(7)}", f"X{digits(7)}{upper(1)}", f"{digits(8)}{upper(1)}", f"{digits(2)} {digits(6)} {upper(1)} {digits(3)}", f"{upper(1)}{digits(8)}", f"{digits(8)}-{upper(1)}"])

    def address() -> str:
        w = _invented(rng, lexicon).capitalize()
        street = rng.choice([f"{rng.randint(1, 200)} {w} {rng.choice(['Street', 'Lane', 'Road', 'Avenue', 'Drive', 'Square', 'Court', 'Close', 'Terrace', 'Way', 'Place', 'Hill'])}", f"{w}{rng.choice(['straße', 'weg', 'gasse'])} {rng.randint(1, 200)}{rng.choice(['', '', 'a'])}", f"{rng.randint(1, 200)}{rng.choice(['', ' bis'])} rue {rng.choice(['de la', 'du', 'des'])} {w}", f"Calle {rng.choice(['de la', 'del', 'de los'])} {w}, {rng.randint(1, 200)}", f"{rng.randint(1, 200)}{rng.choice(['', ' bis', ' ter'])} {rng.choice(['avenue', 'chemin', 'rue', 'place'])} du {_invented(rng, lexicon)[:5].capitalize()} {w}", f"{rng.choice(['Via', 'Piazza', 'Corso'])} {w}{rng.choice([',', ''])} {rng.randint(1, 90)}", f"{w} {rng.choice(['Mews', 'Gardens', 'Crescent'])} {rng.randint(1, 90)}"])
        town = _invented(rng, lexicon).capitalize()
        return street + (f", {digits(5)} {town}" if rng.random() < 0.55 else "")

    text, gold = "", set()
    for part in re.split(r"(\{\w\})", rng.choice(PHRASES)):
        at, kind, piece = len(text), None, part
        if part == "{w}":
            piece = rng.choice(_WORDS)
        elif part == "{W}":
            piece = rng.choice(_CAPS)
        elif part == "{C}":
            piece = rng.choice(common)
        elif part == "{N}":
            title, piece = name()
            text += title
            at, kind = len(text), "name"
        elif part == "{T}":
            text += rng.choice(["Dr. ", "Prof. ", "Mr. ", "Mrs. ", "Ms ", "Mme ", "Herr ", "Frau ", "Sra. "])
            at, kind, piece = len(text), "name", last()
        elif part == "{G}":
            kind, piece = "name", rng.choice(plain if rng.random() < 0.75 else given or plain)
        elif part == "{P}":
            kind, piece = "phone", number()
        elif part == "{I}":
            kind, piece = "national_id", identity()
        elif part == "{A}":
            kind, piece = "address", address()
        elif part == "{E}":
            kind, piece = "email", f"{rng.choice([first().lower(), last().lower(), first() + '.' + last(), first().lower() + '+memo', last().lower() + '_' + digits(2)])}@{rng.choice(['example.com', 'mail.example.org', 'team.' + _invented(rng, lexicon).lower() + '.test'])}"
        text += piece
        if kind:
            gold.add((at, len(text), kind))
    if rng.random() < 0.4:
        tail = rng.choice([" ", "\n", "  "]) + rng.choice(["The rest can wait.", "Next week: shorter lists.", "Nobody minded.", "Danach sind es 14.", "Après cela, tout va bien.", "Luego se cierra.", "Then the door closed."])
        text += tail if text[-1] in ".\n?" or tail[0] == "\n" or rng.random() < 0.4 else "." + tail
    if rng.random() < 0.3:
        head = rng.choice(["It was asked for. ", "[draft] ", "me: ", "The door was open. ", "Heute. ", "Voilà. "])
        text, gold = head + text, {(s + len(head), e + len(head), k) for s, e, k in gold}
    case = rng.random()
    if case < 0.1:
        text = text.lower()
    elif case < 0.13 and len(text.upper()) == len(text):
        text = text.upper()
    return text, gold


@lru_cache(maxsize=4)
def _fitted(rows: tuple[tuple[str, str], ...]) -> dict[str, float]:
    lexicon = Lexicon(list(rows))
    given = sorted(p for p, k in lexicon.kind.items() if k in "GB") or ["Anna"]
    family = sorted(p for p, k in lexicon.kind.items() if k in "FB")
    rng = random.Random(11)
    data = []
    for _ in range(SENTENCES):
        text, gold = _filled(rng, lexicon, given, family)
        data.append((candidates(text, lexicon), gold))
    weights: dict[str, float] = {}
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 2)
        for cands, gold in data:
            if not cands:
                continue
            for k, g in _gradient(cands, gold, weights).items():
                if abs(g) > 1e-3:
                    kind, feats = cands[k][2], cands[k][3]
                    for name in (kind, *(f"{kind}|{f}" for f in feats)):
                        weights[name] = weights.get(name, 0.0) * (1 - DECAY) - rate * g
    return weights


def model(name_lexicon: DataFrame) -> tuple[Lexicon, dict[str, float]]:
    """The lexicon (at most LEXICON_ROWS rows) and the fitted weights; the same for the same lexicon."""
    rows = name_lexicon.where("name_part IS NOT NULL AND part_kind IS NOT NULL").select("name_part", "part_kind").distinct().limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError("the name lexicon is too large to broadcast")
    rows = tuple(sorted((r[0], r[1]) for r in rows))
    return Lexicon(list(rows)), _fitted(rows)


def _records(memories: DataFrame, source_records: DataFrame) -> DataFrame:
    a = memories.where("content <> ''").select(F.lit("memories").alias("rec_table"), F.col("id").alias("rec_id"), "content")
    b = source_records.where("content <> ''").select(F.lit("source_records").alias("rec_table"), F.col("source_id").alias("rec_id"), "content")
    return a.unionByName(b)


def personal_spans(memories: DataFrame, source_records: DataFrame, name_lexicon: DataFrame) -> DataFrame:
    """(rec_table, rec_id, kind, start_pos, end_pos): every occurrence, repeated rows counting once.

    Positions are code points from 0. Null and empty contents hold nothing; an empty lexicon leaves the formats and the
    titled names; other columns are ignored.
    """
    lexicon, weights = model(name_lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tables, ids, kinds, starts, ends = [], [], [], [], []
        for t, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for s, e, kind in decode(text, lexicon, weights):
                tables.append(t), ids.append(i), kinds.append(kind), starts.append(s), ends.append(e)
        cols = [pa.array(tables, pa.string()), pa.array(ids, pa.string()), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["rec_table", "rec_id", "kind", "start_pos", "end_pos"])

    return arrow_map(_records(memories, source_records), run, "rec_table string, rec_id string, kind string, start_pos long, end_pos long").distinct()


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def redacted_records(memories: DataFrame, source_records: DataFrame, name_lexicon: DataFrame) -> DataFrame:
    """(rec_table, rec_id, found, content): every row's content with [KIND] in place of each occurrence."""
    lexicon, weights = model(name_lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, texts = [], []
        for text in batch.column(2).to_pylist():
            spans = decode(text, lexicon, weights)
            found.append(len(spans)), texts.append(redacted(text, spans))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32()), pa.array(texts, pa.string())], names=["rec_table", "rec_id", "found", "content"])

    return arrow_map(_records(memories, source_records), run, "rec_table string, rec_id string, found int, content string")


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("memories", "source_records", "name_lexicon")]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(*_tables(spark, sf_dir)).select("rec_table", "rec_id", "kind", "start_pos")


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_records(*_tables(spark, sf_dir))
