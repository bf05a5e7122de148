"""Problem 10: sentences of documents in any script, with their positions.

The sentence-break rules of the Unicode text segmentation standard, expressed over blocks of Markdown. The classes of
characters (terminators of all scripts, closing marks, scripts without spaces between words) come from the character
database. Full stops inside numbers and names do not break, nor do those of abbreviations, which are kept by language:
a document's language is told by its function words, and only where they decide nothing do the abbreviations of all
languages apply. A quotation is passed over as a whole; whether a sentence ends behind it depends on what follows.

Scripts of the class SA (Thai, Lao, Khmer, Burmese) write a space between sentences and between clauses, and nothing
but a dictionary could tell them apart; every space between their letters is taken as a break.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from mnemolith.session import arrow_map, spread, table

# fixed values: abbreviations by language, in lower case and without the last full stop. After a title or one of
# "always" no sentence ends, after one of "capital" one ends before a capital only, and one of "number" suppresses a
# break before a number only. A title counts only with a capital (or in a script without case).
TITLES = {
    "en": ("dr", "mr", "mrs", "ms", "prof", "st", "mt", "messrs", "rev", "hon", "gen", "col", "sgt", "capt", "lt"),
    "de": ("dr", "prof", "hr", "fr", "st"),
    "fr": ("dr", "pr", "mm", "mme", "mlle", "st", "ste", "prof"),
    "es": ("dr", "dra", "sr", "sra", "srta", "prof", "gral", "ud", "uds"),
    "hi": ("डॉ", "श्री", "प्रो"),
    "th": ("ดร", "นพ", "ผศ", "รศ"),
}
ALWAYS = {
    "en": ("approx", "cf", "vs", "viz", "i.e", "e.g"),
    "de": ("bzw", "ca", "evtl", "ggf", "vgl", "inkl", "z.b", "d.h", "u.a", "approx", "vs"),
    "fr": ("env", "p.ex", "ex", "c.-à-d", "cf", "vs"),
    "es": ("aprox", "p.ej", "ej", "cf", "vs"),
}
CAPITAL = {
    "en": ("etc", "p.m", "a.m", "inc", "ltd", "jr", "co", "corp", "u.s", "u.k", "e.u", "bros", "dept", "est", "al"),
    "de": ("usw", "etc", "ff", "u.dgl", "n.chr", "v.chr", "bspw", "al"),
    "fr": ("etc", "al"),
    "es": ("etc", "ddd", "pp.ss", "al"),
}
NUMBER = {
    "en": ("no", "nos", "fig", "figs", "sec", "eq", "ref", "vol", "ch", "art", "tab", "chap", "pp", "p"),
    "de": ("nr", "abb", "abs", "art", "tab", "bd", "kap", "s"),
    "fr": ("fig", "art", "vol", "chap", "p", "pp", "n", "nº"),
    "es": ("pág", "págs", "pag", "núm", "fig", "art", "vol", "cap", "n.º", "nº", "p", "pp"),
}
# fixed values: frequent function words that tell a language; German months, which follow the number of a day
FUNCTION_WORDS = {
    "en": frozenset("the of and to is was that with for which after this are were has have".split()),
    "de": frozenset("der die das und ist nicht ein eine mit dem den von zu auf wird wurde nach".split()),
    "fr": frozenset("le les des une est dans pour qui sur avec ce cette du au aux pas sont".split()),
    "es": frozenset("el los las una es en por para con que del al se lo su fue más".split()),
}
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())


def _of(*properties: str) -> str:
    """All characters that have one of the properties, from the character database."""
    text = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    return "".join(regex.findall("[" + "".join(f"\\p{{{p}}}" for p in properties) + "]", text))


def _class(characters: str) -> str:
    return "".join(re.escape(c) for c in characters)


#: Terminators other than the full stop, with the small and the wide full stop among them.
_STOPS = _of("Sentence_Break=STerm") + "".join(c for c in _of("Sentence_Break=ATerm") if c not in ".․")
_PAIRED = "“”„«»「」『』‘’"
_CLOSERS = "\"'" + "".join(c for c in _of("Pe", "Pf") if c not in "„")
_SA = _of("Line_Break=SA")
_SA_LETTERS = "".join(c for c in _SA if c.isalpha())

_QUOTE = r"“[^“”]*”|„[^“”„]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"]+\"|(?<!\w)'(?=\S)[^'\n]{2,}(?<=\S)'(?!\w)|‘[^‘’]{2,}’(?!\w)"
_S, _C, _T = _class(_STOPS), _class(_CLOSERS), _class(_SA)
_CLOSE = rf"[{_C}]*"
_MARK = re.compile(rf"(?P<quote>{_QUOTE})|(?P<stop>(?:[{_S}…]|\.(?:\.+|(?=[{_S}])))[.{_S}…]*{_CLOSE})|(?P<dot>\.{_CLOSE})")
_MARK_SPACE = re.compile(_MARK.pattern + rf"|(?P<space>(?<=[{_T}\d)”\"])[ \t\n]+(?=[\"“(]?[{_T}]))")
#: What a mark can begin with; the lookbehinds of _MARK are tested from there.
_BEGIN = re.compile(rf"[.…“„«「『\"'‘{_S}]")
_SPACED = re.compile(f"[{_class(_SA_LETTERS)}]")
_LIST = re.compile(r"[ \t]*(?:[-*+•‣◦]|(\d{1,9})[.)])[ \t]+(?=\S)")
_HEADING = re.compile(r" {0,3}#{1,6}[ \t]+")
_BEFORE = re.compile(r"[^\s(\[{\"'“„«/,;:]+$")
_NEXT = re.compile(r"\s*[\"'“„«‘¿¡(\[「『]*\s?")
_WORD = re.compile(r"\w")
_ENDS = tuple(_STOPS + ".…")
#: Particles and verbs that carry a Japanese or Chinese sentence on behind a quotation.
_GOES_ON = ("と", "って", "、", "，", ",", "；", ";", "然后", "后", "并", "的", "は", "が", "を", "も", "に", "の")


def _ideographic(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "가" <= c <= "힯" or "豈" <= c <= "﫿" or "＀" <= c <= "￯" or c >= "\U00020000"


class Rules:
    """The abbreviations of a text, by its language, which is told when the first abbreviation asks for it."""

    def __init__(self, text: str):
        self.text, self.found = text, None

    def languages(self) -> tuple[str, ...]:
        if self.found is None:
            words = Counter(self.text.lower().split())
            counts = {lang: sum(map(words.__getitem__, known)) for lang, known in FUNCTION_WORDS.items()}
            most = max(counts.values())
            # a text may mix languages: all that have at least a quarter of the most frequent one's words
            self.found = tuple(k for k, n in counts.items() if most >= 2 and 4 * n >= most) or tuple(FUNCTION_WORDS)
        return (*self.found, "hi", "th")

    def has(self, table: dict[str, tuple[str, ...]], word: str) -> bool:
        return any(word in table.get(lang, ()) for lang in self.languages())


_ABBREVIATIONS = frozenset(w for table in (TITLES, ALWAYS, CAPITAL, NUMBER) for words in table.values() for w in words)


def _dot_ends(text: str, start: int, dot: int, end: int, stop: int, rules: Rules) -> bool:
    """Whether a single full stop at dot, with closing marks up to end, ends a sentence; stop is the block's end."""
    if end >= stop:
        return True
    spaced = text[end].isspace()
    here = _NEXT.match(text, end, stop).end()
    if here >= stop:
        return True
    after = text[here]
    before = text[dot - 1] if dot > start else " "
    if not spaced:
        if end > dot + 1:
            return after.isupper() or _ideographic(after)
        if _ideographic(after):
            return _ideographic(before)
        return after.isupper() and (before.islower() or before.isdigit()) and here + 1 < stop and (text[here + 1].islower() or text[here + 1].isspace())
    found = _BEFORE.search(text, max(start, dot - 24), dot)
    word = found.group().lower() if found else ""
    if len(word) == 1 and word.isalpha() and not _ideographic(word):
        # an initial or a part of an abbreviation, unless it is the unit of a number
        unit = dot - 3 >= start and text[dot - 1].islower() and text[dot - 2].isspace() and text[dot - 3].isdigit()
        return unit and (after.isupper() or here > end + 1)
    if word in _ABBREVIATIONS:
        if rules.has(TITLES, word) and not (found.group()[0].islower() and after.isupper()):
            return False
        if rules.has(ALWAYS, word):
            return False
        if rules.has(NUMBER, word):
            return not after.isdigit()
        if rules.has(CAPITAL, word):
            return after.isupper() or not after.islower() and not after.isdigit()
    if len(word) > 2 and word[1::2] == "." * (len(word) // 2) and word.replace(".", "").isalpha():
        return after.isupper()
    if word.isdigit() and len(word) <= 2:
        follower = re.match(r"\w+", text[here : here + 12])
        if follower and follower.group().lower() in MONTHS:
            return False
    return True


def _quote_ends(text: str, sentence: int, quote: int, end: int, stop: int) -> bool:
    """Whether a sentence ends behind the quotation text[quote:end]."""
    if end >= stop:
        return True
    inner = end - 2
    while inner > quote and text[inner].isspace():
        inner -= 1
    if text[inner] not in _ENDS:
        return False
    rest = _NEXT.match(text, end, stop).end()
    if rest >= stop:
        return True
    after = text[rest]
    if _ideographic(after):
        return quote == sentence and not text.startswith(_GOES_ON, end)
    if not text[end].isspace():
        return after.isupper() and text[end] == after
    return not after.islower() and (after.isupper() or quote == sentence or not after.isalpha())


def _marks(text: str, start: int, stop: int) -> Iterator[re.Match]:
    """The marks of a block: as finditer, but only where a mark can begin, and with the text before start in sight."""
    if _SPACED.search(text, start, stop):
        yield from _MARK_SPACE.finditer(text, start, stop)
        return
    at = start
    while first := _BEGIN.search(text, at, stop):
        m = _MARK.match(text, first.start(), stop)
        if m:
            yield m
        at = m.end() if m else first.end()


def _block(text: str, start: int, stop: int, out: list[int], single: bool, rules: Rules) -> None:
    """Appends the sentence starts of one block."""
    while start < stop and text[start].isspace():
        start += 1
    if start >= stop or not _WORD.search(text, start, stop):
        return
    out.append(start)
    if single:
        return
    sentence = start
    for m in _marks(text, start, stop):
        kind, end = m.lastgroup, m.end()
        if kind == "quote":
            ends = _quote_ends(text, sentence, m.start(), end, stop)
        elif kind == "dot":
            ends = _dot_ends(text, start, m.start(), end, stop, rules)
        elif kind == "space":
            ends = not text.startswith("ๆ", m.start() - 1)
        elif end >= stop:
            break
        else:
            after = text[end]
            if after.isspace():
                here = _NEXT.match(text, end, stop).end()
                follows = text[here] if here < stop else " "
                # an ellipsis or a question in the middle of a sentence goes on in lower case
                ends = not (follows.islower() and m.group().lstrip(".…")[:1] in ("", ")", '"', "'", "”", "’"))
            else:
                ends = _ideographic(after) or after.isupper() or after in "“„«「『¿¡\"" or not after.isascii() and after.isalpha() and not after.islower()
        if ends:
            here = end
            while here < stop and text[here].isspace():
                here += 1
            if here >= stop or not _WORD.search(text, here, stop):
                break
            if not _WORD.search(text, sentence, end):
                continue
            out.append(here)
            sentence = here


def sentence_starts(text: str) -> list[int]:
    """Positions of the first characters of the sentences of a Markdown text."""
    out: list[int] = []
    rules = Rules(text)
    begin = end = None  # of the open block
    single, fence, at = False, None, 0
    ordered = False  # whether the line before belongs to a list

    def close() -> None:
        nonlocal begin
        if begin is not None:
            _block(text, begin, end, out, single, rules)
            begin = None

    for line in text.split("\n"):
        stop = at + len(line)
        head = line.lstrip()
        if fence:
            if head.startswith(fence):
                fence = None
        elif head.startswith(("```", "~~~")):
            close()
            fence, ordered = head[:3], False
        elif not head:
            close()
        elif m := _HEADING.match(line):
            close()
            begin, end, single = at + m.end(), stop, True
            close()
            ordered = False
        elif (m := _LIST.match(line)) and (m.group(1) is None or begin is None or ordered or m.group(1) == "1"):
            close()
            begin, end, single, ordered = at + m.end(), stop, True, True
        else:
            if begin is None:
                begin, single, ordered = at, False, False
            end = stop
        at = stop + 1
    close()
    return out


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    docs, starts = [], []
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        found = sentence_starts(text)
        docs.extend([doc] * len(found))
        starts.extend(found)
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64())], names=["doc_id", "sent_start"])


def _text_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    docs, numbers, starts, sentences = [], [], [], []
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        found = sentence_starts(text)
        for k, s in enumerate(found):
            piece = text[s : found[k + 1] if k + 1 < len(found) else len(text)]
            # what stands between two blocks (marks, code) is no part of a sentence
            piece = re.split(r"\n\s*(?:\n|```|~~~|#{1,6}[ \t]|[-*+•‣◦][ \t]+$|\d{1,9}[.)][ \t]+$)", piece, maxsplit=1)[0].rstrip()
            docs.append(doc), numbers.append(k), starts.append(s), sentences.append(piece)
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(sentences, pa.string())], names=["doc_id", "sent_no", "sent_start", "sentence"])


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_no, sent_start, sentence) of every document, positions in code points.

    A null or blank text, one of code or of signs only, has no sentences. The language column is not trusted: the rules
    of all scripts apply side by side. Repeated rows give repeated sentences; other columns are ignored.
    """
    rows = documents.where("text IS NOT NULL").select(documents.doc_id.cast("long").alias("doc_id"), "text")
    return arrow_map(spread(rows), _text_batch, "doc_id long, sent_no int, sent_start long, sentence string")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return arrow_map(spread(documents.select("doc_id", "text")), _batch, "doc_id long, sent_start long")


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))
