"""Problem 8: sentence boundaries across languages and scripts, by cascading segmentation rule tables.

Every rule is a pair of regular expressions, one for what stands before a
position and one for what follows, and says break or no break. The tables of
the languages and scripts follow one another in a fixed cascade, and the first
rule that matches decides the position. A language's rules hold wherever its
abbreviations and scripts occur, so texts that mix languages, or whose language
is given wrongly, need no detection.

Before the tables, the layout decides: blank lines end units, list items are
units, and positions inside quoted speech are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Marks that may end a sentence, and what may close it after them.
MARKS = ".!?…。！？।॥؟｡．"
CLOSERS = "\"'”’»)\\]」』】）》〉›"
#: Scripts without letter case.
CASELESS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Devanagari}\p{Arabic}\p{Hangul}\p{Hebrew}"
CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
#: A lower-case word goes on with the sentence, but for names like eBay and words that open a question.
ASKING = (
    r"(?:what|when|where|who|whom|whose|why|how|which|can\s+(?:you|we|i)|"
    r"quel(?:le)?s?|pourquoi|combien|comment|qui|quand|où|à\s+quoi|à\s+quoi|peut-on|est-ce|"
    r"qué|qué|quién|quién|cómo|cómo|cuándo|cuándo|cuánto|cuánto|cuál|cuál|por\s+qué|por\s+qué|para\s+qué|para\s+qué|se\s+puede|"
    r"wer|wann|warum|wieso|wofür|wofür|wie\s+lange|kann\s+man|was\s+(?:kostet|ist))\b"
)
GOES_ON = rf"\s*(?!\p{{Ll}}\p{{Lu}})(?!{ASKING})\p{{Ll}}"
#: Words that open a sentence far more often than they are a name after an initial.
OPENERS = r"(?:The|A|An|In|It|He|She|We|They|This|That|There|As|For|But|And|According|Why|What|How|When|Der|Die|Das|Ein|Eine|Le|La|Les|L'|Un|Une|El|Los|Las|Una)\b"
NOT_WORD = r"(?<![\p{L}\p{M}\p{N}])"


def _words(*words: str) -> str:
    """Abbreviations without their last dot; white space may follow the dots inside."""
    return NOT_WORD + "(?:" + "|".join(w.replace(".", r"\.\s*") for w in words) + r")\."


#: (break?, before, after). The first match decides.
TABLES: dict[str, list[tuple[bool, str, str]]] = {
    "quotes": [
        # Whoever speaks is named after a question or a call, in lower case.
        (False, r"[!?؟]\s?[\"”’»“]", rf"\s*(?!\p{{Ll}}\p{{Lu}})\p{{Ll}}"),
        (False, r"[\"”’»“」』]", r"\s*[,;，、；،]"),
    ],
    "ja": [
        (False, r"[。！？…][」』”]", r"\s*(?:と|って|という|など|なんて|は|が|を|に|の|も|で|な)"),
    ],
    "zh": [
        (True, r"[:：]\s*(?:“[^”]*[。！？…!?]”|「[^」]*[。！？…!?]」|『[^』]*[。！？…!?]』)", r""),
        (True, r"[。！？…][」』”]", r"\s*[“「『]"),
        (False, r"(?:[。！？…]|(?<=[\p{Han}\p{Hiragana}\p{Katakana}])[!?])[」』”]", r"\s*\S"),
    ],
    "hi, ar": [
        (True, r"[:：]\s*(?:\"[^\"]*\"|“[^”]*”|«[^»]*»)", r"\s"),
        (False, r"[\p{Devanagari}\p{Arabic}]\s?[!?؟][\"”»]", r"\s+\p{L}"),
        (False, _words("डॉ", "डा", "प्रो", "रु", "श्री", "सं", "पृ", "क्र", "उदा", "कि.मी", "ई.पू"), r"\s"),
        (False, _words("د", "أ", "م", "ص", "ج", "هـ", "ق.م", "ت", "أ.د", "ط"), r"\s"),
    ],
    "en": [
        (False, _words("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Messrs", "Gen", "Col", "Capt", "Lt", "Sgt", "Rev", "Hon", "Pres", "Gov", "Mt", "Ft"), r"\s"),
        (False, _words("vs", "e.g", "i.e", "cf", "acc", "approx", "resp", "incl", "excl", "esp", "viz", "al"), r"\s+(?!$)"),
        (False, _words("No", "Nos", "Nr", "Fig", "fig", "Figs", "figs", "Sec", "sec", "Ch", "ch", "Eq", "eq", "Vol", "vol", "vols", "pp", "p", "pop", "ca", "c", "art", "Art", "ed", "Ed", "Tab", "tab", "v", "n", "max", "min", "est"), r"\s*\d"),
        (False, _words("Sec", "Fig", "Vol", "vol", "pp"), r"\s+\p{Lu}\b"),
        (False, _words("Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sept?", "Oct", "Nov", "Dec"), r"\s+\d"),
    ],
    "de": [
        (True, rf"„[^„“”]*[{MARKS}]“", r"\s"),
        (False, _words("z", "d", "u", "i", "o", "v", "s", "a"), r"\s+\p{L}\p{M}*\."),
        (False, _words("u"), r"\s+(?:Co|Cie|Söhne|Partner)\b"),
        (False, _words("z.B", "d.h", "u.a", "o.ä", "o.ä", "i.d.R", "v.a", "s.o", "u.U", "z.T", "i.A", "m.E"), r"\s"),
        (False, _words("bzw", "bspw", "Abb", "Nr", "ca", "evtl", "ggf", "inkl", "exkl", "vgl", "Vgl", "Hr", "Fr", "Str", "Bd", "Kap", "Aufl", "Hrsg", "Jh", "sog", "Tel", "Mio", "Mrd", "zzgl", "max", "min", "geb", "gest"), r"\s"),
        (False, r"(?<![\d.,])\d{1,2}\.", r"\s+(?:Januar|Jänner|Jänner|Februar|März|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhunderts?|Jahrtausends?|Jh|Auflage|Kapitel|Klasse|Stock|Etage|Platz|Geburtstag|Jahrestag|Mal|Tag|Lebensjahr|Internationale[nrms]?)\b"),
    ],
    "fr, es": [
        (False, _words("p", "p.ex", "p.ej", "M", "MM", "Mmes?", "Mlles?", "Me", "Mgr", "Dr", "Pr", "env", "cf", "c\\.-à-d", "c\\.-à-d"), r"\s+(?!$)"),
        (False, _words("Sr", "Sra", "Sres", "Srta", "Dr", "Dra", "Prof", "D", "Dña", "Lic", "Ing", "Ud", "Uds", "aprox", "pág", "pág", "págs", "págs", "núm", "núm", "tel", "tel", "Av", "Avda", "art", "fig", "cap", "vol", "ej"), r"\s+(?!$)"),
    ],
    "abbreviations that may end a sentence": [
        (False, _words("Inc", "Ltd", "Co", "Corp", "Cía", "Cía", "S.A", "GmbH", "Jr", "Sr", "Bros", "etc", "usw", "usf", "etw", "a.m", "p.m", "Ph.D", "M.D", "B.A", "M.A", "cents?", "ft", "in", "oz", "lbs?", "hrs?", "u.Co"), GOES_ON),
        (False, NOT_WORD + r"(?:\p{L}\.){2}", rf"(?:{GOES_ON}|\s+\d)"),
        (False, NOT_WORD + r"(?:\p{Lu}\.){2}", rf"\s+(?!{OPENERS})\p{{Lu}}\p{{Ll}}+\s+(?:\p{{Lu}})"),
        (False, r"(?<![\p{L}\p{M}\p{N}'’-])\p{Lu}\p{M}*\.", rf"\s*(?!{OPENERS})(?:\p{{Lu}}\p{{M}}?[\p{{Ll}}'’.])"),
        (False, r"(?<![\p{L}\p{M}\p{N}'’-])\p{Lu}\.", GOES_ON),
    ],
    "pauses": [
        (False, r"(?:…|\.\.)[.…]*", GOES_ON),
        (False, r"\p{Devanagari}\s?(?:…|\.\.)[.…]*", r"\s*\p{Devanagari}"),
        (False, r"\p{Arabic}\s?(?:…|\.\.)[.…]*", r"\s*\p{Arabic}"),
        (False, rf"[{CJK}]\s?(?:…|\.\.)[.…]*", rf"\s*[{CJK}]"),
        (False, r"(?:^|\s)(?:…|\.\.)[.…]*", r"\s*\S"),
    ],
    "th": [
        (False, r"\p{Thai}\.", r"\s+[\p{Thai}\d]"),
        (False, r"[ๆฯ๐-๙]", r"\s"),
        (False, r"\p{Thai}", r"\s+(?:[๐-๙]|และ|หรือ|แต่|ซึ่ง|เพราะ)"),
        (True, r"\p{Thai}", r"\s+\p{Thai}"),
    ],
    "all": [
        (False, r"[.!?…]", r"\s*[,;:]"),
        (True, rf"[。！？।॥｡．][{MARKS}]*[{CLOSERS}]*", r""),
        (True, rf"[{MARKS}]\s?[{CLOSERS}]*", r"(?:\s|$)"),
    ],
}

#: What closes quoted speech that a mark opens, and what must not come before that.
QUOTES = {'"': ('"', ""), "“": ("”", "“"), "„": ("“”\"", "„"), "«": ("»", ""), "「": ("」", ""), "『": ("』", ""), "‘": ("’", "‘")}
QUOTE_MARKS = "\"“”„«»「」『』‘’"

_BLANK = r"(?>\r\n|\r|\n)[^\S\r\n]*(?>\r\n|\r|\n)"
_ITEM = r"[^\S\r\n]*(?:(?P<bullet>[-*•–—·▪◦‣●○■])[^\S\r\n]+|(?P<number>\d{1,3})[.)][^\S\r\n]+|\(?(?P<letter>[a-zA-Z])\)[^\S\r\n]+|\((?P<inner>\d{1,3})\)[^\S\r\n]+)(?=\S)"


class Segmenter:
    """The compiled tables."""

    def __init__(self, tables: dict[str, list[tuple[bool, str, str]]] | None = None):
        import regex

        rules = [rule for table in (tables or TABLES).values() for rule in table]
        self.breaks = [b for b, _, _ in rules]
        self.decide = regex.compile("|".join(f"((?<={before})(?={after}))" if before else f"((?={after}))" for _, before, after in rules)).match
        # Positions to decide on, and the marks that may open quoted speech.
        self.spot = regex.compile(
            rf"(?P<open>[\"“„«「『‘])|(?P<mark>[{MARKS}]+(?:[{CLOSERS}]|(?<=[!?…])\s?»)*)|(?<=[\p{{Thai}}])(?P<gap>\s+)(?=\p{{Thai}})"
        ).search
        self.quotes = regex.compile(f"[{QUOTE_MARKS}]").finditer
        self.after = regex.compile(rf"[{CLOSERS}]*(?P<more>[{MARKS}]+[{CLOSERS}]*)?").match
        self.letter = regex.compile(r"\p{L}").match
        self.in_word = regex.compile(r"[\p{L}\p{N}]").match
        self.said = regex.compile(rf"[{MARKS}]\s?[{CLOSERS}“]+$").search
        self.blank = regex.compile(_BLANK + r"\s*").finditer
        self.line = regex.compile(r"[^\r\n]*(?>\r\n|\r|\n|$)").finditer
        self.item = regex.compile(_ITEM).match
        self.ended = regex.compile(rf"[{MARKS}:：][{CLOSERS}]*\s*$").search

    def _quoted(self, text: str, start: int, end: int) -> dict[int, int]:
        """Where the quoted speech ends that an opening mark begins: the next closing mark of each is known from the
        right, so a stretch is read once however many of its quotes stay open."""
        ends, later = {}, dict.fromkeys(QUOTE_MARKS, end)
        for p in reversed([m.start() for m in self.quotes(text, start, end)]):
            mark = text[p]
            if mark in QUOTES:
                closing, never = QUOTES[mark]
                q = min(later[c] for c in closing)
                if q < end and all(later[c] > q for c in never):
                    ends[p] = q + 1
            later[mark] = p
        return ends

    def _speech(self, text: str, p: int, q: int) -> bool:
        """Whether marks at p and before q hold quoted speech, and not an apostrophe or an inch."""
        mark = text[p]
        if mark in "\"“‘" and text[p + 1].isspace():
            return False
        if mark == '"':
            return not p or not self.in_word(text, p - 1)
        return mark != "‘" or not self.letter(text, q)

    def _prose(self, text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
        """Units of text[start:end], a stretch without blank lines or list items."""
        at = here = start
        ends = None
        while m := self.spot(text, here, end):
            p = here = m.end()
            if m.lastgroup == "gap":
                p = m.start()
            elif m.lastgroup == "open":
                if ends is None:
                    ends = self._quoted(text, start, end)
                q = ends.get(m.start())
                if q is None or not self._speech(text, m.start(), q):
                    continue
                more = self.after(text, q, end)
                p = here = more.end()
                if more["more"] is None and not self.said(text, m.start(), p):
                    continue
            if p >= end:
                break
            rule = self.decide(text, p)
            if rule and self.breaks[rule.lastindex - 1]:
                _keep(text, at, p, out)
                at = p
        _keep(text, at, end, out)

    def _block(self, text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
        """Units of a stretch without blank lines."""
        if "\n" not in text[start:end] and "\r" not in text[start:end]:
            if (m := self.item(text, start, end)) and (m["number"] in (None, "1") or m.end() - start < 5 and not self.ended(text, start, end)):
                _keep(text, start, end, out)
            else:
                self._prose(text, start, end, out)
            return
        lines = [(m.start(), m.end()) for m in self.line(text, start, end) if m.end() > m.start()]
        items = self._items(text, lines)
        if not any(items):
            self._prose(text, start, end, out)
            return
        at, own = start, False  # own: the stretch since at is one list item
        for (a, b), item in zip(lines, items):
            goes_on = own and not item and text[a:b].lstrip()[:1].islower()
            if a > at and (item or own) and not goes_on:
                _keep(text, at, a, out) if own else self._prose(text, at, a, out)
                at = a
            own = item or goes_on
        _keep(text, at, end, out) if own else self._prose(text, at, end, out)

    def _items(self, text: str, lines: list[tuple[int, int]]) -> list[bool]:
        """Which lines are list items: markers of one kind in a row, numbers in order, after an end or an introduction."""
        found = [self.item(text, a, b) for a, b in lines]
        out = [False] * len(lines)
        i = 0
        while i < len(lines):
            if not found[i]:
                i += 1
                continue
            j = i + 1
            while j < len(lines) and found[j] and found[j].lastgroup == found[i].lastgroup and (
                found[i]["number"] is None or int(found[j]["number"]) == int(found[j - 1]["number"]) + 1
            ):
                j += 1
            led = i == 0 or out[i - 1] or self.ended(text, *lines[i - 1])
            if j - i > 1 or (led and (found[i]["number"] in (None, "1") or i and text[slice(*lines[i - 1])].rstrip().endswith((":", "：")))):
                out[i:j] = [True] * (j - i)
            i = j
        return out

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of every unit in order."""
        out: list[tuple[int, int]] = []
        if not text:
            return out
        at = 0
        for m in self.blank(text):
            self._block(text, at, m.start(), out)
            at = m.end()
        self._block(text, at, len(text), out)
        return out


def _keep(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    part = text[start:end]
    bare = part.lstrip()
    if bare:
        start = end - len(bare)
        out.append((start, start + len(bare.rstrip())))


@cache
def segmenter() -> Segmenter:
    """This worker's compiled tables, made once."""
    return Segmenter()


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units = segmenter().units
    for batch in batches:
        found = [units(text) for text in batch.column(1).to_pylist()]
        count = np.array([len(x) for x in found], dtype=np.int64)
        flat = np.array([y for x in found for y in x], dtype=np.int64).reshape(-1, 2)
        keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), count)))
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(nth, pa.int32()), pa.array(np.ascontiguousarray(flat[:, 0])), pa.array(np.ascontiguousarray(flat[:, 1]))],
            ["id", "unit_no", "start_pos", "end_pos"],
        )


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, unit_no (from 0), start_pos and end_pos (code points from 0, end exclusive) of every sentence unit.

    Null, empty and blank texts have no units; units don't overlap, have no white space at their ends and hold every
    other character between them; texts of any length are cut whole; a null key stays null; repeated rows give
    repeated units; further columns are ignored. It is one narrow stage: no shuffle.
    """
    kind = df.select(key).schema[0].dataType.simpleString()
    rows = df.where(df[text].isNotNull()).select(df[key].alias("id"), df[text].cast("string").alias("text"))
    out = rows.mapInArrow(_split, f"id {kind}, unit_no int, start_pos long, end_pos long")
    return out.toDF(key, "unit_no", "start_pos", "end_pos")
