"""Sentence boundaries across languages and scripts.

The rules follow the standard sentence-break properties: terminators of all scripts (SATerm), closing
quotes and brackets stay with their sentence, no break before a lower-case continuation, none within
numbers and between initials. Added to them are lists of abbreviations by language, balanced quotations
and brackets that don't split the sentence around them, list entries, and clauses of scripts without stops.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from quernwork.session import table

#: Terminators without the standard's property: full-width, double and stylistic forms.
_MORE = "？！｡︒‽⸮༎꘏"
#: The standard's sentence terminators of all scripts (Sentence_Terminal) and the ones above. "." and the ellipsis are ambiguous (DOTS); the others always end a sentence unless a lower-case letter or a speech tag follows a closing quote.
_TERMINAL = regex.compile(r"\p{Sentence_Terminal}")
STRONG = "".join(dict.fromkeys([*(c for c in map(chr, range(0x20000)) if c not in ".．․…﹒" and _TERMINAL.match(c)), *_MORE]))
DOTS = ".．․…﹒"
_OPEN = {"(": ")", "[": "]", "{": "}", "«": "»", "‹": "›", "“": "”", "„": "“", "‚": "‘", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "‘": "’", "［": "］", "〔": "〕"}
_CLOSERS = frozenset(_OPEN.values()) | {'"', "'", "＂"}
_QUOTES = frozenset("«»‹›“”„‚‘’「」『』\"'")
_DASHES = "—–―"

#: Abbreviations that don't end a sentence, by language ("*": all). "initial" ones never do, "final" ones may before a capital.
_NEVER = {
    "*": "dr prof mr mrs ms st cf vol fig figs vgl nr art chap núm num bd hrsg approx ca capt col gen lt sgt rev hon pres gov jr sr messrs mt ft vs viz ed eds tel ext op pp",
    "en": "no nos sec secs eq eqs p ch est dept univ assn bros e.g i.e resp incl excl mon tue tues wed thu thur thurs fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec",
    "fr": "m mm mme mmes mlle mlles me p ex p.ex c.-à-d éd env av bd réf tél n° janv févr juil sept oct nov déc min max",
    "de": "z z.b d d.h u.a u s bzw ggf evtl inkl exkl abs hr fr frl str nr vgl dipl ing bspw sog st tel jan feb apr aug sept okt nov dez max min o i v m.e",
    "es": "sr sra sres sras srta d dña dra ud uds p p.ej ej pág págs avda c cap lic ing núm art depto",
    "el": "κ κα κκ αρ σελ π π.χ δηλ βλ κεφ τηλ δρ χλμ",
    "ar": "د أ م ص ج ت هـ",
    "hi": "डॉ रु नं श्री सं प्रो पं कु",
    "pt": "sr sra dr dra pág núm art av ex p.ex",
    "it": "sig sigg dott ing pag art es p.es",
    "ru": "г гг т тт стр рис им ул д кв с см руб коп др пр т.е т.к",
}
_FINAL = {
    "*": "etc inc ltd co corp llc bros u.s u.k a.m p.m a.d b.c ph.d usw κ.λπ κλπ",
    "fr": "etc",
    "de": "usw u.ä",
    "es": "etc a m",
    "ru": "т.д т.п",
}
#: Words that go on after "9 p.m." or after a German ordinal.
_AFTER_TIME = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split())
_AFTER_ORDINAL = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember stock etage tag woche monat quartal jahr jahrhundert klasse schicht reihe mal kapitel abschnitt platz auflage halle lager stufe".split()
)
_LANGS = {"en": "en", "eng": "en", "fr": "fr", "fra": "fr", "fre": "fr", "de": "de", "deu": "de", "ger": "de", "es": "es", "spa": "es", "el": "el", "ell": "el", "ar": "ar", "ara": "ar", "hi": "hi", "hin": "hi", "ja": "ja", "jp": "ja", "jpn": "ja", "zh": "zh", "cn": "zh", "zho": "zh", "th": "th", "tha": "th", "pt": "pt", "it": "it", "ru": "ru"}
#: Frequent words by which a text without a usable language code is recognised.
_STOP = {
    "en": "the of and to in is for with on at you be".split(),
    "fr": "le la les des et une dans pour vous est du au".split(),
    "de": "der die das und ist nicht ein eine wir zu im wer".split(),
    "es": "el la los las y una para es del por de se".split(),
    "pt": "o os as e uma para é do da não em um".split(),
    "it": "il lo gli e una per è del della non di un".split(),
}
_ITEM = re.compile(r"[ \t　]*(?:[-*•◦▪‣·–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\))[ \t 　]+(?=\S)")
_SOFT_ITEM = re.compile(r"[ \t　]*[•◦▪‣][ \t 　]*(?=\S)")
_BLANK = re.compile(r"(?:\r\n?|[\n\u0085 \f\v])[ \t 　​]*(?:(?:\r\n?|[\n\u0085 \f\v])[ \t 　​]*)+|[ \f]")
_LINE = re.compile(r"\r\n?|[\n\u0085 \v]")
_THAI = re.compile(r"(?<=[ก-ฺเ-๎຀-໿ក-៓က-႟])[ \t\n\r ]+(?=[ก-ฮเ-ไ຀-ະເ-ໄក-ឳက-ဪ])")
_STOPS = re.compile(f"[{re.escape(STRONG + DOTS)}]")
_CANDIDATE = re.compile(f"[{re.escape(STRONG)};;]|[{re.escape(DOTS)}]+")
_SPACE = re.compile(r"[\s​﻿ ]*")
_BEFORE = re.compile(r"[^\s\"'«»“”„‘’(\[（「]*$")
_URL = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+")


_PAIRED = re.compile(f"[{re.escape(''.join(sorted({*_OPEN, *_CLOSERS})))}]")


#: Scripts that name a language. One decides where it has this share of the letters, Latin ones and its own.
_SCRIPTS = [(lang, re.compile(f"[{lo}-{hi}]+")) for lang, lo, hi in (("el", "Ͱ", "Ͽ"), ("ar", "؀", "ۿ"), ("hi", "ऀ", "ॿ"), ("th", "฀", "๿"), ("ja", "぀", "ヿ"), ("ru", "Ѐ", "ӿ"))]
_SCRIPT_SHARE = 0.1
_LATIN = re.compile("[A-Za-zÀ-ɏ]+")
_HAN = re.compile("[一-鿿]+")


def _letters(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def language(code: str | None, text: str) -> str:
    """A language for the abbreviation lists, from the whole text: from the script, from the code where it is a known one, else from frequent words."""
    latin = 0
    if not text.isascii():
        latin = _letters(_LATIN, text)
        n, lang = max(((_letters(p, text), lang) for lang, p in _SCRIPTS), key=lambda x: x[0])
        if n and n >= _SCRIPT_SHARE * (n + latin):
            return lang
    known = _LANGS.get(re.split(r"[-_]", (code or "").strip().lower())[0])
    if known:
        return known
    if not text.isascii() and (n := _letters(_HAN, text)) and n >= _SCRIPT_SHARE * (n + latin):
        return "zh"
    words = Counter(re.findall(r"[^\W\d_]+", text.lower()))
    score = {k: sum(words[w] for w in v) for k, v in _STOP.items()}
    best = max(score, key=score.get)
    return best if score[best] else "en"


def _abbreviations(lang: str) -> tuple[frozenset, frozenset]:
    return tuple(frozenset(f"{x.get('*', '')} {x.get(lang, '')}".split()) for x in (_NEVER, _FINAL))


_ABBR = {k: _abbreviations(k) for k in {*_LANGS.values(), "*"}}


def _spans(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Balanced quotations and brackets of the block, outermost only, as (position of the opening, of the closing mark).

    Of any length: a mark without a partner in its block is unbalanced, so a straight quotation mark that can only open
    takes the place of an open one, and one that can only close opens nothing.
    """
    out, stack = [], []
    for m in _PAIRED.finditer(text, lo, hi):
        i, ch = m.start(), m[0]
        if ch == '"' or ch == "＂":
            before, after = (text[i - 1] if i > lo else " "), (text[i + 1] if i + 1 < hi else " ")
            opens, closes = before.isspace() or before in _OPEN, not after.isalnum() and not before.isspace()
            if stack and stack[-1][1] == ch:
                j, _ = stack.pop()
                if opens and after.isalnum():
                    stack.append((i, ch))
                else:
                    out.append((j, i))
            elif opens or not closes:
                stack.append((i, ch))
        elif ch == "'":
            before, after = (text[i - 1] if i > lo else " "), (text[i + 1] if i + 1 < hi else " ")
            if stack and stack[-1][1] == "'" and not before.isspace() and not after.isalnum():
                j, _ = stack.pop()
                out.append((j, i))
            elif (before.isspace() or before in _OPEN or before in ":：") and after.isalnum():
                stack.append((i, "'"))
        else:
            for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[k][1] == ch:
                    out.append((stack[k][0], i))
                    del stack[k:]
                    break
            else:
                if ch in _OPEN and not (ch == "‘" and i > lo and text[i - 1].isalnum()):
                    stack.append((i, _OPEN[ch]))
    outer: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _goes_on(text: str, at: int, hi: int) -> bool:
    """Whether what starts at `at` continues a sentence: a lower-case letter, or punctuation that can't start one."""
    while at < hi and text[at] in _DASHES + "- ":
        at += 1
    if at >= hi:
        return False
    ch = text[at]
    return ch.islower() or ch in ",;:)]}،、，；：·؛»”’%" or unicodedata.category(ch) == "Mn"


def _breaks(text: str, lo: int, hi: int, lang: str) -> list[int]:
    """Positions where sentences of the block text[lo:hi] end (without trailing space)."""
    never, final = _ABBR.get(lang, _ABBR["*"])
    spans = _spans(text, lo, hi)
    starts = [a for a, _ in spans]
    urls = [m.span() for m in _URL.finditer(text, lo, hi)]
    ends, since = [], lo
    pos = lo
    while m := _CANDIDATE.search(text, pos, hi):
        pos = m.end()
        mark, at = m[0], m.start()
        if mark in ";;" and (lang != "el" or not _question(text, pos, hi)):
            continue
        if any(a <= at and pos < b - (text[b - 1] in ".!?") for a, b in urls):
            continue
        k = bisect_left(starts, at) - 1
        inside = spans[k] if k >= 0 and spans[k][1] > at else None
        end = pos
        while end < hi and (m2 := _CANDIDATE.match(text, end, hi)) and m2[0] not in ";;":  # "?!", "……。"
            end = m2.end()
        pos = end
        if inside:
            gap = _SPACE.match(text, end).end()
            if gap != inside[1]:
                continue  # within a quotation or bracket
            end = inside[1] + 1
            while end < hi and text[end] in _CLOSERS and text[end] not in _OPEN and text[end] not in "'\"":
                end += 1
            pos = max(pos, end)
            quoted = text[inside[0]] in _QUOTES
        else:
            quoted = False
            while end < hi and text[end] in _CLOSERS and (end not in starts):
                end += 1
            gap = _SPACE.match(text, end).end()
            if gap > end and gap < hi and text[gap] in "»":  # an unbalanced French closing mark
                end = gap + 1
            pos = max(pos, end)
        after = _SPACE.match(text, end).end()
        if after >= hi:
            continue  # the block's end is an end anyway
        spaced, nxt = after > end, text[after]
        word = _BEFORE.search(text, since, at)[0] if not inside else ""
        if inside:
            if not _after_quote(text, inside, after, hi, since, quoted, spaced):
                continue
        elif mark[0] in DOTS:
            if not _after_dots(text, mark, word, at, after, hi, spaced, nxt, never, final, lang):
                continue
        elif _goes_on(text, after, hi) and (text[after] in _DASHES or not spaced or nxt.islower() or nxt in ",;:，、；：،"):
            if mark not in "。！？।॥؟۔｡":
                continue
            if nxt in ",;:，、；：،)）":
                continue
        elif not spaced and mark in "!?" and nxt.isalnum() and not nxt.isupper() and ord(nxt) < 0x2E80:
            continue
        ends.append(end)
        since = after
    return ends


def _question(text: str, at: int, hi: int) -> bool:
    """Whether a Greek question mark (the same sign as a semicolon) ends a sentence here."""
    at = _SPACE.match(text, at).end()
    return at >= hi or not _goes_on(text, at, hi)


def _after_quote(text: str, span: tuple[int, int], after: int, hi: int, since: int, quoted: bool, spaced: bool) -> bool:
    """Whether a sentence ends behind a quotation or bracket that closes with a terminator."""
    nxt = text[after]
    leads = _SPACE.match(text, since).end() >= span[0]
    if _goes_on(text, after, hi) or nxt in "、，,。.!?！？）":
        return False
    if not quoted:  # a bracket: only one that is a whole sentence
        return leads
    if nxt.isupper() or nxt in _OPEN or nxt in "\"'¿¡" or nxt.isdigit():
        return not (nxt in _DASHES)
    if "぀" <= nxt <= "ゟ" and not leads:  # a Japanese particle goes on
        return False
    return not leads


def _after_dots(text: str, mark: str, word: str, at: int, after: int, hi: int, spaced: bool, nxt: str, never: frozenset, final: frozenset, lang: str) -> bool:
    """Whether full stops or an ellipsis end the sentence."""
    wide = ord(nxt) >= 0x2E80
    if len(mark) > 1 or mark == "…":
        if mark.count("…") > 1 or ord(text[at - 1]) >= 0x2E80:
            return nxt not in "、，,）)"
        return not _goes_on(text, after, hi)
    low = word.lower().rstrip(".")
    last = low.rsplit("-", 1)[-1]
    before = text[at - 1] if at else " "
    if before.isdigit():
        if not spaced:
            return False
        if lang == "de" and (m := re.match(r"\w+", text[after:hi])) and m[0].lower() in _AFTER_ORDINAL and re.fullmatch(r"\d{1,3}", low):
            return False
        return not _goes_on(text, after, hi)
    if not spaced:
        # a missing blank: a full word, a stop, and a capital that starts a word; never inside names, codes or Latin between CJK
        return len(last) > 1 and word.isalpha() and word[1:].islower() and low not in never and low not in final and nxt.isupper() and not wide and (after + 1 >= hi or text[after + 1] != "." or (len(last) > 2 and text[after + 2 : after + 3].isspace())) or (nxt in "\"“«„¿¡(" and len(last) > 2 and word.isalpha() and low not in never)
    if low in never or last in never:
        numbered = low in ("no", "nos", "p", "pp", "ch", "sec", "m", "s", "c", "d", "ex", "art", "min", "max", "mon", "sat", "sun", "mar", "est", "col", "gen", "ed", "me")
        if low in ("no", "nos") and not nxt.isdigit():
            return not _goes_on(text, after, hi)
        if word[:1].islower() and numbered and low in ("mon", "sat", "sun", "mar", "est", "me", "ex"):
            return not _goes_on(text, after, hi) and low not in ("ex",)
        return False
    if len(low) == 1 and low.isalpha():
        if word[:1].isupper() or lang in ("ar", "hi"):
            return False  # an initial
        if low == "m" and re.search(r"\b[ap]\.\s?m$", text[max(0, at - 6) : at]):
            return nxt.isupper() and _next_word(text, after, hi) not in _AFTER_TIME
        return _opens(text, after, hi)
    if low in final or last in final:
        return _opens(text, after, hi) and _next_word(text, after, hi) not in _AFTER_TIME
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", low):  # "b.o.b."
        return nxt.isupper() and word[:1].islower() and _next_word(text, after, hi) not in _AFTER_TIME
    if re.search(r"\d\.[^\W\d_]$", low):  # "9.B."
        return nxt.isupper()
    if nxt in ",;:)،，、":
        return False
    return True


def _opens(text: str, at: int, hi: int) -> bool:
    """Whether a capital stands here, if need be behind an opening bracket or quote."""
    while at < hi and (text[at] in _OPEN or text[at] in "\"'¿¡ "):
        at += 1
    return at < hi and text[at].isupper()


def _next_word(text: str, at: int, hi: int) -> str:
    m = re.match(r"\w+", text[at:hi])
    return m[0].lower() if m else ""


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Paragraphs and list entries as (start, end, whether it is a list entry); the start is behind the list marker."""
    cuts = [0, *(x for m in _BLANK.finditer(text) for x in m.span()), len(text)]
    for lo, hi in zip(cuts[::2], cuts[1::2], strict=True):
        lines, p = [], lo
        for m in _LINE.finditer(text, lo, hi):
            lines.append((p, m.start()))
            p = m.end()
        lines.append((p, hi))
        start, item = None, False
        for a, b in lines:
            m = _ITEM.match(text, a, b) if start is None or item else _SOFT_ITEM.match(text, a, b)
            if m:
                if start is not None:
                    yield start, prev, item
                start, item = m.end(), True
            elif start is None:
                start = a
            elif item and text[a:b].strip() and not text[a].isspace() and not text[a].islower() and not text[a].isdigit():
                yield start, prev, item
                start, item = a, False
            prev = b
        if start is not None:
            yield start, prev, item


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every unit in code points; none for null and blank texts."""
    if not text or not text.strip():
        return []
    lang = language(lang, text)
    out = []
    for lo, hi, item in _blocks(text):
        ends = [] if item else _breaks(text, lo, hi, lang)
        a = lo
        for e in [*ends, hi]:
            pieces = [(a, e)]
            if not item and "฀" < max(text[a:e] or " ") and not _STOPS.search(re.sub(r"\d[.,]\d", "", text[a : e - 1] if e - a > 1 else "")):
                cut = [a, *(x for m in _THAI.finditer(text, a, e) for x in m.span()), e]
                pieces = list(zip(cut[::2], cut[1::2], strict=True))
            for s, t in pieces:
                while s < t and (text[s].isspace() or text[s] in "​﻿"):
                    s += 1
                while s < t and (text[t - 1].isspace() or text[t - 1] in "​﻿"):
                    t -= 1
                if s < t:
                    out.append((s, t))
            a = e
    return out


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(id, start_pos, end_pos): one row per sentence, heading and list entry, positions in code points, end exclusive.

    One pass without a shuffle; the text itself never leaves its partition. Null and blank texts give no
    rows; a repeated document gives its rows as often; a null id keeps its rows; other columns aren't read.
    """
    kind = dict(df.dtypes)[id_col]
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, starts, ends = [], [], []
            for i, t, g in zip(b["id"], b["text"], b["lang"], strict=True):
                for s, e in sentence_spans(t, g):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=b["id"].dtype), "start_pos": pd.Series(starts, dtype="int64"), "end_pos": pd.Series(ends, dtype="int64")})

    spec = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"))
    return spec.mapInPandas(split, f"`{id_col}` {kind}, start_pos bigint, end_pos bigint")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every document."""
    return sentences(table(spark, sf_dir, "documents"))


def p9_units_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every language code: documents with text, units, and mean characters of a unit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    units = p9_found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("chars"))
    return (
        docs.join(units, "doc_id")
        .groupBy("lang")
        .agg(F.count("*").alias("documents"), F.sum("n").alias("units"), F.round(F.sum("chars") / F.sum("n"), 3).alias("mean_chars"))
    )


QUERIES = {"p9_found": p9_found, "p9_units_by_language": p9_units_by_language}
