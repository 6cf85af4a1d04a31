"""Sentence boundaries in many languages and scripts (problem 9).

A text is parted at empty or blank lines; each part is read once by a pushdown automaton whose
symbols are the final marks of all scripts, quotation marks and brackets, the stops of list levels,
and (in Thai) blanks. Its stack holds an open quotation or bracket in each frame, together with the
state from before it: where the sentence began and how many boundaries there were. A boundary found
inside a frame is provisional: when the frame closes, the state from before comes back, so quoted or
bracketed text stays whole, and the mark before the closing one decides whether the sentence ends
there. A frame that never closes keeps what was found in it, so a stray mark hides nothing. A list
level (``1.``, ``1.2.``, ``IV.``) is a state that a sentence begins in and that lasts while one
number after the other comes. Abbreviations are kept in a trie of reversed spellings that is walked
back from a full stop. The output are offsets in code points.

Defined results: null, empty and blank texts give no row; offsets never include white space at the
ends; a rest without a mark is a sentence; repeated documents repeat their rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the languages. NEVER: no sentence ends there if a text follows. NUMERIC: none ends
# before a number. MAY: one ends unless a small letter follows. LATE: as MAY, and also in texts that
# have no capitals at all.
NEVER = """
dr mr mrs ms mx prof st rev gen col capt lt sgt hon pres gov sen rep messrs mt ft
e.g i.e vs viz cf approx al resp incl excl est
hr fr frau bzw ca z.b z. b d.h d. h u.a u. a o.ä evtl ggf inkl vgl sog zzgl abzgl dipl ing zz
mme mlle mgr env c.-à-d p.ex p. ex réf
sr sra srta dña p.ej p. ej aprox ud uds vd vds núm lic ing arq
dott sig sig.ra
dra exmo exma profa
π.χ π. χ δηλ κ κα κος περ αρ τηλ
د أ م ص ج
डॉ श्री प्रो रु कृ पं
กก ซม กม มม ม ดร พ.ศ ค.ศ น ร.ร
jan feb apr jun jul aug sept sep oct okt nov dez
""".split("\n")
NUMERIC = "no nos nr nrn nº p pp pg pág págs sec sect ch chap fig figs abb tab art cap vol bd s seite ver v n núm ref par z kap εικ σελ".split()
MAY = "co inc ltd corp bros ave blvd rd jr u.s e.u u.k u.n u.s.a d.c ph.d m.d b.a m.a esq gmbh e.v s.a s.l e.u.a ee.uu dept".split()
LATE = "etc usw p.m a.m u.s.w u.v.m ff ecc κ.λπ κ.ά κλπ".split()
MONTHS = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember jan feb apr jun jul aug sep sept okt nov dez "
    "januari februari mars maj juni augusti januar marts tammikuuta helmikuuta ledna února března dubna května června července srpna září října listopadu prosince "
    "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia".split()
)
AND_WORDS = frozenset(
    "and but or nor then und aber oder denn sondern y e ni pero sino et puis mais ou donc mas nem então και κι ή αλλά όμως ed ma oppure maar och eller og ale".split()
)
# Particles that close a Thai statement or question: polite ones, softening ones, tags of questions.
THAI_FINALS = ("ครับ", "ครับผม", "คับ", "ฮะ", "ขอรับ", "ค่ะ", "คะ", "ค๊ะ", "จ้ะ", "จ้า", "จ๊ะ", "จ๋า", "นะ", "น่ะ", "น้า", "ล่ะ", "เถอะ", "เถิด", "สิ", "ซิ", "หรอก", "แหละ", "ไหม", "มั้ย", "หรือยัง", "หรือเปล่า", "หรือไม่", "ใช่ไหม", "รึเปล่า", "รึยัง", "เหรอ", "หรอ")
OPENERS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "«": "»", "„": "“", "‹": "›", "‚": "‘", "〔": "〕"}
CLOSERS = frozenset(OPENERS.values()) | {"”", '"', "’", "＂"}
HARD = "!?。！？।॥؟۔‼⁇⁈⁉｡"
SOFT = ".…．"
GREEK_QUESTION = ";;"

_INVISIBLE = "­​‌⁠﻿"
_EMOJI = "[\U0001f000-\U0001fbff☀-➿⬀-⯿⌚-⏿⃣️‍]"
_TAIL = re.compile(f"(?:[{re.escape(HARD + SOFT)}]| ?{_EMOJI}+|[)\\]}}）］】」』》〉”»›＂]|[\"“’](?=\\s|$))*")
_RUN = re.compile(f"[{re.escape(HARD + SOFT)}]+")
_BREAK = r"(?:\r\n|\r(?!\n)|(?<!\r)\n)"  # never one half of a pair
_PART = re.compile(rf"{_BREAK}[^\S\r\n]*(?:{_BREAK}[^\S\r\n]*)+")
_PAIRED = frozenset(OPENERS) | CLOSERS - {"’"}
_EVENT = re.compile(f"[{re.escape(HARD + SOFT + GREEK_QUESTION)}]|[{re.escape(''.join(sorted(_PAIRED)))}]|(?<=[฀-๿{_INVISIBLE}])\\s+")
_WORD = re.compile(r"[^\W\d_]+")
_ROMAN = re.compile("(?=.)X{0,3}(?:IX|IV|V?I{0,3})")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
# Top-level names (those of RFC 2606, the first generic ones, some of countries) and endings of files.
_NAME_ENDS = frozenset("com org net edu gov mil int info biz app dev io ai co uk de fr es pt it gr jp cn th in sa ae eg us ca eu ch at nl example test invalid localhost".split())
_FILE_ENDS = frozenset("htm html php asp js css json xml txt csv pdf doc docx xls xlsx ppt png jpg jpeg gif svg mp3 mp4 zip gz tar exe py".split())
_LABEL = re.compile(r"[a-z0-9](?:[\w\-]*[a-z0-9])?", re.ASCII | re.IGNORECASE)


def _trie(groups: dict[str, list[str]]) -> dict:
    root: dict = {}
    for kind, words in groups.items():
        for word in words:
            for form in {word, unicodedata.normalize("NFD", word)}:
                node = root
                for char in reversed(form):
                    node = node.setdefault(char, {})
                node.setdefault("kind", kind)
    return root


def _never() -> list[str]:
    """NEVER holds words parted by blanks; spellings with a blank inside (``z. b``) come in twos."""
    words: list[str] = []
    for line in NEVER:
        for word in line.split():
            if words and words[-1].endswith(".") and len(word) <= 2:
                words[-1] = f"{words[-1]} {word}"
            else:
                words.append(word)
    return [w for w in words if not w.endswith(".")]


ABBREVIATIONS = _trie({"late": LATE, "may": MAY, "numeric": NUMERIC, "never": _never()})


def abbreviation(text: str, dot: int) -> tuple[str | None, int]:
    """Kind of the abbreviation that ends at the full stop, by the longest spelling, and its begin."""
    node, at, found, begin, last = ABBREVIATIONS, dot - 1, None, dot, ""
    while at >= 0:
        char = text[at]
        if char in _INVISIBLE:
            at -= 1
            continue
        node = node.get(char.lower()) or (node.get(" ") if char in "  " else None)
        if node is None:
            break
        if "kind" in node and (at == 0 or not _wordy(text[at - 1])):
            found, begin = node["kind"], at
        at -= 1
    return found, begin


def _wordy(char: str) -> bool:
    return char.isalnum() or unicodedata.category(char)[0] == "M"


def _caseless(char: str) -> bool:
    return char.isalpha() and char.lower() == char.upper()


class _Stack:
    """The open quotations and brackets, found by kind without a search; a frame keeps the state to come back to."""

    def __init__(self) -> None:
        self.frames: list[tuple[str, int, int, int]] = []  # closing mark, place, begin of the sentence, boundaries so far
        self.places: dict[str, list[int]] = {}

    def push(self, kind: str, at: int, begin: int, found: int) -> None:
        self.places.setdefault(kind, []).append(len(self.frames))
        self.frames.append((kind, at, begin, found))

    def close(self, char: str) -> tuple[str, int, int, int] | None:
        """The innermost frame that the mark closes; strays above it go too."""
        depth = max((self.places[k][-1] for k in ("”“" if char == "”" else char) if self.places.get(k)), default=None)
        if depth is None:
            return None
        frame = self.frames[depth]
        while len(self.frames) > depth:
            self.places[self.frames.pop()[0]].pop()
        return frame


def _next_visible(text: str, at: int) -> int:
    n = len(text)
    while at < n and (text[at].isspace() or text[at] in _INVISIBLE):
        at += 1
    return at


def _last_letter(text: str, at: int, floor: int) -> str:
    for i in range(at - 1, floor - 1, -1):
        if text[i].isalpha():
            return text[i]
    return ""


def _thai_final(text: str, at: int, floor: int) -> bool:
    """Whether a final word ends at ``at``, through invisible characters and held letters."""
    said = ""
    for i in range(at - 1, floor - 1, -1):
        char = text[i]
        if char in _INVISIBLE or char == said[:1]:
            continue
        said = char + said
        if said in THAI_FINALS:
            return True
        if not any(x.endswith(said) for x in THAI_FINALS):
            return False
    return False


class _Token:
    """What stands between the blanks around ``at``."""

    def __init__(self, text: str, at: int) -> None:
        left = right = at
        while left and not text[left - 1].isspace():
            left -= 1
        while right < len(text) and not text[right].isspace():
            right += 1
        token = text[left:right]
        self.left, self.right = left, right
        self.is_address = "://" in token or "@" in token
        # The form of a name: labels of Latin letters and digits with nothing but stops between them, before a path or port.
        labels = re.split(r"[/:?#]", token.strip(".,;!?()[]{}\"'“”«»"), maxsplit=1)[0].split(".")
        named = len(labels) >= 2 and all(map(_LABEL.fullmatch, labels))
        self.is_host = named and (len(labels) >= 3 or labels[-1].lower() in _NAME_ENDS | _FILE_ENDS)


def _is_emoji(char: str) -> bool:
    return "\U0001f000" <= char <= "\U0001fbff" or "☀" <= char <= "➿" or "⬀" <= char <= "⯿"


def _stop_ends(text: str, at: int, begin: int, small: bool, tokens: list[_Token]) -> bool:
    """Whether the single full stop at ``at`` ends the sentence that began at ``begin`` (or whose list level reaches there). ``tokens`` keeps the last token looked up."""
    n = len(text)
    after = text[at + 1] if at + 1 < n else ""
    before = text[at - 1] if at else " "
    if after.isdigit() and (before.isalnum() or not before.strip() or before in "$€£+-(\"“"):
        return False
    if after in "ºª°":
        return False
    touching = bool(after) and (after.isalnum() or after in "_@/")
    upto = _next_visible(text, at + 1)
    follows = text[upto] if upto < n else ""
    if not follows or _is_emoji(follows):
        return True
    if after in CLOSERS:  # the end of a quotation that began in another part
        beyond = _next_visible(text, at + 2)
        if beyond < n and text[beyond].islower() and not small:
            return False
    if "฀" <= before <= "๿":
        return False
    kind, since = abbreviation(text, at)
    if kind == "numeric" and not follows.isdigit():
        kind = None
    if kind in ("never", "numeric"):
        return False
    if kind in ("may", "late"):
        if follows in ",;:)-–/&":
            return False
        return not (follows.islower() and not (small and kind == "late"))
    word = at
    while word > begin and _wordy(text[word - 1]):
        word -= 1
    head = text[word:at]
    # Initials: one letter before the stop.
    letters = unicodedata.normalize("NFC", head)
    if len(letters) == 1 and letters.isalpha() and (follows.isalnum()) and letters != "I":
        return False
    if word == begin and not touching and (head.isdigit() or _ROMAN.fullmatch(head)):
        return False  # the level of a list
    if head.isdigit():
        m = _WORD.match(text, upto)
        if len(head) <= 2 and m and m.group().lower() in MONTHS:
            return False
    if touching:
        if not tokens or not tokens[0].left <= at < tokens[0].right:
            tokens[:] = [_Token(text, at)]
        if tokens[0].is_address:
            return False
        if after.isupper():
            return True
        if _caseless(after):
            return not head or _caseless(before) or before.isdigit() or unicodedata.category(before)[0] == "M"
        if not small or not after.isalpha():
            return False
        return not tokens[0].is_host
    return True


def _ellipsis_ends(text: str, upto: int) -> bool:
    at = _next_visible(text, upto)
    if at >= len(text):
        return True
    char = text[at]
    return char.isupper() or _is_emoji(char) or char in "¿¡" or (char in OPENERS and char not in "（(「『")


def _close_ends(text: str, opened: int, closed: int, begin: int, small: bool) -> bool:
    """Whether a sentence ends with the quotation or bracket whose content ends with a final mark."""
    last = _last_letter(text, closed, opened)
    if last and _caseless(last):
        return False
    at = _next_visible(text, closed + 1)
    if at >= len(text):
        return True
    char = text[at]
    if char.islower():
        if not small:
            return False
        first = _next_visible(text, begin) == opened
        if text[opened] in "([{":
            return first
        m = _WORD.match(text, at)
        return not first and not (m and m.group() in AND_WORDS)
    return char.isupper() or char.isdigit() or _is_emoji(char) or char in "¿¡-–•*" or char in OPENERS or char == '"' or _caseless(char)


def _part_spans(text: str) -> Iterator[tuple[int, int]]:
    n = len(text)
    stack = _Stack()
    small = text.lower() == text and text.upper() != text
    begin, free = 0, 0  # the sentence's begin, and from where on marks count
    level = -1  # how far the list level at the sentence's begin reaches
    ends: list[int] = []
    greek: list[int] | None = None
    tokens: list[_Token] = []
    for m in _EVENT.finditer(text):
        i, char = m.start(), m.group()[0]
        end = -1
        if char in _PAIRED:
            frame = stack.close(char)
            if frame is None:
                if char in OPENERS or char in '"＂':
                    stack.push(OPENERS.get(char, char), i, begin, len(ends))
                continue
            _, opened, begin, found = frame
            del ends[found:]
            free, level = i + 1, -1
            last = i
            while last > opened + 1 and text[last - 1].isspace():
                last -= 1
            if last > opened + 1 and text[last - 1] in HARD + SOFT and not (free < n and text[free] in HARD + SOFT) and _close_ends(text, opened, i, begin, small):
                end = free
        elif i < free:
            continue
        elif char.isspace():
            free = m.end()
            if _thai_final(text, i, begin):
                end = i
        elif char in GREEK_QUESTION:
            free = i + 1
            if greek is None:
                greek = [x.start() for x in _GREEK.finditer(text)]
            at = bisect_left(greek, begin)
            if at < len(greek) and greek[at] < i:
                end = free
        else:
            run = _RUN.match(text, i)
            free = run.end()
            marks = run.group()
            if any(c in HARD for c in marks):
                end = free if text[free : free + 1] != "=" else -1
            elif marks in (".", "．"):
                since = max(_next_visible(text, begin), level)
                if _stop_ends(text, i, since, small, tokens):
                    end = free
                elif text[since:i].isdigit():
                    level = free
            elif _ellipsis_ends(text, free):
                end = free
        if end >= 0:
            end = _TAIL.match(text, end).end()
            ends.append(end)
            begin, free, level = end, max(free, end), -1
    begin = 0
    for end in ends:
        yield begin, end
        begin = end
    if begin < n:
        yield begin, n


def spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence in code points."""
    out, at = [], 0
    for m in [*_PART.finditer(text), None]:
        upto = m.start() if m else len(text)
        for a, b in _part_spans(text[at:upto]):
            piece = text[at + a : at + b]
            left = len(piece) - len(piece.lstrip())
            right = len(piece.rstrip())
            if right > left:
                out.append((at + a + left, at + a + right))
        at = m.end() if m else upto
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs: list[int] = []
        begins: list[int] = []
        ends: list[int] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                for a, b in spans(text):
                    docs.append(doc)
                    begins.append(a)
                    ends.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "begin_char", "end_char"])


def sentence_spans(documents: DataFrame) -> DataFrame:
    """``doc_id, begin_char, end_char`` of every sentence of every document."""
    return documents.select("doc_id", "text").mapInArrow(_rows, "doc_id bigint, begin_char bigint, end_char bigint")
