"""Personal data in plain and disguised form, with spans in the source's characters.

Plain identifiers are found by fixed patterns. Disguised ones: a chain of small transducers rewrites the text (look-alike
letters and foreign digits to ASCII, invisible characters to nothing, spelled digits to digits, at/dot disguises to ``@``
and ``.``), and every character of the result keeps the source range it came from. The same patterns then run over the
result and their spans are mapped back. A span found that way is added unless it meets a plain one of its kind.

All scans are linear in the text, so long texts and long runs of digits are no trouble. Transducers run only over texts
that show one of their signs. A null or empty text has no spans. Repeated rows are treated each; an empty table gives an
empty result. :func:`redacted` keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .textkit import arrow_batch

KINDS = ("email", "ip", "card", "phone")
# What an identifier looks like.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα", "ABEKMHOPCTXaeopcyxijsdqw" "ABEZHIKMNOPTYXoa"))
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
NUMBER = "(?:%s)" % "|".join(DIGITS)
SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[\s-]+)?{NUMBER}(?:(?:[\s-]+|\s*(?:,|\bdot\b|\bpoint\b)\s*){NUMBER}){{3,}}(?!\w)")
# Generic last labels, words of two letters that are prose rather than a country, and words before a
# "dot" that are prose rather than a host; words before "at host.label" that are no mailbox.
GENERIC = frozenset("com org net edu gov mil info biz app dev in it us at be no so my me".split())
TWO_LETTERS = frozenset("an as by do go he if is of oh on or to up we".split())
DETERMINERS = frozenset("a an the this that each every my our your his her its their".split())
NO_MAILBOX = frozenset("us me him her them it you now here information details form page list address support team".split())
OPEN, CLOSE, WORD = "[({<", "])}>", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
AT = re.compile(r"(?i)[\[({<]\s*+(?:at|@)\s*+[\])}>]")
DOT = re.compile(r"(?i)[\[({<]\s*+(?:dot|\.)\s*+[\])}>]")
#: Any "at": in brackets, a word or sign with white space on both sides, or plain.
ANY_AT = re.compile(AT.pattern + r"|(?<=\s)(?:at|@)(?=\s)|@")
ANY_DOT = r"(?:\s*+[\[({<]\s*+(?:dot|\.)\s*+[\])}>]\s*+|\s++(?:dot|\.)\s++|\.)"
HOST = re.compile(rf"(?i)\s*+[a-z0-9-]++(?:{ANY_DOT}[a-z0-9-]++)+")
SEPARATOR = re.compile(rf"(?i){ANY_DOT}")
#: Four numbers with dots of any form but white space around a plain one.
NUMBERS = re.compile(r"(?i)(?<![0-9.])[0-9]++(?:(?:\s*+[\[({<]\s*+(?:dot|\.)\s*+[\])}>]\s*+|\s++(?:dot|point)\s++|\.)[0-9]++){3}(?![0-9])")
NUMBER_DOT = re.compile(r"[^0-9]+")
CUE = re.compile(r"(?i)(?:(?:\be-?mail(?:ed|s)?|\bmailto|\bcontact|\bwrite to|\baddress)(?: is)?|\b(?:from|to|cc|bcc|reply-to)\s?:)\s?:?\s?$")
#: What every disguise accepted here shows: a dot or an "at" in brackets, a dot with white space around it, an "at" before a
#: plain host, or spelled digits. (An address with a plain "@" and plain dots in its host is no disguise.)
SIGNS = re.compile(AT.pattern + "|" + DOT.pattern[4:] + r"|\s(?:dot|\.|point)\s|\s(?:at|@)\s+[a-z0-9-]+\.[a-z0-9]|" + SPELLED.pattern[4:])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        v = v * 2 if i % 2 else v
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost and non-overlapping; matches that fail their test are dropped."""
    small = lambda x: len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255
    out = {k: [] for k in KINDS}
    out["email"] = list(emails(text))
    out["ip"] = [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


class Traced:
    """A text under rewriting; character i came from ``lo[i] .. hi[i]`` of the source."""

    def __init__(self, text: str):
        self.text, self.lo = text, np.arange(len(text))
        self.hi = self.lo + 1

    def rewrite(self, spans: list[tuple[int, int, str]]) -> None:
        """Put new characters in place of spans (sorted, disjoint); each comes from its whole span."""
        if not spans:
            return
        text, lo, hi, at = [], [], [], 0
        for a, b, new in spans:
            text += [self.text[at:a], new]
            lo += [self.lo[at:a], np.full(len(new), self.lo[a])]
            hi += [self.hi[at:a], np.full(len(new), self.hi[b - 1])]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.lo, self.hi = np.concatenate([*lo, self.lo[at:]]), np.concatenate([*hi, self.hi[at:]])


def odd_characters() -> re.Pattern:
    """Full-width forms, look-alikes, invisible characters and digits of other scripts."""
    return re.compile("[%s！-～%s]|(?![0-9])\\d" % ("".join(LOOKALIKES), INVISIBLE))


ODD = odd_characters()


def as_ascii(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return LOOKALIKES.get(c) or str(unicodedata.digit(c))


def spelled(words: str) -> str:
    out = []
    for w in re.findall(r"[a-z]+|,", words.lower()):
        out.append("+" if w == "plus" else "." if w in ("dot", "point") else DIGITS.get(w, ""))
    return "".join(out)


def gap_before(text: str, at: int, least: int) -> int:
    """Where the white space that ends at ``at`` begins."""
    while at > least and text[at - 1].isspace():
        at -= 1
    return at


def dot_before(text: str, end: int, least: int) -> int | None:
    """Where a dot of any form that ends at ``end`` begins."""
    at = gap_before(text, end, least)
    if at > least and text[at - 1] in CLOSE:
        inner = gap_before(text, at - 1, least)
        size = 1 if text[inner - 1:inner] == "." else 3 if text[max(inner - 3, 0):inner].lower() == "dot" else 0
        inner = gap_before(text, inner - size, least)
        return gap_before(text, inner - 1, least) if size and inner > least and text[inner - 1] in OPEN else None
    for mark in (".", "dot"):
        if text[max(at - len(mark), 0):at].lower() == mark:
            begin = gap_before(text, at - len(mark), least)
            if (begin < at - len(mark)) == (at < end) and (mark == "." or at < end):
                return begin
    return None


def form(separator: str) -> str:
    """How a separator is written: plain, spaced, spoken, or in brackets as a sign or a word."""
    core = separator.strip()
    word = any(c.isalpha() for c in core)
    return "bracketed word" if word and len(core) > 3 else "bracketed" if len(core) > 1 and not word else "spoken" if word else "plain" if core == separator else "spaced"


def is_ending(label: str, loose: bool) -> bool:
    """``loose``: any letters, two at least; else a generic label, or two letters that are not prose."""
    label = label.lower()
    return label.isalpha() and len(label) > 1 and (loose or label in GENERIC or (len(label) == 2 and label not in TWO_LETTERS))


def addressed(text: str, start: int, name: str, end: int) -> bool:
    """Whether the surroundings of "name at host.label" say that it is an address: a name with a dot, underscore or plus, a
    word for mail before it, brackets or quotes around it, or a line of its own."""
    if name.lower() in NO_MAILBOX:
        return False
    if any(c in name for c in "._+") or CUE.search(text[max(start - 40, 0):start]):
        return True
    before, after = text[start - 1:start] or "\n", text[end:end + 1] or "\n"
    return (before == "\n" and after == "\n") or before + after in ("<>", "()", "[]", "{}", '""', "''")


def addresses(text: str):
    """(begin, end, new character) of the separators of disguised addresses.

    A separator, the "at" as well as each dot, is plain, has white space around it, is a word, or stands in brackets, each
    independently of the others; one of them at least is not plain. A bracketed or plain "at", or a dot that is a
    bracketed word, takes any ending; a spoken "at" with a spoken dot, or a spaced "@", an ending of :func:`is_ending`.
    A spoken "at" with other dots is an address only where :func:`addressed` says so, as prose has "look at host.label".
    """
    done = 0
    for m in ANY_AT.finditer(text):
        if m.start() < done:
            continue
        host = HOST.match(text, m.end())
        if not host:
            continue
        first = m.end() + len(host[0]) - len(host[0].lstrip())
        begin = gap_before(text, m.start(), done)
        kind = form(text[begin:first] if m[0][0] not in OPEN else m[0])
        if kind == "plain" and first > m.end() or kind == "spaced" and (begin == m.start() or first == m.end()):
            continue
        start, dots = begin, []
        while True:
            word = start
            while start > done and text[start - 1] in WORD:
                start -= 1
            if start == word:
                if dots:
                    start = dots.pop()[1]  # a dot without a word before it
                break
            dot = dot_before(text, start, done)
            if dot is None or dot <= done:
                break
            dots.append((dot, start))
            start = dot
        if start == begin:
            continue
        dots.reverse()
        marks = list(SEPARATOR.finditer(text, first, host.end()))
        labels = [text[a:b] for a, b in zip([first, *(x.end() for x in marks)], [*(x.start() for x in marks), host.end()])]
        for n in range(len(marks), 0, -1):
            forms = {form(x[0]) for x in marks[:n]}
            end = marks[n].start() if n < len(marks) else host.end()
            if kind == "plain":
                good = forms != {"plain"} and is_ending(labels[n], True)
            elif kind.startswith("bracketed"):
                good = is_ending(labels[n], True)
            elif "bracketed word" in forms:
                good = is_ending(labels[n], True) and labels[0].lower() not in DETERMINERS
            elif "spoken" in forms or kind == "spaced":
                good = is_ending(labels[n], False) and labels[0].lower() not in DETERMINERS
            else:
                good = is_ending(labels[n], False) and addressed(text, start, text[start:begin], end)
            if good:
                yield from ((a, b, ".") for a, b in dots)
                yield begin, first, "@"
                yield from ((*x.span(), ".") for x in marks[:n])
                done = end
                break


def bracketed(text: str, core: re.Pattern, new: str) -> list[tuple[int, int, str]]:
    """Rewritings of all matches of ``core`` with the white space around them."""
    out, done = [], 0
    for m in core.finditer(text):
        end = m.end()
        while end < len(text) and text[end].isspace():
            end += 1
        out.append((gap_before(text, m.start(), done), end, new))
        done = end
    return out


def disguised(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans, in the source, of identifiers that show only after rewriting."""
    t = Traced(text)
    t.rewrite([(m.start(), m.end(), as_ascii(m[0])) for m in ODD.finditer(text)])
    t.rewrite([(m.start(), m.end(), spelled(m[0])) for m in SPELLED.finditer(t.text)])
    t.rewrite([(*x.span(), ".") for m in NUMBERS.finditer(t.text) for x in NUMBER_DOT.finditer(t.text, m.start(), m.end())])
    t.rewrite(list(addresses(t.text)))
    t.rewrite(bracketed(t.text, AT, "@"))
    t.rewrite(bracketed(t.text, DOT, "."))
    return {k: [(int(t.lo[a]), int(t.hi[b - 1])) for a, b in v] for k, v in plain(t.text).items()}


def spans(text: str) -> tuple[dict, dict]:
    """(plain spans, plain and added spans) by kind."""
    base = plain(text)
    if not (SIGNS.search(text) or (not text.isascii() and ODD.search(text))):
        return base, base
    both = {}
    for kind, more in disguised(text).items():
        own, at = base[kind], 0
        both[kind] = list(own)
        for a, b in more:  # both lists are sorted
            while at < len(own) and own[at][1] <= a:
                at += 1
            if at == len(own) or own[at][0] >= b:
                both[kind].append((a, b))
        both[kind].sort()
    return base, both


def listed(found: dict) -> str:
    """kind:start:end by start, then kind in the order of KINDS."""
    flat = sorted((a, KINDS.index(k), b) for k, v in found.items() for a, b in v)
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in flat)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FOUND for every row: numbers and digest of the plain spans, and all spans."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, both = spans(text)
                out.append((*(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(both)))
            yield arrow_batch(FOUND, [batch.column(0), *(zip(*out) if out else [[]] * 6)])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).mapInArrow(run, FOUND)


def without(text: str) -> str:
    """The text with each identifier (overlapping ones as one) replaced by its kind in brackets."""
    flat = sorted((a, KINDS.index(k), b) for k, v in spans(text)[1].items() for a, b in v)
    out, at, i = [], 0, 0
    while i < len(flat):
        a, kind, b = flat[i]
        while i + 1 < len(flat) and flat[i + 1][0] < b:
            i += 1
            b = max(b, flat[i][2])
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at, i = b, i + 1
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with identifiers in the text replaced; null texts stay null, other columns stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kind = batch.schema.field(at).type
            texts = pa.array([None if t is None else without(t) for t in batch.column(at).to_pylist()], kind)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)
