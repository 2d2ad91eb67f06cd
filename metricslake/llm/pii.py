"""Personal data by anchor expansion (operator 3).

One Aho-Corasick automaton finds the anchors of a text in a single pass: at-signs, plus
signs, digits, URL schemes and identifier cues. From each anchor a deterministic local
parser expands to the left and right and validates what it has bounded. Spans of one kind
do not overlap: a parser starts at or after the end of the last span bounded for its kind,
whether that one was valid or not.

Kinds of the contract: ``email``, ``ip`` (four numbers of at most 255), ``card`` (13 to 19
digits with a right Luhn sum), ``phone`` (plus sign, 9 to 15 digits). Kinds of the method:
``url`` (a scheme and an address with user and password), ``iban`` (after its cue, with a
right check number) and ``ssn`` (after its cue, in an assigned range).
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricslake.llm.common import lean

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "ssn")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://")
CUES = {"iban": "iban", "ssn": "ssn", "social security number": "ssn"}

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LABEL = DIGITS | LETTERS | {"-"}
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
PHONE = DIGITS | frozenset(" ().-")

Span = tuple[str, int, int]


def run_of(text: str, at: int, allowed: frozenset) -> int:
    """End of the longest run of ``allowed`` characters from ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email(text: str, at: int, floor: int) -> Span | None:
    """From an at-sign: the local part to the left, two or more labels to the right."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_of(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while text[end : end + 1] == "." and text[end + 1 : end + 2] in LABEL:
        end = run_of(text, end + 1, LABEL)
        labels += 1
    return ("email", start, end) if labels > 1 else None


def ip(text: str, start: int) -> tuple[int, bool] | None:
    """From the first digit of a number: end of four dotted numbers and whether all are small enough."""
    end, valid = start, True
    for part in range(4):
        begin = end + (part > 0)
        if part and text[end : end + 1] != ".":
            return None
        end = run_of(text, begin, DIGITS)
        if end == begin:
            return None
        number = text[begin:end].lstrip("0")
        valid &= len(number) <= 3 and int(number or 0) <= 255
    return end, valid


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def card(text: str, start: int) -> tuple[int, bool]:
    """From a digit: end of the digits joined by at most one space or hyphen each, and validity."""
    end, n = start + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and text[end + 1 : end + 2] in DIGITS and end + 1 < n:
            end += 2
        else:
            break
    digits = text[start:end].replace(" ", "").replace("-", "")
    return end, 13 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, plus: int) -> tuple[int, bool] | None:
    """From a plus sign: end of the number and whether its digits are as many as a number has."""
    if text[plus + 1 : plus + 2] not in DIGITS or plus + 1 >= len(text):
        return None
    end = run_of(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3 or text[end - 1] not in DIGITS:
        return None
    return end, 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15


def credentials(text: str, scheme: int, begin: int) -> Span | None:
    """From a URL scheme: user, password and host before the path."""
    end = begin
    while end < len(text) and text[end] not in "/?#\"'<> \t\r\n":
        end += 1
    user, at, host = text[begin:end].rpartition("@")
    if at and ":" in user.strip(":") and host[:1] in LABEL and host:
        return "url", scheme, end
    return None


def iban(text: str, at: int) -> Span | None:
    """After its cue: country, check number and account in groups; ISO 7064 remainder 1."""
    while at < len(text) and text[at] in " :#=.":
        at += 1
    end, chars = at, []
    while end < len(text) and len(chars) < 34:
        if text[end] in LETTERS or text[end] in DIGITS:
            chars.append(text[end].upper())
            end += 1
        elif text[end] == " " and chars and text[end + 1 : end + 2] in DIGITS | LETTERS and end + 1 < len(text):
            end += 1
        else:
            break
        if len(chars) >= 15 and not (text[end : end + 1] in DIGITS | LETTERS and end < len(text)) and _iban_valid(chars):
            return "iban", at, end
    return None


def _iban_valid(chars: list[str]) -> bool:
    if not (all(c in LETTERS for c in chars[:2]) and all(c in DIGITS for c in chars[2:4])):
        return False
    return int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1


def ssn(text: str, at: int) -> Span | None:
    """After its cue: three, two and four digits with hyphens or spaces, in an assigned range."""
    while at < len(text) and text[at] in " :#=.":
        at += 1
    found = text[at : at + 11]
    a, b, c = found[:3], found[4:6], found[7:]
    shape = len(found) == 11 and all(x in DIGITS for x in a + b + c) and found[3] == found[6] and found[3] in "- "
    if not shape or text[at + 11 : at + 12] in DIGITS and at + 11 < len(text):
        return None
    return None if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else ("ssn", at, at + 11)


@lru_cache(maxsize=1)
def anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for char in ["@", "+", *DIGITS]:
        automaton.add_word(char, ("digit" if char in DIGITS else char, 1))
    for kind, words in (("scheme", SCHEMES), *((k, (w,)) for w, k in CUES.items())):
        for word in words:
            for form in {word, word.upper(), word.title(), word.capitalize()}:
                automaton.add_word(form, (kind, len(form)))
    automaton.make_automaton()
    return automaton


def find(text: str | None) -> list[Span]:
    """All spans of a whole text, by kind as listed and then by start (code points, end exclusive)."""
    if not text:
        return []
    spans: list[Span] = []
    floor = dict.fromkeys(KINDS, 0)
    digits_to = 0

    def bounded(kind: str, start: int, end: int, valid: bool = True) -> None:
        floor[kind] = end
        if valid:
            spans.append((kind, start, end))

    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at < digits_to:
                continue
            digits_to = run_of(text, at, DIGITS)
            if at >= floor["ip"] and (found := ip(text, at)):
                bounded("ip", at, *found)
            if at >= floor["card"]:
                end, valid = card(text, at)
                if end > at + 1:
                    bounded("card", at, end, valid)
        elif kind == "@":
            if at >= floor["email"] and (span := email(text, at, floor["email"])):
                bounded(*span)
        elif kind == "+":
            if at >= floor["phone"] and (found := phone(text, at)):
                bounded("phone", at, *found)
        else:
            parse = {"iban": iban, "ssn": ssn}.get(kind)
            span = parse(text, last + 1) if parse else credentials(text, at, last + 1)
            if span and span[1] >= floor[span[0]]:
                bounded(*span)
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    out, done = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[done:start], f"<{kind.upper()}>"]
        done = end
    return "".join([*out, text[done:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (kind, start, end), one row for each row of ``docs``.

    A null or empty text has no span; repeated rows and null ids are kept; other columns are
    not read, so their names may clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ARROW_SPANS)], names=[id_col, "spans"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"`{id_col}` {kind}, spans {SPANS}")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind; all rows and columns stay."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([redact(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(lean(run), docs.schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query: counts, digest of the contract's spans, all spans."""
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count: list[Column] = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        F.col(id_col),
        *count,
        F.sha2(joined(of(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
