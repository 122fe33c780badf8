"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in each whole text: at-signs, plus signs, digits, ``://`` and identifier cues
("iban", "account" ...). At each anchor a deterministic local parser expands left and right to the boundaries of the
value and validates it. Scanning is left to right per kind, and a kind's next value starts after its last candidate, so
the base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns.

Added by the method: ``login`` (user:password before the host of a URL) and ``account`` (an IBAN that passes the check
sum, or a number after an account cue).
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import append_column, as_text

#: Order in listings; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "login", "account")
BASE = KINDS[:4]
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"://([^\s/@:\[\]<>\"']+:[^\s/@\[\]<>\"']+)@[A-Za-z0-9]")
_AFTER_CUE = re.compile(r"(?:[ \t]*(?:no\.?|nr\.?|number|num\.?|#|:|=))*[ \t]*", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,33}(?![A-Za-z0-9])")

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for a in ("@", "+", "://", *"0123456789"):
        out.add_word(a, (a if len(a) == 1 and not a.isdigit() else "0" if len(a) == 1 else "/", len(a)))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            out.add_word(form, ("c", len(form)))
    out.make_automaton()
    return out


_CUE_AUTOMATON: list[ahocorasick.Automaton] = []


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind as listed in ``KINDS``, then start."""
    if not text:
        return []
    if not _CUE_AUTOMATON:
        _CUE_AUTOMATON.append(_automaton())
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free_email = free_ip = free_card = free_phone = free_account = 0
    for last, (anchor, size) in _CUE_AUTOMATON[0].iter(text):
        at = last - size + 1
        if anchor == "0":
            if at >= free_card:
                m = _CARD.match(text, at)
                free_card = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and _luhn(digits):
                        found["card"].append(m.span())
            if at >= free_ip:
                m = _IP.match(text, at)
                free_ip = m.end() if m else _DIGITS.match(text, at).end()
                if m and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
                    found["ip"].append(m.span())
        elif anchor == "@":
            start = at
            while start > free_email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                free_email = m.end()
                found["email"].append((start, m.end()))
        elif anchor == "+":
            if at >= free_phone and (m := _PHONE.match(text, at)):
                free_phone = m.end()
                if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "/":
            if m := _USERINFO.match(text, at):
                found["login"].append(m.span(1))
        elif at >= free_account and (at == 0 or not text[at - 1].isalnum()):
            value = _AFTER_CUE.match(text, last + 1).end()
            if value > last + 1 and (m := _IBAN.match(text, value)) and _iban(m[0]) or value > last + 1 and (m := _ACCOUNT.match(text, value)):
                free_account = m.end()
                found["account"].append(m.span())
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, overlapping ones as one, replaced by the name of its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text_col: str = "text", result_col: str = "pii") -> DataFrame:
    """``docs`` with an array column ``result_col`` of (kind, start, end).

    Each row is judged alone, without a shuffle: repeated rows get equal results. A null or empty text has no spans; an
    empty table gives an empty table. Other columns pass through; one already called ``result_col`` is replaced.
    """

    def find(batch: pa.RecordBatch) -> pa.Array:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in texts], _ARROW)

    return append_column(as_text(docs, text_col), result_col, SPAN, find)


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the text replaced; a null text stays null."""

    def redact(batch: pa.RecordBatch) -> pa.Array:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return pa.array([t if not t or not (s := find_spans(t)) else redact_text(t, s) for t in texts], pa.string())

    names = docs.columns
    return append_column(as_text(docs, text_col), text_col, T.StringType(), redact).select(*names)
