"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits, plus
signs and identifier cues ("account", "iban", "token" ...).  From each anchor a
local parser expands left and right to the boundaries of an email, a web
address, an IP number, a card, a phone or an account identifier, and validates
it (parts at most 255, Luhn, digit counts, a host with a dot, enough digits).

Kinds: email, ip, card and phone are the base; their spans equal those of a
leftmost, non-overlapping scan for each kind, a candidate that fails its check
being dropped without a retry.  address and account are added.  Positions are
code points, the end exclusive.

Every parser goes on behind what it has read, so a text takes time in proportion
to its length.

Defined results: a null or empty text has no spans; kinds may overlap each
other; redact() merges overlapping spans and names the first; a host that fails
its check is not tried again within itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts, with_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
#: Words that announce an identifier.
CUES = ("account", "acct", "iban", "passport", "password", "ssn", "user id", "customer id", "token", "api key", "api_key", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
WORD = LETTERS | frozenset("0123456789_")
# What the parsers expect to the right of an anchor.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
DIGITS = re.compile(r"[0-9]+")
GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PLACE = r"([A-Za-z0-9.-]+)(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>\\^`{|}]*)?"
ADDRESS = {"s": re.compile(r"(?:[A-Za-z0-9._~%!$&'()*+,;=:-]+@)?" + _PLACE), "w": re.compile(_PLACE)}
IDENTIFIER = re.compile(r"(?:\s+(?:no|number|nr|id|is)\b)?[\s.:=#]{0,4}[\"']?([A-Za-z0-9](?:[A-Za-z0-9_-]{4,62})[A-Za-z0-9])(?![A-Za-z0-9_-])", re.I)
_KIND = {"@": "@", "+": "+", "://": "s", "www.": "w"}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for anchor, kind in _KIND.items():
        out.add_word(anchor, (kind, len(anchor)))
    for d in "0123456789":
        out.add_word(d, ("d", 1))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            out.add_word(form, ("c", len(form)))
    out.make_automaton()
    return out


AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind in the order of KINDS, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the next candidate of a kind may begin
    for last, (anchor, size) in AUTOMATON.iter(text):
        at = last - size + 1
        if anchor == "d":
            if at >= done["ip"]:
                if m := QUAD.match(text, at):
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        found["ip"].append(m.span())
                else:  # nor can one begin later in this run of digits
                    done["ip"] = DIGITS.match(text, at).end()
            if at >= done["card"] and (m := GROUPED.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif anchor == "@":
            begin = at
            while begin > done["email"] and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                found["email"].append((begin, m.end()))
        elif anchor == "+":
            if at >= done["phone"] and (m := DIALLED.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "c":
            if at >= done["account"] and (at == 0 or text[at - 1] not in WORD) and (m := IDENTIFIER.match(text, last + 1)):
                if sum(c.isdigit() for c in m[1]) >= 4:
                    found["account"].append(m.span(1))
                    done["account"] = m.end(1)
        elif at >= done["address"]:
            begin = at
            if anchor == "s":
                while begin > done["address"] and text[begin - 1] in LETTERS:
                    begin -= 1
                if begin == at:
                    continue
            elif at and text[at - 1] in WORD:
                continue
            if m := ADDRESS[anchor].match(text, last + 1 if anchor == "s" else at):
                done["address"] = m.end(1)  # so that every part of a text is read once
                if "." in (host := m[1].strip(".")) and ".." not in host:
                    end = m.start() + len(m[0].rstrip(".,;:!?)'"))
                    found["address"].append((begin, end))
                    done["address"] = m.end()
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def redact(text: str, own: list[tuple[str, int, int]] | None = None) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, begin, end in sorted(spans(text) if own is None else own, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_address long, n_account long, n_spans long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        rows = []
        for text in texts(b.column(1)):
            own = spans(text)
            n = dict.fromkeys(KINDS, 0)
            for kind, _, _ in own:
                n[kind] += 1
            said = [f"{k}:{s}:{e}" for k, s, e in own]
            base = ",".join(said[: sum(n[k] for k in BASE)])
            rows.append((*(n[k] for k in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(said), n["address"], n["account"], len(own)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])


def find(docs: DataFrame) -> DataFrame:
    """A row for each document: counts by kind, the base's digest, all spans."""
    return with_text(docs).mapInArrow(_report, SCHEMA)


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in chunks(iter([batch]), text=batch.schema.get_field_index("text")):
            clean = pa.array([None if t is None else redact(t) for t in b.column("text").to_pylist()], pa.string())
            yield b.set_column(b.schema.get_field_index("text"), "text", clean)


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns, personal data in `text` replaced, n_chars (if
    there) counted anew; a null text stays null."""
    out = docs.mapInArrow(_redacted, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
