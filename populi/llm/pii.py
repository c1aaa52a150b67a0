"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in one pass over a text. From
each anchor a local deterministic parser expands to the boundaries of an address, number or account and validates it.
Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns, failing ones dropped
without a retry; further kinds (login_url, account, secret) come from schemes and cues and never remove a base span.

Defined results: null and empty texts have no spans; offsets are code points; every input row gives one output row,
repeated ids included; further input columns are ignored; an empty table gives an empty result. A text is parsed whole,
in time linear in its length."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from populi.llm.common import per_batch, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login_url", "account", "secret")

# Cues that stand before an account number or a secret.
ACCOUNT_CUES = ("iban", "ssn", "account", "acct", "passport", "social security")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "api key")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"<>]*)?")
ACCOUNT = re.compile(r"(?: ?(?:no|nr|number|id)\b\.?)?\s{0,2}[:=#]?\s{0,2}([A-Za-z]{0,4}[0-9][A-Za-z0-9 -]{4,40}[A-Za-z0-9])")
SECRET = re.compile(r"\"?\s{0,2}[:=]\s{0,2}[\"']?([^\s\"']{8,})")
CLOUD_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, ("digit" if sign.isdigit() else sign, 1))
    found.add_word("://", ("scheme", 3))
    found.add_word("AKIA", ("key", 4))
    for tag, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (tag, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(code: str) -> bool:
    code = code.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue: an IBAN that checks, or a run of 6 to 34 characters with six digits at least."""
    m = ACCOUNT.match(text, at)
    if not m:
        return None
    start, value = m.start(1), m.group(1)
    parts = value.split(" ")
    while parts:  # the longest head that is an account; words after it are cut
        head = " ".join(parts)
        plain = re.sub(r"[ -]", "", head)
        if iban(head) or all(any(c.isdigit() for c in p) for p in parts) and 6 <= len(plain) <= 34 and sum(c.isdigit() for c in plain) >= 6:
            return start, start + len(head)
        parts.pop()
    return None


def spans_of(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where the next span of a kind may start
    run_end = 0  # digits before it belong to a run already tried

    def put(kind: str, start: int, end: int, valid: bool = True) -> None:
        free[kind] = end
        if valid:
            out[kind].append((start, end))

    for last, (tag, length) in automaton.iter(text):
        at = last + 1 - length
        if tag == "digit":
            if at >= run_end:
                run_end = DIGITS.match(text, at).end()
                if at >= free["ip"] and (m := IP.match(text, at)):
                    put("ip", at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")))
                if at >= free["card"] and (m := CARD.match(text, at)):
                    digits = m.group().replace(" ", "").replace("-", "")
                    put("card", at, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
        elif tag == "@":
            if span := _email(text, at, free["email"]):
                put("email", *span)
        elif tag == "+":
            if at >= free["phone"] and (m := PHONE.match(text, at)):
                put("phone", at, m.end(), 8 <= sum(c.isdigit() for c in m.group()) <= 15)
        elif tag == "scheme":
            start = at
            while start > free["login_url"] and text[start - 1] in SCHEME:
                start -= 1
            if start < at and (m := LOGIN.match(text, last + 1)):
                put("login_url", start, m.end())
        elif tag == "key":
            if at >= free["secret"] and (m := CLOUD_KEY.match(text, at)):
                put("secret", at, m.end())
        elif tag == "secret":
            if last >= free["secret"] and (m := SECRET.match(text, last + 1)):
                put("secret", m.start(1), m.end(1))
        elif last >= free["account"] and (span := _account(text, last + 1)):
            put("account", *span)
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, one array of {start, end} structs per kind in `KINDS`: every span of the whole text."""
    kind_type = "array<struct<start:long,end:long>>"
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def parse(batches):
        automaton = _automaton()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [spans_of(t, automaton) for t in batch.column("text").to_pylist()]
            columns = [pa.array([[{"start": s, "end": e} for s, e in f[k]] for f in found], arrow) for k in KINDS]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *KINDS])
        yield from per_batch(one)(batches)

    return source.mapInArrow(parse, "doc_id long, " + ", ".join(f"{k} {kind_type}" for k in KINDS))


def digest(found: DataFrame) -> DataFrame:
    """Counts, checksum of the base spans and all spans as one string."""
    def named(kind):
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    def text(kinds):
        each = [named(k) for k in kinds]
        return F.array_join(F.concat(*each), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(text(BASE_KINDS).cast("binary"), 256).alias("base_sha256"), text(KINDS).alias("spans"))


def redact(text: str, automaton: ahocorasick.Automaton | None = None) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    spans = sorted((s, e, k) for k, found in spans_of(text, automaton or _automaton()).items() for s, e in found)
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k}>"]
            at = e
    return "".join(out) + text[at:]
