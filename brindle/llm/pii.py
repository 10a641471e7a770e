"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds cues: at-signs, schemes, plus signs
before digits, digits, dots before digits, and words that announce an account.
Around each cue a small deterministic parser widens to the boundaries of an
email, address or number and validates it.
"""

from __future__ import annotations

import hashlib
import string

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_or_empty

DIGITS = frozenset("0123456789")
ALNUM = frozenset(string.ascii_letters + string.digits)
LOCAL, DOMAIN = ALNUM | frozenset("._%+-"), ALNUM | {"-"}
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset("<>\"'`{}|\\^")

# Kinds in the order of their output, words before an account number, schemes of addresses.
KINDS = ("email", "ip", "card", "phone", "url", "account")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "compte", "cuenta")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
#: Characters between an account cue and its number, and the number's letters and digits.
ACCOUNT_GAP, ACCOUNT_LEAST, ACCOUNT_MOST = 12, 6, 34


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
        a.add_word("+" + d, ("phone", 2))
    a.add_word("@", ("at", 1))
    for s in SCHEMES:
        a.add_word(s, ("url", len(s)))
    for w in ACCOUNT_CUES:
        for form in {w, w.upper(), w.capitalize()}:
            a.add_word(form, ("account", len(form)))
    a.make_automaton()
    return a


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Email around the at-sign; ``floor``: where the last one ended."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, parts, good = len(text), at + 1, 0, 0
    while True:
        part = end
        while end < n and text[end] in DOMAIN:
            end += 1
        if end == part:
            break
        parts, good = parts + 1, end
        if end < n and text[end] == ".":
            end += 1
        else:
            break
    return (start, good) if parts > 1 else None


def digit_run(text: str, start: int) -> int:
    n = len(text)
    while start < n and text[start] in DIGITS:
        start += 1
    return start


def ips_from(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """Valid addresses in the chain of dotted digit runs that begins at ``start``, and its end."""
    runs = []
    while True:
        end = digit_run(text, start)
        runs.append((start, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            start = end + 1
        else:
            break
    fours = [runs[i : i + 4] for i in range(0, len(runs) - 3, 4)]
    return [(q[0][0], q[3][1]) for q in fours if all(octet(text[a:b]) for a, b in q)], end


def octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and int(digits) <= 255


def card_from(text: str, start: int) -> tuple[tuple[int, int] | None, int]:
    """Card in the run of digits with single blanks or hyphens that begins at ``start``, and the run's end."""
    n, end = len(text), start
    while True:
        end = digit_run(text, end)
        if end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
            end += 1
        else:
            break
    digits = text[start:end].replace(" ", "").replace("-", "")
    return ((start, end) if 16 <= len(digits) <= 19 and luhn(digits) else None), end


def phone_from(text: str, plus: int) -> tuple[tuple[int, int] | None, int]:
    """Phone number from the plus sign, and where its match ends (``plus`` if there is none)."""
    n, end = len(text), plus + 2
    while end < n and text[end] in PHONE:
        end += 1
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4:
        return None, plus
    count = sum(c in DIGITS for c in text[plus:end])
    return ((plus, end) if 8 <= count <= 15 else None), end


def url_from(text: str, start: int, body: int) -> tuple[int, int] | None:
    n, end = len(text), body
    if end == n or text[end] not in ALNUM:
        return None
    while end < n and not text[end].isspace() and text[end] not in URL_END:
        end += 1
    while end > body and text[end - 1] in ".,;:!?)]":
        end -= 1
    return (start, end) if end > body else None


def account_after(text: str, start: int, cue_end: int) -> tuple[int, int] | None:
    """Identifier announced by a cue word: letters and digits in groups, six digits at least."""
    if start and text[start - 1].isalnum():
        return None
    n, at, stop = len(text), cue_end, min(len(text), cue_end + ACCOUNT_GAP)
    while at < stop and not (text[at] in DIGITS or text[at].isupper() and at + 1 < n and (text[at + 1] in DIGITS or text[at + 1].isupper())):
        if text[at] in "\n\r":
            return None
        at += 1
    if at == stop or text[at - 1].isalnum():
        return None
    end = good = at
    while end < n and end - at < ACCOUNT_MOST + 8:
        c = text[end]
        if c in DIGITS or "A" <= c <= "Z":
            end += 1
            good = end
        elif c in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 1
        else:
            break
    found = [c for c in text[at:good] if c in ALNUM]
    if len(found) > ACCOUNT_MOST or sum(c in DIGITS for c in found) < ACCOUNT_LEAST or good < n and text[good].isalnum():
        return None
    return at, good


def find(text: str, cues: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, by start; code points, end exclusive. Spans of one kind don't overlap."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = card = phone = url = account = 0  # where the last of a kind was read up to
    for last, (kind, size) in cues.iter(text):
        start = last + 1 - size
        if kind == "digit":
            if start >= ip:
                got, ip = ips_from(text, start)
                out["ip"] += got
            if start >= card:
                one, card = card_from(text, start)
                if one:
                    out["card"].append(one)
        elif kind == "at":
            if start >= email and (one := email_at(text, start, email)):
                out["email"].append(one)
                email = one[1]
        elif kind == "phone":
            if start >= phone:
                one, phone = phone_from(text, start)
                if one:
                    out["phone"].append(one)
        elif kind == "url":
            if start >= url and (one := url_from(text, start, last + 1)):
                out["url"].append(one)
                url = one[1]
        elif start >= account and (one := account_after(text, start, last + 1)):
            out["account"].append(one)
            account = one[1]
    return out


def joined(found: dict, kinds=KINDS) -> str:
    return ",".join([f"{k}:{s}:{e}" for k in kinds for s, e in found[k]])


def mask(text: str, found: dict) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first and longest."""
    out, at = [], 0
    for s, e, k in sorted(((s, e, k) for k in KINDS for s, e in found[k]), key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
            at = e
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """Personal data in every whole text.

    Columns: id, n_email, n_ip, n_card, n_phone, n_url, n_account, base_sha256 (of the
    first four kinds' spans), spans (all), and the masked text if ``masked``. A null text
    counts as empty. Rows pass one by one; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"] + ["masked"] * masked

    def run(batches):
        cues = automaton()
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                found = find(text, cues)
                rows.append([*(len(found[k]) for k in KINDS), hashlib.sha256(joined(found, KINDS[:4]).encode()).hexdigest(), joined(found)] + [mask(text, found)] * masked)
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64() if n.startswith("n_") else pa.string()) for n, c in zip(names[1:], cols, strict=True))], names=names)

    schema = f"id {kind}, " + ", ".join(f"{n} {'bigint' if n.startswith('n_') else 'string'}" for n in names[1:])
    return docs.select(id_col, text_or_empty(text_col).alias("__text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
