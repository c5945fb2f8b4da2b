"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors: at-signs, schemes and
identifier cues (digits, plus signs and the words and prefixes that announce an
account or a secret). A deterministic parser for the anchor's kind expands it to both
sides and validates what it finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import packed, unpacked
from lexigrid.shipping import map_arrow

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
WORD = DIGITS | LETTERS
MAIL_LOCAL = WORD | frozenset("._%+-")
DOMAIN = WORD | frozenset(".-")
URL = WORD | frozenset("-._~:/?#[]@!$&'()*+,;=%")
SECRET = WORD | frozenset("+/=_-.~!@#$%^&*")
CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey", "access_key")
ACCOUNTS = ("account", "acct", "iban", "ssn", "passport")
SCHEMES = ("://", "mailto:")

#: What shows that an address names a person, behind its scheme.
PERSONAL = ("/~", "/@", "/user/", "/users/", "email=", "user=", "account=", "token=", "password=")
_authority = re.compile("[^/?#]*")
_lead = re.compile(r"(?:[ \t:#=.,\-]|\b(?:numbers?|no|nr|num|id|is|was|code|with|the|of|for|my|your|our|his|her|their|following|holder|customer|user|bank)\b)*+", re.IGNORECASE)

Span = tuple[str, int, int]


class Runs:
    """Runs of ``chars`` in a text without the signs ``trim`` at their ends. However many anchors stand in a run, it is walked once."""

    def __init__(self, text: str, chars: frozenset[str], trim: str, marks: tuple[str, ...]) -> None:
        self.text, self.trim, self.marks = text, trim, marks
        self.match = re.compile("[" + re.escape("".join(sorted(chars))) + "]*").match
        self.start = self.end = self.stop = 0
        self.mark = -1

    def at(self, i: int) -> tuple[int, int]:
        """Where the run from ``i`` on ends, and where the last of ``marks`` in it starts (less than ``i`` if there is none)."""
        if not self.start <= i < self.end:
            self.start, self.end = i, self.match(self.text, i).end()
            run = self.text[i : self.end].lower()
            self.stop = i + len(run.rstrip(self.trim))
            last = max(run.rfind(m) for m in self.marks)
            self.mark = i + last if last >= 0 else -1
        return max(i, self.stop), self.mark


#: Small letters for capital ones, sign by sign, so that places stay.
_small = {ord(c): ord(c.lower()) for c in UPPER}


def small(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_small)


def automaton() -> ahocorasick.Automaton:
    """The anchors, in small letters: cues count in any case."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("akia", ("key", 4))
    a.add_word("+", ("phone", 1))
    for d in "0123456789":
        a.add_word(d, ("number", 1))
    for words, kind in ((SCHEMES[:1], "url"), (SCHEMES[1:], "mailto"), (CUES, "secret"), (ACCOUNTS, "account")):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _host(name: str) -> bool:
    """Dotted labels of letters, digits and inner hyphens; the last one has two letters or more."""
    labels = name.split(".")
    if len(labels) < 2 or len(name) > 253:
        return False
    for x in labels:
        if not x or len(x) > 63 or x[0] == "-" or x[-1] == "-":
            return False
    last = labels[-1]
    return len(last) >= 2 and all(c in LETTERS for c in last)


def _email(t: str, at: int) -> Span | None:
    i = at
    while i > 0 and t[i - 1] in MAIL_LOCAL:
        i -= 1
        if at - i > 64:
            return None  # longer than any mailbox name: no part of it is one
    while i < at and t[i] in ".-+%":
        i += 1
    j = at + 1
    while j < len(t) and t[j] in DOMAIN and j - at < 255:
        j += 1
    if j < len(t) and t[j] in DOMAIN:
        return None
    while j > at + 1 and not _host(t[at + 1 : j]):
        # the domain gives back its last label: "a@b.example.Then" keeps what is valid
        k = max(t.rfind(".", at + 1, j), t.rfind("-", at + 1, j))
        j = k if k > at else at + 1
    local = t[i:at]
    if not local or ".." in local or local[-1] == "." or j <= at + 1:
        return None
    return "email", i, j


def _ip(t: str, i: int) -> Span | None:
    """Four numbers up to 255; no letter, digit or further dotted number on either side."""
    j, parts = i, 0
    while True:
        k = j
        while k < len(t) and t[k] in DIGITS and k - j < 4:
            k += 1
        n = t[j:k]
        if not n or len(n) > 3 or int(n) > 255 or (len(n) > 1 and n[0] == "0"):
            return None
        parts += 1
        if parts == 4:
            break
        if k >= len(t) or t[k] != ".":
            return None
        j = k + 1
    if i > 0 and (t[i - 1] in WORD or t[i - 1] in "._-"):
        return None
    if k < len(t) and (t[k] in WORD or t[k] == "_" or (t[k] == "." and k + 1 < len(t) and t[k + 1] in DIGITS)):
        return None
    return "ip_address", i, k


def _run(t: str, i: int, between: str, most: int) -> tuple[str, int]:
    """Digits from ``i`` on, with single characters of ``between`` among them; where they end."""
    out, j, n = [], i, len(t)
    while j < n and len(out) <= most:
        if t[j] in DIGITS:
            out.append(t[j])
            j += 1
        elif t[j] in between and j + 1 < n and t[j + 1] in DIGITS:
            j += 1
        else:
            break
    return "".join(out), j


def _free(t: str, i: int, j: int) -> bool:
    return not (i > 0 and (t[i - 1] in WORD or t[i - 1] == "_")) and not (j < len(t) and (t[j] in WORD or t[j] == "_"))


def _phone(t: str, i: int) -> Span | None:
    """``+`` and 8 to 15 digits in groups; or ten digits as (ddd) ddd-dddd or ddd-ddd-dddd."""
    j, n, digits, groups = i, len(t), 0, 0
    plus = t[j] == "+"
    j += plus
    open_ = False
    end, taken = i, 0
    while j < n:
        c = t[j]
        if c in DIGITS:
            k = j
            while k < n and t[k] in DIGITS:
                k += 1
            if digits + k - j > 15:
                break
            digits += k - j
            groups += 1
            j = k
            if not open_:
                end, taken = j, digits
        elif c == "(" and not open_ and j + 1 < n and t[j + 1] in DIGITS:
            open_ = True
            j += 1
        elif c == ")" and open_:
            open_ = False
            j += 1
            end, taken = j, digits
        elif c in " .-" and j + 1 < n and (t[j + 1] in DIGITS or t[j + 1] == "(") and end == j:
            if c == " " and _ip(t, j + 1):
                break
            j += 1
        else:
            break
    if plus:
        ok = 8 <= taken <= 15 and groups >= 2 or 10 <= taken <= 15
    else:
        body = t[i:end]
        shape = "".join("9" if c in DIGITS else c for c in body)
        ok = shape in ("(999) 999-9999", "(999)999-9999", "999-999-9999", "999.999.9999", "999 999 9999")
    if not ok or not _free(t, i, end) or t[end - 1] not in DIGITS:
        return None
    return "phone", i, end


def _iban(t: str, i: int) -> Span | None:
    """Two capital letters before two digits, up to 30 more; the check number must be right."""
    if i < 2 or t[i - 1] not in UPPER or t[i - 2] not in UPPER or (i > 2 and t[i - 3] in WORD):
        return None
    out, j = [], i - 2
    while j < len(t) and len(out) < 35:
        if t[j] in DIGITS or t[j] in UPPER:
            out.append(t[j])
            j += 1
        elif t[j] == " " and len(out) % 4 == 0 and j + 1 < len(t) and (t[j + 1] in DIGITS or t[j + 1] in UPPER):
            j += 1
        else:
            break
    while len(out) >= 15:
        s = "".join(out)
        if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 and not (j < len(t) and t[j] in WORD):
            return "account", i - 2, j
        cut = t.rfind(" ", i, j)
        if cut < 0:
            return None
        out = [c for c in t[i - 2 : cut] if c != " "]
        j = cut
    return None


def _number(t: str, i: int) -> Span | None:
    """What starts at the first digit of a run: address, account number, phone number."""
    found = _ip(t, i) or _iban(t, i)
    if found:
        return found
    digits, j = _run(t, i, "-", 9)
    if len(digits) == 9 and t[i:j].count("-") == 2 and t[i + 3 : i + 4] == "-" and t[i + 6 : i + 7] == "-" and _free(t, i, j):
        if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000":
            return "account", i, j
    for between in ("", " -"):
        digits, j = _run(t, i, between, 19)
        if 13 <= len(digits) <= 19 and luhn(digits) and digits[0] in "3456" and _free(t, i, j):
            return "account", i, j
    return _phone(t, i - 1 if i and t[i - 1] == "(" else i)


def _secret(t: str, start: int, j: int, values: Runs) -> Span | None:
    """After the cue: a separator, maybe quotes, and a value of 8 characters or more with a digit in it; what is assigned to a password, by an equals sign or in quotes, needs no digit."""
    n = len(t)
    password = t[start] in "pP"
    while j < n and t[j] in " \t\"'":
        j += 1
    if j >= n or t[j] not in "=:":
        return None
    sign = j
    j += 1
    while j < n and t[j] in " \t\"'>":
        j += 1
    stop, digit = values.at(j)
    assigned = password and (t[sign] == "=" or t[j - 1] in "\"'")
    if stop - j < 8 or digit < j and not assigned:
        return None
    return "secret", j, stop


def _account(t: str, j: int) -> Span | None:
    """After the cue: words that lead to a number, however many, and 16 further signs at most, then 6 to 34 letters and digits with at least 5 digits."""
    j = _lead.match(t, j).end()
    n, stop = len(t), j + 16
    while j < n and j < stop and t[j] not in DIGITS:
        if t[j] == "\n":
            return None
        j += 1
    if j >= n or t[j] not in DIGITS:
        return None
    i = j
    while i > 0 and t[i - 1] in UPPER:
        i -= 1
    digits = 0
    while j < n and (t[j] in WORD or (t[j] in "- " and j + 1 < n and t[j + 1] in DIGITS)) and j - i < 34:
        digits += t[j] in DIGITS
        j += 1
    return ("account", i, j) if digits >= 5 and j - i >= 6 and _free(t, i, j) else None


def _url(t: str, at: int, addresses: Runs) -> Span | None:
    """An address that names a person: user information before the host, or a user's page."""
    i = at
    while i > 0 and t[i - 1] in LETTERS and at - i <= 16:
        i -= 1
    if at - i > 16:
        return None
    j, personal = addresses.at(at + 3)
    authority = _authority.match(t, at + 3, j).group()
    user, sign, host = authority.rpartition("@")
    host = host.split(":", 1)[0]
    if i == at or not (_host(host) or (_ip(host, 0) or ("", 0, -1))[2] == len(host)):
        return None
    if sign and user or personal >= at + 3:
        return "address", i, j
    return None


def find(text: str, a: ahocorasick.Automaton) -> list[Span]:
    """Spans by start; of spans that overlap the one found from the earlier anchor stays."""
    out: list[Span] = []
    done = -1
    digits_until = -1
    values, addresses = Runs(text, SECRET, ".!", tuple("0123456789")), Runs(text, URL, ".,;:!?)]'", PERSONAL)
    for end, (kind, width) in a.iter(small(text)):
        start = end - width + 1
        if kind == "number":
            if start < digits_until or start < done:
                continue
            # only the first digit of a run is an anchor
            if start and text[start - 1] in DIGITS:
                continue
        elif start < done:
            continue
        if kind == "email":
            s = _email(text, start)
        elif kind == "number":
            s = _number(text, start)
            if s is None:
                j = start
                while j < len(text) and text[j] in DIGITS:
                    j += 1
                digits_until = j
        elif kind == "phone":
            s = _phone(text, start)
        elif kind == "key":
            if text[start : end + 1] != "AKIA":
                continue
            j = end + 1
            while j < len(text) and (text[j] in UPPER or text[j] in DIGITS):
                j += 1
            s = ("secret", start, j) if j - start == 20 and _free(text, start, j) else None
        elif kind == "secret":
            s = _secret(text, start, end + 1, values)
        elif kind == "account":
            s = _account(text, end + 1)
        elif kind == "mailto":
            s = None  # the at-sign that follows is an anchor of its own
        else:
            s = _url(text, start, addresses)
        if s is not None:
            while out and out[-1][1] >= s[1] and out[-1][2] <= s[2]:
                out.pop()  # what the new span contains
            if not out or s[1] >= out[-1][2]:
                out.append(s)
                done = s[2]
    return out


#: A text without any anchor never leaves the JVM. The same anchors as the automaton's.
ANCHOR = r"[0-9@+]|://|AKIA|(?i:" + "|".join(CUES + ACCOUNTS) + ")"


def find_pii(docs: DataFrame) -> DataFrame:
    """``(doc_id, kind, start, stop, value)``, one row for each span; kinds: email, address, ip_address, phone, account, secret.

    Offsets count characters from 0. Each row of ``docs`` gives its own spans, so
    repeated rows repeat; null and empty texts give none, nor does an empty table. A null ``doc_id`` stays null. Of spans that overlap
    the earlier anchor's stays, unless another one contains it. Texts of any length are scanned whole, and
    a span is reported whole or not at all. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                out += [(doc_id, k, i, j, text[i:j]) for k, i, j in find(text, a)]
            cols = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "kind", "start", "stop", "value"])

    rows = docs.where(F.col("text").rlike(ANCHOR)).selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    return map_arrow(rows, run, "doc_id long, kind string, start int, stop int, value string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets; all else stays as it is.

    Null, empty and clean texts stay, repeated rows too; an empty table stays empty. Extra columns are carried, whatever their
    names. Time follows the length of a text, however many spans it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            texts = []
            for text in batch.column("r").field("text").to_pylist():
                if text is not None:
                    pieces, at = [], 0
                    for kind, i, j in find(text, a):
                        pieces += (text[at:i], f"<{kind}>")
                        at = j
                    text = "".join(pieces) + text[at:]
                texts.append(text)
            r = batch.column("r")
            fields = [pa.array(texts, pa.string()) if f.name == "text" else r.field(f.name) for f in r.type]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=[pa.field(f.name, pa.string() if f.name == "text" else f.type) for f in r.type])], ["r"])

    rows = packed(docs)
    return unpacked(map_arrow(rows, run, rows.schema))
