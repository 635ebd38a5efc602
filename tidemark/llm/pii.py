"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, URL schemes, identifier cues
(``password``, ``token``, ``account``, ``ssn``, key prefixes), the countries that begin an IBAN, and the digit patterns
that numeric identifiers cannot do without.  From each anchor a deterministic local parser walks to both boundaries
of the candidate and validates it: e-mail syntax, IPv4 and IPv6 value ranges, user data in URLs, the Luhn
check of card numbers, length and mod-97 check of IBANs, digit counts of phone and account numbers, the form of
secrets.  Runs of digits and their separators are read whole, however long.
"""

from __future__ import annotations

import functools
import ipaddress
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMAIL, ADDRESS, PHONE, ACCOUNT, SECRET = KINDS = ("email", "address", "phone", "account", "secret")

_LOCAL = set(".!#$%&'*+/=?^_`{|}~-")
#: Letters from here on are of scripts that are written without spaces: a mail name doesn't run on into them.
_UNSPACED = 0x2E80
_LABEL = r"[^\W_](?:[^\W_-]|-(?=[^\W_]|-)){0,62}"
_DOMAIN = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\.(?:xn--[A-Za-z0-9-]{{1,58}}[A-Za-z0-9](?![A-Za-z0-9])|[A-Za-z]{{2,24}}(?![A-Za-z0-9])|[^\W\d_A-Za-z]{{2,24}})")
_USERINFO = re.compile(r"://([^\s/@?#\"'<>]+)@")
_VALUE = re.compile(r"[\w-]{0,20}[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>,;]{6,})")
_KEY = re.compile(r"[A-Z0-9]{12,20}(?![A-Za-z0-9])")
#: Lengths of account numbers by country, from the IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN = re.compile(r"[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])")
_IBAN_AFTER = re.compile(r"[\s:#.]{0,4}")
#: Between a cue for a number and the number.
_LEAD = r"(?:[ \t]{0,3}(?:number|nummer|no\.?|nr\.?|num\.?|id|is|was|:|=|#|-|\())*+[ \t]{0,3}"
_ACCOUNTS = {
    "account": re.compile(rf"(?i:{_LEAD})(\d(?:[ -]?\d){{5,16}})(?![\w]|[ -]\d)"),
    "ssn": re.compile(rf"(?i:{_LEAD})((?!000|666|9)\d{{3}}([ -]?)(?!00)\d\d\2(?!0000)\d{{4}})(?!\w|-\d)"),
    "passport": re.compile(rf"(?i:{_LEAD})([A-Z]{{0,2}}\d{{6,9}})(?!\w|-\d)"),
}
#: Card numbers in one piece or in the groups they are printed in.
_NUMBER = re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5})(?!\w)")
_IPV4 = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)")
_IPV6 = re.compile(r"(?<![\w:])[0-9A-Fa-f:]*::?[0-9A-Fa-f:]+(?![\w:])")
_PHONE = re.compile(
    r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w]|[.-]\d)"
)
_NUMERIC = set("0123456789+().- ")
_HEX = set("0123456789abcdefABCDEF:")
_NUMERIC_RUN, _HEX_RUN = re.compile(r"[0-9+(). -]*"), re.compile(r"[0-9a-fA-F:]*")

_NUMBER_CUES = {"account": "account", "acct": "account", "konto": "account", "routing": "account", "ssn": "ssn", "social security": "ssn", "passport": "passport"}
_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key")


@functools.lru_cache(1)
def anchors():
    """The automaton; each anchor's value is (what, length)."""
    import ahocorasick

    found = {"@": "at", "://": "scheme", "akia": "key", "asia": "key", "iban": "iban", "::": "colon"}
    found |= {c: "cue" for c in _CUES} | _NUMBER_CUES | {f"{c.lower()}{d}": "country" for c in IBAN_LENGTHS for d in "0123456789"}
    for d in "0123456789":
        found[f"+{d}"] = found[f"{d}."] = found[f"({d}"] = "digit"
        found[f"{d}:"] = found[f":{d}"] = "colon"
        found |= {f"{d}{e}": "digit" for e in "0123456789"}
    auto = ahocorasick.Automaton()
    for word, what in found.items():
        auto.add_word(word, (what, len(word)))
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _run(text: str, at: int, least: int, allowed: set, forward: re.Pattern) -> tuple[int, int]:
    """The run of allowed characters around at, from least on."""
    a = at
    while a > least and text[a - 1] in allowed:
        a -= 1
    return a, forward.match(text, at).end()


def _email(text: str, at: int):
    a, unspaced = at, at > 0 and ord(text[at - 1]) >= _UNSPACED
    while a > 0 and at - a < 64 and ((c := text[a - 1]) in _LOCAL or (c.isalnum() and (unspaced or ord(c) < _UNSPACED))):
        a -= 1
    while a < at and not text[a].isalnum() and text[a] != "_":
        a += 1
    if a == at or text[at - 1] == "." or ".." in text[a:at]:
        return None
    m = _DOMAIN.match(text, at + 1)
    return (a, m.end(), EMAIL) if m and m.end() - at <= 254 else None


def _iban(text: str, at: int):
    """An IBAN that begins at at: as many letters and digits as its country has, with single blanks between."""
    if at and text[at - 1].isalnum():
        return None
    size, z = IBAN_LENGTHS.get(text[at : at + 2].upper(), 0), at
    for i in range(size):
        z += i > 0 and text[z : z + 1] == " "
        c = text[z : z + 1]
        if not (c.isascii() and c.isalnum()):
            return None
        z += 1
    return (at, z, ACCOUNT) if size and not text[z : z + 1].isalnum() and iban_valid(text[at:z]) else None


def _cards(text: str, a: int, z: int):
    """Card numbers; digits in front of one or after it, such as a date, don't hide it."""
    end = min(len(text), z + 1)
    while m := _NUMBER.search(text, a, end):
        a = m.start() + 1
        # with and without the last group, which may be something else
        whole = m.group(), m.group()[:19] if m.group(1) else ""
        for number in whole:
            if number and luhn(re.sub(r"\D", "", number)):
                yield m.start(), m.start() + len(number), ACCOUNT
                a = m.start() + len(number)
                break


def _numeric(text: str, a: int, z: int):
    """All numeric identifiers in a window, the strictest form first."""
    # the patterns look at the characters beside the window, too
    for m in _IPV4.finditer(text, a, min(len(text), z + 1)):
        if all(int(p) <= 255 for p in m.group().split(".")):
            yield m.start(), m.end(), ADDRESS
    yield from _cards(text, a, z)
    for m in _PHONE.finditer(text, a, min(len(text), z + 1)):
        if 7 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.start(), m.end(), PHONE


def find_pii(text: str) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, kind) in order of start; of overlapping finds the earliest, then the longest, stands.

    A cue for a secret inside another secret's value is part of that value.
    """
    lowered = text.lower()
    if len(lowered) != len(text):  # a few capitals have two lower-case code points
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found, done, hexed, told = [], 0, 0, 0  # where the last run of digits, of hexadecimal groups, and the last value ended
    for end, (what, length) in anchors().iter(lowered):
        at = end - length + 1
        if what == "digit":
            if end < done:
                continue
            a, done = _run(text, at, done, _NUMERIC, _NUMERIC_RUN)
            found += _numeric(text, a, done)
        elif what == "colon":
            if end < hexed:
                continue
            a, hexed = _run(text, at, hexed, _HEX, _HEX_RUN)
            for m in _IPV6.finditer(text, a, min(len(text), hexed + 1)):
                if m.group().count(":") >= 2 and len(m.group()) > 3:
                    try:
                        ipaddress.IPv6Address(m.group())
                        found.append((m.start(), m.end(), ADDRESS))
                    except ValueError:
                        pass
        elif what == "at":
            if got := _email(text, at):
                found.append(got)
        elif what == "scheme":
            if m := _USERINFO.match(text, at):
                found.append((m.start(1), m.end(1), SECRET))
        elif what == "cue":
            if at >= told and (m := _VALUE.match(text, end + 1)):
                told = m.end(1)
                found.append((m.start(1), m.end(1), SECRET))
        elif what == "key":
            if text[at:end + 1].isupper() and (at == 0 or not text[at - 1].isalnum()) and (m := _KEY.match(text, end + 1)):
                found.append((at, m.end(), SECRET))
        elif what == "country":
            if got := _iban(text, at):
                found.append(got)
        elif what in _ACCOUNTS:
            if (at == 0 or not text[at - 1].isalpha()) and (m := _ACCOUNTS[what].match(text, end + 1)):
                found.append((m.start(1), m.end(1), ACCOUNT))
        elif m := _IBAN.match(text, _IBAN_AFTER.match(text, end + 1).end()):
            if iban_valid(m.group()):
                found.append((m.start(), m.end(), ACCOUNT))
    out: list[tuple[int, int, str]] = []
    for a, z, kind in sorted(set(found), key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if not out or a >= out[-1][1]:
            out.append((a, z, kind))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its kind in capitals between brackets."""
    parts, last = [], 0
    for a, z, kind in spans:
        parts += [text[last:a], f"[{kind.upper()}]"]
        last = z
    return "".join([*parts, text[last:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data in ``text`` replaced by markers such as [EMAIL]; nothing else changes but
    n_chars, where the table has it as a whole number: it is the new text's length.

    Every row and column comes back, repeated rows too; a null text stays null and an empty one empty.
    """
    place = docs.columns.index("text")
    lengths = next((i for i, (c, kind) in enumerate(docs.dtypes) if c == "n_chars" and kind in ("bigint", "int")), None)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, touched = b.column(place).to_pylist(), False
            counts = None
            for i, t in enumerate(texts):
                if t and (spans := find_pii(t)):
                    texts[i] = redact(t, spans)
                    touched = True
                    if lengths is not None:
                        counts = counts or b.column(lengths).to_pylist()
                        counts[i] = len(texts[i])
            cols = list(b.columns)
            if touched:
                cols[place] = pa.array(texts, b.schema.field(place).type)
                if counts:
                    cols[lengths] = pa.array(counts, b.schema.field(lengths).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def pii_report(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_email, n_address, n_phone, n_account, n_secret): each document's redacted text and
    how many of each kind were replaced.  Rows with a null id are left out; a null text stays null with
    counts of 0; repeated rows come back each time.  Other columns are ignored."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            counts = [[0] * len(texts) for _ in KINDS]
            for i, t in enumerate(texts):
                if t and (spans := find_pii(t)):
                    texts[i] = redact(t, spans)
                    for _, _, kind in spans:
                        counts[KINDS.index(kind)][i] += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), *(pa.array(c, pa.int32()) for c in counts)], names=["doc_id", "text", *(f"n_{k}" for k in KINDS)]
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return base.mapInArrow(run, "doc_id long, text string, " + ", ".join(f"n_{k} int" for k in KINDS))
