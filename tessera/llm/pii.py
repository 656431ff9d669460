"""Personal data by anchor expansion.

One Aho-Corasick pass over a text in lower case finds anchors: at-signs, plus signs, digits, schemes, cue words and the
beginnings of keys. Around each anchor a small parser expands to the borders of a value and checks it. Text far from an
anchor is never parsed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]

# Fixed patterns of the base, each tried at an anchor only.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
NO_DIGIT = re.compile(r"[^0-9]")

# Fixed cue words of the further kinds, in lower case; text may write them in any case.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn", "tax id")
SECRET_CUES = ("password", "passwd", "passphrase", "pwd", "token", "secret", "api_key", "apikey", "api key", "api-key", "access_key", "access key")
# How keys of well-known services begin.
KEY_PREFIXES = ("AKIA", "ASIA")
TOKEN_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "sk_live_", "rk_live_", "AIza")
# Length of an international account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

ACCOUNT_VALUE = re.compile(
    r"(?:[ _-]?(?i:no|nr|number|num|id))?\.?[ ]{0,2}[:=#]?[ ]{0,2}([A-Z]{0,3}[0-9](?:[ -]?[0-9A-Z]){5,33})(?![0-9A-Za-z])"
)
SECRET_LEAD = re.compile(
    r"(?:[ _-](?i:access|api|client|private|key|token|id|value)){0,3}[\"']?(?:[ ]{0,2}[:=]|[ ]{1,2}(?i:is)(?=[ ]))[ ]{0,2}[\"']?"
)
BEARER_LEAD = re.compile(r"[ ]{1,2}")
SECRET_VALUE = re.compile(r"[A-Za-z0-9+/_=.~-]*")
KEY_VALUE = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
TOKEN_VALUE = re.compile(r"[A-Za-z0-9_-]*")
WEB_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
KEY_BLOCK = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----\s*(?:[A-Za-z-]+: [^\n]*\n)*[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"
)
CREDENTIALS = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:/[^\s\"'<>]*)?")
CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Lower case of the same length, for texts that have another one.
LOWER = {ord(c): c.lower() for c in CAPITALS}


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for kind, words in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    for kind, words in (("key", KEY_PREFIXES), ("prefix", TOKEN_PREFIXES), ("bearer", ("bearer",)), ("web", ("eyJ",)), ("block", ("-----BEGIN ",))):
        for word in words:
            found.add_word(word.lower(), (kind, len(word)))
    found.make_automaton()
    return found


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def passes_mod97(code: str) -> bool:
    """The check of international account numbers."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _valid_account(value: str) -> bool:
    plain = value.replace(" ", "").replace("-", "")
    if plain[:2].isalpha():
        return 15 <= len(plain) <= 34 and passes_mod97(plain)
    return plain.isdigit() and 8 <= len(plain) <= 20


def _bare_account(text: str, at: int) -> tuple[int, int] | None:
    """An international account number whose first digit is at ``at``: length by country and check digits must fit."""
    length = IBAN_LENGTHS.get(text[at - 2 : at])
    if not length or (at > 2 and text[at - 3].isalnum()):
        return None
    plain, place = [], at - 2
    while len(plain) < length and place < len(text):
        char = text[place]
        if char in CAPITALS or char in "0123456789":
            plain.append(char)
        elif char != " " or text[place - 1] == " ":
            return None
        place += 1
    code = "".join(plain)
    whole = len(code) == length and not text[place : place + 1].isalnum() and code[2:4].isdigit()
    return (at - 2, place) if whole and passes_mod97(code) else None


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    begin = at
    while begin > floor and text[begin - 1] in LOCAL:
        begin -= 1
    domain = DOMAIN.match(text, at + 1) if begin < at else None
    return (begin, domain.end()) if domain else None


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, by kind as listed in KINDS, then by start.

    Base kinds are found leftmost and without overlap; a match that fails its check is dropped and
    search goes on behind it. Further kinds are added where they touch no base span. Cues may have any case; beginnings of
    keys and country codes count as they are written. Each run of characters is read once, so time is linear in the text.
    """
    base: dict[str, list[tuple[int, int]]] = {kind: [] for kind in BASE}
    more: list[tuple[str, int, int]] = []
    free = dict.fromkeys(BASE, 0)  # where the next match of each kind may begin
    run, digit = 0, -1  # end of the last run of a secret's characters, and its last digit
    token = web = block = 0  # ends of the last runs read for a prefixed key, a web token and a key block
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(LOWER)
    for last, (kind, length) in _anchors().iter(lower):
        at = last - length + 1
        if kind == "digit":
            if at >= free["card"] and (match := CARD.match(text, at)):
                free["card"] = match.end()
                digits = match[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and passes_luhn(digits):
                    base["card"].append(match.span())
            if at >= free["ip"]:
                if match := ADDRESS.match(text, at):
                    free["ip"] = match.end()
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in match[0].split(".")):
                        base["ip"].append(match.span())
                else:
                    free["ip"] = DIGITS.match(text, at).end()  # a later start in this run would meet the same end
            if at >= 2 and text[at - 1] in CAPITALS and (span := _bare_account(text, at)):
                more.append(("account", *span))
        elif kind == "at":
            if at >= free["email"] and (span := _email(text, at, free["email"])):
                free["email"] = span[1]
                base["email"].append(span)
        elif kind == "plus":
            if at >= free["phone"] and (match := PHONE.match(text, at)):
                free["phone"] = match.end()
                if 8 <= len(NO_DIGIT.sub("", match[0])) <= 15:
                    base["phone"].append(match.span())
        elif kind == "scheme":
            begin = at
            while begin > 0 and text[begin - 1].isalpha():
                begin -= 1
            if begin < at and (match := CREDENTIALS.match(text, last + 1)):
                more.append(("url", begin, match.end()))
        elif at and text[at - 1].isalnum():
            continue
        elif kind == "account":
            if (match := ACCOUNT_VALUE.match(text, last + 1)) and _valid_account(match[1]):
                more.append(("account", *match.span(1)))
        elif kind in ("secret", "bearer"):
            if lead := (SECRET_LEAD if kind == "secret" else BEARER_LEAD).match(text, last + 1):
                begin = lead.end()
                if begin >= run:  # else a cue within the run, whose end is known
                    run = SECRET_VALUE.match(text, begin).end()
                    digit = next((k for k in range(run - 1, begin - 1, -1) if text[k].isdigit()), -1)
                if run - begin >= (8 if kind == "secret" else 16) and digit >= begin:
                    more.append(("secret", begin, run))
        elif kind == "key":
            if text[at : last + 1] in KEY_PREFIXES and (match := KEY_VALUE.match(text, last + 1)):
                more.append(("secret", at, match.end()))
        elif kind == "prefix":
            if at >= token and text[at : last + 1] in TOKEN_PREFIXES:
                token = TOKEN_VALUE.match(text, last + 1).end()
                if token - last > 16:
                    more.append(("secret", at, token))
        elif kind == "web":
            if at >= web and text.startswith("eyJ", at):
                match = WEB_TOKEN.match(text, at)
                web = match.end() if match else TOKEN_VALUE.match(text, at).end()
                if match:
                    more.append(("secret", *match.span()))
        elif at >= block and (match := KEY_BLOCK.match(text, at)):
            block = match.end()
            more.append(("secret", at, at + len(match[0].rstrip())))
    spans = [(kind, *span) for kind in BASE for span in base[kind]]
    taken = sorted(span[1:] for span in spans)
    return spans + _apart(more, taken)


def _apart(more: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Further spans that touch no base span and no earlier one, in the order of KINDS, then of start."""
    out, edge, place, reach = [], 0, 0, 0
    for kind, begin, end in sorted(more, key=lambda s: (s[1], s[2], s[0])):
        while place < len(taken) and taken[place][0] < end:
            reach = max(reach, taken[place][1])
            place += 1
        if begin >= edge and begin >= reach:
            out.append((kind, begin, end))
            edge = end
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for kind, begin, end in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a tag in place of each span; overlapping spans become the first one's tag."""
    out, done = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= done:
            out += [text[done:begin], f"<{kind}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def personal_data(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", redact: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans[, redacted]) of every row of ``documents``.

    One pass over whole texts without a shuffle; a task holds the spans of one text. A null text counts as
    empty and redacts to null. Repeated rows have equal results; other columns are ignored. An empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in BASE}
            digests, lists, clean = [], [], []
            for value in batch.column(1):
                own = value.as_py()
                spans = find(own) if own else []
                base = [s for s in spans if s[0] in counts]
                for kind in BASE:
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(spans))
                if redact:
                    clean.append(redacted(own, spans) if own else own)
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()),
                       pa.array(lists, pa.string())]
            names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
            if redact:
                columns.append(pa.array(clean, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    counts = ", ".join(f"n_{k} long" for k in BASE)
    tail = ", redacted string" if redact else ""
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string{tail}")
