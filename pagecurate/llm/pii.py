"""Personal data by anchor expansion.

One Aho-Corasick pass per text finds anchors: at-signs, digits, digit-dot
pairs, plus-digit pairs, ``://`` and identifier cues. A deterministic local
parser for each anchor kind then expands to the left and right of its anchor
and validates what it has read. A text costs one automaton pass plus the
characters around its anchors; nothing is shuffled.

Kinds, in listed order: ``email``, ``ip``, ``card``, ``phone`` (the base),
then ``url`` (an address that names a user) and ``account`` (an identifier
behind a cue such as "account no").

Defined results: NULL or empty text gives an empty array; every row is judged
alone, so repeated rows repeat their spans; an existing column of the output's
name is replaced, other columns pass through. Positions are code points.
"""

from __future__ import annotations

import re
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecurate.llm.common import SPANS, digest, n_kind, spans_array, values

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "url", "account"]
CUES = ["account", "acct", "iban", "passport", "ssn", "customer id", "member id"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGIT_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE_TAIL = re.compile(r"[ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"']+")
_USER_PATH = re.compile(r"/(?:~|u/|users?/|profile/|@)[A-Za-z0-9._-]+")
_ACCOUNT = re.compile(r"(?: ?(?:number|num|no\.?|nr\.?|#))? ?[:=#]? ?([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])")
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
_ID_TOKEN = re.compile(r"[A-Za-z0-9-]+")


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("://", ("url", 3))
    for d in sorted(_DIGITS):
        a.add_word(d, ("card", 1))
        a.add_word(f"{d}.", ("ip", 2))
        a.add_word(f"+{d}", ("phone", 2))
    for cue in CUES:
        a.add_word(cue, ("account", len(cue)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _back(text: str, end: int, floor: int, allowed: frozenset) -> int:
    i = end
    while i > floor and text[i - 1] in allowed:
        i -= 1
    return i


def _email(text: str, at: int, floor: int):
    left = _back(text, at, floor, _LOCAL)
    m = _DOMAIN.match(text, at + 1) if left < at else None
    return (left, m.end(), True) if m else None


def _ip_address(text: str, at: int, floor: int):
    m = _IP.match(text, _back(text, at + 1, floor, _DIGITS))
    return (m.start(), m.end(), all(int(p) <= 255 for p in m[0].split("."))) if m else None


def _card(text: str, at: int, floor: int):
    m = _DIGIT_CHAIN.match(text, at)
    if not m:
        return None
    digits = m[0].replace(" ", "").replace("-", "")
    return m.start(), m.end(), 12 <= len(digits) <= 19 and _luhn(digits)


def _phone(text: str, at: int, floor: int):
    m = _PHONE_TAIL.match(text, at + 2)
    return (at, m.end(), 9 <= sum(c in _DIGITS for c in text[at:m.end()]) <= 15) if m else None


def _url(text: str, at: int, floor: int):
    left = _back(text, at, floor, _SCHEME)
    m = _URL_REST.match(text, at + 3)
    if left == at or not m:
        return None
    rest = m[0].rstrip(".,;:!?)]}")
    authority = rest.split("/", 1)[0]
    named = "@" in authority or _USER_PATH.search(rest) is not None
    return left, at + 3 + len(rest), named


def _account(text: str, at: int, floor: int):
    cue_end = at
    while cue_end < len(text) and (text[cue_end].isalpha() or text[cue_end] == " " and text[at:cue_end].lower() in ("customer", "member")):
        cue_end += 1
    if text[at:cue_end].lower() not in CUES or at and text[at - 1].isalnum():
        return None
    m = _ACCOUNT.match(text, cue_end)
    if not m:
        return None
    start, cue_is_iban = m.start(1), text[at:cue_end].lower() == "iban"
    # groups of an identifier hold digits; a following plain word ends it
    end = start
    for part in _ID_TOKEN.finditer(text, start, m.end(1)):
        bank_code = cue_is_iban and len(part[0]) == 4 and part[0].isupper()
        if not bank_code and not any(c in _DIGITS for c in part[0]):
            break
        end = part.end()
    value = text[start:end].replace(" ", "").replace("-", "").upper()
    ok = 6 <= len(value) <= 34 and sum(c in _DIGITS for c in value) >= 4
    if ok and cue_is_iban:
        moved = value[4:] + value[:4]
        ok = int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    return (start, end, ok) if end > start else None


_PARSERS = {"email": _email, "ip": _ip_address, "card": _card, "phone": _phone, "url": _url, "account": _account}


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of one text, by start, then kind as listed. Per kind a match ends
    where the next may begin, also when validation drops it."""
    ends = dict.fromkeys(KINDS, 0)
    found = []
    for last, (kind, width) in _anchors().iter(text.translate(_LOWER)):  # of the same length; cues in any case
        at = last - width + 1
        if at < ends[kind]:
            continue
        read = _PARSERS[kind](text, at, ends[kind])
        if read:
            start, end, valid = read
            ends[kind] = end
            if valid:
                found.append((start, KINDS.index(kind), end))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


@F.arrow_udf(SPANS)
def pii_spans(texts: pa.Array) -> pa.Array:
    return spans_array(find_spans(t) if t else [] for t in values(texts))


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Append the array of personal-data spans of each text."""
    return docs.withColumn(out, pii_spans(F.col(text_col)))


def mask_pii(docs: DataFrame, text_col: str = "text", mask: str = "[{}]") -> DataFrame:
    """Replace each span by its kind; of overlapping spans the first stays."""
    spans = F.col("_pii")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.col(text_col)

    def step(acc, s):
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                         F.format_string(mask.replace("{}", "%s"), s["kind"]))
        return F.when(s["start"] >= acc["at"], F.struct(piece.alias("out"), s["end"].alias("at"))).otherwise(acc)

    done = F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return find_pii(docs, text_col, "_pii").withColumn(text_col, done).drop("_pii")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    spans = F.col("pii")
    return docs.select("doc_id", *[n_kind(spans, k) for k in BASE_KINDS], *digest(spans, BASE_KINDS))
