"""Secret scans with multipart credential linking.

Each text is read for parts of credentials: access identifiers, secrets and
endpoints, strong ones (their form alone gives them away) and weak ones (a
client id, a random-looking token, a host address: harmless alone). Parts are
intervals of the text; each reaches ``REACH`` characters to both sides but not
over a blank line, and that reach is its scope. An interval join of the parts
of a document by their scopes, swept in order of position, links complementary
parts. A weak candidate is reported only when the other half of a credential
lies in its scope: a secret for an access identifier or an endpoint, either of
these for a secret. Strong parts are always reported.

The join runs inside the row, since a scope never leaves its document: parts
are sorted, and every interval looks up by bisection how far the complementary
parts that start in its reach extend (the running maximum of their ends), so a text with n parts costs n log n and emits at
most n spans, whatever its size.

Kinds, in listed order: ``assign``, ``access``, ``hex`` (the base, strong),
then ``weak_access``, ``weak_secret``, ``endpoint``. NULL or empty text gives
an empty array; rows are judged alone; an existing column of the output's name
is replaced; positions are code points.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecurate.llm.common import SPANS, digest, n_kind, spans_array, values

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "weak_access", "weak_secret", "endpoint"]
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret",
        "access": "access", "weak_access": "access", "endpoint": "endpoint"}
#: Roles that complete a credential together with the key's role.
COMPLEMENTS = {"secret": ("access", "endpoint"), "access": ("secret",), "endpoint": ("secret",)}
REACH = 300
MIN_ENTROPY = 3.5

_start = itemgetter(0)

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile("(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|"
                     + _either_case("api") + "_?" + _either_case("key")
                     + r""")["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more are the runs that a length test keeps
_WEAK_ACCESS = re.compile(
    r"\b(?:" + "|".join(map(_either_case, ("client_id", "clientid", "access_id", "user", "username", "login", "account_id", "key_id")))
    + r""")["']? *[:=] *["']?([A-Za-z0-9+/_.@=-]+)""")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# a run of scheme characters before "://"; only its first character can begin one
_SCHEME = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]++(?=://)")
_LETTER = re.compile(r"[A-Za-z]")
_AFTER_SCHEME = re.compile(r"""://[^\s<>"']+""")
_HOST = re.compile(r"\b" + _either_case("host") + r"""["']? *[:=] *["']?[A-Za-z0-9.-]+(?::[0-9]+)?""")
_BLANK_LINE = re.compile(r"\n[\x20\x09-\x0D]*\n")


def _random_looking(token: str) -> bool:
    """Letters and digits mixed, and at least MIN_ENTROPY bits a character."""
    if not (any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token)):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= MIN_ENTROPY


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses ``scheme://rest`` and ``host: name``, leftmost and apart. A scheme
    is found from its "://", to the left, so a text is read a fixed number of times."""
    found, at = [], 0
    runs = _SCHEME.finditer(text) if "://" in text else iter(())
    run, host = next(runs, None), _HOST.search(text)
    while run or host:
        letter = _LETTER.search(text, max(at, run.start()), run.end()) if run and run.end() > at else None
        rest = _AFTER_SCHEME.match(text, run.end()) if letter else None
        if rest is None and run:
            run = next(runs, None)
        elif rest and (host is None or letter.start() <= host.start()):
            found.append((letter.start(), at := rest.end()))
            run = next(runs, None)
        else:
            found.append((host.start(), at := host.end()))
        if host and host.start() < at:
            host = _HOST.search(text, at)
    return found


def _parts(text: str) -> list[tuple[int, int, str]]:
    """Strong and weak parts of a text as (start, end, kind)."""
    lower = text.lower()
    found = []
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    strong = sorted(found)
    starts = [s for s, _, _ in strong]
    reach = list(accumulate((e for _, e, _ in strong), max))  # ends overlap: the furthest so far

    def free(start: int, end: int) -> bool:
        """Whether no strong part overlaps [start, end)."""
        i = bisect_left(starts, end)
        return i == 0 or reach[i - 1] <= start

    found += [(s, e, "endpoint") for s, e in endpoints(text)] if "://" in text or "host" in lower else []
    hosts = [(s, e) for s, e, k in found if k == "endpoint"]
    found += [(m.start(), m.end(), "weak_access") for m in _WEAK_ACCESS.finditer(text)
              if free(m.start(), m.end())] if ":" in text or "=" in text else []
    host_starts = [s for s, _ in hosts]
    for m in _TOKEN.finditer(text):
        i = bisect_left(host_starts, m.end())
        inside_host = i > 0 and hosts[i - 1][1] > m.start()
        if not inside_host and free(m.start(), m.end()) and _random_looking(m[0]):
            found.append((m.start(), m.end(), "weak_secret"))
    return found


def _linked(text: str, parts: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Strong parts, and weak ones with a complementary part in their scope."""
    if all(kind in BASE_KINDS for _, _, kind in parts):
        return parts
    walls = [m.start() for m in _BLANK_LINE.finditer(text)]
    by_role: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for start, end, kind in sorted(parts):
        by_role.setdefault((bisect_left(walls, start), ROLE[kind]), []).append((start, end))
    reach = {key: list(accumulate((e for _, e in others), max)) for key, others in by_role.items()}
    kept = []
    for start, end, kind in parts:
        scope = bisect_left(walls, start)
        if kind in BASE_KINDS:
            kept.append((start, end, kind))
            continue
        for role in COMPLEMENTS[ROLE[kind]]:
            others = by_role.get((scope, role), [])
            # of the parts that start in reach, the one that ends last
            i = bisect_right(others, end + REACH, key=_start)
            if i and start - reach[scope, role][i - 1] <= REACH:
                kept.append((start, end, kind))
                break
    return kept


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Reported spans of one text, by start, then kind as listed."""
    spans = sorted((s, KINDS.index(k), e) for s, e, k in _linked(text, _parts(text)))
    return [(KINDS[k], s, e) for s, k, e in spans]


@F.arrow_udf(SPANS)
def secret_spans(texts: pa.Array) -> pa.Array:
    return spans_array(find_spans(t) if t else [] for t in values(texts))


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Append the array of reported credential spans of each text."""
    return docs.withColumn(out, secret_spans(F.col(text_col)))


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    docs = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    spans = F.col("secrets")
    return docs.select("doc_id", *[n_kind(spans, k) for k in BASE_KINDS], *digest(spans, BASE_KINDS))
