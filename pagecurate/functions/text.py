"""Text clean-up expressions (B1, B23, entity unescape)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the set of characters that count as white space when a segment is
# normalised — ASCII controls \t \n \v \f \r, the separators 0x1C-0x1F, NEL (0x85)
# and every Unicode separator (category Z). Written so that Java regex and RE2
# read it the same way.
WHITESPACE_RUN = r"[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]+"

# The predefined XML entities.
XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]
XML_REFERENCE = r"&(?:#x[0-9A-Fa-f]+|#[0-9]+|lt|gt|quot|apos|amp);"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def computed_once(c: Column, use) -> Column:
    """``use(c)`` for a ``use`` that names its argument several times: written out,
    ``c`` would be computed each time, and nested uses multiply."""
    return F.get(F.transform(F.array(c), use), 0)


def normalise_text(c) -> Column:
    """NULL -> '', drop line feeds (no blank in their place), collapse every
    white-space run to one blank, strip both ends."""
    s = F.coalesce(_c(c), F.lit(""))
    s = F.replace(s, F.lit("\n"), F.lit(""))
    s = F.regexp_replace(s, WHITESPACE_RUN, " ")
    return F.trim(s)


def xml_unescape(c) -> Column:
    """Resolve numeric character references and the five predefined entities in
    one pass, i.e. give the text a parser would hand to the caller: what a
    reference stands for is not read again (``&#38;lt;`` is ``&lt;``)."""
    def resolved(s):
        pieces = F.zip_with(F.split(s, XML_REFERENCE, -1), F.regexp_extract_all(s, F.lit(XML_REFERENCE), F.lit(0)),
                            lambda t, ref: F.concat(t, F.coalesce(_resolved(ref), F.lit(""))))
        # the regex runs only on texts that can hold one
        return F.when(s.contains("&"), F.array_join(pieces, "")).otherwise(s)

    return computed_once(_c(c), resolved)


def _resolved(ref: Column) -> Column:
    named = F.lit(None).cast("string")
    for entity, char in XML_ENTITIES:
        named = F.when(ref == entity, F.lit(char)).otherwise(named)
    is_hex = ref.startswith("&#x")
    digits = F.when(is_hex, F.substring(ref, F.lit(4), F.length(ref) - 4)).otherwise(F.substring(ref, F.lit(3), F.length(ref) - 3))
    point = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    is_char = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    # UTF-32BE bytes of the code point -> string; no character: the reference stays
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(is_char, point)), 8, "0")), "UTF-32")
    return F.when(ref.startswith("&#"), F.coalesce(char, ref)).otherwise(named)


def speaker_prefix(c, n_colons) -> Column:
    """Cut a block text to the first ``n_colons + 1`` pieces of a colon split that
    keeps the colons as pieces.

    n = 0 keeps the text before the first colon; n = 1 keeps it up to and with the
    first colon; n = 2 adds the text between the first and second colon but not
    the second colon itself (pieces alternate text / ':'), and so on.
    """
    s = _c(c)
    n = n_colons if isinstance(n_colons, Column) else F.lit(n_colons)
    # pieces: text0, ':', text1, ':', text2 ...  -> first n+1 of them
    texts = F.split(s, ":", -1)
    k = n + F.lit(1)
    # number of text pieces taken = ceil(k/2), colons taken = floor(k/2)
    n_text = F.least(F.size(texts), F.floor((k + F.lit(1)) / F.lit(2)).cast("int"))
    n_colon = F.least(F.size(texts) - F.lit(1), F.floor(k / F.lit(2)).cast("int"))
    head = F.slice(texts, 1, n_text)
    tail = F.when(n_colon == n_text, F.lit(":")).otherwise(F.lit(""))
    return F.concat(F.array_join(head, ":"), tail)
