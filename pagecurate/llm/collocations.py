"""Phrase collocations by stripes.

Texts are cut into pieces at ``CUTS``, pieces into words (A-Z in lower case); a
phrase is a run of words of one piece. For phrases of m words each prefix of
m - 1 words keys a stripe: an associative counter of the words that follow it. A
task sums the cells (prefix, next word) of its batches and gives on one stripe of
a prefix for all of them, or for as many as hold ``MOST_CELLS`` different cells,
so that stripes grow with the tasks and not with the batches a prefix occurs in.
Stripes of one prefix are merged elementwise, by summing their cells with map-side
combination, so the stripe of a frequent prefix is never gathered in one place.
Cells of at least ``MIN_COUNT`` are the frequent phrases of m words: they are
the extensions of the prefix, their totals are the counts of the prefixes of the next
stripes, and the greatest cell of a stripe (and, keyed by the phrase without its
first word, the greatest one on the other side) says whether an extension
subsumes the phrase.

Passes. Both parts of a frequent phrase that leave out its first or last word are
frequent, so a pass only counts phrases whose parts passed the one before:

1. words, exactly;
2. to 4. pairs, triples, then all longer phrases of such triples, counted under a
   64-bit hash alone, which bounds each phrase's count from above;
5. the stripes of the phrases that may be frequent.

Tasks know what passed from bitmaps of ``FILTER_BITS`` bits, which is what is
sent to them whatever the corpus. Each hash has ``HASH_BITS`` of them: with one, the
phrases let through by chance grow with the square of the corpus, by those asked
for and by those that passed. A hash or its bits can let a phrase pass but never
misses one, and the stripes carry their words, so all counts are exact.

Scores. Each cut of a candidate joins the counts of its two parts; all
arithmetic is on decimals of 38 digits. A count is a BIGINT; words of one language
may be up to 10^17.

Defined results: NULL or empty texts have no pieces; a NULL language is
``NO_LANG``, the same as that name; repeated rows count each; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecurate.llm.common import hinted, small_batches, written
from pagecurate.llm.hashing import equal_slices, mix, runs_of, slice_hashes

MOST_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: A power of two; the bitmaps take an eighth of it in bytes.
FILTER_BITS = 1 << 26
HASH_BITS = 4
#: Per cent of a phrase's count that a longer candidate needs to subsume it.
SUBSUMED = 100
NO_LANG = "und"
CUTS = b".,;:!?\n\x0b\x0c\r"
MOST_BROADCAST = 500_000
#: Different cells a task holds before it gives its stripes on, and those of one
#: row: a longer stripe goes on in the next. Bounds on memory; the sums are the same.
MOST_CELLS = 1 << 19
ROW_CELLS = 20_000
_FLAT = bytes.maketrans(CUTS + bytes(range(65, 91)), b"\n" * len(CUTS) + bytes(range(97, 123)))
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, 0x09, 0x0A]] = True  # what is left between words
_STEP = np.uint64(0xD6E8FEB86659FD93)


# ---- words of a batch --------------------------------------------------------

def cut_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end as bytes, and of each word its start, end and piece."""
    raw = np.frombuffer(b"\n".join((t or "").encode() for t in texts).translate(_FLAT), np.uint8)
    starts, ends = runs_of(~_BETWEEN[raw])
    return raw, starts, ends, np.cumsum(raw == 10)[starts]


def number_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, place of the first word of each number); equal words,
    by their bytes, have one number."""
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    of = first[ids]
    if (ends - starts != (ends - starts)[of]).any() or not equal_slices(raw, starts, ends, raw, starts[of]).all():
        words = [raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]  # two words of one hash
        _, first, ids = np.unique(np.array(words, object), return_index=True, return_inverse=True)
    return ids, first


def run_hashes(lang: str, hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words of a language."""
    name = np.frombuffer(lang.encode(), np.uint8)
    h = np.full(max(0, len(hashes) - size + 1), slice_hashes(name, np.array([0]), np.array([len(name)]))[0] + np.uint64(size))
    for k in range(size):
        h = h * _STEP + hashes[k:k + len(h)]
    return mix(h)


def passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes have all their bits set in a bitmap."""
    last = np.uint64(8 * len(bits) - 1)
    at, step = (hashes & last).astype(np.int64), (hashes >> np.uint64(32) & last | np.uint64(1)).astype(np.int64)
    passes = np.ones(len(hashes), bool)
    for k in range(HASH_BITS):
        bit = at + k * step & int(last)
        passes &= (bits[bit >> 3] >> (bit & 7) & 1).astype(bool)
    return passes


def places(lang: str, hashes: np.ndarray, piece: np.ndarray, size: int, filters: dict[int, np.ndarray]) -> np.ndarray:
    """Where the runs of ``size`` words begin that lie in one piece and of which
    the runs of ``part`` words, the longest there is a filter for, all pass it."""
    n = max(0, len(hashes) - size + 1)
    starts = piece[:n] == piece[size - 1:size - 1 + n]
    part = max((k for k in filters if k <= size), default=0)
    if part and n:
        passes = passing(run_hashes(lang, hashes, part), filters[part])
        for k in range(size - part + 1):
            starts &= passes[k:k + n]
    return np.flatnonzero(starts)


def number_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first row of each number, number of each row) of rows given by
    their columns, numbered in order; equal rows have one number."""
    names, most = columns[0], max(int(c.max()) for c in columns) + 1
    for column in columns[1:]:
        names = np.unique(names * most + column, return_inverse=True)[1]
    return np.unique(names, return_index=True, return_inverse=True)[1:]


def count_runs(ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, count) of each distinct run of ``size`` words that begins at one
    of the places ``at``, in order of the numbers."""
    if not len(at):
        return np.empty((0, size), np.int64), np.empty(0, np.int64)
    first, names = number_runs([ids[at + k] for k in range(size)])
    return np.stack([ids[at[first] + k] for k in range(size)], axis=1), np.bincount(names)


def batch_counts(lang: str, texts: list[str | None], sizes: tuple[int, ...],
                 filters: dict[int, np.ndarray]) -> tuple[list[str | None], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The words by number, and for each size the phrases as rows of numbers and
    their counts. Phrases of one word count all words under NULL, too."""
    raw, starts, ends, piece = cut_words(texts)
    if not len(starts):
        return [], {}
    hashes = slice_hashes(raw, starts, ends)
    ids, first = number_words(raw, starts, ends, hashes)
    word = [*(raw[a:b].tobytes().decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())), None]
    counts = {}
    for size in sizes:
        rows, n = count_runs(ids, places(lang, hashes, piece, size, filters), size)
        if size == 1:
            rows, n = np.append(rows, [[len(first)]], axis=0), np.append(n, n.sum())
        counts[size] = rows, n
    return word, counts


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One (rows, counts) of several: each distinct row once, in order."""
    rows, n = (np.concatenate(x) for x in zip(*parts))
    first, names = number_runs(list(rows.T))
    total = np.zeros(len(first), np.int64)
    np.add.at(total, names, n)
    return rows[first], total


class Gathered:
    """The phrases of one language in the batches of a task: words numbered in order
    of their coming, for each size parts of (rows of numbers, counts)."""

    def __init__(self) -> None:
        self.number: dict[str | None, int] = {}
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, word: list[str | None], counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        for size, (rows, n) in counts.items():
            if len(n):
                used, at = np.unique(rows, return_inverse=True)
                number = np.array([self.number.setdefault(word[i], len(self.number)) for i in used.tolist()])
                self.parts.setdefault(size, []).append((number[at].reshape(rows.shape), n))

    def cells(self) -> int:
        return sum(len(n) for parts in self.parts.values() for _, n in parts)

    def merge(self) -> None:
        """One part of each size, in which each phrase has one row, in order."""
        self.parts = {size: [summed(parts)] for size, parts in self.parts.items()}

    def stripes(self, lang: str) -> Iterator[pa.RecordBatch]:
        """(size, lang, prefix, next words, counts), after a merge."""
        words = pa.array(list(self.number), pa.string())
        for size, [(rows, n)] in self.parts.items():
            turns = np.append(True, (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1))
            turns[::ROW_CELLS] = True
            begin = np.flatnonzero(turns)
            prefix = [words.take(pa.array(rows[begin, k])) for k in range(size - 1)]
            cuts = pa.array(np.append(begin, len(n)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(begin), size, np.int32)), pa.array([lang] * len(begin), pa.string()),
                 pc.binary_join_element_wise(*prefix, " ") if prefix else pa.array([""] * len(begin)),
                 pa.ListArray.from_arrays(cuts, words.take(pa.array(rows[:, -1]))), pa.ListArray.from_arrays(cuts, pa.array(n, pa.int64()))],
                names=["size", "lang", "prefix", "next", "n"])


def task_stripes(texts: Iterable[tuple[str, list[str | None]]], sizes: tuple[int, ...], filters: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(size, lang, prefix, next words, counts) of the batches (lang, texts) of a task."""
    gathered: dict[str, Gathered] = {}
    cells = 0
    for lang, of_lang in texts:
        word, counts = batch_counts(lang, of_lang, sizes, filters)
        gathered.setdefault(lang, Gathered()).add(word, counts)
        cells += sum(len(n) for _, n in counts.values())
        if cells > MOST_CELLS:
            for g in gathered.values():
                g.merge()
            cells = sum(g.cells() for g in gathered.values())
            if cells > MOST_CELLS // 2:  # merging again would free little
                for of, g in gathered.items():
                    yield from g.stripes(of)
                gathered, cells = {}, 0
    for lang, g in gathered.items():
        g.merge()
        yield from g.stripes(lang)


# ---- passes over the texts -----------------------------------------------------

def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str | None]]]:
    for batch in small_batches(batches, 4_000):
        texts: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(lang, []).append(text)
        yield from texts.items()


def stripes(texts: DataFrame, sizes: tuple[int, ...], filters: dict[int, np.ndarray]) -> DataFrame:
    """(size, lang, prefix, next, n): the merged stripes of the texts (lang, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task_stripes(_by_lang(batches), sizes, filters)

    built = texts.mapInArrow(build, "size int, lang string, prefix string, next array<string>, n array<long>")
    cells = built.select("size", "lang", "prefix", F.inline(F.arrays_zip("next", "n")))
    return cells.groupBy("size", "lang", "prefix", "next").agg(F.sum("n").alias("n"))


def hashed_counts(texts: DataFrame, sizes: tuple[int, ...], filters: dict[int, np.ndarray]) -> DataFrame:
    """(hash, n): the occurrences of the phrases of these sizes, by their hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, of_lang in _by_lang(batches):
            raw, starts, ends, piece = cut_words(of_lang)
            hashes = slice_hashes(raw, starts, ends)
            for size in sizes:
                found, n = np.unique(run_hashes(lang, hashes, size)[places(lang, hashes, piece, size, filters)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["hash", "n"])

    return texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _word_hashes(words: DataFrame) -> DataFrame:
    """(hash) of words (lang, word)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches):
            words = [w.encode() for w in texts]
            ends = np.cumsum([len(w) for w in words], dtype=np.int64)
            hashes = slice_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
            yield pa.RecordBatch.from_arrays([pa.array(run_hashes(lang, hashes, 1).view(np.int64))], names=["hash"])

    return words.mapInArrow(of, "hash long")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, as bytes, with those of the hashes set."""
    last = F.lit(FILTER_BITS - 1).cast("long")
    first, step = F.col("hash").bitwiseAND(last), F.shiftrightunsigned("hash", 32).bitwiseAND(last).bitwiseOR(F.lit(1).cast("long"))
    bits = hashes.select(F.explode(F.array(*((first + k * step).bitwiseAND(last) for k in range(HASH_BITS)))).alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    # at most FILTER_BITS / 64 rows, whatever the number of phrases
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(mask).alias("mask")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("mask").to_numpy()
    return out.view(np.uint8)


def frequent_phrases(texts: DataFrame, most_words: int = MOST_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, prefix, suffix, size, n) of the phrases that occur
    ``min_count`` times, and (lang, total) with all words of each language."""
    texts = texts.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    often = F.col("n") >= min_count
    words = written(stripes(texts, (1,), {}).filter(often | F.col("next").isNull()), "stripes-words")
    filters = {1: bitmap(_word_hashes(words.filter("next IS NOT NULL").select("lang", "next")))}
    for sizes in [(2,), (3,), tuple(range(4, most_words + 1))]:
        if sizes and sizes[-1] <= most_words:
            passed = bitmap(hashed_counts(texts, sizes, {sizes[0] - 1: filters[sizes[0] - 1]}).filter(often).select("hash"))
            filters |= dict.fromkeys(sizes, passed)
    longer = written(stripes(texts, tuple(range(2, most_words + 1)), filters).filter(often), "stripes-phrases")
    phrase = F.concat_ws(" ", F.when(F.col("prefix") != "", F.col("prefix")), "next")
    after_first = F.concat_ws(" ", F.when(F.col("prefix").contains(" "), F.expr("substring_index(prefix, ' ', 2 - size)")), "next")
    found = (words.filter("next IS NOT NULL").unionByName(longer)
             .select("lang", phrase.alias("phrase"), "prefix", after_first.alias("suffix"), "size", "n"))
    return found, words.filter("next IS NULL").select("lang", F.col("n").alias("total"))


# ---- scores --------------------------------------------------------------------

def _scores(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score: each candidate by its weakest cut."""
    words = F.split("phrase", " ")
    cuts = (candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .withColumn("left", F.array_join(F.slice(words, 1, F.col("k")), " "))
            .withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.size(words) - F.col("k")), " ")))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    known = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(hinted(totals, MOST_BROADCAST), "lang")

    def exact(c: str) -> Column:
        return F.col(c).cast("decimal(17,0)")

    known = known.select("lang", "phrase", "a", "k", "l", "r", "total", (F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("total")).alias("top"),
                         (exact("l") * exact("r")).alias("bottom")).withColumn("score", F.expr("top div bottom"))
    weakest = F.min(F.struct("score", "k", "a", "l", "r", F.col("total").alias("n"))).alias("w")
    return known.groupBy("lang", "phrase").agg(weakest).select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")


def mine_collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = MOST_WORDS, min_count: int = MIN_COUNT,
                      top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a
    (count), l and r (counts of the parts at the weakest cut), n (words of the
    language), score ``floor(1000 a n / (l r))``."""
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    found, totals = frequent_phrases(texts, most_words, min_count)
    # the greatest cells of the stripes that extend a phrase on either side; a longer
    # candidate that holds it reaches no more than the one-word extension inside it
    longer = found.filter("size > 2")
    cover = (longer.select("lang", F.col("prefix").alias("phrase"), "n").unionByName(longer.select("lang", F.col("suffix").alias("phrase"), "n"))
             .groupBy("lang", "phrase").agg((F.max("n") * 100).alias("cover")))
    kept = (found.filter("size > 1").join(cover, ["lang", "phrase"], "left")
            .filter(F.col("cover").isNull() | (F.col("cover") < subsumed * F.col("n"))))
    scored = written(_scores(kept, found.select("lang", "phrase", "n"), totals), "collocations")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return mine_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


def op13_sql(min_count: int = MIN_COUNT, top: int = TOP, subsumed: int = SUBSUMED) -> str:
    return rf"""
WITH p AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS n
  FROM i, range(1, {MOST_WORDS + 1}) s(size) WHERE i + size - 1 <= len(w) GROUP BY 1, 2, 3 HAVING count(*) >= {min_count}),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
o AS (
  SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[b:b + k - 1], ' ') AS phrase, n
  FROM f, range(2, {MOST_WORDS}) a(k), range(1, {MOST_WORDS}) s(b) WHERE k < size AND b + k - 1 <= size),
c AS (
  SELECT lang, size, phrase, n FROM f WHERE size > 1
  AND NOT EXISTS (SELECT 1 FROM o WHERE o.lang = f.lang AND o.phrase = f.phrase AND 100 * o.n >= {subsumed} * f.n)),
x AS (
  SELECT c.lang, phrase, n AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') AS rp
  FROM c, range(1, {MOST_WORDS}) a(k) WHERE k < size),
s AS (
  SELECT x.lang, x.phrase, a, l.n AS l, r.n AS r, t.n, k, ((1000::HUGEINT * a * t.n) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = lp JOIN f r ON r.lang = x.lang AND r.phrase = rp JOIN t ON t.lang = x.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {top}
"""
