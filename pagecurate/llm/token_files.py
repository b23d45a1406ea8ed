"""Token ids in fixed-width bit-packed files.

File format (little-endian; one file per range of ids, ``PackedFile`` reads it):

* header: magic ``PKTOKEN1``, u32 bits per id, u32 ids per block;
* blocks: every ``block`` ids packed with ``bits`` bits each, first id in the
  lowest bits, padded to whole bytes; each id has the minimum width that the
  vocabulary needs;
* block offsets: u64 byte offset of every block, and of the end of the last;
* document index: i64 id, u8 id-is-NULL and u64 first token per document, and
  the number of ids;
* trailer: u64 offset of the block offsets, u64 blocks, u64 offset of the
  document index, u64 documents, u64 ids, magic.

Any token range is read by unpacking only the blocks it touches, with numpy.

Writing: documents are range-partitioned by id, each task tokenizes its
sorted range as a stream and writes one file under a fresh name, and the task's
result row (its name and counts) enters a manifest table. Only files that the
manifest names count, so a task that is run again after a lost executor leaves
an unnamed file and nothing else. Reading: one task per file.

Defined results: NULL text is an empty text (only the end id); NULL ids come
first; repeated ids are ordered by text; an empty table gives an empty
manifest. Extra columns are ignored; ids are cast to long, and one that is not
a number fails the job. The string of a special token in a text becomes that
token, as the library does by default.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecurate.llm.common import small_batches
from pagecurate.llm.hashing import equal_slices, slice_hashes
from pagecurate.session import scratch_dir

MAGIC = b"PKTOKEN1"
BLOCK = 4096
END_ID = 0
#: Distinct text pieces whose ids a Python worker remembers.
CACHE_PIECES = 500_000
_TRAILER = struct.Struct("<QQQQQ8s")
_HEADER = struct.Struct("<8sII")
# first bytes of blank characters: ASCII blanks and separators, and the first
# bytes in UTF-8 of the blanks beyond ASCII (U+0085, U+00A0, U+1680, U+2000 ff., U+3000)
_BLANK_LEAD = np.zeros(256, bool)
_BLANK_LEAD[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MARKS = b".,;:!?"


# ---- packing ---------------------------------------------------------------

def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids to a bit stream, lowest bit first, padded to whole bytes. 64 ids
    fill exactly ``bits`` 64-bit words, so whole columns shift at once."""
    n = len(ids)
    groups = np.zeros((-(-n // 64), 64), "<u8")
    groups.reshape(-1)[:n] = ids
    words = np.zeros((len(groups), bits), "<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= groups[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= groups[:, j] >> np.uint64(64 - shift)
    return words.tobytes()[:-(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    words = np.zeros((-(-n // 64), bits), "<u8")
    words.reshape(-1).view(np.uint8)[:len(data)] = np.frombuffer(data, np.uint8)
    groups = np.empty((len(words), 64), "<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        groups[:, j] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            groups[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    return (groups.reshape(-1)[:n] & np.uint64((1 << bits) - 1)).astype(np.uint32)


# ---- files -----------------------------------------------------------------

def _open(path: str, mode: str):
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_file(inner)


class PackedWriter:
    """Streams ids into a file; holds one block and the document index."""

    def __init__(self, path: str, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = _open(path, "w"), bits, block
        self.out.write(_HEADER.pack(MAGIC, bits, block))
        self.at, self.offsets, self.rest, self.held, self.n_ids = _HEADER.size, [], [], 0, 0
        self.doc_ids, self.doc_starts = [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.doc_starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 16 * self.block:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            self._write(ids[i:min(i + self.block, whole)])
        self.rest, self.held = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush(last=True)
        blocks_at = self.at
        table = np.asarray([*self.offsets, self.at], "<u8").tobytes()
        index = (np.asarray([d or 0 for d in self.doc_ids], "<i8").tobytes()
                 + np.asarray([d is None for d in self.doc_ids], "u1").tobytes()
                 + np.asarray([*self.doc_starts, self.n_ids], "<u8").tobytes())
        self.out.write(table + index + _TRAILER.pack(blocks_at, len(self.offsets), blocks_at + len(table),
                                                     len(self.doc_ids), self.n_ids, MAGIC))
        self.out.close()


class PackedFile:
    """Random access to a packed file."""

    def __init__(self, path: str):
        self.f = _open(path, "r")
        size = self.f.size()
        blocks_at, n_blocks, docs_at, self.n_docs, self.n_ids, magic = _TRAILER.unpack(self._read(size - _TRAILER.size, size))
        head, self.bits, self.block = _HEADER.unpack(self._read(0, _HEADER.size))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{path} is not a packed token file")
        self.offsets = np.frombuffer(self._read(blocks_at, blocks_at + 8 * (n_blocks + 1)), "<u8")
        index = self._read(docs_at, docs_at + 17 * self.n_docs + 8)
        ids = np.frombuffer(index, "<i8", self.n_docs)
        missing = np.frombuffer(index, "u1", self.n_docs, 8 * self.n_docs)
        self.doc_ids = [None if m else int(d) for d, m in zip(ids, missing)]
        self.starts = np.frombuffer(index, "<u8", self.n_docs + 1, 9 * self.n_docs).astype(np.int64)

    def _read(self, start: int, end: int) -> bytes:
        self.f.seek(int(start))
        return self.f.read(int(end) - int(start))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids at positions [start, end) of the file."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        data = self._read(self.offsets[first], self.offsets[last + 1])
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            at = int(self.offsets[b] - self.offsets[first])
            parts.append(unpack(data[at:int(self.offsets[b + 1] - self.offsets[first])], n, self.bits))
        base = first * self.block
        return np.concatenate(parts)[start - base:end - base]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first position, ids) of every document, reading runs of blocks."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + ids_at_once, "right")) - 1)
            run = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                yield self.doc_ids[k], int(self.starts[k]), run[self.starts[k] - self.starts[i]:self.starts[k + 1] - self.starts[i]]
            i = j

    def close(self) -> None:
        self.f.close()


# ---- tokenizing ------------------------------------------------------------

def cut_pieces(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts [start, end) that lie end to end in a
    buffer: the texts' starts, and each space between two characters that are not
    blank. Characters whose first byte also begins a blank beyond ASCII count as
    blank, so a few texts are cut less often than they could be."""
    at = np.flatnonzero(raw == 0x20)
    inner = np.ones(len(raw) + 1, bool)
    inner[starts] = inner[ends] = inner[np.maximum(ends - 1, 0)] = False
    at = at[inner[at]]
    before, after = raw[at - 1], raw[np.minimum(at + 1, len(raw) - 1)]
    plain = ~_BLANK_LEAD[before] & ~_BLANK_LEAD[after]
    # the last byte of a character beyond ASCII does not tell its first byte
    far = before >= 0x80
    second, third = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    plain &= ~(far & (_BLANK_LEAD[second] & (second >= 0x80) | _BLANK_LEAD[third] & (third >= 0x80)))
    return np.sort(np.concatenate([starts[ends > starts], at[plain]]))


def _byte_level(file: dict) -> bool:
    """Whether a tokenizer file is a BPE whose texts may be cut by ``cut_pieces``."""
    cutter, model = file["pre_tokenizer"] or {}, file["model"]
    plain = {"truncation", "padding", "normalizer", "post_processor"}
    return (cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
            and model["type"] == "BPE" and not model.get("dropout") and not any(file.get(k) for k in plain))


class PieceEncoder:
    """Byte-level BPE of whole texts, one library call per new piece.

    The byte-level pre-tokenizer never joins characters across a single space
    between two non-blank characters, so a text is the sequence of its pieces
    (each with its leading space) and a piece always has the same ids. Pieces
    recur: those of a batch are grouped by a 64-bit hash, each distinct one is
    looked up in a bounded memory or tokenized, and the ids of the batch are
    gathered with numpy; only new pieces are Python objects. Wherever a hash is
    met again the bytes of the pieces are compared.

    Texts that hold the string of an added token go to the library whole, and
    so do all texts when the file is not a plain byte-level BPE (another
    pre-tokenizer or model, a normalizer, truncation, padding, dropout)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_piece = _byte_level(json.loads(self.tokenizer.to_str()))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the memory: the hash (sorted) and bytes of each known piece, and its ids in a pool
        self.hashes, self.bytes = np.empty(0, np.uint64), np.empty(0, np.uint8)
        self.byte_at, self.byte_size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.at, self.size, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        # a byte-level token is written with one character per byte
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(self.vocabulary, np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_inner(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that begin with a space and do not end with a blank.
        They are encoded as one text and told apart by the bytes that each token
        stands for."""
        if not pieces:
            return {}
        ids = np.asarray(self._ids([b"".join(pieces).decode()])[0], "<u4")
        ends = np.cumsum([len(p) for p in pieces])
        cut = (4 * (np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1)).tolist()
        data = ids.tobytes()
        return {p: data[i:j] for p, i, j in zip(pieces, [0, *cut], cut)}

    def _encode_each(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        return {p: np.asarray(ids, "<u4").tobytes() for p, ids in zip(pieces, self._ids([p.decode() for p in pieces]))}

    def _encode_fresh(self, fresh: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that are not known. A run of letters and the
        punctuation behind it never share a token, so "word," needs only
        "word" and ","; pieces that open a text, or close it with a blank, are
        encoded one by one."""
        inner, outer, parts = set(), [], {}
        for p in fresh:
            if p[0] != 0x20 or _BLANK_LEAD[p[-1]] or p[-1] >= 0x80 and p[-8:].decode(errors="ignore")[-1].isspace():
                outer.append(p)
                continue
            core = p.rstrip(_MARKS)
            if len(core) < len(p) and (core[1:].isalpha() or not core.isascii() and core[1:].decode().isalpha()):
                parts[p] = core
                inner.add(core)
            else:
                inner.add(p)
        found = self._encode_inner(list(inner))
        marks = self._encode_each(list({p[len(c):] for p, c in parts.items()}))
        for p, c in parts.items():
            found[p] = found[c] + marks[p[len(c):]]
        return found | self._encode_each(outer)

    def _tokenized(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of each piece's ids in a pool."""
        found = self._encode_fresh(pieces)
        ids = [found[p] for p in pieces]
        size = np.array([len(x) // 4 for x in ids], np.int64)
        return np.cumsum(size) - size, size, np.frombuffer(b"".join(ids), "<u4")

    def _remembered(self, hashes: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for distinct pieces [begin, end), in ascending order of their
        hashes; those that are not known are then remembered."""
        size_in = end - begin
        where = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = np.zeros(len(hashes), bool)
        if len(self.hashes):
            met = np.flatnonzero((self.hashes[where] == hashes) & (self.byte_size[where] == size_in))
            known[met] = equal_slices(raw, begin[met], end[met], self.bytes, self.byte_at[where[met]])
        fresh = np.flatnonzero(~known)
        pieces = [raw[i:j].tobytes() for i, j in zip(begin[fresh].tolist(), end[fresh].tolist())]
        new_at, new_size, new_pool = self._tokenized(pieces)
        at, size = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        at[known], size[known] = self.at[where[known]], self.size[where[known]]
        at[fresh], size[fresh] = new_at + len(self.pool), new_size
        pool = np.concatenate([self.pool, new_pool])
        if len(self.hashes) < CACHE_PIECES:
            # one entry per first hash
            first = self.hashes[where[fresh]] != hashes[fresh] if len(self.hashes) else np.ones(len(fresh), bool)
            new = fresh[first]
            slot = np.searchsorted(self.hashes, hashes[new])  # both in ascending order
            held = np.frombuffer(b"".join(pieces), np.uint8)
            byte_at = np.cumsum(size_in[fresh]) - size_in[fresh] + len(self.bytes)
            self.pool, self.bytes = pool, np.concatenate([self.bytes, held])
            self.hashes, self.byte_at, self.byte_size, self.at, self.size = (np.insert(a, slot, v) for a, v in (
                (self.hashes, hashes[new]), (self.byte_at, byte_at[first]), (self.byte_size, size_in[new]), (self.at, at[new]), (self.size, size[new])))
        return at, size, pool

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The library's ids of each text (``add_special_tokens=False``)."""
        whole = [i for i, t in enumerate(texts) if t and (not self.by_piece or any(a in t for a in self.added))]
        if not whole:
            return self._encode_pieces(texts)
        rest = [*texts]
        for i in whole:
            rest[i] = ""
        out = self._encode_pieces(rest)
        for i in whole:
            out[i] = np.asarray(self._ids([texts[i]])[0], np.uint32)
        return out

    def _encode_pieces(self, texts: list[str | None]) -> list[np.ndarray]:
        coded = [(t or "").encode() for t in texts]
        ends = np.cumsum([len(c) for c in coded], dtype=np.int64)
        starts = ends - np.array([len(c) for c in coded], np.int64)
        data = b"".join(coded)
        if not data:
            return [np.empty(0, np.uint32) for _ in texts]
        raw = np.frombuffer(data, np.uint8)
        begin = cut_pieces(raw, starts, ends)
        end = np.append(begin[1:], len(raw))
        hashes, first, which = np.unique(slice_hashes(raw, begin, end), return_index=True, return_inverse=True)
        of = first[which]
        if (end - begin == (end - begin)[of]).all() and equal_slices(raw, begin, end, raw, begin[of]).all():
            at, size, pool = self._remembered(hashes, raw, begin[first], end[first])
        else:  # two pieces of one hash: tell them apart by their bytes
            _, first, which = np.unique(np.array([data[i:j] for i, j in zip(begin.tolist(), end.tolist())], object), return_index=True, return_inverse=True)
            at, size, pool = self._tokenized([data[begin[i]:end[i]] for i in first.tolist()])
        n = size[which]
        behind = np.cumsum(n)
        tokens = pool[np.repeat(at[which] - (behind - n), n) + np.arange(behind[-1])]
        # a text's ids end where the pieces before the next text end
        stop = np.append(0, behind)[np.searchsorted(begin, ends)]
        return [tokens[i:j] for i, j in zip([0, *stop.tolist()], stop.tolist())]


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return PieceEncoder(path)


def _batches(texts: list, chars: int = 1 << 20) -> Iterator[slice]:
    """Runs of rows with about so many characters each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


# ---- Spark -----------------------------------------------------------------

MANIFEST = "path string, shard int, n_docs long, n_ids long, first_id long, bits int, vocabulary int"


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Write ``docs`` in ascending id order as packed files below ``folder``;
    returns the manifest, itself a table there (``folder/manifest``)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, out, path, first = _encoder(tokenizer_path), None, None, None
        bits = bits_for(encoder.vocabulary)
        end = np.asarray([end_id], np.uint32)
        for batch in small_batches(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if out is None and ids:
                path, first = f"{folder}/tokens-{uuid.uuid4().hex}.bin", ids[0]
                out = PackedWriter(path, bits, block)
            for run in _batches(texts):
                for d, tokens in zip(ids[run], encoder.encode(texts[run])):
                    out.add(d, np.concatenate([tokens, end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{
                "path": path, "shard": TaskContext.get().partitionId(), "n_docs": len(out.doc_ids), "n_ids": out.n_ids,
                "first_id": first, "bits": bits, "vocabulary": encoder.vocabulary}], schema=_MANIFEST_ARROW)

    # the opening of the text parts repeated ids over several tasks in the same order
    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
               .repartitionByRange("id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text"))
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


_MANIFEST_ARROW = pa.schema([("path", pa.string()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                             ("first_id", pa.int64()), ("bits", pa.int32()), ("vocabulary", pa.int32())])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as little-endian u32).

    The manifest has one row per file; the running sum over it is the only
    step that sees all files at once."""
    spark = manifest.sparkSession
    files, before = [], 0
    for r in manifest.select("path", "shard", "n_ids").orderBy("shard").toLocalIterator():
        files.append((r["path"], before))
        before += r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f, rows = PackedFile(path), []
                for d, start, ids in f.documents():
                    rows.append((d, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _doc_rows(rows)
                        rows = []
                f.close()
                yield _doc_rows(rows)

    table = spark.createDataFrame(files, "path string, base long")
    return (table.repartition(max(1, len(files)), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def _doc_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def tokens_of(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write and read back: one row per document."""
    folder = scratch_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer_path, **options))


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op4_tokens(spark, sf_dir: str) -> DataFrame:
    return tokens_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer())
