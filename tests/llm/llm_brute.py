"""Brute-force readings used by several tests."""
import re
import zlib

import numpy as np

#: Two words that a polynomial modulo 2**64 cannot tell apart, whatever its base.
_BITS = "".join(str(bin(i).count("1") % 2) for i in range(1024))
THUE_MORSE = (_BITS.translate(str.maketrans("01", "ab")), _BITS.translate(str.maketrans("01", "ba")))

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def groups(texts):
    """Union-find over all pairs of row numbers whose sets are similar enough."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= 75 * (len(a) + len(b) - k):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return sets, [root(i) for i in range(len(sets))]


def near_dups(rows):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets, of = groups([t for _, t in rows])
    smallest = {}
    for (d, _), r in zip(rows, of):
        if d is not None:
            smallest[r] = min(smallest.get(r, d), d)
    out = [(d, len(s), smallest.get(r) if s else d, d == (smallest.get(r) if s else d)) for (d, _), s, r in zip(rows, sets, of)]
    return sorted(out, key=repr)


def token_rows(rows, tokenizer):
    """(doc_id, start, n_tokens, ids_crc32) in id order."""
    out, start = [], 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (d, _), e in zip(rows, tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        ids = e.ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)
