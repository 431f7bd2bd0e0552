"""Plain versions of the operators' results, and tables of awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_id long, n long, spans string, words string, score double"


def awkward(extra=()):
    """Rows with nulls everywhere, empty and very long texts, repeats and ties, and clashing columns."""
    passage = " ".join(f"w{i}" for i in range(70))
    long = " ".join(f"x{i % 977}y{i % 31}" for i in range(30_000))
    texts = [
        (1, passage), (2, "before " + passage + " after"), (2, "before " + passage + " after"), (3, None), (4, ""), (5, " \t\n "),
        (None, passage), (None, None), (6, "one"), (7, "one two three four"), (8, "one two three four"), (9, long), (10, long + " tail"),
        (11, "a" * 3000), (12, "é à ﬁ 日本 🙂 ß"), (13, "rep eat " * 80), (14, passage), *extra,
    ]
    return [(d, t, None, "s", None if t is None else len(t), 5, 6, "s", "w", 0.5) for d, t in texts]


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return WORD.findall(text or "")


def dedup(rows, size=50):
    first = {}
    for d, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i:i + size])] < d:
                gone[i:i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows):
    """(doc_id, class_id, n_links) of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    shared = Counter((b, a) for found in where.values() for x, a in enumerate(found) for b in found[:x])
    parent, links = list(range(len(rows))), Counter()

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(rows[i][0])
    return [
        (rows[i][0], min((d for d in classes[root(i)] if d is not None), default=None) if sets[i] else rows[i][0], links[i])
        for i in range(len(rows))
    ]


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def bench_words(text):
    return BENCH.findall((text or "").translate(LOWER))


def contaminated(rows, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item)
    lengths = {len(k) for k in windows}
    out = []
    for d, text in rows:
        w = bench_words(text)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                key = tuple(w[i:i + n])
                if key in windows:
                    hit[i:i + n] = [True] * n
                    found |= {str(x) for x in windows[key] if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        n = sum(hit)
        out.append((d, len(w), n, len(found), digest, n > 0 and 20 * n >= len(w)))
    return out


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    x = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(x) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 32]
    return sorted(found)


def secrets(rows):
    out = []
    for d, text in rows:
        found = base_spans(text)
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
        out.append((d, *(sum(f[1] == i for f in found) for i in range(3)), hashlib.sha256(said.encode()).hexdigest()))
    return out


def packed(pieces, ids_of, length=1024):
    """Check pieces (doc_id, piece, start, length, crc, sequence, offset) of documents with distinct ids; the number of sequences."""
    import zlib

    import numpy as np

    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for d, piece, start, size, crc, sequence, offset in pieces:
        by_doc[d].append((piece, start, size, crc))
        by_sequence[sequence].append((offset, size))
    assert set(by_doc) == set(ids_of)
    for d, ids in ids_of.items():
        at = 0
        for k, (piece, start, size, crc) in enumerate(sorted(by_doc[d])):
            assert (piece, start) == (k, at) and (size == length or k == 0) and size > 0
            assert crc == zlib.crc32(np.array(ids[start:start + size], "<u4").tobytes())
            at += size
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return len(by_sequence)


def by_text(rows):
    return sorted(rows, key=str)
