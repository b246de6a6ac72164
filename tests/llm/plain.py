"""The contracts of the corpus operators in plain Python, and documents with every awkward case."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def words(text):
    return WORD.findall(text or "")


def statistics(text):
    found, lines, repeats = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeats += line in lines
            lines.add(line)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    n = len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered)
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def without_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    often = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size):
    found = words((text or "").translate(CAPITALS))
    if len(found) < size:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def components(docs, size, percent):
    """doc_id -> (number of shingles, smallest linked doc_id)."""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            valid = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if valid:
                out.append((kind, m.start(), m.end()))
    return out


def random_texts(r, n):
    """Texts of a small vocabulary, some of them near copies of others, some repeating themselves."""
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "x", "of", "the", "###", "|", "Über", "🙂", "end."]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.4:
            found = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                found[r.randrange(len(found))] = r.choice(vocabulary) + str(r.randrange(5))
            texts.append(" ".join(found))
        elif kind < 0.5:
            line = " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 14)))
            texts.append("\n".join([line] * r.randrange(1, 6)))
        else:
            texts.append(" ".join(r.choice(vocabulary) + (str(r.randrange(40)) if r.random() < 0.8 else "") for _ in range(r.randrange(1, 160))))
    return texts


def grouped(rows, key):
    out = defaultdict(list)
    for row in rows:
        out[row[key]].append(row)
    return out
