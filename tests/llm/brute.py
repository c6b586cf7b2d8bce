"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

KIND = ("assign", "access", "hex")


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """For each fingerprint in a list the first place of its component."""
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination(text, items):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        theirs = words(item)
        windows = {tuple(theirs[i : i + 13]) for i in range(max(1, len(theirs) - 12))} if theirs else set()
        for w in windows:
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add("" if name is None else str(name))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(own)


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(spans)


def digest(spans):
    return hashlib.sha256(",".join(f"{KIND[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def neighbours(rows, k=5):
    """(query_id, rank, vec_id, score) over usable rows (id, vector)."""
    out = []
    for q, (i, v) in enumerate(rows):
        if i % 50:
            continue
        v = np.array(v, float)
        scored = []
        for c, (j, u) in enumerate(rows):
            if c != q:
                u = np.array(u, float)
                scored.append((-(v @ u) / (np.sqrt(v @ v) * np.sqrt(u @ u)), j))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scored)[:k])]
    return out


def edge_texts():
    """Null, empty, no words, one word, long, marks, other scripts, repeats."""
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "Word"), (4, "one two"), (5, "a b c " * 3000), (6, "a b c " * 3000),
        (7, "Zürich straße ÄÖÜ İstanbul"), (8, "日本語 テキスト。 東京"), (9, "x" * 30_000), (10, "tab\tand\nline\r\nends  double"), (11, "!!! ??? ..."),
        (12, "same text here twice"), (12, "same text here twice"), (None, "no id at all"), (13, "<|endoftext|> it's  odd \x1c sep"),
    ]
