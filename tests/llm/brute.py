"""Plain Python versions of the operators, written from their contracts."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE_PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, m.end(), kind))
    return sorted(found)


def base_row(text):
    spans = base_spans(text)
    shown = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    counts = [sum(s[3] == kind for s in spans) for kind in BASE_PATTERNS]
    return (*counts, hashlib.sha256(shown.encode()).hexdigest())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(prints):
    """``{doc_id: component}`` from ``{doc_id: fingerprint}``."""
    codes = np.array(sorted(set(prints.values())), np.uint64)
    links = []
    for i, c in enumerate(codes):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ c) <= 2):
            links.append((int(c), int(codes[i + 1 + j])))
    of = components([int(c) for c in codes], links)
    least = defaultdict(lambda: float("inf"))
    for d, f in prints.items():
        least[of[f]] = min(least[of[f]], d)
    return {d: least[of[f]] for d, f in prints.items()}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(documents, benchmark, window=10):
    """Rows ``(doc_id, n_words, n_hit, items)``."""
    places = defaultdict(set)
    for item, text in benchmark:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            places[tuple(w[i : i + m])].add(str(item))
    lengths = {len(k) for k in places}
    rows = []
    for doc, text in documents:
        w = words(text)
        hit, items = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                of = places.get(tuple(w[i : i + m]))
                if of:
                    hit.update(range(i, i + m))
                    items |= of
        rows.append((doc, len(w), len(hit), ",".join(sorted(items))))
    return rows


def best_split(word, scores, lowest):
    """Fewest tokens among the splits of the highest score, over all splits."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(
            max(
                (best[a][0] + scores.get(word[a:end], lowest if end - a == 1 else -1e18), best[a][1] - 1)
                for a in range(end)
            )
        )
    return -best[-1][1]
