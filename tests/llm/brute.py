"""Plain Python versions of the query contracts, one document at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "base_failed": n < 50 or 100 * len(covered) > 50 * n}


def crc_ids(ids):
    raw = array("I", ids)
    return zlib.crc32(raw.tobytes())


def repeats(texts, width=35):
    """Per text: (words, positions covered by a window that starts elsewhere too)."""
    words = [WORD.findall(t or "") for t in texts]
    where = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        covered = set()
        for i in range(len(w) - width + 1):
            if where[tuple(w[i:i + width])] > 1:
                covered.update(range(i, i + width))
        out.append((w, covered))
    return out


def repeats_digest(texts, width=35):
    out = []
    for words, covered in repeats(texts, width):
        kept = " ".join(w for i, w in enumerate(words) if i not in covered)
        out.append((len(words), len(covered), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, width=5):
    words = WORD.findall(fold(text))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def components(ids, sets, percent=80):
    """Smallest id reachable over links with 100 |A & B| >= percent |A | B|."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, s in enumerate(sets):
        both = Counter(j for x in s for j in where[x] if j < k)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return [least[find(k)] for k in range(len(ids))]


def benchmark_hits(texts, items, width=10):
    """Per text: (n_words, n_hit, sorted item ids as strings)."""
    by = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(fold(text))
        size = min(width, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by[tuple(words[i:i + size])].add(str(item))
    sizes = {len(k) for k in by}
    out = []
    for text in texts:
        words = ALNUM.findall(fold(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if ids := by.get(tuple(words[i:i + size])):
                    hit.update(range(i, i + size))
                    found |= ids
        out.append((len(words), len(hit), sorted(found)))
    return out


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
           "mit license": "mit"}


def licences(text):
    words = ALNUM.findall(fold(text))
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
            "last_word": max(starts, default=None), "base_labels": ",".join(sorted(labels))}
