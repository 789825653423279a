"""Plain versions of the operators, for comparison."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACED = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def dedup_words(docs, window):
    words = [(i, re.findall(SPACED, t or "")) for i, t in docs]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def dedup_bytes(docs, window):
    seen, out = set(), {}
    for i, t in sorted(docs):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - window + 1):
            if data[k : k + window] in seen:
                gone[k : k + window] = True
            else:
                seen.add(data[k : k + window])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def contamination(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    owners = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[k : k + window])].add(str(i))
    sizes, out = {len(w) for w in owners}, {}
    for i, t in docs:
        w = words(t)
        hit, names = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := owners.get(tuple(w[k : k + n])):
                    names |= found
                    hit[k : k + n] = [True] * n
        n = sum(hit)
        out[i] = (len(w), n, len(names), sha(",".join(sorted(names)).encode()), n > 0 and 20 * n >= len(w))
    return out


def bigram_scores(docs, train, mu):
    tokens = [(i, re.findall(SPACED, lower(t)) + ["\n"]) for i, t in docs]
    learned = [w for i, w in tokens if train(i)]
    count = Counter(x for w in learned for x in w)
    pairs = Counter(p for w in learned for p in zip(["\0", *w], w))
    before = Counter(p for w in learned for p in ["\0", *w[:-1]])
    n, v = sum(count.values()), len(count)
    p1 = lambda x: (count[x] + 1) / (n + v + 1)
    return {
        i: (
            len(w), sum(count[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w),
            sum(math.log10((pairs[a, b] + mu * p1(b)) / (before[a] + mu)) for a, b in zip(["\0", *w], w)),
        )
        for i, w in tokens
    }


def jaccard(a, b):
    """Plain Jaccard similarity of the five-word shingles of two texts."""
    sets = []
    for t in (a, b):
        w = lower(t).split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n
