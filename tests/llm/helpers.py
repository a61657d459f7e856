"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

SEP = re.compile(rb"[\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shingles(text):
    w = plain_words(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def near_duplicates(rows):
    sets = {i: shingles(t) for i, t in rows}
    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    common = Counter()
    for ids in index.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def decontaminate(rows, items, window=10):
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = sorted({len(k) for k in windows})
    out = []
    for i, text in rows:
        w, hit, found = alnum_words(text), set(), set()
        for size in sizes:
            for at in range(len(w) - size + 1):
                ids = windows.get(tuple(w[at : at + size]))
                if ids:
                    hit |= set(range(at, at + size))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out
