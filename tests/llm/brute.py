"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib


def exact(rows):
    """rows: (doc_id, text) -> doc_id: (keep_id, size, kept, sha)."""
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    return {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm}


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(rows):
    """doc_id: (n_shingles, component_id), by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            small, big = sorted((len(a), len(b)))
            if small and 100 * small >= 75 * big and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def contamination(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                at = windows.get(tuple(w[i:i + n]))
                if at:
                    hit.update(range(i, i + n))
                    found |= at
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out


def crc_of_ids(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
