"""The operators' results over a few rows, the plain way."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles(text, size=5):
    own = words((text or "").translate(LOWER))
    if not own:
        return set()
    return {tuple(own[i : i + size]) for i in range(max(len(own) - size + 1, 1))}


def jaccard_components(rows):
    """{index: least key of the component} for rows (key, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = {}
    for members in groups.values():
        keys = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = min(keys) if keys else None
    return [(rows[i][0], len(sets[i]), out[i] if sets[i] else rows[i][0]) for i in range(len(rows))]


def without_repeats(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def contamination(rows, items, size=10):
    """[(key, n_words, n_hit, n_items, sha256)] for rows (key, text) and items (id, text)."""
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = lambda t: pattern.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        own = cut(text)
        for i in range(max(len(own) - size + 1, 1) if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in rows:
        own, hit, names = cut(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(own[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((key, len(own), len(hit), len(names), digest))
    return out
