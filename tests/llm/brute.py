"""Plain, row-at-a-time versions of the operators' results, for small tables."""

import hashlib
import re
import zlib
from base64 import b32encode
from collections import defaultdict


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near(rows, percent=85):
    """rows: (doc_id, text) with distinct ids. {doc_id: (n_shingles, component_id, kept)}"""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def crc(t):
    return zlib.crc32((t or "").encode())


def hits(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w:
            n = min(size, len(w))
            for k in range(len(w) - n + 1):
                wins[tuple(w[k : k + n])].add(i)
    sizes = {len(w) for w in wins}
    out = {}
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[x]
        ids = sorted(map(str, found))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def near_misses(docs, items, size=10, rarest=3, slop=2):
    """{doc_id: places where a window's rarest words stand near their places but the window is not exact}"""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    texts = {i: words(t) for i, t in docs}
    freq = defaultdict(int)
    for w in texts.values():
        for x in w:
            freq[x] += 1
    wins = set()
    for _, t in items:
        w = words(t)
        n = min(size, len(w))
        wins |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    out = dict.fromkeys(texts, 0)
    for win in wins:
        if not all(x in freq for x in win):
            continue
        rank = sorted(range(len(win)), key=lambda o: (freq[win[o]], o))[:rarest]
        for i, w in texts.items():
            for p in range(len(w)):
                s = p - rank[0]
                if w[p] == win[rank[0]] and all(win[o] in w[max(0, s + o - slop) : max(0, s + o + slop + 1)] for o in rank[1:]):
                    out[i] += s < 0 or tuple(w[s : s + len(win)]) != win
    return out


def joined(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]))))


def secrets(t):
    t = t or ""
    out = []
    key = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return out


def luhn(d):
    t = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def personal(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def captures(pages, least=0):
    by = defaultdict(list)
    for i, h in pages:
        by[h or ""].append(i)
    out = {}
    for i, h in pages:
        b = (h or "").encode()
        top = max(by[h or ""])
        again = len(b) >= least and i != top
        out[i] = (len(b), b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None)
    return out


def same_texts(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    by = defaultdict(list)
    for i, t in norm.items():
        by[t].append(i)
    return {i: (min(by[t]), len(by[t]), i == min(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
