"""Plain loops that give the results the operators must give."""

import hashlib
import re
from collections import defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def line_dedup(docs):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for i, t in docs:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40:
                held[key(s)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (len(held[key(s)]) >= 5 and i != max(held[key(s)]))]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def secrets(docs):
    rules = [("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
             ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]
    out = {}
    for i, t in docs:
        found = [(m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(rules)
                 for m in re.finditer(p, t or "") if len(m.group(g)) >= least]
        text = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found))
        out[i] = (*(sum(x[1] == k for x in found) for k in range(3)), sha(text), text)
    return out


def jaccard(docs, n=3, percent=90):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    shared = defaultdict(int)
    for group in where.values():
        for a in range(len(group)):
            for b in range(a):
                shared[group[a], group[b]] += 1
    for (a, b), n_shared in shared.items():
        if 100 * n_shared >= percent * (len(sets[a]) + len(sets[b]) - n_shared):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contamination(docs, items, n=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        for j in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[j:j + n])].add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in docs:
        w = word.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[j:j + size]))) is not None:
                    hit.update(range(j, j + size))
                    found |= got
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))),
                  len(hit) > 0 and 20 * len(hit) >= len(w))
    return out
