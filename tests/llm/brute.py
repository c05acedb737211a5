"""Plain versions of what the operators do, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, n=5):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, similarity=85):
    """doc_id to the least id that links reach."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in sets:
        for b, r in sets:
            if s and r and 100 * len(s & r) >= similarity * len(s | r):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in up}


def exact(rows):
    """doc_id to (keep_id, group size)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def repeated(rows, length):
    """(id, bytes, removed, runs, digest of the rest) of each row, in order."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        rest = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        runs = sum(mask[k] and not (k and mask[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(mask), runs, hashlib.sha256(rest).hexdigest()))
    return out


def base_scores(rows):
    """doc_id to (tokens, known, N, base score)."""
    import math

    tokens = {i: [*WORD.findall(lower(t or "")), None] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in train for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    return {i: (len(t), sum(w in counts for w in t), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens.items()}


def base_spans(text):
    found = [(m.start(), "assign", m.end()) for m in re.finditer(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 12]
    found += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


def word_pairs(text):
    """(word before, word) of a text, an end as None."""
    words = [None, *WORD.findall(lower(text or "")), None]
    return list(zip(words[:-1], words[1:], strict=True))


def pitman_yor(rows, counts, discount, strength, sweeps, burn_in, seed=1):
    """doc_id to the log10 probability of its text: two levels of restaurants, every customer taken away and seated anew in each sweep.

    counts: training counts of (word before, word). Probabilities are averaged over sweeps before logarithms are taken.
    """
    import math
    import random

    rng = random.Random(seed)
    leaf, root = defaultdict(lambda: defaultdict(list)), defaultdict(list)  # sizes of tables
    floor = 1 / (len({w for _, w in counts}) + 1)

    def root_p(w):
        tables = sum(map(len, root.values()))
        customers = sum(map(sum, root.values()))
        return (sum(root[w]) - discount[0] * len(root[w]) + (strength[0] + discount[0] * tables) * floor) / (strength[0] + customers)

    def seat(sizes, fresh, d):
        spot = rng.random() * (fresh + sum(sizes) - d * len(sizes))
        for k, size in enumerate(sizes):
            spot -= size - d
            if spot < 0:
                sizes[k] += 1
                return False
        sizes.append(1)
        return True

    def leave(sizes):
        spot = rng.randrange(sum(sizes))
        for k, size in enumerate(sizes):
            spot -= size
            if spot < 0:
                sizes[k] -= 1
                if not sizes[k]:
                    del sizes[k]
                    return True
                return False

    def sit(u, w):
        fresh = (strength[1] + discount[1] * sum(map(len, leaf[u].values()))) * root_p(w)
        if seat(leaf[u][w], fresh, discount[1]):
            seat(root[w], (strength[0] + discount[0] * sum(map(len, root.values()))) * floor, discount[0])

    customers = [k for k, n in counts.items() for _ in range(n)]
    rng.shuffle(customers)
    for u, w in customers:
        sit(u, w)
    asked = {p for _, t in rows for p in word_pairs(t)}
    total = Counter()
    for turn in range(sweeps):
        for u, w in customers:
            if leave(leaf[u][w]):
                leave(root[w])
            sit(u, w)
        if turn >= burn_in:
            for u, w in asked:
                tables, own = sum(map(len, leaf[u].values())), leaf[u][w]
                total[u, w] += (sum(own) - discount[1] * len(own) + (strength[1] + discount[1] * tables) * root_p(w)) / (strength[1] + sum(map(sum, leaf[u].values())))
    log_p = {k: math.log10(v / (sweeps - burn_in)) for k, v in total.items()}
    return {i: sum(log_p[p] for p in word_pairs(t)) for i, t in rows}
