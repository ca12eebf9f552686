"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().lower().split()


def quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    cover = {i + d for v in windows.values() if len(v) > 1 for i in v for d in range(3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(cover)


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def base_spans(t):
    t, out = t or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 13 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(digits(m)) <= 15:
            out.append(("phone", m.start(), m.end()))
    return [f"{k}:{a}:{b}" for k, a, b in out]


def passages(texts):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of what is left)."""
    seen, out = set(), {}
    for d, t in sorted(texts.items()):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), []
        for i in range(len(b) - 49):
            own.append(b[i : i + 50])
            if own[-1] in seen:
                gone[i : i + 50] = b"\1" * 50
        seen.update(own)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()
    return out


def joined(rows, width=3, percent=90):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text); every pair that shares a shingle is counted."""
    sets = [frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]) for _, t in rows for w in [words(t)]]
    parent, held = list(range(len(rows))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in held[x])
        for x in s:
            held[x].append(i)
        for j, k in both.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root of digests, and for each the steps (letter, sibling) to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            other = at[i] ^ 1
            path.append(("L" if other < at[i] else "R", nodes[other]) if other < len(nodes) else ("-", ""))
            at[i] //= 2
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0], paths


def manifest(rows):
    """op13's rows of (doc_id, source, lang, n_chars, text)."""
    leaf = lambda *values: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = [tree([leaf(*r) for r in by[x]]) for x in langs]
    root, tops = tree([t[0] for t in trees]) if trees else ("", [])
    out = []
    for x, (subroot, paths), top in zip(langs, trees, tops, strict=True):
        for r, path in zip(by[x], paths, strict=True):
            bent = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(*r[:3], r[3] + 1, r[4]) if bent else leaf(*r)
            for side, other in path + top:
                now = h(other, now) if side == "L" else h(now, other)
            out.append((r[0], leaf(*r), subroot, root, h(*(o for _, o in path + top)), now, now == root))
    return out


def clusters(rows, count=16, rounds=3, dims=64, scale=64):
    """op11's rows of (vec_id, vector), in Python's integers."""
    whole = lambda x: (lambda n, d: n * scale // d)(*float(x).as_integer_ratio())
    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted((h(f"1:{i}"), v) for i, v in kept if i is not None)[:count]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, k, strict=True)), j) for j, k in enumerate(c))
    for _ in range(rounds if c else 0):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for j, vs in own.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    most = 2**63 - 1
    made = [(i, j, min(d, most)) for i, v in (kept if c else []) for d, j in [near(v)]]
    total = Counter()
    for _, j, d in made:
        total[j] += d
    return [(i, j, d, min(total[j], most), min(total.total(), most), h(",".join(map(str, c[j])))) for i, j, d in made]


def near(texts, width):
    """doc_id -> (n_shingles, component_id)."""
    sets = {d: frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]) for d, t in texts.items() for w in [words(t)]}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


def unigrams(texts):
    """doc_id -> (held_out, n_tokens, n_known, base_score); and the number of training tokens."""
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    tokens = {d: [*words(t), b""] for d, t in texts.items()}
    c = Counter(w for d in texts if not held[d] for w in tokens[d])
    floor = c.total() + 0.1 * (len(c) + 1)
    return {d: (held[d], len(ts), sum(c[w] > 0 for w in ts), sum(math.log10((c[w] + 0.1) / floor) for w in ts)) for d, ts in tokens.items()}, c.total()
