"""Plain forms of the contracts, row by row, for the tests."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np


def rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def ids(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def shingles(t, size=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    lists = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            lists[g].append(i)
    for i, (_, s) in enumerate(sets):
        for j in {j for g in s for j in lists[g] if j < i}:
            both = len(s & sets[j][1])
            if 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)]


def contamination(docs, items, size=13):
    cut = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            wins[tuple(w[k:k + size])].add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k:k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[g]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


SECRET = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
          "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def secrets(t):
    out = []
    for k, rule in SECRET.items():
        for m in rule.finditer(t):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[k]():
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(SECRET).index(s[0])))


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii(t):
    def valid(k, m):
        g = re.sub("[^0-9]", "", m)
        if k == "card":
            v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(g))]
            return 13 <= len(g) <= 19 and sum(x - 9 if x > 9 else x for x in v) % 10 == 0
        return all(int(p) <= 255 for p in m.split(".")) if k == "ip" else 9 <= len(g) <= 15 if k == "phone" else True
    return [(k, m.start(), m.end()) for k, rule in PII.items() for m in re.finditer(rule, t) if valid(k, m[0])]


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()
