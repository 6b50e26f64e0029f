"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def op1(docs, items, size=13):
    wins = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for a in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[a : a + size]), set()).add(str(i))
    lengths = {len(x) for x in wins}
    for d, t in docs:
        w, hit, found = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in wins:
                    hit.update(range(a, a + n))
                    found |= wins[x]
        yield d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)


def op4(docs):
    for d, t in docs:
        t, found = t or "", []
        for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            if len(m[2]) >= 12:
                found.append((m.start(), 0, "assign", m.end()))
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        found.sort()
        n = Counter(x[2] for x in found)
        yield d, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{z}" for a, _, k, z in found))


def op6(docs, size=4):
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = frozenset({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    for d in ids:
        yield d, len(sets[d]), find(d), find(d) == d


def op8(docs, size=35):
    seen, words = Counter(), []
    for d, t in docs:
        w = WORD.findall(t or "")
        words.append((d, w))
        seen.update(tuple(w[a : a + size]) for a in range(len(w) - size + 1))
    for d, w in words:
        gone = set()
        for a in range(len(w) - size + 1):
            if seen[tuple(w[a : a + size])] > 1:
                gone.update(range(a, a + size))
        yield d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def op9(docs, path):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(path), 0
    for d, t in sorted(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        yield d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)
