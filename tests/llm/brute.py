"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def tokens(text, file: str, end: int) -> list[int]:
    import public_tokenizers
    from tokenizers import Tokenizer

    if file not in tokens.known:
        tokens.known[file] = Tokenizer.from_file(public_tokenizers.path(file))
    return [*tokens.known[file].encode(text or "", add_special_tokens=False).ids, end]


tokens.known = {}


def find(parent: dict, x):
    while parent[x] != x:
        x = parent[x]
    return x


def join(parent: dict, x, y) -> None:
    a, b = find(parent, x), find(parent, y)
    parent[max(a, b)] = min(a, b)


def shingles(text) -> set:
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def near_dups(docs: list[tuple]) -> list[tuple]:
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    join(parent, a, b)
    return sorted((i, len(sets[i]), find(parent, i), find(parent, i) == i) for i in ids)


def repeats(docs: list[tuple], window: int = 35) -> list[tuple]:
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def secrets(text) -> tuple:
    spans, counts = [], []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        own = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
        counts.append(len(own))
        spans += own
    return (*counts, sha(",".join(x[2] for x in sorted(spans))))


def distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]
