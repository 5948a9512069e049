"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import xxhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def simhash(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[k:k + 3]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    """items: (name, value); name of the smallest member of each item's group."""
    root = list(range(len(items)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(items)):
        for b in range(a):
            if linked(items[a][1], items[b][1]):
                x, y = find(a), find(b)
                if items[x][0] < items[y][0]:
                    x, y = y, x
                root[x] = y
    return [items[find(k)][0] for k in range(len(items))]


def near(a, b):
    return bin(a ^ b).count("1") <= 3


def repeats(rows, length=50):
    """(id, bytes, removed, runs, hash, kept) of rows (id, text)."""
    first = {}
    for k, t in sorted(((k, (t or "").encode()) for k, t in rows if k is not None), key=lambda r: r[0]):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i:i + length], k)
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone, last = [False] * len(b), -1
        for i in range(len(b) - length + 1 if k is not None else 0):
            if first[b[i:i + length]] < k:
                for j in range(max(i, last + 1), i + length):
                    gone[j] = True
                last = i + length - 1
        kept = bytes(c for c, x in zip(b, gone) if not x)
        out.append((k, len(b), sum(gone), sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest(), kept))
    return out
