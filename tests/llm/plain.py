"""Near-duplicates one pair at a time."""

from __future__ import annotations

import itertools

import xxhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint). The smallest id that each reaches."""
    group = {f: f for _, f in rows}

    def top(f):
        while group[f] != f:
            f = group[f]
        return f

    for a, b in itertools.combinations(sorted(group), 2):
        if (a ^ b).bit_count() <= 3:
            group[top(b)] = top(a)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    return [least.get(top(f)) for _, f in rows]
