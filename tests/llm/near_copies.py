"""Plain loop for near copies, shared by tests."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def jaccard(rows):
    """doc_id → (class, links), by the definition; rows under one id are one node."""
    texts = {r[0]: r[1] or "" for r in rows}
    count = Counter(r[0] for r in rows)
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = {
        i: [j for j in texts if j != i and (texts[i] == texts[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0)] for i in texts
    }
    out = {}
    for i in texts:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := [j for j in near[todo.pop()] if j not in seen])
            seen.update(new)
        out[i] = (min(seen), sum(count[j] for j in near[i]) + count[i] - 1)
    return out
