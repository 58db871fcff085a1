"""The contracts of the queries in plain Python, on whole tables of a small size."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def span_text(spans, kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, kinds.index(k), k, b) for k, a, b in spans))


def secrets(text):
    out = [
        ("assign", *m.span())
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A)
        if len(m[2]) >= 6
    ]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [
        ("ip", *m.span())
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(p) <= 255 for p in m[0].split("."))
    ]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [
        ("phone", *m.span())
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15
    ]
    return out


def quality(text):
    words = WORD.findall(text)
    triples = list(zip(words, words[1:], words[2:]))
    seen = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if seen[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def chat(turns):
    """turns: (conv_id, turn, role, text) rows -> {conv_id: (n, turns_sha, loss_chars, loss_sha)}."""
    groups = defaultdict(list)
    for c, t, role, text in turns:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, rows in groups.items():
        rows.sort()
        loss = "".join(x[3] for x in rows if x[2] == "assistant")
        out[c] = (len(rows), sha("".join(f"{x[2]}\n{x[3]}\n" for x in rows)), len(loss), sha(loss))
    return out


def substrings(docs, n=13):
    """docs: (doc_id, text) -> {doc_id: (n_words, n_removed, kept_sha)}."""
    first = {}
    split = {d: WORD.findall(t or "") for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(zip(words, words[1:], words[2:])) if len(words) >= 3 else frozenset([tuple(words)])


def jaccard_components(docs, num=90):
    """docs: (doc_id, text) -> {doc_id: (n_shingles, component_id)}; pairs are compared all with all."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_size = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(by_size):
        for b in by_size[i + 1 :]:
            if 100 * len(sets[a]) < num * len(sets[b]):
                break
            if find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def minimax(sizes: list[int], shards: int) -> int:
    """The smallest capacity, by trying the sums of all runs."""

    def needed(capacity):
        used, room = 0, 0
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if needed(middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low
