"""Plain versions of the operators' results, one document at a time, to test against."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def simhash(text: str | None, shingle: int = 4) -> int:
    own = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not own:
        return 0
    spans = [own[i:i + shingle] for i in range(max(1, len(own) - shingle + 1))]
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list, fps: list[int], most: int = 4) -> dict[int, object]:
    """Least id (nulls last) of each fingerprint's component."""
    kinds = sorted(set(fps))
    root = {f: f for f in kinds}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for i, a in enumerate(kinds):
        for b in kinds[i + 1:]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    least: dict[int, object] = {}
    for i, f in zip(ids, fps):
        r = find(f)
        if r not in least or least[r] is None or (i is not None and i < least[r]):
            least[r] = i
    return {f: least[find(f)] for f in kinds}


def normal(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def sha256(text: str | None) -> str:
    return hashlib.sha256(normal(text).encode()).hexdigest()


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = [tuple(own[i:i + 3]) for i in range(len(own) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def shard(doc_id, weights: list[float]) -> int:
    def score(i: int) -> float:
        bits = int(hashlib.md5(f"{'null' if doc_id is None else doc_id}:{i}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2.0 ** 52) / weights[i]
    return min(range(len(weights)), key=lambda i: (score(i), i))


def targets(sizes: dict, weights=(3, 1, 2), ratio: float = 1.5, most: float = 2) -> dict:
    """By bisection of the level at which weight * level, cut at ``most`` sizes, sums to the budget."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, low, high = ratio * sum(sizes.values()), 0.0, 1e18
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(weight[s] * level, most * sizes[s]) for s in order) < budget:
            low = level
        else:
            high = level
    return {s: min(weight[s] * high, most * sizes[s]) for s in order}


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _proved(leaves: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """Root, and per leaf the siblings left and right of its ancestors, upwards."""
    paths, nodes, level = [[] for _ in leaves], leaves, 0
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            at = i // 16 ** level
            run = nodes[at // 16 * 16:][:16]
            path.append((run[:at % 16], run[at % 16 + 1:]))
        nodes, level = [_h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)], level + 1
    return nodes[0], paths


def merkle(rows: list[tuple], tampers) -> list[tuple]:
    """(id, leaf, subroot, root, proof digest, folded root, verified) of rows (id, text, lang, source, n_chars)."""
    def leaf(doc_id, text, lang, source, n_chars):
        return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])

    def lowered(text):
        return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
    sources: dict = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), leaf(r[0], lowered(r[1]), *r[2:])))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _proved([x[2] for x in sorted(sources[s])]) for s in order}
    root, top = _proved([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, top):
        for (known, doc_id, own, low), path in zip(sorted(sources[s]), trees[s][1]):
            now = low if tampers(doc_id if known else None) else own
            for left, right in path + above:
                now = _h(*left, now, *right)
            proof = _h(*[d for left, right in path + above for d in left + right])
            out.append((doc_id if known else None, own, trees[s][0], root, proof, now, now == root))
    return out


def lower_words(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(words: list, items: dict, size: int) -> tuple[set[int], set]:
    """Places of ``words`` inside an occurrence of a window of an item, and the items with one."""
    hit, found = set(), set()
    for name, own in items.items():
        n = min(len(own), size)
        keys = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in keys:
                hit |= set(range(i, i + n))
                found.add(name)
    return hit, found


def search(docs: list[tuple], items: dict, k: int) -> list[tuple]:
    """(item, rank, id, score) of the k best documents of every item (a list of texts)."""
    def terms(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)
    counted = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, total = len(counted), sum(c for _, _, c in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, texts in items.items():
        scored = []
        for i, c, size in counted:
            m = 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m))
                        for w in {w for t in texts for w in terms(t)} if w in c)
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def cheapest_routes(patterns: list[tuple[tuple, int]], quotas: dict, most: int = 2) -> tuple[int, int]:
    """(most words routed, fewest repeated words) over all ways to give patterns' words to the quotas of their sources."""
    best = {tuple(quotas.values()): (0, 0)}
    names = list(quotas)
    for sources, size in patterns:
        ways = [{}]
        for s in sources:
            ways = [w | {s: k} for w in ways for k in range(min(quotas[s], most * size - sum(w.values())) + 1)]
        then: dict = {}
        for left, (sent, cost) in best.items():
            for w in ways:
                rest = tuple(x - w.get(s, 0) for s, x in zip(names, left))
                if min(rest) >= 0:
                    now = (sent + sum(w.values()), cost - max(0, sum(w.values()) - size))
                    then[rest] = max(then.get(rest, (-1, 0)), now)
        best = then
    sent, cost = max(best.values())
    return sent, -cost


def subword_buckets(word: str, sizes, bits: int) -> list[int]:
    """Buckets of a word and of its n-grams with one boundary on each side."""
    factor, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
    letters = [ord(c) for c in word]
    own = 0
    for i, c in enumerate(letters):
        x = (c + i * 0x1F123BB5) * factor & full
        own += (x ^ x >> 29) * 0xBF58476D1CE4E5B9
    out = [(own * factor & full) >> 64 - bits]
    padded = [0, *letters, 0]
    for n in sizes:
        for i in range(len(padded) - n + 1):
            h = 0
            for c in padded[i:i + n]:
                h = h * factor + c
            out.append(((h ^ n) & full) * factor % (1 << 64) >> 64 - bits)
    return out
