"""Slow and plain versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """By source; shares again and again what goes beyond the caps."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, left, total = {}, set(order), float(sum(sizes.values()))
    while left:
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > most * sizes[s]}
        if not above:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in above}
        left -= above
    return capped


def removed(docs: list[tuple[int, str | None]], window: int = 100) -> dict:
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - window + 1):
            w = data[i : i + window]
            if w in seen:
                gone[i : i + window] = True
            else:
                seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1)
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out[doc] = (len(data), int(gone.sum()), len(edges), sha(kept))
    return out


def exact(docs: list[tuple[int, str | None]]) -> dict:
    groups = defaultdict(list)
    for doc, text in docs:
        groups[low(text or "")].append(doc)
    return {d: (max(g), len(g), d == max(g), sha(t)) for t, g in groups.items() for d in g}


def shingles(text: str | None, k: int) -> set:
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def roots(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def near(docs: list[tuple[int, str | None]], k: int = 2, percent: int = 80) -> dict:
    """doc_id -> (n_shingles, component): all pairs that share a shingle are compared."""
    sets = {d: shingles(t, k) for d, t in docs}
    links, holders = [], defaultdict(list)
    for d, s in sets.items():
        common = Counter(o for x in s for o in holders[x])
        for o, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[o]) - c):
                links.append((d, o))
        for x in s:
            holders[x].append(d)
    root = roots(sets, links)
    return {d: (len(s), root[d]) for d, s in sets.items()}


def cosines(vectors: list[tuple[int, list | None]], least: float = 0.95) -> dict:
    """vec_id -> (n_links, component)."""
    good = [(v, np.array(e, float)) for v, e in vectors if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = []
    for length in {len(e) for _, e in good}:
        own = [(v, e / np.abs(e).max()) for v, e in good if len(e) == length]
        x = np.stack([e / np.sqrt((e * e).sum()) for _, e in own])
        i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
        links += [(own[a][0], own[b][0]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    n = Counter(v for pair in links for v in pair)
    root = roots([v for v, _ in vectors], links)
    return {v: (n[v], root[v]) for v, _ in vectors}


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_secrets(text: str | None) -> list[tuple[int, str, int]]:
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(a, k, b) for a, _, k, b in sorted(out)]


def secret_verdicts(rows: list[tuple]) -> list[tuple[str, str]]:
    """(spans, verdicts) of rows (text, repository, owner): every value is counted over all rows."""
    owners, repositories, each = defaultdict(set), defaultdict(set), []
    for text, repository, owner in rows:
        t, base = text or "", base_secrets(text)
        own = [(a, ("assign", "access", "hex").index(k), b, ASSIGN.match(t, a, b)[2] if k == "assign" else t[a:b]) for a, k, b in base]
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            share = [c / len(m[0]) for c in Counter(m[0]).values()]
            if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and sum(-p * np.log2(p) for p in share) >= 3.2:
                own.append((m.start(), 4 if any(a < m.end() and b > m.start() for a, _, b in base) else 3, m.end(), m[0]))
        for *_, v in own:
            owners[v].add(owner or "")
            repositories[v].add((owner or "", repository))
        each.append(sorted(own))
    out = []
    for own in each:
        said = [(f"{('assign', 'access', 'hex', 'token')[k]}:{a}:{b}", k, len(owners[v]) > 1 or len(repositories[v]) > 10) for a, k, b, v in own if k < 4]
        out.append((",".join(x for x, k, copied in said if k < 3 or not copied), ",".join(f"{x}:{'copied' if copied else 'live'}" for x, _, copied in said)))
    return out


def url_parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return low(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(host: str, path: str, rules: list[tuple[str, str]]) -> str | None:
    fits = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len) if fits else None


def walked(forest, x: list[float]) -> float:
    """Score of one row, node by node."""
    total, inner = forest.base, forest.feature.shape[1] if len(forest.feature) else 0
    for t in range(len(forest.feature)):
        node = 0
        while node < inner:
            node = 2 * node + (2 if x[forest.feature[t, node]] > forest.cut[t, node] else 1)
        total += forest.value[t, node - inner]
    return 1 / (1 + float(np.exp(-total)))


def chats(rows: list[tuple]) -> dict:
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256) of rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out
