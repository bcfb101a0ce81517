"""Plain Python versions of the queries, row at a time, for tests."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def mix_targets(rows, share=1.5, limit=2.0, weights=(5, 2, 1)):
    """{source: (size, target)} by repeated resharing."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if limit * sizes[s] < level * w[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        for s in full:
            target[s] = limit * sizes[s]
            rest -= target[s]
        open_ -= full
    return {s: (sizes[s], target[s]) for s in order}


def chat(rows):
    """Digests of op3 for [(role, text)] in order."""
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def pii(text):
    """Counts by kind and the digest of base spans."""
    spans = []
    for kind, (pattern, ok) in BASE.items():
        spans += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if ok(m.group())]
    counts = Counter(s[0] for s in spans)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return [counts[k] for k in BASE], joined, hashlib.sha256(joined.encode()).hexdigest()


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard_components(rows):
    """{doc_id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def jaccard_links(rows):
    """(doc_id, least id of an equal set, number of other rows linked) by comparing all pairs of rows."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    out = []
    for k, (i, s) in enumerate(sets):
        near = [100 * len(s & t) >= 80 * len(s | t) for j, (_, t) in enumerate(sets) if j != k and s and t]
        equal = [j for j, t in sets if t == s and j is not None] if s else [i]
        out.append((i, min(equal), sum(near)))
    return out


def unigram(rows):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    toks = {i: [*words((t or "").translate(LOWER)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks.items()}


def fair_queue(rows, targets, share=1.5, limit=2):
    """[(id, size, copies)] of one queue over all copies of (key, id, size, source), shuffled by their keys as
    unsigned numbers: a copy's finish time is the
    words of its source up to and with it by the target; the queue is cut where half of a copy passes the budget."""
    shuffled = lambda r: (r[0] % 2**64, r[1] is not None, r[1] or 0, r[2])
    budget = share * sum(size for size, _ in targets.values())
    upto, queue = Counter(), []
    for key, i, size, source in sorted(rows, key=shuffled):
        upto[source] += size
        total, target = targets[source]
        if size > 0 and target > 0:
            queue += [((p * total + upto[source]) / target, key, i is not None, i or 0, size) for p in range(limit)]
    queue.sort()
    whole, last = 0, None
    for c in queue:
        whole += c[4]
        if whole - c[4] / 2 <= budget:
            last = c[:4]
    got, upto = [], Counter()
    for key, i, size, source in sorted(rows, key=shuffled):
        upto[source] += size
        total, target = targets[source]
        times = [(p * total + upto[source]) / target for p in range(limit)] if size > 0 and target > 0 else []
        got.append((str(i), size, sum(last is not None and (t, key, i is not None, i or 0) <= last for t in times)))
    return sorted(got)


class KneserNey:
    """An interpolated modified Kneser-Ney model of three words, from its textbook definition."""

    def __init__(self, texts):
        seqs = [["<s>", "<s>", *t, "</s>"] for t in texts]
        self.counts = [Counter(), Counter(), Counter()]
        self.counts[2].update(tuple(s[i - 2 : i + 1]) for s in seqs for i in range(2, len(s)))
        self.counts[1].update(x[1:] for x in self.counts[2])  # once for each different word before
        self.counts[0].update(x[1:] for x in self.counts[1])
        self.discounts, self.by = [], []
        for c in self.counts:
            n = [max(1, sum(v == k for v in c.values())) for k in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1])
            self.discounts.append([min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)])
            by = {}
            for x, v in c.items():
                by.setdefault(x[:-1], []).append(v)
            self.by.append(by)

    def p(self, words):
        level = len(words) - 1
        c, d, by = self.counts[level], self.discounts[level], self.by[level]
        own = by.get(words[:-1])
        lower = self.p(words[1:]) if level else 1 / (len(c) + 1)
        if not own:
            return lower
        cut = lambda v: d[min(v, 3) - 1]
        v = c.get(words, 0)
        return ((v - cut(v)) if v else 0) / sum(own) + sum(map(cut, own)) / sum(own) * lower

    def log10(self, text):
        s = ["<s>", "<s>", *text, "</s>"]
        return sum(math.log10(self.p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s)))


def best_edits(pattern, text):
    """The fewest edits between a pattern and any part of a text, by the whole table."""
    import numpy as np

    t = np.frombuffer(text, np.uint8).astype(np.int32)
    row, place = np.zeros(len(t) + 1, np.int32), np.arange(len(t) + 1, dtype=np.int32)
    for c in pattern:
        step = np.empty_like(row)
        step[0] = row[0] + 1
        step[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        row = np.minimum.accumulate(step - place) + place
    return int(row.min())


def exact(rows):
    """op11 for [(doc_id, text)]: sorted (doc_id, keep_id, group_size, kept, sha), for distinct ids."""
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, first[t], len(groups[t]), i == first[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm]


def runs(text, orders=3):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def resample(rows, target, percent=5, min_words=20):
    """op12 for [(doc_id, text)] and texts: {doc_id: (n_features, weight, score, rank)}."""
    own, other = Counter(), Counter()
    found = {i: runs(t) for i, t in rows}
    for _, f in found.values():
        own.update(f)
    for t in target:
        other.update(runs(t)[1])
    s, t = sum(own.values()), sum(other.values())
    gain = [math.floor(1000 * math.log((other[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = {}
    for i, (n, f) in found.items():
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i, (n, _) in found.items() if n >= min_words), key=lambda i: (-out[i][2], i is None, i or 0))
    for rank, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(x) for i, x in out.items()}


def trie(conversations):
    """op13's nodes for {conv_id: [(role, text)]}, by going over all prefixes."""
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []

    def go(p):
        """Leaves and savings at or below a node."""
        leaves, saved = int(p not in children), (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for q in children.get(p, []):
            a, b = go(q)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(conversations[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        go(())
    return sorted(out)


def rebuilt(rows):
    """Conversations of op13 from [(conv_id, turn, role, text)]."""
    own = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            label = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, label, (role, text)))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - math.trunc(math.fmod(c, 5)), [])[: h[c]] + t[h[c] :] for c, t in own.items()}
