"""Plain-Python versions of the operators for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_duplicates(rows, threshold=0.8):
    """{row index: (rep_id, class_id, n_links)} of (doc_id, text) rows with distinct non-null ids."""
    sets = [shingle_set(t) for _, t in rows]
    text = [t or "" for _, t in rows]
    n = len(rows)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if text[i] == text[j] or (either and both >= threshold * either - 1e-9):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = {}
    for i, (doc, _) in enumerate(rows):
        same = min(d for (d, _), t in zip(rows, text) if t == text[i])
        group = min(d for k, (d, _) in enumerate(rows) if find(k) == find(i))
        out[doc] = (same, group, links[i])
    return out


def repeats(docs, length):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of {doc_id: text}."""
    data = {d: (t or "").encode() for d, t in docs.items()}
    first = {}
    for d in sorted(data):
        for p in range(len(data[d]) - length + 1):
            first.setdefault(data[d][p : p + length], (d, p))
    out = {}
    for d, t in data.items():
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (d, p):
                gone[p : p + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d] = (len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def line_drops(docs, min_docs=5, threshold=0.7, depth=3):
    """{doc_id: set of dropped line numbers} of {doc_id: text}."""
    lines = []
    for d, t in docs.items():
        for i, raw in enumerate(t.split("\n") if t is not None else []):
            tokens = tuple("<*>" if re.search(r"[0-9]", x) else x for x in re.split(r"[ \t\n\x0b\f\r]+", raw) if x)
            if tokens:
                lines.append((d, i, tokens))
    leaves = defaultdict(set)
    for _, _, t in lines:
        leaves[len(t), t[:depth]].add(t)
    owner = {}
    for leaf, members in leaves.items():
        templates = []
        for t in sorted(members, key=lambda x: [y.encode() for y in x]):
            same = [sum(a == b and a != "<*>" and a is not None for a, b in zip(x, t)) for x in templates]
            best = int(np.argmax(same)) if same else -1
            if best >= 0 and same[best] >= threshold * len(t):
                templates[best] = [a if a == b else None for a, b in zip(templates[best], t)]
            else:
                best = len(templates)
                templates.append(list(t))
            owner[t] = (leaf, best)
    seen = defaultdict(set)
    for d, _, t in lines:
        seen[owner[t]].add(d)
    out = defaultdict(set)
    for d, i, t in lines:
        if len(seen[owner[t]]) >= min_docs:
            out[d].add(i)
    return out


def base_scores(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)} of {doc_id: text}."""
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for d, t in docs.items()}
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d in docs}
    counts = Counter()
    for d, ts in tokens.items():
        if not held[d]:
            counts.update(ts)
    n, v = sum(counts.values()), len(counts)
    return {d: (held[d], len(ts), sum(counts[t] > 0 for t in ts), n, sum(log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)) for d, ts in tokens.items()}


def warc(pages):
    """{page_id: (payload_bytes, digest, type, refers_to)} of {page_id: html}."""
    payload = {p: (h or "").encode() for p, h in pages.items()}
    top = {}
    for p, x in payload.items():
        top[x] = max(top.get(x, p), p)
    return {p: (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if top[x] == p else "revisit", None if top[x] == p else top[x]) for p, x in payload.items()}


def template_slots(weights, h):
    """Earliest deadline first over one hyperperiod: [(source, block)] by slot, for integer slots per source."""
    done = {s: 0 for s in weights}
    out = []
    for t in range(h):
        due = [(-(-(done[s] + 1) * h // a), i, s) for i, (s, a) in enumerate(sorted(weights.items())) if done[s] * h // a <= t]
        s = min(due)[2]
        out.append((s, done[s]))
        done[s] += 1
    return out
