"""Plain versions of the operators, written for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def ids(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def token_rows(docs, tokenizer, end=2):
    """{doc_id: (start, n, crc)} for (doc_id, text) with distinct ids."""
    out, start = {}, 0
    for doc, text in sorted(docs):
        a = ids(tokenizer, text, end)
        out[doc] = (start, len(a), zlib.crc32(a.tobytes()))
        start += len(a)
    return out


def pieces(docs, tokenizer, capacity, end=1):
    rows = []
    for doc, text in docs:
        a = ids(tokenizer, text, end)
        rows += [(doc, k, s, len(a[s : s + capacity]), zlib.crc32(a[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(a), capacity))]
    return rows


def base_counts(text):
    t = text or ""
    words = BLANK_WORD.findall(t)
    lines = [x for x in t.split("\n") if BLANK_WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = [0] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit[i : i + 3] = [1] * 3
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit)


def contamination(docs, items, window=13):
    known = defaultdict(set)
    for name, text in items:
        w = ITEM_WORD.findall(lower(text or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            known[tuple(w[k : k + n])].add(str(name))
    out = []
    for doc, text in docs:
        w = ITEM_WORD.findall(lower(text or ""))
        hit, names = [0] * len(w), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if found := known.get(tuple(w[k : k + n])):
                    names |= found
                    hit[k : k + n] = [1] * n
        h = sum(hit)
        out.append((doc, len(w), h, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return out


def shingles(text, width):
    w = tuple(BLANK_WORD.findall(lower(text or "")))
    if not w:
        return frozenset()
    return frozenset(w[i : i + width] for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([w])


def components(docs, width, percent):
    """{doc_id: (n_shingles, component_id)}; rows that share an id are one document."""
    sets = [(d, shingles(t, width)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(d, len(s), find(d)) for d, s in sets]


def warc_rows(pages):
    best = {}
    for page, html in pages:
        if page is not None:
            best[html or ""] = max(page, best.get(html or "", page))
    out = []
    for page, html in pages:
        body = (html or "").encode()
        target = best.get(html or "")
        again = target is not None and target != page
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", target if again else None))
    return out


def chat_rows(turns):
    groups = defaultdict(list)
    for conv, turn, role, text in turns:
        groups[conv].append((turn if turn is not None else -(2**63), role or "", text or ""))
    out = {}
    for conv, rows in groups.items():
        rows.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        loss = "".join(t for _, r, t in rows if r == "assistant")
        out[conv] = (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """{item: [(doc_id, score)]} by the formula alone; items of one id are one query."""
    counts = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    queries = defaultdict(set)
    for item, text in items:
        queries[item].update(TERM.findall(lower(text or "")))
    out = {}
    for item, words in queries.items():
        found = []
        for d, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            score = 0
            for w in words & c.keys():
                score += int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[w] + 1)))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((d, score))
        out[item] = sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
    return out


def collocations(docs, least, best, covered=80):
    """[(lang, rank, phrase, a, l, r, n, score)] by counting every run."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(4, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    rows = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows[lang].append((-score, -a, " ".join(w).encode(), w, f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, found in rows.items():
        known = {r[3]: -r[1] for r in found}
        around = Counter()
        for w, a in known.items():
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    around[w[i : i + m]] = max(around[w[i : i + m]], a)
        kept = sorted(r for r in found if 100 * around[r[3]] < covered * -r[1])
        out += [(lang, i + 1, r[2].decode(), -r[1], r[4], r[5], n[lang], -r[0]) for i, r in enumerate(kept[:best])]
    return sorted(out)


def base_scores(docs, held):
    """[(n_tokens, n_known, N, score)] with one added to each training count; the end is a token."""
    words = [[*BLANK_WORD.findall(lower(t or "")), ""] for t in docs]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(w in c for w in ws), n, sum(np.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws)) for ws in words]


def attention_log_p(p, tokens, stride, bounds):
    """Log probabilities of one document's tokens, position by position, with the inputs of its block and the one before."""
    inputs = [len(p["embed"]) - 1, *tokens[:-1]]
    width, out = p["out"].shape[0], []
    for t, token in enumerate(tokens):
        seen = range(max(0, (t // stride - 1) * stride), t + 1)
        x = {j: p["embed"][inputs[j]] for j in seen}
        q = (x[t] @ p["qkv"])[:width]
        kv = {j: np.split(x[j] @ p["qkv"], 3)[1:] for j in seen}
        w = np.exp([q @ kv[j][0] / np.sqrt(width) + p["bias"][t - j] for j in seen])
        h = x[t] + (sum(a * kv[j][1] for a, j in zip(w / w.sum(), seen, strict=True)) @ p["out"])
        a, b = h @ p["cls"] + p["cls_b"], h @ p["slot"] + p["slot_b"]
        k = max(i for i, first in enumerate(bounds[:-1]) if first <= token)
        out.append(a[k] - np.log(np.exp(a).sum()) + b[token] - np.log(np.exp(b[bounds[k] : bounds[k + 1]]).sum()))
    return np.array(out)
