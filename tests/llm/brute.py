"""Plain Python versions of the operators' results, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text):
    return WORD.findall((text or "").encode())


def lower(data: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b < 91 else b for b in data)


def suffix(docs, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)"""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[doc] = (len(data), int(gone.sum()), int((edge == 1).sum()), sha(bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


def quality(text):
    w = words(text)
    t = text or ""
    starts = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if starts[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    n = len(w)
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def simhash(text):
    w = [lower(x) for x in words(text)]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text, width):
    w = [lower(x) for x in words(text)]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(docs):
    """doc_id -> (fingerprint, component)"""
    prints = {d: simhash(t) for d, t in docs}
    ids = list(prints)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def base_scores(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)"""
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    tokens = {d: [lower(x) for x in words(t)] + [None] for d, t in docs}
    count = Counter(x for d, _ in docs if not held[d] for x in tokens[d])
    n, v = count.total(), len(count)
    score = lambda x: math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1)))
    return {d: (held[d], len(x), sum(count[y] > 0 for y in x), n, sum(map(score, x))) for d, x in tokens.items()}


def bpe(text):
    import base64

    import tiktoken

    if not hasattr(bpe, "coder"):
        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe.coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.coder.encode_ordinary(text or "")
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())


def chat(turns):
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256)"""
    out = {}
    for c in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == c), key=lambda t: t[1])
        loss = "".join(x or "" for _, _, r, x in mine if r == "assistant")
        out[c] = (len(mine), sha("".join(f"{r}\n{x or ''}\n" for _, _, r, x in mine).encode()), len(loss), sha(loss.encode()))
    return out


def edits(docs):
    """doc_id -> (n_chars, edited_sha256)"""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        k = len(t) // 3
        out[d] = (len(t), sha((t[: len(t) - k] + n[:k]).encode()))
    return out


def likenesses(docs):
    """doc_id -> (near_edited, near_next): shared over all (paragraph piece, times it occurs)"""
    pieces = lambda t: set(Counter(re.findall(r"[^\n]{1,160}\n?|\n", t)).items())
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        k = len(t) // 3
        out[d] = (like(pieces(t), pieces(t[: len(t) - k] + n[:k])), like(pieces(t), pieces(n)))
    return out


def decision_list(made):
    """What ``quality_rules.learn`` must find, by loops over the rows, for at most 31 distinct values a feature."""
    from tracewell.llm import quality_rules as Q

    rank = lambda v, q: sorted(v)[max(0, math.ceil(q * len(v)) - 1)]
    cuts = {f: sorted({rank([r[f] for r in made], i / Q.BINS) for i in range(1, Q.BINS)}) for f in Q.FEATURES}
    holds = lambda r, rule: all(r[c.feature] > c.threshold if c.above else r[c.feature] <= c.threshold for c in rule)
    count = lambda part, rule: (sum(r["bad"] and holds(r, rule) for r in part), sum(not r["bad"] and holds(r, rule) for r in part))
    left, rules, barred = list(made), [], set()
    while len(rules) < Q.MAX_RULES and len(barred) < Q.MAX_REFUSED:
        rule = []
        while len(rule) < Q.MAX_CONDITIONS:
            grow = [r for r in left if r["grow"] and holds(r, rule)]
            p0, n0 = count(grow, [])
            tried = [(Q.gain(*count(grow, [c]), p0, n0), c) for f in Q.FEATURES for t in cuts[f] for c in (Q.Condition(f, False, t), Q.Condition(f, True, t)) if rule or (f, c.above) not in barred]
            best = max(tried, key=lambda x: x[0])
            if not n0 or best[0] <= 1e-9:
                break
            rule.append(best[1])
        if not rule:
            break
        held = [r for r in left if not r["grow"]]
        k = max(range(len(rule)), key=lambda i: (Q.lower_bound(*count(held, rule[: i + 1])), -i))
        rule = rule[: k + 1]
        p, n = count(held, rule)
        if p >= Q.MIN_PRECISION * (p + n) and Q.lower_bound(p, n) >= Q.MIN_BOUND:
            rules.append(rule)
            left = [r for r in left if not holds(r, rule)]
        else:
            barred.add((rule[0].feature, rule[0].above))
    return rules
