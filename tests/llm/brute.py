"""Plain Python versions of the result contracts, for small inputs."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n == 2


def grams(word, low, high, buckets):
    """Buckets of a word between its edges, and of all that it is made of."""
    marked = f"<{word}>"
    parts = [marked] + [marked[i : i + n] for n in range(low, high + 1) if n < len(marked) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(p.encode("utf-8", "replace")) % buckets for p in parts]


def gram_words(text):
    edge = " .,;:!?\"'()[]{}<>|/\\*_-–—«»…“”„"
    return [w for w in (x.strip(edge) for x in (text or "").lower().split()) if w]


def op1(text, model):
    """The score of the mean over all grams of all words, one by one."""
    ids = [g for w in gram_words(text) for g in grams(w, model.low, model.high, len(model.weight))]
    mean = math.fsum(float(model.weight[g]) for g in ids) / max(1, len(ids))
    return 1 / (1 + math.exp(-(mean + model.bias)))


def op5(text, model):
    """Language and score: each language's losses of the margins against its codeword, one bit at a time."""
    if text is None or not any(map(str.isalpha, text)):
        return "und", 1.0
    ids = [g for w in gram_words(text) for g in grams(w, model.low, model.high, len(model.weight))]
    bits = model.code.shape[1]
    margin = [math.fsum(float(model.weight[g][b]) for g in ids) / max(1, len(ids)) + float(model.bias[b]) for b in range(bits)]
    loss = [sum(float(model.trust[k][b]) * math.log1p(math.exp(-margin[b] * (1 if model.code[k][b] else -1))) for b in range(bits)) for k in range(len(model.langs))]
    best = loss.index(min(loss))
    return model.langs[best], 1 / math.fsum(math.exp(-(x - loss[best]) * bits) for x in loss)


def op2(rows):
    out = {}
    for doc_id, text in rows:
        text = text or ""
        words = SPACE.findall(text)
        grams = Counter(zip(words, words[1:], words[2:]))
        marked = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
        out[doc_id] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed)
    return out


def op3(rows):
    by = defaultdict(list)
    for page_id, html in rows:
        by[(html or "").encode()].append(page_id)
    out = []
    for payload, ids in by.items():
        ids.sort()
        for k, page_id in enumerate(ids):
            out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if k else "response", ids[0] if k else None))
    return sorted(out, key=str)


def op4(rows, items, size=10):
    return sorted(op4_rows(rows, items, size))


def op4_rows(rows, items, size=10):
    wins = defaultdict(set)
    for item_id, text in items:
        w = ALNUM.findall(lower(text))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wins[tuple(w[i : i + size])].add(str(item_id))
    lengths = {len(w) for w in wins}
    out = []
    for doc_id, text in rows:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def op4_near(rows, items, span=20, rarest=3):
    """Per row the number of items whose rarest terms lie together."""
    docs = [ALNUM.findall(lower(text)) for _, text in rows]
    n = Counter(w for ws in docs for w in ws)
    own = defaultdict(dict)
    for item_id, text in items:
        for k, w in enumerate(ALNUM.findall(lower(text))):
            own[str(item_id)][w] = min(k, own[str(item_id)].get(w, k))
    out = []
    for ws in docs:
        met = 0
        for terms in own.values():
            top = sorted(terms, key=lambda w: (n[w], w.encode()))[:rarest]
            reach = max([span, *(abs(terms[w] - terms[top[0]]) for w in top)])
            met += any(w == top[0] and set(top) <= set(ws[max(0, p - reach) : p + reach + 1]) for p, w in enumerate(ws))
        out.append(met)
    return out


def shingles(text, n=5):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def op7(rows):
    sets = [(doc_id, shingles(text)) for doc_id, text in rows]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    by = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for g in s:
            by[g].add(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    low = {}
    for i, (doc_id, _) in enumerate(sets):
        low[find(i)] = min(doc_id, low.get(find(i), doc_id))
    return sorted((doc_id, len(s), low[find(i)]) for i, (doc_id, s) in enumerate(sets))


def op9(rows, size=200):
    texts = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    n = Counter(t[i : i + size] for _, t in texts for i in range(len(t) - size + 1))
    out = []
    for doc_id, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if n[t[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def op10_base(rows):
    docs = [(doc_id, [*SPACE.findall(lower(text)), None]) for doc_id, text in rows]
    c = Counter(w for doc_id, ws in docs if not held(doc_id, 7) for w in ws)
    total, kinds = sum(c.values()), len(c)
    return {doc_id: (held(doc_id, 7), len(ws), sum(c[w] > 0 for w in ws), total, sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in ws)) for doc_id, ws in docs}


def log_add(values):
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(math.fsum(math.exp(v - top) for v in values))


def cuts_of(word, logs, longest):
    """Each way to go on in a word: (start, end, pieces), characters without a piece being spelt by their bytes."""
    out = []
    for i in range(len(word)):
        out += [(i, j, [word[i:j]]) for j in range(i + 1, min(len(word), i + longest) + 1) if word[i:j] in logs]
        if word[i] not in logs:
            out.append((i, i + 1, [f"<0x{x:02X}>" for x in word[i].encode()]))
    return out


def forward_backward(word, logs, longest):
    edges = cuts_of(word, logs, longest)
    by_end, by_start, n = defaultdict(list), defaultdict(list), len(word)
    for s, e, p in edges:
        by_end[e].append((s, sum(logs[x] for x in p)))
        by_start[s].append((e, sum(logs[x] for x in p)))
    alpha, beta = {0: 0.0}, {n: 0.0}
    for e in range(1, n + 1):
        alpha[e] = log_add([alpha[s] + v for s, v in by_end[e]])
    for s in range(n - 1, -1, -1):
        beta[s] = log_add([beta[e] + v for e, v in by_start[s]])
    return edges, alpha, beta


def op10(rows, first, rounds=3, smooth=0.1):
    """log10 of each text's probability: three rounds of expectation-maximisation over the training words, then the sum over
    all segmentations of each word."""
    logs, end = {p: float(v) for p, v in zip(first.pieces, first.logs) if p}, float(first.end)
    docs = [(doc_id, SPACE.findall(lower(text))) for doc_id, text in rows]
    train = [ws for doc_id, ws in docs if not held(doc_id, 7)]
    counts, longest = Counter(w for ws in train for w in ws), max(len(p) for p in logs if not p.startswith("<0x"))
    for _ in range(rounds):
        sums = dict.fromkeys(logs, smooth)
        for w, n in counts.items():
            edges, alpha, beta = forward_backward("▁" + w, logs, longest)
            for s, e, p in edges:
                share = n * math.exp(alpha[s] + sum(logs[x] for x in p) + beta[e] - beta[0])
                for x in p:
                    sums[x] += share
        whole = math.fsum(sums.values()) + len(train)
        logs, end = {p: math.log(n / whole) for p, n in sums.items()}, math.log(len(train) / whole)
    known = {w: forward_backward("▁" + w, logs, longest)[2][0] for _, ws in docs for w in ws}
    return {doc_id: (math.fsum(known[w] for w in ws) + end) / math.log(10) for doc_id, ws in docs}
