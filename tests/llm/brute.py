"""Plain models that the tests hold the operators against."""

import re
from collections import defaultdict


def components(texts: dict, size: int, percent: int) -> dict:
    """doc_id -> (set size, smallest doc_id reachable) by comparing all pairs that share a shingle."""
    sets = {}
    for d, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = max(1, len(words) - size + 1)
        sets[d] = {tuple(words[i : i + size]) for i in range(n)} if words else set()
    index = defaultdict(list)
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for d in sorted(sets):
        seen = defaultdict(int)
        for s in sets[d]:
            for other in index[s]:
                seen[other] += 1
            index[s].append(d)
        for other, same in seen.items():
            if 100 * same >= percent * (len(sets[d]) + len(sets[other]) - same):
                a, b = sorted((root(d), root(other)))
                up[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def leaks(docs: dict, items: dict, size: int = 5, percent: int = 80) -> set:
    """(doc_id, item_id) of the documents of which a window as long as the item passes, over all windows."""
    import math

    def shingles(text):
        w = re.findall(r"[^\W_]+", text.lower())
        n = max(1, len(w) - size + 1)
        return [tuple(w[i : i + size]) for i in range(n)] if w else [], len(w)

    both = {i: shingles(t) for i, t in items.items()}
    sets = {i: (set(s), n) for i, (s, n) in both.items() if s}
    count = defaultdict(int)
    for s, _ in sets.values():
        for x in s:
            count[x] += 1
    rare = round(16 * (1 + math.log(max(1, len(sets)))))
    wt = {x: math.floor(16 * (1 + math.log(len(sets) / c)) + 0.5) for x, c in count.items()}
    found = set()
    for d, t in docs.items():
        sh, n = shingles(t)
        if not any(x in wt for x in sh):
            continue
        for i, (own, m) in sets.items():
            total, k = sum(wt[x] for x in own), max(1, min(m, n) - size + 1)
            for at in range(max(1, n - m + 1)):
                w = sh[at : at + k]
                both = sum(wt[x] for x in own.intersection(w))
                weight = sum(wt[x] for x in set(w) if x in wt) + rare * sum(x not in wt for x in w)
                if both and 100 * both >= percent * (weight + total - both):
                    found.add((d, i))
                    break
    return found


def base_spans(text: str) -> list:
    """(start, kind number, end, kind) by the standard library's patterns."""
    kinds = [("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    return sorted((m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(kinds) for m in re.finditer(p, text or "", re.ASCII) if len(m[g]) >= n)


def entropy_range(run: str, classes: dict, window: int = 20):
    """First and last start of the windows whose entropy reaches the bound of the run's class."""
    import math
    from collections import Counter

    bound = next((b for p, b in classes.items() if re.fullmatch(p, run)), 99)
    hot = [i for i in range(len(run) - window + 1) if round(-sum(c / window * math.log2(c / window) for c in Counter(run[i : i + window]).values()), 9) >= bound]
    return (hot[0], hot[-1]) if hot else None


def secret_spans(text: str) -> list:
    """All spans of a text: the base ones, and in each run that is no base match one per stretch between them."""
    from weftline.llm import secrets

    text = text or ""
    base = base_spans(text)
    more = []
    for m in re.finditer(secrets.CANDIDATE, text):
        if not re.search("[0-9]", m[0]) or not re.search("[A-Za-z]", m[0]) or any(re.search(a, m[0]) for a in secrets.ALLOW):
            continue
        bits = next(b for p, b in secrets.CLASSES.items() if re.fullmatch(p, m[0]))
        at = m.start()
        for start, end in [*((b[0], b[2]) for b in base if b[0] < m.end() and m.start() < b[2]), (m.end(), m.end())]:
            if start - at >= secrets.WINDOW and (hot := entropy_range(text[at:start], {".+": bits})):
                more.append((at + hot[0], 3, at + hot[1] + secrets.WINDOW, "entropy"))
            at = max(at, end)
    return sorted(base + more)


def redacted(text: str, mark: str = "[REDACTED]") -> str:
    out, at = "", 0
    for start, _, end, _ in secret_spans(text):
        if end > at:
            out += text[at : max(at, start)] + (mark if start >= at or at == 0 else "")
            at = end
    return out + text[at:]


M64 = (1 << 64) - 1


def mixed(h: int) -> int:
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def word_hash(word: bytes) -> int:
    h, p = 0, 1
    for b in word:
        h, p = (h + (b + 1) * p) & M64, p * 0x9E3779B97F4A7C15 & M64
    return mixed((h + len(word)) & M64)


def gram_set(text: str, bits: int = 20) -> set:
    """The feature numbers of a text: words, pairs, pairs that skip one, triples."""
    a, b, c, s = 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB
    h = [word_hash(w.lower()) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    out = [mixed(x ^ s) for x in h]
    out += [mixed((x * a + y * b) & M64) for x, y in zip(h, h[1:], strict=False)]
    out += [mixed((x * c + y * b) & M64) for x, y in zip(h, h[2:], strict=False)]
    out += [mixed((x * s + y * a + z * c) & M64) for x, y, z in zip(h, h[1:], h[2:], strict=False)]
    return {x >> (64 - bits) for x in out}


def ftrl(rows: list, epochs: int = 3, alpha: float = 0.6, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0, bias: int = 1 << 20) -> dict:
    """Weights by feature number from (features, label) rows, one coordinate at a time."""
    import math

    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        cut = 0 if i == bias else l1
        return 0.0 if abs(z[i]) <= cut else -(z[i] - math.copysign(cut, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for features, y in rows:
            w = {i: weight(i) for i in [*sorted(features), bias]}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - y
            for i, x in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * x
                n[i] += g * g
    return {i: w for i in list(z) if (w := weight(i))}


def votes(text: str, labellers: dict, least: int = 8) -> str:
    """The labellers' votes on a text, from shares that are counted one by one."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    n, w = len(words), max(1, len(words))
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    symbol = lambda b: not letter(b) and not 48 <= b <= 57
    chars = b"".join(words)
    low = [x.lower() for x in words]
    stops = sum(x[-1] in b".," for x in words)
    shares = {
        "symbols": sum(map(symbol, chars)) / max(1, len(chars)), "bars": sum(x[:1] == b"|" for x in words) / w,
        "capitals": sum(65 <= b <= 90 for b in data) / max(1, sum(map(letter, data))), "repeats": sum(x == y for x, y in zip(low, low[1:], strict=False)) / w,
        "marked": sum(symbol(x[-1]) and x[-1] not in b".," for x in words) / w, "long_words": sum(len(x) > 6 for x in words) / w,
        "few_stops": 1 - min(1, 8 * stops / w), "one_word": max(map(low.count, set(low)), default=0) / w,
    }
    return "".join("-" if n < least else "0" if shares[k] > bad else "1" if shares[k] < good else "-" for k, (bad, good) in labellers.items())


def posteriors(count: dict, rounds: int = 100) -> dict:
    """P(good) of vote patterns by expectation-maximisation, pattern by pattern."""
    import math

    p = {v: 0.9 * 0.4 ** v.count("0") for v in count}
    total = sum(count.values())
    for _ in range(rounds):
        new = {}
        log = {v: [0.0, 0.0] for v in count}
        for c in (0, 1):
            mass = {v: n * (p[v] if c else 1 - p[v]) for v, n in count.items()}
            for v in count:
                log[v][c] = math.log((sum(mass.values()) + 1) / (total + 2))
                for k, vote in enumerate(v):
                    if vote != "-":
                        own = {x: sum(m for u, m in mass.items() if u[k] == x) + 1 for x in "01"}
                        log[v][c] += math.log(own[vote] / (own["0"] + own["1"]))
        for v, (bad, good) in log.items():
            new[v] = 1 / (1 + math.exp(max(-50, min(50, bad - good))))
        p = new
    return p


def greedy_count(text: str, vocabulary: set, longest: int) -> int:
    """Pieces of greedy longest-match over the words of a text, each with a leading space."""
    n = 0
    for word in (text or "").split():
        w, i = b" " + word.encode(), 0
        while i < len(w):
            i = next(j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in vocabulary)
            n += 1
    return n
