"""Plain statements of the operators, in loops over rows, for the tests."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from excerpta.llm import langid, minhash, mixing, pii

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


# ---- language -------------------------------------------------------------------------------------------


def probabilities(net, text):
    """Mean class probabilities of a text's windows, convolved byte by byte."""
    total = np.zeros(len(net.classes))
    windows = langid.windows_of(text.encode())
    for w in windows:
        h = []
        for k in langid.WIDTHS:
            patches = np.array([net.p["e"][w[i : i + k]].ravel() for i in range(langid.WINDOW_BYTES - k + 1)])
            h.append((patches @ net.p[f"f{k}"]).max(axis=0) + net.p[f"c{k}"])
        z = np.maximum(np.concatenate(h), 0) @ net.p["w"] + net.p["b"]
        z = np.exp(z - z.max())
        total += z / z.sum()
    return total / len(windows)


def language(net, text):
    if not text or not any(map(str.isalpha, text)):
        return langid.NONE, 0.0
    p = probabilities(net, text)
    return net.classes[int(p.argmax())], float(p.max())


# ---- near copies ----------------------------------------------------------------------------------------


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def without_near_copies(rows):
    """Rows whose id (first column) is the least of those that links of Jaccard 0.8 of the texts (second column) reach."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return [r for i, r in enumerate(rows) if r[0] == least[top(i)]]


# ---- personal data --------------------------------------------------------------------------------------


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text) if passes(k, m[0])]


def seed_kind(value):
    for k, p in BASE:
        if any(passes(k, m[0]) for m in re.finditer(p, value)):
            return k
    return "secret" if re.search(pii.SECRET, value) else None


def candidates(text):
    """(value, start, end, kind, patterns) of what looks like an identifier."""
    out, found = [], list(re.finditer(pii.CANDIDATE, text, re.A))
    for i, m in enumerate(found):
        before = text[found[i - 1].end() if i else 0 : m.start()][-80:]
        after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)][:80]
        core = re.search(r"(?s)[0-9A-Za-z@+(](?:.*[0-9A-Za-z])?", m[0])
        value = core[0] if core else ""
        start = m.start() + len(re.match(r"[^0-9A-Za-z@+(]*", m[0])[0])
        two, one, next_ = re.search(r"(\S*)\s+(\S*)\s*$", before, re.A), re.search(r"(\S*)\s*$", before, re.A), re.search(r"^\S*\s+(\S+)", after, re.A)
        left, right, following = (x[1].lower() if x else "" for x in (two, one, next_))
        if re.search(rf"[0-9]|[0-9A-Za-z].*@|@.*[0-9A-Za-z]|{pii._AT}", value.lower()):
            patterns = [f"l {left} {right}", f"b {right} _ {following}"] if left or right else []
            out.append((value.lower(), start, start + len(value), seed_kind(value), patterns))
    return out


def bootstrapped(texts):
    """For each text the spans that contexts vouch for, base ones left out."""
    places = [candidates(t) for t in texts]
    edges = {}
    for own in places:
        for value, _, _, kind, patterns in own:
            for p in patterns:
                edges[p, value] = max(filter(None, (edges.get((p, value)), kind)), default=None)
    n_values, seeds = Counter(p for p, _ in edges), Counter((p, k) for (p, _), k in edges.items() if k)
    unknown = [(p, v) for (p, v), k in edges.items() if not k]
    scores, kept = {}, {}
    for i in range(pii.ROUNDS):
        more, taught = defaultdict(float), Counter()
        by_value = defaultdict(list)
        for (v, k), s in scores.items():
            by_value[v].append((k, s))
        for p, v in unknown:
            for k, s in by_value[v]:
                more[p, k] += s
                taught[p, k] += s >= pii.LEAST_SCORE
        kept = {}
        for p, k in seeds.keys() | more.keys():
            score = (seeds[p, k] + more[p, k]) / (n_values[p] + pii.SMOOTH)
            if seeds[p, k] + taught[p, k] >= pii.LEAST_SEEDS and score >= pii.LEAST_SCORE:
                kept[p, k] = score
        miss = defaultdict(float)
        kinds = defaultdict(list)
        for (p, k), s in kept.items():
            kinds[p].append((k, s))
        for p, v in unknown:
            for k, s in kinds[p]:
                miss[v, k] += math.log(max(1.0 - s, 1e-9))
        scores = {vk: 1.0 - math.exp(x) for vk, x in miss.items()}
    trusted = {vk for vk, s in scores.items() if s >= pii.LEAST_SCORE}
    out = []
    for text, own in zip(texts, places):
        base, spans = base_spans(text), set()
        for value, a, b, kind, patterns in own:
            for p in patterns:
                for k in pii.FOUND_KINDS:
                    if (p, k) in kept and (kind is None and (value, k) in trusted or kind == k == "secret"):
                        if not any(a < y and x < b for _, x, y in base):
                            spans.add((pii.FOUND_KINDS.index(k), a, b))
        out.append([(pii.FOUND_KINDS[k], a, b) for k, a, b in sorted(spans)])
    return out


def masked(texts):
    out = []
    for text, found in zip(texts, bootstrapped([t or "" for t in texts])):
        if text is not None:
            for k, a, b in sorted(found, key=lambda s: s[1:], reverse=True):
                text = f"{text[:a]}<{k}>{text[b:]}"
            for kind in ("email", "phone", "card", "ip"):
                text = re.sub(dict(BASE)[kind], lambda m: f"<{kind}>" if passes(kind, m[0]) else m[0], text)
        out.append(text)
    return out


# ---- mixing ---------------------------------------------------------------------------------------------


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Target of each source by repeating the reshare."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(names)}
    cap = {s: mixing.MOST_COPIES * sizes[s] for s in names}
    full, total = set(), mixing.SHARE * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        line = max(0.0, total - sum(cap[s] for s in full)) / sum(weight[s] for s in rest) if rest else math.inf
        more = {s for s in rest if cap[s] <= weight[s] * line}
        if not more:
            return {s: cap[s] if s in full else weight[s] * line for s in names}
        full |= more


def mixed(spark, rows):
    """Copies of each row (id, text, source), ids not null and different, systematic sampling one source at a time."""
    ids = spark.createDataFrame([(r[0],) for r in rows], "id long")
    hashes = {r[0]: (r[1], r[2]) for r in ids.select("id", F.pmod(F.xxhash64(F.lit(mixing.SEED + 1), "id"), F.lit(2)) == 1, F.xxhash64(F.lit(mixing.SEED), "id")).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size_of(t)
    target, copies = targets(sizes), {}
    for source in sizes:
        own = [(hashes[i][0], -size_of(t) if hashes[i][0] else size_of(t), hashes[i][1], i, size_of(t)) for i, t, s in rows if s == source]
        own.sort()
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        drawn = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(mixing.SEED), F.lit(k), F.lit(source or "")), F.lit(1 << 30)) / F.lit(float(1 << 30)) for k in range(mixing.DRAWS)]).first()
        tries = []
        for k, offset in enumerate(drawn):
            taken = [math.floor(offset + (j + 1) * rate) - math.floor(offset + j * rate) for j in range(len(own))]
            off = abs(sum(c * o[4] for c, o in zip(taken, own)) - target[source])
            tries.append((0.0 if off <= mixing.CLOSE * target[source] else off, k, taken))
        copies.update({o[3]: c for o, c in zip(own, min(tries)[2])})
    return copies, target, sizes


# ---- fingerprints ---------------------------------------------------------------------------------------


def chain(*values):
    """Spark's XXH64 of several values: ints as ("i", x), longs as ("l", x)."""
    h = 42
    for kind, x in values:
        h = xxhash.xxh64_intdigest(struct.pack("<i" if kind == "i" else "<q", x), h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def fingerprint(text):
    """One-permutation MinHash of an ASCII text: hex digits, one a bin."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    hashed = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    if not hashed:
        return ""
    if len(hashed) < minhash.SHINGLE:
        a = 42
        for x in hashed:
            a = signed(chain(("l", a), ("l", x)))
        all_ = [a]
    else:
        all_ = [signed(chain(*(("l", x) for x in hashed[i : i + minhash.SHINGLE]))) for i in range(len(hashed) - minhash.SHINGLE + 1)]
    low = (1 << 64 - minhash.BIN_BITS) - 1
    bins = [None] * minhash.BINS
    for x in all_:
        b = (x >> 64 - minhash.BIN_BITS) + minhash.BINS // 2
        if x & low != low:
            bins[b] = x if bins[b] is None else min(bins[b], x)
    filled = {b: x for b, x in enumerate(bins) if x is not None}
    out = []
    for b, x in enumerate(bins):
        if x is None:
            for a in range(1, minhash.PROBES + 1):
                at = signed(chain(("i", b), ("i", a))) % minhash.BINS
                if at in filled:
                    other = filled[at]
                    break
            else:
                other = min((signed(chain(("i", b), ("l", y >> 64 - minhash.BIN_BITS))), y) for y in filled.values())[1]
            x = signed(chain(("l", other), ("i", b)))
        out.append(x & (1 << minhash.LOW_BITS) - 1)
    return "".join(f"{x:x}" for x in out)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()
