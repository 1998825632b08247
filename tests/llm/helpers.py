"""Small fixtures and brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; a table may have them too.
CLASH = ["block", "keys", "norm", "n_norm", "head", "digest", "rep", "p", "q", "hits", "items", "held_out", "mix_copy", "mix_key", "mix_times", "mix_source", "mix_steps", "row", "size", "text_", "c0", "source_", "weird.name", "part", "u"]


def words(seed: int, n: int, vocabulary: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefghij')}{r.randrange(vocabulary)}{r.choice(['', 'é', 'ß', ','])}" for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, repeats inside a text, short, empty, blank, null and very long texts."""
    base = [words(i, 60 + 7 * i) for i in range(8)]
    passage = words(99, 80)
    near = base[3].split(" ")
    near[10] = "changed"
    far = base[3].split(" ")
    far[::6] = ["x"] * len(far[::6])
    texts = [
        *base, base[0], base[0], base[1].upper(), base[2].replace(" ", "\n"), base[2] + " ", " ".join(near), " ".join(far), words(50, 30) + " " + passage, passage + "\t" + words(51, 45), words(52, 20) + " " + passage + " " + words(53, 20),
        passage + " and " + passage, "ab " * 150, "ab " * 200, "z" * 500, "z" * 199, "é" * 150, "", " \t\n", "one", "one two three", "ONE two three", "one two three four five", None, None, words(60, 20000, 5000), words(60, 20000, 5000) + " tail",
        "x<|endoftext|>y it's they're", "emoji \U0001f600 中文 \x1c \x85 \xa0", "12345 !!! ??? ...",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    rows.append((5, words(70, 70), "en", "s1", 0))  # a repeated id with another text
    rows.append((None, base[6], "en", "s1", 0))  # no id
    return rows


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in CLASH})


def repeated(units: list[list], window: int) -> list[list[bool]]:
    """Which units lie in a window that starts at two places."""
    count: dict = {}
    for u in units:
        for i in range(len(u) - window + 1):
            k = tuple(u[i : i + window])
            count[k] = count.get(k, 0) + 1
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if count[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def ascii_lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_bytes(rows, window=200):
    data = [(r[1] or "").encode() for r in rows]
    count: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - window + 1):
            k = hash(d[i : i + window])
            count[k] = count.get(k, 0) + 1
    out = []
    for r, d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if count[hash(d[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((r[0], len(d), sum(gone), runs, sha(bytes(b for b, g in zip(d, gone, strict=True) if not g))))
    return out


def brute_words(rows, window=35):
    units = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    gone = repeated(units, window)
    return [(r[0], len(u), sum(g), sha(" ".join(w for w, x in zip(u, g, strict=True) if not x).encode())) for r, u, g in zip(rows, units, gone, strict=True)]


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows]
    best: dict[str, tuple] = {}
    for r, t in zip(rows, norm, strict=True):
        k = (-len(r[1] or ""), r[0] is None, r[0] if r[0] is not None else 0)
        if t not in best or k < best[t][0]:
            best[t] = (k, r[0])
    return [(r[0], best[t][1], norm.count(t), r[0] == best[t][1], sha(t.encode())) for r, t in zip(rows, norm, strict=True)]


def brute_contamination(rows, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda t: re.findall(pattern, ascii_lower(t or ""))
    wins: dict[tuple, set] = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    sizes = {len(k) for k in wins}
    out = []
    for r in rows:
        w, found = split(r[1]), set()
        hit = [False] * len(w)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (t := tuple(w[k : k + n])) in wins:
                    found |= wins[t]
                    hit[k : k + n] = [True] * n
        out.append((r[0], len(w), sum(hit), len(found), sha(",".join(sorted(found)).encode()), any(hit)))
    return out


def brute_jaccard(rows, n=5):
    """{(id, text): (shingles, component)} of rows with an id."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(r[1] or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None:
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), low.get(find(i))) for i, r in enumerate(rows)]


def plain_features(lexicon, text: str) -> list[float]:
    """The toxicity features of one text, word by word."""
    import math

    import numpy as np

    from quillspark.llm import toxicity as T
    from quillspark.llm._bytes import bytes_hash

    raw = text.encode()
    low = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in raw)
    hash_ = lambda b: int(bytes_hash(np.frombuffer(b, np.uint8)).slices(np.array([0]), np.array([len(b)]))[0])
    word_odds = dict(zip(lexicon.word.keys.tolist(), lexicon.word_odds.tolist(), strict=True))
    stem_odds = dict(zip(lexicon.stem.keys.tolist(), lexicon.stem_odds.tolist(), strict=True))
    spans = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff@$*]+", low)]
    words = [low[a:b] for a, b in spans]
    odds = [word_odds.get(hash_(w), None) for w in words]
    stems, mixed, hidden = [], [], []
    for w in words:
        best = 0.0
        for k in T.STEMS:
            if len(w) > k and w[k] & 0xC0 != 0x80:
                best = max(best, stem_odds.get(hash_(w[:k]) ^ (int(T._SALT) + k), 0.0))
        stems.append(best)
        mixed.append(any(b < 0x61 for b in w) and any(b >= 0x61 for b in w))
        unmasked = bytes(ord(T.LEET.get(chr(b), chr(b))) if b < 0x80 else b for b in w)
        hidden.append(mixed[-1] and hash_(unmasked) in word_odds)
    second = [w.decode("utf-8", "replace") in T.SECOND_PERSON for w in words]
    n, size = max(len(words), 1), max(len(raw), 1)
    near = sum((o is not None or s > 0 or h) and any(second[max(0, i - T.NEAR) : i + T.NEAR + 1]) for i, (o, s, h) in enumerate(zip(odds, stems, hidden, strict=True)))
    hits = [o for o in odds if o is not None]
    upper, alpha = sum(0x41 <= b <= 0x5A for b in raw), sum(0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0 for b in raw)
    shout = sum(b - a > 1 and all(0x41 <= x <= 0x5A for x in raw[a:b]) for a, b in spans)
    twice = sum(a in b"!?" and b in b"!?" for a, b in zip(raw, raw[1:], strict=False))
    thrice = sum(a == b == c >= 0x61 for a, b, c in zip(low, low[1:], low[2:], strict=False))
    return [
        math.log1p(len(words)), len(hits) / n, len(hits), sum(hits) / n, max(hits, default=0.0), sum(s > 0 for s in stems) / n, sum(s > 0 for s in stems), max(stems, default=0.0),
        sum(hidden) / n, sum(hidden), near / n, sum(second) / n, upper / max(alpha, 1), shout / n, raw.count(b"!") / size, raw.count(b"?") / size, twice / size, sum(mixed) / n, thrice / size,
        sum(0x30 <= b <= 0x39 for b in raw) / size,
    ]


def plain_score(model, text: str | None) -> float:
    """Features, then each tree from its root, then the point of the isotonic curve."""
    import math

    x = plain_features(model.lexicon, text or "")
    total = model.trees.start
    for feature, cut, value in model.trees.trees:
        node = 0
        for _ in range(model.trees.depth):
            f = feature[node]
            node = 2 * node + (2 if sum(c < x[f] for c in model.trees.cuts[f]) > cut[node] else 1)
        total += value[node - (2**model.trees.depth - 1)]
    at, p = model.curve
    if not len(at):
        return 1 / (1 + math.exp(-total))
    if total <= at[0] or total >= at[-1]:
        return float(p[0] if total <= at[0] else p[-1])
    k = next(i for i in range(1, len(at)) if at[i] > total)
    return float(p[k - 1] + (p[k] - p[k - 1]) * (total - at[k - 1]) / (at[k] - at[k - 1]))


def brute_mix(rows, exponent: float, seed: int) -> list[tuple]:
    """The rows of the mixture, each as often as the inverted Poisson distribution says, by source (column 3)."""
    import math

    size: dict = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").encode())
    weight = {s: n**exponent if n else 0.0 for s, n in size.items()}
    out = []
    for r in rows:
        n = size[r[3]]
        rate = weight[r[3]] / sum(weight.values()) * sum(size.values()) / n if n else 1.0
        u = int(hashlib.md5(f"{seed}|{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, total = 0, math.exp(-rate), 0.0
        while True:
            total += p
            if u < total:
                break
            k += 1
            p *= rate / k
        out += [r] * k
    return out
