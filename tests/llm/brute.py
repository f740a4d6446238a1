"""Plain, slow versions of the operators, one document at a time."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("assign", "access", "hex")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    text = text or ""
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A
    ):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


CLASSES = ("lower", "space", "upper", "stop", "digit", "letter", "symbol", "other")


def class_of(c):
    import unicodedata

    if "a" <= c <= "z":
        return "lower"
    if c in " \t\n\x0b\x0c\r":
        return "space"
    if "A" <= c <= "Z":
        return "upper"
    if c in ".,;:!?'\"()-":
        return "stop"
    if "0" <= c <= "9":
        return "digit"
    kind = unicodedata.category(c)[0]
    return "letter" if kind == "L" else "symbol" if kind in "SP" else "other"


def letters(word):
    m = re.match(r"([^\W\d_]+)(?![^.,;:!?])", word.lower())
    return m[1] if m else ""


def distance(p, q):
    from math import log2, sqrt

    if not sum(p) or not sum(q):
        return None
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda x, m: x * log2(x / m) if x else 0.0
    return sqrt(max(0.0, sum((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2 for a, b in zip(p, q, strict=True))))


def verdicts(docs, n_common=24, max_class=0.3, max_common=0.3, min_chars=200, min_words=50):
    """{doc_id: (class distance, common distance, kept)} of (doc_id, text, lang)."""
    classes, common = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang in docs:
        for key in {lang, None}:
            classes[key].update(map(class_of, text or ""))
            common[key].update(map(letters, words(text)))
    top = {k: [w for w, _ in sorted(((w, n) for w, n in c.items() if w), key=lambda x: (-x[1], x[0].encode()))[:n_common]] for k, c in common.items()}
    out = {}
    for i, text, lang in docs:
        own, told = Counter(map(class_of, text or "")), Counter(map(letters, words(text)))
        hist = lambda c: [*[c[w] for w in top[lang]], sum(c.values()) - sum(c[w] for w in top[lang])]  # noqa: B023, E731
        a = distance([own[c] for c in CLASSES], [classes[lang][c] for c in CLASSES]) if len(text or "") >= min_chars else None
        b = distance(hist(told), hist(common[lang])) if len(words(text)) >= min_words else None
        fine = (a is None or a <= max_class) and (b is None or b <= max_common)
        out[i] = (a, b, fine and not quality(text)[-1])
    return out


PARTS = {
    "ident": r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "endpoint": r"""\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+""",
    "opaque": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9a-z+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}",
}
NEEDS = {"ident": ("opaque", "hex"), "endpoint": ("opaque", "hex", "assign"), "opaque": ("access", "ident", "endpoint")}


def all_secrets(text, scope=160):
    """Base spans, and weak parts that overlap none of them and stand near a complement, pair by pair."""
    base = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in secrets(text))]
    weak = [(m.start(), k, m.end()) for k, p in PARTS.items() for m in re.finditer(p, text or "", re.A)]
    weak = [w for w in weak if not any(w[0] < b[2] and b[0] < w[2] for b in base)]
    found = [w for w in weak if any(q[1] in NEEDS[w[1]] and w[0] - scope <= q[2] and q[0] <= w[2] + scope for q in base + weak)]
    order = (*KINDS, *PARTS)
    return [f"{k}:{a}:{b}" for a, k, b in sorted(base + found, key=lambda s: (s[0], order.index(s[1]), s[2]))]


def repeats(docs, n=13):
    """{doc_id: kept words} by removing words in windows that start in a document with a smaller id."""
    first = {}
    for i, text in docs:
        w = words(text)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def roots(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, n=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))


def jaccard_components(docs, num=80, den=100):
    sets = {i: shingles(t) for i, t in docs}
    index, pairs = defaultdict(list), []
    for i, s in sets.items():
        shared = Counter(j for x in s for j in index[x])
        pairs += [(i, j) for j, o in shared.items() if den * o >= num * (len(s) + len(sets[j]) - o)]
        for x in s:
            index[x].append(i)
    root = roots(sets, pairs)
    return {i: (len(s), root[i]) for i, s in sets.items()}
