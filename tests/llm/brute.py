"""Plain Python versions of the operators, slow and simple, that the tests compare with."""

import hashlib
import re
from collections import Counter

from flowlens.llm.quality_rules import BOILERPLATE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# quality rules


def line_fails(line):
    n = len(WORD.findall(line))
    return (
        10 * len(re.findall(r"[#*$%&|<>]", line)) > 3 * n
        or 10 * len(re.findall(r"[!?]{2,}(?=[\x20\x09-\x0D]|\Z)", line)) > 3 * n
        or 10 * len(re.findall(r"[|›»→•·]|::|>>", line)) > 2 * n
        or n <= 4 and not re.search(r"[.!?…。！？:;,]", line)
        or n <= 20 and any(p in line.lower() for p in BOILERPLATE)
    )


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean text."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    good = [x for x in lines if not line_fails(x)]
    kept = not failed and 1 - len("".join(good)) / max(len("".join(lines)), 1) <= 0.5
    return len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed, kept, "\n".join(good)


# near copies


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def components(rows, percent=80):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]), low[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)]


# decontamination


def contamination(text, items, size=10):
    """n_words, n_hit, n_items, items_sha256, contaminated; items: (item_id, text)."""
    words = ALNUM.findall((text or "").translate(LOW))
    hit, names = set(), set()
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        k = min(size, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                names.add("null" if item is None else str(item))
    return len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)


# secrets and personal data: the base patterns of the contracts

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def luhn(m):
    digits = [int(c) for c in m if c.isascii() and c.isdigit()]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _n(m):
    return len(re.findall("[0-9]", m))


SECRET_KINDS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}
PII_KINDS = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= _n(m[0]) <= 19 and luhn(m[0])),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= _n(m[0]) <= 15),
}


def base_spans(text, kinds):
    found = []
    for rank, (kind, (pattern, keep)) in enumerate(kinds.items()):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if keep(m)]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def span_digest(text, kinds):
    """The count of each kind, and base_sha256."""
    spans = base_spans(text, kinds)
    return *(sum(k == kind for k, _, _ in spans) for kind in kinds), sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
