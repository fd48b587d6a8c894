"""Plain single-process versions of the operators, for comparison."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def luhn(digits):
    each = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in each) % 10 == 0


def personal(text):
    """Base spans of personal data as kind, start, end in the order of the digest."""
    text, out = text or "", []
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def secret(text):
    text, out = text or "", []
    patterns = {
        "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]+",
    }
    for n, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text, re.A):
            if {"assign": kind == "assign" and len(m[2]) >= 6, "access": len(m[0]) >= 20, "hex": len(m[0]) >= 24}[kind]:
                out.append((m.start(), n, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def quality_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = WORD.findall(lower(text))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset({tuple(w)} if w else ())


def near_classes(rows):
    """doc_id -> (set size, smallest identifier of the class), over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated(docs, items):
    windows = {}
    for i, t in items:
        w = TERM.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    for d, t in docs:
        w, hit, found = TERM.findall(lower(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        yield d, len(w), len(hit), len(found), sha(sorted(found)), bool(hit)
