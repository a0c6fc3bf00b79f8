"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def words(text):
    return WORD.findall(text or "")


def luhn(digits):
    doubled = (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits)))
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def valid(kind, surface):
    digits = re.sub("[^0-9]", "", surface)
    return {
        0: lambda: True,
        1: lambda: all(int(x) <= 255 for x in surface.split(".")),
        2: lambda: 12 <= len(digits) <= 19 and luhn(digits),
        3: lambda: 9 <= len(digits) <= 15,
    }[kind]()


def pii(text):
    found = [
        (m.start(), kind, m.end())
        for kind, pattern in enumerate((EMAIL, IP, CARD, PHONE))
        for m in pattern.finditer(text or "")
        if valid(kind, m.group())
    ]
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in sorted(found))


def repeats(docs, size=50):
    """doc_id -> (words, removed, digest of what stays)."""
    first = {}
    for d, t in docs.items():
        w = words(t)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in docs.items():
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def similar_lines(docs, num=4, den=5):
    """doc_id -> line numbers to remove."""
    seen, out = [], defaultdict(list)
    index = defaultdict(list)
    for d in sorted(docs):
        for i, line in enumerate((docs[d] or "").split("\n")):
            s = frozenset(words(line))
            if not s:
                continue
            shared = Counter(j for w in s for j in index[w])
            if any(c * den >= (len(s) + len(seen[j]) - c) * num for j, c in shared.items()):
                out[d].append(i)
            for w in s:
                index[w].append(len(seen))
            seen.append(s)
    return out


def rules(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside),
        "base_failed": len(w) < 50 or 100 * len(inside) > 50 * len(w),
    }


def duplicate_share(text, n):
    w = words(text)
    seen, inside = set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            inside |= set(range(i, i + n))
        seen.add(g)
    return sum(len(w[i]) for i in inside) / max(1, sum(map(len, w)))
