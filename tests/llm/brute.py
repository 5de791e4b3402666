"""Plain versions of the operators, for small tables."""

import hashlib
import re


def tokens(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width):
    w = tokens(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(sets, percent=80):
    """sets: id -> set. id -> least id reachable."""
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}


def without_repeats(rows, window):
    """rows: (id, text) of distinct ids. id -> (n_words, n_removed, sha256 of the kept words)."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        w = (text or "").encode().split()
        drop = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                drop[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, gone in zip(w, drop, strict=True) if not gone)
        out[d] = (len(w), sum(drop), hashlib.sha256(kept).hexdigest())
    return out


def item_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def hits(text, items, size):
    w, hit, found = item_words(text), set(), set()
    for name, item in items:
        iw = item_words(item)
        for s in range(max(1, len(iw) - size + 1)) if iw else ():
            win = iw[s : s + size]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(name)
    return len(w), len(hit), len(found), ",".join(sorted(found))


def quality(text):
    body = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", body) if x]
    lines = [x for x in body.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 5)} if len(w) < 2000 else None
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", body)), len(lines) - len(set(lines)), None if covered is None else len(covered)
