"""Plain Python forms of the operators, row by row, for small tables."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def documents(rows):
    """Distinct (doc_id, text), nulls first."""
    return sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def sets(rows, n):
    out = {}
    for d, t in documents(rows):
        w = SPACE.findall(t.translate(LOWER))
        out[d, t] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def components(rows, n, percent):
    s = sets(rows, n)
    keys = list(s)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).append(k)
    low = {k: min((x[0] for x in g), key=lambda d: (d is not None, d or 0)) for g in groups.values() for k in g}
    return {k: (len(s[k]), low[k]) for k in keys}


def later_windows(rows, cut, n):
    """(doc_id, text) -> marks of items covered by a window that starts earlier, too."""
    seen, out = set(), {}
    for d, t in documents(rows):
        w = cut(t)
        marks = [False] * len(w)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                marks[i : i + n] = [True] * n
            seen.add(key)
        out[d, t] = marks
    return out


def repeated_bytes(rows, n):
    docs = documents(rows)
    count = Counter(t.encode()[i : i + n] for _, t in docs for i in range(len(t.encode()) - n + 1))
    out = {}
    for d, t in docs:
        b = t.encode()
        marks = [False] * len(b)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                marks[i : i + n] = [True] * n
        out[d, t] = (
            len(b),
            sum(marks),
            sum(m and (i == 0 or not marks[i - 1]) for i, m in enumerate(marks)),
            sha(bytes(x for x, m in zip(b, marks, strict=True) if not m)),
        )
    return out


def quality(text):
    w = SPACE.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    marks = [False] * len(w)
    for i, g in enumerate(grams):
        if count[g] > 1:
            marks[i : i + 5] = [True] * 5
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if SPACE.search(x):
            dup += x in seen
            seen.add(x)
    n, r = len(w), sum(marks)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 10 or 100 * r > 20 * n


def contamination(rows, bench, n):
    windows = {}
    for item, t in bench:
        w = ALNUM.findall((t or "").translate(LOWER))
        if w:
            for i in range(max(1, len(w) - n + 1)):
                windows.setdefault(tuple(w[i : i + n]), set()).add(None if item is None else str(item))
    out = {}
    for d, t in documents(rows):
        w = ALNUM.findall(t.translate(LOWER))
        marks, items = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    items |= windows[tuple(w[i : i + k])]
                    marks[i : i + k] = [True] * k
        out[d, t] = (len(w), sum(marks), len(items - {None}), sha(",".join(sorted(items - {None}))), any(marks))
    return out


def base_phrases(text):
    w = ALNUM.findall(text.translate(LOWER))
    found = []
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


# --- conversations

WRITES = {"": "u", "s": "u", "u": "a", "a": "u"}
GOES = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def damage(rows):
    """(conv, turn, role, text) after damage."""
    import zlib

    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        hit = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's rows, by a plain table from the end."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        found = SPACE.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    kinds = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
    after = {"": (0, "", ()), "s": (6, "II", (("user", ""), ("assistant", ""))), "u": (3, "I", (("assistant", ""),)), "a": (0, "", ())}
    for (_, _, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        here = {}
        for state in WRITES:
            c, a, t = after[state]
            ways = [(c + 4, "D" + a, t)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role and (state, role[0]) in GOES:
                    c, a, t = after[role[0]]
                    ways.append((c + more, "K" + a, ((role, text), *t)))
                new = WRITES[state]
                c, a, t = after[new]
                ways.append((c + more + 3, "R" + a, ((("user" if new == "u" else "assistant"), text), *t)))
            here[state] = min(ways)
        for _ in range(3):
            for state, new in WRITES.items():
                c, a, t = here[new]
                here[state] = min(here[state], (c + 3, "I" + a, (("user" if new == "u" else "assistant", ""), *t)))
        after = here
    cost, audit, turns = after[""]
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns))


def repairs(rows):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    return {c: repair(x) for c, x in by.items()}


# --- words


def variants(rows, one_in=31, least=7, count=2, times=10):
    """word -> (form, root, n, n_near, form_n)."""
    import zlib

    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= least and n >= count}
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= holes[w[:i], w[i + 1 :]] - {w}  # replaced
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out
