"""Brute-force versions of the corpus operators, on small inputs."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def jaccard_classes(docs, n=5):
    """docs: [(id, text)]. {row: (class members, links)} by row number."""
    sets = []
    for _, t in docs:
        w = words(t)
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(docs))], [links[i] for i in range(len(docs))], sets


def lines_deleted(docs, least=50):
    """Numbers of deleted lines by (id, text), by comparing every run of lines with all earlier ones."""
    seen = sorted({(d is not None, d or 0, t or "") for d, t in docs}, key=lambda x: x[:2])
    rows = []
    for has, d, t in seen:
        lines = [x for line in t.split("\n") if (x := line.strip(" \t\n\x0b\x0c\r"))]
        rows.append(((d if has else None, t), lines, [len(words(x)) for x in lines]))
    gone = defaultdict(set)
    for a, (key, lines, count) in enumerate(rows):
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(count[i:j]) < least:
                    continue
                run = lines[i:j]
                first = next((b, k) for b, (_, other, _) in enumerate(rows) for k in range(len(other)) if other[k : k + j - i] == run)
                if first[0] < a or (first[0] == a and i >= first[1] + (j - i)):
                    gone[key].update(range(i, j))
    return {key: len(gone[key]) for key, _, _ in rows}


def quality_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n_words, repeat = len(w), len(covered)
    return {
        "n_words": n_words,
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat,
        "base_failed": n_words < 10 or 100 * repeat > 20 * n_words,
    }


def damaged_rows(rows):
    """rows: [(conv_id, turn, role, text)]. {conv_id: rows after damage, by turn (nulls first), role and SHA-256 of the text}."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        said = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return out


def repaired_conversation(rows):
    """The contract's columns of one conversation by a search over all edits, least cost first and then the least audit."""
    faults, seen = [], set()
    for _, role, text in rows:
        word = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not word else "duplicate" if (role, text) in seen else "" if word[-1] in ".!?" else "truncated")
        seen.add((role, text))
    allowed = re.compile(r"(s?(ua)*u?)?")  # beginnings of what the pattern asks for
    heap = [(0, "", 0, "", [])]
    found = None
    done = set()
    while heap:
        cost, audit, k, shape, made = heapq.heappop(heap)
        if (k, shape) in done:
            continue
        done.add((k, shape))
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", shape):
            found = cost, audit, made
            break
        steps = [("I", 5, k, r[0], (r, "")) for r in ("user", "assistant")]
        if k < len(rows):
            _, role, text = rows[k]
            steps.append(("D", 2, k + 1, "", None))
            if faults[k] not in ("blank", "duplicate"):
                more = 5 * (faults[k] == "truncated")
                steps.append(("K", more, k + 1, role[:1] or "-", (role, text)))
                steps += [("R", 1 + more, k + 1, r[0], (r, text)) for r in ("user", "assistant")]
        for name, price, to, initial, row in steps:
            if allowed.fullmatch(shape + initial):
                whole = shape + initial
                whole = "ua" if whole.endswith("ua") else "u" if whole.endswith("u") else whole  # what follows asks for no more
                heapq.heappush(heap, (cost + price, audit + name, to, whole, [*made, row] if row else made))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, made = found
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    }
