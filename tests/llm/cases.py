"""Small tables with every awkward row, and plain versions of what the operators compute."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, n long, word string"


def words(text):
    return WORD.findall((text or "").encode())


def lowered(text):
    return [w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words(text)]


def awkward(seed=0):
    """Documents with nulls, blanks, long texts, copies, near copies, shared lines, equal ids and clashing columns."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = make(120)
    near = base.split()
    near[60] = "changed"
    shared = make(30)
    texts = [None, "", "  \n\t ", "one", "two words", base, base, " ".join(near), base.upper(), make(3000), f"{shared}\n{make(60)}", f"{make(60)}\n{shared}\n{shared}", "same same same " * 40, "### $$$ % & | <> " * 10, "é ü ñ ß " * 30, "</s>[INST] x [/INST] <|im_end|>"]
    texts += [make(r.randint(1, 200)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "h", 1, "w") for i, t in enumerate(texts)]
    rows += [rows[5], rows[10], (None, base, None, None, None, None, None, None)]
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS).repartition(3)


def shingle_set(text, width):
    w = lowered(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def near_components(rows, width, percent=80):
    """Component by doc_id, by comparing all pairs."""
    sets = {i: shingle_set(t, width) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, sets


def removed_lines(rows, percent=80, min_words=3):
    """Line numbers that go, of each row of (id, text) with ids that don't repeat, comparing every line with all earlier ones."""
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        gone = []
        for k, line in enumerate((text or "").split("\n")):
            w = lowered(line)
            if len(w) < min_words:
                continue
            s = frozenset(w)
            if any(100 * len(s & t) >= percent * len(s | t) for t in seen):
                gone.append(k)
            seen.append(s)
        out[i] = gone
    return out


def base_counts(text):
    raw = text or ""
    w = words(raw)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in raw.split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(raw.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def conversations(seed=1):
    """Conversations with null ids, turns, roles and texts, other roles, ties, repeated rows and one of 300 rows."""
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    texts = [None, "", " ", "a.", "b!", "c", "d?", "e. ", "f\n", "</s>.", "\t\x0b"]
    rows = [(c or None, r.choice([None, *range(12)]), r.choice(roles), r.choice(texts), "x", 1) for c in range(60) for _ in range(r.randint(1, 16))]
    rows += [(99, k, r.choice(["user", "assistant", "tool"]), r.choice([f"{k}.", f"{k}", "x.", ""]), None, None) for k in range(300)]
    return rows + rows[:5]


CONVERSATIONS = "conv_id long, turn long, role string, text string, k string, row long"
_NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
_ROLE = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def cheapest(rows):
    """Faults, cost, audit and lines of one conversation's rows (turn, role, text): all edits, the least of (cost, audit) in front of each row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        ink = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else None if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    insert = lambda s, rest: (rest[0] + 3, "I" + rest[1], (_ROLE[_NEXT[s]] + ":", *rest[2]))
    behind = {s: (0, "", ()) for s in ("", "a")}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            (_, role, text), fault, now = rows[i], faults[i], {}
            for s in _NEXT:
                ways = [(behind[s][0] + 4, "D" + behind[s][1], behind[s][2])]
                if fault in (None, "truncated"):
                    extra, to = 3 * (fault is not None), _NEXT[s]
                    if role[:1] == to or (role[:1] == "s" and not s):
                        rest = behind[role[:1]]
                        ways.append((rest[0] + extra, "K" + rest[1], (f"{role}:{text}", *rest[2])))
                    ways.append((behind[to][0] + 3 + extra, "R" + behind[to][1], (f"{_ROLE[to]}:{text}", *behind[to][2])))
                now[s] = min(ways, key=lambda w: w[:2])
            behind = now
        for _ in range(3):  # inserts in front, one more each time
            behind |= {s: min([*([behind[s]] if s in behind else []), insert(s, behind[_NEXT[s]])], key=lambda w: w[:2]) for s in _NEXT if _NEXT[s] in behind}
    return rows, faults, behind[""]


def repaired_digests(rows):
    """What op11 returns, by conversation."""
    by = {r[0]: [] for r in rows}
    for conv, *rest in damaged(rows):
        by[conv].append(tuple(rest))
    out = {}
    for conv, mine in by.items():
        ordered, faults, (cost, audit, lines) = cheapest(mine)
        turns, first = [t for t, _, _ in ordered if t is not None], [r[:1] for _, r, _ in ordered]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def importance(rows, target):
    """(doc_id, n_features, weight, score, rank) of rows of (doc_id, text)."""

    def buckets(text):
        w = plain_words(text)
        return [zlib.crc32(f) % 10_000 for f in w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]]

    all_, goal = Counter(b for _, t in rows for b in buckets(t)), Counter(b for t in target for b in buckets(t))
    n, m = sum(all_.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1.0) * (n + 10_000.0) / ((all_[b] + 1.0) * (m + 10_000.0)))) for b in range(10_000)]
    found = []
    for i, text in rows:
        f = buckets(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(plain_words(text)), hashlib.md5((text or "").encode()).hexdigest()])
    able = sorted((r for r in found if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(able[: len(able) * 25 // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in found), key=repr)
