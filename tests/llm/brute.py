"""Plain Python versions of what the queries return, for small tables."""

import hashlib
import re
import unicodedata

from lamina.llm.pii import MAX_WORDS, Places, base_spans, joined, pattern_names, positions, sides, units

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def digest(spans, kinds):
    ordered = sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at, covered = {}, set()
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for found in at.values():
        if len(found) > 1:
            covered.update(j for i in found for j in range(i, i + 8))
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def features(text):
    n, chars, symbols, dup, repeat, _ = quality(text)
    w, lines = words(text), max(1, sum(bool(WORD.search(x)) for x in (text or "").split("\n")))
    upper = sum(unicodedata.category(c) == "Lu" for c in text or "")
    digits = sum(c in "0123456789" for c in text or "")
    of_words, of_chars = max(1, n), max(1, chars)
    return {
        "n_words": n, "mean_word": chars / of_words, "symbol_share": symbols / of_chars, "upper_share": upper / of_chars, "digit_share": digits / of_chars,
        "dup_line_share": dup / lines, "repeat_share": repeat / of_words, "distinct_share": len(set(w)) / of_words, "words_per_line": n / lines,
    }


SECRET_KINDS = ["assign", "access", "hex", "opaque"]
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def secret_values(text):
    """(kind, start, end, value) of base spans, and of opaque runs that touch none."""
    text = text or ""
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(k, a, b, text[a:b]) for k, a, b in secrets(text) if k != "assign"]
    last = max((b for _, _, b, _ in out), default=0)
    taken = bytearray(last + 1)
    for _, a, b, _ in out:
        taken[a:b] = b"1" * (b - a)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and not any(taken[m.start() : m.end()]):
            out.append(("opaque", m.start(), m.end(), m[0]))
    return out


def looks_live(value):
    low = value.lower()
    rest = re.sub("x{4,}|0{4,}|0?1234567(?:89?0?)?(?:abcdef)?", "", low)
    named = any(w in low for w in ("example", "sample", "dummy", "placeholder", "changeme", "your_"))
    return len(set(value)) >= 5 and 2 * len(rest) > len(value) and not named


def shingle_set(text, width=4):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(docs, width=4, percent=80):
    """doc_id -> (size, least reachable id), by an inverted index over all shingles."""
    sets = {k: shingle_set(t, width) for k, t in docs.items()}
    index = {}
    for k, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(k)
    shared = {}
    for found in index.values():
        for i, a in enumerate(found):
            for b in found[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


PII_KINDS = ["email", "ip", "card", "phone", "learned"]


def luhn(digits):
    n = [int(d) for d in digits]
    n[-2::-2] = [sum(divmod(2 * d, 10)) for d in n[-2::-2]]
    return sum(n) % 10 == 0


def pii(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def bootstrap(texts, rounds=10, min_support=3, min_confidence=0.6, min_score=0.75):
    """(text number, start, end) of what patterns discover, with dictionaries over all slots of all texts."""
    read = []
    fillers, around = {}, {}  # pattern -> what fills it, instance -> patterns it stands in
    for n, text in enumerate(texts):
        base = base_spans(text or "")
        tokens = Places().tokens(text or "", base)
        ends = units(tokens)
        begins = {e: b for b, e in enumerate(ends) if e > b}
        name = lambda i, j, t=tokens: " ".join(x.core for x in t[i : j + 1]).lower()
        slots, shortest = [], set()
        for i, t in enumerate(tokens):
            if not t.core:
                continue
            j = i
            while True:
                made = {p[0]: p for p in pattern_names(*sides(tokens, i, j))}
                kinds = "3" + ("12" if j == ends[i] else "") + ("45" if i == begins.get(j, j) else "")
                for k in kinds:
                    if k in made:
                        around.setdefault(name(i, j), set()).add(made[k])
                        if k != "3" or (made[k], i) not in shortest:
                            shortest.add((made[k], i))
                            slots.append((made[k], i, j))
                            fillers.setdefault(made[k], set()).add(name(i, j))
                if j + 1 - i >= MAX_WORDS or not joined(tokens, j):
                    break
                j += 1
        read.append((tokens, slots, positions(text or "", base), name))
    seeds = {name(i, i) for tokens, _, _, name in read for i, t in enumerate(tokens) if t.shape == 3}
    score = {s: 1.0 for s in seeds}
    touched = {(p, s) for s in seeds for p in around[s]}
    strong, last = {}, None
    for _ in range(rounds):
        by = {}
        for p, s in touched:
            by.setdefault(p, set()).add(s)
        wanted = [p for p, known in by.items() if sum(score[s] >= min_score for s in known) >= min_support]
        confidence = {p: sum(score.get(x, 0) for x in fillers[p]) / (len(fillers[p]) + 1) for p in wanted}
        strong = {p: c for p, c in confidence.items() if c >= min_confidence}
        miss = {}
        for p, c in strong.items():
            for x in fillers[p]:
                miss[x] = miss.get(x, 1.0) * (1 - c)
        fresh = {x for x in miss if x not in score}
        for x, m in miss.items():
            score[x] = max(score.get(x, 0), 1 - m)
        touched |= {(p, x) for x in fresh for p in around[x]}
        pairs = {(p, x) for p in strong for x in fillers[p] if score[x] >= min_score}
        if pairs == last:
            break
        last = pairs
    out = set()
    for n, (tokens, slots, at, name) in enumerate(read):
        hits = {(at[i][0], at[j][1]) for p, i, j in slots if p in strong and tokens[i].shape != 3 and name(i, j) not in seeds and score[name(i, j)] >= min_score}
        end = -1
        for a, b in sorted(hits, key=lambda s: (s[0], -s[1])):
            if b > end:
                out.add((n, a, b))
                end = b
    return out
