"""Plain-Python versions of what the training-data operators decide."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from gaugeframe.llm import secrets

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def lowered(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]


def near_duplicates(rows, width, percent):
    """rows: (doc_id, text). component_id by place in rows."""
    sets = []
    for _, text in rows:
        w = lowered(text)
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append(min(ids) if sets[i] and ids else None if sets[i] else doc_id)
    return out, [len(s) for s in sets], group


class KneserNey:
    """Modified Kneser-Ney over character trigrams, by dictionaries."""

    def __init__(self, texts):
        self.n = [None, Counter(), Counter(), Counter()]
        for text in texts:
            for w in (text or "").encode().lower().split():
                s = symbols(w)
                for k in range(2, len(s)):
                    self.n[3][tuple(s[k - 2 : k + 1])] += 1
        for size in (2, 1):
            for g in self.n[size + 1]:
                self.n[size][g[1:]] += 1
        self.cut, self.total, self.rest = [None], [None], [None]
        for size in (1, 2, 3):
            of = [None, *(max(1, sum(c == k for c in self.n[size].values())) for k in (1, 2, 3, 4))]
            y = of[1] / (of[1] + 2 * of[2])
            self.cut.append([0, *(min(k - 0.05, max(0.05, k - (k + 1) * y * of[k + 1] / of[k])) for k in (1, 2, 3))])
            total, rest = Counter(), defaultdict(float)
            for g, c in self.n[size].items():
                total[g[:-1]] += c
                rest[g[:-1]] += self.cut[size][min(c, 3)]
            self.total.append(total)
            self.rest.append(rest)

    def probability(self, g):
        if not g:
            return 1 / 2**21
        size, below = len(g), self.probability(g[1:])
        if not self.total[size][g[:-1]]:
            return below
        c = self.n[size][g]
        return ((c - self.cut[size][min(c, 3)]) + self.rest[size][g[:-1]] * below) / self.total[size][g[:-1]]


def symbols(word):
    return [0, 0, *(48 if "0" <= c <= "9" else ord(c) for c in word.decode().lower()), 0]


def base_counts(text):
    w, seen, twins = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            twins += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), twins, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def quality(rows, below, above):
    """rows: (text, lang). (base counts, log perplexity, kept) for each."""
    every = KneserNey([t for t, _ in rows])
    own = {lang: KneserNey([t for t, x in rows if x == lang]) for lang in {x for _, x in rows}}
    cost, counts = [], [base_counts(t) for t, _ in rows]
    for text, lang in rows:
        total = letters = 0
        for w in (text or "").encode().lower().split():
            s = symbols(w)
            grams = [tuple(s[k - 2 : k + 1]) for k in range(2, len(s))]
            mine, all_ = (math.prod(m.probability(g) for g in grams) for m in (own[lang], every))
            total -= math.log(0.7 * mine + 0.3 * all_)
            letters += sum(chr(c).isalnum() for c in s[2:])
        cost.append(total / max(1, letters) if words(text) else None)
    kept = []
    for (_, lang), c, x in zip(rows, counts, cost, strict=True):
        own_costs = sorted(y for (_, l), d, y in zip(rows, counts, cost, strict=True) if l == lang and not d[5])
        if not own_costs or c[5]:
            kept.append(False)
            continue
        q = [own_costs[max(0, math.ceil(p * len(own_costs)) - 1)] for p in (0.25, 0.75)]
        reach = max(q[1] - q[0], 0.02)
        kept.append(q[0] - below * reach <= x <= q[1] + above * reach)
    return counts, cost, kept


def ratios(sample):
    """sample: (token, random). Log-likelihood ratios by pairs of places in the alphabet."""
    n = [defaultdict(float), defaultdict(float)]
    place = lambda c: secrets.ALPHABET.find(c) + 1
    for token, random in sample:
        for a, b in zip(token, token[1:], strict=False):
            n[random][place(a), place(b)] += 1
    out, wide = {}, range(len(secrets.ALPHABET) + 1)
    for a in wide:
        for b in wide:
            logs = []
            for m in n:
                every = sum(m.values()) + 0.5 * len(wide)
                char = (sum(v for (_, y), v in m.items() if y == b) + 0.5) / every
                logs.append(math.log((m.get((a, b), 0) + secrets.BACK * char) / (sum(v for (x, _), v in m.items() if x == a) + secrets.BACK)))
            out[a, b] = logs[1] - logs[0]
    return out


def base_spans(text):
    out = []
    for kind, (_, pattern, group, least) in enumerate(secrets.KINDS):
        out += [(m.start(), kind, m.end(), m.start(group)) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return out


def spans(text, ratio):
    out = base_spans(text)
    for m in re.finditer(secrets.LONG, text or ""):
        t = m[0]
        if re.search("[A-Za-z]", t) and re.search("[0-9]", t) and not re.search(secrets.UUID, t) and not any(a < m.end() and m.start() < b for a, _, b, _ in out if _ < 3):
            llr = sum(ratio[secrets.ALPHABET.find(a) + 1, secrets.ALPHABET.find(b) + 1] for a, b in zip(t, t[1:], strict=False))
            if llr >= secrets.LIKELIER and llr >= secrets.EACH * (len(t) - 1):
                out.append((m.start(), 3, m.end(), m.start()))
    return sorted(out)


def masked(text, found):
    if not found:
        return text
    out, at = "", 0
    for value, end in sorted((v, e) for _, _, e, v in found):
        if end > at:
            out += text[at:value] + ("[SECRET]" if value >= at else "")
            at = max(at, end)
    return out + text[at:]


def topic(text):
    return next((name for name, mark in (("table", " | "), ("links", "://"), ("license", "opyright")) if mark in (text or "")), "prose")


def sampled(rows, rounds=10, smoothing=0.9):
    """rows: (doc_id, text, lang, source). Whether each is sampled."""
    cell = [(s, l, topic(t)) for _, t, l, s in rows]
    tokens = defaultdict(int)
    for c, (_, t, _, _) in zip(cell, rows, strict=True):
        tokens[c] += len(words(t))
    tokens = {c: n for c, n in tokens.items() if n}
    weight, total = dict(tokens), sum(tokens.values())
    goals = []
    for m in range(3):
        share = defaultdict(int)
        for c, n in tokens.items():
            share[c[m]] += n
        power = {v: (n / total) ** smoothing for v, n in share.items()}
        goals.append({v: p / sum(power.values()) for v, p in power.items()})
    for _ in range(rounds):
        for m in range(3):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[m]] += w
            weight = {c: w * goals[m][c[m]] / sums[c[m]] for c, w in weight.items()}
    most = max(weight[c] / n for c, n in tokens.items()) if tokens else 1
    chance = {c: weight[c] / n / most for c, n in tokens.items()}
    number = lambda d, t: int(hashlib.md5((str(d) if d is not None else "text:" + hashlib.md5((t or "").encode()).hexdigest()).encode()).hexdigest()[:12], 16) / 2**48
    return [number(d, t) < chance.get(c, 1.0) for c, (d, t, _, _) in zip(cell, rows, strict=True)]
