"""SimHash links, importance resampling and periodic runs against brute force, and on nulls, empty and long texts, ties, repeated rows, an empty table and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from gaugeframe.llm import resampling, runs, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, chunk string, prefix int, weight string, rank int, hot boolean, own string"
rng = np.random.default_rng(11)
VOCABULARY = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


BASE, SHORT = prose(300), prose(25)
TEXTS = [BASE, BASE, BASE + " tail", BASE.replace(" ", "\t", 3), " ".join(BASE.split()[1:]), None, "", " \n\t", "Eins zwei", "eins  Zwei", "ab " * 40, "x y z " * 400, prose(60_000), SHORT, "ÄB ab-cd, ef9 " + SHORT, prose(400).upper()]


def rows_of():
    rows = [(k, t, "en", "s", len(t or ""), "f", "c", 7, "w", 3, True, "o") for k, t in enumerate(TEXTS)]
    return [*rows, rows[13], rows[11], (None, SHORT, *[None] * 10), (None, None, *[None] * 10)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash_of(text, width=4):
    w = words(lower(text))
    parts = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, reach):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= reach and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


@pytest.mark.parametrize("size", [simhash.SLICE, 3000])
def test_simhash(docs, none, size):
    assert simhash.near_duplicates(none).count() == 0
    got = simhash.near_duplicates(docs, size=size).collect()
    rows = [(r[0], r[1]) for r in rows_of()]
    prints = [simhash_of(t) for _, t in rows]
    group = classes(prints, 4)
    least = {g: min((d for (d, _), h in zip(rows, group, strict=True) if h == g and d is not None), default=None) for g in group}
    want = sorted(((-1 if d is None else d), f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("size", [1 << 21, 20000])
def test_simhash_balls(spark, size):
    """Fingerprints around a few centres, and chains of distance 4 and 5, cut into slices down to single values."""
    gen = np.random.default_rng(3)
    every = set()
    for _ in range(6):
        centre = int(gen.integers(0, 1 << 63)) << 1
        for _ in range(40):
            every.add(centre ^ sum(1 << int(b) for b in gen.choice(64, int(gen.integers(0, 4)), replace=False)))
        for step in (4, 5, 4):
            centre ^= sum(1 << int(b) for b in gen.choice(64, step, replace=False))
            every.add(centre)
    every = sorted(every)
    signed = [p - (1 << 64) if p >> 63 else p for p in every]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    cut = simhash.slices(table, 2, size)
    assert sum(r.count() for _, r in cut) >= len(every) and (size > 20000 or len(cut) > 1)
    pairs = [(r["a"], r["b"]) for depth, rows in cut for r in simhash.linked(rows, depth, 4, 4).collect()]
    at, group = {p: k for k, p in enumerate(signed)}, list(range(len(every)))
    for a, b in pairs:
        x, y = group[at[a]], group[at[b]]
        group = [x if g == y else g for g in group]
    want = classes(every, 4)
    assert len(set(zip(group, want, strict=True))) == len(set(group)) == len(set(want))


def test_links_are_near():
    """Pairs that share a variant differ in at most 4 bits, and no pair that differs so little is left unconnected."""
    gen = np.random.default_rng(8)
    fp = np.unique(np.array([(1 << 63) ^ sum(1 << int(b) for b in gen.choice(20, 5, replace=False)) for _ in range(60)], np.uint64))
    pair = simhash.links(fp, np.full(len(fp), 2), 64)
    assert (np.bitwise_count(fp[pair[:, 0]] ^ fp[pair[:, 1]]) <= 4).all()
    group = list(range(len(fp)))
    for x, y in simhash.stars(pair).tolist():
        assert y < x
        group = [group[y] if g == group[x] else g for g in group]
    assert len(set(group)) == len(set(classes([int(f) for f in fp], 4)))


def feature_runs(text, longest):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return len(w), [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def resampled(rows, target, longest, buckets, percent, least_words, seed):
    cell = lambda f: zlib.crc32(f.encode()) % buckets
    found = [feature_runs(t, longest) for _, t in rows]
    s, t = Counter(cell(f) for _, x in found for f in x), Counter(cell(f) for x in target for f in feature_runs(x, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for (d, _), (n, x) in zip(rows, found, strict=True):
        weight = sum(gain(cell(f)) for f in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    order = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return out


@pytest.mark.parametrize(("longest", "percent", "least_words", "size"), [(1, 10, 20, 1 << 18), (1, 70, 2, 500), (3, 50, 0, 999), (2, 100, 1, 64)])
def test_resampling(spark, docs, none, longest, percent, least_words, size):
    target = [BASE, "eins zwei drei", None, TEXTS[12]]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resampling.resampled(docs, goal, longest, 997, percent, least_words, 5, size).collect()
    want = resampled([(r[0], r[1]) for r in rows_of()], target, longest, 997, percent, least_words, 5)
    key = lambda r: tuple(-(10**9) if v is None else v for v in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert resampling.resampled(none, goal).count() == 0 and resampling.resampled(docs, none).count() == len(rows_of())


def test_chunks_own_their_starts():
    text = (" ".join(VOCABULARY) + "," * 50 + "äö" * 40).encode()
    for size in (1, 7, 64, 10_000):
        parts = list(resampling.cut(text, size, 2))
        assert b"".join(c[:own] for c, own in parts) == text
        whole = sorted(x for f, _ in resampling.features(text, None, 3, 1 << 32) for x in f.tolist())
        assert sorted(x for c, own in parts for f, _ in resampling.features(c, own, 3, 1 << 32) for x in f.tolist()) == whole


def runs_of(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and not any(w[i : j + q - d] == w[i + d : j + q] for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("times", [2, 3, 4])
def test_runs_of_codes(times):
    gen = np.random.default_rng(times)
    for _ in range(60):
        docs = []
        for _ in range(int(gen.integers(1, 9))):
            w = gen.integers(0, int(gen.integers(1, 5)), int(gen.integers(0, 90)))
            if len(w) and gen.random() < 0.6:
                a = int(gen.integers(0, len(w)))
                w = w[np.r_[np.arange(a), a + np.arange(len(w) - a) % (1 + (len(w) - a) // int(gen.integers(2, 9)))]]
            docs.append(w.astype(np.int64))
        for d, found in zip(docs, runs.runs(docs, 6, times), strict=True):
            assert [tuple(x) for x in found.tolist()] == runs_of(d.tolist(), 6, times)


def test_minima():
    x = rng.integers(0, 50, 3000).astype(np.int32)
    x[-1] = -1
    a = rng.integers(0, 2999, 500)
    b = a + 1 + (rng.random(500) * (3000 - a - 1)).astype(int)
    m = runs.Minima(x)
    assert m.between(a, b).tolist() == [int(x[i:j].min()) for i, j in zip(a, b, strict=True)]
    assert m.next_smaller()[:-1].tolist() == [next(j for j in range(i + 1, 3000) if x[j] < x[i]) for i in range(2999)]


@pytest.mark.parametrize("tails", [False, True])
def test_periodic_runs(docs, none, tails):
    assert runs.periodic_runs(none).count() == 0
    got = runs.periodic_runs(docs, with_tails=tails, with_text=True).collect()
    assert len(got) == len(rows_of())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for d, text in [(r[0], r[1]) for r in rows_of() if r[0] not in (12, None)]:
        w = words(text)
        h = zlib.crc32(str(d).encode())
        if tails and h % 10 == 0 and w:
            g, a = h // 10, h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        found = runs_of(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        for r in by[d]:
            assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
            assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
            assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
            assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest() and r["collapsed"] == kept
            assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == found
    assert sorted(r["n_runs"] for r in by[None]) == [0, 0]
