"""The training-data operators against brute force, and on nulls, empty and long texts, repeated rows, an empty table and clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gaugeframe.llm import fingerprints, mixing, mixing_model, near_dedup, packing, quality, repair, secrets, sharding, substring_dedup
from gaugeframe.llm.tokens import WORD_BPE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, block int, text_hash string, sampled string"
rng = np.random.default_rng(5)
VOCABULARY = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(150)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


PASSAGE, BASE, NO_ID = prose(40), prose(120), "null id " + prose(25)
TEXTS = [BASE, BASE, BASE + " tail", prose(60) + " " + PASSAGE, PASSAGE + " " + prose(30), None, "", " \n\t", "One two", "one Two", "ab " * 40, prose(6000), prose(50) + ' password = "hunter2hunter2" ' + "0123456789abcdef" * 2]


def rows_of():
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), True, 7, "x", "y") for k, t in enumerate(TEXTS)]
    return [*rows, rows[3], (None, NO_ID, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_near_duplicates(docs, none):
    got = near_dedup.near_duplicates(docs, 3, 85).toPandas()
    assert len(got) == len(rows_of()) and near_dedup.near_duplicates(none).count() == 0
    by = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id")
    assert by.loc[[0, 1, 2], "component_id"].tolist() == [0, 0, 0] and by.loc[[8, 9], "component_id"].tolist() == [8, 8]
    assert by.loc[[5, 6, 7], "n_shingles"].tolist() == [0, 0, 0] and by.loc[[5, 6, 7], "kept"].all()
    assert near_dedup.deduplicate(docs).select("doc_id").distinct().count() == near_dedup.deduplicate(docs).count()


@pytest.mark.parametrize("size", [300, 1 << 22])
def test_substring_dedup(docs, none, size):
    got = {(r["doc_id"], r["n_words"]): r for r in substring_dedup.repeats(docs.dropDuplicates(["doc_id"]), 20, size).collect()}
    assert substring_dedup.repeats(none).count() == 0
    seen = set()
    for doc_id, text in sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows_of()}):
        w, gone = split(text), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone.update(range(k, k + 20))
            seen.add(x)
        row = got[(None if doc_id < 0 else doc_id, len(w))]
        assert row["n_removed"] == len(gone)
        assert row["kept_sha256"] == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


def ids_of(text):
    return np.array([*Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_packing(docs, none):
    got = packing.pack(docs.dropDuplicates(["doc_id"])).toPandas()
    assert packing.pack(none).count() == 0 and got["sequence_id"].is_unique and (got["offset"] == 0).all()
    assert all(n & (n - 1) == 0 and n <= 4096 for n in got["length"])
    for k, text in enumerate(TEXTS):
        own = got[got["doc_id"] == k].sort_values("start")
        assert b"".join(own["ids"]) == ids_of(text)
        assert all(zlib.crc32(i) == c for i, c in zip(own["ids"], own["ids_crc32"], strict=True))


def test_token_files(spark, docs, none, tmp_path):
    repair.write_tokens(docs, str(tmp_path / "t"))
    got = repair.read_tokens(spark, str(tmp_path / "t")).toPandas().sort_values("start").reset_index(drop=True)
    want = sorted(((-1 if r[0] is None else r[0], ids_of(r[1])) for r in rows_of()))
    assert got["ids"].tolist() == [x for _, x in want] and got["start"].tolist() == [0, *np.cumsum([len(x) // 4 for _, x in want])[:-1]]
    ids = np.tile(np.arange(50, dtype="<u4"), 200).tobytes()
    shard = repair.Shard(repair.to_blob([1], [10000], ids))
    assert len(shard.symbols) < 2000 and shard.decode() == ids and shard.decode_range(123, 4567) == ids[4 * 123 : 4 * 4567]
    repair.write_tokens(none, str(tmp_path / "e"))
    assert repair.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_sharding(docs, none):
    table = sharding.lookup_table(sharding.shard_names(7), 10007)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup_table(sharding.shard_names(6), 10007)
    assert np.mean([a != b for a, b in zip(table, fewer, strict=True) if a != 6]) < 0.2
    got = sharding.place(docs, sharding.shard_names(4), 101).collect()
    full = sharding.lookup_table(sharding.shard_names(4), 101)
    assert len(got) == len(rows_of()) and all(full[r["slot"]] == r["shard"] for r in got) and sharding.place(none, ["a"], 101).count() == 0


def test_mixing(docs, none):
    got = mixing.mixed(docs).toPandas()
    assert len(got) == len(rows_of()) and got["probability"].between(0, 1).all() and got["probability"].max() == 1
    assert mixing.mixed(none).count() == 0 and mixing.sampled(docs).columns == docs.columns
    cells = docs.sparkSession.createDataFrame([(s, l, "p", n) for (s, l), n in zip([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], [10, 70, 15, 5], strict=True)], "source string, lang string, topic string, tokens long")
    w = mixing.raked(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.3, "y": 0.7}, "topic": {"p": 1.0}}, rounds=30).toPandas()
    assert w.groupby("source")["weight"].sum().tolist() == pytest.approx([0.5, 0.5], abs=1e-6)
    assert w.groupby("lang")["weight"].sum().tolist() == pytest.approx([0.3, 0.7], abs=1e-6)


def test_secrets(docs, none):
    got = {r["doc_id"]: r["s"] for r in secrets.scan(docs).select("doc_id", secrets.named(F.col("found")).alias("s")).collect()}
    text = TEXTS[12]
    at, hexa = text.index("password"), text.index("0123456789abcdef")
    assert f"assign:{at}:{text.index('hunter') + 14},hex:{hexa}:{hexa + 32}" == got[12] and got[0] == "" and got[5] == ""
    assert secrets.scan(none).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    assert "hunter2" not in clean[12] and "0123456789abcdef" not in clean[12] and clean[0] == BASE and clean[5] is None


def test_markov(spark):
    value = lambda k: "".join(chr(c) for c in np.random.default_rng(k).choice([*range(48, 58), *range(65, 91), *range(97, 123)], 40))
    mixed = value(5000)
    rows = [(k, f"token = {value(k)} end") for k in range(60)] + [(100 + k, prose(60)) for k in range(60)] + [(999, f"see {mixed} here {'abcde' * 5}")]
    found = {r["doc_id"]: r["s"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.named(F.col("found")).alias("s")).collect()}
    assert found[999] == "markov:4:44" and not any(found[100 + k] for k in range(60))


def test_fingerprints(docs, none):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    for k, text in enumerate(TEXTS):
        text, after = text or "", TEXTS[(k + 1) % len(TEXTS)] or ""
        m = len(text) // 4
        assert rows[k]["n_chars"] == len(text) and rows[k]["edited_sha256"] == hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest()
        assert rows[k]["fingerprint"] == str(fingerprints.fingerprint(text)) and rows[k]["edited_fingerprint"] == str(fingerprints.fingerprint(text[: len(text) - m] + after[:m]))
    assert rows[0]["near_next"] == 1 and rows[11]["near_edited"] > 0.5 and fingerprints.fingerprints(none).count() == 0
    x, y = fingerprints.Prefix("abcdefgh" * 9), fingerprints.Prefix("zz" + "abcdefgh" * 4 + "q")
    assert fingerprints.common_extension(x, 0, y, 2) == 32 and fingerprints.same_span(x, 0, x, 8, 20) and not fingerprints.same_span(x, 0, x, 1, 20)


def test_quality(docs, none):
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert quality.judged(none).count() == 0 and not got[5]["kept"] and got[5]["n_words"] == 0 and got[10]["base_failed"] and got[10]["n_repeat_words"] == 40
    assert got[0]["kept"] and got[0]["word_chars"] == sum(map(len, BASE.split()))


def test_mixing_model(docs, none):
    held = F.col("doc_id") == 4
    got = {r["doc_id"]: r for r in mixing_model.scores(docs.dropDuplicates(["doc_id"]), held, 2000).collect()}
    assert mixing_model.scores(none).count() == 0
    train = [w for k, t in [*enumerate(TEXTS), (None, rows_of()[-1][1])] if k != 4 for w in [*split(t, True), b""]]
    count = {w: train.count(w) for w in set(train)}
    own = [*split(TEXTS[4], True), b""]
    assert got[4]["n_tokens"] == len(own) and got[4]["n_known"] == sum(w in count for w in own)
    base = sum(np.log10((count.get(w, 0) + 0.1) / (len(train) + 0.1 * (len(count) + 1))) for w in own)
    assert got[4]["train_tokens"] == len(train)
    assert got[4]["base_score"] == pytest.approx(base)
    assert got[4]["held_out"] and got[5]["score"] < 0


def test_spelling_is_a_distribution():
    m = mixing_model.Mixer(np.zeros(mixing_model.SLOTS, np.uint16))
    words = [bytes([a]) for a in range(256) if a not in b" \t\n\v\f\r"]
    assert 10.0 ** m.logs(words).sum() <= 1 and (10.0 ** m.logs(words)).sum() < 1


def test_pipeline(spark, tmp_path):
    frame = docs_frame(spark)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(out["doc_id"]) == set(kept)
    for doc_id, text in kept.items():
        assert b"".join(out[out["doc_id"] == doc_id].sort_values("start")["ids"]) == ids_of(text)


def docs_frame(spark):
    rows = [(k, prose(60 + k) + (" password=abcdefgh1234" if k % 5 == 0 else ""), "en", f"s{k % 2}", 1) for k in range(40)]
    rows += [(100 + k, rows[k][1], "en", "s0", 1) for k in range(5)] + [(200, "short", "en", "s1", 1), (201, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_raking_together_or_by_shuffles(spark, monkeypatch):
    from gaugeframe.llm import mixing

    rows = [(f"s{k % 5}" if k % 5 else None, "ab"[k % 2], "t", 10 * k + 1) for k in range(10)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").repartition(3)
    got = []
    for together in (mixing.TOGETHER, 0):
        monkeypatch.setattr(mixing, "TOGETHER", together)
        got.append({(r["source"], r["lang"]): round(r["weight"], 9) for r in mixing.raked(cells).collect()})
    assert got[0] == got[1] and len(got[0]) == 10


def test_mixer_codes_known_words_by_those_before(spark):
    own = np.random.default_rng(11)
    line = lambda: " ".join(f"{a} {own.choice(['m', x], p=[0.6, 0.4])}" for a, x in (("a", "n"), ("c", "o"))[:: own.choice([1, -1])])
    rows = [(k, " ".join(line() for _ in range(8))) for k in range(400)] + [(1000, "a n"), (1001, "c n")]
    got = {r["doc_id"]: r["score"] for r in mixing_model.scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).where("held_out").collect()}
    assert got[1000] > got[1001] + 0.2  # n is the second follower of a, and never follows c


@pytest.mark.parametrize("size", [300, 1 << 22])
def test_substring_dedup_of_every_period(spark, size):
    own = np.random.default_rng(3)
    rows = []
    for period in range(1, 41):
        line = [f"p{period}w{k}" for k in range(period)]
        own.shuffle(line)
        rows.append((period, " ".join([f"before{period}", *line * max(3, 1 + 40 // period), f"after{period}"])))
    got = {r["doc_id"]: r for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, size).collect()}
    for period, text in rows:
        w, seen, gone = split(text), set(), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone.update(range(k, k + 20))
            seen.add(x)
        assert got[period]["n_removed"] == len(gone) > 0, period
        assert got[period]["kept_sha256"] == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


@pytest.mark.parametrize("pair_bytes", [1, 1 << 20])
def test_favourite_followers_are_of_all_pairs(spark, pair_bytes):
    texts = [*["a b a b a b a c a c"] * 5, *["a d a d a d a c a c"] * 5, "x y x y x z"]  # c is nobody's favourite in any text
    train = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = {r["h"]: r for r in mixing_model._followers(train, 3, pair_bytes).collect()}
    count = {}
    for t in texts:
        w = [*split(t), b""]
        for k in (1, 2):
            for i, x in enumerate(w):
                pair = (k, w[i - k] if i >= k else b"", x)
                count[pair] = count.get(pair, 0) + 1
    of = {w: (mixing_model.hashes([w]).view(np.int64)[0], mixing_model.name([w])[0]) for w in {p[2] for p in count}}
    for w, (h, _) in of.items():
        for k in (1, 2):
            most = max((n for (d, x, _), n in count.items() if d == k and x == w), default=0)
            names = {of[y][1] for (d, x, y), n in count.items() if d == k and x == w and n == most}
            assert got[h][f"v{k}"] == most and (most == 0 or got[h][f"f{k}"] in names)
    assert got[of[b"a"][0]]["f1"] == of[b"c"][1] and got[of[b"a"][0]]["v1"] == 20


def test_new_words_are_encoded_together():
    """As the tokenizer does it, odd words included, with few calls of the model for many words."""
    import random

    import numpy as np

    from gaugeframe.llm.tokens import Encoder

    gen, e = random.Random(1), Encoder()
    pool = ["a", "B", "É", "e\u0301", "ß", "Σ", "İ", "'s", "'", "9", "٣", ".", ",", "<|endoftext|>", "<|", "\x01", "\x1c", "\x85", "\xa0", "\u2028", "\u200b", "漢", "</w>", "\x7f", "\x00", "\t", " ", "\n"]
    texts = [None, "", "  ", *["".join(gen.choices(pool, k=gen.randint(1, 30))) for _ in range(500)]]
    want = [np.array(e.tokenizer.encode(x or "", add_special_tokens=False).ids, np.uint32).tobytes() for x in texts]
    assert [ids for k in range(0, len(texts), 50) for ids in e.encode(texts[k : k + 50])] == want
    calls, model = [], e.model
    e.model = type("Counted", (), {"encode_batch_fast": lambda self, x, **more: calls.append(1) or model.encode_batch_fast(x, **more)})()
    text = " ".join("".join(gen.choices("abcdefgh", k=9)) for _ in range(8000))
    assert e.encode([text]) == [np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()] and len(calls) == 2


def test_each_block_is_scored_in_a_task_of_its_own(spark):
    from pyspark.sql import functions as F

    from gaugeframe.llm import mixing_model
    from gaugeframe.llm.common import with_block

    docs = spark.createDataFrame([(k, f"some words of text {k} and {k % 7}") for k in range(60)], "doc_id long, text string")
    block = {r["doc_id"]: r["block"] for r in with_block(docs, 200).collect()}
    got = mixing_model.scores(docs, block_bytes=200).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 60 and len(set(block.values())) > 5 and {r["doc_id"]: r["task"] for r in got} == block


def test_known_words_are_kept_and_told_apart():
    """Words of all lengths that differ in one byte; some times ``most`` words stay known, and a table that grows finds all."""
    import random

    from gaugeframe.llm import tokens

    gen, e = random.Random(2), tokens.Encoder(most=1000)
    words = ["".join(gen.choices("abcdefgh", k=9)) for _ in range(3000)]
    again = [" ".join(words[k : k + 100]) for k in range(0, 3000, 100)]
    want = [np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32).tobytes() for x in again]
    assert e.encode(again) == want
    calls, model = [], e.model
    e.model = type("Counted", (), {"encode_batch_fast": lambda self, x, **more: calls.append(1) or model.encode_batch_fast(x, **more)})()
    assert e.encode(again) == want and not calls
    odd = ["x" * n for n in range(1, 300)] + ["x" * k + "é" + "x" * (n - k) for n in (1, 7, 8, 16, 255, 257, 300) for k in range(n + 1)]
    raw = np.frombuffer((" " + " \t\r".join(odd) + " " * 9).encode(), np.uint8)
    begin, size = tokens.words_of(raw)
    h = tokens.word_hashes(raw, begin, size)
    assert [raw[b : b + n].tobytes().decode() for b, n in zip(begin.tolist(), size.tolist(), strict=True)] == odd and len(set(h.tolist())) == len(odd)
    assert tokens.word_hashes(raw[begin[250] - 1 :], *tokens.words_of(raw[begin[250] - 1 :])).tolist() == h[250:].tolist()  # wherever they stand
    found = tokens.Numbers(bits=4)
    for k in range(0, len(h), 50):
        found.add(h[k : k + 50])
    assert found.find(h).tolist() == list(range(len(h))) and (found.find(h + np.uint64(1)) == -1).all()


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    """Right components of chains, a hub and single links, by rounds whose plans name the links and the large star twice at most."""
    from gaugeframe.llm import common

    own, plans, whole = np.random.default_rng(4), [], common.materialize
    links = [(k, k + 1) for k in range(30)] + [(100, 101 + k) for k in range(40)] + [tuple(own.choice(200, 2) + 200) for _ in range(120)] + [(7, 7)]
    rows = [(f"{a:03d}".encode(), f"{b:03d}".encode()) for a, b in links]
    monkeypatch.setattr(common, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df))
    got = {bytes(r["node"]).decode(): bytes(r["root"]).decode() for r in common.components(spark.createDataFrame([*rows, (None, b"000")], "a binary, b binary")).collect()}
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {f"{x:03d}": f"{y:03d}" for x, y in root.items()}
    assert len(plans) > 3 and max(p.count("Aggregate") for p in plans) <= 6


@pytest.mark.parametrize("pack_bytes", [1, 1 << 20])
def test_rows_are_sent_compressed(spark, pack_bytes):
    """All rows of a block come back as they were, nulls and repeated rows too, in less than half their bytes where they are alike."""
    rows = [(None if k % 7 == 0 else (1 << 60) + k, "" if k % 5 == 0 else f"some words of text é {k % 50} " * 20, None if k % 3 == 0 else k % 2 == 0, k % 4) for k in range(400)] * 2
    got = mixing_model._packed(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, block int").coalesce(1), pack_bytes).toPandas()
    back = [(None if d is None else int(d), t, h, b) for b, parts in got.groupby("block") for d, t, h in mixing_model._unpacked(parts).itertuples(index=False)]
    assert sorted(map(repr, back)) == sorted(map(repr, rows))
    assert pack_bytes == 1 or got["part"].map(len).sum() < sum(len(r[1]) for r in rows) / 2
    assert not len(mixing_model._unpacked(got[:0]))
