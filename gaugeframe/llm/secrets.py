"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio. DataFrame operations alone.

Two models of character pairs, one of random strings and one of ordinary identifiers, are trained from labelled samples. Random: the values
that the fixed patterns find, and ``MADE`` strings cut from digests in several alphabets. Ordinary: digitless words of documents in which the patterns find nothing,
and ``MADE`` identifiers with digits (paths, versions, dates, numbered and camel-case names) put together from such words and ``TECHNICAL`` ones.
Long tokens with letters and digits that no pattern covers are reported as kind ``markov`` where random is likelier by ``LIKELIER`` nats in
all and ``EACH`` for each pair; those in the shape of a UUID are names by convention and left alone.

The samples come from about ``SAMPLE`` different texts (chosen by a hash of the text; copies count once, so the bound holds whatever is repeated, and does not grow with the
table); the scan reads every whole text. ``evaluated`` trains on four fifths of the labelled samples and gives precision and recall on the rest.

Spans are code points, end exclusive. Defined results: null or empty text: no spans. Very long texts: whole. Overlaps: base spans all stay, a markov span that touches one goes.
A table without labelled values trains from the made samples. Null doc_id and repeated rows are scanned like any other, an empty table stays empty. All columns stay, whatever their names, but
``found``, which ``scan`` replaces; ``redacted`` returns the columns of ``docs`` and changes ``text`` alone, and ``n_chars`` where there is one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm.common import materialize

#: The patterns. (kind, pattern, group of the value, least characters of it)
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: What may be a secret besides, if it has a letter and a digit, unless it is a UUID.
LONG = r"[A-Za-z0-9+/_=-]{16,}"
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Words that stand for themselves in identifiers, beside those of the documents.
TECHNICAL = (
    "access", "account", "api", "app", "archive", "backup", "branch", "build", "cache", "chapter", "client", "cluster", "config", "core", "dashboard", "data", "default", "demo", "deployment", "encoding",
    "error", "export", "feature", "file", "final", "gnu", "graph", "group", "history", "image", "index", "input", "iso", "job", "kernel", "key", "kubernetes", "layer", "library", "linux", "local", "log", "main",
    "manager", "model", "module", "network", "node", "order", "output", "page", "part", "photo", "platform", "profile", "project", "public", "query", "region", "release", "report", "request", "result", "row",
    "sample", "section", "server", "service", "session", "source", "stable", "static", "storage", "system", "table", "task", "test", "thumb", "token", "train", "unknown", "update", "upload", "user", "value", "verse",
    "version", "video", "view", "web", "window", "worker",
)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-/"
WIDTH = len(ALPHABET) + 1
SAMPLE, MADE = 8000, 4000
LIKELIER, EACH = 12.0, 0.5
#: Weight of single characters behind pairs.
BACK = 5.0
SPANS = "array<struct<start:int,kind:int,end:int,value:int>>"


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """All matches of ``pattern`` whose value has ``least`` characters: (start, kind, end, start of the value)."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["all"]), F.lit(0))
        found = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), (end - F.length(x["value"])).alias("value"))
        good = F.length(x["value"]) >= least
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(found))).otherwise(acc["spans"]).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    found = F.aggregate(parts, first, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    return F.concat(*[_spans(text, pattern, group, least, k) for k, (_, pattern, group, least) in enumerate(KINDS)])


def _codes(token: Column) -> Column:
    """Pairs of neighbouring characters as numbers below WIDTH squared; characters outside the alphabet count as one."""
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: a * WIDTH + b)


def _number(salt: str, most: int) -> Column:
    """A number below ``most`` for each row ``i``, by a digest."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("i").cast("string"), F.lit(":" + salt))), 1, 8), 16, 10).cast("long"), F.lit(most)).cast("string")


def made_ordinary(spark: SparkSession, n: int = MADE) -> DataFrame:
    """(token): identifiers with digits in nine forms."""
    words = F.array(*map(F.lit, TECHNICAL))
    rows = spark.range(n).withColumnRenamed("id", "i")
    rows = materialize(rows.withColumns({f"w{k}": F.get(words, _number(f"w{k}", len(TECHNICAL)).cast("int")) for k in range(3)}))  # else each form would hold the words thrice
    w = [F.col(f"w{k}") for k in range(3)]
    number = lambda k, most: _number(f"n{k}", most)
    padded = lambda k, most: F.lpad(number(k, most), 2, "0")
    year = (number(0, 40).cast("int") + 1990).cast("string")
    joined = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [
        joined(w[0], "_", w[1], "_", year, "_v", number(1, 10), "_", w[2]),
        joined(w[0], "-", w[1], "-v", number(0, 10), "-", number(1, 100), "-", number(2, 10)),
        joined(year, "-", padded(1, 12), "-", padded(2, 28), "T", padded(3, 24), "-", padded(4, 60), "-", padded(5, 60), "Z"),
        joined(F.initcap(w[0]), number(0, 100), "-", F.initcap(w[1]), number(1, 100), "-", F.initcap(w[2]), number(2, 1000)),
        joined(w[0], "/", w[1], "/", year, "/", padded(1, 12), "/", F.upper(w[2]), "_", number(3, 100000)),
        joined(w[0], number(0, 100), "_", number(1, 64), "-", w[1], "-", w[2]),
        joined(w[0], number(0, 10000), "_", number(1, 20), "_", w[1], "_", w[2]),
        joined(w[0], F.initcap(w[1]), F.initcap(w[2]), number(0, 1000)),
        joined(F.substring(F.lit(ALPHABET), number(0, 10).cast("int") + 1, number(1, 12).cast("int") + 6), number(2, 1000)),
    ]
    return rows.select(F.coalesce(*[F.when(F.col("i") % len(forms) == k, x) for k, x in enumerate(forms)]).alias("token"))


def made_random(spark: SparkSession, n: int = MADE) -> DataFrame:
    """(token): strings of 20 to 40 characters cut from digests: base 64, letters and digits, lower-case hexadecimal, upper case and digits."""
    digest = F.sha2(F.concat(F.lit("random:"), F.col("i").cast("string")), 256)
    code = F.base64(F.unhex(digest))
    forms = [code, F.regexp_replace(code, "[+/=]", ""), digest, F.regexp_replace(F.upper(code), "[+/=]", "")]
    length = _number("length", 21).cast("int") + 20
    form = F.coalesce(*[F.when(F.col("i") % len(forms) == k, F.substring(x, F.lit(1), length)) for k, x in enumerate(forms)])
    return spark.range(n).select(F.col("id").alias("i")).select(form.alias("token"))


def labelled(docs: DataFrame) -> DataFrame:
    """(token, random): the labelled samples."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.md5(text).alias("md5"))
    n = rows.count()
    sample = rows.where(F.pmod(F.conv(F.substring("md5", 1, 8), 16, 10).cast("long"), F.lit(max(1, n // SAMPLE))) == 0).dropDuplicates(["md5"])
    none = F.array().cast("array<string>")
    values = F.concat(*[F.when(F.col("text").rlike(p), F.regexp_extract_all("text", F.lit(p), F.lit(g))).otherwise(none) for _, p, g, _ in KINDS])
    plain = F.transform(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w.rlike("^[A-Za-z_]{4,}[.,]?$")), lambda w: F.regexp_replace(w, "[.,]", ""))
    sample = sample.withColumn("values", values)
    found = sample.select(F.explode("values").alias("token"), F.lit(1).alias("random")).unionByName(sample.where(F.size("values") == 0).select(F.explode(plain).alias("token"), F.lit(0).alias("random")))
    made = made_ordinary(docs.sparkSession).withColumn("random", F.lit(0)).unionByName(made_random(docs.sparkSession).withColumn("random", F.lit(1)))
    return found.unionByName(made).where("length(token) >= 4")


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of all pairs."""
    return ratios_of(labelled(docs))


def ratios_of(sample: DataFrame) -> list[float]:
    pairs = sample.select("random", F.explode(_codes(F.col("token"))).alias("pair"))
    count = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}  # WIDTH squared for each class at most
    logs = []
    for random in (0, 1):
        n = [[count.get((random, a * WIDTH + b), 0) for b in range(WIDTH)] for a in range(WIDTH)]
        every = sum(map(sum, n)) + 0.5 * WIDTH
        char = [(sum(row[b] for row in n) + 0.5) / every for b in range(WIDTH)]  # pairs not seen fall back on their second character
        logs.append([math.log((n[a][b] + BACK * char[b]) / (sum(n[a]) + BACK)) for a in range(WIDTH) for b in range(WIDTH)])
    return [x - y for x, y in zip(logs[1], logs[0], strict=True)]


def seems_random(token: Column, ratios: list[float]) -> Column:
    """Whether the models take a token for a random string."""
    model = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")
    pairs = _codes(token)
    ratio = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.get(model, p))
    return token.rlike("[A-Za-z]") & token.rlike("[0-9]") & ~token.rlike(UUID) & (ratio >= LIKELIER) & (ratio >= EACH * F.size(pairs))


def evaluated(docs: DataFrame) -> DataFrame:
    """One row: precision and recall of ``seems_random`` on tokens that ``scan`` would judge, of the fifth of the labelled samples that training did not see."""
    sample = labelled(docs).withColumn("fold", F.pmod(F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long"), F.lit(5)))
    ratios = ratios_of(sample.where("fold <> 0"))
    judged = sample.where((F.col("fold") == 0) & F.col("token").rlike(f"^{LONG}$") & F.col("token").rlike("[A-Za-z]") & F.col("token").rlike("[0-9]")).withColumn("said", seems_random(F.col("token"), ratios))
    hit = F.count_if(F.col("said") & (F.col("random") == 1))
    return judged.agg(F.try_divide(hit, F.count_if("said")).alias("precision"), F.try_divide(hit, F.count_if(F.col("random") == 1)).alias("recall"), F.count("*").alias("tokens"))


def _found(docs: DataFrame, ratios: list[float] | None) -> DataFrame:
    """``docs`` with __found."""
    ratios = train(docs) if ratios is None else ratios
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("__base", base_spans(text)).withColumn("__long", _spans(text, LONG, 0, 16, len(KINDS)))
    random = lambda s: seems_random(F.substring(text, s["start"] + 1, s["end"] - s["start"]), ratios) & ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return out.withColumn("__found", F.array_sort(F.concat("__base", F.filter("__long", random)))).drop("__long", "__base")


def scan(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with ``found``: spans (start, kind, end, value) by start and kind; kinds are KINDS in order, then markov."""
    return _found(docs, ratios).drop("found").withColumnRenamed("__found", "found")


def named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("markov"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the values of all spans in ``text`` replaced by ``mask``, and n_chars counted anew; same rows and columns."""
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.greatest(s["value"] - acc["at"], F.lit(0))), F.when(s["value"] >= acc["at"], mask).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] > acc["at"], more).otherwise(acc["text"]).alias("text"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    clean = F.aggregate(F.array_sort(F.transform("__found", lambda s: F.struct(s["value"].alias("value"), s["end"].alias("end")))), first, step, lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = _found(docs, None).withColumn("text", F.when(F.size("__found") > 0, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL for the query of the scan: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    ctes = ["d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    for k, (name, pattern, group, least) in enumerate((*KINDS, ("markov", LONG, 0, 16))):
        ctes.append(f"""m{k} AS (SELECT r, text, generate_subscripts(x, 1) AS j, unnest(x) AS x, unnest(v) AS v, unnest(gap[1:len(x)]) AS gap FROM
        (SELECT r, text, regexp_extract_all(text, {q(pattern)}, 0) AS x, regexp_extract_all(text, {q(pattern)}, {group}) AS v, string_split_regex(text, {q(pattern)}) AS gap FROM d))""")
        ctes.append(f"""s{k} AS (SELECT r, text, {k} AS kind, '{name}' AS name, x, ends - length(x) AS start, ends AS "end" FROM (SELECT *, sum(length(gap) + length(x)) OVER (PARTITION BY r ORDER BY j)::BIGINT AS ends FROM m{k}) WHERE length(v) >= {least})""")
    words = ", ".join(map(q, TECHNICAL))
    ctes.append("base AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)")
    ctes.append(f"""sample AS (SELECT DISTINCT text FROM d WHERE ('0x' || left(md5(text), 8))::BIGINT % (SELECT greatest(1, count(*) // {SAMPLE}) FROM d) = 0)""")
    ctes.append(f"""hits AS (SELECT text, {" || ".join(f"regexp_extract_all(text, {q(p)}, {g})" for _, p, g, _ in KINDS)} AS v FROM sample)""")
    number = lambda salt, most: f"(('0x' || left(md5(i || ':{salt}'), 8))::BIGINT % {most})"
    w = [f"w[1 + {number(f'w{k}', len(TECHNICAL))}]" for k in range(3)]
    n = lambda k, most: f"{number(f'n{k}', most)}"
    two = lambda k, most: f"lpad({n(k, most)}::VARCHAR, 2, '0')"
    cap = lambda x: f"(upper(left({x}, 1)) || substr({x}, 2))"
    year = f"({n(0, 40)} + 1990)"
    forms = [
        [w[0], "'_'", w[1], "'_'", year, "'_v'", n(1, 10), "'_'", w[2]],
        [w[0], "'-'", w[1], "'-v'", n(0, 10), "'-'", n(1, 100), "'-'", n(2, 10)],
        [year, "'-'", two(1, 12), "'-'", two(2, 28), "'T'", two(3, 24), "'-'", two(4, 60), "'-'", two(5, 60), "'Z'"],
        [cap(w[0]), n(0, 100), "'-'", cap(w[1]), n(1, 100), "'-'", cap(w[2]), n(2, 1000)],
        [w[0], "'/'", w[1], "'/'", year, "'/'", two(1, 12), "'/'", f"upper({w[2]})", "'_'", n(3, 100000)],
        [w[0], n(0, 100), "'_'", n(1, 64), "'-'", w[1], "'-'", w[2]],
        [w[0], n(0, 10000), "'_'", n(1, 20), "'_'", w[1], "'_'", w[2]],
        [w[0], cap(w[1]), cap(w[2]), n(0, 1000)],
        [f"substr({q(ALPHABET)}, {n(0, 10)}::INT + 1, {n(1, 12)}::INT + 6)", n(2, 1000)],
    ]
    made = " ".join(f"WHEN {k} THEN concat({', '.join(f)})" for k, f in enumerate(forms))
    strip = lambda x: f"regexp_replace({x}, '[+/=]', '', 'g')"
    ctes.append(f"""lab AS (SELECT unnest(v) AS token, 1 AS random FROM hits UNION ALL
        SELECT unnest(list_transform(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: regexp_full_match(x, '[A-Za-z_]{{4,}}[.,]?')), lambda x: regexp_replace(x, '[.,]', ''))), 0 FROM hits WHERE len(v) = 0 UNION ALL
        SELECT CASE i % {len(forms)} {made} END, 0 FROM (SELECT i, [{words}] AS w FROM range({MADE}) t(i)) UNION ALL
        SELECT left(CASE i % 4 WHEN 0 THEN c WHEN 1 THEN {strip("c")} WHEN 2 THEN h ELSE {strip("upper(c)")} END, ({number("length", 21)} + 20)::INT), 1 FROM (SELECT i, sha256('random:' || i) AS h, base64(from_hex(sha256('random:' || i))) AS c FROM range({MADE}) t(i)))""")
    ctes.append(f"a AS (SELECT {q(ALPHABET)} AS abc)")
    ctes.append(f"""pairs AS (SELECT random, instr(abc, substr(token, j::INT, 1)) AS x, instr(abc, substr(token, (j + 1)::INT, 1)) AS y, count(*) AS n FROM (SELECT token, random, unnest(range(1, length(token))) AS j FROM lab WHERE length(token) >= 4), a GROUP BY ALL)""")
    ctes.append(f"""chars AS (SELECT random, y, (coalesce(n, 0) + 0.5) / (t.total + 0.5 * {WIDTH}) AS p FROM (SELECT random, total, y::BIGINT AS y FROM (SELECT random, sum(n) AS total FROM pairs GROUP BY random), range({WIDTH}) u(y)) t LEFT JOIN (SELECT random, y, sum(n) AS n FROM pairs GROUP BY random, y) USING (random, y))""")
    ctes.append(f"""model AS (SELECT x.x, c.y, sum((CASE c.random WHEN 1 THEN 1 ELSE -1 END) * ln((coalesce(p.n, 0) + {BACK} * c.p) / (coalesce(r.n, 0) + {BACK}))) AS ratio FROM chars c CROSS JOIN (SELECT x::BIGINT AS x FROM range({WIDTH}) u(x)) x
        LEFT JOIN pairs p ON p.random = c.random AND p.x = x.x AND p.y = c.y LEFT JOIN (SELECT random, x, sum(n) AS n FROM pairs GROUP BY random, x) r ON r.random = c.random AND r.x = x.x GROUP BY x.x, c.y)""")
    ctes.append(f"""cand AS (SELECT * FROM s3 WHERE regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, {q(UUID)}) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = s3.r AND b.start < s3."end" AND s3.start < b."end"))""")
    ctes.append(f"""good AS (SELECT c.r, c.start, any_value(c."end") AS "end" FROM (SELECT r, start, "end", x AS token, unnest(range(1, length(x))) AS j FROM cand) c, a, model m WHERE m.x = instr(abc, substr(token, j::INT, 1)) AND m.y = instr(abc, substr(token, (j + 1)::INT, 1))
        GROUP BY c.r, c.start HAVING sum(round(ratio, 5)) >= {LIKELIER} AND sum(round(ratio, 5)) >= {EACH} * count(*))""")
    ctes.append("""every AS (SELECT r, start, kind, name, "end" FROM base UNION ALL SELECT r, start, 3, 'markov', "end" FROM good)""")
    text = """string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind)"""
    return f"""WITH {", ".join(ctes)} SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    sha256(coalesce({text} FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce({text}, '') AS spans FROM d LEFT JOIN every USING (r) GROUP BY d.r, d.doc_id"""
