"""Rules over statistics, points and key-values, compiled to DataFrames of findings(run, key, rule_name, score, description, message)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.functions.expr import compare, finding_score, number_text, percent_text, ratio
from gaugeframe.operators import profile

FINDING = ("run", "key", "rule_name", "score", "description", "message")
#: How comparisons and statistics are called in descriptions (one as it is misspelt there).
RELATIONS = {"=": "equal to", "!=": "not equal to", ">": "greater than", ">=": "greater than or equal to", "<": "less than", "<=": "less than or euqal to"}
CALLED = {"avg": "average"}


def _finding(rows: DataFrame, rule, *said: str | Column) -> DataFrame:
    """The findings of a rule; their description is put together from texts and columns."""
    parts = [F.lit(x) if isinstance(x, str) else x for x in said]
    return rows.select("run", "key", F.lit(rule.name).alias("rule_name"), "score", F.concat(*parts).alias("description"), F.lit(rule.message).alias("message"))


def _plain(x: float) -> str:
    """A number as short as it can be written."""
    return f"{x:.17g}" if x != int(x) and float(repr(x)) != x else repr(x).removesuffix(".0")


@dataclass(frozen=True)
class StatThreshold:
    """A statistic of a metric, or of one of its series, against a threshold."""

    name: str
    metric: str
    stat: str
    op: str
    threshold: float
    base_score: float
    series: str | None = None
    message: str = ""

    def findings(self, stats: DataFrame) -> DataFrame:
        """stats(run, metric, …), or with a series stats(run, metric, series, …)."""
        v, t = F.col(self.stat), F.lit(float(self.threshold))
        own = F.col("metric") == self.metric
        hit = stats.where((own if self.series is None else own & (F.col("series") == self.series)) & compare(self.op, v, t))
        hit = hit.select("run", F.col("metric").alias("key"), v.alias("v"), finding_score(v, t, F.lit(float(self.base_score))).alias("score"))
        return _finding(hit, self, f"The {CALLED.get(self.stat, self.stat)} in ", F.col("run"), " is ", number_text(F.col("v")), ".")


@dataclass(frozen=True)
class RunComparison:
    """A statistic against the base run's, as relative change."""

    name: str
    metric: str
    stat: str
    op: str
    threshold: float
    base_score: float
    absolute: bool = False
    message: str = ""

    def findings(self, stats: DataFrame, base_run: str) -> DataFrame:
        own = stats.where(F.col("metric") == self.metric).select("run", F.col("metric").alias("key"), F.col(self.stat).alias("v"))
        base = own.where(F.col("run") == base_run).select("key", F.col("v").alias("b"))
        t = F.lit(float(self.threshold))
        rows = own.where(F.col("run") != base_run).join(base, "key").withColumn("change", ratio(F.col("v"), F.col("b")))
        hit = rows.withColumn("c", F.abs("change") if self.absolute else F.col("change")).where(compare(self.op, F.col("c"), t))
        hit = hit.withColumn("score", finding_score(F.col("c"), t, F.lit(float(self.base_score))))
        return _finding(hit, self, f"The {CALLED.get(self.stat, self.stat)} in ", F.col("run"), " (", number_text(F.col("v")), ") is ", percent_text(F.col("change")), f" {base_run} (", number_text(F.col("b")), ").")


@dataclass(frozen=True)
class MetricComparison:
    """A metric's statistic against another metric's of the same run."""

    name: str
    base_metric: str
    metric: str
    stat: str
    op: str
    threshold: float
    base_score: float
    message: str = ""

    def findings(self, stats: DataFrame) -> DataFrame:
        pick = lambda m, c: stats.where(F.col("metric") == m).select("run", F.col(self.stat).alias(c))
        t = F.lit(float(self.threshold))
        hit = pick(self.metric, "v").join(pick(self.base_metric, "b"), "run").withColumn("c", ratio(F.col("v"), F.col("b"))).where(compare(self.op, F.col("c"), t))
        hit = hit.withColumns({"key": F.lit(self.metric), "score": finding_score(F.col("c"), t, F.lit(float(self.base_score)))})
        return _finding(hit, self, f"The {CALLED.get(self.stat, self.stat)} in {self.metric} (", number_text(F.col("v")), ") is ", percent_text(F.col("c")), f" {self.base_metric} (", number_text(F.col("b")), ").")


@dataclass(frozen=True)
class PointThreshold:
    """The worst point of the metrics that match a pattern; the later of equals."""

    name: str
    pattern: str
    op: str
    threshold: float
    base_score: float
    message: str = ""

    def findings(self, points: DataFrame) -> DataFrame:
        t = F.lit(float(self.threshold))
        hit = points.where(F.col("metric").rlike(self.pattern) & compare(self.op, F.col("value"), t))
        hit = hit.withColumn("score", finding_score(F.col("value"), t, F.lit(float(self.base_score))))
        worst = hit.groupBy("run", F.col("metric").alias("key")).agg(F.max_by(F.struct("score", "value"), F.struct(F.abs("score"), "series", "time_diff")).alias("w")).select("run", "key", "w.*")
        return _finding(worst, self, "At least one data point in ", F.col("run"), " is ", number_text(F.col("value")), f" ({RELATIONS[self.op]} the threshold of {_plain(self.threshold)}).")


@dataclass(frozen=True)
class KeyExpected:
    """A key's value in every run against the expected one; a missing key counts as different."""

    name: str
    key: str
    expected: str
    base_score: float
    message: str = ""

    def findings(self, runs: DataFrame, kv: DataFrame) -> DataFrame:
        own = kv.where(F.col("key") == self.key).groupBy("run").agg(F.min_by("value", "grp").alias("value"))
        hit = runs.select("run").join(own, "run", "left").where(~F.col("value").eqNullSafe(F.lit(self.expected)))
        other = F.concat(F.lit(f"The value of {self.key} in "), "run", F.lit(' is "'), "value", F.lit(f'", instead of "{self.expected}".'))
        none = F.concat(F.lit(f"The key {self.key} in "), "run", F.lit(f" is missing, instead of being set to {self.expected}"))
        return _finding(hit.withColumns({"key": F.lit(self.key), "score": F.lit(float(self.base_score))}), self, F.coalesce(other, none))


@dataclass(frozen=True)
class KeyComparison:
    """A key's value in every run against the base run's."""

    name: str
    key: str
    base_score: float
    message: str = ""

    def findings(self, runs: DataFrame, kv: DataFrame, base_run: str) -> DataFrame:
        own = kv.where(F.col("key") == self.key).groupBy("run").agg(F.min_by("value", "grp").alias("value"))
        base = own.where(F.col("run") == base_run).select(F.lit(self.key).alias("key"), F.col("value").alias("b"))
        rows = runs.select("run").where(F.col("run") != base_run).withColumn("key", F.lit(self.key)).join(own, "run", "left")
        hit = rows.join(base, "key").where(~F.col("value").eqNullSafe(F.col("b")))
        other = F.concat(F.lit(f"The value of {self.key} in "), "run", F.lit(' ("'), "value", F.lit(f'") is different from {base_run} ("'), "b", F.lit('").'))
        none = F.concat(F.lit(f"The key {self.key} does not exist in "), "run", F.lit(f', while its value in {base_run} is "'), "b", F.lit('".'))
        return _finding(hit.withColumn("score", F.lit(float(self.base_score))), self, F.coalesce(other, none, F.concat(F.lit(f"The key {self.key} does not exist in {base_run}, while "), "run", F.lit(" has it."))))


@dataclass(frozen=True)
class PreemptionRule:
    """Across sources: a kernel of major version 7 or more with lazy preemption."""

    name: str = "PREEMPT_LAZY Detected"
    message: str = ""

    def findings(self, kv: DataFrame) -> DataFrame:
        pick = lambda k, c: kv.where(F.col("key") == k).groupBy("run").agg(F.min_by("value", "grp").alias(c))
        major = F.expr("try_cast(split_part(version, '.', 1) as int)")
        hit = pick("Kernel Version", "version").join(pick("CONFIG_PREEMPT_LAZY", "lazy"), "run").where((major >= 7) & (F.col("lazy") == "y"))
        return _finding(hit.withColumns({"key": F.lit("CONFIG_PREEMPT_LAZY"), "score": F.lit(0.0)}), self, "Kernel ", F.col("version"), " in ", F.col("run"), " is running with PREEMPT_LAZY preemption model.")


@dataclass(frozen=True)
class StackThreshold:
    """The share of stacks that hold frames of the given patterns, of one or the sum of all, against a least percentage."""

    name: str
    patterns: tuple[tuple[str, ...], ...]
    threshold: float
    base_score: float
    states: tuple[int, ...] = ()
    add_up: bool = True
    totals: bool = True
    profile_type: str | None = None
    frame_type: str | None = None
    message: str = ""

    def findings(self, samples: DataFrame) -> DataFrame:
        """samples(run, profiler, block, thread_state, path, count), and profile_type if the rule is of one; the last frame of each pattern must be of ``frame_type``, if given."""
        rows = samples if self.profile_type is None else samples.where(F.col("profile_type") == self.profile_type)
        rows, by = profile.in_states(rows, self.states), ["run", "profiler"]
        out = rows.groupBy(*by).agg(F.sum("count").alias("all"))
        for k, pattern in enumerate(self.patterns):
            found = profile.matches(rows, list(pattern), self.frame_type, tuple(by)).select(*by, F.col("total" if self.totals else "self").alias(f"n{k}"))
            out = out.join(found, by)
        counts = [F.col(f"n{k}") for k in range(len(self.patterns))]
        names = [f"[{', '.join(p)}]" for p in self.patterns]
        if self.add_up:
            hits, said = reduce(lambda a, b: a + b, counts), F.lit(", ".join(names))
        else:
            hits = F.greatest(*counts) if len(counts) > 1 else counts[0]
            said = F.when(hits == 0, ", ".join(names))
            for n, name in zip(counts, names, strict=True):
                said = said.when(n == hits, name)
        hit = out.withColumns({"percent": F.coalesce(F.try_divide(hits * 100.0, F.col("all")), F.lit(0.0)), "said": said}).where(F.col("percent") >= self.threshold)
        hit = hit.select("run", F.col("profiler").alias("key"), F.lit(float(self.base_score)).alias("score"), "percent", "said")
        kind = self.profile_type or "all profiles"
        return _finding(hit, self, "Stack pattern ", F.col("said"), " accounts for ", F.format_string("%.2f", "percent"), f"% of samples in {kind} (threshold: {self.threshold:.2f}%)")


@dataclass(frozen=True)
class MetadataExpected:
    """A field of each profiler's metadata against a regular expression; a missing one counts if it must exist."""

    name: str
    key: str
    pattern: str
    base_score: float
    must_exist: bool = True
    group: str = ""
    message: str = ""

    def findings(self, profilers: DataFrame, metadata: DataFrame) -> DataFrame:
        """profilers(run, profiler), metadata(run, profiler, key, value)."""
        own = metadata.where(F.col("key") == self.key).groupBy("run", "profiler").agg(F.min("value").alias("value"))
        rows = profilers.select("run", "profiler").join(own, ["run", "profiler"], "left")
        hit = rows.where(F.when(F.col("value").isNotNull(), ~F.col("value").rlike(self.pattern)).otherwise(self.must_exist))
        quoted = F.concat(F.lit('"'), F.replace(F.replace("value", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        other = F.concat(F.lit(f"Event type '{self.group}' field '{self.key}' in "), "profiler", F.lit(f" should match pattern '{self.pattern}', found: "), quoted)
        none = F.lit(f"Event type '{self.group}' field '{self.key}' not found in profile data")
        return _finding(hit.withColumns({"key": F.col("profiler"), "score": F.lit(float(self.base_score))}), self, F.coalesce(other, none))


@dataclass(frozen=True)
class MetadataComparison:
    """A field of profilers' metadata against the base run's: by profiler, or, where both runs have it of one profiler alone, whatever their names."""

    name: str
    key: str
    base_score: float
    must_exist: bool = True
    group: str = ""
    message: str = ""

    def findings(self, runs: DataFrame, metadata: DataFrame, base_run: str) -> DataFrame:
        """runs(run), metadata(run, profiler, key, value)."""
        own = metadata.where((F.col("key") == self.key) & F.col("value").isNotNull()).groupBy("run", "profiler").agg(F.min("value").alias("value"))
        one = own.groupBy("run").agg(F.count("*").alias("n"), F.min("profiler").alias("only"), F.min("value").alias("value"))
        others = runs.select("run").where(F.col("run") != base_run)
        base = own.where(F.col("run") == base_run).select("profiler", F.col("value").alias("b"), F.lit(base_run).alias("base"))
        sizes = others.join(one, "run", "left").withColumn("base", F.lit(base_run)).join(one.where(F.col("run") == base_run).select(F.col("run").alias("base"), F.col("n").alias("bn"), F.col("value").alias("bv"), F.col("only").alias("bkey")), "base")
        alone = (F.col("n") == 1) & (F.col("bn") == 1)
        field, quote = f"Event type '{self.group}' field '{self.key}'", lambda c: F.concat(F.lit('("'), c, F.lit('")'))
        single = sizes.where(alone & (F.col("value") != F.col("bv"))).select("run", F.col("only").alias("key"), F.concat(F.lit(f"{field} in "), "run", F.lit(" for '"), "only", F.lit("' "), quote("value"), F.lit(f" differs from {base_run} for '"), "bkey", F.lit("' "), quote("bv")).alias("said"))
        pairs = sizes.where(~F.coalesce(alone, F.lit(False))).select("run", "base").join(base, "base").join(own, ["run", "profiler"], "left")
        other = F.concat(F.lit(f"{field} in "), "run", F.lit(" for '"), "profiler", F.lit("' "), quote("value"), F.lit(f" differs from {base_run} "), quote("b"))
        none = F.concat(F.lit(f"{field} not found in "), "run", F.lit(" for '"), "profiler", F.lit(f"', while its value in {base_run} is \""), "b", F.lit('"'))
        many = pairs.where(F.when(F.col("value").isNotNull(), F.col("value") != F.col("b")).otherwise(self.must_exist)).select("run", F.col("profiler").alias("key"), F.coalesce(other, none).alias("said"))
        hit = single.unionByName(many)
        if self.must_exist:
            lacks = runs.where(F.col("run") == base_run).join(own, "run", "left_anti").select("run", F.lit(self.name).alias("key"), F.lit(f"{field} not found in run {base_run}.").alias("said"))
            hit = hit.unionByName(lacks)
        return _finding(hit.withColumn("score", F.lit(float(self.base_score))), self, F.col("said"))


@dataclass(frozen=True)
class Facts:
    """What rules look at, for one source: statistics(run, metric, …), points, key-values, samples, profilers' metadata; and the runs."""

    runs: DataFrame
    base_run: str
    stats: DataFrame | None = None
    points: DataFrame | None = None
    kv: DataFrame | None = None
    samples: DataFrame | None = None
    metadata: DataFrame | None = None
    series_stats: DataFrame | None = None


def run_rules(rules: list, facts: Facts) -> DataFrame | None:
    """The findings of all rules whose facts are there; each rule is a filter or a join of its own, so rules and facts never meet pair by pair."""
    takes = {
        StatThreshold: ("stats",), RunComparison: ("stats", "base_run"), MetricComparison: ("stats",), PointThreshold: ("points",), KeyExpected: ("runs", "kv"), KeyComparison: ("runs", "kv", "base_run"),
        PreemptionRule: ("kv",), StackThreshold: ("samples",), MetadataExpected: ("profilers", "metadata"), MetadataComparison: ("runs", "metadata", "base_run"),
    }
    found = []
    for rule in rules:
        names = ("series_stats",) if getattr(rule, "series", None) else takes[type(rule)]
        given = [facts.samples.select("run", "profiler").distinct() if name == "profilers" and facts.samples is not None else getattr(facts, name, None) for name in names]
        if all(x is not None for x in given):
            found.append(rule.findings(*given))
    return union(found) if found else None


def chosen(findings: DataFrame, sources: tuple[str, ...] = (), kind: str | None = None, text: str = "") -> DataFrame:
    """Findings of the given sources (all, if none), of a kind ('good': score above 0, 'poor': below, 'neutral': 0), that hold a text in any case."""
    out = findings.where(F.col("data_name").isin(*sources)) if sources else findings
    sign = {"good": F.col("score") > 0, "poor": F.col("score") < 0, "neutral": F.col("score") == 0}
    out = out.where(sign[kind]) if kind else out
    found = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    return out.where(found("rule_name") | found("description") | found("key")) if text else out


def worst_first(findings: DataFrame) -> DataFrame:
    return findings.orderBy("score", *[c for c in FINDING if c != "score"])


def union(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def ranked(findings: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of findings, the largest scores first."""
    return findings.orderBy(F.abs("score").desc(), *[c for c in FINDING if c != "score"]).offset(offset).limit(limit)
