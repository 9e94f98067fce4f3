"""Retrieval quality: gold sets, ranks of first relevant hits, recall, lift, verdicts, sweeps, times, percentiles and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright import settings as S
from clausewright.functions import text as T


def gold_ids(gold: Column, acceptable: Column, adversarial: Column) -> Column:
    """The ids that count as found: for adversarial queries the gold ones only."""
    return F.when(adversarial, F.array_distinct(gold)).otherwise(F.array_union(gold, acceptable))


def first_ranks(queries: DataFrame, results: DataFrame, relevant: Column) -> DataFrame:
    """(query_id, first): rank of the first result for which `relevant` holds, 0 if none does."""
    hit = results.filter(relevant).groupBy("query_id").agg(F.min("rank").alias("first"))
    return queries.join(hit, "query_id", "left").withColumn("first", F.coalesce("first", F.lit(0)))


def _scores() -> list[Column]:
    at = lambda k: (F.avg(F.when(F.col("first").between(1, k), 1.0).otherwise(0.0)) * 100).alias(f"recall_{k}")
    return [F.count("*").alias("n"), at(1), at(3), at(5), F.avg(F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0)).alias("mrr")]


def quality(ranks: DataFrame, by: str) -> DataFrame:
    """Recall at 1, 3 and 5 in percent and mean reciprocal rank, for each value of `by` and over all (null)."""
    return ranks.rollup(by).agg(*_scores())


def lift(ranks: DataFrame, by: str, arms: tuple[str, str] = ("system", "plain")) -> DataFrame:
    """Scores of both arms (column arm), and the first's less the second's, for each value of `by` and over all (null).

    Percentages have one place, mean reciprocal ranks three, and lifts are taken of these.
    """
    names = {"recall_1": 1, "recall_3": 1, "recall_5": 1, "mrr": 3}
    per = ranks.groupBy("arm", by).agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("first").between(1, k), 1).otherwise(0)).alias(f"h{k}") for k in (1, 3, 5)], F.sum(F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0)).alias("rr"))
    per = per.rollup(by).agg(*[F.sum(F.when(F.col("arm") == a, F.col(c))).alias(f"{a}_{c}") for a in arms for c in ("n", "h1", "h3", "h5", "rr")])
    share = lambda a, c, k, p: T.rounded(F.try_divide(F.col(f"{a}_{c}").cast("double"), F.col(f"{a}_n")) * k, p)
    parts = {"recall_1": ("h1", 100), "recall_3": ("h3", 100), "recall_5": ("h5", 100), "mrr": ("rr", 1)}
    out = per.select(by, F.col(f"{arms[0]}_n").alias("n"), *[share(a, c, k, names[m]).alias(f"{a}_{m}") for a in arms for m, (c, k) in parts.items()])
    return out.withColumns({f"lift_{m}": T.rounded(F.col(f"{arms[0]}_{m}") - F.col(f"{arms[1]}_{m}"), p) for m, p in names.items()})


def verdict_counts(items: DataFrame) -> DataFrame:
    """One row: n, green, amber or red, false_confident (green without a relevant hit) and its share of the green in percent."""
    green = F.col("state") == "green"
    wrong = F.count_if(green & (F.col("first") == 0))
    out = items.agg(F.count("*").alias("n"), F.count_if(green).alias("green"), F.count_if(~green).alias("other"), wrong.alias("false_confident"))
    return out.withColumn("false_confident_pct", F.coalesce(T.rounded(F.try_divide(F.col("false_confident").cast("double"), F.col("green")) * 100, 2), F.lit(0.0)))


def sweep(items: DataFrame, score: str, good: Column, limits: list[float]) -> DataFrame:
    """(limit, shown, wrong, coverage_pct, wrong_pct, amber_pct): rows that reach each limit, and those of them that aren't good; one pass."""
    counts = F.explode(F.array(*[F.struct(F.lit(x).alias("limit"), (F.col(score) >= x).alias("shown")) for x in limits]))
    out = items.select(counts.alias("c"), good.alias("good")).groupBy("c.limit").agg(F.count("*").alias("n"), F.count_if("c.shown").alias("shown"), F.count_if(F.col("c.shown") & ~F.col("good")).alias("wrong"))
    pct = lambda a, b: T.rounded(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)) * 100, 1)
    return out.withColumns({"coverage_pct": pct(F.col("shown"), F.col("n")), "wrong_pct": pct(F.col("wrong"), F.col("shown")), "amber_pct": pct(F.col("n") - F.col("shown"), F.col("n"))}).drop("n")


def sweep_report(swept: DataFrame, n: Column, chosen: float = S.AMBER) -> DataFrame:
    """(place, line): the sweep as lines of a Markdown table, the chosen limit marked."""
    number = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")
    shown = F.when(F.col("limit") == chosen, F.concat(F.lit("**"), number(F.col("limit")), F.lit("** ←"))).otherwise(number(F.col("limit")))
    line = F.format_string("| %s | %d/%d | %s%% | %d (%s%%) | %s%% |", shown, F.col("shown"), n, number(F.col("coverage_pct")), F.col("wrong"), number(F.col("wrong_pct")), number(F.col("amber_pct")))
    body = swept.select((F.row_number().over(Window.orderBy("limit")) + 2).alias("place"), line.alias("line"))  # a row a limit
    head = swept.sparkSession.createDataFrame([(1, "| Threshold | Shown | Coverage | False-confident | Amber rate |"), (2, "|---|---|---|---|---|")], "place int, line string")
    return head.unionByName(body)


def calibration(scores: DataFrame, verdict: DataFrame, swept: DataFrame, hard: DataFrame | None = None, stages: DataFrame | None = None) -> DataFrame:
    """One row with the column json: the nested result of an evaluation, from lift(), verdict_counts() and sweep(), lift() of the adversarial queries alone and stage_summary(), each of a bounded number of rows.

    What there is for each query is a table of its own, see per_item().
    """
    listed = lambda df, key, name: df.agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in df.columns if c != key]))).alias(name))
    whole = listed(scores, scores.columns[0], "recall").join(verdict.select(F.struct("*").alias("gate")), how="cross").join(listed(swept, "limit", "sweep"), how="cross")  # one row each
    parts = [F.col("recall"), F.struct(*[F.col(f"gate.{c}").alias(c) for c in verdict.columns], "sweep").alias("gate")]
    if hard is not None:
        whole = whole.join(hard.filter(F.col(hard.columns[0]).isNull()).select(F.struct(*hard.columns[1:]).alias("adversarial")), how="left")  # the row over all
        parts.append(F.col("adversarial"))
    if stages is not None:
        whole = whole.join(listed(stages, "stage", "latency_ms"), how="cross")
        parts.append(F.col("latency_ms"))
    return whole.select(F.to_json(F.struct(*parts)).alias("json"))


def per_item(items: DataFrame, other: DataFrame) -> DataFrame:
    """(query_id, rank, plain_rank, adversarial, state, composite, hit): what each query came to in both arms, a row each; ranks are of the first relevant result, null if there is none."""
    shown = lambda c: F.when(F.col(c) > 0, F.col(c))
    both = items.join(other.select("query_id", F.col("first").alias("plain")), "query_id", "left")
    return both.select("query_id", shown("first").alias("rank"), shown("plain").alias("plain_rank"), "adversarial", "state", "composite", (F.col("first") > 0).alias("hit"))


STAGES = ["build_ms", "embed_ms", "search_ms", "rank_ms", "total_ms"]


def stage_summary(times: DataFrame) -> DataFrame:
    """(stage, p50, p95, mean) of the stages that stage_times() adds, as they are, to two places."""
    long = times.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).cast("double").alias("ms")) for n in STAGES])).alias("x")).select("x.*")
    mean = long.groupBy("stage").agg(T.rounded(F.avg("ms"), 2).alias("mean"))
    at = values_at(long, "stage", "ms", {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95)})
    return at.join(mean, "stage").select("stage", T.rounded(F.col("p50"), 2).alias("p50"), T.rounded(F.col("p95"), 2).alias("p95"), "mean")


def number(x: Column) -> Column:
    """A number without needless noughts, three places at most."""
    return F.regexp_replace(F.format_string("%.3f", x.cast("double")), r"\.?0+$", "")


def report(scores: DataFrame, hard: DataFrame, stages: DataFrame, verdict: DataFrame, swept: DataFrame, budget_ms: float = 10, most_wrong_pct: float = 5) -> DataFrame:
    """(place, line): an evaluation as Markdown: recall of both arms, the same for adversarial queries, times by stage against the search's budget, the gate's verdicts and the sweep of its limit.

    The inputs are those of calibration(); sections without rows keep their headings. Lines are made from tables of some rows each.
    """
    spark = scores.sparkSession

    def table(rows: DataFrame, order: Column, line: Column, head: list[str]) -> DataFrame:
        top = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "at int, line string")
        return top.unionByName(rows.select(F.row_number().over(Window.orderBy(order)).alias("at"), line.alias("line")))  # some rows

    def arms(rows: DataFrame, names: dict[str, str]) -> DataFrame:
        of = rows.filter(F.col(rows.columns[0]).isNull())
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(shown).alias("name"), *[F.col(f"{a}_{m}").alias(a) for a in ("system", "plain", "lift")]) for i, (m, shown) in enumerate(names.items())]))
        return of.select(each.alias("x")).select("x.*")

    recall = {"recall_1": "Recall@1 (%)", "recall_3": "Recall@3 (%)", "recall_5": "Recall@5 (%)", "mrr": "MRR"}
    arm_line = F.format_string("| %s | %s | %s | %s |", F.col("name"), number(F.col("system")), number(F.col("plain")), number(F.col("lift")))
    arm_head = ["", "| Measure | System | Plain | Lift |", "|---|---|---|---|"]
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    within = F.when(F.col("stage") == "search_ms", F.when(F.col("p95") < budget_ms, f"within {budget_ms:g}").otherwise(f"over {budget_ms:g}")).otherwise("")
    gate = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), v.alias("v")) for i, (n, v) in enumerate({
        "Queries": number(F.col("n")), "Green": number(F.col("green")), "Amber or red": number(F.col("other")), "Green without a relevant card": number(F.col("false_confident")),
        "Share of the green (%)": F.concat(number(F.col("false_confident_pct")), F.when(F.col("false_confident_pct") <= most_wrong_pct, f", within {most_wrong_pct:g}").otherwise(f", over {most_wrong_pct:g}")),
    }.items())]))
    sections = [
        table(arms(scores, recall), F.col("i"), arm_line, ["# Evaluation", "", "## Retrieval", *arm_head]),
        table(arms(hard, dict(list(recall.items())[:2])), F.col("i"), arm_line, ["", "### Adversarial queries", *arm_head]),
        table(stages, place, F.format_string("| %s | %s | %s | %s | %s |", F.col("stage"), number(F.col("p50")), number(F.col("p95")), number(F.col("mean")), within), ["", "## Times (ms)", "", "| Stage | p50 | p95 | Mean | Budget |", "|---|---|---|---|---|"]),
        table(verdict.select(gate.alias("x")).select("x.*"), F.col("i"), F.format_string("| %s | %s |", F.col("name"), F.col("v")), ["", "## Gate", "", "| Verdict | Value |", "|---|---|"]),
        sweep_report(swept.join(verdict.select(F.col("n").alias("__n")), how="cross"), F.col("__n")).withColumnRenamed("place", "at").unionByName(spark.createDataFrame([(-2, ""), (-1, "### Limits"), (0, "")], "at int, line string")),
    ]
    all_ = sections[0].withColumn("part", F.lit(0))
    for i, x in enumerate(sections[1:], 1):
        all_ = all_.unionByName(x.withColumn("part", F.lit(i)))
    return all_.select(F.row_number().over(Window.orderBy("part", "at")).alias("place"), "line")  # the lines of a report


def stage_times(marks: DataFrame, floor: float | None = None) -> DataFrame:
    """Adds build_ms, embed_ms, search_ms, rank_ms and total_ms from the marks t_speech_end, t_query_built, t_embed_done, t_search_done, t_ranked.

    floor: least value that is shown; an evaluation takes the times as they are.
    """
    t = ["t_speech_end", "t_query_built", "t_embed_done", "t_search_done", "t_ranked"]
    spans = {"build_ms": (1, 0), "embed_ms": (2, 1), "search_ms": (3, 2), "rank_ms": (4, 3), "total_ms": (4, 0)}
    span = lambda a, b: F.col(t[a]) - F.col(t[b]) if floor is None else F.greatest(F.lit(floor), F.col(t[a]) - F.col(t[b]))
    return marks.withColumns({n: span(a, b) for n, (a, b) in spans.items()})


def decode_times(decodes: DataFrame) -> DataFrame:
    """(seconds, n, mean_ms, min_ms, max_ms, real_time_factor) of speech decodes (seconds of audio, decode_ms)."""
    out = decodes.groupBy("seconds").agg(F.count("*").alias("n"), T.rounded(F.avg("decode_ms"), 2).alias("mean_ms"), F.min("decode_ms").alias("min_ms"), F.max("decode_ms").alias("max_ms"))
    return out.withColumn("real_time_factor", T.rounded(F.col("mean_ms") / (F.col("seconds") * 1000), 3))


def _coarse(value: Column) -> Column:
    """A whole number that follows the order of values, 1024 steps for each doubling: at most some millions of them however many rows there are."""
    of = lambda x: F.floor(F.log2(x) * 1024) + 2_000_000
    return F.when(value > 0, of(value)).when(value < 0, -of(-value)).otherwise(F.lit(0)).cast("long")


def values_at(rows: DataFrame, by: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by and, for each name, the value at the rank (from 1) that its function gives for the number of values; nulls don't count.

    Coarse steps are counted first, on the map side; then only the values of the step in which a rank falls are counted and put in order. So no group
    of rows is sorted by one task.
    """
    known = rows.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v")).withColumn("step", _coarse(F.col("v")))
    w = Window.partitionBy(by)
    before = lambda n, at: F.coalesce(F.sum(n).over(w.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = known.groupBy(by, "step").agg(F.count("*").alias("c")).withColumns({"n": F.sum("c").over(w), "before": before("c", "step")})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("at")) for name, f in ranks.items()]))
    ends = steps.withColumn("r", wanted).filter((F.col("before") < F.col("r.at")) & (F.col("r.at") <= F.col("before") + F.col("c"))).select(F.col(by).alias("__by"), F.col("step").alias("__step"), "r.name", (F.col("r.at") - F.col("before")).alias("at"))
    inside = known.join(ends, F.col(by).eqNullSafe(F.col("__by")) & (F.col("step") == F.col("__step"))).groupBy(by, "name", "at", "v").agg(F.count("*").alias("c"))
    here = Window.partitionBy(by, "name").orderBy("v")
    hit = inside.withColumn("upto", F.sum("c").over(here)).filter(F.col("upto") >= F.col("at")).groupBy(by, "name").agg(F.min("v").alias("v"))
    return hit.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])


def nearest_rank(p: float) -> Callable[[Column], Column]:
    return lambda n: F.greatest(F.lit(1), F.ceil(n * p))


def floor_index(p: float) -> Callable[[Column], Column]:
    return lambda n: F.least(n, F.floor(n * p) + 1)
