"""Reading memories: gaps, calibration, bandits, profiles, kernels over outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(
    records: DataFrame, head: str, margin: Column, novelty: Column, thresholds: DataFrame | None = None, tau: float = 0.2, gate: float = 0.3, novel: float = 0.6, min_n: int = 20,
    unproved: DataFrame | None = None, item: Column | None = None, because: Column | None = None, examples: int = 10,
) -> DataFrame:
    """(head, n, abstain_rate, novel_rate, unproved, examples, precedents): heads of at least min_n records that abstain or meet news too often, or of which claims stand unproved.

    thresholds: (head, tau), where missing the default; unproved: (head, unproved); examples: the least items of those that abstained, or of the novel ones if none did; precedents: how often each source (the text
    before a colon in `because`) stood nearest to an abstained one.
    """
    none = F.lit(None).cast("string")
    own = records.select(F.col(head).alias("head"), margin.alias("m"), novelty.alias("v"), (item if item is not None else none).cast("string").alias("item"), (because if because is not None else none).alias("because")).where("head is not null")
    own = own.join(thresholds, "head", "left") if thresholds is not None else own.withColumn("tau", F.lit(None).cast("double"))
    own = own.withColumn("abstains", F.coalesce("m", F.lit(1.0)) < F.coalesce("tau", F.lit(tau))).withColumn("new", F.coalesce("v", F.lit(0.0)) >= novel)
    rates = own.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("abstains").cast("double")).alias("abstain_rate"), F.avg(F.col("new").cast("double")).alias("novel_rate"))
    rates = rates.join(unproved.select("head", "unproved"), "head", "left").fillna(0, ["unproved"]) if unproved is not None else rates.withColumn("unproved", F.lit(0))
    found = rates.where((F.col("n") >= min_n) & ((F.col("abstain_rate") >= gate) | (F.col("novel_rate") >= gate) | (F.col("unproved") > 0)))
    if item is not None:
        kind = F.when(F.col("abstains"), 0).when(F.col("new"), 1)
        w = Window.partitionBy("head").orderBy("kind", "item")
        first = own.where("item is not null").withColumn("kind", kind).where("kind is not null").select("head", "kind", "item").distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= examples)
        first = first.withColumn("least", F.min("kind").over(Window.partitionBy("head"))).where("kind = least").groupBy("head").agg(F.array_sort(F.collect_list("item")).alias("examples"))
        found = found.join(first, "head", "left")
    if because is not None:
        sources = own.where("abstains and because is not null").groupBy("head", F.substring_index("because", ":", 1).alias("source")).agg(F.count(F.lit(1)).alias("times"))
        found = found.join(sources.groupBy("head").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "times")))).alias("precedents")), "head", "left")
    return found


def brief(gaps_: DataFrame) -> Column:
    """A gap in words: what was seen, which examples, whose precedents."""
    percent = lambda c: F.concat(F.round(F.col(c) * 100).cast("int").cast("string"), F.lit("%"))
    seen = F.array_compact(F.array(F.when(F.col("abstain_rate") > 0, F.concat(F.lit("abstain "), percent("abstain_rate"))), F.when(F.col("novel_rate") > 0, F.concat(F.lit("novel "), percent("novel_rate"))), F.when(F.col("unproved") > 0, F.concat(F.col("unproved").cast("string"), F.lit(" unproved")))))
    lines = [F.concat(F.lit("# Gap: "), F.col("head")), F.concat(F.lit("Of "), F.col("n").cast("string"), F.lit(" queries: "), F.array_join(seen, ", "), F.lit("."))]
    if "examples" in gaps_.columns:
        lines.append(F.concat(F.lit("Examples: "), F.coalesce(F.array_join("examples", ", "), F.lit("-"))))
    if "precedents" in gaps_.columns:
        entries = F.transform(F.map_entries("precedents"), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string")))
        lines.append(F.concat(F.lit("Nearest sources: "), F.coalesce(F.array_join(entries, ", "), F.lit("-"))))
    return F.concat_ws("\n", *lines)


def calibrated(samples: DataFrame, margin: Column, right: Column, grid: list[float]) -> DataFrame:
    """(threshold, good): the threshold with most right answers kept and wrong ones withheld; of equal ones the lowest. One pass: each sample counts in a row per grid point before the shuffle."""
    points = samples.select(margin.alias("m"), right.alias("ok")).where("m is not null and ok is not null").select("m", "ok", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("threshold"))
    good = points.groupBy("threshold").agg(F.sum(((F.col("m") >= F.col("threshold")) == F.col("ok")).cast("long")).alias("good"))
    return good.orderBy(F.desc("good"), "threshold").limit(1)


def bandit(rounds: DataFrame, bucket: Column, arm: Column, reward: Column) -> DataFrame:
    """(bucket, arm, alpha, beta, mean, best): Beta posteriors from a uniform prior; best marks each bucket's greatest mean, ties to the lesser arm."""
    counts = rounds.select(bucket.alias("bucket"), arm.alias("arm"), reward.cast("double").alias("r")).dropna().groupBy("bucket", "arm").agg((1 + F.sum("r")).alias("alpha"), (1 + F.sum(1 - F.col("r"))).alias("beta"))
    means = counts.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    w = Window.partitionBy("bucket").orderBy(F.desc("mean"), "arm")
    return means.withColumn("best", F.row_number().over(w) == 1)


def outcome(near: DataFrame, outcomes: DataFrame, perfect: float, least: float = 0.55, min_votes: int = 3) -> DataFrame:
    """(qid, arm, value): the arm with the greatest similarity-weighted mean reward among near enough memories, ties to the lesser arm; none with fewer than min_votes. near: (qid, id, score), outcomes: (id, arm, reward)."""
    sim = F.col("score") / F.lit(float(perfect))
    votes = near.withColumn("sim", sim).where(F.col("sim") >= least).join(outcomes, "id")
    enough = votes.groupBy("qid").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= min_votes)
    value = votes.join(enough, "qid", "left_semi").groupBy("qid", "arm").agg((F.sum(F.col("sim") * F.col("reward")) / F.sum("sim")).alias("value"))
    w = Window.partitionBy("qid").orderBy(F.desc("value"), "arm")
    return value.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def template(docs: DataFrame, doc: str, elements: Column, support: float) -> DataFrame:
    """(element, documents, share): elements that at least such a share of the documents has."""
    total = docs.select(F.countDistinct(doc).alias("total"))
    counts = docs.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(elements)).alias("element")).groupBy("element").agg(F.countDistinct("doc").alias("documents"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("documents") / F.col("total")).where(F.col("share") >= support).drop("total")


def profile(docs: DataFrame, features: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """name -> (mean, deviation over all documents and a little more than none) of each feature: one row, however many documents."""
    row = docs.agg(*[F.struct(F.avg(c).alias("mean"), (F.stddev_pop(c) + 1e-6).alias("deviation")).alias(k) for k, c in features.items()]).first()
    return {k: (row[k].mean, row[k].deviation) for k in features if row[k].mean is not None}


def closeness(features: dict[str, Column], profile: dict[str, tuple[float, float]]) -> Column:
    """exp(-z / 2) of the mean distance from a profile in standard deviations, each six at most. profile: name to (mean, deviation)."""
    z = sum(F.least(F.abs(features[k] - m) / s, F.lit(6.0)) for k, (m, s) in profile.items()) / len(profile)
    return F.exp(-z / 2)


def coverage(elements: Column, wanted: list[str]) -> Column:
    """The share of a template's elements that a document has; 1 for an empty template."""
    return F.size(F.array_intersect(elements, F.array(*map(F.lit, wanted)))) / F.lit(len(wanted)) if wanted else F.lit(1.0)


def missing(elements: Column, wanted: list[str]) -> Column:
    """A template's elements that a document lacks, in the template's order."""
    return F.array_except(F.array(*map(F.lit, wanted)), elements) if wanted else F.array().cast("array<string>")


def fit(features: dict[str, Column], elements: Column, known: tuple[dict[str, tuple[float, float]], list[str]]) -> Column:
    """Six tenths coverage of the template and four tenths closeness to the profile."""
    return 0.6 * coverage(elements, known[1]) + 0.4 * closeness(features, known[0])


def recognised(features: dict[str, Column], elements: Column, profiles: dict[str, tuple[dict[str, tuple[float, float]], list[str]]]) -> Column:
    """The name of the profile that fits best, the first of equal ones."""
    scored = F.array(*[F.struct(fit(features, elements, p).alias("s"), F.lit(-n).alias("n"), F.lit(name).alias("name")) for n, (name, p) in enumerate(profiles.items())])
    return F.array_max(scored)["name"]
