"""Quality classifier: an ensemble of sparse rules over statistics of the text."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, fresh

#: Most labelled rows a model is fitted on, those with the smallest hashes of doc_id.
FIT_ROWS = 20_000
TREES, DEPTH, SEED = 24, 4, 7
#: Rows of the sample in a task, about.
TASK_ROWS = 8192
#: Weight of the lasso penalty.
LASSO = 0.0015


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a whole text; all are 0 for an empty one. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    count = lambda p: F.regexp_count(text, F.lit(p))
    return {
        "log_chars": F.log1p(n), "word_chars": share(n, F.size(words)), "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "log_words": F.log1p(F.size(words)), "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)), "line_words": share(F.size(words), F.size(lines)),
        "upper": share(count(r"\p{Lu}"), n), "digit": share(count("[0-9]"), n), "mark_runs": share(count(r"[^\p{L}\p{N}\s.,]+"), F.size(words)),
        "symbol": share(count(r"[^\p{L}\p{N}\s.,;:'\"!?()-]"), n), "bang": share(count("[!?]"), n), "stop": share(count("[.]"), F.size(words)), "comma": share(count(","), F.size(words)),
        "long_words": share(count(r"\p{L}{13,}"), F.size(words)), "bars": share(count("[|]"), F.size(words)), "repeats": share(count(rf"(?<![^{SPACE}])([^{SPACE}]++)(?=[{SPACE}]+\1(?![^{SPACE}]))"), F.size(words)),
    }


def paths(model) -> set[tuple[tuple[int, bool, float], ...]]:
    """The conjunctions at every inner node and leaf of a forest: (statistic, at most?, threshold), redundant conditions merged."""
    found = set()

    def walk(node, conditions: dict):
        if conditions:
            found.add(tuple(sorted((k, low, t) for (k, low), t in conditions.items())))
        if node.getClass().getSimpleName() != "InternalNode":
            return
        k, t = node.split().featureIndex(), node.split().threshold()
        for low, child in ((True, node.leftChild()), (False, node.rightChild())):
            old = conditions.get((k, low))
            walk(child, conditions | {(k, low): t if old is None else min(old, t) if low else max(old, t)})

    for tree in model.trees:
        walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"), {})
    return found


class RuleModel:
    """rules: (weight, conditions) over `names`; score() compiles them into one column expression."""

    def __init__(self, names: list[str], bias: float, rules: list):
        self.names, self.bias, self.rules = names, bias, rules

    def score(self, stats: Column) -> Column:
        """The logistic of the rules that hold, from an array column of the statistics in order of names."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule, stats: Column) -> Column:
    out = F.lit(True)
    for k, low, t in rule:
        out = out & ((stats[k] <= F.lit(t)) if low else (stats[k] > F.lit(t)))
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, may_learn: Column | None = None) -> RuleModel:
    """Fit on at most fit_rows labelled documents: docs(doc_id, text) and labels(doc_id, quality).

    Labels other than 0 and 1 are left out, a document with both counts as 1. may_learn
    narrows the rows by doc_id. The bounded sample's statistics are stored once; trees and
    lasso are fitted by Spark. With no labels the score is 0.5; with one class, or where the
    forest finds no split (few rows, or equal texts), a constant by the share of the class.
    Null texts count as empty, very long ones are read whole; rows that repeat a document
    count as often as they came.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null")
    known = known if may_learn is None else known.where(may_learn)
    known = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    known = known.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("_h", "doc_id").limit(fit_rows).drop("_h")
    known = scratch.stored(known, "known")
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most fit_rows ids
    rows = scratch.stored(rows.select("doc_id", "label", F.array(*(c.cast("double") for c in stats.values())).alias("stats")), "rows")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    names, total = list(stats), sum(counts.values())
    constant = RuleModel(names, math.log((counts.get(1.0, 0) + 0.5) / (counts.get(0.0, 0) + 0.5)), [])
    if len(counts) < 2:
        return constant
    rows = scratch.sample(rows, max(1, -(-total // TASK_ROWS)), "doc_id", "label", "stats")
    rows = rows.withColumn("features", array_to_vector("stats")).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, featureSubsetStrategy="onethird", maxBins=64, cacheNodeIds=False).fit(rows)
    rules = sorted(paths(forest))
    if not rules:
        rows.unpersist()
        return constant
    hit = array_to_vector(F.array(*(holds(r, F.col("stats")).cast("double") for r in rules)))
    sparse = VectorAssembler(inputCols=["hit"], outputCol="features")  # a row holds to few rules
    fitted = sparse.transform(rows.select("label", hit.alias("hit"))).select("label", "features").cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, tol=1e-5, standardization=True).fit(fitted)
    fitted.unpersist()
    rows.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleModel(names, float(lasso.intercept), [(float(w), r) for w, r in zip(weights, rules) if w != 0.0])


def scored(docs: DataFrame, model: RuleModel, score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; a column of that name is replaced. The expression runs in the JVM row by row."""
    stats = fresh(docs, "_stats")
    numbers = F.array(*(c.cast("double") for c in statistics(F.col("text")).values()))
    return docs.withColumn(stats, numbers).withColumn(score, model.score(F.col(stats))).drop(stats)


def held_out(doc_id: Column, modulus: int, kept: int) -> Column:
    """Whether the CRC-32 of the id as text has the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == kept, F.lit(False))


def op2_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, held_out, score, predicted.

    Learns from labelled rows that aren't held out (see fit). Null texts count as empty and
    are scored like any other; rows with a null doc_id are scored but never learned from;
    repeated rows come back as often as they came. Other columns are ignored.
    """
    model = fit(docs, labels, may_learn=~held_out(F.col("doc_id"), 3, 1))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs that score at least threshold, with the columns of docs; the model is fitted on all of labels (see fit)."""
    score = fresh(docs, "_score")
    return scored(docs, fit(docs, labels), score).where(F.col(score) >= threshold).drop(score)
