"""Features of a text and its notification type by rules."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import detections, score
from .lexicon import CATEGORIES, NEGATIONS, TYPES, Term, starter_lexicon
from .text import FLAGS, pattern_flags, severity, text_stats

# For each type the flag it needs with its weight, and categories that add half of a score at or above the least.
RULES = {
    "Violência Física": (None, 0.0, ("medical_formal", "legal_police", "colloquial_popular"), 2.0),
    "Violência Sexual": ("sexual_violence", 3.0, (), 0.0),
    "Violência Psicológica/Moral": ("psychological_control", 2.0, ("psychological_abuse", "maria_penha_domestic"), 3.0),
    "Violência Autoprovocada": ("self_harm", 3.0, (), 0.0),
    "Negligência/Abandono": ("neglect", 4.0, ("child_specific",), 2.0),
    "Trabalho Infantil": ("child_labor", 3.0, (), 0.0),
    "Tráfico de Pessoas": ("human_trafficking", 3.0, (), 0.0),
    "Outros/Não Classificado": (None, 0.0, (), 0.0),
}
STATS = ("char_count", "word_count", "sentence_count", "avg_word_len", "avg_sentence_len")


def of_category(found: Column, category: str) -> Column:
    return F.filter(found, lambda s: s["category"] == category)


def category_scores(found: Column, categories=tuple(CATEGORIES)) -> Column:
    """map category -> sum of the weights of its hits that aren't negated."""
    return F.map_from_arrays(F.array(*map(F.lit, categories)), F.array(*(score(of_category(found, c)) for c in categories)))


def category_counts(found: Column, categories=tuple(CATEGORIES)) -> Column:
    live = F.filter(found, lambda s: ~s["negated"])
    return F.map_from_arrays(F.array(*map(F.lit, categories)), F.array(*(F.size(of_category(live, c)) for c in categories)))


def negated_count(found: Column) -> Column:
    return F.size(F.filter(found, lambda s: s["negated"]))


def rule_scores(scores: Column, flags: Column, rules: dict = RULES) -> Column:
    """array<double> in order of the types."""
    out = []
    for flag, weight, bonus, least in rules.values():
        total = F.lit(weight)
        for c in bonus:
            total = total + F.when(scores[c] >= least, scores[c] * 0.5).otherwise(0.0)
        out.append(F.when(flags[flag], total).otherwise(0.0) if flag else total)
    return F.array(*out)


def rule_probabilities(scores: Column) -> Column:
    """Softmax with 4 decimals; with no rule at all the last type has 1."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    soft = F.transform(powers, lambda p: F.bround(p / total, 4))
    none = F.array(*([F.lit(0.0)] * (len(TYPES) - 1)), F.lit(1.0))
    return F.when(top <= 0, none).otherwise(soft)


def best_type(probabilities: Column) -> Column:
    """The likeliest type, the first of equals."""
    return F.element_at(F.array(*map(F.lit, TYPES)), F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def probabilities_map(probabilities: Column) -> Column:
    """map type -> probability."""
    return F.map_from_arrays(F.array(*map(F.lit, TYPES)), probabilities)


def to_json(probabilities: Column) -> Column:
    """The map as JSON text, as it is stored."""
    return F.to_json(probabilities)


def from_json(stored: Column) -> Column:
    """The map of what to_json gave; null for a text that isn't such a map."""
    return F.from_json(stored, "map<string,double>")


def feature_names(categories=tuple(CATEGORIES), flags=tuple(FLAGS)) -> list[str]:
    return [*(f"score_{c}" for c in categories), *(f"count_{c}" for c in categories), "count_negated", "total_score", *(f"pattern_{f}" for f in flags), *(f"text_{s}" for s in STATS)]


def feature_array(scores: Column, counts: Column, negated: Column, total: Column, flags: Column, stats: Column, categories=tuple(CATEGORIES), flag_names=tuple(FLAGS)) -> Column:
    """The numbers of feature_names, as array<double>."""
    parts = [*(scores[c] for c in categories), *(counts[c] for c in categories), negated, total, *(flags[f].cast("int") for f in flag_names), *(stats[s] for s in STATS)]
    return F.array(*(p.cast("double") for p in parts))


def detected(docs: DataFrame, lexicon: list[Term] | None = None, cues: list[str] = NEGATIONS, text: str = "text") -> DataFrame:
    """docs with detections."""
    return docs.withColumn("detections", detections(F.col(text), starter_lexicon() if lexicon is None else lexicon, cues))


def analyze(docs: DataFrame, lexicon: list[Term] | None = None, cues: list[str] = NEGATIONS, categories=tuple(CATEGORIES), text: str = "text", mode: str = "rules") -> DataFrame:
    """docs with detections, scores, features, type, confidence, probabilities, severity and mode, in one narrow stage.

    The hits are found once: everything after reads the array. Null and empty texts have
    no hits, score 0 and the last type with confidence 1.
    """
    live = detected(docs, lexicon, cues, text)
    live = live.withColumn("category_scores", category_scores(F.col("detections"), categories)).withColumn("category_counts", category_counts(F.col("detections"), categories))
    live = live.withColumn("negated_count", negated_count(F.col("detections"))).withColumn("score", score(F.col("detections")))
    live = live.withColumn("flags", pattern_flags(F.col(text))).withColumn("stats", text_stats(F.col(text)))
    known = F.map_concat(F.map_from_arrays(F.array(*(F.lit(c) for c in CATEGORIES if c not in categories)), F.array(*(F.lit(0.0) for c in CATEGORIES if c not in categories))), F.col("category_scores")) if set(CATEGORIES) - set(categories) else F.col("category_scores")
    live = live.withColumn("probabilities", rule_probabilities(rule_scores(known, F.col("flags"))))
    live = live.withColumn("notification_type", best_type(F.col("probabilities"))).withColumn("confidence", F.array_max("probabilities"))
    live = live.withColumn("all_probabilities", probabilities_map(F.col("probabilities"))).drop("probabilities")
    return live.withColumn("severity_level", severity(F.col("score"))).withColumn("mode", F.lit(mode))


def with_features(analysed: DataFrame, categories=tuple(CATEGORIES), embedding: str | None = None) -> DataFrame:
    """analysed with features, an ML vector: the fixed numbers, then those of an embedding column if one is named."""
    numbers = feature_array(F.col("category_scores"), F.col("category_counts"), F.col("negated_count"), F.col("score"), F.col("flags"), F.col("stats"), categories)
    return analysed.withColumn("features", array_to_vector(F.concat(numbers, F.col(embedding).cast("array<double>")) if embedding else numbers))
