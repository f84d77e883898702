"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .quality import held_out

#: Most documents of a language that a model is fitted on.
FIT_ROWS = 1500
#: Vectors of the sample in a task, about.
TASK_ROWS = 8192
#: Dimensions of the hashed grams, grams of 1 to GRAMS bytes, bytes counted at a time.
DIM, GRAMS, STEP = 2048, 3, 1 << 20
#: Steps of each fit; every step is a Spark job over the sample.
STEPS = 20
#: Families of language codes; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "is"), "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "uralic": ("fi", "et", "hu"), "indic": ("hi", "bn", "mr", "ne"), "turkic": ("tr", "az", "kk"),
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), f"only {lang}")


def grams(text: str, dim: int = DIM) -> np.ndarray:
    """Square roots of the shares of the hashed byte grams of a whole lower-cased text, as a unit vector."""
    data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    counts = np.zeros(dim)
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP + GRAMS - 1].astype(np.uint32)
        h = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, GRAMS + 1):
            m = min(len(part) - n + 1, STEP)  # grams that start in this step
            if m <= 0:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
            mixed = h[:m] * np.uint32(0x9E3779B1)
            counts += np.bincount(mixed >> np.uint32(32 - dim.bit_length() + 1), minlength=dim)
    return np.sqrt(counts / counts.sum()) if len(data) else counts


class Model:
    """sampled: documents learned from by language; family: (names, weights, biases) of a multinomial logistic regression; pairs: (a, b) -> (weights, bias), positive for b."""

    def __init__(self, sampled: dict[str, int], family, pairs: dict):
        self.sampled, self.langs, self.family, self.pairs = sampled, sorted(sampled), family, pairs
        self.members = {f: [x for x in self.langs if family_of(x) == f] for f in family[0]}

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the family's probability times the mean certainty of the winner's duels."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        x = grams(text)
        names, weights, biases = self.family
        z = weights @ x + biases
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        langs = self.members[names[best]]
        if len(langs) == 1:
            return langs[0], float(p[best])
        won, sure = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            w, bias = self.pairs[a, b]
            up = 1 / (1 + np.exp(-min(max(4 * (w @ x + bias), -50), 50)))
            won[b if up >= 0.5 else a] += 1
            sure[a] += 1 - up
            sure[b] += up
        lang = max(langs, key=lambda x: (won[x], sure[x]))
        return lang, float(p[best] * sure[lang] / (len(langs) - 1))


def fit(docs: DataFrame, may_learn=None, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on about fit_rows documents of each language of docs(doc_id, text, lang), chosen by hashes of doc_id and text.

    Rows without a text, a letter or a language are left out. The bounded sample's gram
    vectors are stored once, in several tasks, and all models are fitted by Spark; a language
    that has fewer rows gives all of them. Very long texts are read whole; rows that repeat a
    document count as often as they came. With no rows every prediction is `und`; with one
    language there is no choice to learn.
    """
    scratch = Scratch(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known if may_learn is None else known.where(may_learn)
    shares = known.groupBy("lang").agg((F.lit(fit_rows) / F.count("*")).alias("_share"))
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(1 << 30)) / (1 << 30)

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([grams(t) for t in texts])

    known = known.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang")
    sample = known.where(place < F.col("_share")).where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", vector("text").alias("x"))
    sample = scratch.stored(sample, "vectors")
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    langs, tasks = sorted(sizes), max(1, -(-sum(sizes.values()) // TASK_ROWS))
    sample = scratch.sample(sample, tasks, "doc_id", "lang", "x")
    families = sorted({family_of(x) for x in langs})
    place_of = {f: float(k) for k, f in enumerate(families)}
    numbers = docs.sparkSession.createDataFrame([(x, place_of[family_of(x)]) for x in langs], "lang string, family double")
    sample = sample.join(F.broadcast(numbers), "lang").withColumn("features", array_to_vector("x")).drop("x").cache()
    if len(families) > 1:
        got = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=STEPS).fit(sample.withColumnRenamed("family", "label"))
        family = (families, got.coefficientMatrix.toArray(), got.interceptVector.toArray())
    else:
        family = (families, np.zeros((len(families), DIM)), np.zeros(len(families)))
    pairs = {}
    for a, b in combinations(langs, 2):
        if family_of(a) == family_of(b):
            rows = sample.where(F.col("lang").isin(a, b)).withColumn("label", (F.col("lang") == b).cast("double"))
            got = LinearSVC(regParam=1e-4, maxIter=STEPS).fit(rows)
            pairs[a, b] = (got.coefficients.toArray(), float(got.intercept))
    sample.unpersist()
    return Model(sizes, family, pairs)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced. Null text or one without a letter: und, 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # weights of the families and pairs: DIM for each family and pair

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang", "score"])

    both = fresh(docs, "_guess")
    return docs.withColumn(both, guess("text")).withColumn("lang_pred", F.col(f"{both}.lang")).withColumn("score", F.col(f"{both}.score")).drop(both)


def op9_langid(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, lang, ...): doc_id, held_out, lang_pred, score.

    Learns from documents that aren't held out and have a text and a language (see fit).
    Texts that are null or have no letter are `und` with score 0; of languages with equal
    duels the surer one is taken, then the first by name. Rows with a null doc_id are
    predicted like any other; repeated rows come back as often as they came. Other columns
    are ignored; an empty table gives an empty result.
    """
    model = fit(docs, may_learn=~held_out(F.col("doc_id"), 4, 2))
    rows = predicted(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
