"""Reference tables as data: lexicon, notification types, severities and codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Categories in order of precedence with their weights.
CATEGORIES = {
    "medical_formal": 2.8,
    "legal_police": 2.5,
    "maria_penha_domestic": 2.3,
    "healthcare_nursing": 2.0,
    "colloquial_popular": 1.8,
    "orthographic_variations": 1.5,
    "psychological_abuse": 1.9,
    "child_specific": 2.7,
}

# A starter list of terms. The full list of an institution is a table, see read_lexicon.
STARTER = {
    "medical_formal": ["politraumatismo", "fraturas múltiplas", "fratura de costela", "equimoses múltiplas", "hematoma subdural", "estupro", "abuso sexual", "violência sexual", "negligência grave", "abandono de incapaz", "ideação suicida", "tentativa de suicídio", "automutilação"],
    "legal_police": ["agressão física", "violência física", "lesão corporal", "violência doméstica", "ameaça", "ameaça de morte", "cárcere privado", "arma de fogo", "faca", "espancamento", "surra"],
    "maria_penha_domestic": ["violência doméstica", "violência psicológica", "violência conjugal", "gaslighting", "controle coercitivo"],
    "healthcare_nursing": ["hematomas múltiplos", "suspeita de violência doméstica", "lesões recentes"],
    "colloquial_popular": ["soco", "chute", "tapa", "murro", "me bateu"],
    "orthographic_variations": ["agressao", "violencia", "espancou"],
    "psychological_abuse": ["humilhação constante", "isolamento social"],
    "child_specific": ["maus-tratos infantis", "abuso infantil", "abandono de incapaz"],
}

# Notification types in order (ties go to the first), each with its form code and ICD-10 code.
TYPES = {
    "Violência Física": ("1", "T74.1"),
    "Violência Sexual": ("2", "T74.2"),
    "Violência Psicológica/Moral": ("3", "T74.3"),
    "Violência Autoprovocada": ("4", "X84"),
    "Negligência/Abandono": ("5", "T74.0"),
    "Trabalho Infantil": ("6", "T74.4"),
    "Tráfico de Pessoas": ("7", "T74.8"),
    "Outros/Não Classificado": ("9", "T74.9"),
}

# Severities from the gravest, with the least score (above 0 for the fifth) and the outcome code.
SEVERITIES = [("CRÍTICO", 20.0, "3"), ("ALTO", 12.0, "2"), ("MODERADO", 6.0, "2"), ("BAIXO", 2.0, "1"), ("MÍNIMO", 0.0, "1"), ("SEM INDICAÇÃO", None, "1")]

# States of a case.
STATUSES = ["pendente", "em análise", "notificado", "arquivado"]

# Cues that negate a finding that follows.
NEGATIONS = ["não", "nao", "jamais", "nunca", "nega", "negou", "descarta", "descartado", "afasta", "afastado", "exclui", "excluído", "ausente", "sem", "inexistente", "improvável", "sem evidências", "sem indícios", "sem sinais"]


@dataclass(frozen=True)
class Term:
    category: str
    rank: int
    weight: float
    term: str


def terms_of(by_category: dict[str, list[str]], weights: dict[str, float]) -> list[Term]:
    return [Term(c, k, float(weights[c]), t) for k, c in enumerate(by_category) for t in by_category[c]]


def starter_lexicon() -> list[Term]:
    return terms_of(STARTER, CATEGORIES)


def lexicon_table(spark: SparkSession, terms: list[Term] | None = None) -> DataFrame:
    """(category, category_rank, weight, term)."""
    rows = [(t.category, t.rank, t.weight, t.term) for t in (starter_lexicon() if terms is None else terms)]
    return spark.createDataFrame(rows, "category string, category_rank int, weight double, term string")


def read_lexicon(table: DataFrame, most: int = 20_000) -> list[Term]:
    """The lexicon of a table (category, category_rank, weight, term), for expressions; a larger one than `most` is for match_by_join."""
    rows = table.select("category", "category_rank", "weight", "term").where("term is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms: use match_by_join")
    return sorted((Term(r[0], int(r[1]), float(r[2]), r[3]) for r in rows), key=lambda t: (t.rank, t.category, t.term))
