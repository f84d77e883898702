"""Scalar functions over clinical text, all built of column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import trimmed
from .lexicon import SEVERITIES, TYPES

# Patterns of clinical findings.
FLAGS = {
    "sexual_violence": [r"\b(?:estupro|abuso\s+sexual|violência\s+sexual|sexo\s+forçado|estupro\s+conjugal)\b", r"\b(?:forçou|obrigou)\b.{0,40}\b(?:relação|ato\s+sexual|sexo)\b"],
    "self_harm": [r"\b(?:ideação\s+suicida|tentativa\s+de\s+suicídio|automutilação|autolesão|autoextermínio|comportamento\s+autodestrutivo)\b"],
    "neglect": [r"\b(?:negligência|abandono\s+de\s+incapaz|desnutrição|desidratação\s+severa|má\s+higiene|privação\s+de\s+alimentos|falta\s+de\s+higiene)\b"],
    "psychological_control": [r"\b(?:controle\s+coercitivo|cárcere\s+privado|isolamento\s+social\s+forçado|proibição\s+de\s+(?:sair|trabalhar|estudar)|gaslighting|tortura\s+psicológica)\b"],
    "chronic_violence": [r"\b(?:sempre|todo\s+dia|constantemente|frequentemente|anos|rotina|recorrente|repetid[ao]|crônic[ao])\b.{0,60}\b(?:agred|bat|violent|maltrat|espanc)\w*"],
    "weapons_involved": [r"\b(?:arma\s+de\s+fogo|arma\s+branca|faca|revólver|pistola|martelo|objeto\s+contundente)\b"],
    "children_present": [r"\b(?:na\s+frente\s+d[ao]s?\s+crianças?|filh[oa]s?\s+(?:viu|assistiu|presenci)|menor\s+exposto|crianças\s+presentes)\b"],
    "pregnancy_violence": [r"\b(?:grávida|gestante|gestação).{0,80}(?:agred|bat|chut|violent|espanc)\w*", r"\b(?:agred|bat|chut|violent|espanc)\w*.{0,80}\b(?:grávida|gestante|barriga)\b"],
    "death_threats": [r"\b(?:vou\s+te\s+matar|vai\s+morrer|ameaçou\s+de\s+morte|prometeu\s+matar|disse\s+que\s+mata)\b"],
    "multiple_injuries": [r"\b(?:fraturas?\s+múltiplas?|equimoses?\s+múltiplas?|hematomas?\s+múltiplos?|politraumatismo|lesões\s+em\s+diferentes\s+estágios)\b"],
    "child_labor": [r"\b(?:trabalho\s+infantil|menor\s+trabalhando|criança\s+trabalha|exploração\s+de\s+menor)\b"],
    "human_trafficking": [r"\b(?:tráfico\s+de\s+pessoas?|exploração\s+sexual\s+comercial|escravidão\s+sexual|aliciamento)\b"],
}

#: Parts of words, one of which a text must have for a pattern of the flag to match: they are looked for first.
HINTS = {
    "sexual_violence": ["estupro", "sexual", "sexo", "relação"],
    "self_harm": ["suic", "auto"],
    "neglect": ["negligência", "abandono", "desnutrição", "desidratação", "higiene", "privação"],
    "psychological_control": ["coercitivo", "cárcere", "isolamento", "proibição", "gaslighting", "tortura"],
    "chronic_violence": ["sempre", "todo", "constantemente", "frequentemente", "anos", "rotina", "recorrente", "repetid", "crônic"],
    "weapons_involved": ["arma", "faca", "revólver", "pistola", "martelo", "contundente"],
    "children_present": ["criança", "filh", "exposto"],
    "pregnancy_violence": ["grávida", "gestante", "gestação", "barriga"],
    "death_threats": ["mata", "morrer", "morte"],
    "multiple_injuries": ["múltipl", "politraumatismo", "estágios"],
    "child_labor": ["infantil", "menor", "criança"],
    "human_trafficking": ["tráfico", "exploração", "escravidão", "aliciamento"],
}

# Substrings of the additive severity patterns with what each adds.
SEVERITY_PATTERNS = {
    "chronic_violence": (["sempre", "todo dia", "constantemente", "anos", "rotina", "frequentemente"], 1.2),
    "weapons_involved": (["faca", "revolver", "pistola", "arma", "martelo"], 1.8),
    "children_present": (["na frente das crianças", "criança viu", "filho assistiu"], 1.5),
    "pregnancy_violence": (["grávida", "gestante", "chutou barriga"], 2.2),
    "sexual_violence": (["estupro", "abuso sexual", "forçou", "obrigou"], 2.5),
    "death_threats": (["vou te matar", "vai morrer", "ameaçou de morte"], 2.0),
}

# Keywords of document types; the first type with the most keywords wins.
DOCUMENT_TYPES = {
    "Evolução Médica": ["evolução médica", "evolucao medica", "evolução diária", "médico responsável", "crm", "prescrição médica"],
    "Anotações de Enfermagem": ["anotação de enfermagem", "anotações de enfermagem", "coren", "enfermeiro", "técnico de enfermagem", "auxiliar de enfermagem", "sinais vitais"],
    "Multiprofissional": ["multiprofissional", "equipe multidisciplinar", "fisioterapia", "nutrição", "psicologia", "serviço social", "assistente social"],
}

# Patterns of metadata and identifiers, each with the group that is taken.
METADATA = {
    "document_date": (r"\b(\d{2}[/\-]\d{2}[/\-]\d{4}|\d{4}[/\-]\d{2}[/\-]\d{2})\b", 0),
    "author": (r"(?iU)(?:Dr\.?|Dra\.?|Enf\.?)\s+([A-ZÀ-Ú][a-zà-ú]+(?:\s+[A-ZÀ-Ú][a-zà-ú]+)*)", 0),
    "service": (r"(?iU)(?:serviço|setor|unidade|ala)\s*(?:de\s+)?([A-ZÀ-Úa-zà-ú\s]{3,40})", 1),
}
UPPER, LOWER = "A-ZÁÉÍÓÚÂÊÎÔÛÃÕÀÈÌÒÙÇ", "a-záéíóúâêîôûãõàèìòùç"
IDENTIFIERS = {
    "rghc": (r"(?iU)\b(?:RGHC?|RG\s*HC)\s*[:\-]?\s*(\d{5,12})\b", 1),
    "cpf": (r"(?U)\b(\d{3}[.\s]?\d{3}[.\s]?\d{3}[\-\s]?\d{2})\b", 1),
    "nome_paciente": (rf"(?U)\b(?:paciente|nome|pac\.?)\s*[:\-]?\s*([{UPPER}][{LOWER}]+(?:\s+[{UPPER}][{LOWER}]+){{1,5}})", 1),
    "data_nascimento": (r"(?iU)\b(?:DN|nascimento|nasc\.?)\s*[:\-]?\s*(\d{2}[/\-]\d{2}[/\-]\d{4})\b", 1),
}


def clean_text(text: Column) -> Column:
    """Without page markers and control signs, with at most one empty line and single blanks, trimmed."""
    for pattern, put in ((r"(?U)\n?---\s*PÁGINA\s+\d+\s*(?:\(OCR\))?\s*---\n?", "\n"), (r"\n{3,}", "\n\n"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"[ \t]+", " ")):
        text = F.regexp_replace(text, pattern, put)
    return trimmed(text)


def stripped_length(text: Column) -> Column:
    return F.length(trimmed(F.coalesce(text, F.lit(""))))


def sufficient_text(text: Column, least: int = 30) -> Column:
    return stripped_length(text) >= least


def text_quality(text: Column) -> Column:
    n = stripped_length(text)
    return F.when(n >= 2000, "excelente").when(n >= 500, "boa").when(n >= 30, "regular").otherwise("ruim")


def severity(score: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, least, _ in SEVERITIES[:4]:
        out = out.when(score >= least, name)
    return out.when(score > 0, SEVERITIES[4][0]).otherwise(SEVERITIES[5][0])


def severity_rank(name: Column) -> Column:
    """1 for the gravest; 0 for an unknown one."""
    return F.array_position(F.array(*(F.lit(s[0]) for s in SEVERITIES)), name)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def text_stats(text: Column) -> Column:
    """struct<char_count, word_count, sentence_count, avg_word_len, avg_sentence_len> of doubles; 0 where nothing divides."""
    text = F.coalesce(text, F.lit(""))
    w = words(text)
    sentences = F.size(F.filter(F.split(text, r"[.!?\n]+"), lambda s: trimmed(s) != ""))
    chars = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    parts = {"char_count": F.length(text), "word_count": F.size(w), "sentence_count": sentences, "avg_word_len": share(chars, F.size(w)), "avg_sentence_len": share(F.size(w), sentences)}
    return F.struct(*(c.cast("double").alias(n) for n, c in parts.items()))


def pattern_flags(text: Column, flags: dict[str, list[str]] = FLAGS, hints: dict[str, list[str]] = HINTS) -> Column:
    """struct of booleans; negation doesn't matter to them.

    A flag with hints runs its patterns only on texts that contain one of them, whatever
    the case; flags without are all tried together first.
    """
    text = F.coalesce(text, F.lit(""))
    pattern = lambda some: "(?isU)" + "|".join(f"(?:{p})" for p in some)
    rest = [p for n, patterns in flags.items() if n not in hints for p in patterns]
    any_rest = text.rlike(pattern(rest)) if rest else F.lit(False)

    def struct(low: Column) -> Column:
        likely = {n: reduce(Column.__or__, (F.contains(low, F.lit(h)) for h in hints[n])) for n in flags if n in hints}
        return F.struct(*((likely.get(n, any_rest) & text.rlike(pattern(patterns))).alias(n) for n, patterns in flags.items()))

    return F.transform(F.array(F.lower(F.upper(text))), struct)[0]


def severity_patterns(text: Column, patterns: dict = SEVERITY_PATTERNS) -> Column:
    """struct of booleans and their added severity."""
    text = F.lower(F.coalesce(text, F.lit("")))
    hit = {n: F.greatest(*(F.contains(text, F.lit(k)) for k in keys), F.lit(False)) for n, (keys, _) in patterns.items()}
    total = sum((F.when(hit[n], F.lit(more)).otherwise(F.lit(0.0)) for n, (_, more) in patterns.items()), F.lit(0.0))
    return F.struct(*(c.alias(n) for n, c in hit.items()), F.round(total, 1).alias("pattern_severity_score"))


def document_type(text: Column, types: dict[str, list[str]] = DOCUMENT_TYPES, other: str = "Outros") -> Column:
    text = F.lower(F.coalesce(text, F.lit("")))
    counts = F.array(*(sum((F.contains(text, F.lit(k)).cast("int") for k in keys), F.lit(0)) for keys in types.values()))
    best = F.array_max(counts)
    return F.when(best > 0, F.element_at(F.array(*map(F.lit, types)), F.array_position(counts, best).cast("int"))).otherwise(other)


def first_match(text: Column, pattern: str, group: int) -> Column:
    """The first match, trimmed; null if there is none."""
    return F.nullif(trimmed(F.regexp_extract(text, pattern, group)), F.lit(""))


def document_metadata(text: Column, patterns: dict = METADATA) -> Column:
    return F.struct(*(first_match(text, p, g).alias(n) for n, (p, g) in patterns.items()))


def extract_identifiers(text: Column, patterns: dict = IDENTIFIERS) -> Column:
    """struct with the first match of each pattern; a cpf keeps its digits alone."""
    out = {n: first_match(text, p, g) for n, (p, g) in patterns.items()}
    if "cpf" in out:
        out["cpf"] = F.regexp_replace(out["cpf"], r"[.\s\-]", "")
    return F.struct(*(c.alias(n) for n, c in out.items()))


def patient_hash(rghc: Column, cpf: Column, name: Column) -> Column:
    """Stable pseudonym of the identifiers, missing ones empty."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("|", trimmed(empty(rghc)), F.regexp_replace(empty(cpf), r"\D", ""), F.lower(trimmed(empty(name)))), 256)


#: The pseudonym of a document without any identifier: not a patient.
UNKNOWN_PATIENT = "565d240f5343e625ae579a4d45a770f1f02c6368b5ed4d06da4fbe6f47c28866"


def parsed_date(raw: Column) -> Column:
    """A date of yyyy-MM-dd or dd/MM/yyyy, with - or /; null if it is neither."""
    day = F.left(raw, F.lit(10))
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy")
    return F.coalesce(*(F.try_to_timestamp(day, F.lit(f)) for f in formats)).cast("date")


def format_date_br(raw: Column) -> Column:
    """dd/MM/yyyy of an ISO date or time, else its first 10 characters; null is empty."""
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.left(raw, F.lit(10)), F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(iso, "dd/MM/yyyy"), F.left(raw, F.lit(10)), F.lit(""))


def code_of(kind: Column, k: int, default: str) -> Column:
    """Form code (k 0) or ICD-10 code (k 1) of a notification type."""
    pairs = [F.lit(x) for t, codes in TYPES.items() for x in (t, codes[k])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(default))


def week_label(ts: Column) -> Column:
    """%Y-W%W: weeks begin on Monday, days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
