"""Texts with known results, and a small oracle with Python's own regular expressions."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from carewatch.functions import detect, rules, text
from carewatch.functions.lexicon import NEGATIONS, Term, starter_lexicon

GOLDEN = [
    ("Paciente nega violência doméstica.", [("violência doméstica", "legal_police", 14, 33, True)], 0.0, "SEM INDICAÇÃO", "Outros/Não Classificado", 1.0),
    ("Vítima de estupro pelo marido.", [("estupro", "medical_formal", 10, 17, False)], 2.8, "BAIXO", "Violência Sexual", 0.6664),
    ("Criança com negligência grave e abandono de incapaz.", [("negligência grave", "medical_formal", 12, 29, False), ("abandono de incapaz", "medical_formal", 32, 51, False)], 5.6, "BAIXO", "Negligência/Abandono", 0.7087),
    ("Paciente com ideação suicida e tentativa de suicídio.", [("ideação suicida", "medical_formal", 13, 28, False), ("tentativa de suicídio", "medical_formal", 31, 52, False)], 5.6, "BAIXO", "Violência Autoprovocada", 0.4723),
    ("Espancamento com fratura de costela.", [("fratura de costela", "medical_formal", 17, 35, False), ("Espancamento", "legal_police", 0, 12, False)], 5.3, "BAIXO", "Violência Física", 0.6691),
    ("Politraumatismo com fraturas múltiplas e hematomas múltiplos.", [("Politraumatismo", "medical_formal", 0, 15, False), ("fraturas múltiplas", "medical_formal", 20, 38, False), ("hematomas múltiplos", "healthcare_nursing", 41, 60, False)], 7.6, "MODERADO", "Violência Física", 0.7014),
    ("Paciente apresenta febre e tosse há 3 dias.", [], 0.0, "SEM INDICAÇÃO", "Outros/Não Classificado", 1.0),
    ("Consulta de rotina. Sem queixas.", [], 0.0, "SEM INDICAÇÃO", "Outros/Não Classificado", 1.0),
    ("", [], 0.0, "SEM INDICAÇÃO", "Outros/Não Classificado", 1.0),
    (None, [], 0.0, "SEM INDICAÇÃO", "Outros/Não Classificado", 1.0),
]


def test_goldens(spark):
    rows = spark.createDataFrame(list(enumerate(g[0] for g in GOLDEN)), "doc_id int, text string")
    got = rules.analyze(rows).orderBy("doc_id").collect()
    for r, (_, hits, score, level, kind, confidence) in zip(got, GOLDEN):
        assert [(d.term, d.category, d.start, d.end, d.negated) for d in r.detections] == hits
        assert (r.score, r.severity_level, r.notification_type) == (score, level, kind)
        assert r.confidence == pytest.approx(confidence, abs=2e-4)
        assert sum(r.all_probabilities.values()) == pytest.approx(1, abs=1e-3) and len(r.all_probabilities) == 8
        assert sum(r.category_scores.values()) == pytest.approx(r.score)


def naive(s, terms, cues):
    """The same detection over Python strings."""
    seen = []
    for rank in sorted({t.rank for t in terms}):
        mine = [t for t in terms if t.rank == rank]
        p = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(t.term) for t in sorted(mine, key=lambda t: -len(t.term))) + r")(?!\w)", re.I)
        for m in p.finditer(s):
            if not any(a < m.end() and m.start() < b for a, b, *_ in seen):
                cue = re.search(r"\b(?:" + "|".join(cues) + r")\b[^.!?]{0,100}$", s[max(0, m.start() - 120) : m.start()], re.I)
                seen.append((m.start(), m.end(), mine[0].category, bool(cue)))
    return sorted(seen)


def test_spans_equal_pythons(spark):
    rng = random.Random(5)
    terms = [Term("a", 0, 2.0, t) for t in ("órgão", "soco", "arma de fogo", "x-y")] + [Term("b", 1, 1.0, t) for t in ("arma", "soco forte", "fogo", "de")]
    parts = ["ÓRGÃO", "socos", "soco", "soco forte", "arma de fogo", "arma", "de", "x-y", "não", "sem", ". ", "! ", "\n", "\r\n", "🙂", " ", "  ", "nega", "é", "palavra", "arma\nde fogo"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += ["não " + "a" * n + " soco" for n in (97, 98, 99, 100, 101)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = rows.select("i", detect.detections(F.col("text"), terms, NEGATIONS).alias("d")).orderBy("i").collect()
    for r, s in zip(got, texts):
        assert sorted((d.start, d.end, d.category, d.negated) for d in r.d) == naive(s, terms, NEGATIONS), repr(s)
        assert all(s[d.start : d.end] == d.term for d in r.d)


def test_no_overlaps_and_order(spark):
    rows = spark.createDataFrame([("hematomas múltiplos, suspeita de violência doméstica e surra com faca",)], "text string")
    d = rows.select(detect.detections(F.col("text"), starter_lexicon()).alias("d")).first().d
    spans = sorted((x.start, x.end) for x in d)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert [(-x.weight, x.start) for x in d] == sorted((-x.weight, x.start) for x in d)


def test_sentence_and_context(spark):
    rows = spark.createDataFrame([("Primeira frase. Levou um soco ontem! Outra.",)], "text string")
    one = rows.select(detect.detections(F.col("text"), starter_lexicon()).alias("d"), detect.detections(F.col("text"), starter_lexicon(), compat=True).alias("c")).first()
    assert one.d[0].sentence == "Levou um soco ontem!" and one.c[0].sentence == ". Levou um soco ontem!"
    assert one.d[0].context == "Primeira frase. Levou um soco ontem! Outra."


def test_highlight(spark):
    spans = "array<struct<term:string,category:string,weight:double,start:int,end:int,negated:boolean>>"
    rows = spark.createDataFrame([("<b>test</b>", []), ("ab cd ef", [("ab", "k", 1.0, 0, 2, False), ("b c", "k", 1.0, 1, 4, False), ("ef", "k", 1.0, 6, 8, True)])], f"text string, d {spans}")
    a, b = (r[0] for r in rows.select(detect.highlighted(F.col("text"), F.col("d"))).collect())
    assert a == "&lt;b&gt;test&lt;/b&gt;"
    assert b.count("<mark") == 2 and "line-through" in b and b.endswith("ef</mark>")


def test_identifiers_and_pseudonym(spark):
    note = "RGHC: 1234567, CPF 123.456.789-00, paciente Maria da Silva Souza, DN: 20/05/1990"
    rows = spark.createDataFrame([("paciente Maria Silva RGHC: 1234567 CPF 123.456.789-00 DN: 20/05/1990",), (note,), ("nada",)], "text string")
    got = rows.select(text.extract_identifiers(F.col("text")).alias("i")).collect()
    assert got[0].i.rghc == "1234567" and got[0].i.cpf == "12345678900" and got[0].i.data_nascimento == "20/05/1990"
    assert got[0].i.nome_paciente.startswith("Maria Silva")
    from carewatch.operators.privacy import pseudonymized

    hashes = [r.patient_hash for r in pseudonymized(rows).collect()]
    assert len(hashes[0]) == 64 and hashes[2] is None


def test_cleaning_and_metadata(spark):
    raw = "a\n--- PÁGINA 2 (OCR) ---\nb\n\n\n\nc\x07 \t d  "
    rows = spark.createDataFrame([(raw, "Dr. João Souza, setor de Cardiologia, 10/03/2025 sinais vitais, enfermeiro")], "a string, b string")
    r = rows.select(text.clean_text(F.col("a")).alias("a"), text.document_metadata(F.col("b")).alias("m"), text.document_type(F.col("b")).alias("t")).first()
    assert r.a == "a\nb\n\nc d" and r.m.document_date == "10/03/2025" and r.m.author.startswith("Dr. João Souza") and r.t == "Anotações de Enfermagem"


def test_dates(spark):
    rows = spark.createDataFrame([("2025-03-15T10:00:00+00:00",), ("2025-03-10",), ("31/02/2025",), (None,), ("bad date text",)], "d string")
    got = [tuple(r) for r in rows.select(text.format_date_br(F.col("d")), text.parsed_date(F.col("d")).cast("string")).collect()]
    assert got == [("15/03/2025", "2025-03-15"), ("10/03/2025", "2025-03-10"), ("31/02/2025", None), ("", None), ("bad date t", None)]


def test_intensity_and_strict_negation(spark):
    rows = spark.createDataFrame([("sempre agrediu com faca na fratura foi agredida", 7, 14), ("nega que houve violência aqui", 15, 24), ("houve violência aqui", 6, 15)], "text string, s int, e int")
    got = [tuple(r) for r in rows.select(detect.contextual_intensity(F.col("text"), F.col("s"), F.col("e")), detect.negated_strictly(F.col("text"), F.col("s"), F.col("e"))).collect()]
    assert got[0][0] == 2.7 and [g[1] for g in got] == [False, True, False]


def test_features(spark):
    from pyspark.ml.functions import vector_to_array

    rows = spark.createDataFrame([("Vítima de estupro. Não houve surra.",)], "text string")
    v = rules.with_features(rules.analyze(rows)).select(vector_to_array("features")).first()[0]
    names = rules.feature_names()
    f = dict(zip(names, v))
    assert len(v) == len(names) == 35
    assert f["score_medical_formal"] == 2.8 and f["count_negated"] == 1 and f["pattern_sexual_violence"] == 1 and f["text_sentence_count"] == 2 and f["text_word_count"] == 6


def test_match_by_join_finds_terms_of_any_length(spark):
    terms = ["faca", "arma de fogo", "ferimento por arma de fogo", "um dois três quatro cinco seis sete oito nove", "--"]
    lexicon = spark.createDataFrame([("c", 0, 1.0, t) for t in terms], "category string, category_rank int, weight double, term string")
    docs = spark.createDataFrame([(1, "Ferimento por arma de fogo, faca"), (2, "um-dois três quatro cinco seis sete oito nove -- dez"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.position, r.term) for r in detect.match_by_join(docs, "doc_id", lexicon).collect()}
    assert got == {(1, 1, terms[2]), (1, 3, terms[1]), (1, 6, terms[0]), (2, 1, terms[3])}
    assert detect.match_by_join(docs, "doc_id", lexicon.limit(0)).count() == 0


def test_detection_has_no_python(spark):
    rows = spark.createDataFrame([("x",)], "text string")
    plan = rules.analyze(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_match_by_join_sends_the_lexicon(spark):
    """The lexicon is the broadcast side up to the bound, and shuffled beyond it, with the same rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = re.findall(r"\w+", docs.where("length(text) > 100").first().text.lower())
    lexicon = spark.createDataFrame([("c", 0, 1.0, some[0]), ("c", 0, 1.0, f"{some[1]} {some[2]}"), ("d", 1, 2.0, some[3])], "category string, category_rank int, weight double, term string")
    small, large = detect.match_by_join(docs, "doc_id", lexicon), detect.match_by_join(docs, "doc_id", lexicon, broadcast_terms=1)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "leftHint" not in plan
    assert sorted(small.collect()) == sorted(large.collect()) != []


def test_flags_need_no_hints(spark):
    """Hints only spare work: flags are the same without them."""
    said = ["ESTUPRO conjugal", "obrigou a um ato  sexual", "Ideação\nSuicida", "AUTOMUTILAÇÃO", "má  higiene", "cárcere privado", "todo dia ele bate", "arma de fogo", "na frente das crianças", "chutou a barriga", "vou te matar", "fraturas múltiplas", "menor trabalhando", "tráfico de pessoas", "nada", None, ""]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    got = rows.select(text.pattern_flags(F.col("t")).alias("a"), text.pattern_flags(F.col("t"), hints={}).alias("b")).collect()
    assert all(r.a == r.b for r in got) and [any(r.a) for r in got] == [True] * 14 + [False] * 3


def test_negation_cues_of_several_words(spark):
    """A hit 95 characters after `sem evidências`; a cue's blank is any white space, and 101 characters are too far."""
    said = [f"sem evidências{' ' + 'a' * (n - 2) + ' '}estupro" for n in (95, 100, 101)] + ["sem\n indícios " + "a" * 90 + " estupro", "sem sinaisx " + "a" * 95 + " estupro"]
    got = [r.d[0].negated for r in spark.createDataFrame([(t,) for t in said], "text string").select(detect.detections(F.col("text"), starter_lexicon()).alias("d")).collect()]
    assert got == [True, True, False, True, False]


def test_a_dense_document_takes_little_time(spark):
    """The work grows with the hits, not with their square."""
    import time

    rows = spark.createDataFrame([("Levou um soco e uma faca é. " * 10_000,)], "text string")
    found = rows.select(detect.detections(F.col("text"), starter_lexicon()).alias("d")).select(F.size("d"), F.xxhash64("d"), F.col("d")[0]["sentence"], F.col("d")[19_999]["context"])
    found._jdf.queryExecution().executedPlan()
    took = []
    for _ in range(3):
        began = time.perf_counter()
        r = found.first()
        took.append(time.perf_counter() - began)
    assert r[0] == 20_000 and r[2] == "Levou um soco e uma faca é." and r[3].count("soco") == 5
    assert min(took) < 2 * 2  # 1.2 s on an idle machine


def test_overlaps_equal_a_plain_loop(spark):
    rng = random.Random(11)
    lists = []
    for _ in range(300):
        some = []
        for _ in range(rng.randint(0, 5)):
            at, spans = 0, []
            for _ in range(rng.randint(0, 8)):
                start = at + rng.randint(0, 6)
                at = start + rng.randint(1, 5)
                spans.append((start, at, "t", "c", 1.0))
            some.append(spans)
        lists.append(some)
    df = spark.createDataFrame(list(enumerate(lists)), f"i int, s array<array<{detect.FLAT}>>")
    for r in df.select("i", detect.without_overlaps(F.col("s")).alias("k")).collect():
        kept = []
        for spans in lists[r.i]:
            kept += [s for s in spans if not any(a[0] < s[1] and s[0] < a[1] for a in kept)]
        assert [(x.start, x.end) for x in r.k] == [s[:2] for s in sorted(kept)]


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(k, [rng.randint(0, 9) for _ in range(n)]) for k, n in enumerate([0, 1, 127, 128, 129, 256, 1000])]
    for r, (_, a) in zip(spark.createDataFrame(rows, "k int, a array<int>").select("k", detect.totals(F.col("a")).alias("t")).orderBy("k").collect(), rows):
        assert list(r.t) == [sum(a[: i + 1]) for i in range(len(a))]


def lexicon_of(spark, terms):
    return spark.createDataFrame([(t.category, t.rank, t.weight, t.term) for t in terms], "category string, category_rank int, weight double, term string")


def test_automaton_equals_patterns(spark):
    from carewatch.functions import automaton

    rng = random.Random(6)
    terms = [Term("a", 0, 2.0, t) for t in ("órgão", "soco", "arma de fogo", "x-y", "ς", "STRASSE")] + [Term("b", 1, 1.0, t) for t in ("arma", "soco forte", "fogo", "de", "soco")] + [Term("c", 2, 1.5, t) for t in ("sem", "-")]
    parts = ["ÓRGÃO", "socos", "soco", "soco forte", "arma de fogo", "arma", "de", "x-y", "não", "sem", ". ", "! ", "\n", "🙂", "İ", "straße", "ΑΣ", "Σ", "é", "e\u0301", "_de", "de²", "-"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "soco" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = rows.select("i", detect.detections(F.col("text"), terms).alias("detections"))
    got = automaton.detected(rows, lexicon_of(spark, terms + terms[:2])).select("i", "detections")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert automaton.detected(rows, lexicon_of(spark, terms).limit(0)).where("size(detections) > 0").count() == 0
    with pytest.raises(ValueError):
        automaton.detected(rows, lexicon_of(spark, terms), most_terms=5)


def test_automaton_is_flat_in_the_number_of_terms():
    import time

    from carewatch.functions.automaton import Matcher

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(7, 12)))
    said = " ".join(word() for _ in range(20_000))
    took = []
    for n in (500, 50_000):
        m = Matcher([(0, "c", 1.0, word()) for _ in range(n)] + [(0, "c", 1.0, said.split()[0])])
        began = time.perf_counter()
        assert m.spans(said)[0][0]["start"] == 0
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0], took
