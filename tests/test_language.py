"""Spelling, names meant, texts alike, names in texts, grounded answers and calculated columns against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from lucerna.functions import matching as MT
from lucerna.functions import spelling as SP
from lucerna.operators import calculated as C
from lucerna.operators import model as M
from lucerna.operators import tables as T
from lucerna.plans import grounding as G
from lucerna.plans import naming as NM
from lucerna.plans import references as RF
from lucerna.plans import similar as SM

WORDS = "cirugia hospitalizacion consulta urgencias egresos ingresos paciente servicio lavanderia facturacion especialidad quirofano ambulatorio honorarios hoja boton vacuna zapato queso guitarra jirafa yegua cama camas".split()


def test_distance():
    cases = {("casa", "casa"): 0, ("casa", "caza"): 0.5, ("hola", "ola"): 0.5, ("abc", "acb"): 1, ("baca", "vaca"): 0.5, ("kaso", "caso"): 0.5, ("perro", "pero"): 1, ("gente", "jente"): 0.5, ("xyz", "a"): 3.0}
    assert {k: SP.distance(*k, 2.0) for k in cases} == cases


def test_corrections_against_all_pairs(spark):
    """Planted errors of every kind: the join by deletions finds what a comparison of all pairs finds."""
    dice = random.Random(8)
    typos = {"cirujia", "sirujia", "ospitalisasion", "consutla", "urgensias", "egrsos", "fakturacion", "kirofano", "onorarios", "voton", "bacuna", "sapato", "keso", "gitarra", "girafa", "llegua", "CIRUGIA", "camaa", "ab12cdef", "x" * 60, "ingersos", "pacientes", "consultas", "servicia", "quirofanos"}
    for w in WORDS:
        for _ in range(12):
            x = list(w)
            for _ in range(dice.randrange(1, 3)):
                i = dice.randrange(len(x))
                kind = dice.randrange(4)
                if kind == 0 and len(x) > 3:
                    del x[i]
                elif kind == 1:
                    x.insert(i, dice.choice("aeiohsczbv"))
                elif kind == 2:
                    x[i] = dice.choice("aeiosczbvgjykq")
                elif i + 1 < len(x):
                    x[i], x[i + 1] = x[i + 1], x[i]
            typos.add("".join(x))
    want = {}
    for w in typos:
        low = w.lower()
        limit = 0.0 if len(low) < 5 else 1.0 if len(low) < 8 else 2.0
        if not low.isalpha() or len(low) > SP.LONGEST or not limit or set(SP.known_forms(low)) & set(WORDS):
            continue
        near = sorted((d, t) for t in WORDS if len(t) >= 3 and SP.alike_start(low, t) and not SP.other_form(low, t) and (d := SP.distance(low, t, limit)) <= limit)
        if near and (len(near) == 1 or near[1][0] - near[0][0] >= 0.5):
            want[w] = (near[0][1], near[0][0])
    got = SP.corrections(spark.createDataFrame([(w,) for w in typos] + [(None,)], "w string"), spark.createDataFrame([(w,) for w in WORDS], "t string"), "w", "t")
    assert {r["w"]: (r["correction"], r["distance"]) for r in got.collect()} == want and len(want) > 60


def test_distances_of_many_pairs_at_once():
    dice = random.Random(5)
    words = ["".join(dice.choice("ahscv") for _ in range(dice.randrange(1, 11))) for _ in range(150)]
    a, b = zip(*((x, y) for x in words for y in words), strict=True)
    for limit in (1.0, 2.0):
        assert SP.distances(list(a), list(b), limit).tolist() == [SP.distance(x, y, limit) for x, y in zip(a, b, strict=True)]


def test_only_words_with_alike_starts_and_lengths_meet(spark):
    """Words of the same syllables behind other first letters are no candidates: pairs don't grow with the square of these."""
    known = spark.createDataFrame([(f"{c}{v}renda{t}",) for c in "abdefghijlmnoprstuwx" for v in "aeiou" for t in ("", "rio", "rionado")], "__w string")
    pairs = SP.met(spark.createDataFrame([("marrenda",), ("horenda",)], "__w string"), known).distinct().collect()
    assert {r["__w"] for r in pairs} == {"marrenda", "horenda"}
    assert all(r["__t"][0] == "m" and len(r["__t"]) <= 10 for r in pairs if r["__w"] == "marrenda")
    assert all(r["__t"][0] in "ho" and len(r["__t"]) <= 8 for r in pairs if r["__w"] == "horenda")


def test_chat_questions(spark):
    cases = {
        "q  valor x servisio ,k pasa??": "que valor por servicio, que pasa?", "3 x 4 d 5 d": "3 x 4 d 5 d", "rayos x y x cama": "rayos x y por cama", "cuantas ciruuuugias hay pa' Lavandria": "cuantas cirugias hay para Lavandria",
        "LAVANDRIA  y lavandria": "LAVANDRIA y lavanderia", "egresos por cada servicio": "egresos por servicio", "por cada 100 camas": "por cada 100 camas", "": "", "vitamina D": "vitamina D", "XIII egrsos": "XIII egresos",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, text string")
    got = {r["id"]: r["text"] for r in SP.normalised(df, spark.createDataFrame([(w,) for w in WORDS], "t string"), "id", "text", "t").collect()}
    assert {k: got[i] for i, k in enumerate(cases)} == cases


def test_sounds(spark):
    df = spark.createDataFrame([("casa", "kasa"), ("cosa", "kosa"), ("cena", "sena"), ("zapato", "sapato"), ("queso", "keso"), ("hilo", "ilo"), ("casa", "sasa")], "a string, b string")
    got = [r["s"] for r in df.select((MT.phonetic(F.col("a")) == MT.phonetic(F.col("b"))).alias("s")).collect()]
    assert got == [True] * 6 + [False]


def test_values_in_texts_against_all_pairs(spark, monkeypatch):
    """Whole and partial matches over several blocks of values, values of the same words, texts without any; and texts don't
    meet values in a join, whose rows were texts times values of a frequent word."""
    monkeypatch.setattr(MT, "VALUES", 7)
    dice = random.Random(4)
    words = "a al casa del la los mar sol uno".split()
    texts = [(k, " ".join(dice.choice(words) for _ in range(dice.randrange(0, 7))).upper()) for k in range(60)] + [(90, None), (91, "nada")]
    values = sorted({" ".join(dice.choice(words[dice.randrange(0, 5) :]) for _ in range(dice.randrange(1, 5))) for _ in range(50)})
    for least in (0.7, 0.5):
        want = {}
        for q, text in texts:
            own = set((text or "").lower().split())
            scored = [(-len(own & set(v.split())) / len(set(v.split())), -len(set(v.split())), v) for v in values]
            best = min((s for s in scored if -s[0] >= least), default=None)
            if best:
                want[q] = (best[2], -best[0])
        df = MT.matched_values(spark.createDataFrame(texts, "q long, t string"), spark.createDataFrame([(v,) for v in [*values, None, "?"]], "v string"), "q", "t", "v", least)
        assert {r["q"]: (r["v"], r["score"]) for r in df.collect()} == want and 20 < len(want)
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert any(v < 1 for _, v in want.values())


def plain_likeness(a, b):
    return NM.likeness(a, b)


def test_names_meant(spark):
    """Scores against a comparison of every question with every name."""
    names = ["Total Cirugías", "Cirugías realizadas", "Egresos", "Total egresos hospitalarios", "Promedio de estancia", "Ocupación", "% Ocupación camas", "Consultas ambulatorias", "Consultas"]
    questions = ["cuántas cirugías realizadas hubo", "total de cirugias", "egresos hospitalario total", "promedio estancia", "ocupacional de camas", "consultas ambulatoria", "algo distinto", "", "egresos y consultas"]
    n = spark.createDataFrame([(x,) for x in names], "name string")
    q = spark.createDataFrame(list(enumerate(questions)), "id long, text string")
    norm = {x: r["k"] for x, r in zip(names, n.select(NM.normal("name").alias("k")).collect(), strict=True)}
    cut = lambda df, c: {r[0]: (r["k"], list(r["w"])) for r in df.select(c, NM.normal(c).alias("k"), NM.words(NM.normal(c)).alias("w")).collect()}
    nw, qw = cut(n, "name"), {r["id"]: (r["k"], list(r["w"])) for r in q.select("id", NM.normal("text").alias("k"), NM.words(NM.normal("text")).alias("w")).collect()}
    df = {}
    for _, w in nw.values():
        for t in w:
            df[t] = df.get(t, 0) + 1
    weight = {t: 0.25 + 0.75 * (1 - c / len(names)) for t, c in df.items()}
    want = set()
    for i, (qk, own) in qw.items():
        scores = {}
        for name, (k, ws) in nw.items():
            best = [max((NM.likeness(t, o) for o in own), default=0.0) for t in ws]
            rare = 0.1 * min(3.0, sum(weight[t] for t in ws))
            if qk and f" {k} " in f" {qk} ":
                s = min(1.2, 1 + 0.03 * min(len(k.split()), 6)) + rare
            elif len(ws) >= 2 and all(b == 1 for b in best):
                s = min(1.2, 1 + 0.02 * min(len(ws), 6)) + rare
            else:
                cover = sum(weight[t] for t, b in zip(ws, best, strict=True) if b >= 0.82) / sum(weight[t] for t in ws)
                s = min(0.99, 0.68 * cover + 0.24 * sum(best) / len(ws) + 0.08 * min(len(ws), len(own)) / max(len(ws), len(own), 1)) if cover >= 0.6 else 0.0
            if round(s, 6) >= NM.LEAST:
                scores[name] = round(s, 6)
        close = {m: s for m, s in scores.items() if max(scores.values()) - s < NM.MARGIN}
        want |= {(i, m, "resolved" if len(close) == 1 else "ambiguous") for m in close}
    got = NM.resolved(q, n, "id", "text", "name").collect()
    assert {(r["id"], r["name"], r["status"]) for r in got} == want and len(norm) == len(names)
    assert {r["id"] for r in got} >= {0, 1, 2, 5} and 6 not in {r["id"] for r in got}


def test_alike_against_all_pairs(spark):
    dice = random.Random(4)
    base = ["cuantas cirugias hubo en marzo", "total de egresos por servicio", "ocupacion de camas este mes", "valor facturado por eps"]
    texts = {b[: len(b) - dice.randrange(6)] + dice.choice(["", "?", " hoy", " ayer", "s"]) for b in base * 12} | {"", None, "a", "¿Total?", "total"}
    got = SM.alike(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 0.6).collect()
    norm = sorted({r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(SM.normal("t").alias("k")).collect() if r["k"]})
    want = {(a, b): round(c, 6) for i, a in enumerate(norm) for b in norm[i + 1 :] if (c := SM.cosine(SM.trigrams(a), SM.trigrams(b))) >= 0.6}
    assert {(r["a"], r["b"]): r["cosine"] for r in got} == want and len(want) > 20
    assert all(r["sequence"] == round(difflib.SequenceMatcher(None, r["a"], r["b"]).ratio(), 6) for r in got)
    same = SM.same_question(SM.alike(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 0.6)).collect()
    assert 0 < len(same) <= len(got)


def test_names_in_texts(spark, monkeypatch):
    names = ["Ventas", "ventas netas", "IVA", "Año_Mes", "net", "Clientes "]
    docs = [(1, "Las ventas netas del año-mes"), (2, "IVA"), (3, None), (4, ""), (5, "clientesventas"), (6, "x" * 100_000 + "Clientes")]
    key = lambda t: "".join(ch for ch in (t or "").lower().translate(str.maketrans("áéíóúüñ", "aeiouun")) if ch in "abcdefghijklmnopqrstuvwxyz0123456789")
    want = {(d, n) for d, t in docs for n in names if len(key(n)) >= 4 and key(n) in key(t)}
    d, n = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame([(x,) for x in [*names, None, "Ventas"]], "n string")
    assert {tuple(r) for r in RF.mentions(d, n, "d", "t", "n").collect()} == want
    monkeypatch.setattr(RF, "LETTERS", 8)
    assert {tuple(r) for r in RF.mentions(d, n, "d", "t", "n").collect()} == want
    assert RF.mentions(d, n.limit(0), "d", "t", "n").collect() == []
    c = {r["d"]: (r["tables"], r["n_tables"]) for r in RF.catalogue(d, n, "d", "t", "n").collect()}
    assert c[1] == (["Año_Mes", "Ventas", "ventas netas"], 3) and c[3] == ([], 0)


def test_names_are_counted_where_they_are_found(spark, monkeypatch):
    """The counts of all names, over several blocks and for names of one key; no row of a single name is shuffled."""
    names = ["Ventas", "ventas", "VEN tas", "ventas netas", "netas", "Clientes ", "äbcdez"]
    docs = spark.createDataFrame([(1, "Las ventas netas"), (2, "IVA"), (3, None), (4, ""), (5, "clientesventas"), (6, "clientes")], "d long, t string")
    n = spark.createDataFrame([(x,) for x in [*names, None, "Ventas"]], "n string")
    want = {tuple(r) for r in RF.mentions(docs, n, "d", "t", "n").groupBy("d").agg(F.count("*"), F.min("n"), F.max("n")).collect()}
    for letters in (RF.LETTERS, 30):
        monkeypatch.setattr(RF, "LETTERS", letters)
        got = RF.mention_counts(docs, n, "d", "t", "n")
        assert {tuple(r) for r in got.collect()} == want == {(1, 5, "VEN tas", "ventas netas"), (5, 4, "Clientes ", "ventas"), (6, 1, "Clientes ", "Clientes ")}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("MapInArrow") >= 1
    assert RF.mention_counts(docs, n.limit(0), "d", "t", "n").collect() == []


def test_documented_names(spark):
    documented = ["Total Ventas", "ventas netas 2024", "Margen", "iva", "Clientes"]
    technical = ["TOTAL_VENTAS", "VENTAS_NETAS", "VENTAS", "MARGEN_BRUTO", "MARGEN_NETO_X", "IVA_TOTAL"]
    got = RF.matched(spark.createDataFrame([(x,) for x in documented], "n string"), spark.createDataFrame([(x,) for x in technical], "t string"), "n", "t")
    assert {tuple(r) for r in got.collect()} == {("Total Ventas", "TOTAL_VENTAS", "exact"), ("ventas netas 2024", "VENTAS_NETAS", "partial"), ("Margen", "MARGEN_BRUTO", "partial")}


def test_readings(spark):
    cases = {"1.234,50": {"1.234,50", "123450", "1234.5"}, "12": {"12"}, "0,5": {"0,5", "5", "0.5"}, "1.000": {"1.000", "1000", "1"}, "007": {"007", "7"}, "1,000.25": {"1,000.25", "100025", "1000.25"}}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: set(r["r"]) for r in df.select("t", G.readings(F.col("t")).alias("r")).collect()} == cases


def test_grounding(spark):
    answers = [
        (1, "Hubo 1.234 egresos. Fueron 99 en marzo. Subieron mucho."), (2, "Las áreas son:\n- Cardiología\n- Astrología\n1. Urgencias"), (3, "Todo en orden."), (4, None), (5, "Son 7 casos."), (6, "Las áreas son:\n- Astrología"), (7, "Hubo 2024 casos. Bajaron en mayo."),
    ]
    sources = [(1, "En total 1234 egresos"), (1, "nada más"), (2, "cardiologia y urgencias"), (3, "x"), (6, "nada"), (7, "los casos bajaron")]
    a = spark.createDataFrame([(i, t, "¿y en 2024?" if i == 7 else None) for i, t in answers], "id long, a string, q string")
    got = {r["id"]: (r["grounded"], r["removed"]) for r in G.grounded(a, spark.createDataFrame(sources, "id long, s string"), "id", "a", "s", "q").collect()}
    assert got == {1: ("Hubo 1.234 egresos.", 2), 2: ("- Cardiología\n1. Urgencias", 1), 3: ("Todo en orden.", 0), 4: ("", 0), 5: ("", 1), 6: ("", 1), 7: ("Hubo 2024 casos. Bajaron en mayo.", 0)}
    out = G.extract(spark.createDataFrame([(1, "Los egresos suben. El clima es bueno. Egresos por servicio hay. Egresos.")], "id long, s string"), "id", "s", spark.createDataFrame([(1, "egresos por servicio")], "id long, q string"), "q")
    assert [tuple(r) for r in out.collect()] == [(1, "Los egresos suben. Egresos por servicio hay.")]


def test_calculated_columns(spark):
    tables = {"sale": spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, None, 7), (4, "z", 1)], "id int, shop string, n int"), "shop": spark.createDataFrame([("A", 3), ("b", 4)], "s string, rent int")}
    m = M.Model(tables, [M.Relationship("sale", "shop", "shop", "s")], {"sold": M.total("sale", "n")})
    x = lambda *a, **k: C.Calculated(*a, **k)
    full = C.with_columns(m, [x("sale", "part", ("double", "rent"), lambda d, r: d / r), x("sale", "double", ("n",), lambda n: n * 2), x("shop", "sum", ("sold", "rent"), lambda s, r: F.coalesce(s, F.lit(0)) - r, key="s"), x("sale", "of_shop", ("sum", "part"), lambda s, p: s + p)])
    assert sorted(tuple(r) for r in full.tables["shop"].select("s", "sum").collect()) == [("A", 12), ("b", -4)]
    assert {r["id"]: r["of_shop"] and round(r["of_shop"], 4) for r in full.tables["sale"].collect()} == {1: 18.6667, 2: 15.3333, 3: None, 4: None}
    with pytest.raises(C.CircularDependency, match="p -> q -> p"):
        C.with_columns(m, [x("sale", "p", ("q",), lambda q: q), x("sale", "q", ("p",), lambda p: p)])
    with pytest.raises(ValueError, match="not related"):
        C.with_columns(m, [x("shop", "p", ("n",), lambda n: n)])


def test_ranks_over_all_values(spark):
    values = [5.0, None, 5.0, 2.0, 9.0, 2.0, 2.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(5)
    got = {r["i"]: (r["rank"], r["d"]) for r in T.ranked(T.ranked(df, F.col("v")), F.col("v"), "d", dense=True, up=True).collect()}
    known = [v for v in values if v is not None]
    assert got == {i: (None, None) if v is None else (1 + sum(k > v for k in known), 1 + len({k for k in known if k < v})) for i, v in enumerate(values)}
    assert T.ranked(df.limit(0), F.col("v")).collect() == [] and {r["rank"] for r in T.ranked(df.where("v is null"), F.col("v")).collect()} == {None}
