"""Word documents, metadata files, model folders, registries, intents and scopes on small cases."""

import zipfile

from pyspark.sql import functions as F

from lucerna.plans import intents as IN
from lucerna.sources import documents as D
from lucerna.sources.files import metadata

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def save(path, body, styles=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")


def p(text, style=None):
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_word_documents(spark, tmp_path):
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('')}</w:tr></w:tbl>"
    save(tmp_path / "one.docx", p("Intro  text") + p("Ventas", "T1") + p("") + p("Uno  <w:tab/>") + table + p("Detalle", "T2") + p("fin"), '<w:style w:styleId="T1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="T2"><w:name w:val="Heading 2"/></w:style>')
    (tmp_path / "sub").mkdir()
    save(tmp_path / "sub" / "two.docx", "")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("x")
    blocks = D.docx(spark, str(tmp_path)).cache()
    got = [(r["place"], r["kind"], r["style"], r["text"], r["cells"]) for r in blocks.orderBy("place").collect()]
    assert got == [(0, "paragraph", None, "Intro text", None), (1, "paragraph", "heading 1", "Ventas", None), (3, "paragraph", None, "Uno", None), (4, "table", None, None, [["a", "b"], ["1", ""]]), (5, "paragraph", "Heading 2", "Detalle", None), (6, "paragraph", None, "fin", None)]
    s = [(r["section"], r["heading"], r["level"], r["text"], r["tables"]) for r in D.sections(blocks).orderBy("section").collect()]
    assert s == [(0, None, None, "Intro text", []), (1, "Ventas", 1, "Uno", ["a | b\n1 | "]), (2, "Detalle", 2, "fin", [])]


def test_metadata_and_model_folders(spark, tmp_path):
    df = spark.createDataFrame([("a,b", "x"), ('say "hi"', "ñ")], "Name string, Kind string")
    for folder in ("r1/Mi Modelo", "r1/otro", "r2/mi-modelo", "r2/tercero"):
        D.write_metadata(df.coalesce(1), str(tmp_path / folder))
    assert sorted(tuple(r) for r in metadata(spark, str(tmp_path / "r1" / "otro")).collect()) == sorted(tuple(r) for r in df.collect())
    found = D.discovered(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")], "*.csv").collect()
    assert {r["model"]: r["path"].rsplit("/", 2)[-2] for r in found} == {"mi_modelo": "r1", "otro": "r1", "tercero": "r2"}


def test_conversations_as_documents(spark):
    df = spark.createDataFrame([(1, 2, "assistant", " Hola "), (1, 1, "user", "¿Qué?"), (2, None, None, None)], "c long, t long, r string, x string")
    got = {r["c"]: r["markdown"] for r in D.exported(df, "c", "t", "r", "x", {"user": "Usuario"}).collect()}
    assert got == {1: "## Usuario\n\n¿Qué?\n\n## assistant\n\nHola", 2: "## \n\n"}


def test_registry(spark):
    m = spark.createDataFrame([("A", "t", "Total", False), ("A", "t", "total", True), ("A", "t", "Secret", True), ("A", "t", "Shown", True)], "model string, table string, name string, hidden boolean")
    v = spark.createDataFrame([("A", "r", "p", "t", "shown", None), ("A", "r", "p", "t", "Col", "SUM"), ("A", "r", "q", "t", "col", "SUM")], "model string, report string, page string, table string, name string, aggregation string")
    old = D.registry(m, v).where("kind = 'measure'").withColumn("model", F.lit("B")).union(D.registry(m, v).limit(1))
    got = sorted((r["model"], r["metric"], r["kind"], r["shown"]) for r in D.registry(m, v, old).collect())
    assert got == [("A", "Col", "visual", True), ("A", "Shown", "measure", True), ("A", "Total", "measure", False), ("A", "col", "visual", True), ("B", "Shown", "measure", True), ("B", "Total", "measure", False)]


def test_intents(spark):
    cases = {
        "¿Qué muestra el tablero de lavandería?": "overview", "que filtros tiene el tablero de facturacion": "filters", "como se calcula el turno ok en lavanderia": "calculation", "que significan los colores del semaforo": "definition",
        "que consulta sql usa el tablero de lavanderia": "technical", "dame una receta de arepas": "general", None: "general",
    }
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    got = {r["q"]: (r["i"], round(r["p"], 4)) for r in df.withColumn("i", IN.intent("q")).withColumn("p", IN.prior(F.lit("sql_query"), "i")).collect()}
    assert got == {k: (v, 0.04 if v == "technical" else -0.2) for k, v in cases.items()}


def test_scopes(spark):
    names = [("TABLERO REFERENCIA", "report", "ref"), ("REFERENCIA", "page", "dem"), ("FACTURACIÓN PENDIENTE", "page", "fact"), ("Tiempos de Urgencias", "report", "urg"), ("URGENCIAS", "page", "brief"), ("Tablero", "report", "none")]
    asked = {1: "que informacion tiene el tablero de referencia", 2: "que filtros tiene el tablero de facturacion pendiente", 3: "boton azul en tiempos de urgencias", 4: "cual es la capital de francia", 5: None}
    got = {r["id"]: (r["kind"], r["groups"]) for r in IN.scopes(spark.createDataFrame(list(asked.items()), "id long, text string"), spark.createDataFrame(names, "name string, kind string, g string"), "id", "name", "kind", "g").collect()}
    assert got == {1: ("report", ["ref"]), 2: ("page", ["fact"]), 3: ("report", ["urg"])}
