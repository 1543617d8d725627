import re

import pyarrow as pa
from pyspark.sql import functions as F
from test_operators import LAW

from brindle.functions.repair import repair
from brindle.functions.text import fold
from brindle.operators import answer, branches, chunking, classify, evaluate, hierarchy
from brindle.sources.store import Store, profiled

SCAN = """<!-- image -->
## LA GACETA
## SUMARIO
Decretos y acuerdos del día.
El Presidente. La siguiente: LeyN°822 de tributos
## TítuloI Objeto delaley
Artículo1Objeto. ConsejoDirectivo de Seguridad Socialy otros fines.Arto 2. Lapresente ley.



CapítuloII
Fin"""


def test_repair(spark):
    cases = {
        1: (SCAN, "Ley N. 822 de tributos\nTítulo I Objeto de la ley\nArtículo 1 Objeto. Consejo Directivo de Seguridad Social y otros fines.\nArto 2. la presente ley.\n\nCapítulo II\nFin"),
        2: ("", ""),
        3: ("  \n ", "  \n "),
        4: (None, None),
        5: ("Texto sin encabezados.\n\n\n\nOtro", "Texto sin encabezados.\n\nOtro"),
        6: ("DIARIO OFICIAL " + "x" * 300 + "\nLIBRO PRIMERO\nTexto", "LIBRO PRIMERO\nTexto"),
        7: ("Carta " + "x" * 300 + "\nLIBRO PRIMERO\nTexto", "Carta " + "x" * 300 + "\nLIBRO PRIMERO\nTexto"),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "k int, t string")
    found = dict(docs.select("k", repair(F.col("t"), F.lit(True))).collect())
    assert found == {k: w for k, (_, w) in cases.items()}


def test_fold_drops_the_marks_of_all_latin_letters(spark):
    texts = {"ĀŐȘ": "aos", "Ñandú Çà": "nandu ca", "é": "e", "Ệ": "e", "ß ø": "ß ø"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert dict(rows.select("t", fold("t")).collect()) == texts


def test_items_of_an_outline():
    assert chunking.items(["Intro", "1) a", "more", "2) b"]) == ["Intro", "1) a\nmore", "2) b"]
    assert chunking.items(["a) x", "b) y", "iv) z"]) == ["a) x", "b) y\niv) z"] and chunking.items(["uno", "dos"]) == ["uno", "dos"]
    assert chunking.items(["Del objeto:", "texto", "De los fines:", "otro"]) == ["Del objeto:\ntexto", "De los fines:\notro"]
    long = "Arto. 1 Lista.\n" + "\n".join(f"{i}) punto " + "palabra " * 30 + "\nsigue" for i in range(1, 12))
    parts = chunking.chunks_of(long, "normative_hierarchical", chunking.Window(50, 40, 120))
    assert all(c.text.split("\n")[0][0] in "A123456789" for c in parts)


def test_chunking_repairs_legal_texts(spark):
    docs = spark.createDataFrame([(1, LAW.replace("Artículo 2", "Artículo2"), "normative_hierarchical"), (2, "Artículo2 suelto", "generic_freeform")], "id int, t string, s string")
    found = chunking.chunk_documents(docs, "id", "t", "s").collect()
    assert "Arto. 2" in {x for r in found if r.id == 1 for x in r.path} and [r.chunk for r in found if r.id == 2] == ["Artículo2 suelto"]


def test_rows_of_tables_name_units(spark):
    lines = ["| Sección 3 | Presentación |", "| Sección 3 Presentación | presentación |", "| nada | Anexo IV |", "| 7.1 | Estado de flujos |", "| 7 | Fuentes |", "| :-- | --- |", "Sección 9", "| Anexo 1 |", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    said = lambda technical: dict(rows.select("i", hierarchy.unit_of_row(F.col("line"), F.lit(technical))["label"].alias("label")).where("label IS NOT NULL").collect())
    assert said(False) == {0: "Sección 3 Presentación", 1: "Sección 3 Presentación", 2: "Anexo IV"}
    assert said(True) == {**said(False), 3: "Sección 7.1 Estado de flujos"}


def test_inventory_of_empty_and_clashing_input(spark):
    schema = "doc string, path array<string>, o int, page int, kind string, text string, key string, i int, family string"
    rows = [("a", ["T I", " "], 1, 4, "text", "uno", "k", 1, "general"), ("a", ["t  í"], 0, 2, "text", None, "k", 1, "general"), ("a", None, 2, 1, "text", "x", "k", 1, "general"), ("a", ["T I"], 3, 9, "table", "| Anexo 1 | Datos |", "k", 1, "general"), (None, ["B"], 1, 1, "text", "y", "k", 1, "normative")]
    make = lambda some: hierarchy.inventory(spark.createDataFrame(some, schema), "doc", "path", "o", "page", "kind", "text", F.col("family"))
    found = {(r.document, tuple(r.unit_path)): r for r in make(rows).collect()}
    assert make([]).count() == 0 and set(found) == {("a", ("t  í",)), (None, ("B",))}
    assert found["a", ("t  í",)].page_end == 9 and found["a", ("t  í",)].snippets == ["uno"] and found["a", ("t  í",)].blocks == 3


def test_branch_searches_fuse(spark):
    lists = lambda rows: spark.createDataFrame(rows, "query_id int, variant int, key int, score double, rank int")
    near, sparse = lists([(1, v, k, 1.0 - k / 100, k) for v in (0, 1) for k in range(1, 21)]), lists([(1, 0, 20, 3.0, 1)])
    found = branches.fuse(near, sparse, spark.createDataFrame([(1, "multi_branch")], "query_id int, strategy string"), "query_id", "key").orderBy("rank").collect()
    assert len(found) == 14 and found[0].key == 20
    rows = spark.createDataFrame([("document", "", "x", ["a"]), ("article", "", "x", ["a"]), ("", "3", "x", []), (None, None, "Capítulo 1", None), ("unknown", None, None, ["a", "b"]), (None, None, None, None)], "t string, n string, l string, p array<string>")
    assert [r[0] for r in rows.select(branches.is_specific(F.col("t"), F.col("n"), F.col("l"), F.col("p"))).collect()] == [False, True, True, True, True, False]


def test_cases_traces_and_evidence(spark):
    cases = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "suite_id string, case_id int")
    ids = lambda *some: sorted(r.case_id for r in evaluate.filter_cases(cases, *some).collect())
    assert ids() == [1, 2, 3] and ids(["a"]) == [1, 2] and ids(["a"], [2, 3]) == [2] and ids(None, [3]) == [3]
    traces = spark.createDataFrame([(["x=1", "planner:strategy= focal", "planner:strategy=global"],), (["planner:strategy="],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in traces.select(evaluate.traced(F.col("t"), "planner:strategy")).collect()] == ["focal", None, None, None]
    hits = spark.createDataFrame([(1, 2, "impuesto", "El impuesto sobre la renta se paga cada año; " * 3, "Arto. 3", ["T", "A"], "article", None), (1, 5, "impuesto", None, " ", ["T", "A", "B"], None, None), (1, 9, "impuesto", "x", None, [], None, "table")], "q int, r int, question string, t string, l string, p array<string>, u string, k string")
    found = answer.evidence_rows(hits, "q", "r", "question", "t", "l", "p", "u", "k").orderBy("r").collect()
    assert [(r.label, r.branch_label, r.kind) for r in found] == [("[1]", "Arto. 3", "article"), ("[2]", "T > A", "chunk"), ("[3]", answer.UNNAMED, "table")] and "impuesto" in found[0].evidence


def test_tables_by_profile(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert profiled("index", " Model/V2.large ") == "index__model-v2-large" and profiled("index", "--") == "index__default"
    assert store.read_profiled("index", "m") is None
    store.write("index", spark.range(2))
    assert store.read_profiled("index", "m").count() == 2
    store.write(profiled("index", "m"), spark.range(5))
    assert store.read_profiled("index", "M").count() == 5


def test_repair_computes_each_step_once(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(repair(F.col("t")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(ley)") == 1


def test_markers_are_sought_only_where_their_literal_is(spark):
    every = (*classify.MEETING, *classify.MEETING_KIND, *classify.TECHNICAL, *classify.STRUCTURED_MARKERS)
    samples = ["acta", "sesion", "sesión", "reunion", "punto de agenda", "puntos  de agenda", "orden del dia", "lectura de acuerdo anteriores", "consejo directivo", "reunión ordinaria", "reunion extraordinaria", "niif", "ifrs", "nic", "norma de contabilidad", "modulo educativo", "estudio de caso", "pregunta de autoevaluación", "consejo de normas internacionales de contabilidad", "fundacion ifrs", "seccion 4", *"manual procedimiento objetivo alcance responsabilidades anexo agenda".split(), "estado de resultados", "estado de situacion financiera"]
    assert all(any(re.search(p, x) for x in samples) and all(classify.literal(p) in x for x in samples if re.search(p, x)) and len(classify.literal(p)) > 2 for p in every)


def test_chunks_of_a_bounded_number_of_texts(spark, monkeypatch):
    docs, taken = spark.createDataFrame([], "id long, text string, strategy string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a: taken.append(f) or self.selectExpr("id", "0 AS chunk_order", "text AS chunk"))
    chunking.chunk_documents(docs, "id", "text", "strategy")
    n = 1_000
    texts = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["Una casa."] * n), pa.array(["generic_freeform"] * n)], names=["id", "text", "strategy"])
    given = [b.num_rows for b in taken[0]([texts])]
    assert max(given) == chunking.ROWS and sum(given) == n
