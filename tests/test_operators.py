import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.operators import answer, catalog, chunking, classify, enrich, evaluate, outline, rank, understand
from brindle.operators.chunking import Window, chunks_of, estimate, pack
from brindle.sources import extract

LAW = """LEY 822
LIBRO PRIMERO Disposiciones
TÍTULO I De las normas
CAPÍTULO I Objeto
Arto. 1 Objeto. La presente ley tiene por objeto regular el impuesto.
Artículo 2. Ámbito. Se aplica en todo el territorio.
CAPÍTULO II Sujetos
Arto. 3 Sujetos. Son sujetos los residentes.
el articulo 4 de otra ley no es un encabezado
TÍTULO II Otras
Arto. 4 Final. Deroga lo anterior."""


def test_normative_chunks_carry_their_path():
    found = chunks_of(LAW, "normative_hierarchical", Window())
    assert [c.kind for c in found] == ["preamble", "article", "article", "article", "article"]
    assert found[1].path == ["LIBRO PRIMERO", "TITULO I", "CAPITULO I", "Arto. 1"]
    assert found[3].path == ["LIBRO PRIMERO", "TITULO I", "CAPITULO II", "Arto. 3"] and "otra ley" in found[3].text
    assert found[4].path == ["LIBRO PRIMERO", "TITULO II", "Arto. 4"]
    assert sorted("\n".join(c.text for c in found).split()) == sorted(LAW.split())


def test_headings():
    assert outline.level_heading("## ARTÍCULO 12 bis. Texto") == ("article", "Arto. 12")
    assert outline.level_heading("articulo 4 de la ley") is None and outline.heading("articulo 4 de la ley") is None
    assert outline.heading("CAPÍTULO ÚNICO") == ("chapter", "CAPITULO UNICO") and outline.heading("3) Aprobar el acta") == ("item", "Item 3")
    assert outline.heading("DISPOSICIONES GENERALES") == ("document", "DISPOSICIONES GENERALES") and outline.heading("Texto corriente.") is None
    assert outline.kind_of("TITULO II") == "title" and outline.kind_of("XIV") == "roman" and outline.kind_of("Sección 3") == "section"
    assert outline.looks_like_table(["Rango  Monto", "DE 1 A 2  5", "DE 2 A 3  6"]) and not outline.looks_like_table(["una frase", "otra frase", "y otra 3"])
    trail = outline.Trail()
    assert trail.path([outline.heading("TITULO I"), outline.heading("CAPITULO II")]) == ["TITULO I", "CAPITULO II"]
    assert trail.path([outline.heading("Arto. 5")]) == ["TITULO I", "CAPITULO II", "Arto. 5"] and trail.path([outline.heading("TITULO II")]) == ["TITULO II"]


@given(st.lists(st.text("ab .\n", max_size=80), max_size=12), st.integers(5, 40))
@settings(max_examples=60, deadline=None)
def test_packing_keeps_words_in_order_and_the_budget(units, most):
    packed = pack(units, most)
    assert " ".join(" ".join(x for p in packed for x in p).split()) == " ".join(" ".join(units).split())
    for p in packed:
        n = sum(estimate(x) for x in p)
        assert n <= most + len(p) or len(p) == 1


def test_overlap_repeats_the_tail():
    units = [f"w{i} x y z." for i in range(20)]
    packed = pack(units, 30, 0.2)
    assert all(a[-1] == b[0] for a, b in zip(packed, packed[1:], strict=False))


def test_structural_and_technical():
    minutes = "ACTA 5\nPresentes todos los miembros del consejo.\nACUERDOS\n1) Aprobar el acta.\n2) Aprobar el presupuesto.\n4) no sigue la lista"
    assert any(c.path == ["ACUERDOS"] or "ACUERDOS" in c.path for c in chunks_of(minutes, "generic_structural", Window()))
    standard = "Portada\nSección 1 Alcance\nTexto de alcance.\nSección 2 Conceptos\nMás texto."
    assert [c.path for c in chunks_of(standard, "technical_structural", Window())] == [["Preliminares"], ["Sección 1 Alcance"], ["Sección 2 Conceptos"]]
    for empty in (None, "", " \n "):
        assert all(chunks_of(empty, s, Window()) == [] for s in chunking.BUILDERS)
    with pytest.raises(ValueError):
        Window(target=10)


def test_chunk_ids_are_stable(spark):
    docs = spark.createDataFrame([(1, LAW, "normative_hierarchical"), (2, None, "generic_freeform")], "id long, text string, s string")
    a, b = (chunking.chunk_documents(docs, "id", "text", "s").select("chunk_id").collect() for _ in range(2))
    assert a == b and len(a) == 5


def test_classification(spark):
    rows = [("ley.txt", LAW), ("acta.txt", "Acta de la sesión del consejo directivo"), ("niif.txt", "NIIF para pymes, IFRS, Sección 3 y la fundación IFRS"), ("x", "hola"), (None, None)]
    found = classify.classify(spark.createDataFrame(rows, "name string, text string"), "name", "text").collect()
    assert [r.document_class for r in found] == ["legal_normative", "general_document", "technical_standard", "general_document", "general_document"]
    assert found[1].confidence == 0.94 and found[1].chunking_strategy == "generic_structural"
    safe = spark.createDataFrame([("x", "legal_normative", "normative", "normative_hierarchical", 0.9)], "name string, document_class string, document_family string, chunking_strategy string, confidence double")
    mixed = classify.gateway(classify.classify(spark.createDataFrame([("x", "manual")], "name string, text string"), "name", "text"), safe, "name").first()
    assert mixed.document_class == "legal_normative" and mixed.confidence == 0.9


def test_question_structure(spark):
    rows = [(1, "¿Qué establece el artículo 23 y la Sección 4.2 de la Ley 822?"), (2, "Que diferencia hay entre la NIIF para las pymes y la NIC 39?"), (3, None)]
    found = {r.id: r for r in understand.structure(spark.createDataFrame(rows, "id long, q string"), "q").collect()}
    assert [(r.kind, r.value) for r in found[1].refs] == [("article", "23"), ("section", "4.2"), ("law", "822")]
    assert found[1].document_markers == ["ley 822"] and found[1].topic_terms == ["establece"]
    assert found[1].queries[0] == "ley 822 establece" and len(found[1].queries) == 8
    assert found[2].clauses == ["la niif para las pymes", "la nic 39"] and found[3].queries == []
    kind = lambda *a: spark.range(1).select(*understand.route(*[F.lit(x).cast(t) for x, t in zip(a, ("string", "string", "string", "double"), strict=True)])).first()
    assert kind("general_document", None, None, None)[0] == "general_document" and len(kind(None, "normative", None, None)[1]) == 2
    assert kind(None, None, "legal_normative", 0.5)[0] == "legal_normative" and kind(None, None, "legal_normative", 0.4)[0] == "all_domains"


def test_units_and_variants(spark):
    paths = [(1, ["LIBRO I", "TITULO II", "Arto. 23 Renta de trabajo"]), (2, ["Sección 4 Estados financieros"]), (3, [])]
    rows = enrich.index_documents(spark.createDataFrame(paths, "id long, path array<string>").withColumns({"t": F.lit("ley_822.pdf"), "x": F.lit("Un texto breve.")}), "t", "path", "x")
    found = {r.id: r for r in rows.collect()}
    assert (found[1].unit_type, found[1].unit_key, found[1].unit_topic) == ("article", "article:23", "Renta de trabajo")
    assert "Art. 23" in found[1].reference_variants and found[2].unit_key == "section:4" and found[3].unit_type == "document"
    assert found[1].sample_questions[0] == "Que establece Arto. 23 Renta de trabajo de ley 822?" and len(found[1].sample_questions) == 4


def test_reference_scores(spark):
    cols = "unit_key string, article_label string, section_label string, subsection_label string, canonical_label string, path_text string, retrieval_context string, raw_text string"
    hits = spark.createDataFrame([("article:23", "Arto. 23", "", "", "Arto. 23", "TITULO I > Arto. 23", "", ""), ("article:9", "Arto. 9", "", "", "Arto. 9", "TITULO I > Arto. 9", "", "")], cols)
    refs = understand.references(understand.normal(F.lit("arto. 23")))
    got = hits.select(rank.structural_score(refs).alias("s"), rank.mismatch_penalty(refs).alias("p"), rank.reference_bonus(refs, {"canonical_label": "canonical_label"}).alias("b")).collect()
    assert [(round(r.s, 2), r.p, r.b) for r in got] == [(1.45, 0.0, 25.0), (0.0, 0.6, 0.0)]


def test_visibility_and_clauses(spark):
    rows = [(1, "a", 1, 0.1, 0.9, "x", True, False), (1, "b", 2, 0.5, 0.8, "y", False, False), (1, "c", 3, 0.6, 0.7, "x", True, False), (1, "d", 4, 0.9, 0.2, "x", True, True)]
    hits = spark.createDataFrame(rows, "query_id long, k string, rank int, role double, score double, branch string, selected boolean, lead boolean")
    found = [r.k for r in rank.visibility(hits, "query_id").orderBy("position").collect()]
    assert found[0] == "d" and set(found[:3]) == {"d", "c", "a"} and found[3] == "b"
    two = spark.createDataFrame([(1, "p", 1, "costos historicos"), (1, "q", 2, "valor razonable activos")], "q long, k string, rank int, t string").withColumn("c", F.array(F.lit("valor razonable"), F.lit("costos historicos")))
    assert [r.k for r in rank.cover_clauses(two, "q", "k", "c", "t").orderBy("position").collect()] == ["q", "p"]


def test_fragments_and_answers(spark):
    text = "Introduccion breve de la norma aplicable al caso presente; El impuesto sobre la renta se paga cada mes por los residentes. Otra cosa."
    best = spark.range(1).select(answer.best_fragment(F.lit("cuando se paga el impuesto renta"), F.lit(text))).first()[0]
    assert "impuesto sobre la renta" in best
    rows = spark.createDataFrame([(1, 1, "uno", "r1", "summary"), (1, 2, "dos", "r2", "summary"), (2, 1, "solo", "r", "single_branch")], "q long, rank int, t string, b string, s string")
    said = {r.q: r.answer for r in answer.answers(rows, "q", "rank", "t", "b", "s").collect()}
    assert said[1] == "Resumen de evidencia por ramas:\n[1] r1: uno\n[2] r2: dos" and said[2] == "solo [1]"


def test_catalogue_commands(spark):
    versions = spark.createDataFrame([("v1", "d", "active", "s3/a", 1), ("v2", "d", "active", "s3/b", 2), ("v3", "e", "active", "s3/c", 3)], "version_id string, document_id string, version_status string, storage_uri string, created_at int")
    documents = catalog.latest_versions(versions)
    gone = spark.createDataFrame([("v2",), ("v3",)], "version_id string")
    left = catalog.delete_versions({"versions": versions, "documents": documents}, gone)
    assert [tuple(r) for r in left["documents"].collect()] == [("d", "v1")] and left["versions"].count() == 1
    old = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    assert catalog.upsert(old, spark.createDataFrame([(2, [5.0, 5.0])], old.schema), "id", 2).where("id = 2").first().vector == [5.0, 5.0]
    with pytest.raises(Exception, match="components"):
        catalog.upsert(old, spark.createDataFrame([(3, [5.0])], old.schema), "id", 2).collect()


def test_metrics_without_targets_or_hits(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    hits = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (3, 1, 1)], "case_id long, doc_id long, rank int")
    wanted = spark.createDataFrame([(1, 8), (1, 9), (2, 1)], "case_id long, doc_id long")
    found = {r.case_id: r for r in evaluate.case_metrics(cases, hits, wanted).collect()}
    assert (found[1].rr, found[1].hit_1, found[1].hit_3, found[1].all_3, found[1].precision) == (0.5, False, True, False, 0.5)
    assert found[2].rr == found[3].rr == 0 and not found[3].hit_5


def office(parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return held.getvalue()


def test_extraction(spark, tmp_path):
    w, m = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    docx = office({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Uno</w:t></w:r></w:p><w:p><w:r><w:t>texto</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    xlsx = office({"xl/workbook.xml": f'<workbook xmlns="{m}"><sheets><sheet name="Hoja"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{m}"><sheetData><row><c t="inlineStr"><is><t>x</t></is></c><c><v>3</v></c></row></sheetData></worksheet>'})
    files = {"a.docx": docx, "b.xlsx": xlsx, "c.html": "<h1>T</h1><p>uno dos<p>tres<ul><li><p>item</p></li></ul><table><tr><td>1</td><td>2</td></tr></table>".encode(), "d.txt": "señal".encode("cp1252"), "e.bin": b"x", "f.docx": b"broken"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    raw = extract.read_files(spark, str(tmp_path))
    found = {}
    for r in extract.extract(raw).join(raw.select("version_id", F.element_at(F.split("path", "/"), -1).alias("name")), "version_id").orderBy("name", "block_order").collect():
        found.setdefault(r["name"], []).append((r.block_type, r.section_path, r.text, r.review_reason))
    assert found["a.docx"] == [("heading", ["Uno"], "Uno", None), ("paragraph", ["Uno"], "texto", None), ("table", ["Uno"], "a\tb", None)]
    assert found["b.xlsx"] == [("table", ["Hoja"], "x\t3", None)] and found["d.txt"][0][2] == "señal"
    assert [x[2] for x in found["c.html"]] == ["T", "uno dos", "tres", "item", "1\t2"]
    assert found["e.bin"][0][3] == "unsupported_format" and found["f.docx"][0][3] == "extraction_failed"


def test_fixture_scan(spark, tmp_path):
    for text in ('{"cases": [{"case_id": "a", "question": "q"}]}', '[{"case_id": "a", "question": "q"}]'):
        (tmp_path / "cases.json").write_text(text)
        assert extract.read_cases(spark, str(tmp_path / "cases.json"), "case_id string, question string").first().question == "q"
