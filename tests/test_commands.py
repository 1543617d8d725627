from pyspark.sql import functions as F
from test_operators import LAW

from brindle.operators import commands
from brindle.sources import extract
from brindle.sources.store import Store

MINUTES = "ACTA 5\nSesión ordinaria del consejo directivo con todos los miembros presentes.\nACUERDOS\n1) Aprobar el acta anterior.\n2) Aprobar el presupuesto anual de la cooperativa."


def table(df):
    return sorted(map(str, df.select(*[c for c in df.columns if c != "vector"]).collect()))


def test_from_files_to_answers(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    files = {"ley.txt": LAW, "acta.md": MINUTES, "corto.txt": "nada", "pagina.html": "<h1>Guía</h1><p>El manual describe el procedimiento de compras y su alcance general en la empresa.</p>"}
    for name, text in files.items():
        (inbox / name).write_text(text)
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("versions") is None
    read = lambda: extract.read_files(spark, str(inbox))
    versions = {r["name"]: r for r in commands.ingest(store, read()).collect()}
    assert versions["ley.txt"].document_class == "legal_normative" and versions["acta.md"].confidence == 0.94
    assert versions["corto.txt"].review_required and versions["corto.txt"].review_reason == "low_text_yield" and not versions["pagina.html"].review_required
    once = {n: table(store.read(n)) for n in ("blocks", "versions", "documents")}
    commands.ingest(store, read())  # again: nothing changes
    assert {n: table(store.read(n)) for n in once} == once and store.generations("versions")[-1] == 2

    chunks = commands.chunk(store)
    total, of_law = chunks.count(), chunks.where(F.col("version_id") == versions["ley.txt"].version_id).count()
    assert chunks.select("version_id").distinct().count() == 3 and {r.index_status for r in chunks.collect()} == {"pending"}
    assert table(commands.chunk(store)) == table(chunks)
    done = commands.reindex(store).collect()
    assert len(done) == 3 and {r.status for r in done} == {"indexed"} and store.count("chunks", "index_status = 'indexed'") == store.count("index") == total
    assert commands.reindex(store).collect() == [] and len(commands.reindex(store, force=True).collect()) == 3

    asked = spark.createDataFrame([(1, "¿Quiénes son los sujetos residentes según el artículo 3?"), (2, "presupuesto anual de la cooperativa"), (3, "zzz qqq")], "query_id long, question string")
    first = {r.query_id: r for r in commands.find(store.read("index"), asked).where("final_rank = 1").collect()}
    assert first[1].canonical_label == "Arto. 3" and "presupuesto" in first[2].chunk
    said = {r.query_id: r for r in commands.answer_questions(store.read("index"), asked).collect()}
    assert "residentes" in said[1].answer and said[1].citations[0].startswith("[1] ley.txt: ") and 0.35 < said[1].confidence <= 0.95
    assert set(said) == {1, 2, 3}

    branches = commands.reindex_branches(store)
    keys = {k for r in store.read("index").collect() for k in r.branch_keys}
    assert {r.chunk_id for r in branches.collect()} == keys and all(r.parent_branch_key in keys for r in branches.collect() if len(r.path) > 1)
    guided = commands.find(store.read("index"), asked, branch_table=branches)
    rows = guided.where("query_id = 1").orderBy("final_rank").collect()
    assert rows[0].canonical_label == "Arto. 3" and len({r.chunk_id for r in rows}) == len(rows) and keys & {r.chunk_id for r in rows}

    commands.delete(store, store.read("versions").where(F.col("name") == "ley.txt").select("version_id"))
    assert store.count("index", "title = 'ley.txt'") == 0 and store.count("documents") == 3 and store.count("chunks") == total - of_law


def test_a_dead_write_leaves_the_last_generation(spark, tmp_path):
    store = Store(spark, str(tmp_path), keep=2)
    store.write("t", spark.range(3))
    spark.range(9).write.parquet(f"{tmp_path}/t/2")  # written, never marked
    assert store.read("t").count() == 3 and store.write("t", spark.range(5)).count() == 5
    assert store.merge("t", spark.createDataFrame([(4,), (7,)], "id long"), "id").count() == 6 and len(store.generations("t")) == 2
