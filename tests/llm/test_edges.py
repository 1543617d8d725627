"""Defined results at the edges: clashing names, missing ids, repeated rows, very long texts, empty tables; stages against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from compare import duck, rows
from test_llm import BODY, SF, TEXTS, components, naive_simhash, words

import corpus_pipeline
from brindle.llm import common, langid, linededup, mixing, packing, pii, queries, simhash, substring, winnow

NAMES = ["__id", "__k", "__n", "__taken", "__brindle_n", "__score", "__rejected", "__lang_pred", "id", "k", "n", "taken", "mask", "lines", "stay", "lang_pred", "rejected", "entropy", "start", "w", "leaf", "part", "wanted", "root", "fp", "TEXT_hash", "row.x"]
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Missing and repeated ids, repeated rows, a text of a megabyte, and columns with the names that operators use themselves."""
    texts = [*TEXTS, BODY, "x" * 50_000 + " " + "lorem ipsum dolor " * 55_000 + "\nlast line of it", None, words(9, 40)]
    ids = [*range(len(TEXTS)), 3, 17, None, None]
    made = [(i, t, ("en", "fr", None)[j % 3], f"src{j % 4}" if j % 5 else None, len(t or ""), *[f"{n}{j}" for n in NAMES]) for j, (i, t) in enumerate(zip(ids, texts, strict=True))]
    made.append(made[5])
    return spark.createDataFrame(made, PLAIN + "".join(f", `{n}` string" for n in NAMES)).repartition(3).cache()


def test_stages_keep_columns_whatever_their_names(spark, odd):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = {r["__id"]: r for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, odd, SF)
        assert done.columns == odd.columns, name
        for r in done.collect():
            assert all(r[n] == own[r["__id"]][n] for n in [*NAMES, "source"]), name
        assert stage(spark, odd.limit(0), SF).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), SF).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_operators_take_every_row(spark, odd):
    n = odd.count()
    assert simhash.near_duplicates(odd).count() == n and substring.dedup_substrings(odd).count() == n and linededup.dedup_lines(odd).count() == n
    assert winnow.compare_edited(odd).count() == n and pii.sanitise(odd).count() == n and langid.identify(odd).count() == n
    assert packing.pack(odd, **queries.tokenizer_files()).where("start = 0").count() == n
    assert mixing.selection(odd, queries.domain_of(), queries.WEIGHTS, share=(2, 1)).where("epoch = 0").count() == sum(bool((r.text or "").split()) for r in odd.dropDuplicates(["doc_id", "text"]).collect())


def test_near_dedup_keeps_one_row_of_each_group(spark, odd):
    held = odd.collect()
    fps = {j: naive_simhash(r.text) for j, r in enumerate(held)}
    groups = defaultdict(list)
    for j, root in components(fps).items():
        groups[root].append(held[j])
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_first(odd).collect())
    assert sum(kept.values()) == len(groups) == len(kept)
    for members in groups.values():
        mine = [r for r in members if (r.doc_id, r.text) in kept]
        assert len({(r.doc_id, r.text) for r in mine}) == 1
        first = min((r.doc_id is None, r.doc_id or 0) for r in members)
        assert (mine[0].doc_id is None, mine[0].doc_id or 0) == first


def test_stages_equal_plain_versions(spark):
    docs = queries.documents(spark, SF)
    stages = dict(corpus_pipeline.STAGES)
    known = {r.doc_id: r for r in langid.identify(docs).collect()}
    one = common.cut(stages["language_id"](spark, docs, SF))
    assert {(r.doc_id, r.lang) for r in one.collect()} == {(i, r.lang_pred) for i, r in known.items() if not r.rejected}
    two = common.cut(stages["line_dedup"](spark, one, SF))
    want = {r["doc_id"]: r for r in duck(linededup.ORACLE_SQL, documents=one.toArrow()).to_pylist()}
    whole = {r.doc_id: r.text for r in one.collect()}
    got = {r.doc_id: r.text for r in two.collect()}
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[i]["kept_sha256"] for i, t in got.items())
    assert all(i in got or want[i]["n_removed"] for i in whole)
    three = common.cut(stages["near_dedup"](spark, two, SF))
    root = components({i: naive_simhash(t) for i, t in got.items()})
    assert {r.doc_id for r in three.collect()} == set(root.values())
    four = common.cut(stages["source_mixing"](spark, three, SF))
    chosen = duck(mixing.oracle_sql(queries.DOMAIN_SQL, queries.WEIGHTS), documents=three.toArrow()).to_pylist()
    whole = {r.doc_id: r.text for r in three.collect()}
    cut = lambda i, n, most: whole[i] if n == most else " ".join(re.findall(r"[^\x20\x09-\x0D]+", whole[i])[:n])
    assert Counter((r.doc_id, r.text, r.n_chars) for r in four.collect()) == Counter((c["doc_id"], (t := cut(c["doc_id"], c["taken"], c["n_tokens"])), len(t)) for c in chosen)
    packed = stages["sequence_packing"](spark, four, SF).toPandas()
    filled = packed.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and filled.sum() / (2048 * len(filled)) >= 0.9
    assert sorted(packed[packed.start == 0].doc_id) == sorted(r.doc_id for r in four.collect())


def naive_model(texts, table):
    """Interpolated Kneser-Ney with dictionaries."""
    grams = Counter()
    for t in texts:
        s = [0] * (langid.ORDER - 1) + langid.symbols(t, table).tolist()
        grams.update(tuple(s[i : i + langid.ORDER]) for i in range(len(s) - langid.ORDER + 1))
    levels = {langid.ORDER: grams}
    for n in range(langid.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    size = int(table.max()) + 1
    totals, kinds, discount = defaultdict(int), defaultdict(int), {}
    for n, c in levels.items():
        ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        discount[n] = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
        for g, x in c.items():
            totals[g[:-1], n] += x
            kinds[g[:-1], n] += 1

    def p(g):
        n = len(g)
        if not n:
            return 1 / size
        at = (g[:-1], n)
        if not totals[at]:
            return p(g[1:])
        return max(levels[n][g] - discount[n], 0) / totals[at] + discount[n] * kinds[at] / totals[at] * p(g[1:])

    def entropy(text):
        s = langid.symbols(text, table).tolist()
        full = [0] * (langid.ORDER - 1) + s
        return -sum(math.log(p(tuple(full[i : i + langid.ORDER]))) for i in range(len(s))) / len(s)

    return entropy


@pytest.mark.parametrize("shard", [1, 8])
def test_language_models_equal_dictionaries(shard):
    texts = ["the cat sat on the mat and the dog", "le chat est sur la table et le chien", "\U00010400\U00010401 the \U00010428 Größe", "der hund ist auf dem tisch"]
    langs = ["en", "fr", "en", "de"]
    model = langid.fit(texts, langs, shard)
    assert model["table"][0x10400] == model["table"][0x10428] >= 2
    asked = ["a dog and the cat", "les chiens", "\U00010401xyz", "unbekannt", "e"]
    got = langid.entropies(model, [langid.symbols(t, model["table"]) for t in asked])
    for j, name in enumerate(model["names"]):
        entropy = naive_model([t for t, x in zip(texts, langs, strict=True) if x == name], model["table"])
        assert got[:, j] == pytest.approx([entropy(t) for t in asked], rel=1e-4)


def test_likeness_of_fingerprints(spark):
    texts = [BODY, BODY + " more of it", words(5, 90), "", None, "short"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    parse = lambda s: {x.split(":")[0] for x in s.split(",") if x}
    same = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r.doc_id: r for r in winnow.compare_edited(table).collect()}
    for i, r in got.items():
        own, after = parse(r.fingerprint), parse(got[(i - 1) % len(texts)].fingerprint)
        assert r.near_edited == pytest.approx(same(own, parse(r.edited_fingerprint))) and r.near_next == pytest.approx(same(own, after))
    shared = words(8, 12)[: winnow.GRAM + winnow.WINDOW - 1 + 20]
    a, b = winnow.winnow("abc " + shared + words(6, 50)), winnow.winnow(words(7, 30) + shared + "xyz")
    assert set(a[0].tolist()) & set(b[0].tolist())


@pytest.mark.parametrize("most_bits", [substring.MOST_BITS, 0])
def test_sketch_by_broadcast_and_by_joins(spark, most_bits):
    table = queries.documents(spark, SF)
    got = substring.dedup_substrings(table, with_text=False, most_bits=most_bits).toArrow()
    assert rows(got) == rows(duck(queries.ORACLE_SQL["op6_substring_countmin"], SF))


def test_short_lines_are_compared_within_the_bound(spark):
    lines = ["a", "b", "ab", "", "abc", "xyz", "xyzw", "\tb ", "yz", "é", "漢字", "漢"]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = linededup.dedup_lines(table).selectExpr("doc_id", "n_lines", "n_removed", "sha2(text, 256) AS kept_sha256").toArrow()
    assert rows(got) == rows(duck(linededup.ORACLE_SQL, documents=table.toArrow()))


def test_written_tables_go(spark):
    table = queries.documents(spark, SF)
    held = len(common._written)
    done = common.settle(lambda: simhash.keep_first(table))
    assert len(common._written) == held + 1 and done.count()
    common.discard(done)
    assert len(common._written) == held


def test_hot_leaf_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 8)
    made = [(i, words(i, 1 + i % 9), "en", "src1" if i % 3 else f"src{i}", 1) for i in range(300)]
    table = spark.createDataFrame(made, PLAIN)
    for most in (mixing.ONE_TASK, 0):
        monkeypatch.setattr(mixing, "ONE_TASK", most)
        got = mixing.selection(table, queries.domain_of(), queries.WEIGHTS).withColumn("epoch", mixing.F.col("epoch").cast("long")).drop("k").toArrow()
        assert rows(got) == rows(duck(mixing.oracle_sql(queries.DOMAIN_SQL, queries.WEIGHTS), documents=table.toArrow()))
