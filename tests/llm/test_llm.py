import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from compare import duck, rows

from brindle.llm import graph, langid, licenses, linededup, mixing, packing, queries, simhash, substring, winnow

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, text_hash string, n_words long, h string, k long"


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(r.randint(0, 30)) for _ in range(n))


BODY = words(1, 120)
TEXTS = [
    None, "", " \n\t ", "one", "Two words", BODY, BODY, BODY.replace("alpha", "ALPHA"), BODY + " tail", words(2, 80) + " " + " ".join(BODY.split()[10:75]), words(3, 60) + "\n" + "the quick brown fox jumps over it\nthe quick brown fox jumps over itt\nshort\nshort",
    "the quick brown fox jumps over it\nunique line of some length here\n  the quick brown fox jumps over it ", "mail a.b@example.org now +49 (0) 30 1234567 ip 10.0.0.256 and 10.0.0.25 card 4111 1111 1111 1111", "Under the MIT license, and under  the-mit license; CC BY NC. Licensed under the Apache License, Version 2.0.", "éèê ünï 漢字 \U0001f600 text", words(4, 3000), "<|endoftext|> special",
]


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i, t, ("en", "fr", None)[i % 3], f"src{i % 4}" if i % 5 else None, len(t or ""), 0.5, "x", 1, "y", 2) for i, t in enumerate(TEXTS)]
    made.append(made[5])  # a repeated row
    return spark.createDataFrame(made, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "u long, v long")
    found = {r["node"]: r["root"] for r in graph.connected_components(edges).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[101] == 100 and 5 in found


def naive_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fps):
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_simhash(docs, empty):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: naive_simhash(t) for i, t in enumerate(TEXTS)}
    root = components(fps)
    assert found == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    assert simhash.near_duplicates(docs).count() == len(TEXTS) + 1 and simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values())) and kept.columns == docs.columns


@pytest.mark.parametrize("shard_rows", [100, 500, 10_000])
def test_vantage_shards_lose_no_pair(spark, shard_rows):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(300)]
    fps += [f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in fps[:150] for _ in range(4)]
    signed = sorted({int(np.uint64(f).astype(np.int64)) for f in fps})
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.links(table, len(signed), shard_rows=shard_rows, block_rows=60)
    found = {x["node"]: x["root"] for x in graph.connected_components(links).collect()}
    want = components({f: f & 0xFFFFFFFFFFFFFFFF for f in signed})
    assert {f: found.get(f, f) for f in signed} == want


def test_line_dedup(spark, docs, empty):
    table = docs.dropDuplicates(["doc_id"]).select("doc_id", "text")
    got = linededup.dedup_lines(table).selectExpr("doc_id", "n_lines", "n_removed", "sha2(text, 256) AS kept_sha256").toArrow()
    assert rows(got) == rows(duck(linededup.ORACLE_SQL, documents=table.toArrow()))
    assert linededup.dedup_lines(docs).count() == len(TEXTS) + 1 and linededup.dedup_lines(empty).columns == [c for c in SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")] + ["n_lines", "n_removed"]
    lines = ["a sentence of sixteen", "a sentence of sixteem", "a sentence of sixtee", "xa sentence of sixteen", "a sentenceof sixteen", "another text that is different", "a sentence of sixt"]
    random.Random(3).shuffle(lines)
    one = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    kept = {r.text for r in linededup.dedup_lines(one).where("n_removed = 0").collect()}

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a == b or a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    assert kept == {x for i, x in enumerate(lines) if not any(near(y, x) for y in lines[:i])}


def test_substring(docs, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(docs, with_text=False).collect()}
    first, split = {}, {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(TEXTS)}
    for i, w in split.items():
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    for i, w in split.items():
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert got[6][1] == 120 and got[9][1] == 65 and substring.dedup_substrings(empty).count() == 0


def test_winnowing(docs, empty):
    table = docs.dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in winnow.compare_edited(table, rows_a_part=4).collect()}
    order = sorted(got, reverse=True)
    for at, i in enumerate(order):
        text, after = TEXTS[i] or "", TEXTS[order[(at + 1) % len(order)]] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].edited_fingerprint == winnow.as_string(winnow.winnow(edited))
    assert got[5].fingerprint == got[6].fingerprint and got[6].near_next == 1.0 and winnow.compare_edited(empty).count() == 0
    h, p = winnow.winnow(BODY, 5, 4)  # brute force: the least hash of each window, the rightmost of equals
    where = [i for i, c in enumerate(BODY) if not c.isspace()]
    low = np.frombuffer("".join(BODY[i] for i in where).lower().encode("utf-32-le"), np.uint32)
    grams = (winnow.gram_hashes(low, 5) >> np.uint64(32)).tolist()
    chosen = sorted({max(range(s, s + 4), key=lambda j: (-grams[j], j)) for s in range(len(grams) - 3)})
    assert [where[j] for j in chosen] == p.tolist() and [grams[j] for j in chosen] == h.tolist()


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(s, label, len(p.split())) for label, p in phrases.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base) == (len(w), len(at))
        assert got[i].base_labels == ",".join(sorted({x[1] for x in at})) and set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
        assert (got[i].first_word, got[i].last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
    assert "apache-2" in got[13].labels and got[13].score >= 0.95 and licenses.scan(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    plain = Tokenizer.from_file(files["tokenizer"])
    got = packing.pack(docs, **files).toPandas()
    for i, t in enumerate(TEXTS):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == i].drop_duplicates(["start"]).sort_values("start")
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    for _, one in got.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one.offset.tolist() == [0, *np.cumsum(one.length)[:-1]] and one.length.sum() <= 2048
    assert packing.pack(empty, **files).count() == 0
    filled = sum(s * n * k for use, k in packing.plan({3: 50, 5: 40, 7: 33, 11: 9}, 16) for s, n in use.items())
    assert filled == 3 * 50 + 5 * 40 + 7 * 33 + 11 * 9


def test_mixing(spark, docs, empty):
    got = queries.op1_mixing_budget(spark, SF).toArrow()
    assert rows(got) == rows(duck(queries.ORACLE_SQL["op1_mixing_budget"], SF))
    table = docs.dropDuplicates(["doc_id"])
    n = table.selectExpr(f"sum(regexp_count(text, '{mixing.WORD}')) AS n".replace("\\", "\\\\")).first().n
    taken = mixing.selection(docs, queries.domain_of(), queries.WEIGHTS).toPandas().taken.sum()
    assert taken == n * 3 // 5 and mixing.selection(empty, queries.domain_of(), queries.WEIGHTS).count() == 0
    assert mixing.mix(docs, queries.domain_of(), queries.WEIGHTS).columns == docs.columns


def test_language_id(spark, docs, empty):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op2_langid_kneser_ney(spark, SF).join(truth, "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (found.lang_pred == found.lang).mean() >= 0.9 and found.score.between(0, 1).all()
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and langid.identify(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "source_mixing", "sequence_packing"]
    docs = queries.documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.simhash.cut(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and set(packed.doc_id) == {r.doc_id for r in docs.collect()}
