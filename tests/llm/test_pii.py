import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from test_llm import TEXTS, docs, empty, words  # noqa: F401

from brindle.llm import pii


def naive_spans(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, card, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 8 <= len(digits(s)) <= 15]
    return [(k, m.start(), m.end()) for k, p in enumerate((email, ip, card, phone)) for m in p.finditer(text) if good[k](m[0])]


def test_pii(docs, empty, spark):
    got = {r.doc_id: r for r in pii.sanitise(docs, with_text=False).collect()}
    for i, t in enumerate(TEXTS):
        base = pii.spans_string(naive_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(got[i].spans.split(",")) | {""}
    r = random.Random(9)
    for _ in range(300):
        t = "".join(r.choice("a.@-+ 1234567890()x_%é") for _ in range(60))
        assert sorted(pii.base_spans(t)) == sorted(naive_spans(t)), t
    told = [(i, f"{words(i, 6)} Zorblax writes boss@corp.example {words(i + 50, 6)}") for i in range(6)] + [(10 + i, words(i + 90, 40)) for i in range(60)]
    found = pii.sanitise(spark.createDataFrame(told, "doc_id long, text string"))
    assert "term:" in found.where("doc_id = 0").first().spans and "Zorblax" not in found.where("doc_id = 0").first().sanitised
    assert pii.sanitise(empty).count() == 0


def test_pii_of_entities_mentioned_once(spark):
    # Each address stands in one document; the pool of its mail domain has four, and only they hold the terms.
    told = [(i, f"{words(i, 9)} Qo unit R7x Vandelay writes worker{i}@corp.example {words(i + 50, 9)}") for i in range(4)]
    told += [(10 + i, f"{words(i + 200, 9)} someone{i}@mail{i}.example {words(i + 90, 9)}") for i in range(4)]
    told += [(20 + i, words(i + 300, 40) + " unit") for i in range(60)]
    found = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    for i in range(4):
        assert not set("Qo R7x Vandelay".split()) & set(found[i].sanitised.split()) and " unit " in found[i].sanitised
        assert "term:" not in found[10 + i].spans
    assert not any("term:" in found[20 + i].spans for i in range(60))


def naive_disclosure(texts, reach, support, least):
    """The documented measure with dictionaries: PMI over IC from the contexts that agree on a word, and what chance allows."""
    near, of_entity, held = defaultdict(lambda: defaultdict(int)), defaultdict(int), defaultdict(int)
    for text in texts:
        text = text or ""
        for w in {m[0].lower() for m in re.finditer(r"[^\W_]+", text)} | {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", text)}:
            held[w] += 1
        spans = naive_spans(text)
        outside = lambda form: [m for m in re.finditer(form, text) if not any(m.start() < b and m.end() > a for _, a, b in spans)]  # noqa: E731, B023
        seen = {}
        for k, a, b in spans:
            sides = []
            for form in (r"[^\W_]+", r"[^\W\d_]{3,}"):
                found = outside(form)
                before, after = [m for m in found if m.start() < a], [m for m in found if m.start() >= a]
                sides.append([m[0].lower() for m in before[-reach:] + after[:reach]])
            context = " ".join(sides[1] or sides[0])
            for entity in (f"{pii.KINDS[k]}:{text[a:b]}", *pii.pools(k, text[a:b])):
                seen.setdefault((entity, ""), context)
                for w in (*sides[0], *sides[1]):
                    seen.setdefault((entity, w), context)
        for (entity, w), context in seen.items():
            if w:
                near[entity, w][context] += 1
            else:
                of_entity[entity] += 1
    tested = {pair: sum(c.values()) for pair, c in near.items() if len(c) >= support}
    out = defaultdict(float)
    for (entity, w), both in tested.items():
        n, e, total = held[w], of_entity[entity], len(texts)
        pmi, ic, apart = math.log(both * total / (e * n)), math.log(total / e), n - both
        g2 = 2 * (both * pmi + (apart * math.log(apart / (n * (1 - e / total))) if apart else 0))
        if ic > 0 and g2 > pii.LEAST_G2 + 2 * math.log(len(tested)) and pmi / ic >= least:
            out[w] = max(out[w], pmi / ic)
    return dict(out)


@pytest.mark.parametrize("most_terms", [pii.MOST_TERMS, 0])
def test_disclosure_equals_the_dictionary_version(spark, most_terms):
    r = random.Random(4)
    texts = [words(i, r.randint(3, 60)) for i in range(150)] + [None, "", "a@b.example"]
    for i in range(40):  # terms that go with a domain, a network and a person, some of them elsewhere too
        texts.append(f"{words(i, 5)} Vandelay {r.choice(['Qo', 'unit'])} someone{i % 9}@corp.example {words(i + 7, 4)}")
        texts.append(f"{words(i, 5)} rack{i % 3} host 10.0.7.{i % 6} {words(i + 7, r.randint(0, 12))}")
        texts.append(f"{words(i, 6)} " + r.choice(["unit", "host", "call +49 30 1234567 Zorblax", "Zorblax"]))
    texts += texts[160:175]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = naive_disclosure(texts, 4, 2, 0.6)
    found = {x.word: x.disclosure for x in pii.disclosing_words(table, reach=4, least=0.6, most_terms=most_terms).collect()}
    assert want and set(found) == set(want) and all(found[w] == pytest.approx(want[w]) for w in want)
    for x in pii.sanitise(table, reach=4, least=0.6, most_terms=most_terms).collect():
        text = texts[x.doc_id] or ""
        base = naive_spans(text)
        told = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in want and not any(m.start() < b and m.end() > a for _, a, b in base)]
        assert set(x.spans.split(",")) - {""} >= {f"term:{a}:{b}" for a, b in told} | {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base}
        assert not any(w in pii.words_of(x.sanitised) for w in want)


def test_very_long_texts_repeats_and_clashing_columns(spark):
    long = ("word " * 200_000) + "a.b@corp.example " + "x" * 100_000
    rows = [(None, "mail a.b@corp.example", 1), (1, long, 2), (1, long, 2), (2, None, 3)]
    found = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, own int")).collect()
    assert sorted((x.doc_id or -1, x.n_email) for x in found) == [(-1, 1), (1, 1), (1, 1), (2, 0)]
