import random
import re
import time

from brindle.llm import license_rules, licenses


def samples(parsed):
    """Texts that an expression matches: each branch, and each option with and without."""
    out = [""]
    for op, arg in parsed:
        if str(op) == "LITERAL":
            more = [chr(arg)]
        elif str(op) == "IN":
            more = [chr(x if str(kind) == "LITERAL" else x[0]) for kind, x in arg if str(kind) in ("LITERAL", "RANGE")] or ["x"]
        elif str(op) == "SUBPATTERN":
            more = samples(arg[3])
        elif str(op) == "BRANCH":
            more = [x for branch in arg[1] for x in samples(branch)]
        elif str(op) == "MAX_REPEAT":
            more = [""] * (arg[0] == 0) + samples(arg[2])
        else:
            more = ["x"]
        out = [a + b for a in out for b in more]
    return out


def test_license_gate(spark):
    made = []
    for rule in license_rules.rules():
        every = [t for t in samples(re._parser.parse(rule.expression.replace(license_rules.GRANT, "licensed under the "))) if re.fullmatch(rule.expression, t)]
        assert every and {t.split()[0] for t in every} <= set(rule.openings) and max(len(t.split()) for t in every) <= rule.span, rule
        made += [(rule.order, t) for t in every] + [(rule.order, every[-1].title().replace(" ", " \u2013\n"))]
    for verb in samples(re._parser.parse(license_rules.GRANT)):
        made.append((1, verb + "mit"))
    lost = licenses.with_rules(spark.createDataFrame(made, "rule int, text string")).where("NOT coalesce(exists(__rules, r -> r.order = rule), false)")
    assert lost.collect() == []
    said = {
        "gpl-3": "licensed under the GPLv3", "gpl-2": "released under GPLv2.", "lgpl-3": "Available under the LGPLv3", "agpl-3": "Licensed under AGPLv3", "mpl-2": "licensed under MPLv2", "eupl-1.2": "European Union Public Licence v. 1.2 Licence; licensed under the European Union Public Licence 1.2",
        "cddl": "Licensed under the Common Development and Distribution License", "sspl-1": "licensed under the Server Side Public License v1", "hpnd": "used under the Historical Permission Notice and Disclaimer", "etalab-2": "published under the Licence Ouverte", "cc0": "released under CC Zero", "gpl": "placed under, and shared under\u00a0GPL",
    }
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(said.values())], "doc_id long, text string")).collect()}
    assert [label for i, label in enumerate(said) if label not in got[i]] == []


def naive(text):
    """Every rule at every word, every detection against every other."""
    w = re.sub("[^0-9a-z]+", " ", text.lower()).strip().split(" ")
    found = []
    for i in range(len(w)):
        rest = " ".join(w[i:]) + " "
        for r in license_rules.rules():
            m = re.match(f"(?:{r.expression})(?= )", rest)
            if m and set(r.keywords) & set(w):
                found.append((i, i + len(m[0].split()), r.priority, r.order, r.label, r.confidence))

    def stronger(e, d):
        wide, narrow = e[1] - e[0], d[1] - d[0]
        return e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or (e[2] == d[2] and (wide > narrow or (wide == narrow and e[3] < d[3]))))

    return sorted(d for d in found if not any(stronger(e, d) for e in found))


def test_rules_suppression_and_score(spark):
    r = random.Random(11)
    said = ["licensed under the", "GNU Lesser General Public License", "GPLv3", "version 2.1", "MIT License", "SPDX-License-Identifier: Apache-2.0", "Creative Commons Attribution ShareAlike 4.0", "license", "or later", "the", "copyright 2020 Foo", "all rights reserved", "Mozilla Public License 2.0", "opensource.org/licenses/MIT", "in the public domain", "Redistribution and use in source and binary forms, with or without modification, are permitted", "provided that", "neither the name of"]
    texts = [" ".join(r.choice(said) for _ in range(r.randint(1, 14))) for _ in range(60)] + ["", "no word of it", "licence", None]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = naive(t) if t and spark.range(1).select(licenses.gate(licenses.F.lit(t))).first()[0] else []
        assert sorted(tuple(d) for d in got[i].detections) == want, t
        base = got[i].base_labels.split(",") if got[i].base_labels else []
        assert got[i].labels == ",".join(sorted({*base, *(d[4] for d in want)}))
        assert got[i].score == max([0.95 * bool(base), *(d[5] for d in want)])


def test_many_detections_take_time_in_proportion(spark):
    took = {}
    for n in (500, 4000, 32000):
        table = spark.createDataFrame([(n, "Licensed under the MIT license. " * n)], "doc_id long, text string")
        began = time.time()
        found = licenses.scan(table).collect()[0]
        took[n] = time.time() - began
        assert len(found.detections) == n and found.labels == "mit" and found.n_base == n
    assert took[32000] < 30


def test_order_of_text_and_repeated_or_extra_columns(spark):
    rows = spark.createDataFrame([(None, "MIT licence", 1), (7, None, 2), (7, "MIT licence", 3), (7, "MIT licence", 3)], "doc_id long, text string, __rules int")
    assert sorted((r.doc_id or -1, r.labels) for r in licenses.scan(rows).collect()) == [(-1, "mit"), (7, ""), (7, "mit"), (7, "mit")]
