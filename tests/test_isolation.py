"""Isolation beside a plain version that walks one text."""

import random
import re

from pyspark.sql import functions as F

from brindle.operators import isolation as iso

ACCENTS = str.maketrans("áéíóúñü", "aeiounu")


def low(x):
    return x.lower().translate(ACCENTS)


def plain(name, text):
    stem = low(re.sub(r"\.[^./]*$", "", name or ""))
    want = next(((k, m[1]) for k, p in iso.NAMES if (m := re.search(p, stem))), None)
    if text is None or want is None or len(text) < 1500 or not re.search(iso.SUMMARY, text) or len(re.findall("(?m)" + iso.HEADING, text)) < 4:
        return text
    word = "RESOLUCI[ÓO]N" if want[0] == "RESOLUCION" else want[0]
    m = re.search(rf"(?is)(?:\A|\n)\s*#{{0,6}}\s*{word}\s*N\s*[Oº°0]?\s*[.\-:]?\s*{want[1]}\b.*", text)
    if not m:
        return text
    tail = m[0].strip()
    marks, at = [], 0
    for line in tail.split("\n"):
        h, a = re.search(iso.HEADING, line), re.search(iso.ARTICLE.replace("(?iu)", "(?i)"), line)
        if h or a:
            marks.append((at, h and h[1], a and int(a[1])))
        at += len(line) + 1
    begins = lambda x, words: re.match(r"\s*(?:" + "|".join(words) + ")", low(x))
    opens = lambda h: h and not begins(h, iso.CONTINUATIONS)
    letters = lambda h: [c for c in h if c.isalpha()]
    loud = lambda h: opens(h) and 8 <= len(h) <= 120 and letters(h) and sum(c.isupper() for c in letters(h)) >= 0.7 * len(letters(h))
    heads = [(s, h) for s, h, _ in marks if h]
    found = []
    for s, h in heads if len(tail) >= 2000 else ():
        if s < 1500 or not opens(h):
            continue
        before, after = tail[max(0, s - 500) : s].strip(), tail[s : s + 1200].strip()
        prefaces = sum(bool(re.search(p, low(after))) for p in iso.PREFACES)
        last = max([a for x, _, a in marks if a is not None and x < s], default=0)
        following = next((a for x, _, a in marks if a is not None and s <= x < s + 1600), None)
        wall = before.count("|") >= 10 or after.count("|") >= 10
        score = 4.0 * bool(begins(h, iso.INSTRUMENTS)) + 1.5 * bool(loud(h)) + (3.5 if prefaces >= 2 else 1.0 * prefaces) + wall + 1.5 * bool(loud(h) and wall)
        if last >= 10 and following is not None and following <= 5:
            score += 4.0
        elif last >= 25 and following is not None and following < last / 2:
            score += 1.5
        after_it = [x for x, _ in heads if x > s]
        score += 1.5 * bool(after_it and after_it[0] - s <= 220)
        if score >= 3:
            found.append((s, bool(begins(h, iso.INSTRUMENTS)), score, False))
    hard = [s for s, is_hard, _, _ in found if is_hard]
    found += [(s, False, 5.0, True) for s, h in heads if loud(h) and any(0 < x - s <= 250 for x in hard)]
    kept = []
    for x in sorted(found):
        if kept and x[0] - kept[-1][0] < 250:
            kept[-1] = x if x[2] > kept[-1][2] else kept[-1]
        else:
            kept.append(x)
    short = sorted({*kept[:12], *sorted(kept, key=lambda x: (-x[2], x[0]))[:6], *[x for x in kept if x[3]]})
    first = next((x for x in short if x[2] >= 6), None)
    cut = None
    if first:
        earlier = [x for x in short if x[0] < first[0] <= x[0] + 250 and not x[1] and x[2] >= 4]
        first = earlier[-1] if first[1] and earlier else first
        cut = min([first[0], *[s for s, h in heads if loud(h) and first[0] - 250 <= s < first[0]]]) if first[1] else first[0]
    isolated = tail[:cut].strip() if cut is not None else ""
    return isolated if len(isolated) >= 200 else tail if len(tail) >= 200 else text


def gazette(r):
    law, out = r.randint(100, 999), ["# LA GACETA DIARIO OFICIAL", "# SUMARIO", "Ley y decretos del día."]
    numbers = [law, *[r.randint(1000, 1099) for _ in range(3)]]
    for i, n in enumerate(numbers):
        if r.random() < 0.4:
            out.append("# ASAMBLEA NACIONAL DE LA REPUBLICA")
        out.append(r.choice(["## LEY No. {}", "LEY N° {}", "# Ley N. {}"]).format(n) if i == 0 else r.choice(["## LEY No. {}", "## DECRETO No. {}", "# RESOLUCIÓN {}", "## AVISO COMERCIAL {}", "## CARTEL DE LICITACION {}"]).format(n))
        if r.random() < 0.7:
            out.append("El Presidente de la República\nCONSIDERANDO que es necesario\nPOR TANTO acuerda")
        for a in range(1, r.randint(3, 32)):
            out.append(f"Artículo {a}. " + "El texto del artículo sigue aquí con más palabras. " * r.randint(1, 3))
            if r.random() < 0.1:
                out.append(r.choice(["## CAPÍTULO II", "## DISPOSICIONES GENERALES", "| a | b | c |\n| 1 | 2 | 3 |\n| 1 | 2 | 3 |", "## Título preliminar"]))
    return f"gaceta ley {law}.md", "\n".join(out)


def test_isolation_equals_a_plain_walk(spark):
    r = random.Random(7)
    rows = [(i, *gazette(r)) for i in range(60)]
    law = rows[0][2]
    rows += [(100, "Ley 822.txt", None), (101, None, law), (102, "informe.md", law), (103, "ley 55555.md", law), (104, "ley 12.md", ""), (105, rows[0][1], "𝐀 preface\n" + law)]
    docs = spark.createDataFrame(rows, "id long, name string, text string").withColumn("start", F.lit("an extra column"))
    found = {x.id: x for x in iso.isolate(docs, "id", "name", "text").collect()}
    wanted = {i: plain(name, text) for i, name, text in rows}
    assert len(found) == len(rows) and {i: x.text for i, x in found.items()} == wanted
    assert {i for i, x in found.items() if x.isolated} == {i for i, _, t in rows if wanted[i] != t}
    cut = sum(not t.endswith(wanted[i][-50:]) for i, _, t in rows[:60])
    assert cut > 20  # many end at a boundary


def test_a_trusted_provider_chooses(spark):
    name, text = gazette(random.Random(3))
    docs = spark.createDataFrame([(1, name, text)], "id long, name string, text string")
    tails = docs.select("id", iso.tail(F.col("text"), iso.target(F.col("name"))).alias("__tail"))
    offered = iso.boundaries(tails, "id").orderBy("start").collect()
    last = offered[-1]
    given = lambda sure: spark.createDataFrame([(1, last.start, sure)], "id long, start long, confidence double")
    far, near = (iso.isolate(docs, "id", "name", "text", given(c)).first().text for c in (0.9, 0.5))
    assert near == plain(name, text) and far == tails.first()["__tail"][: last.cut if last.hard else last.start].strip()
