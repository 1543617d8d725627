"""From texts to token-bounded chunks: page furniture, segments, units, packing with overlap, the strategies.

What needs no order is DataFrame code. The ordered folds over one document's lines are Python functions, run in
Arrow batches; a document is one row, so nothing is shuffled for them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.repair import repair
from brindle.functions.text import lines as line_array
from brindle.operators import outline
from brindle.shipping import by_value

by_value(__name__)

TARGET, LEAST, MOST, OVERLAP = 600, 400, 800, 0.2
#: Texts whose chunks a worker holds at once.
ROWS = 256
_TOKEN = re.compile(r"\w+|[^\w\s]")
# Fixed value: what a line with nothing but a page number looks like.
PAGE_NUMBER_SQL = r"(?i)^(P[ÁA]GINA\s+[0-9]+\s+DE\s+[0-9]+|[0-9]+)$"

# What opens an item of an outline, in order of preference.
ITEMS = tuple(re.compile(p) for p in (r"\d+\)", r"[A-Za-zÁÉÍÓÚÑáéíóúñ]\)", r"(?i:[ivxlcdm]+)\)", r"[A-ZÁÉÍÓÚÑ][^:]{1,80}:\s*$"))


@dataclass
class Window:
    target: int = TARGET
    least: int = LEAST
    most: int = MOST
    overlap: float = OVERLAP

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.target <= self.most or not 0 <= self.overlap < 1:
            raise ValueError("0 < least <= target <= most and 0 <= overlap < 1 must hold")


@dataclass
class Block:
    text: str
    path: list[str] = field(default_factory=list)
    kind: str = "section"


def boilerplate(pages: DataFrame, group: str, text: str, share: float = 0.4, least: int = 3, edge: int = 3) -> DataFrame:
    """``(group, line, n)``: normalised lines among the first or last ``edge`` of at least ``share`` of a group's texts, and ``least``; page numbers aside.

    A line that is among both counts twice. Groups of fewer than ``least`` texts have none.
    """
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    rows = pages.select(group, line_array(F.coalesce(text, F.lit(""))).alias("l"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    ends = rows.select(group, F.explode(F.concat(F.slice("l", 1, edge), F.slice("l", F.greatest(F.lit(1), F.size("l") - edge + 1), edge))).alias("line")).select(group, norm("line").alias("line"))
    counted = ends.where(~F.col("line").rlike(PAGE_NUMBER_SQL)).groupBy(group, "line").agg(F.count("*").alias("n"))
    return counted.join(sizes, group).where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))).select(group, "line", "n")


def clean(pages: DataFrame, group: str, text: str, furniture: DataFrame) -> DataFrame:
    """``pages`` with the text's blank lines, page numbers and boilerplate lines gone."""
    sets = furniture.groupBy(group).agg(F.collect_set("line").alias("__gone"))  # a group's edge lines: few
    norm = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    stays = lambda x: ~norm(x).rlike(PAGE_NUMBER_SQL) & ~F.array_contains("__gone", norm(x))
    rows = pages.join(sets, group, "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<string>")))
    return rows.withColumn(text, F.array_join(F.filter(line_array(F.coalesce(text, F.lit(""))), stays), "\n")).select(pages.columns)


def estimate(text: str) -> int:
    return max(1, math.ceil(len(_TOKEN.findall(text)) * 1.1))


def explode(unit: str, most: int) -> list[str]:
    """A unit in parts of at most ``most`` tokens: by paragraphs, else lines, else sentences, else words."""
    unit = unit.strip()
    if not unit or estimate(unit) <= most:
        return [unit] if unit else []
    for pattern, glue in ((r"\n\s*\n", "\n\n"), (r"[\r\n\x0b\x0c\x1c-\x1e\x85  ]+", "\n"), (r"(?<=[.!?])\s+", " ")):
        parts = [p.strip() for p in re.split(pattern, unit) if p.strip()]
        if len(parts) > 1:
            return [glue.join(x) for x in pack(parts, most)]
    out: list[list[str]] = [[]]
    n = 0
    for word in unit.split():
        count = len(_TOKEN.findall(word))
        if out[-1] and math.ceil((n + count) * 1.1) > most:
            out.append([])
            n = 0
        out[-1].append(word)
        n += count
    return [" ".join(x) for x in out if x]


def pack(units: list[str], most: int, overlap: float = 0.0) -> list[list[str]]:
    """Units in order, packed greedily up to ``most`` tokens; a new pack starts with the tail of the one before, about ``overlap`` of the budget."""
    done: list[list[str]] = []
    held: list[tuple[str, int]] = []  # a unit and its number of words and marks
    raw = lambda x: len(_TOKEN.findall(x))
    cost = lambda n: max(1, math.ceil(n * 1.1))
    total = 0
    for unit in units:
        for part in explode(unit, most):
            n = raw(part)
            if held and cost(total) + cost(n) > most:
                done.append([x for x, _ in held])
                tail: list[tuple[str, int]] = []
                if overlap > 0:
                    running = 0
                    for x in reversed(held):
                        tail.insert(0, x)
                        running += cost(x[1])
                        if running >= math.ceil(most * overlap):
                            break
                    while tail and cost(sum(c for _, c in tail) + n) > most:
                        tail.pop(0)
                held, total = tail, sum(c for _, c in tail)
            held.append((part, n))
            total += n
    if held:
        done.append([x for x, _ in held])
    return done


def segments(text: str, opens=outline.is_boundary) -> list[list[str]]:
    """Non-blank lines, cut before every heading."""
    out: list[list[str]] = []
    for line in (x.strip() for x in text.splitlines()):
        if line:
            if out and not opens(line):
                out[-1].append(line)
            else:
                out.append([line])
    return out


def items(lines: list[str]) -> list[str]:
    """Lines in groups, cut before each item of the first kind that opens two or more of them; as they are if none does."""
    for kind in ITEMS:
        if sum(bool(kind.match(x)) for x in lines) > 1:
            return ["\n".join(x) for x in segments("\n".join(lines), kind.match)]
    return lines


def normative(text: str, w: Window) -> Iterator[Block]:
    """A preamble up to the first article, then a chunk for each article, tables apart; long articles are packed with overlap."""
    trail, held, path, met = outline.Trail(), [], [], False
    pending: list[str] = []  # headings above an article wait for it

    def flush():
        nonlocal held
        if held:
            parts = [held] if estimate("\n".join(held)) <= w.most or not met else None
            for part in parts or pack(items(held), w.most, w.overlap):
                yield Block("\n".join(part), path, "article" if met else "preamble")
        held = []

    for seg in segments(text):
        opened = [x for x in map(outline.heading, seg[:4]) if x][:2]
        found = outline.level_heading(seg[0])
        if outline.looks_like_table(seg):
            yield from flush()
            yield from table(seg, trail.path(opened) if opened else path, w)
            continue
        if found and found.kind == "article":
            yield from flush()
            met, path = True, trail.path([found])
            held, pending = [*pending, *seg], []
        elif found:
            here = trail.path(opened or [found])
            if met:
                yield from flush()
                pending += seg
            else:  # still the preamble
                path = here
                held += seg
        elif pending:
            pending += seg
        else:
            held += seg
            path = path or trail.path(opened)
    held += pending
    yield from flush()


def table(rows: list[str], path: list[str], w: Window) -> Iterator[Block]:
    """A table's parts, each under its first line."""
    for i, part in enumerate(pack(rows[1:], max(1, w.most - estimate(rows[0]))) if estimate("\n".join(rows)) > w.most else [rows[1:]]):
        yield Block("\n".join([rows[0], *part]), path, "table" if not i else "table_part")


def structural(text: str, w: Window) -> Iterator[Block]:
    """Chunks that end where a heading opens another branch, or at the budget."""
    held: list[str] = []
    path: list[str] = []
    number = 0
    for line in (x.strip() for x in text.splitlines()):
        if not line:
            continue
        heading = outline.generic_heading(line)
        item = re.match(r"([0-9]+)\)\s", line)
        if item and int(item[1]) == number + 1:  # a list of decisions counts on without a gap
            number += 1
            new = [*path[:2], f"Item {number}"] if path else [f"Item {number}"]
        elif heading:
            number = 0
            if path and path[-1] == heading:
                continue  # a repeated heading
            new = [heading] if outline.kind_of(heading) == "section" or not path else [path[0], heading]
        else:
            held.append(line)
            continue
        if held and (estimate("\n".join(held)) >= max(40, w.least // 10) or (len(path) > 1 and path[:-1] == new[:-1])):
            yield from (Block("\n".join(p), path, "section") for p in pack(held, w.most, w.overlap))
            held = []
        path = new
        held.append(line)
    if held:
        yield from (Block("\n".join(p), path, "section") for p in pack(held, w.most, w.overlap))


def technical(text: str, w: Window) -> Iterator[Block]:
    """Runs of equal section; what comes before the first numbered section is one editorial run; a lone heading joins what follows."""
    runs: list[tuple[list[str], str, list[str]]] = []  # path, kind, lines
    front = ["Preliminares"]
    path = front
    opens = lambda x: x.startswith("#") or bool(outline.TECHNICAL_SECTION.match(x) or outline.generic_heading(x)) or outline.is_boundary(x)
    for seg in segments(text, opens):
        head = outline.bare(seg[0])
        if outline.TECHNICAL_SECTION.match(head):
            path = [head[: outline.LONGEST]]
        elif path is not front and (seg[0].startswith("#") or outline.generic_heading(head)):
            path = [path[0], head[: outline.LONGEST]]
        kind = "table" if outline.looks_like_table(seg) else "editorial" if path is front else "section"
        if runs and runs[-1][:2] == (path, kind) and kind != "table":
            runs[-1][2].extend(seg)
        else:
            runs.append((path, kind, list(seg)))
    lone: list[str] = []
    for i, (path, kind, lines) in enumerate(runs):
        if kind == "section" and len(lines) == 1 and estimate(lines[0]) <= 24 and i + 1 < len(runs) and runs[i + 1][0][:1] == path[:1]:
            lone += lines
            continue
        lines, lone = lone + lines, []
        if kind == "table":
            yield from table(lines, path, w)
        else:
            yield from (Block("\n".join(p), path, kind) for p in pack(lines, w.most, w.overlap))


def freeform(text: str, w: Window) -> Iterator[Block]:
    """Paragraphs, else sentences, packed with overlap; the path is a heading among the first lines."""
    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    if len(parts) < 2:
        parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+", text) if p.strip()]
    head = next((h for h in (outline.generic_heading(x) for x in [x for x in text.splitlines() if x.strip()][:3]) if h), "Page 1")
    yield from (Block(" ".join(p) if all("\n" not in x for x in p) else "\n\n".join(p), [head], "text") for p in pack(parts, w.most, w.overlap))


def merge_small(blocks: list[Block], w: Window) -> list[Block]:
    """One pass from left to right: a chunk below the floor takes its successor, if both fit and share their first label."""
    floor, cap = max(200, w.least * 3 // 4), w.most + math.ceil(w.most * w.overlap)
    out: list[Block] = []
    i = 0
    while i < len(blocks):
        a = blocks[i]
        if i + 1 < len(blocks) and estimate(a.text) < floor:
            b = blocks[i + 1]
            if a.path[:1] == b.path[:1] and "table" not in (a.kind, b.kind) and estimate(a.text) + estimate(b.text) <= cap:
                out.append(Block(f"{a.text}\n\n{b.text}", max(a.path, b.path, key=len), a.kind))
                i += 2
                continue
        out.append(a)
        i += 1
    return out


BUILDERS = {"normative_hierarchical": normative, "technical_structural": technical, "generic_structural": structural, "generic_freeform": freeform}


def chunks_of(text: str | None, strategy: str | None, w: Window) -> list[Block]:
    """A text's chunks; an unknown strategy is freeform."""
    found = [b for b in BUILDERS.get(strategy or "", freeform)(text or "", w) if b.text.strip()]
    return merge_small(found, w) if (strategy or "generic").startswith("generic") else found


def chunk_documents(docs: DataFrame, key: str, text: str, strategy: str, window: Window | None = None) -> DataFrame:
    """``(key, chunk_order, kind, path, chunk, tokens, chunk_id)`` of each row; ids follow from content, so chunking again changes nothing.

    A null or blank text has no chunks; legal texts are repaired first.
    """
    w = window or Window()
    schema = pa.schema([("chunk_order", pa.int32()), ("kind", pa.string()), ("path", pa.list_(pa.string())), ("chunk", pa.string()), ("tokens", pa.int32())])

    def run(batches):
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            at, rows = [], []
            for i, (t, s) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for n, c in enumerate(chunks_of(t, s, w)):
                    at.append(i)
                    rows.append((n, c.kind, c.path, c.text, estimate(c.text)))
            keys = b.column(0).take(pa.array(at, pa.int32()))
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([keys, *columns], names=[key, *schema.names])

    kind = docs.schema[key].dataType.simpleString()
    body = F.col(text).cast("string")
    out = docs.select(key, F.when(F.col(strategy) == "normative_hierarchical", repair(body)).otherwise(body).alias(text), strategy).mapInArrow(run, f"{key} {kind}, chunk_order int, kind string, path array<string>, chunk string, tokens int")
    return out.withColumn("chunk_id", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("chunk_order").cast("string"), F.md5("chunk"))))
