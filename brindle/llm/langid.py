"""Language identification by interpolated Kneser-Ney character models.

One model of order four per language is fitted on a bounded, seeded sample of labelled documents, whole texts
of them. A character n-gram packs into 64 bits (16 a symbol); the n-grams of some languages, a shard,
form one sorted array per order, beside a matrix with each language's log probability, so that a position of a text costs
one binary search for all languages of the shard, and a few more where it must back off. A text gets the language
of the lowest cross-entropy per character, and is rejected if that entropy is far above what held-back
sample documents of the language show.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import by_value, clear_of, in_batches

by_value(__name__)

ORDER, NO_LETTER, UNKNOWN = 4, 0, 1
#: Bounds of the fitting sample: documents of a language, and of all together; letters told apart, the most frequent ones.
SAMPLE_DOCS, SAMPLE_ROWS, SYMBOLS = 500, 20_000, 65_000
#: Languages that share sorted arrays; positions scored at a time.
SHARD, CHUNK = 8, 500_000


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters_table(texts: list[str]) -> np.ndarray:
    """For each code point its symbol: 0 no letter, 1 a letter not seen, else a seen letter's number; case is folded."""
    seen = np.zeros(sys.maxunicode + 1, np.int64)
    for t in texts:
        np.add.at(seen, codes(t.lower()), 1)
    letter = np.fromiter((chr(c).isalpha() for c in range(len(seen))), bool, len(seen))
    order = np.nonzero((seen > 0) & letter)[0]
    order = order[np.lexsort((order, -seen[order]))][:SYMBOLS]
    table = letter.astype(np.uint16)
    table[order] = np.arange(2, len(order) + 2)
    for c in np.nonzero(letter)[0].tolist():
        low = chr(c).lower()
        if low != chr(c):
            table[c] = table[ord(low)] if len(low) == 1 else UNKNOWN
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """A text's symbols; each run of other characters is one 0, and a 0 comes first."""
    out = np.concatenate([[np.uint16(0)], table[codes(text)]])
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def grams(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The packed ORDER-grams that end at each symbol of the sequences, and their sequence; zeros stand before a start."""
    pad = np.zeros(ORDER - 1, np.uint16)
    flat = np.concatenate([x for s in sequences for x in (pad, s)] or [pad]).astype(np.uint64)
    key = flat.copy()
    for i in range(1, ORDER):
        key[i:] |= flat[:-i] << np.uint64(16 * i)
    owner = np.repeat(np.arange(len(sequences)), [len(s) + ORDER - 1 for s in sequences])
    inside = np.concatenate([x for s in sequences for x in (np.zeros(ORDER - 1, bool), np.ones(len(s), bool))] or [np.zeros(ORDER - 1, bool)])
    return key[inside], owner if not len(sequences) else owner[inside]


def _low(key: np.ndarray, n: int) -> np.ndarray:
    return key if n == 4 else key & np.uint64((1 << (16 * n)) - 1)


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


def fit(texts: list[str], langs: list[str], shard: int = SHARD) -> dict:
    """Models of all languages, ``shard`` of them sharing arrays."""
    names, table = sorted(set(langs)), letters_table(texts)
    shards = []
    for i in range(0, len(names), shard):
        some = set(names[i : i + shard])
        rows = [(t, x) for t, x in zip(texts, langs, strict=True) if x in some]
        shards.append(fit_shard(*map(list, zip(*rows, strict=True)), table))
    return {"names": names, "table": table, "shards": shards}


def fit_shard(texts: list[str], langs: list[str], table: np.ndarray) -> dict:
    """Models of some languages: for each order the sorted n-grams and log probabilities, the sorted contexts and log back-off weights."""
    names = sorted(set(langs))
    vocabulary = int(table.max()) + 1
    counts = []  # [language][order] = (keys, counts); below the highest order counts are of distinct left neighbours
    for name in names:
        key, _ = grams([symbols(t, table) for t, x in zip(texts, langs, strict=True) if x == name])
        levels = {ORDER: np.unique(key, return_counts=True)}
        for n in range(ORDER - 1, 0, -1):
            levels[n] = np.unique(_low(levels[n + 1][0], n), return_counts=True)
        counts.append(levels)
    model = {"names": names, "orders": {}}
    lower = None
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([c[n][0] for c in counts]))
        contexts = np.unique(keys >> np.uint64(16))
        logp, logb = np.zeros((len(keys), len(names))), np.zeros((len(contexts), len(names)))
        for i, c in enumerate(counts):
            own, amount = c[n]
            ones, twos = (amount == 1).sum(), (amount == 2).sum()
            discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
            here = np.searchsorted(contexts, own >> np.uint64(16))
            total, kinds = np.bincount(here, amount, len(contexts)), np.bincount(here, minlength=len(contexts))
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            at = np.searchsorted(contexts, keys >> np.uint64(16))
            base = np.full(len(keys), 1 / vocabulary) if lower is None else np.exp(lower[1][np.searchsorted(lower[0], _low(keys, n - 1)), i])
            p = back[at] * base
            p[np.searchsorted(keys, own)] += (amount - discount) / total[here]
            logp[:, i], logb[:, i] = np.log(p), np.log(back)
        model["orders"][n] = (keys, logp.astype(np.float32), contexts, logb.astype(np.float32))
        lower = (keys, logp)
    model["floor"] = float(-np.log(vocabulary))
    return model


def entropies(model: dict, sequences: list[np.ndarray]) -> np.ndarray:
    """Each sequence's cross-entropy a symbol, in nats, under each language."""
    key, owner = grams(sequences)
    sums = np.concatenate([_sums(shard, key, owner, len(sequences)) for shard in model["shards"]], axis=1)
    return -sums / np.array([[len(s)] for s in sequences])


def _sums(model: dict, key: np.ndarray, owner: np.ndarray, n_sequences: int) -> np.ndarray:
    """Log probabilities under the languages of a shard, summed by sequence."""
    sums = np.zeros((n_sequences, len(model["names"])))
    for i in range(0, len(key), CHUNK):
        part, score = key[i : i + CHUNK], None
        score, open_ = np.zeros((len(part), sums.shape[1]), np.float32), np.arange(len(part))
        for n in range(ORDER, 0, -1):
            keys, logp, contexts, logb = model["orders"][n]
            low = _low(part[open_], n)
            at, hit = _find(keys, low)
            score[open_[hit]] += logp[at[hit]]
            open_, low = open_[~hit], low[~hit]
            at, hit = _find(contexts, low >> np.uint64(16))
            score[open_[hit]] += logb[at[hit]]
        score[open_] += model["floor"]
        for j in range(sums.shape[1]):
            sums[:, j] += np.bincount(owner[i : i + CHUNK], score[:, j], n_sequences)
    return sums


def calibrate(model: dict, texts: list[str], langs: list[str]) -> dict:
    """Adds each language's usual entropy and spread, and the sharpness that makes scores probabilities."""
    seqs = [symbols(t, model["table"]) for t in texts]
    held = [i for i, s in enumerate(seqs) if s.any()]
    h = entropies(model, [seqs[i] for i in held]) if held else np.zeros((0, len(model["names"])))
    true = np.array([model["names"].index(langs[i]) for i in held], int)
    own = h[np.arange(len(h)), true]
    model["usual"] = np.array([np.median(own[true == j]) if (true == j).any() else np.median(own) if len(own) else 3.0 for j in range(len(model["names"]))])
    spread = [1.4826 * np.median(np.abs(own[true == j] - model["usual"][j])) if (true == j).any() else 0.1 for j in range(len(model["names"]))]
    model["most"] = model["usual"] + np.maximum(8 * np.array(spread), 0.6)
    losses = {}
    for t in (1, 2, 5, 10, 20, 50, 100):
        z = -t * (h - h.min(axis=1, keepdims=True)) if len(h) else h
        losses[t] = -(z[np.arange(len(h)), true] - np.log(np.exp(z).sum(axis=1))).mean() if len(h) else 0.0
    model["sharp"] = min(losses, key=losses.get)
    return model


def train(docs: DataFrame, learnable: Column, seed: str = "langid", docs_a_language: int = SAMPLE_DOCS, rows: int = SAMPLE_ROWS) -> dict | None:
    """Fit and calibrate on whole texts of at most ``docs_a_language`` labelled documents of each language and about ``rows`` in all, chosen by hash; None without any.

    Rows are told apart by id and text, so ids that repeat or are missing fill no sample; equal rows count as one.
    """
    labelled = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1_000_000_000)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    most = max(2, min(docs_a_language, rows // len(sizes)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, 1e9 * 1.3 * most / n)])
    some = labelled.where(F.col("h") < share[F.col("lang")]).dropDuplicates().limit(2 * max(rows, 2 * len(sizes)))
    taken: dict[str, int] = {}
    fitted, checked = ([], []), ([], [])
    for r in sorted(some.collect(), key=lambda r: (r.lang, r.h, r.text)):
        n = taken[r.lang] = taken.get(r.lang, 0) + 1
        if n <= most:
            to = checked if n % 5 == 0 else fitted
            to[0].append(r.text)
            to[1].append(r.lang)
    if not fitted[0]:
        return None
    return calibrate(fit(*fitted), *checked)


PREDICTED = ("lang_pred", "score", "entropy", "rejected")


def predict(docs: DataFrame, model: dict | None, names: Sequence[str] = PREDICTED) -> DataFrame:
    """``docs`` with the language, its score, its entropy and whether the text is rejected, under ``names``; only ``text`` is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    own = docs.columns
    at_text, kinds = own.index("text"), [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)]])

    def run(batches):
        m = held.value
        for b in batches:
            texts = b.column(at_text).to_pylist()
            seqs = [symbols(x or "", m["table"]) for x in texts] if m else []
            known = [i for i, s in enumerate(seqs) if s.any()]
            lang, score, entropy, rejected = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
            at = 0
            while at < len(known):  # by some million symbols at a time
                end, n = at, 0
                while end < len(known) and (n == 0 or n + len(seqs[known[end]]) < 2_000_000):
                    n += len(seqs[known[end]])
                    end += 1
                part = known[at:end]
                h = entropies(m, [seqs[i] for i in part])
                best = h.argmin(axis=1)
                p = 1 / np.exp(-m["sharp"] * (h - h.min(axis=1, keepdims=True))).sum(axis=1)
                for row, i in enumerate(part):
                    j = int(best[row])
                    lang[i], score[i], entropy[i] = m["names"][j], float(p[row]), float(h[row, j])
                    rejected[i] = bool(h[row, j] > m["most"][j] + 20 / len(seqs[i]))
                at = end
            added = [pa.array(x, kind) for x, kind in zip((lang, score, entropy, rejected), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*own, *names])

    return in_batches(docs.toDF(*[f"c{i}" for i in range(len(own))]), run, schema)  # any name goes through


def held_out() -> Column:
    """Whether a row is kept from learning: the checksum of its id as text is divisible by five (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row.

    A text that is null or has no letter is ``und`` with score 0 and rejected, as is every text if no
    labelled row can be learned from. Repeated rows are predicted as often as given; empty tables give
    empty results; whole texts are read, in pieces of bounded size; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(rows, train(docs, ~held_out(), **options)).withColumn("held_out", held_out()).drop("text")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without its rejected rows, ``lang`` set to the prediction; columns and repeated rows stay as given."""
    names = clear_of(docs, *PREDICTED)
    known = predict(docs, train(docs, ~held_out(), **options), names).where(~F.col(names[3]))
    return known.select(*[F.col(names[0]).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
