"""A toxicity classifier with a counterfactual penalty."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import Words, bounded_batches, chunked, mix64, stored, utf8_rows

SAMPLE_ROWS = 6000
FEATURES = 4096
PREFIXES = (3, 4, 5, 6)
TABLE_BITS = 22
RIDGE, COUNTERFACTUAL, ROUNDS = 2.0, 50.0, 300
INSERTED = 1
#: Words on either side of a mention that a counterfactual pair holds.
CONTEXT_WORDS = 8
# Identity terms by language, in groups within which one is put for another.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "lesbian", "straight", "bisexual", "transgender"), ("immigrant", "refugee", "foreigner", "citizen"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("muslimisch", "christlich", "jüdisch"), ("muslime", "christen", "juden"), ("schwarze", "weiße", "asiaten"), ("schwul", "lesbisch", "transsexuell"), ("ausländer", "flüchtling", "bürger"), ("behindert", "taub"), ("alte", "junge"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulman", "chrétien", "juif"), ("musulmans", "chrétiens", "juifs"), ("noir", "blanc", "asiatique"), ("homosexuel", "lesbienne", "transgenre"), ("immigré", "réfugié", "citoyen"), ("handicapé", "sourd", "aveugle"), ("vieux", "jeune"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmán", "cristiano", "judío"), ("musulmanes", "cristianos", "judíos"), ("negro", "blanco", "asiático"), ("homosexual", "lesbiana", "transexual"), ("inmigrante", "refugiado", "ciudadano"), ("discapacitado", "sordo", "ciego"), ("viejo", "joven"),
)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every word, lower-cased, and of its first bytes; a code is a place in a table of 2**TABLE_BITS."""
    words = Words([t.decode().lower().encode() for t in texts])
    rows, codes = [words.row], [words.substrings.hash(words.begin, words.end)]
    for n in PREFIXES:
        long = np.flatnonzero(words.end - words.begin >= n)
        rows.append(words.row[long])
        codes.append(mix64(words.substrings.hash(words.begin[long], words.begin[long] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(codes) >> np.uint64(64 - TABLE_BITS)


def distinct_features(texts: list[bytes]) -> list[np.ndarray]:
    row, code = features(texts)
    pairs = np.unique((row.astype(np.uint64) << np.uint64(TABLE_BITS)) | code)
    ends = np.searchsorted(pairs >> np.uint64(TABLE_BITS), np.arange(1, len(texts)).astype(np.uint64))
    return [(x & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int32) for x in np.split(pairs, ends)]


def swapped(text: bytes, groups: tuple[tuple[str, ...], ...], inserted: int = INSERTED) -> list[tuple[bytes, bytes]]:
    """Pairs of passages that differ in an identity term: for every mention in every sentence, the words around it, at most
    CONTEXT_WORDS on either side, against the same with another term of its group. A text without any mention gives
    `inserted` pairs: passages drawn from the whole text, with a term put in against without. Drawing goes by the text
    alone."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(text))
    known = {term: group for group in groups for term in group}
    sentences = [w for w in (x.split() for x in re.split(r"[.!?\n]", text.decode())) if w]
    pairs = []

    def around(words: list[str], i: int, more: list[str], skip: int) -> str:
        return " ".join([*words[max(0, i - CONTEXT_WORDS) : i], *more, *words[i + skip : i + skip + CONTEXT_WORDS]])

    for words in sentences:
        for i, w in enumerate(words):
            bare = w.lower().strip(",;:\"'()")
            if bare in known:
                others = [t for t in known[bare] if t != bare]
                pairs.append((around(words, i, [w], 1), around(words, i, [others[int(rng.integers(len(others)))]], 1)))
    for _ in range(0 if pairs or not sentences else inserted):
        words, group = sentences[int(rng.integers(len(sentences)))], groups[int(rng.integers(len(groups)))]
        i = int(rng.integers(len(words) + 1))
        pairs.append((around(words, i, [], 0), around(words, i, [group[int(rng.integers(len(group)))]], 0)))
    return [(a.encode(), b.encode()) for a, b in pairs]


_CODES = pa.list_(pa.int32())
PAIRS_AT_ONCE = 1000


@dataclass
class Model:
    place: np.ndarray  # of every table entry: 1 + its weight's index, or 0
    weight: np.ndarray  # weight 0 is that of no feature
    bias: float


def most_telling(coded: DataFrame, n: int) -> np.ndarray:
    """The n codes of coded(kind, codes) whose log-odds between kinds 1 and 0 stand out most from chance."""
    total = {r[0]: float(r[1]) for r in coded.groupBy("kind").count().collect()}
    of = coded.select("kind", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("kind").alias("a"), F.sum(1 - F.col("kind")).alias("b")).where("a + b >= 3")
    odds, spread = [], []
    for name, kind in (("a", 1), ("b", 0)):
        seen, left = F.col(name) + 0.5, F.lit(total.get(kind, 0.0) + 0.5) - F.col(name)
        odds.append(F.log(seen / left))
        spread.append(1 / seen + 1 / left)
    z = F.abs(odds[0] - odds[1]) / F.sqrt(spread[0] + spread[1])
    return np.array([r[0] for r in of.orderBy(F.round(z, 9).desc(), "code").limit(n).select("code").collect()], dtype=np.int64)


def train(rows: list[np.ndarray], toxic: np.ndarray, share: float, pairs: list[tuple[np.ndarray, np.ndarray, int]], chosen: np.ndarray) -> Model:
    """Ridge logistic regression on the chosen codes, with a penalty on the squared change of the logit within each
    counterfactual pair: (codes of the first alone, codes of the second alone, how many such pairs there are).

    share: that of toxic rows among all labelled ones; rows of the two classes are weighted to it. Accelerated gradient
    steps on a fixed number of rounds.
    """
    place = np.zeros(1 << TABLE_BITS, dtype=np.int32)
    place[chosen] = np.arange(1, len(chosen) + 1)

    def sparse(many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = [p[p > 0] for p in (place[r] for r in many)]
        return np.repeat(np.arange(len(at)), [len(p) for p in at]), np.concatenate(at or [np.zeros(0, np.int32)])

    n, m = len(rows), len(chosen) + 1
    x_row, x_at = sparse(rows)
    a_row, a_at = sparse([a for a, _, _ in pairs])
    b_row, b_at = sparse([b for _, b, _ in pairs])
    times = np.array([k for _, _, k in pairs], dtype=float)
    times *= 2 * COUNTERFACTUAL / max(times.sum(), 1.0)
    d_row, d_at, d_sign = np.concatenate((a_row, b_row)), np.concatenate((a_at, b_at)), np.concatenate((-np.ones(len(a_at)), np.ones(len(b_at))))
    y = toxic.astype(float)
    importance = np.where(toxic == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    # a diagonal step: the curvature of a weight, times how many features share a row
    width = np.bincount(x_row, minlength=n)
    curve = np.bincount(x_at, importance[x_row] * (width[x_row] + 1.0), m) / 4 + RIDGE
    if len(pairs):
        d_width = np.bincount(d_row, minlength=len(pairs))
        curve += np.bincount(d_at, (times * d_width)[d_row], m)
    bias_curve = float((importance * (width + 1.0)).sum()) / 4 + 1e-9
    w, bias = np.zeros(m), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    w_last, bias_last = w, bias
    for t in range(ROUNDS):
        ahead = t / (t + 3)
        v, c = w + ahead * (w - w_last), bias + ahead * (bias - bias_last)
        z = np.bincount(x_row, v[x_at], n) + c
        g = importance * (1 / (1 + np.exp(-z)) - y)
        grad = np.bincount(x_at, g[x_row], m) + RIDGE * v
        if len(pairs):
            change = np.bincount(d_row, d_sign * v[d_at], len(pairs))
            grad += np.bincount(d_at, d_sign * (times * change)[d_row], m)
        w_last, bias_last = w, bias
        w, bias = v - grad / curve, c - g.sum() / bias_curve
        w[0] = 0.0
    return Model(place, w, bias)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, inserted: int = INSERTED) -> Model:
    """A model of labels(doc_id, toxic) on docs(doc_id, text).

    At most sample_rows labelled documents of each class are used, those of least hash of their id. Their whole texts
    become feature codes on the executors, which also choose the n_features most telling ones; only what the sample has
    of these reaches the driver: at most 2 * sample_rows * n_features codes. All mentions of an identity term are swapped; a
    text without one gives `inserted` pairs. Of a pair only the codes that one side has alone bear on the penalty; equal
    ones are counted on the executors, so what reaches the driver grows with the pairs of terms, not with the texts. Labels other than 0 and 1 and null ids are
    ignored; of several labels of a document the largest counts. Repeated documents count each time. Without labels of
    both classes the score is the share of toxic labels (without any, 0).
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    each = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where("doc_id is not null")
    count = {r[0]: r[1] for r in each.groupBy("toxic").count().collect()}
    share = count.get(1, 0) / max(sum(count.values()), 1)
    least = [each.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for c in (0, 1)]
    sample = spark.createDataFrame(least[0].unionAll(least[1]).collect(), "doc_id long, toxic int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = utf8_rows(batch.column("text")), batch.column("toxic").to_pylist()
            for i, j in chunked(texts):
                codes = distinct_features(texts[i:j])
                columns = [pa.array(toxic[i:j], pa.int32()), pa.array(codes, _CODES), pa.nulls(j - i, _CODES)]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "codes", "twin"])
                for k in range(i, j):
                    twins = swapped(texts[k], groups, inserted)
                    for x in range(0, len(twins), PAIRS_AT_ONCE):
                        first, second = (distinct_features([p[side] for p in twins[x : x + PAIRS_AT_ONCE]]) for side in (0, 1))
                        alone = [[np.setdiff1d(p, q, assume_unique=True) for p, q in zip(*sides, strict=True)] for sides in ((first, second), (second, first))]
                        yield pa.RecordBatch.from_arrays([pa.array([2] * len(first), pa.int32()), *(pa.array(c, _CODES) for c in alone)], names=["kind", "codes", "twin"])

    matched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    coded = stored(matched.mapInArrow(run, "kind int, codes array<int>, twin array<int>"), "toxicity-codes")
    terms = np.unique(np.concatenate(distinct_features([t.encode() for group in groups for t in group])))
    chosen = np.union1d(most_telling(coded.where("kind < 2"), n_features), terms)

    def only_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << TABLE_BITS, dtype=bool)
        known[chosen] = True

        def kept(lists: pa.ListArray) -> pa.ListArray:
            values = lists.flatten().to_numpy()
            stay = known[values]
            ends = np.concatenate(([0], np.cumsum(stay)))[np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))]
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[stay]))

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("kind"), *(kept(batch.column(c)) for c in ("codes", "twin"))], names=["kind", "codes", "twin"])

    kept = coded.mapInArrow(only_chosen, coded.schema)
    got = kept.where("kind < 2").select("kind", "codes").toArrow()
    rows = list(zip(got.column("kind").to_pylist(), [np.asarray(x.values) for x in got.column("codes")], strict=True))
    if len({k for k, _ in rows}) < 2:
        return Model(np.zeros(1 << TABLE_BITS, np.int32), np.zeros(1), float(np.log((share + 1e-12) / (1 - share + 1e-12))))
    counted = kept.where("kind = 2").groupBy("codes", "twin").agg(F.count("*").alias("times")).toArrow()
    pairs = [(np.asarray(a.values), np.asarray(b.values), k.as_py()) for a, b, k in zip(*(counted.column(c) for c in ("codes", "twin", "times")), strict=True)]
    # the same sums whatever the order of arrival
    rows.sort(key=lambda x: (x[0], x[1].tobytes()))
    pairs.sort(key=lambda x: (x[0].tobytes(), x[1].tobytes()))
    return train([c for _, c in rows], np.array([k for k, _ in rows]), share, pairs, chosen)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus toxic_score (0 to 1; in place of a column of this name): every whole text; null texts are empty and score by
    the bias alone."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        m, texts, out = sent.value, utf8_rows(text), []
        for i, j in chunked(texts):
            row, code = features(texts[i:j])
            at = m.place[code.astype(np.int64)]
            hits = np.unique((row[at > 0].astype(np.int64) << 32) | at[at > 0])
            z = np.bincount(hits >> 32, m.weight[hits & 0xFFFFFFFF], j - i) + m.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("toxic_score", F.arrow_udf(run, "double")(F.col("text").cast("string")))
