"""Spelling variants, ranked search and the set join against brute force, and on the awkward cases of their docstrings."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import queries, ranked_search, set_join, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, tmp_path_factory, tables):
    base = tmp_path_factory.mktemp("tables")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{base}/{name}.parquet")
    return str(base)


def components(nodes, links, least):
    group = {n: n for n in nodes}

    def find(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in links:
        group[find(a)] = find(b)
    best: dict = {}
    for n in nodes:
        best.setdefault(find(n), []).append(least(n))
    return {n: min((x for x in best[find(n)] if x is not None), default=None) for n in nodes}


# --- spelling ---


def spelled_corpus():
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdeéßÿ") for _ in range(rng.randint(6, 12))) for _ in range(40)]
    stems += [stems[0][:-1] + "x", "q" + stems[0], stems[1][1:], stems[2][:3] + "z" + stems[2][3:], "aaaaaaa", "aaaaaaaa", "aaaaaab", "Ünötigès"]
    texts = []
    for _ in range(250):
        words = [rng.choice(stems[: 1 + rng.randint(0, len(stems) - 1)]) for _ in range(rng.randint(0, 60))]
        texts.append(rng.choice([" ", "-", "1", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words))
    texts += [None, "", "abc" * 3000, texts[0], texts[0]]
    return [(i * 2 + 1, t, None, "s", 1) for i, t in enumerate(texts)] + [(None, texts[1], None, None, None)]


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(counts: dict[str, int], ratio: int = 10) -> dict[str, tuple]:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(((-counts[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root(w)) for w in counts}


def test_spelling_query_equals_brute_force(spark, tmp_path_factory):
    rows = spelled_corpus()
    sf = written(spark, tmp_path_factory, {"documents": (rows, SCHEMA)})
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen: Counter = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            seen[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    want = brute_forms({w: n for w, n in seen.items() if len(w) >= 7 and n >= 2})
    got = queries.op11_spelling(spark, sf).collect()
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == want
    assert len(got) == len(want) and any(v[2] for v in want.values())


def test_chunks_lose_no_pair_of_any_kind_or_length(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(4, 9))) for _ in range(250)} | {"".join(rng.choice("abcß👍") for _ in range(20)) for _ in range(3)}
    for w in sorted(words)[-40:]:
        i = rng.randrange(len(w))
        words |= {w[:i] + "z" + w[i:], w[:i] + w[i + 1 :] + "yy", w[:i] + "k" + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 4)
    counted = spark.createDataFrame([(w, 1 + i) for i, w in enumerate(words)], "word string, n long").withColumn("key", F.lit(1))
    got = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_words(counted.select("word", "n")).collect()]
    assert Counter(got) == Counter((a, b) for a, b in itertools.combinations(words, 2) if one_edit(a, b))


def test_roots_follow_long_ways_of_forms_and_ties_go_to_the_least(spark):
    names = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl", "abcdefghijklm"]
    rows = [(w, 10**i) for i, w in enumerate(names)] + [("tttttta", 90), ("ttttttb", 90), ("ttttttc", 9), (None, 5)]
    got = {r["word"]: r for r in spelling.spelling_forms(spark.createDataFrame(rows, "word string, n long").withColumn("root", F.lit(0))).collect()}
    assert {got[w]["root"] for w in names} == {names[-1]} and got["ttttttc"]["form"] == "tttttta" and None not in got
    assert spelling.spelling_forms(spark.createDataFrame([], "word string, n long")).count() == 0


def test_a_word_that_thousands_are_near_keeps_them_all(spark):
    stem, letters = "hauptwort", "abcdefghijklmnopqrstuvwxyz"
    many = {stem[:i] + c + stem[i:] for i in range(10) for c in letters} | {stem[:i] + c + stem[i + 1 :] for i in range(9) for c in letters}
    many.discard(stem)
    df = spark.createDataFrame([(stem, 10_000), *((w, 2) for w in sorted(many))], "word string, n long")
    got = {r["word"]: r for r in spelling.spelling_forms(df).collect()}
    assert got[stem]["n_near"] == len(many) and all(got[w]["root"] == stem for w in many)


# --- ranked search ---


def search_corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = []
    for i in range(900):
        words = [vocabulary[min(int(rng.expovariate(0.06)), 119)] for _ in range(rng.randint(0, 80))]
        rows.append((i * 3 % 907, rng.choice([" ", ", ", "\x00", "_"]).join(words), None, "s", 1))
    rows += [(5000, None, None, None, None), (5001, "", None, None, None), (5002, "?!", None, None, None), (5003, "ab " * 20000, None, None, None), (5004, rows[3][1].upper(), "x", None, None)]
    rows += [(6000 + i, rows[7][1], None, None, None) for i in range(30)] + [rows[9], (None, rows[9][1], None, None, None)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))) for i in range(12)] + [(20, None), (21, "unseenword"), (22, rows[7][1]), (23, "Ab ab AB"), (24, "")]
    return rows, items


def brute_search(rows, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: [x.translate(lower) for x in pattern.findall(t or "")]
    docs = [(doc_id, Counter(terms(text))) for doc_id, text, *_ in rows]
    n, every, df = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = {}
    for item, text in items:
        found = []
        for doc_id, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * n) // every
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out[item] = [(i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("rows_a_shard,terms_a_shard", [(4096, 1 << 20), (64, 1 << 20), (500, 300)])
def test_search_equals_brute_force_at_any_shard_size(spark, tmp_path_factory, monkeypatch, rows_a_shard, terms_a_shard):
    rows, items = search_corpus()
    monkeypatch.setattr(ranked_search, "SHARD_ROWS", rows_a_shard)
    monkeypatch.setattr(ranked_search, "SHARD_TERMS", terms_a_shard)
    monkeypatch.setattr(ranked_search, "QUERY_PAIRS", 40)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit("x"), "shard": F.lit(1)}).repartition(2)
    index = ranked_search.build_index(docs)
    for k in (1, 10):
        got: dict = {}
        for r in ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string"), k).orderBy("item_id", "rank").collect():
            got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
        assert got == brute_search(rows, items, k)


def test_blocks_that_cannot_reach_the_threshold_are_not_decoded(spark):
    """One rare term decides; the frequent term's blocks hold few of the candidates."""
    rng = random.Random(3)
    rows = [(i, ("rare rare rare " if i in (1, 2, 3, 4, 5, 900, 1900, 2900) else "") + "common " * rng.randint(1, 9), None, None, 1) for i in range(4000)]
    index = ranked_search.build_index(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    own = {r["term"]: r.asDict() for r in index.collect()}
    spread = lambda length: 10 + (90 * length * 4000) // sum(own[None]["lengths"])
    import numpy as np

    lists = [ranked_search._List(own[t], w, spread) for t, w in ((b"rare", 6000), (b"common", 1))]
    doc, _ = ranked_search.search_shard(lists, spread(np.array(own[None]["lengths"], dtype=np.int64)), 5)
    assert len(doc) == 5 and len(lists[1].decoded) < len(lists[1].last) / 2


def test_search_of_empty_tables(spark):
    empty, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert ranked_search.search(ranked_search.build_index(empty), items).count() == 0
    index = ranked_search.build_index(spark.createDataFrame([(1, "a b", None, None, 1)], SCHEMA))
    assert ranked_search.search(index, items.limit(0)).count() == 0


# --- set join ---


def sets_corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts: list = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 160))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                i = rng.randrange(len(words))
                words[i : i + rng.choice([0, 1])] = rng.choice([[rng.choice(vocabulary)], []]) or [rng.choice(vocabulary)]
            texts.append(rng.choice([" ", "\n"]).join(words))
    relatives = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(25):  # most not alike enough, all with many shingles in common
        words = list(relatives)
        for _ in range(3 + i % 5):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[0].upper(), texts[1] + " " + texts[1], "one two", "One  two", "one two three four", "", None, " \n", "", "x " * 4000, "x " * 9]
    rows = [(i * 5 % 1009, t, None, "s", 1) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[2], None, None, None), (None, "alone here with nobody else", None, None, None)]


def brute_sets(rows, words=4, similarity=(85, 100)):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and similarity[1] * len(sets[i] & sets[j]) >= similarity[0] * len(sets[i] | sets[j])]
    found = components(range(len(rows)), links, lambda i: rows[i][0])
    return Counter((rows[i][0], len(sets[i]), found[i]) for i in range(len(rows))), links


@pytest.mark.parametrize("seed,block", [(2, 256), (3, 4)])
def test_set_join_equals_brute_force_in_blocks_of_any_size(spark, monkeypatch, seed, block):
    rows = sets_corpus(seed)
    monkeypatch.setattr(set_join, "BLOCK_MEMBERS", block)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "shingle": F.lit(1), "id": F.lit(1)}).repartition(3)
    want, links = brute_sets(rows)
    got = Counter(tuple(r) for r in set_join.similar_sets(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want and len(links) > 20


def test_set_join_of_a_large_family_and_another_threshold(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(150)] = f"u{i}"
        rows.append((i, " ".join(words), None, None, 1))
    got = set_join.similar_sets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 400
    few = sets_corpus(6)[:60]
    want, _ = brute_sets(few, 3, (60, 100))
    assert Counter(tuple(r) for r in set_join.similar_sets(spark.createDataFrame(few, SCHEMA), 3, (60, 100)).collect()) == want


def test_set_join_of_an_empty_table(spark):
    assert set_join.similar_sets(spark.createDataFrame([], SCHEMA)).count() == 0
