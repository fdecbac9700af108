"""Hand-made rows for what the operators must not get wrong."""

from __future__ import annotations

import datetime
import itertools
import json
import math
import random
import re
import time
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire import plans
from quire.functions import expressions as e
from quire.functions.literals import alphabet, excerpts, needed_literal
from quire.operators import alignment, evaluation, facts, layout, match, nearest, ranges, score, series, tables, text
from quire.operators.batching import read_batched, whole_keys
from quire.sources import incremental, page_json, pages, views
from quire.streaming import quota


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bags_are_counted_by_one_aggregation(spark):
    a, b = (spark.createDataFrame(rows, "k int, t string") for rows in ([(1, "a"), (1, "a"), (1, None), (2, "c")], [(1, "a"), (1, None), (1, "b")]))
    flags = spark.createDataFrame([(1, "a"), (1, None), (3, "z")], "k int, t string")
    sided = a.withColumn("side", F.lit("a")).unionAll(b.withColumn("side", F.lit("b")))
    for pair in ((a, b), (sided, None)):
        diff = match.bag_diff(*pair, ["k", "t"])
        assert got(diff.fillna("none"), "k", "t", "missing", "extra") == [(1, "a", 1, 0), (1, "b", 0, 1), (1, "none", 0, 1), (1, "none", 1, 0), (2, "c", 1, 0)]
        assert got(match.silent_errors(*pair, flags, a.where("k = 2"), "k", "t"), "k", "silent") == [(1, 3), (2, 0)]
        assert "Join" not in diff._jdf.queryExecution().executedPlan().toString()


def test_bag_difference_with_itself_is_empty(spark):
    bag = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "k int, t string")
    assert match.bag_diff(bag, bag, ["k", "t"]).where("missing + extra > 0").count() == 0
    assert got(match.bag_diff(bag, bag.limit(0), ["k", "t"]), "t", "missing", "extra") == [("a", 2, 0), ("b", 1, 0)]


def test_resolve_prefers_unambiguous_then_rank(spark):
    rows = [(1, 1, "x", 7, True, 0.9), (1, 2, "y", 2, False, 0.5), (1, 3, "z", 2, False, 0.5), (2, 4, None, 1, True, None)]
    df = spark.createDataFrame(rows, "key int, fact_id int, value string, rnk int, ambiguous boolean, confidence double")
    assert got(facts.resolve(df), "key", "fact_id") == [(1, 2), (2, 4)]
    assert got(facts.evidence_conflicts(df), "fact_id", "winner") == [(1, "y"), (3, "y")]


@pytest.mark.parametrize("pcts,want", [(["33.33", "33.33", "33.34"], ["3.33", "3.33", "3.34"]), (["50", "25", "10"], ["5.00", "2.50", "1.00"]), (["33.33", "33.33", "33.33"], ["3.33", "3.33", "3.34"])])
def test_allocation_sums_to_the_total_only_if_percentages_do(spark, pcts, want):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(pcts)], "k int, n int, p string").select("k", "n", F.lit("10").cast("decimal(18,2)").alias("total"), F.col("p").cast("decimal(18,2)").alias("pct"))
    found = [str(r[0]) for r in score.allocate(rows, "k", "n", "total", "pct").orderBy("n").select("amount").collect()]
    assert found == want


def test_even_split_gives_the_last_the_remainder(spark):
    rows = spark.createDataFrame([(1, i) for i in range(3)], "k int, n int").withColumn("total", F.lit("10").cast("decimal(18,2)"))
    assert [str(r[0]) for r in score.split_evenly(rows, "k", "n", "total").orderBy("n").select("amount").collect()] == ["3.33", "3.33", "3.34"]


def test_answered_total_of_k_of_n(spark):
    rows = [(1, 1, 10.0, ""), (1, 2, 5.0, "g"), (1, 3, 7.0, "g"), (2, 1, 4.0, "g"), (2, 2, 4.0, "g")]
    df = spark.createDataFrame(rows, "qid int, sec int, points double, grp string").withColumns({"points": F.col("points").cast("decimal(18,2)"), "k": F.lit(1), "total": F.lit(17).cast("decimal(18,2)")})
    assert [(a, float(b)) for a, b in got(score.answered_total(df), "qid", "answered")] == [(1, 17.0), (2, 4.0)]
    assert ("1", "g", "unequal_options") in [tuple(map(str, r)) for r in got(score.score_issues(df), "qid", "grp", "issue")]
    assert score.rebalance(df).where("qid = 1").groupBy("grp").agg(F.count_distinct("new_points").alias("n")).where("n > 1").count() == 0


def test_as_of_takes_the_last_mark_at_or_before(spark):
    items = spark.createDataFrame([(1, 5), (1, 10), (1, 2), (2, 9)], "k int, at int")
    marks = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "k int, y int, v string")
    assert sorted(ranges.as_of(items, marks, "k", "at", "y", "v").select("k", "at", "v").collect(), key=str) == sorted([(1, 2, None), (1, 5, "a"), (1, 10, "b"), (2, 9, None)], key=str)


def test_near_and_overlap_joins_meet_once(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.05), (1, -3.0)], "k int, x double")
    b = spark.createDataFrame([(1, 1.9), (1, 0.0), (1, 5.0)], "k int, o double")
    assert got(ranges.near_join(a, b, ["k"], F.col("x"), F.col("o"), 1.0), "x", "o") == [(1.0, 0.0), (1.0, 1.9), (2.05, 1.9)]
    s = spark.createDataFrame([(1, 0, 100), (1, 95, 96)], "k int, b int, e int")
    t = s.select("k", F.col("b").alias("ob"), F.col("e").alias("oe"))
    assert ranges.overlap_join(s, t, ["k"], ("b", "e"), ("ob", "oe"), 10).count() == 4


def test_tolerance_match_marks_contested_unmatched_and_extra(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 5.0, 5.0)], "k int, pid long, x double, y double")
    b = spark.createDataFrame([(1, 7, 0.05, 0.0), (1, 8, 0.1, 0.0)], "k int, pid long, x double, y double")
    assert sorted(match.tolerance_match(a, b, "k", 0.2, 0.2).select("pid", "match_id", "status").collect(), key=str) == sorted([(1, 7, "contested"), (2, None, "unmatched"), (None, 8, "extra")], key=str)


def test_boilerplate_needs_half_of_the_pages_and_never_counts_empty_lines(spark):
    lines = [(g, p, line) for g, p, line in [("s", 1, "page 1"), ("s", 2, "page 2"), ("s", 3, "other"), ("s", 1, ""), ("s", 2, ""), ("s", 3, ""), ("t", 1, "page 1")]]
    df = spark.createDataFrame(lines, "g string, p int, line string")
    assert got(text.boilerplate(df, "g", "p").where("repeated"), "g", "p") == [("s", 1), ("s", 2)]


def test_text_blocks(spark):
    lines = ["(1) solve", "this part.", "Next", "$$x$$", "after", "", "end"]
    df = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "d int, line_no int, line string")
    assert [r[0] for r in text.text_blocks(df, "d").orderBy("block").select("text").collect()] == ["(1) solve this part.", "Next", "$$x$$", "after", "end"]
    assert text.text_blocks(df, "d", preserve=True).count() == 6


def test_comma_context(spark):
    df = spark.createDataFrame([(1, "well, 7,350 and (1, 2) $a,b$ x,y"), (2, "")], "d int, text string")
    assert got(text.punctuation_commas(df, "d"), "d", "commas", "punctuation") == [(1, 5, 1), (2, 0, 0)]


def test_alignment_rebuilds_the_other_reading(spark):
    a, b = "one two three four five six".split(), "one two 3 four six seven".split()
    frames = [spark.createDataFrame([(9, i, w) for i, w in enumerate(words)], "d long, pos int, tok string") for words in (a, b)]
    ops = sorted(tuple(r) for r in text.aligned_diff(*frames, "d").select("from_a", "to_a", "from_b", "to_b").collect())
    out, at = [], 0
    for i, j, k, m in ops:
        out += a[at:i] + b[k:m]
        at = j
    assert out + a[at:] == b
    assert sorted(tuple(r) for r in text.compare_readings(*frames, "d").select("from_a", "to_a", "kind").collect()) == [(0, 6, "incomplete"), (2, 3, "number"), (4, 5, "missing"), (6, 6, "extra")]


def readings(spark, a: dict[int, str], b: dict[int, str]):
    frames = [spark.createDataFrame([(d, i, w) for d, t in side.items() for i, w in enumerate(e_tokens(t))], "d long, pos int, tok string") for side in (a, b)]
    return [(r["d"], r["kind"], r["text_a"], r["text_b"]) for r in text.compare_readings(*frames, "d").orderBy("d", "from_a", "from_b").collect()]


def e_tokens(line: str) -> list[str]:
    return re.findall(r"\$\$[^$]+\$\$|\$[^$]+\$|[^\s$]+", line)


def test_readings_of_all_kinds(spark):
    base = "the quick brown fox jumps over a lazy dog and runs home again"
    a = {1: base, 2: base, 4: base, 5: base + " $x^{2}+1$ end", 6: base + " $x^{2}$ end", 7: base + " 12 end", 8: base, 9: "again " + base.replace("again", "now"), 10: base, 11: base}
    b = {1: base, 3: base, 4: base.replace("lazy", "[?]"), 5: base + " $x^3+1$ end", 6: base + r" $x^2\,$ end", 7: base + " 13 end", 8: "only these words", 9: base.replace("again", "now") + " again", 10: base.replace("quick ", ""), 11: base.replace("brown", "crown")}
    got = readings(spark, a, b)
    assert (2, "missing", base, "") in got and (3, "extra", "", base) in got and (2, "incomplete", "", "") in got
    rest = [r for r in got if r[0] in (1, 4, 5, 6, 7, 9, 10, 11)]
    assert rest == [(4, "unreadable", "lazy", "[?]"), (5, "formula", "$x^{2}+1$", "$x^3+1$"), (7, "number", "12", "13"), (9, "missing", "again", ""), (9, "extra", "", "again"), (10, "missing", "quick", ""), (11, "word", "brown", "crown")]
    assert {k for d, k, *_ in got if d == 8} >= {"incomplete"}


def test_anchors_are_the_longest_rising_row(spark):
    rng = random.Random(3)
    for n in (1, 5, 200):
        places = list(range(n))
        for _ in range(n // 5):
            places.insert(rng.randrange(n), places.pop(rng.randrange(n)))
        keep = alignment.rising(places)
        row = [p for p, k in zip(places, keep, strict=True) if k]
        longest = [1] * n
        for i in range(n):
            longest[i] = 1 + max((longest[j] for j in range(i) if places[j] < places[i]), default=0)
        assert row == sorted(row) and len(row) == max(longest)
    words = [f"w{i}" for i in range(300)]
    moved = words[1:] + words[:1]  # one word from the front to the end costs itself only
    frames = [spark.createDataFrame([(1, i, w) for i, w in enumerate(x)], "d long, pos int, tok string") for x in (words, moved)]
    assert text.anchors(*frames, "d").count() == 299


def test_number_pairs(spark):
    a = spark.createDataFrame([(1, 1, "7,350 and $x=12$"), (1, 2, "5 of 5"), (2, 1, "1{,}000")], "d int, line_no int, line string")
    b = spark.createDataFrame([(1, 1, "7350 and $x=13$"), (1, 2, "5 of 6 or 9"), (2, 1, "1000")], "d int, line_no int, line string")
    assert got(text.number_pairs(a, b, "d"), "d", "place", "number_a", "number_b") == [(1, 1, "12", "13"), (1, 2, "5", "6"), (1, 3, None, "9")]


def test_normalisers_of_words_formulas_and_labels(spark):
    def one(f, *texts):
        return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]

    assert one(e.word, "\u05e9\u05b8\u05c1\u05dc\u05d5\u05b9\u05dd", '\u05e1\u05f4\u05de', '\u05e1"\u05de', "Word,") == ["\u05e9\u05dc\u05d5\u05dd", "\u05e1\u05de", "\u05e1\u05de", "word"]
    assert one(e.maths, r"$\left(a\right)\leftarrow b$", r"x\ne y", r"x \quad y", r"\mathrm{cm}^{2}", r"\dfrac{1}{2}", "7{,}350", r"x^{12}", r"\Big(x\Big)", r"a \leq b", r"{A}_{1}.") == [r"(a)\leftarrowb", "x≠y", "xy", "cm^2", r"\frac12", "7,350", "x^{12}", "(x)", "a≤b", "A_1"]
    assert one(e.number, "7,350", "3,5", "1{,}000") == ["7350", "3.5", "1000"]
    assert one(e.tokens, "solve $$x=3$$ or $y$ now", "\u05d1\u05d9\u05ea\u05be\u05e1\u05e4\u05e8") == [["solve", "$$x=3$$", "or", "$y$", "now"], ["\u05d1\u05d9\u05ea", "\u05e1\u05e4\u05e8"]]
    assert one(lambda t: e.token_kind(t), "$$x=3$$", "$y$", "word") == ["M", "M", "W"]
    assert one(e.maths, r"\mathrm{a\frac{b}{c}}", r"\text x", r"a_{\mathrm{cm}}", r"{a{b}", None, "$1.5.,$", r"\{x\}") == [r"\mathrm{a\fracbc}", r"\textx", "a_{cm}", r"{ab", None, "1.5", r"\{x\}"]
    numbers = ["1,000,000", "(1,200)", "at (3, -4) or 2x-1", "−5 and 1234,567", "f(2)-3", "(1;2) 7.5", "", None]
    assert one(e.numbers_in, *numbers) == [["1000000"], ["1", "200"], ["3", "-4", "2", "1"], ["-5", "1234", "567"], ["2", "3"], ["1", "2", "7.5"], [], None]
    assert one(e.strip_label, "(12) a", "3. b", "IV. c", "\u05d1. d", "a) e", "1999. f", "Ivy. g") == ["a", "b", "c", "d", "e", "1999. f", "Ivy. g"]


def test_rebalancing_of_rubrics_and_of_weights_of_nothing(spark):
    rows = [(1, 1, 10, "", 100, 0), (1, 2, 30, "", 100, 0), (2, 1, 20, "", 100, 0), (2, 2, 10, "g", 100, 1), (2, 3, 30, "g", 100, 1), (3, 1, 0, "", 90, 0), (3, 2, 0, "", 90, 0), (3, 3, 0, "", 90, 0), (4, 1, 0, "g", 50, 1), (4, 2, 0, "g", 50, 1)]
    sections = spark.createDataFrame(rows, "qid int, sec int, points int, grp string, total int, k int").withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("points", "total")})
    new = score.rebalance(sections)
    assert {(r["qid"], r["sec"]): float(r["new_points"]) for r in new.collect()} == {(1, 1): 25, (1, 2): 75, (2, 1): 50, (2, 2): 50, (2, 3): 50, (3, 1): 30, (3, 2): 30, (3, 3): 30, (4, 1): 50, (4, 2): 50}
    steps = [(1, 1, 1, 10), (1, 1, 2, 10), (1, 2, 1, 10), (2, 0, 1, 60), (2, 1, 1, 30), (2, 1, 2, 10), (2, 2, 1, 0), (2, 2, 2, 0), (3, 1, 1, 0), (4, 0, 1, 20), (4, 0, 2, 20)]
    rubric = spark.createDataFrame(steps, "qid int, sec int, step int, pct int").withColumn("pct", F.col("pct").cast("decimal(18,2)"))
    got_pct = {(r["qid"], r["sec"], r["step"]): float(r["new_pct"]) for r in score.rebalance_rubric(new, rubric).collect()}
    assert got_pct == {(1, 1, 1): 33.33, (1, 1, 2): 33.33, (1, 2, 1): 33.34, (2, 0, 1): 60, (2, 1, 1): 18.75, (2, 1, 2): 6.25, (2, 2, 1): 12.5, (2, 2, 2): 12.5, (3, 1, 1): 0, (4, 0, 1): 50, (4, 0, 2): 50}


def test_greedy_matching_goes_on_after_the_nearest_is_taken(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.3, 0.0), (1, 3, 9.0, 0.0)], "k int, pid long, x double, y double")
    b = spark.createDataFrame([(1, 1, 0.2, 0.0), (1, 2, 0.9, 0.0)], "k int, pid long, x double, y double")
    assert got(match.tolerance_match(a, b, "k", 1.0, 1.0).where("match_id is not null and pid is not null"), "pid", "match_id") == [(1, 2), (2, 1)]
    chain = [(1, i, 1.0 * i * i / 100 + i, 0.0) for i in range(40)]
    x = spark.createDataFrame(chain, "k int, pid long, x double, y double")
    y = spark.createDataFrame([(1, i, v + 0.55, 0.0) for _, i, v, _ in chain], "k int, pid long, x double, y double")
    pairs = sorted((round((v - w) ** 2, 9), i, j) for _, i, v, _ in chain for j, w in [(j, u + 0.55) for _, j, u, _ in chain] if abs(v - w) <= 1.4)
    want, used_a, used_b = [], set(), set()
    for _, i, j in pairs:
        if i not in used_a and j not in used_b:
            want.append((i, j))
            used_a.add(i)
            used_b.add(j)
    assert got(match.tolerance_match(x, y, "k", 1.4, 1.0).where("match_id is not null and pid is not null"), "pid", "match_id") == sorted(want)


def test_hot_keys_are_streamed_counted_or_cut(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2_000_000) if i % 3 else 7, i, 1 if i % 4 else i) for i in range(4000)]
    df = spark.createDataFrame(rows, "ms long, rid long, client long").select(F.timestamp_millis("ms").alias("ts"), "rid", "client")
    want, held = {}, {}
    for t, rid, client in sorted((t * 1000, r, c) for t, r, c in rows):
        own = held[client] = [x for x in held.get(client, []) if x > t - 50_000_000]
        want[rid] = (len(own) < 3, 0 if len(own) < 3 else own[0] + 50_000_000 - t)
        own += [t] if len(own) < 3 else []
    assert {r["rid"]: (r["accepted"], r["wait"]) for r in quota.admit(df, 3, 50).collect()} == want
    requests = df.withColumn("model", F.lit("m"))
    caps = spark.createDataFrame([("m", 1000, 0), ("n", 5, 1)], "model string, cap int, place int")
    order = sorted((t, rid) for t, rid, _ in rows)
    assert got(quota.daily_cap(requests, caps), "n", "first_over", "next_model") == [(4000, order[1000][1], "n")]
    values = [(k, float(v)) for k in range(3) for v in ([5.0] * 500 + [rng.random() ** 4 * 1000 for _ in range(700)] if k else [3.0])]
    shares = {"lo": 0.0, "p50": 0.5, "p95": 0.95, "hi": 1.0}
    found = {r["k"]: [r[n] for n in shares] for r in evaluation.percentiles(spark.createDataFrame(values, "k int, v double"), "k", "v", shares).collect()}
    for k in range(3):
        assert np.allclose(found[k], [np.quantile([v for q, v in values if q == k], p) for p in shares.values()])


def test_breaks_are_carried_over(spark):
    lines = ["alpha beta gamma", "delta epsilon zeta"]
    source = spark.createDataFrame([(1, n, i, w) for n, line in enumerate(lines) for i, w in enumerate(line.split())], "d int, line_no int, pos int, tok string")
    target = spark.createDataFrame([(1, i, w) for i, w in enumerate("alpha beta gamma delta epsilon zeta".split())], "d int, pos int, tok string")
    assert got(text.transfer_breaks(target, source, "d"), "pos", "reversed") == [(3, False)]
    turned = spark.createDataFrame([(1, i, w) for i, w in enumerate("delta epsilon zeta alpha beta gamma".split())], "d int, pos int, tok string")
    assert got(text.transfer_breaks(turned, source, "d"), "pos", "reversed") == [(3, True)]
    assert text.transfer_breaks(target.where("pos < 2").unionByName(target.where("pos < 4").selectExpr("d", "pos + 2 AS pos", "concat(tok, 'x') AS tok")), source, "d").count() == 0


def brute_breaks(target: dict, source: dict, least: float) -> set:
    """(key, pos, reversed) by dictionaries, from {key: [word]} and {key: [[word]]}; the longest rising rows by trying all."""
    out = set()
    for k, words in target.items():
        places = [(n, i, w) for n, line in enumerate(source.get(k, [])) for i, w in enumerate(line)]
        own = {w: p for p, w in enumerate(words) if words.count(w) == 1}
        met = {w: (n, i) for n, i, w in places if sum(w == x for *_, x in places) == 1}
        row = sorted((p, *met[w]) for w, p in own.items() if w in met)
        kept = {}
        for turn in (1, -1):
            best: list = []
            for p, n, i in row:
                best.append(max(([*b, (p, n, i)] for b in [[], *best] if not b or (turn * b[-1][1], b[-1][2]) < (turn * n, i)), key=len))
            kept[turn] = max(best, key=len, default=[])
        turn = -1 if len(kept[-1]) > len(kept[1]) else 1
        if len(kept[turn]) >= least * len(own):
            out |= {(k, y[0], turn == -1) for x, y in zip(kept[turn], kept[turn][1:], strict=False) if x[1] != y[1] and y[2] == 0}
    return out


def test_breaks_of_runs_need_no_row_for_each_word_and_no_join(spark):
    rng, target, source = random.Random(8), {}, {}
    for k in range(300):
        lines = [[f"w{k % 7}_{n}_{i}" for i in range(rng.randrange(7))] for n in range(rng.randrange(1, 6))]
        turned = lines[::-1] if k % 3 == 0 else lines
        source[k], target[k] = lines, [rng.choice(["the", "x", w]) if rng.random() < k % 5 / 10 else w for line in turned for w in line]
        if k % 50 == 1:
            del source[k]
    whole = spark.createDataFrame([(k, 0, 0, v) for k, v in target.items()] + [(None, 0, 0, ["a"]), (900, 0, 0, None), (901, 0, 0, [])], "d int, line_no int, pos int, toks array<string>")
    lines = spark.createDataFrame([(k, n, 0, line) for k, v in source.items() for n, line in enumerate(v)] + [(None, 0, 0, ["a"])], "d int, line_no int, pos int, toks array<string>").repartition(5)
    want = brute_breaks(target, source, 0.6)
    assert len(want) > 100 and {r for *_, r in want} == {True, False}
    for held in (1, 40, 1 << 18):
        found = text.breaks_of_runs(whole, lines, "d", held_words=held)
        rows = got(found, "d", "pos", "reversed")
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert not planned(found, "Generate") and not planned(found, "SortMergeJoin|BroadcastHashJoin") and planned(found, "Exchange") == 2  # one of them deals the lines of this test
    words = lambda df: df.select("d", "line_no", F.posexplode("toks").alias("pos", "tok"))
    assert set(got(text.transfer_breaks(words(whole).drop("line_no"), words(lines), "d"), "d", "pos", "reversed")) == want
    joined = (df.withColumn("toks", F.array_join("toks", " ")) for df in (whole, lines))
    assert set(got(text.breaks_of_runs(*joined, "d", words=lambda t: F.regexp_extract_all(t, F.lit("[^ ]+"), 0)), "d", "pos", "reversed")) == want
    assert text.breaks_of_runs(whole.where("false"), lines.where("false"), "d").count() == 0


def planned(df, step: str) -> int:
    """How often the plan has a step, before it runs."""
    return len(re.findall(rf"\b{step}\b", df._jdf.queryExecution().executedPlan().toString()))


def shared_boxes(spark, rng, pages: int = 6, n: int = 60):
    rows = [(p, i, x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)) for p in range(pages) for i in range(n) for x, y in [(rng.randint(0, 30), rng.randint(0, 30))]]
    return rows, spark.createDataFrame([*rows, (None, 1, 0, 0, 5, 5), (0, 999, None, 0, 5, 5)], "page int, box_id int, x0 int, y0 int, x1 int, y1 int").repartition(3, "page")


def test_regions_are_bound_by_one_sort(spark):
    rng = random.Random(12)
    items = [(p, i, y, y + rng.randint(-2, 9)) for p in range(5) for i in range(80) for y in [rng.randint(0, 60)]] + [(0, 80, None, 40), (0, 81, 3, None), (9, 1, 5, 6)]
    marks = [(p, y, 100 * p + y) for p in range(5) for y in rng.sample(range(20, 60), 6)] + [(1, None, 7), (2, 1, None)]

    def last(p, at):
        above = [(y, r) for q, y, r in marks if q == p and at is not None and y is not None and r is not None and y <= at]
        return max(above)[1] if above else None

    found = match.bind_regions(spark.createDataFrame(items, "page int, box_id int, y0 int, y1 int"), spark.createDataFrame(marks, "page int, y int, region int"))
    want = [(p, i, r if (r := last(p, y0)) is not None else last(p, y1)) for p, i, y0, y1 in items]
    assert sorted(map(str, found.select("page", "box_id", "region").collect())) == sorted(f"Row(page={p}, box_id={i}, region={r})" for p, i, r in want)
    assert planned(found, "Union") == 1


def test_edges_meet_in_one_join(spark):
    rows, df = shared_boxes(spark, random.Random(13))
    want = [(a[0], a[1], b[1], side) for a, b in itertools.permutations(rows, 2) if a[0] == b[0] for side, met in (("right", a[4] == b[2] and a[3] < b[5] and b[3] < a[5]), ("below", a[5] == b[3] and a[2] < b[4] and b[2] < a[4])) if met]
    found = match.adjacent(df)
    assert got(found, "page", "first", "second", "side") == sorted(want) and len(want) > 100
    assert planned(found, "SortMergeJoin") + planned(found, "BroadcastHashJoin") == 1


def test_clusters_are_classified_without_copies_of_their_members(spark):
    rows, df = shared_boxes(spark, random.Random(14))
    members = df.where("page IS NOT NULL").withColumn("cluster", F.col("box_id") % 4).withColumn("kind", F.when(F.col("box_id") % 2 == 0, "word").otherwise("stroke"))
    found = layout.classify_clusters(members, ["page", "cluster"])
    assert planned(found, "Expand") == 0 and planned(found, "Exchange") == 2  # one of them deals the lines of this test
    grids = {(r["page"], r["cluster"]): r["grid"] for r in found.collect()}
    sizes = {k: f"{len({b[3] for b in own})}x{len({b[2] for b in own})}" for k in grids for own in [[b for b in rows if (b[0], b[1] % 4) == k]]}
    assert len(grids) == 24 and all(g in ("", sizes[k]) for k, g in grids.items() if k != (0, 3))


def test_points_are_dealt_by_question_once(spark, sf_dir):
    sections = score.rebalance(views.sections(spark, sf_dir))
    steps = sections.where("qid % 2 = 0").withColumn("step", F.lit(1)).select("qid", "sec", "step", F.col("rubric_pct").alias("pct"))
    assert planned(sections, "Exchange") == 1
    found = score.rebalance_rubric(sections, steps)
    assert found.schema["sec"] == steps.schema["sec"] and found.count() == steps.count()
    assert planned(found, "Exchange") == 2 and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_marker_sequence(spark):
    rows = [(1, 0, 1, 2), (1, 1, 1, 1), (1, 1, 2, 7), (1, 2, 1, 2), (1, 3, 1, 3)]
    df = spark.createDataFrame(rows, "doc int, page int, y int, number int")
    assert got(layout.marker_sequence(df), "start", "numbers") == [(0, "1,2,3")] or got(layout.marker_sequence(df), "numbers") == [("1,2,3",)]


def test_clusters_follow_chains(spark):
    boxes = [(1, i, 10 * i, 0, 10 * i + 8, 5) for i in range(1, 30)] + [(1, 99, 900, 900, 905, 905)]
    df = spark.createDataFrame(boxes, "page int, box_id int, x0 int, y0 int, x1 int, y1 int")
    assert {r[0] for r in layout.clusters(df, 3).select("cluster").distinct().collect()} == {1, 99}


@pytest.mark.parametrize("most", [500_000, 20, 3])
def test_clusters_of_any_page_size_equal_a_search_of_the_graph(spark, most):
    rng = random.Random(5)
    boxes = [(page, i, x, y, x + rng.randint(1, 12), y + rng.randint(1, 12)) for page in range(1, 5) for i in range(60 * page) for x, y in [(rng.randint(0, 300), rng.randint(0, 300))]]
    boxes += [(9, i, 7 * i, 0, 7 * i + 5, 5) for i in random.Random(6).sample(range(400), 400)]
    want = {}
    for page in {b[0] for b in boxes}:
        own = [b for b in boxes if b[0] == page]
        near = {a[1]: [b[1] for b in own if a[2] <= b[4] + 3 and b[2] <= a[4] + 3 and a[3] <= b[5] + 3 and b[3] <= a[5] + 3] for a in own}
        for start in sorted(near):
            todo = [start]
            while todo:
                if (page, (at := todo.pop())) not in want:
                    want[page, at] = start
                    todo += near[at]
    df = spark.createDataFrame([*boxes, (None, 1, 0, 0, 1, 1)], "page int, box_id int, x0 int, y0 int, x1 int, y1 int").repartition(3)
    found = layout.clusters(df, 3, most=most)
    assert got(found.where("page IS NOT NULL"), "page", "box_id", "cluster") == sorted((p, i, c) for (p, i), c in want.items())
    assert got(found.where("page IS NULL"), "cluster") == [(1,)]


def test_series_break_at_undefined_samples(spark):
    df = spark.createDataFrame([(1, x, y) for x, y in enumerate([1.0, 2.0, 3.0, None, 4.0, 5.0, 6.0, 100.0])], "sid int, x int, y double")
    assert got(series.branches(df, "sid", 50), "begin", "end") == [(0, 2), (4, 6)]
    signs = spark.createDataFrame([(1, x, y) for x, y in enumerate([1.0, -1.0, None, 1.0, 0.0, 2.0])], "sid int, x int, y double")
    assert got(series.crossings(signs), "x") == [(0.5,), (4.0,)]


def test_histogram_bins_must_rise(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 11.0)], "k int, v double")
    assert got(series.histogram(df, "k", "v", [0, 5, 10]), "bin", "n") == [(0, 1), (1, 1)]
    with pytest.raises(ValueError):
        series.histogram(df, "k", "v", [0, 0])


def test_delta_counts_repeats(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert got(tables.delta(a, b, "k"), "k", "class") == [(1, "REMOVED"), (2, "UNCHANGED"), (3, "ADDED")]


def test_page_ranges(spark):
    df = spark.range(20)
    assert [r[0] for r in pages.select_ranges(df, "id", "4-6, 10").orderBy("id").collect()] == [4, 5, 6, 10]
    for bad in ("", "a-b"):
        with pytest.raises(ValueError):
            pages.select_ranges(df, "id", bad)


def test_upsert_and_approval(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert got(incremental.upsert(a, b, "k"), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert got(incremental.upsert(a, b, "k", a.where("k = 2")), "k", "v") == [(1, "a"), (2, "c")]
    versions = [(1, 1, "f", False), (1, 2, "f", True), (1, 3, "g", False), (1, 4, "f", False)]
    df = spark.createDataFrame(versions, "item int, seq int, fp string, approved boolean").withColumns({"critical": F.lit(False), "missing": F.lit(False)})
    assert got(incremental.approval_state(df), "seq", "state") == [(1, "pending"), (2, "approved"), (3, "stale"), (4, "approved")]


def test_admission_frees_a_place_when_the_window_has_passed(spark):
    at = [0, 1, 2, 9, 10, 11]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "client long, rid long, t int").select("client", "rid", F.timestamp_seconds("t").alias("ts"))
    assert got(quota.admit(df, 2, 10), "rid", "accepted", "wait") == [(0, True, 0), (1, True, 0), (2, False, 8_000_000), (3, False, 1_000_000), (4, True, 0), (5, True, 0)]


def streamed(spark, base, batches, schema, plan):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{i}")
        time.sleep(0.01)
    stream = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{base}/in"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def test_a_stream_in_any_order_is_judged_as_the_batch_is(spark, tmp_path):
    """2,000 requests of few clients in frames of 50 rows and four batches, up to five minutes out of order, one too late."""
    rng, start = random.Random(4), datetime.datetime(2024, 1, 1)
    rows = [(rng.randrange(3), i, start + datetime.timedelta(seconds=i * 7 + rng.random())) for i in range(2000)]
    order = sorted(rows, key=lambda r: r[2] + datetime.timedelta(seconds=rng.random() * 300))
    batches = [order[i : i + 500] for i in range(0, 2000, 500)]
    late = (0, 9999, start)
    schema = "client long, rid long, ts timestamp"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = got(streamed(spark, tmp_path / "a", [*batches[:3], [*batches[3], late]], schema, lambda s: quota.admit_stream(s, 5, 120)), "rid", "accepted", "wait")
        firsts = got(streamed(spark, tmp_path / "b", batches, schema, lambda s: quota.dedupe_stream(s, ["client"], 600)), "client", "rid")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    closed = max(r[2] for r in rows) - datetime.timedelta(minutes=10)
    past = {r[1] for r in rows if r[2] < closed}
    whole = spark.createDataFrame(rows, schema)
    assert found == [r for r in got(quota.admit(whole, 5, 120), "rid", "accepted", "wait") if r[0] in past]
    assert firsts == [r for r in got(quota.dedupe_stream(whole, ["client"], 600), "client", "rid") if r[1] in past] and len(firsts) > 30


def test_a_stream_deals_keys_of_any_kind_to_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quota, "BUCKETS", 3)
    rng, start = random.Random(8), datetime.datetime(2024, 5, 1)
    rows = sorted(((rng.choice(['a"b', "", None, "\u05d0"]) if i % 2 else f"c{i % 90}", start + datetime.timedelta(microseconds=rng.randrange(10**10)), i) for i in range(600)), key=lambda r: r[1])
    schema = "client string, ts timestamp, rid long"
    stream = streamed(spark, tmp_path / "b", [rows[i : i + 200] for i in range(0, 600, 200)], schema, lambda s: quota.dedupe_stream(s, ["client"], 900))
    past = {r[2] for r in rows if r[1] < rows[-1][1] - datetime.timedelta(minutes=10)}
    whole = quota.dedupe_stream(spark.createDataFrame(rows, schema), ["client"], 900)
    assert got(stream.fillna("none"), "client", "rid") == [r for r in got(whole.fillna("none"), "client", "rid") if r[1] in past]
    plan = quota.admit_stream(spark.readStream.schema("client long, rid long, ts timestamp").parquet(str(tmp_path)), 5, 60)
    assert "AS bucket" in plan._jdf.queryExecution().analyzed().toString()


def page_lines(spark, base, name, pages):
    rows = [(json.dumps({"page_id": i, "page_type": "question", "blocks": [{"kind": "paragraph", "lines": [[{"type": "text", "value": v}]]} for v in values]}),) for i, values in pages]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(f"{base}/{name}")


def test_two_contents_of_a_page_keep_their_own_keys_and_failures_repeat_nothing(spark, tmp_path, monkeypatch):
    from quire.streaming import ingest

    page_lines(spark, tmp_path, "in", [(1, ["a", "b"]), (1, ["c"]), (2, []), (3, ["d"])])
    real, calls = ingest.commit, []

    def failing(keys, results, name):
        calls.append(name)
        if len(calls) == 1:
            raise RuntimeError("lost between write and commit")
        real(keys, results, name)

    monkeypatch.setattr(ingest, "commit", failing)
    run = lambda state: ingest.ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/{state}").awaitTermination()
    with pytest.raises(Exception, match="lost between"):
        run("first")
    assert ingest.committed(spark, f"{tmp_path}/out").count() == 0
    run("first")
    want = [(1, "a"), (1, "b"), (1, "c"), (3, "d")]
    found = ingest.committed(spark, f"{tmp_path}/out")
    assert got(found, "page_id", "value") == want and found.where("page_id = 1").select("work_key").distinct().count() == 2
    page_lines(spark, tmp_path, "in", [(3, ["d"]), (2, []), (4, ["e"])])
    run("second")  # another checkpoint reads all again
    assert got(ingest.committed(spark, f"{tmp_path}/out"), "page_id", "value") == [*want, (4, "e")]
    assert spark.read.parquet(f"{tmp_path}/out/manifest").where("page_id = 2").count() == 1


def test_alignment_has_the_most_common_words_and_long_gaps_end(spark):
    rng = random.Random(8)
    for n in (0, 1, 3, 40, 90):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, n))] for _ in range(2))
        rows = [0] * (len(b) + 1)
        for x in a:
            rows = [0, *itertools.accumulate(range(len(b)), lambda best, j, x=x, rows=rows: max(best, rows[j + 1], rows[j] + 1 if x == b[j] else 0), initial=0)][1:]
        pairs = alignment.matches(a, b)
        assert len(pairs) == rows[-1] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        at, rebuilt = 0, []
        for _, i, j, k, m in alignment.script(a, b):
            rebuilt += a[at:i] + b[k:m]
            at = j
        assert rebuilt + a[at:] == b
    words = [rng.choice("abcdefgh") for _ in range(20_000)]  # no word is unique: one gap
    other = [w for i, w in enumerate(words) if i % 1000] + ["z"]
    frames = [spark.createDataFrame([(1, i, w) for i, w in enumerate(x)], "d long, pos int, tok string") for x in (words, other)]
    began = time.perf_counter()
    ops = sorted(tuple(r)[2:] for r in text.aligned_diff(*frames, "d").collect())
    rows = text.compare_readings(*frames, "d").collect()
    assert time.perf_counter() - began < 60 and sum(j - i for i, j, _, _ in ops) == 20 and len(rows) == 2


def test_alignment_goes_down_into_gaps(spark):
    """Words that are unique within a gap only align it in the second round."""
    a = "x q1 x q1 m y q1 z y".split()
    b = "x x q1 m y z q1 y".split()
    frames = [spark.createDataFrame([(k, i, w) for k in (1, 2) for i, w in enumerate(x)] + more, "d long, pos int, tok string") for x, more in ((a, [(3, 0, "only")]), (b, [(4, 0, "other")]))]
    rows = text.aligned_diff(*frames, "d").collect()
    for d in (1, 2):
        at, rebuilt = 0, []
        for r in sorted((r for r in rows if r["d"] == d), key=lambda r: r["from_b"]):
            rebuilt += a[at : r["from_a"]] + b[r["from_b"] : r["to_b"]]
            at = r["to_a"]
        assert rebuilt + a[at:] == b
    assert {(r["d"], r["op"]) for r in rows if r["d"] > 2} == {(3, "delete"), (4, "insert")}


def test_alignment_takes_one_round_for_small_gaps_and_no_group_a_gap(spark, monkeypatch):
    rng, steps = random.Random(5), []
    monkeypatch.setattr(text, "stored_checkpoint", lambda df: steps.append(df) or incremental.stored_checkpoint(df))
    sides = {d: ([w for i in range(200) for w in (f"u{i}", rng.choice("xyz"), rng.choice("xyz"))], 0) for d in range(4)}
    sides = {d: (words, [w for w in words if rng.random() < 0.9]) for d, (words, _) in sides.items()}
    frames = [spark.createDataFrame([(d, i, w) for d, both in sides.items() for i, w in enumerate(both[n])], "d long, pos int, tok string") for n in (0, 1)]
    for small, most in ((256, 3), (1, 40)):
        steps.clear()
        diff = text.aligned_diff(*frames, "d", small=small)
        assert len(steps) <= most and "FlatMapGroups" not in diff._jdf.queryExecution().analyzed().toString()
        rows = diff.collect()
        for d, (a, b) in sides.items():
            at, rebuilt = 0, []
            for r in sorted((r for r in rows if r["d"] == d), key=lambda r: (r["from_b"], r["from_a"])):
                rebuilt += a[at : r["from_a"]] + b[r["from_b"] : r["to_b"]]
                at = r["to_a"]
            assert rebuilt + a[at:] == b


def test_readings_are_dealt_by_document_twice(spark):
    frames = [spark.range(200).select(F.lit(1).alias("d"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("w"), F.col("id") % n).alias("tok")) for n in (150, 149)]
    plan = text.compare_readings(*frames, "d")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 2 and "SortMergeJoin" not in plan


def ops_of(a: list, b: list, rounds: int, small: int) -> list[tuple]:
    """What aligned_diff says of two lists of words, a gap at a time."""
    todo, done = [(0, 0, a, b)], []
    for n in range(rounds):
        again = []
        for x, y, p, q in todo:
            pairs = sorted((p.index(w), q.index(w)) for w in p if w is not None and p.count(w) == 1 == q.count(w))
            if n and max(len(p), len(q)) <= small or not pairs:
                done.append((x, y, p, q))
                continue
            kept = [pair for pair, k in zip(pairs, alignment.rising([j for _, j in pairs]), strict=True) if k]
            again += [(x + i + 1, y + j + 1, p[i + 1 : k], q[j + 1 : m]) for (i, j), (k, m) in itertools.pairwise([(-1, -1), *kept, (len(p), len(q))])]
        todo = again
    return sorted((op, x + i, x + j, y + k, y + m) for x, y, p, q in done + todo for op, i, j, k, m in alignment.script(p, q))


def test_alignment_deals_texts_once_and_equals_a_gap_at_a_time(spark, sf_dir, monkeypatch):
    steps, rng, sides = [], random.Random(21), {}
    monkeypatch.setattr(text, "stored_checkpoint", lambda df: steps.append(df) or incremental.stored_checkpoint(df))
    for d in range(60):
        words = [rng.choice("abcdefghij") * rng.choice((1, 1, 2, 3)) for _ in range(rng.choice((0, 1, 5, 30, 90)))]
        other = [w for w in words if rng.random() < 0.9]
        if len(other) > 2:
            other.insert(rng.randrange(len(other)), other.pop(rng.randrange(len(other))))
            words[0] = other[-1] = None
        sides[d] = words, other
    rows = [[(d, i, w) for d, both in sides.items() for i, w in enumerate(both[n])] for n in (0, 1)]
    for side in rows:
        rng.shuffle(side)
    frames = [spark.createDataFrame(side, "d int, pos int, tok string") for side in rows]
    packed = text._sided_runs(*frames, "d")
    for rounds, small, apart, held in ((1, 0, 1 << 28, 1 << 18), (8, 256, 1 << 28, 7), (8, 2, 1 << 28, 500), (3, 0, 9, 1)):
        found: dict = {d: [] for d in sides}
        for d, *op in map(tuple, text.diff_runs(packed, "d", F.col("_a"), F.col("_b"), rounds, small, apart, held).collect()):
            found[d].append(tuple(op))
        assert {d: sorted(ops) for d, ops in found.items()} == {d: ops_of(*both, rounds, small) for d, both in sides.items()}
    steps.clear()
    plans.QUERIES["ud02_aligned_diff"](spark, sf_dir)
    plan = steps[0]._jdf.queryExecution().executedPlan().toString()
    assert len(steps) == 1 and plan.count("Exchange hashpartitioning(") == 1 and "Generate" not in plan and "Join" not in plan


def test_readings_deal_texts_once(spark, sf_dir, monkeypatch):
    steps, rng, a, b = [], random.Random(22), [], []
    monkeypatch.setattr(text, "stored_checkpoint", lambda df: steps.append(df) or incremental.stored_checkpoint(df))
    plan = plans.QUERIES["jn19_compare_readings"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not steps and plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan and "Window" not in plan
    assert "Generate" not in plan[plan.index("Exchange hashpartitioning(") :]
    for d in [None, *range(40)]:
        words = [f"w{i}" if rng.random() < 0.4 else rng.choice("abc") for i in range(40 if d is None else rng.choice((0, 3, 40)))]
        a += [(d, i, w) for i, w in enumerate(words)]
        b += [(d, i, w) for i, w in enumerate(w for w in words if rng.random() < 0.8)]
    frames = [spark.createDataFrame(side, "d int, pos int, tok string") for side in (a, b)]
    few = [got(text.compare_runs(text._sided_runs(*frames, "d"), "d", F.col("_a"), F.col("_b"), 0.7, held).fillna(-1), "d", "from_a", "to_a", "from_b", "to_b", "kind", "text_a", "text_b") for held in (1, 1 << 18)]
    assert few[0] == few[1] and few[0][0][0] == -1
    for d in (-1, *range(40)):
        x, y = ([w for k, _, w in side if (-1 if k is None else k) == d] for side in (a, b))
        at, rebuilt = 0, []
        for _, i, j, k, m, kind, before, after in sorted(r for r in few[0] if r[0] == d and r[5] != "incomplete"):
            assert (" ".join(x[i:j]), " ".join(y[k:m])) == (before, after) and kind == ("missing" if k == m else "extra" if i == j else "number" if re.search("[0-9]", before + after) else "word")
            rebuilt += x[at:i] + y[k:m]
            at = j
        assert rebuilt + x[at:] == y


def test_greedy_matching_goes_to_the_end_of_long_chains(spark):
    n = 10_000
    at = [0.0]
    for i in range(2 * n - 1):
        at.append(at[-1] + 1 - i / (4 * n))  # each gap a little smaller: the last pair is the first to be taken
    a = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate(at[::2])], "k int, pid long, x double, y double")
    b = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate(at[1::2])], "k int, pid long, x double, y double")
    found = match.tolerance_match(a, b, "k", 1.5, 1.0).collect()
    pairs = sorted((round((x - y) ** 2, 9), i, j) for i, x in enumerate(at[::2]) for j in (i - 1, i) if j >= 0 for y in [at[1::2][j]])
    left, right, want = set(), set(), set()
    for _, i, j in pairs:
        if i not in left and j not in right:
            left.add(i), right.add(j), want.add((i, j))
    assert {(r["pid"], r["match_id"]) for r in found if r["status"] in ("matched", "contested")} == want and len(want) > n - 2


def test_block_binding_equals_all_pairs(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(90)] + ["", "Straße 12", "Strasse 12", "aaaa", "aaab"]
    worn = [n[:i] + n[i + 1 :] if n and rng.random() < 0.7 else n for n in names for i in [rng.randrange(max(1, len(n)))]]
    frames = [spark.createDataFrame([(1, x) for x in side], "k int, name string") for side in (names, worn)]
    scored = [(-round(SequenceMatcher(None, x, y, autojunk=False).ratio(), 6), x, y) for x in set(names) for y in set(worn) if x and y and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.75]
    left, right, want = set(), set(), []
    for r, x, y in sorted(scored):
        if x not in left and y not in right:
            left.add(x), right.add(y), want.append((x, y, -r))
    assert got(match.block_bind(*frames, "k"), "name", "other", "ratio") == sorted(want)


def test_nearest_owner_by_grid_equals_all_pairs(spark):
    rng = random.Random(12)
    tokens = [(p, i, rng.random() * 100, rng.random() * 100) for p in (1, 2) for i in range(150)] + [(1, 500, 9000.0, -9000.0), (3, 1, 1.0, 1.0), (4, 1, 5.0, 5.0)]
    segs = [(1, i, rng.choice([1.0, 2.0, 50.0, 90.0]) + rng.random(), rng.random() * 100) for i in range(60)] + [(2, 7, 3.0, 3.0), (2, 8, 3.0, 3.0), (4, 2, 5.0, 5.0)]
    frames = spark.createDataFrame(tokens, "page int, token_id long, x double, y double"), spark.createDataFrame(segs, "page int, seg_id long, x double, y double")
    owner: dict = {}
    for p, i, x, y in tokens:
        near = min((((x - sx) * (x - sx) + (y - sy) * (y - sy), s) for q, s, sx, sy in segs if q == p), default=None)
        if near:
            owner[p, near[1]] = min(owner.get((p, near[1]), (math.inf, 0)), (near[0], i))
    assert got(match.nearest_owner(*frames), "page", "seg_id", "token_id", "d2") == sorted((p, s, i, d) for (p, s), (d, i) in owner.items())
    assert match.nearest_owner(frames[0].limit(0), frames[1]).count() == 0 == match.nearest_owner(frames[0], frames[1].limit(0)).count()
    many = spark.range(10_000).select(F.lit(1).alias("page"), F.col("id").alias("token_id"), (F.rand(1) * 1000).alias("x"), (F.rand(2) * 1000).alias("y"))
    assert match.nearest_owner(many, many.withColumnRenamed("token_id", "seg_id")).where("d2 = 0").count() == 10_000


def test_nearest_owner_takes_as_many_steps_however_far_tokens_are(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(match, "stored_checkpoint", lambda df: steps.append(df) or incremental.stored_checkpoint(df))
    tokens = [(1, i, 3.0 ** i, -(2.0 ** i)) for i in range(30)] + [(2, 1, 1e12, 0.0), (2, 2, 4.0, 7.0), (3, 1, -1e9, 5.0)]
    segs = [(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 900.0, -900.0), (2, 1, 5.0, 5.0), (3, 4, 1e9, 5.0), (3, 5, -1e9, 6.0)]
    frames = spark.createDataFrame(tokens, "page int, token_id long, x double, y double"), spark.createDataFrame(segs, "page int, seg_id long, x double, y double")
    owner: dict = {}
    for p, i, x, y in tokens:
        d, s = min(((x - sx) * (x - sx) + (y - sy) * (y - sy), s) for q, s, sx, sy in segs if q == p)
        owner[p, s] = min(owner.get((p, s), (math.inf, 0)), (d, i))
    assert got(match.nearest_owner(*frames), "page", "seg_id", "token_id", "d2") == sorted((p, s, i, d) for (p, s), (d, i) in owner.items())
    assert len(steps) <= 4


def owners(points: list[tuple]) -> list[tuple]:
    """(page, seg_id, token_id, d2) of points(page, seg, id, x, y), by all pairs; a token without an id comes first."""
    kept: dict = {}
    for p, seg, i, x, y in points:
        if not seg and None not in (p, x, y):
            near = min((((x - sx) * (x - sx) + (y - sy) * (y - sy), s) for q, is_seg, s, sx, sy in points if q == p and is_seg and None not in (s, sx, sy)), default=None)
            if near:
                kept[p, near[1]] = min(kept.get((p, near[1]), (math.inf, 0)), (near[0], -1 if i is None else i))
    return sorted((p, s, i, d) for (p, s), (d, i) in kept.items())


@pytest.mark.parametrize(("kind", "trials"), [("double", 5), ("bigint", 3), ("int", 2), ("decimal(9,3)", 1)])
def test_nearest_owner_deals_pages_once_and_equals_all_pairs(spark, sf_dir, monkeypatch, kind, trials):
    steps, rng = [], random.Random(31)
    monkeypatch.setattr(match, "stored_checkpoint", lambda df: steps.append(df) or incremental.stored_checkpoint(df))
    place = (lambda: float(rng.choice((0, 3, 8, 60)) + rng.random() * 3)) if kind == "double" else (lambda: rng.randint(0, 30))
    points = [(p, rng.random() < 0.3, rng.randrange(40), place(), place()) for p in range(25) for _ in range(rng.choice((1, 2, 10, 40)))]
    points = [*{(p, seg, i): (p, seg, i, x, y) for p, seg, i, x, y in points}.values(), (1, True, 3, place(), place()), (None, True, 1, place(), place()), (None, False, 1, place(), place())]
    points += [(2, True, None, place(), place()), (2, False, None, place(), place()), (3, False, 90, None, place()), (4, True, 0, place(), None)]
    rng.shuffle(points)
    df = spark.createDataFrame(points, f"page int, seg boolean, id bigint, x {'double' if kind == 'double' else 'int'}, y {'double' if kind == 'double' else 'int'}").withColumns({c: F.col(c).cast(kind) for c in "xy"})
    for most, pairs, held in ((1 << 20, 1 << 26, 1 << 17), (1 << 20, 1 << 26, 5), (1 << 20, 100, 30), (11, 1 << 26, 1), (0, 0, 1))[:trials]:
        steps.clear()
        found = match.nearest_of_points(df, "page", most, pairs, held)
        assert got(found.fillna(-1, ["token_id"]), "page", "seg_id", "token_id", "d2") == owners(points) and (len(steps) == 1) == (pairs > 100 and most > 11 and "decimal" not in kind)
        assert dict(found.dtypes)["d2"] == {"decimal(9,3)": "decimal(22,6)"}.get(kind, kind)
    steps.clear()
    plans.QUERIES["jn07_nearest_owner"](spark, sf_dir)
    plan = steps[0]._jdf.queryExecution().executedPlan().toString()
    assert len(steps) == 1 and plan.count("Exchange ") == 1 and "Join" not in plan and "Generate" not in plan


def test_pairs_of_points_are_compared_some_at_a_time():
    rng = random.Random(32)
    points = sorted(((p, rng.random() < 0.5, rng.randrange(30), rng.randrange(9), rng.randrange(9)) for p in range(20) for _ in range(rng.randrange(30))), key=lambda r: r[0])
    page, seg, ids, x, y = (np.array(c) for c in zip(*points, strict=True))
    for most in (1, 7, 1 << 22):
        s, t, d2 = nearest.nearest_points(page, seg, ids, x, y, most)
        assert sorted(zip(page[s].tolist(), ids[s].tolist(), ids[t].tolist(), d2.tolist(), strict=True)) == owners(points)
    none = np.zeros(0, np.int64)
    assert [len(c) for c in nearest.nearest_points(none, none.astype(bool), none, none, none)] == [0, 0, 0]


def test_whole_keys_are_held_some_at_a_time():
    rng = random.Random(33)
    keys = sorted([rng.randrange(30) for _ in range(200)]) + [None] * 5
    for width, most in ((1, 0), (7, 3), (50, 20), (300, 10_000)):
        batches = [pa.record_batch({"k": pa.array(keys[i : i + width], pa.int64())}) for i in range(0, len(keys), width)]
        held = [rows.column("k").to_pylist() for rows in whole_keys(iter([*batches, batches[0].slice(0, 0)]), "k", lambda rows: np.ones(rows.num_rows, np.int64), most)]
        assert sum(held, []) == keys and all(len({*x} & {*y}) == 0 for x, y in itertools.pairwise(held))
        assert all(len(x) > most and len(x) - x.count(x[-1]) <= most for x in held[:-1])


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [("([a-z]+) of ([a-z]+)", " of "), ("(a)bc?d", "b"), ("ab+cde", "cde"), ("x{2}yz", "yz"), (r"a\.b(c|d)", "a.b"), ("ab|cd", ""), ("(?i)abc", ""), (r"\x41bc", ""), (r"\p{Lu}bc", "bc"), (r"[]a]bc", ""), (r"[^a\]]bc", "bc"), (r"\Qa|b\E", ""),
     (r"\bword\b(?=s)", "word"), ("(a[)]b)cd", "cd"), ("", ""), ("(open", ""), ("a*", ""), (r"(?:x)*end$", "end"), (r"a\[b", "a[b")],
)
def test_needed_literals(pattern, literal):
    assert needed_literal(pattern) == literal


def test_excerpts_have_the_matches_of_the_text_and_are_short():
    rng = random.Random(6)
    patterns = ["([a-z]+) of ([a-z]+)", "(a+)b(c|d)", "([a-z]+?) ([a-z]{2,3}) x", "([^a]+) of (b)", r"(\\w+) of (a)", "(?:a) of (b)", "(a) of (b)$", "([a-c-]+)xy(z?)"]
    assert [alphabet(p) is not None for p in patterns] == [True, True, True, False, False, False, False, True]
    held = excerpts(patterns)
    for n in (0, 5, 300):
        for _ in range(100):
            line = "".join(rng.choice(["a", "b", "cd", " of ", " of ", " x", ".", "\n", "xy", "z", "A", "-"]) for _ in range(n))
            met = dict(held(line))
            assert all(re.findall(p, met.get(i, "")) == re.findall(p, line) for i, p in enumerate(patterns))
    assert excerpts(["([a-z]+) of ([a-z]+)"])("None. many words. one of two. " * 3 + "no more") == [(0, " one of two\n one of two\n one of two")]


def test_thousands_of_patterns_equal_trying_each(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5_000)]
    rules = [(w, f"([a-z0-9]+) {w} ([a-z0-9]+)", i % 2 == 0) for i, w in enumerate(words)] + [("any", "(w1[0-9]?)[+](w2[0-9]?)", True), ("any", None, True)]
    texts = [(i, " ".join(rng.choice(words[:: 1 + i % 7]) + rng.choice(["", "", "+w2"]) for _ in range(rng.choice([0, 3, 200])))) for i in range(40)] + [(40, None), (41, "b W1 a w1 c"), (41, "b w0 a"), (41, "a w0 b")]
    want = set()
    for i, t in texts:
        for name, pattern, symmetric in rules:
            for pair in re.findall(pattern, t) if t and pattern else []:
                want.add((i, name, ",".join(sorted(pair) if symmetric else pair)))
    df, patterns = spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(rules, "fact_type string, pattern string, symmetric boolean")
    for block in (20_000, 2_000):
        assert got(text.extract_facts(df, "k", patterns, block), "k", "fact_type", "entities") == sorted(want)
    assert text.extract_facts(df, "k", patterns.where("false")).isEmpty()


def test_broken_pages_are_kept_with_a_reason_at_any_split(spark, tmp_path):
    page_json.register(spark)
    good = [json.dumps({"page_id": i, "other": 1, "blocks": [{"kind": "paragraph", "level": 1, "lines": [[{"type": "text", "value": "é" * i, "bold": None}]]}]}, ensure_ascii=False).encode() for i in range(40)]
    bad = {
        b'{"page_id": 1, "blocks"': "not JSON", b"\xff\xfe": "not UTF-8", b"[1]": "not an object", b"null": "not an object", b"{}": "page_id: missing", b'{"page_id": 1.5}': "page_id: not a bigint", b'{"page_id": true}': "page_id: not a bigint",
        b'{"page_id": 9223372036854775808}': "page_id: not a bigint", b'{"page_id": 1, "blocks": [null, {"level": 3000000000}]}': "blocks[1].level: not a int", b'{"page_id": 1, "blocks": [{"lines": [[5]]}]}': "blocks[0].lines[0][0]: not an object", b"[" * 20_000: "not JSON",
    }
    lines = [*good, *bad]
    random.Random(1).shuffle(lines)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_bytes(b"\n\n".join(lines[:30]) + b"\r\n")
    (tmp_path / "in/b.json").write_bytes(b"\n".join(lines[30:]))
    (tmp_path / "in/c.json").write_bytes(b"")
    (tmp_path / "in/_done").write_bytes(b"no page")
    for split in (1 << 20, 4096, 499):
        found = spark.read.format("page_json").option("split", split).load(str(tmp_path / "in"))
        assert got(found.where("reason IS NULL"), "page_id") == [(i,) for i in range(40)]
        assert got(found.where("reason IS NOT NULL"), "raw", "reason") == sorted((k.decode("utf-8", "replace"), v) for k, v in bad.items())
        assert found.groupBy("file", "at").count().where("count > 1").isEmpty()
        assert got(pages.segments(found), "page_id", "value") == [(i, "é" * i) for i in range(40)]

    def ingest():
        stream = spark.readStream.format("page_json").load(f"file://{tmp_path}/in")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    assert ingest().count() == len(lines)
    (tmp_path / "in/d.json").write_bytes(b'{"page_id": 77}\nbroken')
    assert ingest().count() == len(lines) + 2
    assert {(r["page_id"], r["reason"]) for r in ingest().where("page_id = 77 OR raw = 'broken'").collect()} == {(77, None), (None, "not JSON")}


def test_batches_and_missing_answers(spark):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(20)], "k int, n int, t string")
    seen = got(read_batched(df, "k", "n", "t", lambda texts: {0: str(len(texts))}), "n", "reading")
    assert (0, "18") in seen and (18, "2") in seen and sum(r == "unreadable" for _, r in seen) == 18


def test_batches_stream_through_one_exchange(spark):
    """Keys of 1 to 100 rows in frames of 7, each row with all its columns; a batch never goes over a key's end."""
    rng = random.Random(8)
    rows = [(k, i, f"{k}:{i}", k * i) for k in range(1, 101) for i in range(k)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = read_batched(spark.createDataFrame(rows, "k int, n int, t string, more int"), "k", "n", "t", lambda texts: {i: f"{t} {texts[0]} {len(texts)}" for i, t in enumerate(texts)})
        seen = sorted(tuple(r) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert seen == [(k, i, f"{k}:{i}", k * i, f"{k}:{i} {k}:{i - i % 18} {min(18, k - i + i % 18)}") for k in range(1, 101) for i in range(k)]
    assert "Join" not in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize(
    "expression,value,want",
    [
        (e.number, "7,350", "7350"), (e.number, "7,35", "7.35"), (e.number, "1,234,567.5", "1234567.5"), (e.word, '"It,"', "it"), (e.strip_label, " (3) x", "x"), (e.section_id, " (A). ", "a"),
        (e.points_text, "2.005", "2.01"), (e.points_text, "10", "10"), (e.maths, r"$\frac{1}{2} \cdot x^{2}$", r"\frac12·x^2"), (e.break_markers, "a (2) b", "a\n(2) b"), (e.plain_symbols, r"\alpha{x}", "αx"),
    ],
)
def test_normalisers(spark, expression, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0] == want


def test_best_fragment_equals_brute_force_with_a_run_that_all_have(spark):
    rng = random.Random(17)
    draw = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(i, ["all", "have", "this", "run"] + draw(rng.randrange(0, 14))) for i in range(40)]
    docs = [(d, ["all", "have", "this", "run"] + draw(3)) for d in range(60)]
    for i, words in items[:30]:  # whole items, items cut at the threshold and a little more
        docs += [(len(docs) + k, draw(4) + words[: len(words) - cut] + draw(4)) for k, cut in enumerate((i % 5, i % 7))]
    runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = []
    for i, words in items:
        scored = [(-round(len(runs(words) & runs(w)) / len(runs(words)), 6), d) for d, w in docs]
        want += [(i, d, -s) for s, d in [min(scored)] if -s >= 0.7]
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(w)) for k, w in rows] + [(999, None), (998, ""), (997, "a b")], f"{key} long, text string")
    found = match.best_fragment(frame(items, "item_id"), frame(docs, "doc_id").unionAll(frame(docs[:5], "doc_id")), 3, 0.7)
    assert len(want) > 20 and got(found, "item_id", "doc_id", "score") == want
    assert match.best_fragment(frame(items, "item_id"), frame([], "doc_id"), 3, 0.7).count() == 0
