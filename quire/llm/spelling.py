"""Spelling variants: words one edit apart, joined by asymmetric q-chunks, and the frequent form that a rare one stands for."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import stored

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, FORM_RATIO = 7, 2, 10
#: Counts are longs and grow by the ratio with each step to a form; the pointers double each round.
FORM_ROUNDS = 6


def ascii_lower(text: Column) -> Column:
    """Only A-Z in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def letter_runs(text: Column, least: int = 1) -> Column:
    """Array of the maximal runs of letters of `least` or more, A-Z in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)), ascii_lower)


def _cut(word: Column, begin, length) -> Column:
    return F.substring(word, F.lit(begin) if isinstance(begin, int) else begin, F.lit(length) if isinstance(length, int) else length)


def _keys(word: Column, size: Column, gap: Column) -> Column:
    """The four keys under which a word of `size` code points meets one of `gap` (0 or 1) more: for either half that an edit
    may leave whole, that half and the front or the back of the other half, whichever the edit leaves whole too. The longer
    word's grams stand where the shorter one's chunks do, or `gap` further on."""
    first = F.ceil(size / 2).cast("int")
    second = size - first

    def beside(text: Column, length: Column, part: int, chunk: Column) -> list[Column]:
        front = F.floor(length / 2).cast("int")
        back = length - front
        return [F.xxhash64(size, F.lit(2 * part), chunk, _cut(text, 1, front)), F.xxhash64(size, F.lit(2 * part + 1), chunk, _cut(text, F.length(text) - back + 1, back))]

    rest, head = _cut(word, first + 1, size + gap), _cut(word, 1, first + gap)
    return F.array(*beside(rest, second, 0, _cut(word, 1, first)), *beside(head, first, 1, _cut(word, first + gap + 1, second)))


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words(word, n) that differ by exactly one inserted, deleted or replaced code point, once.

    The shorter word gives two disjoint chunks, its halves, and the other its grams of the same sizes: one edit leaves a
    chunk whole, in place or one further on in the longer word, so only grams at these places are emitted. A key also has
    the front or the back of the other half, one of which the edit leaves whole as well; so a group holds only words that
    are alike in three quarters, however common a beginning or an end is. All are verified by edit distance. A pair is
    kept only under the first of the keys that it shares, so none has to be dropped again. Words shorter than 4 code points
    would have empty chunks; they must not be given. Words must be distinct.
    """
    size = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), size.alias("size_a"), _keys(F.col("word"), size, F.lit(0)).alias("keys_a"))
    same = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), size.alias("size_b"), _keys(F.col("word"), size, F.lit(0)).alias("keys_b"))
    longer = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), size.alias("size_b"), _keys(F.col("word"), size - 1, F.lit(1)).alias("keys_b"))
    chunks = chunks.select("*", F.posexplode("keys_a").alias("at", "key"))
    grams = same.unionAll(longer).select("b", "n_b", "size_b", "keys_b", F.explode("keys_b").alias("key"))
    first = reduce(lambda x, y: x & y, ((F.col("at") <= i) | (F.get("keys_a", F.lit(i)) != F.get("keys_b", F.lit(i))) for i in range(3)))
    once = (F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b"))
    joined = chunks.join(grams, (chunks["key"] == grams["key"]) & once & first & (F.levenshtein("a", "b", 1) == 1))
    return joined.select("a", "n_a", "b", "n_b")


def spelling_forms(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each of words(word, n): how many words are one edit away, the most frequent
    of them (ties: the least in code-point order) if it is `ratio` times as frequent or more, and the word at the end of the
    forms from here. Without such a form, form and form_n are null and root is the word. Null words are left out; words
    must be distinct and have 4 code points or more. Other columns are not read. An empty table gives an empty result.

    Counts grow by the ratio from form to form, so the ways are short and have no loops; they are followed by doubling.
    """
    words = words.select("word", F.col("n").cast("long").alias("n")).where("word is not null")
    pairs = near_words(words)
    ends = (F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("n"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n")) for x, y in ("ab", "ba"))
    both = pairs.select(F.explode(F.array(*ends)).alias("end")).select("end.*")
    better = F.when(F.col("near_n") >= ratio * F.col("n"), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form")))
    best = stored(both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(better).alias("best")), "spelling-near")
    forms = stored(best.where("best is not null").select("word", F.col("best.form").alias("root")), "spelling-forms")
    roots = forms
    for _ in range(FORM_ROUNDS):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    found = words.join(best, "word", "left").join(roots, "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"), F.coalesce("root", "word").alias("root"))


def counted_words(runs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of runs(word): the words of `least_letters` code points or more that occur `least_count` times or more."""
    return runs.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
