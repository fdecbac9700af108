"""Document text: scripts, roles, boilerplate, blocks, markers, clauses, facts, readings and their alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.expressions import maths, number, token_kind
from quire.functions.literals import excerpts
from quire.operators import alignment
from quire.operators.batching import changes, whole_keys
from quire.operators.match import bag_diff
from quire.sources.incremental import stored_checkpoint

# Letters of each script, as ranges of a character class, and those written from right to left.
SCRIPTS = {"latin": "A-Za-z\u00c0-\u024f", "hebrew": "\u0590-\u05ff", "arabic": "\u0600-\u06ff", "cyrillic": "\u0400-\u04ff", "digit": "0-9"}
RIGHT_TO_LEFT = ("hebrew", "arabic")
MARKER = r"^\([0-9]+\)"
DISPLAY = r"^\$\$.*\$\$$"


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def script_profile(docs: DataFrame) -> DataFrame:
    """PRJ-01: (doc_id, lang, characters of each script, dominant, rtl); a tie goes to the first script."""
    counts = docs.select("doc_id", "lang", *(count_matches(F.col("text"), f"[{r}]").cast("long").alias(s) for s, r in SCRIPTS.items()))
    best = F.greatest(*SCRIPTS)
    dominant = reduce(lambda c, s: c.when(F.col(s) == best, s), list(SCRIPTS)[1:], F.when(F.col(list(SCRIPTS)[0]) == best, list(SCRIPTS)[0]))
    named = counts.withColumn("dominant", F.when(best > 0, dominant).otherwise("none"))
    return named.withColumn("rtl", F.col("dominant").isin(*RIGHT_TO_LEFT))


def classify_pages(lines: DataFrame, admin: str) -> DataFrame:
    """PRJ-02: (doc, page, role, reason) of lines(doc, page, line): the first rule that fits the page; what would be a
    continuation before the first question is instructions."""
    features = lines.groupBy("doc", "page").agg(
        F.count("*").alias("n"), F.count_if(F.lower("line").rlike(admin)).alias("admin"), F.count_if(F.col("line").rlike(MARKER)).alias("markers"),
        F.count_if(F.col("line").rlike(DISPLAY)).alias("displays"), F.sum(F.length("line")).alias("chars"),
    )
    rule = (
        F.when(F.col("chars") < 5, "empty:no text").when(F.col("markers") > 0, "question:markers").when(F.col("admin") * 2 >= F.col("n"), "admin:words")
        .when(F.col("displays") * 2 >= F.col("n"), "workspace:formulas").otherwise("continuation:rest")
    )
    first = F.min(F.when(F.col("markers") > 0, F.col("page"))).over(Window.partitionBy("doc"))
    early = F.col("_r").startswith("continuation") & (F.col("page") < F.coalesce(F.col("_first"), F.lit(1 << 30)))
    ruled = features.withColumns({"_r": rule, "_first": first}).withColumn("_r", F.when(early, "instructions:before the first question").otherwise(F.col("_r")))
    return ruled.select("doc", "page", F.substring_index("_r", ":", 1).alias("role"), F.substring_index("_r", ":", -1).alias("reason"))


def in_context(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """PRJ-04: rows whose text matches the pattern."""
    return rows.where(F.col(text).rlike(pattern))


def mask_labels(labels: DataFrame, least: float = 0.8) -> DataFrame:
    """PRJ-05: labels plus shown: "?" where confidence is below `least` or an alternative differs."""
    doubtful = (F.col("confidence") < least) | F.exists("alternatives", lambda a: a != F.col("label"))
    return labels.withColumn("shown", F.when(doubtful, "?").otherwise(F.col("label")))


def boilerplate(lines: DataFrame, group: str, page: str, share: float = 0.5, position: str | None = None, top: float = 0.09, bottom: float = 0.92) -> DataFrame:
    """AG-05: lines plus repeated: whether the line's template, digits as #, is on max(2, share of the group's pages). With a
    position column (0 to 1) only lines near the top and bottom count. Empty lines never do. The count is of pages, so a
    template on every page of a huge group is still one row a page before it is counted."""
    rows = lines.withColumn("_t", F.regexp_replace(F.trim("line"), "[0-9]", "#"))
    counted = rows.where("_t <> ''") if position is None else rows.where((F.col("_t") != "") & ((F.col(position) <= top) | (F.col(position) >= bottom)))
    pages = lines.select(group, page).distinct().groupBy(group).agg(F.count("*").alias("_pages"))
    seen = counted.select(group, "_t", page).distinct().groupBy(group, "_t").agg(F.count("*").alias("_n")).join(pages, group)
    often = seen.where(F.col("_n") >= F.greatest(F.lit(2), share * F.col("_pages"))).select(group, "_t", F.lit(True).alias("repeated"))
    return rows.join(often, [group, "_t"], "left").fillna(False, ["repeated"]).drop("_t")


def text_blocks(lines: DataFrame, key: str, preserve: bool = False) -> DataFrame:
    """WN-02: (key, block, kind, text, ended): lines(key, line_no, line) joined into blocks. A block begins after an empty
    line, at a marker, at a display formula and after one, and where the line before ended a sentence; otherwise the line
    goes on. preserve: every line is a block. ended: the block ends with a mark."""
    by = Window.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("_l", F.trim("line")).withColumn("_p", F.lag("_l").over(by))
    begins = F.col("_p").isNull() | (F.col("_p") == "") | F.col("_l").rlike(MARKER) | F.col("_l").rlike(DISPLAY) | F.col("_p").rlike(DISPLAY) | F.col("_p").rlike(r"[.!?:]$")
    rows = rows.withColumn("_b", F.lit(1) if preserve else begins.cast("int")).withColumn("block", F.sum("_b").over(by)).where("_l <> ''")
    joined = rows.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_l"))), lambda x: x["_l"]), " ").alias("text"))
    kind = F.when(F.col("text").rlike(DISPLAY), "formula").when(F.col("text").rlike(MARKER), "section").otherwise("text")
    return joined.select(key, "block", kind.alias("kind"), "text", F.col("text").rlike(r"[.!?:]$").alias("ended"))


def structure_summary(blocks: DataFrame, key: str) -> DataFrame:
    """AG-13: (key, blocks, sections, formulas, commas, flattened): flattened counts markers inside blocks."""
    inner = count_matches(F.col("text"), r"\([0-9]+\)") - F.col("text").rlike(MARKER).cast("int")
    commas = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))
    counts = [F.count("*").alias("blocks"), F.count_if(F.col("kind") == "section").alias("sections"), F.count_if(F.col("kind") == "formula").alias("formulas")]
    return blocks.groupBy(key).agg(*counts, F.sum(commas).alias("commas"), F.sum(inner).alias("flattened"))


def source_structure(texts: DataFrame, key: str) -> DataFrame:
    """AG-14: (key, markers, distinct_markers, labels): the markers in the source text, labels sorted."""
    found = texts.withColumn("_m", F.regexp_extract_all("text", F.lit(r"\(([0-9]+)\)"), 1))
    return found.select(key, F.size("_m").cast("long").alias("markers"), F.size(F.array_distinct("_m")).cast("long").alias("distinct_markers"), F.array_join(F.array_sort(F.array_distinct("_m")), ",").alias("labels"))


def fidelity_issues(mine: DataFrame, source: DataFrame, key: str, least: int = 2) -> DataFrame:
    """AG-15: (key, issue): sections lost or flattened in a reconstruction, from `least` on."""
    both = mine.join(source, key)
    rules = {"lost_sections": F.col("distinct_markers") - F.col("sections") >= least, "flattened": F.col("flattened") >= least, "no_formulas": (F.col("formulas") == 0) & (F.col("markers") >= least)}
    issues = F.filter(F.array(*(F.when(rule, name) for name, rule in rules.items())), lambda x: x.isNotNull())
    return both.select(key, F.explode(issues).alias("issue"))


def classify_errors(logs: DataFrame, line: str) -> DataFrame:
    """AG-25: logs plus status, per_day, limit, delay and reason of their error lines; the first rule that fits."""
    text = F.lower(line)
    number = lambda pattern: F.regexp_extract(line, pattern, 1).try_cast("long")
    rows = logs.withColumns({"status": number(r"status=([0-9]{3})"), "limit": number(r"limit=([0-9]+)"), "delay": number(r"retry in ([0-9]+)s"), "per_day": text.contains("per day")})
    status = F.col("status")
    reason = (
        F.when((status == 429) & F.col("per_day"), "quota_day").when(status == 429, "quota_minute").when(status.isin(401, 403), "auth").when(status >= 500, "overload")
        .when(text.contains("timeout"), "timeout").when(status == 200, "ok").otherwise("unknown")
    )
    return rows.withColumn("reason", reason)


def fingerprint(rows: DataFrame, key: str, position: str, segment: str, version: str = "v1") -> DataFrame:
    """AG-27: (key, fingerprint): the first 24 hex digits of the SHA-256 of a version and the ordered segments; words that
    aren't segments don't change it."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(position, segment))), lambda x: x[segment])
    return rows.groupBy(key).agg(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(version), ordered), 256), 1, 24).alias("fingerprint"))


def formula_inventory(formulas: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """AG-33: (kind, token, n, known): tokens of all formulas: commands, numbers, letters and signs."""
    tokens = formulas.select(F.explode(F.regexp_extract_all(column, F.lit(r"\\[a-zA-Z]+|[0-9]+|[a-zA-Z]|[^\sa-zA-Z0-9]"), 0)).alias("token"))
    kind = F.when(F.col("token").rlike(r"^\\"), "command").when(F.col("token").rlike("^[0-9]"), "number").when(F.col("token").rlike("^[a-zA-Z]"), "letter").otherwise("sign")
    counts = tokens.groupBy(kind.alias("kind"), "token").agg(F.count("*").alias("n"))
    return counts.join(vocabulary.withColumn("known", F.lit(True)), "token", "left").fillna(False, ["known"]).select("kind", "token", "n", "known")


def punctuation_commas(texts: DataFrame, key: str) -> DataFrame:
    """WN-21: (key, commas, punctuation): all commas and those next to a word, outside maths, coordinates and thousands."""
    masked = reduce(lambda t, p: F.regexp_replace(t, p, " # "), (r"\$[^$]*\$", r"\([0-9., ]+\)", r"[0-9]+(,[0-9]{3})+"), F.col("text"))
    tokens = texts.select(key, F.length("text").alias("_n"), "text", F.posexplode(F.regexp_extract_all(masked, F.lit(r"\p{L}+|,|[^\s,\p{L}]+"), 0)).alias("_pos", "_tok"))
    by = Window.partitionBy(key).orderBy("_pos")
    word = lambda c: F.coalesce(c.rlike(r"^\p{L}{2,}$"), F.lit(False))
    near = tokens.withColumn("_p", (F.col("_tok") == ",") & (word(F.lag("_tok").over(by)) | word(F.lead("_tok").over(by))))
    found = near.groupBy(key).agg(F.count_if("_p").alias("punctuation"))
    every = texts.select(key, (F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))).cast("long").alias("commas"))
    return every.join(found, key, "left").fillna(0, ["punctuation"])


def clauses(texts: DataFrame, key: str, rules: list[tuple[str, str]]) -> DataFrame:
    """WN-25: (key, pos, clause, kind): clauses between sentence ends, with the first rule (kind, pattern) that fits, CLAIM if
    none."""
    parts = texts.select(key, F.posexplode(F.split("text", r"[.;\n]+")).alias("pos", "clause")).withColumn("clause", F.trim("clause")).where("clause <> ''")
    lower = F.lower("clause")
    kind = reduce(lambda c, r: c.when(lower.rlike(r[1]), r[0]), rules[1:], F.when(lower.rlike(rules[0][1]), rules[0][0])).otherwise("CLAIM")
    return parts.withColumn("kind", kind)


def clause_summary(found: DataFrame, key: str) -> DataFrame:
    """WN-25: (key, kind, n, text): the clauses of each kind in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "clause"))), lambda x: x["clause"])
    return found.groupBy(key, "kind").agg(F.count("*").alias("n"), F.array_join(ordered, "; ").alias("text"))


def _rules_met(texts: DataFrame, key: str, rules: list, held: int = 1 << 22) -> DataFrame:
    """(key, rule, excerpt) of texts(key, text): the rules whose literal the text holds, and what of it they can match. Some
    `held` characters at a time are put in order of the rules, so that each pattern is compiled once for them."""
    rule = pa.array([{"fact_type": r["fact_type"], "pattern": r["pattern"], "symmetric": bool(r["symmetric"])} for r in rules], pa.struct([("fact_type", pa.string()), ("pattern", pa.string()), ("symmetric", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met_by = excerpts([r["pattern"] for r in rules])
        for batch in batches:
            found: list[tuple[int, int, str]] = []
            size = 0
            for i, t in enumerate(batch.column("text").to_pylist()):
                for place, excerpt in [] if t is None else met_by(t):
                    found.append((place, i, excerpt))
                    size += len(excerpt)
                if found and (size > held or i == batch.num_rows - 1):
                    found.sort()
                    place, row, excerpt = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), rule.take(pa.array(place)), pa.array(excerpt, pa.string())], names=[key, "rule", "excerpt"])
                    found, size = [], 0

    plain = texts.select(key, F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, f"{key} {dict(plain.dtypes)[key]}, rule struct<fact_type:string,pattern:string,symmetric:boolean>, excerpt string")


def extract_facts(texts: DataFrame, key: str, patterns: DataFrame, block: int = 20_000) -> DataFrame:
    """WN-26: (key, fact_type, entities): all matches of a table of patterns(fact_type, pattern, symmetric). Group 1 is the
    first entity and group 2 the second; one row for each fact whatever its order or repeats.

    Each pattern is reduced to a literal that it cannot match without; one automaton finds those of all patterns in one
    reading of a text, and only the patterns whose literal it holds are tried (one without a sure literal always): on the
    runs of characters around the literal that the pattern can match, if these are sure, and else on the whole text.
    The patterns are a table of rules, which the driver hands to the tasks: `block` of them at a time, the texts being
    read once a block. Null texts and rules without a pattern give nothing; an empty table gives no rows.
    """
    rules = patterns.where("pattern IS NOT NULL").distinct()
    blocks = max(1, -(-rules.count() // block))

    def found(part: int) -> DataFrame:
        met = _rules_met(texts, key, rules.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == part).collect())
        group = lambda n: F.regexp_extract_all("excerpt", F.col("rule.pattern"), F.lit(n))
        pairs = F.array_distinct(F.zip_with(group(1), group(2), lambda a, b: F.array(F.lower(a), F.lower(b))))
        facts = met.select(key, "rule.fact_type", "rule.symmetric", F.explode(pairs).alias("pair"))
        return facts.select(key, "fact_type", F.array_join(F.when(F.col("symmetric"), F.array_sort("pair")).otherwise(F.col("pair")), ",").alias("entities"))

    return reduce(DataFrame.unionAll, map(found, range(blocks))).distinct()


def visible_measures(found: DataFrame, labels: DataFrame, key: str, units: str) -> DataFrame:
    """WN-27: clauses(key, pos, clause) without those that have a unit but no number that labels(key, number) shows."""
    numbers = found.select(key, "pos", F.explode(F.regexp_extract_all("clause", F.lit("[0-9]+"), 0)).alias("number"))
    seen = numbers.join(labels.select(key, "number").distinct(), [key, "number"], "left_semi").select(key, "pos").distinct()
    return found.where(~F.col("clause").rlike(units)).unionByName(found.where(F.col("clause").rlike(units)).join(seen, [key, "pos"], "left_semi"))


def limit_per_group(rows: DataFrame, key: str, order: str, message: str, n: int) -> DataFrame:
    """WN-22: (key, place, message): the first n messages of each key, then one "and M more"."""
    by = Window.partitionBy(key)
    placed = rows.select(key, F.row_number().over(by.orderBy(order)).alias("place"), F.count("*").over(by).alias("_n"), F.col(message).alias("_m")).where(F.col("place") <= n + 1)
    return placed.select(key, "place", F.when(F.col("place") <= n, F.col("_m")).otherwise(F.concat(F.lit("and "), F.col("_n") - n, F.lit(" more"))).alias("message"))


def question_span(lines: DataFrame, key: str, least: float = 0.4) -> DataFrame:
    """WN-09: lines(key, line_no, words, matched, atoms, shared) between the first and the last anchor, a line of which
    `least` of the words match. A line without words stays unless it has atoms of which none is shared."""
    anchor = (F.col("words") > 0) & (F.col("matched") >= least * F.col("words"))
    by = Window.partitionBy(key)
    rows = lines.withColumns({"_a": F.min(F.when(anchor, F.col("line_no"))).over(by), "_b": F.max(F.when(anchor, F.col("line_no"))).over(by)})
    kept = F.col("line_no").between(F.col("_a"), F.col("_b")) & ~((F.col("words") == 0) & (F.col("atoms") > 0) & (F.col("shared") == 0))
    return rows.where(kept).drop("_a", "_b")


def _unique(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    return rows.groupBy(*by, "tok").agg(F.count("*").alias("_n"), F.min("pos").alias(name)).where("_n = 1").drop("_n")


def anchors(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Words that are unique in both of a and b(key..., pos, tok), as pairs of positions in rising order of both: the longest
    such row of a document, so that a word that has moved costs itself and no other."""
    return _rising(_unique(a, [*key], "pos_a").join(_unique(b, [*key], "pos_b"), [*key, "tok"]), *key)


def _rising(pairs: DataFrame, *key: str) -> DataFrame:
    rows = pairs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos_a", "pos_b", "tok"))).alias("p"))
    kept = rows.select(*key, F.explode(F.arrays_zip("p", F.arrow_udf(alignment.rising_lists, "array<boolean>")(F.transform("p", lambda x: x["pos_b"].cast("long"))).alias("k"))).alias("z")).where("z.k")
    return kept.select(*key, "z.p.tok", "z.p.pos_a", "z.p.pos_b")


def _sided_runs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, pos, _a, _b) of readings a and b(key, pos, tok): runs of words of either, null in the other's column."""
    runs = (_packed(x.withColumn("line_no", F.lit(0)), key) for x in (a, b))
    columns = (("toks", None), (None, "toks"))
    return reduce(DataFrame.unionAll, (x.select(key, "pos", *((F.col(c) if c else F.lit(None).cast("array<string>")).alias(n) for c, n in zip(own, ("_a", "_b"), strict=True))) for x, own in zip(runs, columns, strict=True)))


def _dealt_readings(rows: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key).select(key, F.col("pos").cast("long").alias("pos"), a.alias("_a"), b.alias("_b"))


def _words_of_readings(batches: Iterator[pa.RecordBatch], key: str, held_words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Of rows(key, pos, _a, _b) sorted by key, some whole documents at a time: their keys, and of each word the document's number,
    whether it is the second reading's, its position and the word."""
    size = lambda toks: toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for rows in whole_keys(batches, key, lambda batch: size(batch.column("_a")) + size(batch.column("_b")), held_words):
        begins = np.append(0, changes(rows.column(key)))
        number, pos = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, rows.num_rows))), rows.column("pos").to_numpy(zero_copy_only=False)
        of = [np.repeat(np.arange(rows.num_rows), size(rows.column(c))) for c in ("_a", "_b")]
        at = [pos[o] + np.arange(len(o)) - (np.cumsum(n) - n)[o] for o, n in zip(of, (size(rows.column(c)) for c in ("_a", "_b")), strict=True)]
        tok = pa.concat_arrays([rows.column(c).flatten() for c in ("_a", "_b")])
        yield rows.column(key).take(pa.array(begins)), number[np.concatenate(of)], np.repeat([False, True], [len(o) for o in of]), np.concatenate(at), tok


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def compare_readings(a: DataFrame, b: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """JN-19, fast path: (key, from_a, to_a, from_b, to_b, kind, text_a, text_b): where the readings a and b(key, pos, tok)
    differ between anchors, common words at either end of a gap taken off.

    kind: unreadable ([?] in b), missing (only in a), extra (only in b), formula (a formula on either side; formulas are
    compared in one spelling), number (digits on either side) or word. A document of which the second reading has less
    than `least` of the words has one row more, incomplete. A document that one reading lacks altogether is missing or
    extra as a whole.
    """
    return compare_runs(_sided_runs(a, b, key), key, F.col("_a"), F.col("_b"), least)


def compare_runs(rows: DataFrame, key: str, a: Column, b: Column, least: float = 0.7, held_words: int = 1 << 18) -> DataFrame:
    """JN-19: compare_readings of runs of words: a row(key, pos, ...) has words of either reading, a and b, from pos on. Rows are
    dealt by document once and stay there; a and b are cut after that, as a text is smaller than its words. There is no row
    for each word: documents stream through, some `held_words` at a time, and those that differ go on as one row each."""
    dealt = _dealt_readings(rows, key, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, doc, second, pos, tok in _words_of_readings(batches, key, held_words):
            words = tok.dictionary_encode()
            found = alignment.gaps(doc, second, pos, words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
            lists = [_lists(words.dictionary.take(pa.array(c, mask=c < 0)), n) for c, n in zip(found.code, found.size, strict=True)]
            gaps = pa.StructArray.from_arrays([*map(pa.array, found.start), *lists], names=["s_a", "s_b", "wa", "wb"])
            of = np.arange(len(keys)) if least > 1 else np.unique(found.doc)
            every = np.bincount(doc[~second], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(every[of]), _lists(gaps, np.bincount(found.doc, minlength=len(keys))[of])], names=[key, "all", "gaps"])

    one_spelling = lambda t: F.when(token_kind(t) == "M", maths(t)).otherwise(t)
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
    front = lambda x, y, n: F.when(same(F.slice(x, 1, n), F.slice(y, 1, n)) > 0, same(F.slice(x, 1, n), F.slice(y, 1, n)) - 1).otherwise(n).cast("int")
    said = lambda w: F.array_join(w, " ")
    size = lambda g: (F.size(g["wa"]), F.size(g["wb"]))

    def spelled(g: Column) -> Column:
        return F.struct(g["s_a"], g["s_b"], g["wa"], g["wb"], *(F.transform(g[w], one_spelling).alias(n) for w, n in (("wa", "na"), ("wb", "nb"))))

    def at_front(g: Column) -> Column:
        return F.struct(*(g[c] for c in ("s_a", "s_b", "wa", "wb", "na", "nb")), front(g["na"], g["nb"], F.least(*size(g))).alias("f"))

    def at_back(g: Column) -> Column:
        back = front(F.reverse(g["na"]), F.reverse(g["nb"]), F.least(*size(g)) - g["f"])
        return F.struct(*(g[c] for c in ("s_a", "s_b", "wa", "wb", "f")), back.alias("b"))

    def cut(g: Column) -> Column:
        words = (F.slice(g[w], g["f"] + 1, n - g["f"] - g["b"]).alias(w) for w, n in zip(("wa", "wb"), size(g), strict=True))
        return F.struct((g["s_a"] + g["f"]).alias("from_a"), (g["s_b"] + g["f"]).alias("from_b"), *words)

    def joined(g: Column) -> Column:
        return F.struct(*(g[c] for c in ("from_a", "from_b", "wa", "wb")), said(g["wa"]).alias("text_a"), said(g["wb"]).alias("text_b"))

    def row(g: Column) -> Column:
        digits = g["text_a"].rlike("[0-9]") | g["text_b"].rlike("[0-9]")
        has_formula = reduce(lambda x, y: x | y, (F.exists(g[w], lambda t: token_kind(t) == "M") for w in ("wa", "wb")))
        kind = (
            F.when(F.contains(g["text_b"], F.lit("[?]")), "unreadable").when(F.size(g["wb"]) == 0, "missing").when(F.size(g["wa"]) == 0, "extra")
            .when(has_formula, "formula").when(digits, "number").otherwise("word")
        )
        to = [(g[f"from_{x}"] + F.size(g[f"w{x}"])).alias(f"to_{x}") for x in "ab"]
        return F.struct(g["from_a"], to[0], g["from_b"], to[1], kind.alias("kind"), g["text_a"], g["text_b"]).cast(_GAP)

    found = dealt.mapInArrow(run, f"{key} {dict(dealt.dtypes)[key]}, all long, gaps array<struct<s_a:long,s_b:long,wa:array<string>,wb:array<string>>>")
    rows_of = reduce(F.transform, (spelled, at_front, at_back, cut, joined, row), F.col("gaps"))
    found = found.select(key, "all", F.filter(rows_of, lambda r: (r["to_a"] > r["from_a"]) | (r["to_b"] > r["from_b"])).alias("rows"))
    wrong = F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + r["to_a"] - r["from_a"])
    whole = F.struct(F.lit(0), F.col("all"), F.lit(0), F.lit(0), F.lit("incomplete"), F.lit(""), F.lit("")).cast(_GAP)
    few = F.when(F.col("all") - wrong < least * F.col("all"), F.array(whole)).otherwise(F.array().cast(f"array<{_GAP}>"))
    return found.select(key, F.explode(F.concat("rows", few)).alias("r")).select(key, "r.*")


_GAP = "struct<from_a:int,to_a:int,from_b:int,to_b:int,kind:string,text_a:string,text_b:string>"


def number_pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JN-19: (key, place, number_a, number_b): the numbers of lines a and b(key, line_no, line), formulas included, that
    only one reading has, repeats counted, those of a paired with those of b in reading order."""

    def numbers(rows: DataFrame) -> DataFrame:
        found = F.regexp_extract_all(F.replace("line", F.lit("{,}"), F.lit(",")), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), 0)
        return rows.select(key, "line_no", F.posexplode(F.transform(found, number)).alias("at", "number"))

    def left_over(rows: DataFrame, other: DataFrame, name: str) -> DataFrame:
        nth = numbers(rows).withColumn("_n", F.row_number().over(Window.partitionBy(key, "number").orderBy("line_no", "at")))
        counts = numbers(other).groupBy(key, "number").agg(F.count("*").alias("_has"))
        only = nth.join(counts, [key, "number"], "left").where(F.col("_n") > F.coalesce("_has", F.lit(0)))
        return only.select(key, F.row_number().over(Window.partitionBy(key).orderBy("line_no", "at")).alias("place"), F.col("number").alias(name))

    return left_over(a, b, "number_a").join(left_over(b, a, "number_b"), [key, "place"], "full_outer")


def agreement(a: DataFrame, b: DataFrame | None, key: str, n: int = 6, least: float = 0.7) -> DataFrame:
    """(key, recall, status, place, message): the bag difference of two readings a and b(key, tok) by document: the recall of
    a's words, INCOMPLETE below `least`, AGREED or CONFLICTS, and the first n differing words, then one "and M more". The
    bags are counted and joined once; what differs in a document is a list of its different words."""
    diff = bag_diff(a, b, [key, "tok"])
    missing, extra = F.col("missing"), F.col("extra")
    said = F.struct("tok", F.concat_ws(" ", F.when(missing > 0, "missing").otherwise("extra"), "tok", (missing + extra).cast("string")).alias("message"))
    rows = diff.groupBy(key).agg(F.sum("n_a").alias("_all"), F.sum(F.least("n_a", "n_b")).alias("_found"), F.array_sort(F.collect_list(F.when(missing + extra > 0, said))).alias("_said"))
    more = F.when(F.size("_said") > n, F.array(F.concat(F.lit("and "), (F.size("_said") - n).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(key, F.round(F.when(F.col("_all") > 0, F.col("_found") / F.col("_all")), 6).alias("recall"), F.concat(F.transform(F.slice("_said", 1, n), lambda x: x["message"]), more).alias("_m"))
    status = F.when(F.col("recall") < least, "INCOMPLETE").when(F.size("_m") == 0, "AGREED").otherwise("CONFLICTS")
    return rows.select(key, "recall", status.alias("status"), F.posexplode_outer("_m").alias("place", "message")).withColumn("place", F.col("place") + 1)


def aligned_diff(a: DataFrame, b: DataFrame, key: str, rounds: int = 8, small: int = 256) -> DataFrame:
    """UD-02, the exact path of JN-19: (key, op, from_a, to_a, from_b, to_b), where the readings a and b(key, pos, tok) differ
    (pos from 0, without gaps): replace, delete or insert.

    Divide and conquer: words unique in both readings of a document are anchors. A gap between anchors with at most `small`
    words on either side, or none on one, goes to an edit script with the most words in common, in linear space; in a larger
    one the words that are unique within it are anchors again, and so on, until a round finds none (or `rounds` are done,
    which bears on the size of the gaps only). A document that one reading lacks is one row.
    """
    return diff_runs(_sided_runs(a, b, key), key, F.col("_a"), F.col("_b"), rounds, small)


def diff_runs(rows: DataFrame, key: str, a: Column, b: Column, rounds: int = 8, small: int = 256, apart: int = 1 << 28, held_words: int = 1 << 18) -> DataFrame:
    """UD-02: aligned_diff of runs of words: a row(key, pos, ...) has words of either reading, a and b, from pos on. Rows are dealt
    by document once; a and b are cut after that, and documents stream through, some `held_words` at a time. What two
    large sides of a gap (`apart`: one's words times the other's) have in common is found where the gap is dealt to, so
    that the large gaps of a document are the work of many tasks."""
    columns, lists = [key, "op", "from_a", "to_a", "from_b", "to_b"], pa.list_(pa.int64())
    schema = f"{key} long, op string, from_a long, to_a long, from_b long, to_b long"

    def listed(out: list[tuple], keys: pa.Array) -> list[pa.Array]:
        of, op, *ends = zip(*out, strict=True) if out else ([],) * 6
        return [keys.take(pa.array(of, pa.int64())), pa.array(op, pa.string()), *(pa.array(x, pa.int64()) for x in ends)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, doc, second, pos, tok in _words_of_readings(batches, key, held_words):
            code = tok.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            found = alignment.gaps(doc, second, pos, code, rounds, small)
            out: list[tuple] = []
            large: list[tuple] = []
            sides: list[tuple] = []
            ends, words = [np.cumsum(n).tolist() for n in found.size], [c.tolist() for c in found.code]
            for k, x, y, n, m, i, j in zip(*(v.tolist() for v in (found.doc, *found.start, *found.size)), *ends, strict=True):
                both = words[0][i - n : i], words[1][j - m : j]
                if n * m > apart:
                    large.append((k, None, x, None, y, None))
                    sides.append(both)
                else:
                    out.extend((k, op, x + f, x + t, y + g, y + u) for op, f, t, g, u in alignment.script(*both))
            yield pa.RecordBatch.from_arrays([*listed(out, keys), *(pa.nulls(len(out), lists) for _ in "ab")], names=[*columns, "wa", "wb"])
            if large:
                yield pa.RecordBatch.from_arrays([*listed(large, keys), *(pa.array(x, lists) for x in zip(*sides, strict=True))], names=[*columns, "wa", "wb"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (x, y) in enumerate(zip(batch.column("from_a").to_pylist(), batch.column("from_b").to_pylist(), strict=True)):
                ops = alignment.script(batch.column("wa")[i].as_py(), batch.column("wb")[i].as_py())
                yield pa.RecordBatch.from_arrays(listed([(i, op, x + f, x + t, y + g, y + u) for op, f, t, g, u in ops], batch.column(key)), names=columns)

    dealt = _dealt_readings(rows.withColumn(key, F.col(key).cast("long")), key, a, b)
    found = stored_checkpoint(dealt.mapInArrow(run, f"{schema}, wa array<long>, wb array<long>"))
    large = found.where("op IS NULL").repartition(key, "from_a", "from_b")
    return found.where("op IS NOT NULL").select(*columns).unionAll(large.mapInArrow(rest, schema))


def runs_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_no, pos, toks): rows(key, line_no, pos, tok) that follow each other on a line, as one row: where they begin
    and their words. What is a run depends on the order that rows come in; none is moved, and those without a key are left out."""
    return _packed(rows.where(F.col(key).isNotNull()), key)


def _packed(rows: DataFrame, key: str) -> DataFrame:
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = np.ones(batch.num_rows, dtype=bool)
                line, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("line_no", "pos"))
                new[1:] = (line[1:] != line[:-1]) | (pos[1:] != pos[:-1] + 1)
                new[changes(batch.column(key))] = True
                begins = np.flatnonzero(new)
                toks = pa.ListArray.from_arrays(pa.array(np.append(begins, batch.num_rows).astype(np.int32)), batch.column("tok"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(begins)) for c in (key, "line_no", "pos")), toks], names=[key, "line_no", "pos", "toks"])

    plain = rows.select(key, *(F.col(c).cast("long").alias(c) for c in ("line_no", "pos")), "tok")
    return plain.mapInArrow(run, f"{key} {kind}, line_no long, pos long, toks array<string>")


def transfer_breaks(target: DataFrame, source: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """JN-20: (key, pos, reversed): where a line of target(key, pos, tok) should break: at an aligned word that begins a line
    of source(key, line_no, pos, tok), if the one before is on another line. A document whose words align for less than
    `least` has none; lines in reverse order are tried too and the better order is taken."""
    found = breaks_of_runs(runs_of(target.withColumn("line_no", F.lit(0)), key), runs_of(source, key), key, least)
    return found.withColumn("pos", F.col("pos").cast(dict(target.dtypes)["pos"]))


def breaks_of_runs(target: DataFrame, source: DataFrame, key: str, least: float = 0.6, held_words: int = 1 << 18, words: Callable[[Column], Column] = lambda toks: toks) -> DataFrame:
    """JN-20: transfer_breaks of the words of runs(key, line_no, pos, toks), of which each has the words of a line from pos on;
    a target has one line. A run without words (or null) has none. Runs are dealt and sorted by document once and streamed, some `held_words` at a time and the words
    of the document that they end in; there is no row for each word. If toks are texts, `words` gives their words: they are
    cut after they are dealt, as text is smaller than its words."""
    sides = (x.where(F.col(key).isNotNull()).select(key, F.lit(own).alias("own"), *(F.col(c).cast("long").alias(c) for c in ("line_no", "pos")), "toks") for own, x in ((True, target), (False, source)))
    rows = reduce(DataFrame.unionAll, sides).repartition(key).sortWithinPartitions(key).withColumn("toks", words(F.col("toks")))

    def judged(runs: pa.RecordBatch) -> pa.RecordBatch:
        number = np.zeros(runs.num_rows, dtype=np.int64)
        number[changes(runs.column(key))] = 1
        sizes = runs.column("toks").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(runs.num_rows), sizes)
        own, line, begin = (runs.column(c).to_numpy(zero_copy_only=False) for c in ("own", "line_no", "pos"))
        pos = begin[of] + np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
        at, turned = alignment.carried_breaks(np.cumsum(number)[of], own[of], line[of], pos, runs.column("toks").flatten(), least)
        return pa.RecordBatch.from_arrays([runs.column(key).take(pa.array(of[at])), pa.array(pos[at]), pa.array(turned)], names=[key, "pos", "reversed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = lambda batch: batch.column("toks").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        yield from map(judged, whole_keys(batches, key, sizes, held_words))

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, pos long, reversed boolean")
