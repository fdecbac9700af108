"""The queries of the training-data operators; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import language_model, licenses, media, pieces, ranked_search, set_join, spelling, toxicity
from quire.llm.html_text import main_text
from quire.llm.packing import pack
from quire.llm.shared import fold, stored, table
from quire.llm.simhash import near_duplicates
from quire.llm.sketches import edited_likeness
from quire.llm.substrings import remove_repeats


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are made of the row: <source>/<lang>/<hundred>/<doc_id>.txt, every twentieth being a LICENSE."""
    name = F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat("doc_id", F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100), name)
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files).select("doc_id", "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", "from_path")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.with_scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted")
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = docs.withColumn("pieces", pieces.encode(spark, F.col("text"), F.col("doc_id")))
    decoded = encoded.withColumn("decoded", pieces.decode(spark, F.col("pieces")))
    return decoded.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.size("pieces").cast("long").alias("n_pieces"), F.hex(F.xxhash64("pieces")).alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("lossless"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature"]
    return media.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns, "shard", "offset", "width", "height", "depth")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs.select("doc_id", "text"), fold(F.col("doc_id"), 7) == 2)


TYPO_EVERY = 31


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of letters loses a letter where TYPO_EVERY divides the hash of document and run."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    runs = docs.select("doc_id", F.explode(spelling.letter_runs(F.col("text"), spelling.LEAST_LETTERS)).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary"))
    gone = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
    words = spelling.counted_words(runs.select(F.when(h % TYPO_EVERY == 0, cut).otherwise(F.col("run")).alias("word")))
    found = spelling.spelling_forms(stored(words, "spelling-words"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"))


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_fingerprints": op6_fingerprints,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_media": op8_media,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_spelling": op11_spelling,
    "op12_ranked_search": op12_ranked_search,
    "op13_set_join": op13_set_join,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("'", "''") for x in row)) for i, row in enumerate(licenses.template_texts()))
_TERMS = r"'[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]'"
ORACLES: dict[str, str] = {
    "op4_licenses": rf"""WITH t(i, license, text) AS (VALUES {_TEMPLATES}), tf AS (SELECT i, license, term, count(*) AS n FROM (SELECT i, license, unnest(regexp_extract_all(lower(text), {_TERMS})) AS term FROM t) GROUP BY ALL),
    df AS (SELECT term, ln(((SELECT count(*) FROM t) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term), tw AS (SELECT i, license, term, n * idf AS w FROM tf JOIN df USING (term)),
    tv AS (SELECT i, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY i)) AS w FROM tw),
    d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang, doc_id // 100, CASE WHEN doc_id % 20 = 0 THEN concat('LICENSE.', doc_id) ELSE concat(doc_id, '.txt') END) AS path FROM documents),
    l AS (SELECT doc_id, unnest(range(len(x))) AS line, unnest(x) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS x FROM d)),
    w AS (SELECT doc_id, line, regexp_extract_all(lower(text), {_TERMS}) AS terms FROM l), b AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS block FROM w WHERE len(terms) > 0),
    u AS (SELECT doc_id, 0 AS kind, line AS unit, unnest(terms) AS term FROM b UNION ALL SELECT doc_id, 1, block, unnest(terms) FROM b UNION ALL SELECT doc_id, 2, 0, unnest(terms) FROM b),
    uw AS (SELECT doc_id, kind, unit, term, count(*) * coalesce(max(idf), ln((SELECT count(*) FROM t) + 1) + 1) AS w FROM u LEFT JOIN df USING (term) GROUP BY doc_id, kind, unit, term),
    un AS (SELECT doc_id, kind, unit, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL),
    s AS (SELECT doc_id, license, round(sum(uw.w * tv.w) / max(norm), 9) AS score FROM uw JOIN un USING (doc_id, kind, unit) JOIN tv USING (term) GROUP BY doc_id, kind, unit, i, license),
    o AS (SELECT doc_id, license AS own_license, score FROM s WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
    f AS (SELECT d.doc_id, path, regexp_extract(concat('/', path), '^(.*)/', 1) AS dir, own_license, score FROM d LEFT JOIN o USING (doc_id)),
    a AS (SELECT dir AS above, min(path) AS near, arg_min(own_license, path) AS license FROM f WHERE own_license IS NOT NULL AND doc_id % 20 = 0 GROUP BY dir),
    n AS (SELECT dir, arg_max(near, length(above)) AS near, arg_max(license, length(above)) AS license FROM (SELECT DISTINCT dir FROM f) JOIN a ON dir = above OR starts_with(dir, concat(above, '/')) GROUP BY dir)
    SELECT doc_id, path, own_license, round(score, 6) AS own_score, coalesce(own_license, n.license) AS license, CASE WHEN own_license IS NOT NULL THEN path ELSE n.near END AS from_path FROM f LEFT JOIN n USING (dir)""",
    "op9_substring_dedup": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS j, ws FROM w WHERE len(ws) >= 13), t AS (SELECT doc_id, j, array_to_string(ws[j:j + 12], ' ') AS t FROM s),
    late AS (SELECT doc_id, j FROM (SELECT doc_id, j, min(doc_id) OVER (PARTITION BY t) AS least FROM t) WHERE doc_id > least),
    gone AS (SELECT DISTINCT doc_id, j + k AS p FROM late, (SELECT unnest(range(13)) AS k)), p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op12_ranked_search": rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    n AS (SELECT doc_id, cast(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id), c AS (SELECT count(*) AS docs, cast(sum(n) AS BIGINT) AS words FROM n), m AS (SELECT doc_id, 10 + (90 * n * docs) // words AS m FROM n, c),
    w AS (SELECT term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, docs),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    s AS (SELECT item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
    SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op13_set_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda j: array_to_string(ws[j:j + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)), r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
    SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
}
