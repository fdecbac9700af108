"""SimHash near-duplicates by meet-in-the-middle ball hashing, and near copies by a prefix-filtered join of shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.shared import Words, bounded_batches, chunked, stored, utf8_rows

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2


def text_fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the shingles of a UTF-8 text; 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    runs = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(x), seed) for x in runs], dtype=np.uint64)
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, code): the fingerprint as a signed long, one row per row of docs (null text: empty, code 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([text_fingerprint(t, words, seed) for t in utf8_rows(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(codes.view(np.int64))], names=["doc_id", "code"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, code long")


def _spread(codes: DataFrame, *keys: str) -> DataFrame:
    """A row becomes dozens: deal them over all partitions first, as few bytes would be joined to a few."""
    return codes.repartition(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ball_links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) among distinct fingerprints `code` that join the same classes as all pairs within radius 1 or 2.

    Each fingerprint emits itself and its 64 one-bit variants. Two fingerprints within 2 bits share a variant, and a
    variant is within one bit of at most 65 distinct fingerprints, so no group is large. In a group every member is
    linked to the least; a final count of differing bits verifies the pair.
    """
    if radius not in (1, 2):
        raise ValueError("variants within half the radius are emitted for a radius of 1 or 2")
    variants = F.concat(F.array("code"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("code").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    balls = _spread(codes, "code").select("code", F.explode(variants).alias("variant"))
    members = balls.groupBy("variant").agg(F.min("code").alias("a"), F.collect_list("code").alias("members")).where(F.size("members") > 1)
    pairs = members.select("a", F.explode("members").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text, ...).

    component_id is the least doc_id reachable by links of at most `radius` differing bits. Null and empty texts have
    fingerprint zero and are linked like any other. Repeated rows give repeated result rows; a row with a null doc_id
    gets the component of its fingerprint and never names one (a component of null ids only is null). Other columns
    are not read. Copies meet as one fingerprint before any link is made.
    """
    each = stored(fingerprints(docs, words, seed), "fingerprints")
    classes = stored(each.groupBy("code").agg(F.min("doc_id").alias("least_id")), "fingerprint-ids")
    roots = connected_components(ball_links(classes.select("code"), radius)).withColumnRenamed("node", "code")
    rooted = stored(classes.join(roots, "code", "left").select("code", "least_id", F.coalesce("root", "code").alias("root")), "fingerprint-classes")
    least = stored(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "fingerprint-least")
    named = rooted.select("code", "root").join(least, "root").select("code", "component_id")
    return each.join(named, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


COPY_WORDS, COPY_SIMILARITY = 5, 0.8
COMMON_SAMPLE, COMMON_SHINGLES = 16, 1 << 17
LIST_ROWS = 1024
_SLACK = 1e-9  # lets rounding add a candidate, never take one away


def _shingle_sets(texts: list[bytes], words: int) -> tuple[list[int], list[np.ndarray]]:
    """Of each text its key and the distinct hashes of its shingles, ascending. Equal sequences of words, letter case
    aside, have equal keys. A text shorter than a shingle is one."""
    texts = [t.lower() for t in texts]
    part = Words(texts)
    h, at = part.hashes(words)
    begin = np.searchsorted(part.row[at], np.arange(len(texts) + 1))
    keys = [xxhash.xxh64_intdigest(b" ".join(t.split()), SEED) for t in texts]
    return keys, [np.unique(h[a:b]) if b > a else np.array([k], dtype=np.uint64) for a, b, k in zip(begin[:-1].tolist(), begin[1:].tolist(), keys, strict=True)]


def _common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample, sorted, and in how many they are: at most COMMON_SHINGLES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_rows(batch.column("text"))
            for i, j in chunked(texts):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_shingle_sets(texts[i:j], words)[1]).view(np.int64))], names=["shingle"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(COMMON_SAMPLE)) == 0).select("text").distinct()
    found = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).toArrow()
    shingle, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def _parities(own: np.ndarray) -> bytes:
    """A bit for each value of the last bits of a hash: whether an odd number of the shingles has it; twice as many bits as
    shingles, in whole powers of two. Bits in which two texts differ are shingles that one of them has alone."""
    size = max(64, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def _maybe_alike(similarity: float):
    """A function of the numbers of shingles and the parities of two texts: false if they differ in more bits than a pair of
    the similarity has shingles of one text alone. The longer bits are folded; so the answer is never wrongly false."""

    def run(n: pa.Array, a: pa.Array, m: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y, most in zip(a.to_pylist(), b.to_pylist(), ((1 - similarity) / (1 + similarity) * (n.to_numpy() + m.to_numpy()) + _SLACK).tolist(), strict=True):
            p, q = (np.unpackbits(np.frombuffer(z, dtype=np.uint8)) for z in (x, y))
            size = min(len(p), len(q))
            p, q = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (p, q))
            out.append(np.count_nonzero(p != q) <= most)
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def _prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, text_key, code, raw, n, parities, prefix): the SimHash and the number of distinct shingles, and so many of the
    rarest that two texts of the similarity share one of them. All texts order the shingles alike: by their number in a sample, then by hash; the
    sample bears on how many candidates there are, not on which pairs are found."""
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, times = common.value
        for batch in batches:
            texts = utf8_rows(batch.column("text"))
            for i, j in chunked(texts):
                keys, sets = _shingle_sets(texts[i:j], words)
                prefixes = []
                for own in sets:
                    if len(shingle):
                        at = np.minimum(np.searchsorted(shingle, own), len(shingle) - 1)
                        own = own[np.argsort(np.where(shingle[at] == own, times[at], 0), kind="stable")]
                    prefixes.append(own[: len(own) - int(np.ceil(similarity * len(own) - _SLACK)) + 1].view(np.int64))
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(np.array([_majority(x) for x in sets], dtype=np.uint64).view(np.int64)), batch.column("raw").slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), pa.array(map(_parities, sets), pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "code", "raw", "n", "parities", "prefix"])

    return docs.mapInArrow(run, "doc_id long, text_key long, code long, raw long, n long, parities binary, prefix array<long>")


def _resemblance(words: int):
    """A function of two columns of texts: the share of the union's distinct shingles that both have."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs, out = list(zip(utf8_rows(a), utf8_rows(b), strict=True)), []
        for i, j in chunked([x + y for x, y in pairs]):
            each = list({t: None for pair in pairs[i:j] for t in pair})
            own = dict(zip(each, _shingle_sets(each, words)[1], strict=True))
            for x, y in pairs[i:j]:
                both = len(np.intersect1d(own[x], own[y], assume_unique=True))
                out.append(both / (len(own[x]) + len(own[y]) - both))
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes(id, code) that join the same classes as all pairs of fingerprints within RADIUS bits."""
    codes = stored(nodes.groupBy("code").agg(F.min("id").alias("first")), "copy-fingerprints")
    same = nodes.select("id", "code").join(codes, "code").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    a, b = (codes.select(F.col("code").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab")
    balls = ball_links(codes.select("code")).join(a, "a").join(b, "b")
    return same.unionAll(balls.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def near_copies(docs: DataFrame, words: int = COPY_WORDS, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row of docs(doc_id, text): the components of all pairs of texts whose sets of
    shingles of `words` words have a Jaccard resemblance of `similarity` or more.

    SimHash comes first: texts whose fingerprints of these shingles are within RADIUS bits meet by ball hashing, and an
    exact check of both texts decides. Most pairs of the resemblance differ in more bits; those are found by prefixes,
    exactly and at any size: a text is listed under the rarest of its shingles, so many that such a pair has one
    in common. All of a pair's common shingles come no earlier in either text than the first of them does, so a list
    proposes a pair only if what is left of both texts from its shingle on is enough for the resemblance: the rare
    shingles that each has alone rule out mere relatives before a row is made. The members of a list are compared with
    the text that has the least before the shingle; then all proposed pairs that are still in different components are
    compared: first bits of both, which rule out most pairs and never one of the resemblance, then both whole texts. So
    each pair of the resemblance is compared or already joined. A list is joined in blocks of about LIST_ROWS texts, each
    with the texts of the list whose numbers of shingles are in the same band or the next, so no task has a whole list.
    Exact copies are one node. component_id is the least doc_id reachable; nulls and repeated rows are treated as in
    near_duplicates.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("raw"))
    each = stored(_prefixes(docs, words, similarity), "copy-prefixes")
    nodes = stored(each.groupBy(F.col("text_key").alias("id")).agg(F.min("doc_id").alias("least_id"), F.min("raw").alias("raw"), F.first("code").alias("code"), F.first("n").alias("n"), F.first("parities").alias("parities"), F.first("prefix").alias("prefix")), "copy-nodes")
    listed = nodes.select("id", "n", F.posexplode("prefix").alias("at", "shingle")).select("id", "shingle", "n", (F.col("n") - F.col("at")).alias("left"))
    shared = listed.groupBy("shingle").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("shingle")
    members = stored(listed.join(shared, "shingle"), "copy-members")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("parities").alias(f"parities_{x}")) for x in "ab")
        pairs = stored(pairs.join(a, "a").join(b, "b").where(_maybe_alike(similarity)("n_a", "parities_a", "n_b", "parities_b")).select("a", "b"), "copy-candidates")
        ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
        wanted = stored(ends.join(nodes.select("id", "raw"), "id"), "copy-wanted")  # as a table its size is known: few rows are sent to the texts
        texts = stored(docs.select("raw", "text").join(wanted, "raw").groupBy("id").agg(F.first("text").alias("text")), "copy-texts")
        a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return stored(pairs.join(a, "a").join(b, "b").where(_resemblance(words)("text_a", "text_b") >= similarity).select("a", "b"), "copy-links")

    def proposed(n, left, m, left_m):
        """Whether two texts of n and m shingles, left of them from a common one on, may have the resemblance."""
        return F.least(left, left_m) >= similarity / (1 + similarity) * (n + m) - _SLACK

    met = verified(_fingerprint_pairs(nodes))
    central = F.min(F.struct((F.col("n") - F.col("left")).alias("before"), "id", "n", "left"))
    hub = F.col("hub")
    pairs = members.join(members.groupBy("shingle").agg(central.alias("hub")), "shingle").where((F.col("id") != hub["id"]) & proposed(F.col("n"), F.col("left"), hub["n"], hub["left"]))
    pairs = pairs.select(F.least("id", hub["id"]).alias("a"), F.greatest("id", hub["id"]).alias("b")).distinct()
    links = met.unionAll(verified(pairs.join(met, ["a", "b"], "left_anti")))
    roots = connected_components(links).withColumnRenamed("node", "id")
    each_root = stored(members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "copy-rooted")
    several = each_root.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows")).where("lo < hi")
    blocks = several.select("shingle", F.ceil(F.col("rows") / LIST_ROWS).cast("int").alias("blocks"))
    rest = each_root.join(blocks, "shingle").withColumn("band", F.floor(F.log("n") / (_SLACK - math.log(similarity))))
    a = rest.select("shingle", "band", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), *(F.col(c).alias(f"{c}_a") for c in ("id", "n", "left", "root")))
    copies = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    b = copies.select("shingle", "band", "block", *(F.col(c).alias(f"{c}_b") for c in ("id", "n", "left", "root")))
    pairs = a.join(b, ["shingle", "band", "block"]).where((F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & proposed(F.col("n_a"), F.col("left_a"), F.col("n_b"), F.col("left_b")))
    pairs = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    pairs = pairs.distinct()
    roots = connected_components(links.unionAll(verified(pairs))).withColumnRenamed("node", "id")
    classes = stored(nodes.join(roots, "id", "left").select("id", "least_id", F.coalesce("root", "id").alias("root")), "copy-classes")
    first = stored(classes.groupBy("root").agg(F.min("least_id").alias("component_id")), "copy-first")
    named = classes.join(first, "root").select(F.col("id").alias("text_key"), "component_id")
    return each.select("doc_id", "text_key").join(named, "text_key").select("doc_id", "component_id")
