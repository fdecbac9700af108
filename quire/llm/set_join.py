"""N-gram Jaccard join by set relations: index lists in blocks of size and position, and answers derived from a similar set's."""

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

SHINGLE_WORDS, SIMILARITY = 4, (85, 100)
#: Members of a list that are compared in one step, and shares of a set's length by which positions are parted.
BLOCK_MEMBERS, BANDS = 256, 40
#: Rounds bear on how many pairs are left to compare, not on which links are found.
GUIDE_ROUNDS = 3
SAMPLE, COMMON = 16, 1 << 17


def shingle_sets(texts: list[bytes], words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Of each text the distinct hashes of its shingles, ascending, A-Z in lower case. A text with fewer words is one
    shingle, and a text without words the empty set."""
    part = Words([t.lower() for t in texts])
    h, at = part.hashes(words)
    begin = np.searchsorted(part.row[at], np.arange(len(texts) + 1))
    out = []
    for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        if b == a and part.counts[i]:
            first, last = int(part.bounds[i]), int(part.bounds[i + 1]) - 1
            out.append(part.substrings.hash(part.begin[first : first + 1], part.end[last : last + 1]))
        else:
            out.append(np.unique(h[a:b]))
    return out


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample, ascending, and how many have them: at most COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_rows(batch.column("text"))
            for i, j in chunked(texts):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts[i:j], words)).view(np.int64))], names=["shingle"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    found = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingle, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def parities(own: np.ndarray) -> bytes:
    """A bit for each value of the last bits of a hash: whether an odd number of the set has it; twice as many bits as
    members, in powers of two. Bits in which two sets differ are members that one of them has alone."""
    size = max(64, 1 << (2 * max(1, len(own)) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def _sets(docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, raw, set_key, n, parities, prefix): of each text the key of its set (null if empty), its size and so many of
    its rarest shingles that a set which it links with has one of them. All sets order shingles alike: by their number in a
    sample, then by hash. The sample bears on how many candidates there are, not on which links are found."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, words))
    p, q = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, times = common.value
        for batch in batches:
            texts = utf8_rows(batch.column("text"))
            for i, j in chunked(texts):
                keys, prefixes, sizes, bits = [], [], [], []
                for own in shingle_sets(texts[i:j], words):
                    keys.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None)
                    sizes.append(len(own))
                    bits.append(parities(own))
                    if len(shingle) and len(own):
                        at = np.minimum(np.searchsorted(shingle, own), len(shingle) - 1)
                        own = own[np.argsort(np.where(shingle[at] == own, times[at], 0), kind="stable")]
                    prefixes.append(own[: len(own) - -(-p * len(own) // q) + 1].view(np.int64))
                columns = [batch.column("doc_id").slice(i, j - i), batch.column("raw").slice(i, j - i), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "raw", "set_key", "n", "parities", "prefix"])

    return docs.mapInArrow(run, "doc_id long, raw long, set_key long, n long, parities binary, prefix array<long>")


def _listed(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(shingle, block, least_n, most_n, most_left, members): the lists of members(shingle, id, n, at, ...) in blocks. A list
    of BLOCK_MEMBERS or fewer is one block; a longer one is parted by size, in classes of the similarity, by position, in
    bands of the set's length, and then by hash into blocks of about BLOCK_MEMBERS. Of each block the bounds are known by which pairs
    of blocks are skipped: sizes, and how much of a set is left from the position on."""
    counts = members.groupBy("shingle").agg(F.count("*").alias("_all"))
    ratio = math.log(similarity[1] / similarity[0])
    cell = F.struct(F.floor(F.log("n") / ratio).alias("size"), F.floor(F.col("at") * BANDS / F.col("n")).alias("band"))
    none = F.lit(None).cast("struct<size:bigint,band:bigint>")
    rows = members.join(counts, "shingle").withColumn("cell", F.when(F.col("_all") > BLOCK_MEMBERS, cell).otherwise(none))
    large = rows.where("cell is not null").groupBy("shingle", "cell").agg(F.count("*").alias("_cell"))
    short = rows.where("cell is null").withColumn("salt", F.lit(0).cast("long"))
    long = rows.where("cell is not null").join(large, ["shingle", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("_cell") / BLOCK_MEMBERS)))
    member = F.struct(*(c for c in members.columns if c != "shingle"))
    dealt = short.select("shingle", "cell", "salt", member.alias("m")).unionAll(long.select("shingle", "cell", "salt", member.alias("m")))
    blocks = dealt.groupBy("shingle", "cell", "salt").agg(
        F.min("m.n").alias("least_n"), F.max("m.n").alias("most_n"), F.max(F.col("m.n") - F.col("m.at")).alias("most_left"), F.collect_list("m").alias("members")
    )
    return blocks.withColumn("block", F.xxhash64("cell", "salt")).drop("cell", "salt")


def _spokes(members: DataFrame, number: int, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of one guide for each size class of a list of members(shingle, id, n, at, root) and the members that may link with
    it and aren't in its component yet: a member of the first band, another one each round."""
    p, q = similarity
    size, band = F.floor(F.log("n") / math.log(q / p)), F.floor(F.col("at") * BANDS / F.col("n"))
    rows = members.withColumn("size", size)
    guide = F.min(F.struct(band.alias("band"), F.xxhash64("id", F.lit(number)).alias("order"), "id", "n", "at", "root")).alias("g")
    pairs = rows.join(rows.groupBy("shingle", "size").agg(guide), ["shingle", "size"]).where(F.col("root") != F.col("g.root"))
    left = F.least(F.col("n") - F.col("at"), F.col("g.n") - F.col("g.at"))
    pairs = pairs.where((p + q) * left >= p * (F.col("n") + F.col("g.n")))
    return pairs.select(F.least("g.id", "id").alias("a"), F.greatest("g.id", "id").alias("b")).distinct()


def _block_pairs(similarity: tuple[int, int]):
    """A function of two blocks of members(id, n, at, root): the pairs that may link and are in different components."""
    p, q = similarity

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (z.values for z in (x, y))
            (id_a, n_a, at_a, root_a), (id_b, n_b, at_b, root_b) = ([z.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "at", "root")] for z in (x, y))
            left = np.minimum.outer(n_a - at_a, n_b - at_b)
            may = ((p + q) * left >= p * np.add.outer(n_a, n_b)) & (root_a[:, None] != root_b[None, :])
            i, j = np.nonzero(may)
            out.append([{"a": int(s), "b": int(t)} for s, t in zip(np.minimum(id_a[i], id_b[j]), np.maximum(id_a[i], id_b[j]), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return F.arrow_udf(run, "array<struct<a:bigint,b:bigint>>")


def _overlap(words: int):
    """A function of two columns of texts: how many shingles both sets have."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs, out = list(zip(utf8_rows(a), utf8_rows(b), strict=True)), []
        for i, j in chunked([x + y for x, y in pairs]):
            each = list({t: None for pair in pairs[i:j] for t in pair})
            own = dict(zip(each, shingle_sets(each, words), strict=True))
            out += [len(np.intersect1d(own[x], own[y], assume_unique=True)) for x, y in pairs[i:j]]
        return pa.array(out, pa.int64())

    return F.arrow_udf(run, "bigint")


def _apart(similarity: tuple[int, int]):
    """A function of two sizes and parities: true if the sets differ in more bits than linked sets have members apart."""
    p, q = similarity

    def run(n: pa.Array, a: pa.Array, m: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y, total in zip(a.to_pylist(), b.to_pylist(), (n.to_numpy() + m.to_numpy()).tolist(), strict=True):
            u, v = (np.unpackbits(np.frombuffer(z, dtype=np.uint8)) for z in (x, y))
            size = min(len(u), len(v))
            u, v = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (u, v))
            out.append((p + q) * int(np.count_nonzero(u != v)) > (q - p) * total)
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def similar_sets(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text): the size of its set of shingles, and the least
    doc_id that links reach. Sets link if similarity[1] * intersection >= similarity[0] * union; empty sets link with none.

    Exact, by set relations:

    * Equal sets are one node.
    * Each set is listed under its rarest shingles. Lists are cut into blocks by size and position; a pair of blocks whose
      sizes or positions can't link is skipped as a whole, and no step compares more than two blocks.
    * In a few rounds one set of each list and size class, its guide, is compared with those of other components, and the
      intersections are kept: the answers of this set. Members of one component need no further comparing, so large
      families are joined by few comparisons of each member. Rounds end when one links nothing new.
    * A pair left in different components is decided from the answers of a set similar to one of them where they suffice:
      if the answer of h to y is known, x has no more of y than this and what x has beside h. Only what that leaves open is
      compared by parities and then by whole texts.

    A null doc_id never names a component; a component of such rows only has a null one. Repeated rows give repeated result
    rows. Null texts are empty. Other columns are not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    p, q = similarity
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("raw"))
    each = stored(_sets(docs, words, similarity), "sets")
    nodes = stored(
        each.where("set_key is not null").groupBy(F.col("set_key").alias("id"))
        .agg(F.min("doc_id").alias("least_id"), F.min("raw").alias("raw"), F.first("n").alias("n"), F.first("parities").alias("parities"), F.first("prefix").alias("prefix")), "set-nodes",
    )
    listed = nodes.select("id", "n", F.posexplode("prefix").alias("at", "shingle"))
    shared = listed.groupBy("shingle").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("shingle")
    members = stored(listed.join(shared, "shingle").select("shingle", "id", "n", F.col("at").cast("long").alias("at")), "set-members")
    sizes = nodes.select("id", "n", "parities")
    linked = ((p + q) * F.col("overlap")) >= p * (F.col("n_a") + F.col("n_b"))

    def answers(pairs: DataFrame) -> DataFrame:
        """(a, b, n_a, n_b, overlap) of the distinct pairs (a, b) that parities don't rule out, from the whole texts."""
        a, b = (sizes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("parities").alias(f"parities_{x}")) for x in "ab")
        open_pairs = stored(pairs.join(a, "a").join(b, "b").where(~_apart(similarity)("n_a", "parities_a", "n_b", "parities_b")).select("a", "b", "n_a", "n_b"), "set-candidates")
        ends = open_pairs.select(F.col("a").alias("id")).unionAll(open_pairs.select("b")).distinct()
        wanted = stored(ends.join(nodes.select("id", "raw"), "id"), "set-wanted")  # as a table its size is known: few rows are sent to the texts
        texts = stored(docs.select("raw", "text").join(wanted, "raw").groupBy("id").agg(F.first("text").alias("text")), "set-texts")
        a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return stored(open_pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", _overlap(words)("text_a", "text_b").alias("overlap")), "set-answers")

    known = links = rooted = None
    for number in range(GUIDE_ROUNDS):
        if rooted is None:
            rooted = members.withColumn("root", F.col("id"))
        spokes = _spokes(rooted, number, similarity)
        found = answers(spokes if known is None else spokes.join(known, ["a", "b"], "left_anti"))
        known = found if known is None else known.unionAll(found)
        fresh = found.where(linked).select("a", "b")
        links = fresh if links is None else links.unionAll(fresh)
        if fresh.isEmpty():
            break
        roots = connected_components(links).withColumnRenamed("node", "id")
        every = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        several = every.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle")
        rooted = stored(every.join(several, "shingle").select(*members.columns, "root"), "set-rooted")
    rest = stored(_listed(rooted, similarity), "set-blocks")
    a, b = (rest.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("block", "least_n", "most_n", "most_left", "members"))) for x in "ab")
    left = F.least("most_left_a", "most_left_b")
    fits = (q * F.col("most_n_a") >= p * F.col("least_n_b")) & (q * F.col("most_n_b") >= p * F.col("least_n_a")) & ((p + q) * left >= p * (F.col("least_n_a") + F.col("least_n_b")))
    met = a.join(b, "shingle").where((F.col("block_a") <= F.col("block_b")) & fits)
    pairs = met.select(F.explode(_block_pairs(similarity)("members_a", "members_b")).alias("pair")).select("pair.*").distinct()
    found = answers(_undecided(pairs.join(known, ["a", "b"], "left_anti"), known, sizes.select("id", "n"), similarity))
    roots = connected_components(links.unionAll(found.where(linked).select("a", "b"))).withColumnRenamed("node", "id")
    classes = stored(nodes.join(roots, "id", "left").select("id", "least_id", F.coalesce("root", "id").alias("root")), "set-classes")
    first = stored(classes.groupBy("root").agg(F.min("least_id").alias("component_id")), "set-first")
    named = classes.join(first, "root").select(F.col("id").alias("set_key"), "component_id")
    rows = each.select("doc_id", "set_key", F.col("n").alias("n_shingles"))
    return rows.join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _undecided(pairs: DataFrame, known: DataFrame, sizes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that the answers so far don't decide against. Each set has a guide: the set of known answers with which it has
    the largest share in common. If the guide's answer to the other set is known too, it bounds what the two can have."""
    p, q = similarity
    both = known.select(F.col("a").alias("x"), F.col("b").alias("h"), F.col("n_a").alias("n_x"), F.col("n_b").alias("n_h"), "overlap").unionAll(known.select("b", "a", "n_b", "n_a", "overlap"))
    likest = F.struct((F.col("overlap") / (F.col("n_x") + F.col("n_h") - F.col("overlap"))).alias("likeness"), "h", "overlap")
    guides = stored(both.groupBy("x").agg(F.max(likest).alias("g")).select("x", F.col("g.h").alias("h"), F.col("g.overlap").alias("o_x")), "set-guides")
    answer = both.select("h", F.col("x").alias("y"), F.col("overlap").alias("o_y"))

    def bounded(rows: DataFrame, x: str, y: str) -> DataFrame:
        own = guides.select(F.col("x").alias(x), "h", "o_x")
        seen = rows.join(own, x, "left").join(answer.withColumnRenamed("y", y), ["h", y], "left")
        most = F.col("o_y") + F.least(F.col(f"n_{x}") - F.col("o_x"), F.col(f"n_{y}") - F.col("o_y"))
        out = F.coalesce((p + q) * most < p * (F.col("n_a") + F.col("n_b")), F.lit(False))
        return seen.where(~out).select("a", "b", "n_a", "n_b")

    a, b = (sizes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    return bounded(bounded(pairs.join(a, "a").join(b, "b"), "a", "b"), "b", "a").select("a", "b")
