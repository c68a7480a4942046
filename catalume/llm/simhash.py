"""SimHash near-duplicates through a hierarchical index in Gray order.

A document's fingerprint has a bit set where more than half of its shingle hashes (XXH64, seed 42) have
it; its words are runs without white space, with A-Z lower-cased. Fingerprints that differ in at most
``BITS`` bits are linked, and documents share a class along links.

Distinct fingerprints are sorted by Gray rank, so that neighbours share bits, and cut into shards. The
bits on which all of a shard agree form a masked pattern; patterns shared by ``FAN`` neighbours are
factored into a node above, which keeps the child only what the parent hasn't. Going down from the
top, a fingerprint adds up its differences with each node's own bits and leaves a whole group as soon
as they exceed the limit. The upper tree has at most ``MAX_SHARDS`` leaves, whatever the data, and goes
to all tasks; each fingerprint is sent to the shards that it reaches, where the same descent goes on
over a tree of that shard's members. No pair within the limit is lost, and no other one is formed.

Edge cases: null and empty texts, and those of white space alone, have fingerprint zero, which links
like any other; texts with fewer words than a shingle are hashed whole; copies share a fingerprint and
are searched once; a null id takes no part in the choice of the smallest id of its class; repeated rows
are all returned; a text of any length is hashed whole; an empty table gives an empty result; columns
other than the id and the text are not read. ``deduplicate`` keeps other columns as they are, one of
several equal rows, and a row with a null id only if its class has no other; texts without words are one
class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few_rows, giving_back, materialise, release, settle, settled, sieved
from .components import connected_components
from .tokens import portions

WORDS, BITS, SEED = 3, 2, 42
FAN, SHARD, MAX_SHARDS = 16, 1024, 65_536
#: The queries of a shard are spread over this many tasks, each with a copy of its members.
SPREAD = 8
#: Rows that share a key are joined with it in this many parts.
SALTS = 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included, as unsigned 64-bit numbers."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(found), min(words, len(found))
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint as a signed number."""
    h = shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of each row."""

    def each(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": np.array([fingerprint(t, words) for t in batch["text"]], np.int64)})

    return df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(each, "doc_id long, fp long")


def gray_rank(column: str):
    """The place of a code in Gray order, as a number that Spark sorts in that order."""
    rank = F.col(column)
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    return rank.bitwiseXOR(F.lit(-(2**63)))


class Tree:
    """Levels of (own mask, pattern) from the top down; child i belongs to parent i // FAN."""

    def __init__(self, masks: np.ndarray, patterns: np.ndarray):
        levels = [(masks, patterns)]
        while len(levels[0][0]) > FAN:
            m, p = levels[0]
            at = np.arange(0, len(m), FAN)
            ones, zeros = np.bitwise_and.reduceat(m & p, at), np.bitwise_and.reduceat(m & ~p, at)
            levels.insert(0, (ones | zeros, ones))
        self.levels = [levels[0]] + [(m & ~np.repeat(up, FAN)[: len(m)], p) for (up, _), (m, p) in zip(levels, levels[1:], strict=False)]

    def reached(self, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of code, index of leaf) for the leaves that may hold a code within ``bits``."""
        top = len(self.levels[0][0])
        q = np.repeat(np.arange(len(codes)), top)
        node = np.tile(np.arange(top), len(codes))
        differ = np.zeros(len(q), np.uint8)
        for depth, (mask, pattern) in enumerate(self.levels):
            if depth:
                q, differ = np.repeat(q, FAN), np.repeat(differ, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                held = node < len(mask)
                q, node, differ = q[held], node[held], differ[held]
            differ = differ + np.bitwise_count((codes[q] ^ pattern[node]) & mask[node])
            held = differ <= bits
            q, node, differ = q[held], node[held], differ[held]
        return q, node


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def links(codes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) for every two codes of the distinct column ``fp`` that differ in at most ``bits`` bits."""
    spark = codes.sparkSession
    n = codes.count()
    shard = max(SHARD, -(-n // MAX_SHARDS))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // shard)))

    def cut(batches):
        from pyspark import TaskContext

        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            yield pd.DataFrame({"shard": first + (seen + np.arange(len(batch))) // shard, "fp": batch["fp"].to_numpy(np.int64)})
            seen += len(batch)

    ordered = codes.select("fp", gray_rank("fp").alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank").select("fp")
    members = settled(ordered.mapInPandas(giving_back(cut), "shard long, fp long"), "gray")
    # at most MAX_SHARDS + `parts` rows, whatever the data
    tops = members.groupBy("shard").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some")).orderBy("shard").toArrow()
    ones, some = (tops[c].to_numpy().view(np.uint64) for c in ("ones", "some"))
    tree, numbers = Tree(~(ones ^ some), ones), tops["shard"].to_numpy()

    def route(batches):
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch[i : i + 2048]
                fp, own = part["fp"].to_numpy(np.int64), np.searchsorted(numbers, part["shard"].to_numpy(np.int64))
                q, to = tree.reached(fp.view(np.uint64), bits)
                later = to >= own[q]  # of two shards, the later one is searched for the members of the earlier
                q, to = q[later], to[later]
                yield pd.DataFrame({"shard": to.astype(np.int32), "salt": (fp[q] % SPREAD).astype(np.int32), "query": True, "own": own[q] == to, "fp": fp[q]})
                for salt in range(SPREAD):
                    yield pd.DataFrame({"shard": own.astype(np.int32), "salt": np.int32(salt), "query": False, "own": True, "fp": fp})

    def search(batches):
        """Rows come by shard and salt, the members of each first; only one shard's members are held."""
        key, held, index = None, [], None
        for batch in batches:
            for (shard_, salt, query), rows in batch.groupby(["shard", "salt", "query"], sort=True):
                if key != (shard_, salt):
                    key, held, index = (shard_, salt), [], None
                fp = rows["fp"].to_numpy(np.int64)
                if not query:
                    held.append(fp)
                    continue
                if index is None:
                    codes_ = np.concatenate(held) if held else np.zeros(0, np.int64)
                    index = (codes_, Tree(np.full(len(codes_), _FULL), codes_.view(np.uint64)))
                codes_, tree_ = index
                for i in range(0, len(fp) if len(codes_) else 0, 1024):
                    q, at = tree_.reached(fp[i : i + 1024].view(np.uint64), bits)
                    a, b, own = fp[i : i + 1024][q], codes_[at], rows["own"].to_numpy()[i : i + 1024][q]
                    new = np.where(own, a < b, True)
                    yield pd.DataFrame({"a": a[new], "b": b[new]})

    sent = members.mapInPandas(giving_back(route), "shard int, salt int, query boolean, own boolean, fp long")
    dealt = sent.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "query", gray_rank("fp"))
    return dealt.mapInPandas(giving_back(search), "a long, b long")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: 16 hexadecimal digits, and the smallest id of its class."""
    docs = materialise(fingerprints(df, id, text, words), "simhash")
    codes = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = connected_components(links(codes.select("fp"), bits))
    rooted = codes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(classes, "root").select("fp", "component_id")
    out = _spread_join(docs, named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _spread_join(many: DataFrame, one: DataFrame, *keys: str) -> DataFrame:
    """``many`` with the columns of ``one``, which has a row for each key: a key of many copies goes to ``SALTS`` tasks."""
    salted = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "__salt"]).drop("__salt")


#: For duplicates by similarity: words of a shingle, least similarity, bits between whole fingerprints,
#: partial fingerprints of a document, hashes in a sketch, how far an estimate may be off (five standard
#: deviations of a sketch of that size), and members of a group of which every two are compared: in the
#: first two rounds, with many groups to a document, and in the later ones, with few.
SHINGLE, SIMILAR, NEAR_BITS, DRAWS, SKETCH, MARGIN, SMALL, LATER = 5, 0.8, 3, 8, 1024, 0.0625, 12, 128
#: Cells of the counts of shingles.
COUNTS = 1 << 18
#: Buckets of a short sketch (a power of two), sets from which on it is asked, and how far below the least
#: similarity its estimate turns a pair away (seven standard deviations).
BINS, LONG, FAR = 128, 128, 0.25
#: Members of a family that decide about its template.
DRAWN = 16
#: About how many members of a larger group the others are compared with in the first round by rare shingles,
#: and how many times as many in each further one.
PIVOTS, MORE = 2, 8
_ODD = np.random.default_rng(11).integers(0, 2**63, DRAWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def similarity(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Jaccard similarity of two sorted sketches; exact for sets that fit in one, and 1 for two empty ones."""
    union = np.union1d(a, b)[:size]
    return float(np.isin(union, np.intersect1d(a, b, True), True).mean()) if len(union) else 1.0


def short_sketch(h: np.ndarray) -> np.ndarray:
    """Of the smallest of the sorted hashes in each bucket 16 bits, -1 for none; a bucket is told by a hash's first bits."""
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    out = np.full(BINS, -1, np.int32)
    if len(h):
        at = np.minimum(np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << shift), len(h) - 1)
        held = (h[at] >> shift) == np.arange(BINS, dtype=np.uint64)
        out[held] = (h[at] & np.uint64(0xFFFF)).astype(np.int32)[held]
    return out


def not_far(pairs: DataFrame, least: float) -> DataFrame:
    """``pairs`` (bx, by: short sketches; nx, ny: sizes) without those whose estimate is clearly below ``least``."""
    same = F.size(F.filter(F.zip_with("bx", "by", lambda a, b: (a == b) & (a >= 0)), lambda x: x))
    some = F.size(F.filter(F.zip_with("bx", "by", lambda a, b: (a >= 0) | (b >= 0)), lambda x: x))
    return pairs.where((F.least("nx", "ny") < LONG) | (same >= (least - FAR) * some))


def with_similarity(pairs: DataFrame, least: float, size: int = SKETCH) -> DataFrame:
    """``pairs`` of sketches (sx, sy) and sizes of their sets (nx, ny) with ``near``, each array made once.

    Sets that their sketches hold are compared exactly; of others an estimate below ``least`` may be 0.
    """
    shared = pairs.withColumn("shared", F.array_intersect("sx", "sy"))
    n, both, union = F.size("shared"), F.greatest("nx", "ny"), F.size("sx") + F.size("sy") - F.size("shared")
    smallest = F.slice(F.sort_array(F.array_union("sx", "sy")), 1, size)
    exact = F.when(union == 0, F.lit(1.0)).otherwise(n / union)
    # no more can be shared among the smallest of both than among all
    near = F.when((both <= size) | (union <= size), exact).when(n < least * size, F.lit(0.0)).otherwise(F.size(F.array_intersect(smallest, "shared")) / size)
    return shared.withColumn("near", near).drop("shared")


def _near_fingerprints(made: DataFrame, bits: int) -> DataFrame:
    """(x, y), x < y: rows whose whole fingerprints are near, one row for each fingerprint."""
    of_fp = made.groupBy("fp").agg(F.min("row").alias("row"))
    first, second = of_fp.select(F.col("fp").alias("a"), F.col("row").alias("x")), of_fp.select(F.col("fp").alias("b"), F.col("row").alias("y"))
    return links(of_fp.select("fp"), bits).join(first, "a").join(second, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def _compared(members: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """(x, y) to compare of groups (row, draw, key), and the members of groups of more than ``small``, with their heads.

    The members with their heads are written once, as all that follows reads them.
    """
    heads = members.groupBy("draw", "key").agg(F.min("row").alias("h"), F.min_by("row", F.xxhash64("row", "draw")).alias("h2"), F.count("*").alias("n")).where("n > 1")
    members = settled(_spread_join(members, heads, "draw", "key"), "grouped")
    few = members.where(F.col("n") <= small).groupBy("draw", "key").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    two = F.flatten(F.transform("rows", lambda x, i: F.transform(F.slice("rows", i + 2, small), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = few.select(F.explode(two).alias("p")).select("p.x", "p.y")
    many = members.where(F.col("n") > small)
    return pairs.unionByName(many.select(F.explode(F.array("h", "h2")).alias("head"), "row").where("head <> row").select(*_ordered("head", "row"))), many


def _refused(many: DataFrame, found: DataFrame) -> DataFrame:
    """The members that neither head of their group accepts; a second head that the first refuses is one too."""
    sure = found.where("sure")
    both = sure.select(F.col("x").alias("head"), F.col("y").alias("row")).unionByName(sure.select(F.col("y").alias("head"), F.col("x").alias("row")))
    rest = many.where(F.col("row") != F.col("h"))
    for head in ("h", "h2"):
        rest = rest.join(both.withColumnRenamed("head", head), [head, "row"], "left_anti")
    return rest


def _families(members: DataFrame) -> DataFrame:
    """(row, fam) of the members of large groups (row, draw, key, n): rows of one template get one family, whichever groups they are in.

    A row names its largest group; it belongs to the one that most members of that group have named.
    """
    named = members.groupBy("row").agg(F.max(F.struct("n", "draw", "key")).alias("g")).select("row", F.col("g.draw").alias("draw"), F.col("g.key").alias("key"), F.xxhash64("g.draw", "g.key").alias("fam"))
    votes = members.select("row", "draw", "key").join(named.select("row", "fam"), "row").groupBy("draw", "key", "fam").agg(F.count("*").alias("n"))
    chosen = settled(votes.groupBy("draw", "key").agg(F.max(F.struct("n", "fam")).alias("v")).select("draw", "key", F.col("v.fam").alias("fam")), "families")
    return _spread_join(named.select("row", "draw", "key"), chosen, "draw", "key").select("row", "fam")


def _edits(sets: DataFrame) -> DataFrame:
    """(row, fam, all, edits) of whole sets (row, fam, all): what tells each from the template of its family.

    The template has the shingles that most of about ``DRAWN`` members, drawn by hash, hold. Any template gives right results, as
    two sets differ in just what their edits differ in; a good one leaves few edits.
    """
    families = sets.groupBy("fam").agg(F.count("*").alias("m"))
    drawn = _spread_join(sets, families, "fam").where(F.pmod(F.xxhash64("row"), F.ceil(F.col("m") / DRAWN)) == 0).select("fam", "all", F.count("*").over(Window.partitionBy("fam")).alias("k"))
    common = drawn.select("fam", "k", F.explode("all").alias("s")).groupBy("fam", "s").agg(F.count("*").alias("n"), F.first("k").alias("k")).where("2 * n > k")
    templates = families.join(common.groupBy("fam").agg(F.collect_list("s").alias("base")), "fam", "left").select("fam", F.coalesce("base", F.array().cast("array<long>")).alias("base"))
    return _spread_join(sets, settled(templates, "templates"), "fam").select("row", "fam", "all", F.concat(F.array_except("all", "base"), F.array_except("base", "all")).alias("edits"))


def _alike_by_template(edits: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``edits`` with ``k``, ``inner`` and ``low``, and the links (x, y, sure) of inner members with the head of their family.

    Two sets reach ``least`` if they differ in at most q of both sizes together, q = (1 - least) / (1 + least). They differ in
    no more than the edits of both; with s, the edits less q of the size, they reach it for sure if both s come to 0 or less, and
    else have to share half of that sum of edits. The head has the least s; inner members reach it for sure, so that they are one
    class, named by ``k``, and two of them need no comparison. ``low`` is the least s that a partner still to be sought can have.
    """
    q = (1 - least) / (1 + least)
    held = edits.withColumn("s", F.size("edits") - q * F.size("all"))
    heads = held.groupBy("fam").agg(F.min(F.struct("s", "row")).alias("h")).select("fam", F.col("h.s").alias("low"), F.col("h.row").alias("h"))
    inner = F.col("s") + F.col("low") <= 1e-9
    outer = _spread_join(held.select("fam", "row", "s"), heads, "fam").where(~inner).groupBy("fam").agg(F.min("s").alias("outer"))
    held = _spread_join(held, heads.join(outer, "fam", "left"), "fam").withColumn("inner", inner | (F.col("row") == F.col("h")))
    tied = held.where(F.col("inner") & (F.col("row") != F.col("h"))).select(*_ordered("h", "row"), F.lit(True).alias("sure"))
    return held.select("row", "fam", "all", "edits", F.when(F.col("inner"), F.col("h")).otherwise(F.col("row")).alias("k"), "inner", F.when(F.col("inner"), F.col("outer")).otherwise(F.col("low")).alias("low")), tied


def _rare_keys(edits: DataFrame, least: float) -> DataFrame:
    """(row, key, s, rem, c, k, inner): the rarest shingles of each whole set and the rarest of its edits.

    Two sets that reach ``least`` share a shingle among the rarest n - least n + 1 of each; two of one family also share one among
    the rarest of their edits, so that shingles need no comparison of equal ``c``, the family, and edits none of equal ``k``, the
    class. ``rem`` is how many are no rarer than the key; what two sets share has to come to half of both ``s``. Rare is by counts
    in ``COUNTS`` cells, so the order is one for all rows, however good the counts are. A key that no other row can have is left out.
    """
    q = (1 - least) / (1 + least)

    def counted(batches):
        table = np.zeros(2 * COUNTS, np.int64)
        for batch in batches:
            for first, name in ((0, "all"), (COUNTS, "edits")):
                flat = batch.column(name).flatten().to_numpy()
                if first:
                    flat = flat ^ np.repeat(batch.column("fam").to_numpy(), pc.list_value_length(batch.column(name)).to_numpy())
                table[first : first + COUNTS] += np.bincount(flat % COUNTS, minlength=COUNTS)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["cell", "n"])

    with few_rows(edits.sparkSession):
        found = edits.select("fam", "all", "edits").mapInArrow(giving_back(counted), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2 COUNTS rows at most
    counts = np.zeros(2 * COUNTS, np.int32)
    counts[found["cell"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**31 - 1)

    def rarest(batches):
        for batch in batches:
            out = []
            for row, fam, h, e, k, inner, low in zip(*(batch.column(c) for c in ("row", "fam", "all", "edits", "k", "inner", "low")), strict=True):
                row, fam, low, n, m = row.as_py(), fam.as_py(), low.as_py(), len(h.values), len(e.values)
                kinds = [(h.values.to_numpy(), 0, n - int(np.ceil(least * n - 1e-9)) + 1, (1 - q) * n, fam, False)]
                if low is not None:
                    # what one has and the other hasn't is at most a share 1 / least - 1 of its size
                    need = max(1, int(np.ceil((m - q * n + low) / 2 - 1e-6)), m - int((1 / least - 1) * n + 1e-9))
                    kinds.append((e.values.to_numpy() ^ fam, COUNTS, m - need + 1, m - q * n, row, inner.as_py()))
                for keys, first, most, s, c, alike in kinds:
                    often = counts[first + keys % COUNTS]
                    own = np.lexsort((keys, often))[: max(0, most)]
                    at = np.flatnonzero(often[own] > 1)
                    out.append((len(at), keys[own[at]], len(keys) - at, row, s, c, k.as_py(), alike))
            if out:
                times, key, rem, *same = zip(*out, strict=True)
                row, s, c, k, alike = (np.repeat(np.array(x), times) for x in same)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, np.concatenate(key), s, np.concatenate(rem), c, k, alike)], names=["row", "key", "s", "rem", "c", "k", "inner"])

    return edits.mapInArrow(giving_back(rarest), "row long, key long, s double, rem long, c long, k long, inner boolean")


def _live(keys: DataFrame) -> DataFrame:
    """The members (row, key, s, rem, c, k, inner) of groups that may still be similar to another one, with the group's size ``m`` and head ``h``.

    If the key is the rarest shingle that two sets share, they share no more than the smaller ``rem`` of them, and have to
    share half of both ``s``. That bounds the ``s`` of a set that a member can be similar to, and a group whose least one is
    larger than that has none for it; inner members are similar to no further inner one. The bound is met exactly where the
    members share a passage and have the rest for themselves.
    """
    most = 2 * F.col("rem") - F.col("s") + 1e-6
    columns = ["row", "key", "s", "rem", "c", "k", "inner"]
    for _ in range(2):
        bounds = [F.min("s").alias("__s"), F.max(most).alias("__most"), F.min(F.when(~F.col("inner"), F.col("s"))).alias("__outer_s"), F.max(F.when(~F.col("inner"), most)).alias("__outer_most")]
        groups = keys.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("s", "row")).alias("__h"), *[f(c).alias(f"__{name}_{c}") for c in ("c", "k") for name, f in (("min", F.min), ("max", F.max))], *bounds).where("m > 1 AND __min_c <> __max_c AND __min_k <> __max_k")
        held = _spread_join(keys.select(columns), groups, "key")
        least, largest = (F.when(F.col("inner"), F.col(f"__outer_{c}")).otherwise(F.col(f"__{c}")) for c in ("s", "most"))
        keys = held.where((most >= least) & (F.col("s") <= largest)).select(*columns, "m", F.col("__h.row").alias("h"))
    return keys


def _by_rare_shingles(keys: DataFrame, known: DataFrame, check) -> DataFrame:
    """``known`` links (x, y, sure) and those found between rows that share a rare shingle; the table ``keys`` is deleted.

    Groups of at most ``SMALL`` (after the first round: ``LATER``) are compared whole. In a larger one all
    members are compared with its least set and with some drawn by hash, which are then done. Those that one of
    them accepts take over its class ``k``, and go on with the others to the next round with ``MORE`` times as many
    drawn, where only members of different classes are compared, until the group is one class or nothing is left.
    So no link is lost, and the number of rounds grows with the logarithm of the largest group.
    """
    out, pivots, small = known, PIVOTS, SMALL
    fits = lambda x, y: (x["c"] != y["c"]) & (x["k"] != y["k"]) & (F.least(x["rem"], y["rem"]) + 1e-6 >= (x["s"] + y["s"]) / 2)
    done = [keys]
    while True:
        keys = settled(_live(keys), "keys")
        while done:
            release(done.pop())
        if not keys.take(1):
            return out
        done.append(keys)
        own = F.struct("row", "s", "rem", "c", "k")
        few = keys.where(F.col("m") <= small).groupBy("key").agg(F.array_sort(F.collect_list(own)).alias("rows"))
        two = F.flatten(F.transform("rows", lambda x, i: F.transform(F.filter(F.slice("rows", i + 2, small), lambda y: fits(x, y)), lambda y: F.struct(x["row"].alias("x"), y["row"].alias("y")))))
        drawn = (F.col("row") == F.col("h")) | (F.pmod(F.xxhash64("row", "key", F.lit(pivots)), F.ceil(F.col("m") / pivots)) == 0)
        many = keys.where(F.col("m") > small).withColumn("drawn", drawn)
        heads = many.where("drawn").groupBy("key").agg(F.collect_list(own).alias("heads"))
        met = F.filter("heads", lambda p: (p["row"] != F.col("row")) & fits(p, own))
        asked = materialise(_spread_join(many.select("row", "key", "s", "rem", "c", "k"), heads, "key").select("key", "row", "k", F.explode(met).alias("p")).select("key", "row", "k", F.col("p.row").alias("head"), F.col("p.k").alias("of_head")), "asked")
        done.append(asked)
        pairs = few.select(F.explode(two).alias("p")).select("p.x", "p.y").unionByName(asked.select(*_ordered("head", "row"))).distinct()
        found = settled(check(pairs.join(out.select("x", "y"), ["x", "y"], "left_anti")), "links")
        out = out.unionByName(found)
        sure = out.where("sure").distinct()
        both = sure.select(F.col("x").alias("head"), F.col("y").alias("row")).unionByName(sure.select(F.col("y").alias("head"), F.col("x").alias("row")))
        accepted = settled(asked.join(both, ["head", "row"], "left_semi"), "accepted")
        # heads may accept each other: the class of a head is the least of theirs
        named = accepted.groupBy("key", "row").agg(F.min(F.least("k", "of_head")).alias("least_k"))
        taken = accepted.join(named.select("key", F.col("row").alias("head"), F.col("least_k").alias("of_heads")), ["key", "head"], "left").groupBy("key", "row").agg(F.min(F.least("k", "of_head", "of_heads")).alias("taken"))
        keys = settled(many.where("NOT drawn").join(taken, ["key", "row"], "left").withColumn("k", F.least("k", "taken")).select("row", "key", "s", "rem", "c", "k", "inner"), "rest")
        done += [accepted, keys]
        pivots, small = pivots * MORE, LATER


def _found_links(made: DataFrame, bits: int, least: float, sets_of, check) -> DataFrame:
    """(x, y, sure) of candidates that hold or are in doubt; ``check`` says which of a frame of pairs (x, y) do.

    Rows that share a fingerprint, whole or partial, form a group. In a group of at most ``SMALL`` every
    two are compared; in a larger one each member with two heads, the smallest row and one by hash. All
    members of larger groups in which a head refuses one (as those that a common passage has brought
    together) are then told by what tells them from their family's template: those that it makes alike are
    linked, and the others are grouped by their rarest shingles and edits, which no similar pair can avoid to share.
    """
    fp, draws = F.struct(F.lit(-1).alias("draw"), F.col("fp").alias("key")), F.transform("draws", lambda h, i: F.struct(i.alias("draw"), h.alias("key")))
    near = settled(_near_fingerprints(made, bits), "alike")
    pairs, many = _compared(made.select("row", F.explode(F.concat(F.array(fp), draws)).alias("k")).select("row", "k.draw", "k.key"), SMALL)
    found = settled(check(pairs.unionByName(near).where("x <> y").distinct()), "links")
    refused = settled(_refused(many, found).select("draw", "key").distinct(), "refused")
    members = settled(many.join(refused, ["draw", "key"], "left_semi"), "members")
    release(many)
    if not members.take(1):
        return found
    mixed = settled(_families(members), "mixed")
    release(members)
    whole = sets_of(mixed.select("row"))
    sets = settled(whole.join(mixed, "row"), "sets")
    release(whole)
    edits = settled(_edits(sets), "edits")
    release(sets)
    held, tied = _alike_by_template(edits, least)
    held, tied = settled(held, "held"), settled(tied, "links")
    release(edits)
    with few_rows(made.sparkSession):  # the keys are read several times
        keys = settled(_rare_keys(held, least), "rare")
    release(held)
    return _by_rare_shingles(keys, found.unionByName(tied), check)


def similar_classes(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = SHINGLE, least: float = SIMILAR, bits: int = NEAR_BITS) -> DataFrame:
    """(row, doc_id, root) of each distinct row: near-duplicates by Jaccard similarity of their shingles.

    Texts with the same set of shingles are one from the start. Candidates are documents whose
    fingerprints differ in at most ``bits`` bits, by the index, and documents that share a partial
    fingerprint. A partial one is the fingerprint of a single shingle, the winner of a min-wise draw, so
    two documents share it with a probability equal to their similarity; of ``DRAWS`` draws, those at
    ``least`` = 0.8 miss all in 3 of a million cases. How a group is compared says ``_found_links``. Every
    pair is verified: a short sketch turns away what is clearly apart (a pair at ``least`` in one of 10^11 cases),
    and the rest goes on sketches (the ``SKETCH`` smallest shingle hashes, 64 bits each) where these hold
    all shingles or the estimate is clear of ``least`` by ``MARGIN``; else, unless other links tie the
    two, on all shingles. Classes are the connected components of what holds. ``row`` is a hash of id
    and text.
    """
    docs = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.xxhash64(F.struct("doc_id", "text")))

    def each(batches):
        for batch in batches:
            for part in portions(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist(), 1_000_000):
                rows = batch.slice(part.start, part.stop - part.start)
                one, draws, sketch, short = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
                for t in rows.column("text").to_pylist():
                    h = np.unique(shingle_hashes(t, words))
                    if len(h):
                        mixed = (h[:, None] ^ _ODD[None, ::-1]) * _ODD
                        draws.append((mixed ^ (mixed >> np.uint64(29))).min(0).view(np.int64))
                    sketch.append(np.sort(h.view(np.int64))[:SKETCH])
                    short.append(short_sketch(h))
                    one.append((xxhash.xxh64_intdigest(h.tobytes()) - 2**63, fingerprint(t, words), len(h)))
                same, fp, size = (np.array(c, np.int64) for c in zip(*one, strict=True))
                of_draws = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(size > 0, DRAWS, 0))].astype(np.int32)), pa.array(np.concatenate(draws)))
                of_sketch = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.minimum(size, SKETCH))].astype(np.int32)), pa.array(np.concatenate(sketch)))
                of_short = pa.ListArray.from_arrays(pa.array(np.arange(len(short) + 1, dtype=np.int32) * BINS), pa.array(np.concatenate(short)))
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), pa.array(same), pa.array(fp), of_draws, of_sketch, of_short, pa.array(size.astype(np.int32))], names=["row", "doc_id", "same", "fp", "draws", "sketch", "short", "size"])

    made = docs.mapInArrow(giving_back(each), "row long, doc_id long, same long, fp long, draws array<long>, sketch array<long>, short array<int>, size int")
    with few_rows(made.sparkSession):
        made = settled(made, "sketches")
    own = made.groupBy("same").agg(F.min("row").alias("row"))
    distinct = made.select("row", "same", "fp", "draws").join(own, ["same", "row"], "left_semi").dropDuplicates(["row"])
    distinct = settled(distinct.select("row", "fp", "draws"), "distinct")

    def some_sketches(rows: DataFrame, which: str = "sketch") -> DataFrame:
        """The sketches of rows that pass a sieve of ``rows``: of these, and of few others; repeated rows stay."""
        return sieved(made.select("row", which, "size"), F.col("row"), rows.select(F.col("row").alias("key"))).where("__maybe").drop("__maybe")

    def sketches_of(rows: DataFrame) -> DataFrame:
        """The sketches of some rows; the others' don't go through a shuffle."""
        return some_sketches(rows).join(rows, "row", "left_semi").dropDuplicates(["row"])

    def whole(batches):
        for batch in batches:
            for row, t in zip(batch.column("row").to_numpy(), batch.column("text").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([np.unique(shingle_hashes(t, words)).view(np.int64)], pa.list_(pa.int64()))], names=["row", "all"])

    def texts_of(rows: DataFrame) -> DataFrame:
        held = sieved(docs, F.col("row"), rows.select(F.col("row").alias("key"))).where("__maybe").drop("__maybe")
        return held.join(rows, "row", "left_semi").dropDuplicates(["row"]).mapInArrow(giving_back(whole), "row long, all array<long>")

    def sets_of(rows: DataFrame) -> DataFrame:
        """The whole sets of some rows; a sketch that holds all of its set is that set."""
        held = materialise(sketches_of(rows), "short")
        with few_rows(made.sparkSession):
            long = materialise(texts_of(held.where(F.col("size") > SKETCH).select("row")), "long")
        return held.where(F.col("size") <= SKETCH).select("row", F.col("sketch").alias("all")).unionByName(long)

    def check(pairs: DataFrame) -> DataFrame:
        """Pairs that hold for sure, and those in doubt: by short sketches first, and of what is left by long ones, in the JVM."""
        pairs = materialise(pairs, "pairs")
        settle(made.sparkSession)
        ends = lambda of: of.select(F.col("x").alias("row")).unionByName(of.select(F.col("y").alias("row")))
        short = some_sketches(ends(pairs), "short")
        near = not_far(pairs.join(short.toDF("x", "bx", "nx"), "x").join(short.toDF("y", "by", "ny"), "y"), least).select("x", "y")
        pairs, asked = settled(near, "near"), pairs
        release(asked)
        sketch = some_sketches(ends(pairs))
        both = pairs.join(sketch.toDF("x", "sx", "nx"), "x").join(sketch.toDF("y", "sy", "ny"), "y")
        both = with_similarity(both, least - MARGIN).select("x", "y", F.greatest("nx", "ny").alias("n"), "near")
        doubt = (F.abs(F.col("near") - least) < MARGIN) & (F.col("n") > SKETCH)
        return both.where(doubt | (F.col("near") >= least)).select("x", "y", (~doubt).alias("sure"))

    found = settled(_found_links(distinct, bits, least, sets_of, check).distinct(), "found")
    sure, doubt = found.where("sure").select("x", "y"), found.where("NOT sure").select("x", "y")
    stars = connected_components(sure)
    settle(made.sparkSession)
    if doubt.count():
        root = lambda end: stars.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
        apart = doubt.join(root("x"), "x", "left").join(root("y"), "y", "left").where(F.coalesce("rx", "x") != F.coalesce("ry", "y"))
        apart = settled(apart.select("x", "y"), "doubts")

        def exact(batches):
            for batch in batches:
                held = [similarity(np.sort(a), np.sort(b), len(a) + len(b)) >= least for a, b in zip(batch["ax"], batch["ay"], strict=True)]
                yield batch.loc[held, ["x", "y"]]

        asked = apart.select(F.explode(F.array("x", "y")).alias("row")).distinct()
        with few_rows(made.sparkSession):
            full = settled(texts_of(asked), "shingles")
        pairs = apart.join(full.toDF("x", "ax"), "x").join(full.toDF("y", "ay"), "y").mapInPandas(giving_back(exact), "x long, y long")
        stars = connected_components(sure.unionByName(pairs))
    rooted = own.join(stars.withColumnRenamed("node", "row"), "row", "left").select("same", F.coalesce("root", "row").alias("root"))
    return _spread_join(made.select("row", "doc_id", "same"), rooted, "same").select("row", "doc_id", "root").dropDuplicates(["row"])


def deduplicate(df: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each class the row with the smallest id stays, once."""
    classes = similar_classes(df, id, text, **options)
    stay = settled(classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("s")).select(F.col("s.row").alias("__row")), "stay")
    keyed = df.withColumn("__row", F.xxhash64(F.struct(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))))
    once = Window.partitionBy("__row").orderBy("__row")
    kept = keyed.join(stay, "__row", "left_semi").withColumn("__n", F.row_number().over(once)).where("__n = 1")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
