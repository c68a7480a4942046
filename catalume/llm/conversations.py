"""Repair of conversations: the cheapest edits that make the turns legal, with an audit of them.

A legal conversation is empty, or a system turn or none, followed by pairs of a user's and an assistant's
turn; roles are told by their first letter. Each turn may be kept, deleted or given another role, and empty
turns of a user or an assistant may be inserted anywhere. Blank and repeated turns must be deleted; one that
is cut off may stay at a price. Of the cheapest sequences of edits the one with the ASCII-least audit (a letter
an edit: D, I, K, R) is taken.

The grammar has four states: nothing yet, after a system, a user's, an assistant's turn. Turns are dealt by
hash of conversation and stretch into batches, and in each batch one recursive DuckDB query advances all its
stretches by one turn a step, holding the least (cost, audit) for each state. The audit decides the states, so
of two audits of equal cost in one state none begins with the other, and the least one stays least whatever
follows.

A stretch is at most ``STRETCH`` turns in a row, so a conversation of any length is shared out: rows are put in
one range-partitioned order (conversation, turn), and a stretch is what falls in one block of that order. For a
stretch that may not be a conversation's first all four states are tried as the start, and stretches are joined
pairwise, in a number of rounds that grows with the logarithm of their number. Only keys, roles and hashes take
part in this. Texts are shuffled once, for the repaired turns: sorted by conversation, they stream past their
audit, and nothing but the audit is held.

Edge cases: null values count as one space, but a null turn sorts first and is left out of gaps; rows of equal
turn come by role, then by hash of the text; rows without an id are one conversation; equal rows are repeated
turns; a conversation without a turn has no row here; texts of any length are taken whole; other columns are not
read; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Turns of a stretch (a power of two), and rows of a batch.
STRETCH, BATCH = 256, 65_536
_BLANKS = " \t\n\x0b\x0c\r"

#: Edits by state: (state, letter, first letter asked for, cost, state after); and runs of insertions before one.
_RULES = """
    moves(state, letter, ini, cost, after) AS (VALUES
        (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3), (3, 'K', 'u', 0, 2),
        (0, 'R', NULL, 2, 2), (1, 'R', NULL, 2, 2), (2, 'R', NULL, 2, 3), (3, 'R', NULL, 2, 2),
        (0, 'D', NULL, 3, 0), (1, 'D', NULL, 3, 1), (2, 'D', NULL, 3, 2), (3, 'D', NULL, 3, 3)),
    inserts(state, letters, cost, after) AS (VALUES
        (0, '', 0, 0), (1, '', 0, 1), (2, '', 0, 2), (3, '', 0, 3),
        (0, 'I', 2, 2), (1, 'I', 2, 2), (2, 'I', 2, 3), (3, 'I', 2, 2), (0, 'II', 4, 3), (1, 'II', 4, 3)),
    edits AS (
        SELECT i.state, m.letter, m.ini, i.cost + m.cost AS cost, i.letters || m.letter AS letters, m.after
        FROM inserts i JOIN moves m ON m.state = i.after)
"""

#: One recursion advances one turn of every stretch. ``g`` numbers the stretches of a batch, ``i`` their turns.
_WALK = """
    WITH RECURSIVE $RULES,
    turns AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY pos) - 1 AS i, pos, ini, gone, open FROM batch),
    starts AS (SELECT g, unnest(CASE WHEN min(pos) % $STRETCH = 0 THEN [0, 1, 2, 3] ELSE [0] END) AS start FROM turns GROUP BY g),
    walk(g, start, state, i, best) USING KEY (g, start, state) AS (
        SELECT g, start, start, 0, {'cost': 0::BIGINT, 'audit': ''} FROM starts
        UNION
        SELECT w.g, w.start, e.after, w.i + 1,
               min({'cost': w.best.cost + e.cost + CASE WHEN t.open AND e.letter <> 'D' THEN 1 ELSE 0 END, 'audit': w.best.audit || e.letters})
        FROM walk w JOIN turns t ON t.g = w.g AND t.i = w.i JOIN edits e ON e.state = w.state
        WHERE CASE WHEN t.gone THEN e.letter = 'D' ELSE e.ini IS NULL OR e.ini = t.ini END
        GROUP BY w.g, w.start, e.after, w.i),
    pairs AS (SELECT g, count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
        FROM (SELECT g, ini, lag(ini) OVER (PARTITION BY g ORDER BY i) AS before FROM turns) GROUP BY g),
    ends AS (SELECT g, arg_min(ini, i) AS first, arg_max(ini, i) AS last, min(pos) AS pos FROM turns GROUP BY g),
    ways AS (SELECT g, list({'start': start, 'state': state, 'cost': best.cost, 'audit': best.audit} ORDER BY start, state) AS ways FROM walk GROUP BY g)
    SELECT e.g, e.pos, e.first, e.last, p.illegal, w.ways FROM ends e JOIN pairs p USING (g) JOIN ways w USING (g) ORDER BY e.g
"""
_WAYS = "array<struct<start:int,state:int,cost:bigint,audit:string>>"


def _or_space(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(" "))


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with known faults, decided by a checksum of conversation and turn."""
    key = F.concat(_or_space(F.col("conv_id").cast("string")), F.lit(":"), _or_space(F.col("turn").cast("string")))
    kind, text = F.crc32(key.cast("binary")) % 20, _or_space("text")
    role = F.when(kind == 4, F.lit("user")).otherwise(_or_space("role"))
    told = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return df.where(kind != 0).select("conv_id", "turn", role.alias("role"), told.alias("text"), copies.alias("__copy")).drop("__copy")


def _keyed(df: DataFrame) -> DataFrame:
    """The rows with what decides their order and what they are told apart by."""
    df = df.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"))
    return df.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


_ORDER = ["conv_id", "turn", "role", "h1", "h2"]


def faults(df: DataFrame) -> DataFrame:
    """(conv_id, turn, at, ini, blank, duplicate, truncated) of each row; ``at`` orders all rows, conversations one after another."""
    ended = F.rtrim(F.col("text"), F.lit(_BLANKS))
    rows = _keyed(df).select(*_ORDER, (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("open"))
    rows = materialise(rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("at", F.monotonically_increasing_id()), "turns")
    first = rows.groupBy("conv_id", "role", "h1", "h2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    told = rows.join(first, "at", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    again = ~F.col("blank") & ~F.col("first")
    return told.select("conv_id", "turn", "at", F.left("role", F.lit(1)).alias("ini"), "blank", again.alias("duplicate"), (~F.col("blank") & F.col("first") & F.col("open")).alias("truncated"))


def _walked(batches, stretch: int):
    """Whole stretches in batches, each through one recursive query."""
    import duckdb

    walk = _WALK.replace("$RULES", _RULES).replace("$STRETCH", str(stretch))
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    held: list[pa.Table] = []

    def solved(table: pa.Table):
        """``table`` has whole stretches, in order."""
        at = table["at"].to_numpy()
        who = table["conv_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        new = np.r_[True, (at[1:] // stretch != at[:-1] // stretch) | (who[1:] != who[:-1])]
        con.register("batch", table.select(["at", "ini", "gone", "open"]).rename_columns(["pos", "ini", "gone", "open"]).append_column("g", pa.array(np.cumsum(new) - 1)))
        found = con.sql(walk).to_arrow_table()
        con.unregister("batch")
        conv = table["conv_id"].take(pa.array(np.flatnonzero(new)))
        for batch in found.drop(["g"]).add_column(0, "conv_id", conv).to_batches():
            yield batch

    def last_start(table: pa.Table) -> int:
        at, conv = table["at"].to_numpy(), table["conv_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        return int(np.flatnonzero((at // stretch == at[-1] // stretch) & (conv == conv[-1]))[0])

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= BATCH:
            table = pa.concat_tables(held)
            cut = last_start(table)
            held = [table.slice(cut)]
            if cut:
                yield from solved(table.slice(0, cut))
    if held:
        yield from solved(pa.concat_tables(held))


def _joined(a: Column, b: Column) -> Column:
    """Two stretches in a row as one."""
    through = F.flatten(
        F.transform(a["ways"], lambda x: F.transform(F.filter(b["ways"], lambda y: y["start"] == x["state"]), lambda y: F.struct(x["start"].alias("start"), y["state"].alias("state"), (x["cost"] + y["cost"]).alias("cost"), F.concat(x["audit"], y["audit"]).alias("audit"))))
    )
    ordered = F.array_sort(through)  # by start, state, cost, audit: the first of each start and state is the least
    least = F.filter(ordered, lambda w, i: (i == 0) | (F.get(ordered, i - 1)["start"] != w["start"]) | (F.get(ordered, i - 1)["state"] != w["state"]))
    odd = (~F.concat(a["last"], b["first"]).isin("su", "ua", "au")).cast("long")
    return F.struct(a["first"].alias("first"), b["last"].alias("last"), (a["illegal"] + b["illegal"] + odd).alias("illegal"), least.cast(_WAYS).alias("ways"))


def _one_stretch(parts: DataFrame) -> DataFrame:
    """(conv_id, part): the stretches of each conversation as one; pairs are joined until none is left."""
    parts = materialise(parts, "stretches")
    many = parts.groupBy("conv_id").agg(F.count("*").alias("n"))
    longest = many.agg(F.max("n")).first()[0] or 0  # one row
    told = _left(parts, many).select("conv_id", "pos", "n", F.struct("first", "last", "illegal", "ways").alias("part"))
    alone, more = told.where("n = 1").select("conv_id", "part"), told.where("n > 1")
    more = more.select("conv_id", "part", (F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")) - 1).alias("k"))
    while longest > 1:
        two = more.groupBy("conv_id", F.shiftright("k", 1).alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("two"))  # two at most
        both = F.when(F.size("two") == 1, F.col("two")[0]["part"]).otherwise(_joined(F.col("two")[0]["part"], F.get("two", F.lit(1))["part"]))
        more = materialise(two.select("conv_id", both.alias("part"), "k"), "stretches")
        longest = (longest + 1) // 2
    return alone.unionByName(more.select("conv_id", "part"))


def report(df: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has a turn.

    Counts are of turns whose first fault it is; ``gaps`` are turn numbers that are missing between others,
    ``illegal`` neighbours that may not follow each other.
    """
    told = materialise(faults(df), "faults")
    kind = dict(told.dtypes)["conv_id"]
    counted = told.groupBy("conv_id").agg(*[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    turns = told.where("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    steps = told.select("conv_id", "at", "ini", (F.col("blank") | F.col("duplicate")).alias("gone"), F.col("truncated").alias("open"))
    dealt = steps.repartition("conv_id", F.shiftright("at", stretch.bit_length() - 1)).sortWithinPartitions("at")
    parts = dealt.mapInArrow(lambda batches: _walked(batches, stretch), f"conv_id {kind}, pos long, first string, last string, illegal long, ways {_WAYS}")
    whole = _one_stretch(parts)
    close = F.transform(  # what is still to be inserted at the end, by state
        F.filter("part.ways", lambda w: w["start"] == 0),
        lambda w: F.struct((w["cost"] + F.element_at(F.array(*map(F.lit, (0, 4, 2, 0))), w["state"] + 1)).alias("cost"), F.concat(w["audit"], F.element_at(F.array(*map(F.lit, ("", "II", "I", ""))), w["state"] + 1)).alias("audit")),
    )
    best = whole.select("conv_id", F.col("part.illegal").alias("illegal"), F.array_min(close).alias("best"))
    out = _left(_left(best, counted), turns)
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))


def _left(many: DataFrame, one: DataFrame) -> DataFrame:
    """A left join on ``conv_id``, in which nulls are equal."""
    other = one.withColumnRenamed("conv_id", "__conv")
    return many.join(other, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")


def _replayed(batches):
    """Turns in order, each conversation's after its audit, as the audit leaves them."""
    audit, at, state, place, own = "", 0, 0, 0, None
    out: list[tuple] = []
    kind = None

    def write(role: str, text: str) -> None:
        nonlocal place
        out.append((own, place, role, text))
        place += 1

    def inserted() -> None:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state = 3 if state == 2 else 2
            write("assistant" if state == 3 else "user", "")
            at += 1

    def rows():
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, opens, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "opens", "audit", "role", "text")), strict=True):
            if opens:
                inserted()  # what is left of the one before
                own, audit, at, state, place = conv, edits, 0, 0, 0
                continue
            inserted()
            letter, at = audit[at], at + 1
            if letter == "D":
                continue
            state = 1 if letter == "K" and role[:1] == "s" else 3 if state == 2 else 2
            write(role if letter == "K" else "assistant" if state == 3 else "user", text)
        yield rows()
        out.clear()
    inserted()
    if out:
        yield rows()


def repaired(df: DataFrame, reported: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns that the audits of ``reported`` leave.

    Conversations are whole in a partition and in order, one after another.
    """
    kind = dict(df.dtypes)["conv_id"]
    turns = _keyed(df).withColumn("opens", F.lit(False)).withColumn("audit", F.lit(None).cast("string"))
    opens = reported.select("conv_id", "audit", F.lit(True).alias("opens"))
    both = turns.unionByName(opens, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("opens"), *_ORDER[1:])
    return dealt.select("conv_id", "opens", "audit", "role", "text").mapInArrow(_replayed, f"conv_id {kind}, place long, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns that ``repaired`` gives: ``role:text``, joined by newlines."""
    kind = dict(turns.dtypes)["conv_id"]

    def each(batches):
        own, digest, out, conv_type = None, None, [], None

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], conv_type), pa.array([d for _, d in out], pa.string())], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if digest:
                        out.append((own, digest.hexdigest()))
                    own, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if out:
                yield rows()
                out.clear()
        if digest:
            out.append((own, digest.hexdigest()))
            yield rows()

    return turns.mapInArrow(each, f"conv_id {kind}, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report and the digest of the repaired turns of every conversation, after known damage."""
    rows = damage(conversations)
    told = materialise(report(rows), "report")
    everyone = conversations.select("conv_id").distinct()
    out = _left(_left(everyone, told), digests(repaired(rows, told)))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
