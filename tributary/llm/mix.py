"""Mixing sources to target weights, in DataFrame functions only.

Sources get targets in words; Sainte-Lague apportionment turns the targets into whole blocks of equally many
words, first among the sources and then among each source's shards. A shard lays its documents out in a seeded
order and takes that many blocks from it, whole passes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, hinted

WORD = r"[^\x20\x09-\x0D]+"
#: Shards of a source at least, and rows that a shard has at most when one source has them all.
SHARDS, SHARD_ROWS = 256, 50_000
BLOCK = 16


def n_words(text: Column) -> Column:
    """Words of a text: runs of characters other than a space and U+0009 to U+000D. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """Rows (no_source, source, source_size) to the same with target: source_size's sum times share, dealt by weight.

    Sources are taken by code point, null last, and weigh `weights` in turn. A target stops at cap times its
    source's size; the excess goes to the others by weight until none is above. Sorted by size per weight, the
    capped sources come first, so running sums find them; quotients are compared as whole-number products.
    There is one row per source, not per document.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("no_source", "source")
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (k + 1).cast("int"))
    t = sources.withColumn("w", w).withColumn("all2", F.sum("source_size").over(Window.partitionBy(F.lit(0))) * share[0]).withColumn("most", F.col("source_size") * share[1] * cap)
    # everything is share[1] times as large, so that it stays whole
    by = Window.partitionBy(F.lit(0)).orderBy((F.col("source_size") / F.col("w")), "no_source", "source")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("left", F.col("all2") - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(after))
    big = "decimal(38,0)"
    t = t.withColumn("capped", F.col("most").cast("decimal(19,0)") * F.col("w_left").cast("decimal(18,0)") <= F.col("left").cast("decimal(19,0)") * F.col("w").cast("decimal(18,0)"))
    t = t.withColumn("left", F.min(F.when(~F.col("capped"), F.struct(F.expr("-w_left"), "left"))).over(Window.partitionBy(F.lit(0))))
    free = (F.col("left.left") * F.col("w")).cast("double") / (-F.col("left.col1") * share[1]).cast("double")
    return t.select("no_source", "source", "source_size", F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(free).alias("target"))


def sainte_lague(t: DataFrame, group: list[str], key: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Adds out: the seats that each row of t gets of its group's `seats`, by highest quotients weight / (2 s + 1).

    Rounding all shares at one divisor is an apportionment by this method for the seats it happens to give; the
    few seats by which that is off, half of the rows at most, then go to (or come from) the highest (lowest)
    quotients. So no quotient is listed for most seats. Of equal quotients the first key's is the higher. Rows of
    weight 0 get none, and with no weight at all nobody gets any.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    whole = F.sum(weight).over(g)
    share = F.when(whole > 0, F.col(weight) / whole * F.col(seats)).otherwise(0.0)
    t = t.withColumn("_q", F.floor(share + 0.5).cast("long"))
    t = t.withColumn("_off", (F.col(seats) - F.sum("_q").over(g)).cast("int"))
    # n seats more (or less) dealt by the same divisor are enough for any rounding, so a row lists its part of 2 n at most
    n = F.count("*").over(g)
    reach = lambda extra: F.when(whole > 0, F.floor(F.col(weight) / whole * (F.col(seats) + extra) + 0.5)).otherwise(0).cast("long")
    t = t.withColumn("_hi", F.least(reach(n), F.col("_q") + F.greatest("_off", F.lit(0)))).withColumn("_lo", F.greatest(reach(-n), F.col("_q") + F.least("_off", F.lit(0)), F.lit(0).cast("long")))
    more = F.when(F.col(weight) > 0, F.expr("case when _off > 0 and _hi > _q then sequence(_q, _hi - 1) when _off < 0 and _q > _lo then sequence(_q - 1, _lo, -1L) else array() end")).otherwise(F.expr("array()").cast("array<bigint>"))
    cand = t.select(*group, *key, "_off", F.explode(more.cast("array<bigint>")).alias("_s"), F.col(weight).alias("_w")).withColumn("_quot", F.col("_w") / (2 * F.col("_s") + 1))
    high = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("_quot"), *key, "_s")
    low = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_quot", *[F.desc(c) for c in key], F.desc("_s"))
    won = cand.withColumn("_r", F.when(F.col("_off") > 0, F.row_number().over(high)).otherwise(F.row_number().over(low))).where("_r <= abs(_off)").groupBy(*group, *key).agg(F.sum(F.signum("_off")).cast("long").alias("_more"))
    return t.join(won, [*group, *key], "left").withColumn(out, F.col("_q") + F.coalesce("_more", F.lit(0))).drop("_q", "_off", "_more", "_hi", "_lo")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2, block: int = BLOCK, shards: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of each document, repeats counted.

    Returns id, source, size, source_size, target and taken; taken is at most cap * size, and a document at the
    end of what its shard takes may be taken in part. Null texts have no words; a null source is a source of
    its own, the last one. Null ids are dealt like the id 'null'; rows with one id are dealt by their text's
    MD5 too, and equal rows one after the other. Other columns are ignored; an empty table gives no rows. A
    source's words are its target, rounded.

    Shards are dealt by the id's MD5 within each source, so that a large source has `shards` windows; as default
    there are as many as keep a window below SHARD_ROWS or so. Texts are read once: a table of sizes is kept in the shared folder, and only that is sorted.
    """
    ws = Workspace(docs.sparkSession, "mix")
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(docs[id_col].cast("string"), F.lit("null"))))
    text = F.coalesce(docs[text_col], F.lit(""))
    slim = docs.select(docs[id_col].alias("id"), docs[source_col].isNull().alias("no_source"), F.coalesce(docs[source_col], F.lit("")).alias("source"), n_words(text).alias("size"), digest.alias("digest"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    slim = ws.keep(slim, "sizes")
    shards = shards or max(SHARDS, -(-slim.count() // SHARD_ROWS))
    slim = slim.withColumn("shard", F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int"))
    src = ["no_source", "source"]
    by_shard = ws.keep(slim.groupBy(*src, "shard").agg(F.sum("size").alias("shard_size")), "shards")
    goal = targets(by_shard.groupBy(*src).agg(F.sum("shard_size").alias("source_size")), weights, share, cap)
    goal = goal.withColumn("_seats", F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block + 0.5).cast("long"))
    goal = ws.keep(sainte_lague(goal, [], src, "target", "_seats", "blocks"), "targets")
    quota = sainte_lague(by_shard.join(goal, src), src, ["shard"], "shard_size", "blocks", "quota")
    quota = quota.withColumn("words", F.least(F.col("quota") * block, F.col("shard_size") * cap))
    # what caps and whole blocks leave of the target goes to the source's next shards with room, or comes from them
    off = F.round(F.col("target")).cast("long") - F.sum("words").over(Window.partitionBy(*src))
    before = Window.partitionBy(*src).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    quota = quota.withColumn("off", off).withColumn("room", F.when(F.col("off") > 0, F.col("shard_size") * cap - F.col("words")).otherwise(F.col("words")))
    moved = F.greatest(F.least(F.abs("off") - F.coalesce(F.sum("room").over(before), F.lit(0)), F.col("room")), F.lit(0))
    quota = ws.keep(quota.select(*src, "shard", "shard_size", "source_size", "target", (F.col("words") + F.signum("off").cast("long") * moved).alias("words")), "quotas")
    order = Window.partitionBy(*src, "shard").orderBy("digest", "crc", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = slim.withColumn("end", F.sum("size").over(order))
    got = laid.join(quota, [*src, "shard"])
    passes = F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(F.lit(0)).cast("long")
    rest = F.when(F.col("shard_size") > 0, F.expr("words % shard_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    return got.select(F.col("id").alias(id_col), F.when(F.col("no_source"), F.lit(None)).otherwise(F.col("source")).alias("source"), "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document as often as the mix takes at least half of it, whole.

    The mix cuts a document only at the end of a shard's share. Rounding such a document to whole repeats keeps
    every text whole. Documents without words stay once. taken: id, size, taken.
    """
    ws = Workspace(docs.sparkSession, "times")
    n = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1)).cast("int")
    times = ws.keep(taken.select(F.col(id_col).alias("_id"), n.alias("_n")).dropDuplicates(["_id"]).where("_n <> 1"), "times")
    n = F.coalesce(times["_n"], F.lit(1))
    out = docs.join(hinted(times), docs[id_col].eqNullSafe(times["_id"]), "left").where(n > 0)
    return out.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), n)).alias("_copy")).select(*[docs[c] for c in docs.columns])
