"""Sharding by balanced label propagation, in DataFrame functions only.

Law `rows`: shard counts are at most one apart. Rows with equal texts are one vertex (of a hot text, a vertex for each piece), and
different texts that hold the same long line are linked. Each round, links pass their vertices' shards on by joins, and a vertex moves
towards the shard that most of its links are in, under the shards' quotas. Rows without links fill the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowlark.llm.common import bound_for, checkpointed, hot_pieces, join_unique, partitions, small, text_of

#: Hash buckets in which movers to a shard are admitted, and rows that one ranking window takes.
ADMIT, RANKED = 1024, 20_000
#: Characters from which a line links the texts that hold it.
LINE = 40


def _ranked(df: DataFrame, group: str, lead: str, salt: str, ties: list[Column], name: str, rows: int, groups: int) -> DataFrame:
    """df plus `name`: the rank from 0 in its group, ordered by (lead, hash bucket of salt, salt, ties), gapless.

    Buckets are ranked each for itself and placed by a running sum of their counts, so no task sorts a whole group.
    """
    buckets = max(1, rows // RANKED, partitions(df.sparkSession) // groups)
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(salt)), F.lit(buckets)))
    counts = checkpointed(cut.groupBy(group, lead, "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(group).orderBy(lead, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, lead, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, lead, "_bucket").orderBy(salt, *ties)
    return (
        cut.join(small(offsets), [group, lead, "_bucket"])
        .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("long"))
        .drop("_bucket", "_offset")
    )


def shared_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """(text, line, n): hashes of texts and of the lines of at least LINE characters that n different texts hold, n over 1."""
    text = text_of(text_col)
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.char_length(x) >= LINE), lambda x: F.xxhash64(x)))
    held = checkpointed(docs.select(F.xxhash64(F.sha2(text, 256)).alias("text"), F.explode(lines).alias("line")).distinct())
    counts = checkpointed(held.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return checkpointed(join_unique(held, counts, "line", bound_for(held.count(), docs.sparkSession), "inner").select("text", "line", "n"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, rounds: int = 3, report: list | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 16, shard is 0 to shards - 1, and slot counts the rows of a shard
    from 0 without gaps. law is `rows`, so grown_shard is null. A text with more rows than a quarter of a shard or
    of rows / (4 x partitions) is a chain of pieces, dealt by the rows' places in the input, which start on neighbouring shards; each
    piece is one vertex. Empty and null texts are equal to each other. Repeated rows are rows like others, null ids too; very long texts
    are rows of their size, whose lines link like others'; an empty table gives an empty result. Other columns are ignored.

    report gets the number of cut links before each round and at the end: of each line, its texts outside the shard that holds most.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"), F.monotonically_increasing_id().alias("_place"))
    return _placed(raw, shared_lines(docs, text_col), shards, rounds, report).drop("_place")


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, rounds: int = 3) -> DataFrame:
    """docs, each row with its shard and slot as in shard(). If docs has columns of these names, the new ones end in underscores.

    Rows are written to the shared folder once with a number of their own, by which they meet their places again: rows repeated in all
    columns stay as many as they are.
    """
    names = docs.columns
    own = docs.toDF(*(f"_column{k}" for k in range(len(names)))).withColumn("_place", F.monotonically_increasing_id())
    own = checkpointed(own)
    text = f"_column{names.index(text_col)}"
    raw = own.select(F.col(f"_column{names.index(id_col)}").alias("doc_id"), text_of(text).alias("_text"), "_place")
    placed = _placed(raw, shared_lines(own, text), shards, rounds, None).select("_place", "shard", "slot")
    new = [next(n for n in (c + "_" * k for k in range(len(names) + 1)) if n not in names) for c in ("shard", "slot")]
    return own.join(placed, "_place").drop("_place").toDF(*names, *new)


def _placed(raw: DataFrame, lines: DataFrame, shards: int, rounds: int, report: list | None) -> DataFrame:
    spark = raw.sparkSession
    raw = raw.select(
        "doc_id",
        "_place",
        (F.octet_length("_text") + 16).cast("long").alias("size"),
        F.crc32(F.encode("_text", "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.sha2("_text", 256)).alias("_key"),
    )
    raw = checkpointed(raw.withColumn("_h", F.xxhash64("doc_id", "_key", "_place")))
    n = raw.count()
    low, over = divmod(n, shards)
    bound = max(1, min(bound_for(n, spark), max(1, low // 4)))
    hot = checkpointed(hot_pieces(raw.select("_key"), "_key", bound))
    run = max(1, low // bound)
    rows = raw.join(small(hot), "_key", "left").withColumn("_piece", F.coalesce(F.expr("cast(pmod(_h, _pieces) as int)"), F.lit(0)))
    rows = rows.withColumn("_v", F.xxhash64("_key", "_piece"))
    chain = F.pmod(F.xxhash64("_key") + F.floor(F.col("_piece") / F.lit(run)), F.lit(shards))
    start = F.when(F.col("_pieces").isNotNull(), chain).otherwise(F.pmod(F.col("_v"), F.lit(shards))).cast("int")
    vertices = checkpointed(rows.groupBy("_v", "_key", start.alias("shard")).agg(F.count(F.lit(1)).alias("_n")))
    rows = checkpointed(rows.select("doc_id", "_place", "size", "text_crc32", "_h", "_v"))
    links = checkpointed(vertices.select("_v", "_key").join(lines, F.col("_key") == F.col("text")).select("_v", "line", "n"))
    has = links.select("_v").distinct().withColumn("_has", F.lit(1))
    single = F.when((F.col("_n") > 1) | (F.col("_has") == 1), 0).otherwise(1)
    vertices = checkpointed(vertices.join(has, "_v", "left").select("_v", "_n", "shard", single.alias("_single")))
    labels = vertices.where("_single = 0").select("_v", "_n", "shard")
    if links.limit(1).count():
        for _ in range(rounds):
            if report is not None:
                report.append(cut_links(labels, links))
            labels = _round(labels, links, low, shards, bound_for(links.count(), spark))
    if report is not None:
        report.append(cut_links(labels, links))
    labels = labels.select("_v", "shard", F.lit(0).alias("_single")).unionByName(vertices.where("_single = 1").select("_v", "shard", "_single"))
    rows = rows.join(labels, "_v")
    quota = low + (F.col("shard") < over).cast("long")
    rows = rows.withColumn("_salt", F.when(F.col("_single") == 1, F.col("_h")).otherwise(F.col("_v")))
    ties = [F.col("_h"), F.col("doc_id")]
    ranked = checkpointed(_ranked(checkpointed(rows), "shard", "_single", "_salt", ties, "_rank", n // shards, shards).withColumn("_out", (F.col("_rank") >= quota).cast("int")))
    # Shards are few: their free places are one literal array, and a released row's rank finds its shard there.
    kept = {r["shard"]: r["n"] for r in ranked.where("_out = 0").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, at = [], 0
    for s in range(shards):
        at += low + (s < over) - kept.get(s, 0)
        places.append(F.lit(at).cast("long"))
    out = ranked.where("_out = 1").withColumn("_all", F.lit(0))
    out = _ranked(out, "_all", "_single", "_salt", ties, "_to", at, 1)
    filled = F.size(F.filter(F.array(*places), lambda x: x <= F.col("_to"))).cast("int")
    names = ["doc_id", "_place", "size", "text_crc32", "_h", "_single", "_salt"]
    final = checkpointed(ranked.where("_out = 0").select(*names, "shard").unionByName(out.select(*names, filled.alias("shard"))))
    return _ranked(final, "shard", "_single", "_salt", ties, "slot", n // shards, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "_place"
    )


def _by_line(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(line, n, shard, _c): how many of a line's vertices are in each shard, combined before the shuffle."""
    return links.join(labels.select("_v", "shard"), "_v").groupBy("line", "n", "shard").agg(F.count(F.lit(1)).alias("_c"))


def cut_links(labels: DataFrame, links: DataFrame) -> int:
    """Links cut by labels (_v, shard): of each line, its vertices outside the shard that holds most of them."""
    most = _by_line(labels, links).groupBy("line").agg(F.max("_c").alias("_c"))
    return links.count() - (most.agg(F.sum("_c")).first()[0] or 0)


def _loads(rows: DataFrame, by: str) -> dict[int, int]:
    """Rows of each shard; shards are few."""
    return {r[by]: r["n"] for r in rows.groupBy(by).agg(F.sum("_n").alias("n")).collect()}


def _round(labels: DataFrame, links: DataFrame, quota: int, shards: int, bound: int) -> DataFrame:
    """One round: each line passes on the shard that holds most of its vertices, among those that aren't full, a vertex asks for the
    shard that its lines name most, each weighed by one over its number of texts, and shards admit what their quota leaves. Links of lines
    with over `bound` texts stay where they are and are told by broadcast, as such lines are few.

    Movers to a shard are admitted by buckets of the vertex hash, whole buckets at a time, up to the quota less the linked
    rows that stay there. Vertices that aren't admitted stay and ask again in the next round.
    """
    full = [s for s, n in _loads(labels, "shard").items() if n >= quota]
    top = F.max(F.struct("_c", F.xxhash64("line", "shard").alias("h"), "shard")).alias("_top")
    best = _by_line(labels, links).where(~F.col("shard").isin(full)).groupBy("line", "n").agg(top).select("line", "n", F.col("_top.shard").alias("_best"))
    wide = links.where(F.col("n") > bound).drop("n").join(F.broadcast(best.where(F.col("n") > bound)), "line")
    told = links.where(F.col("n") <= bound).drop("n").join(best.where(F.col("n") <= bound), "line").unionByName(wide)
    votes = told.groupBy("_v", "_best").agg(F.sum(1 / F.col("n")).alias("_w"))
    asked = votes.groupBy("_v").agg(F.max(F.struct(F.round("_w", 9).alias("w"), F.xxhash64("_v", "_best").alias("h"), "_best")).alias("_top")).select("_v", F.col("_top._best").alias("_target"))
    moving = labels.join(asked, "_v", "left").withColumn("_target", F.coalesce("_target", "shard")).withColumn("_bucket", F.pmod(F.xxhash64("_v"), F.lit(ADMIT)))
    moving = checkpointed(moving)
    stay = _loads(moving.where("shard = _target"), "_target")
    room = F.element_at(F.lit([quota - stay.get(s, 0) for s in range(shards)]), F.col("_target") + 1)
    demand = moving.where("shard <> _target").groupBy("_target", "_bucket").agg(F.sum("_n").alias("_want"))
    upto = Window.partitionBy("_target").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    admitted = demand.withColumn("_upto", F.sum("_want").over(upto)).where(F.col("_upto") <= room).select("_target", "_bucket", F.lit(1).alias("_in"))
    moved = moving.join(F.broadcast(admitted), ["_target", "_bucket"], "left")  # ADMIT rows for each shard at most
    return checkpointed(moved.select("_v", "_n", F.when(F.col("_in") == 1, F.col("_target")).otherwise(F.col("shard")).alias("shard")))
