"""Operator 3, resharding by minimum-cost flow.

Documents stand in the files of old shards. Every old shard is cut into hash blocks, which lie in its files in order; only
the sizes of the blocks come to the driver (n_shards x blocks rows at most). A minimum-cost flow from old sizes to new
capacities, where a byte that stays is free and a byte that moves costs one, fixes how many bytes go from each old to each
new shard. Whole blocks follow the flow: those that stay are taken file by file, so that the blocks that leave fill
whole files but for one; the others are dealt out largest first. A file none of whose blocks leaves stays where it is; only
files with a block that moves are read and written anew, from one shuffle.

A row's slot is its rank in its block and the block's first slot in its shard, so that a file that stays need not know of
blocks that come or go around it.

Law: `bytes` (sizes near equal). Cases: null text has size 1 and crc32 of no bytes; a null doc_id is hashed like any
other value; repeated rows each get a slot of their own; an old shard outside of 0..n_shards-1 counts modulo n_shards, a
null one as 0; a block whose rows are one repeated doc_id is moved whole; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, new_dir, partitions, table

SHARDS = 16
BLOCKS = 2048
FILES = 32  # of each old shard


def min_cost_flow(supply: list[int], capacity: list[int], cost=None) -> list[list[int]]:
    """flow[i][j] of least cost that ships all supply within the capacities; successive shortest paths with potentials.

    cost(i, j) >= 0 a byte; by default 0 to stay (i == j) and 1 to move.
    """
    n, m = len(supply), len(capacity)
    cost = cost or (lambda i, j: int(i != j))
    assert sum(supply) <= sum(capacity), "capacities are too small"
    # nodes: 0 source, 1..n old, n+1..n+m new, n+m+1 sink
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def edge(u, v, cap, c):
        graph[u].append([v, cap, c, len(graph[v])])
        graph[v].append([u, 0, -c, len(graph[u]) - 1])

    sink = n + m + 1
    for i, s in enumerate(supply):
        edge(0, 1 + i, s, 0)
        for j in range(m):
            edge(1 + i, 1 + n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        edge(1 + n + j, sink, c, 0)
    height = [0] * len(graph)
    while True:
        dist: list[float] = [float("inf")] * len(graph)
        came: list = [None] * len(graph)
        dist[0], queue = 0, [(0, 0)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for k, (v, cap, c, _) in enumerate(graph[u]):
                if cap > 0 and (w := d + c + height[u] - height[v]) < dist[v]:
                    dist[v], came[v] = w, (u, k)
                    heapq.heappush(queue, (w, v))
        if came[sink] is None:
            break
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, dist)]
        push, v = float("inf"), sink
        while v:
            u, k = came[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v:
            u, k = came[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    return [[graph[1 + n + j][next(k for k, e in enumerate(graph[1 + n + j]) if e[0] == 1 + i)][1] for j in range(m)] for i in range(n)]


def deal_blocks(blocks: list[tuple[int, int, int]], n_shards: int) -> dict[tuple[int, int], int]:
    """blocks: (old shard, block, bytes). Returns the new shard of each block.

    Along the least-cost flow: blocks that stay in order of their number, then those that move, largest first; the rest of
    a block's error goes to the emptiest shard.
    """
    total = sum(b for _, _, b in blocks)
    supply = [0] * n_shards
    for s, _, b in blocks:
        supply[s] += b
    capacity = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    flow = min_cost_flow(supply, capacity)
    room, out = capacity[:], {}

    def put(s, k, b, j):
        out[s, k] = j
        flow[s][j] = max(0, flow[s][j] - b)
        room[j] -= b

    for s, k, b in sorted(blocks):
        if flow[s][s] >= b and room[s] >= b:
            put(s, k, b, s)
    for s, k, b in sorted((x for x in blocks if (x[0], x[1]) not in out), key=lambda x: (-x[2], x[0], x[1])):
        # the largest remaining flow that it fits; a block that fits no flow goes where there is most room
        fits = [j for j in range(n_shards) if flow[s][j] >= b and room[j] >= b]
        put(s, k, b, max(fits, key=lambda j: (flow[s][j], -j)) if fits else max(range(n_shards), key=lambda j: (room[j], j == s, -j)))
    return out


def _blocks(docs: DataFrame, doc_id, text, old: Column, n_shards: int, blocks: int, files: int) -> DataFrame:
    """doc_id, text, size, old_shard, block and file of every row."""
    d = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.pmod(old.cast("int"), F.lit(n_shards)), F.lit(0)).alias("old_shard"), F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("long")), F.lit(blocks)).cast("int").alias("block"))
    return d.withColumn("file", F.floor(F.col("block") * files / blocks).cast("int"))


def write_old(docs: DataFrame, path: str, doc_id="doc_id", text="text", old_shard: Column | None = None, n_shards: int = SHARDS, blocks: int = BLOCKS, files: int = FILES) -> None:
    """The files `path/old_shard=i/file=k/` of the old shards, by default the hash of the source."""
    old = F.pmod(F.xxhash64("source"), F.lit(n_shards)) if old_shard is None else old_shard
    d = _blocks(docs, doc_id, text, old, n_shards, blocks, files)
    # a task for each file and no more, a large file's rows one after the other
    d.repartition(partitions(docs.sparkSession), "old_shard", "file").write.partitionBy("old_shard", "file").option("compression", "zstd").parquet(path)


OLD = "doc_id long, text string, size long, block int, old_shard int, file int"


def read_old(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OLD).parquet(path)


def plan(old: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """old_shard, block, file, shard, first_slot, bytes, moved and rewritten (the block's file has a block that moves), a row for each block."""
    spark = old.sparkSession
    sizes = old.groupBy("old_shard", "block", "file").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # n_shards x blocks rows at most
    new = deal_blocks([(r["old_shard"], r["block"], r["b"]) for r in sizes], n_shards) if sizes else {}
    touched = {(r["old_shard"], r["file"]) for r in sizes if new[r["old_shard"], r["block"]] != r["old_shard"]}
    start, rows = [0] * n_shards, []
    for r in sorted(sizes, key=lambda r: (new[r["old_shard"], r["block"]], r["old_shard"], r["block"])):
        j = new[r["old_shard"], r["block"]]
        rows.append((r["old_shard"], r["block"], r["file"], j, start[j], r["b"], j != r["old_shard"], (r["old_shard"], r["file"]) in touched))
        start[j] += r["n"]
    return spark.createDataFrame(rows, "old_shard int, block int, file int, shard int, first_slot long, bytes long, moved boolean, rewritten boolean")


def report(blocks: DataFrame) -> DataFrame:
    """One row: bytes, moved_bytes, rewritten_bytes, files and rewritten_files of a plan."""
    files = F.struct("old_shard", "file")
    return blocks.agg(F.sum("bytes").alias("bytes"), F.coalesce(F.sum(F.when(F.col("moved"), F.col("bytes"))), F.lit(0)).alias("moved_bytes"), F.coalesce(F.sum(F.when(F.col("rewritten"), F.col("bytes"))), F.lit(0)).alias("rewritten_bytes"),
        F.countDistinct(files).alias("files"), F.countDistinct(F.when(F.col("rewritten"), files)).alias("rewritten_files"))


def rewrite(old: DataFrame, blocks: DataFrame, path: str) -> None:
    """Writes `path/shard=j/`, the rows of the files that have a block that moves; no other file is read."""
    n = partitions(old.sparkSession)
    hit = old.join(F.broadcast(blocks.where("rewritten").select("old_shard", "file").distinct()), ["old_shard", "file"])
    d = hit.join(F.broadcast(blocks.select("old_shard", "block", "shard")), ["old_shard", "block"]).select("doc_id", "text", "size", "block", "old_shard", "file", "shard")
    d.repartition(n, "shard", "old_shard", "file").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, old_path: str, new_path: str, blocks: DataFrame) -> DataFrame:
    """The new shards from the files that stayed and those that were rewritten: doc_id, text, size, old_shard, block, shard and slot."""
    files = blocks.select("old_shard", "file", "rewritten").distinct()
    stayed = read_old(spark, old_path).join(F.broadcast(files.where("not rewritten").drop("rewritten")), ["old_shard", "file"]).withColumn("shard", F.col("old_shard"))
    every = stayed.select("doc_id", "text", "size", "block", "old_shard", "shard")
    if not blocks.where("rewritten").isEmpty():
        every = every.union(spark.read.schema(OLD + ", shard int").parquet(new_path).select("doc_id", "text", "size", "block", "old_shard", "shard"))
    return every.join(F.broadcast(blocks.select("old_shard", "block", "first_slot")), ["old_shard", "block"])


def reshard(docs: DataFrame, path: str, doc_id="doc_id", text="text", old_shard: Column | None = None, n_shards: int = SHARDS, blocks: int = BLOCKS, files: int = FILES) -> tuple[DataFrame, DataFrame]:
    """The plan and the rows of the new shards, whose files lie below path. A row has first_slot of its block, to which its rank in the block adds."""
    spark = docs.sparkSession
    write_old(docs, f"{path}/old", doc_id, text, old_shard, n_shards, blocks, files)
    old = read_old(spark, f"{path}/old")
    p = cut(plan(old, n_shards), "plan")
    rewrite(old, p, f"{path}/new")
    return p, read_shards(spark, f"{path}/old", f"{path}/new", p)


def with_slots(rows: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and old_shard: the texts stay behind before rows are ranked within their blocks."""
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    d = rows.select("doc_id", size, crc, "old_shard", "block", "shard", "first_slot")
    w = Window.partitionBy("old_shard", "block").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32")
    return d.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.row_number().over(w) - 1).alias("slot"), "old_shard")


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places all documents in 16 shards, rewrites the files that this touches and reads the digest columns back from all."""
    _, rows = reshard(table(spark, sf_dir, "documents"), new_dir(spark, "shards"))
    return with_slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
