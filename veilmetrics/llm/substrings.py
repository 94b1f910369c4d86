"""Operator 10, substring dedup by prefix-partitioned suffix trees.

A window is removed if its node at depth WINDOW of the corpus suffix tree has a leaf in a document with a smaller doc_id.
The tree is sparse, and is built in parts:

1. Suffixes. Of the prefixes (PREFIX words) that start within a window, the one of least hash marks the suffix that stands
   for it; equal windows choose the same one at the same offset, so a text keeps one suffix in about twenty words, with the
   words of all windows that chose it: its run. Prefixes that occur in one document only have no deep node and go.
2. Equal runs meet by the hashes of prefix and run (128 bits). One that a smaller document has too is removed whole; only
   the smallest document's goes on, so a passage that a third of all documents hold is one run from here.
3. Subtrees. Runs are dealt out by their prefix. A group of at most GROUP_BYTES is held in memory: the suffixes of its runs
   are sorted by prefix doubling over word numbers (words are compared, not hashed), the longest common prefixes of
   neighbours give the tree's internal nodes, and those at least WINDOW deep are the repeats. Windows that follow one
   another in a text make one maximal repeat.
4. Longer prefixes. Where a prefix has more runs than memory holds, its suffixes are dealt out anew by LONGER words, and
   what still has several documents by all WINDOW words: at that depth a group is one node, and its least document is an
   aggregate that is combined before its shuffle.

Cases: null text has no words; documents of fewer than WINDOW words lose nothing; rows with a null doc_id keep all and remove
nothing from others; repeated rows are treated alike and don't remove each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, plain, skewed_lookup, table
from .shingles import mix, powers, window_hashes, word_hashes, words_of

WINDOW, PREFIX, LONGER = 50, 12, 24
GROUP_BYTES, TREE_BYTES, BROADCAST_BYTES = 4_000_000, 1_000_000, 24_000_000
_ROOT = 0x9E3779B97F4A7C15


def runs(h: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes: for each run its first window, number of windows, prefix hash and run hash."""
    n = len(h) - window + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, e, e.astype(np.uint64), e.astype(np.uint64)
    p, wide = window_hashes(h, prefix), window - prefix + 1
    view = np.lib.stride_tricks.sliding_window_view(p, wide)
    chosen = np.concatenate([view[i : i + 100_000].argmin(1) + np.arange(i, min(n, i + 100_000)) for i in range(0, n, 100_000)])
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    count = np.diff(np.append(first, n))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(len(h), _ROOT), dtype=np.uint64)])
        back = powers(n, pow(_ROOT, -1, 1 << 64))[first]
        whole = mix((total[first + count - 1 + window] - total[first]) * back + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return first, count, p[chosen[first]], whole


_LONGS = pa.list_(pa.int64())
_INTS = pa.list_(pa.int32())


def _run_batches(batches):
    for big in batches:
        for at in range(0, big.num_rows, 500):
            b = big.slice(at, 500)
            keep, parts = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = words_of(text)
                if len(words) >= WINDOW:
                    keep.append(i)
                    parts.append(runs(word_hashes(words)))
            lists = [[x[0].astype(np.int32) for x in parts], [x[1].astype(np.int32) for x in parts], [x[2].view(np.int64) for x in parts], [x[3].view(np.int64) for x in parts]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64())), b.column("key").take(pa.array(keep, pa.int64())), *(pa.array(v, t) for v, t in zip(lists, (_INTS, _INTS, _LONGS, _LONGS)))], names=["doc_id", "key", "first", "n", "prefix", "run"])


def _runs_of(batches):
    """The words of the given runs."""
    for big in batches:
        for at in range(0, big.num_rows, 200):
            b = big.slice(at, 200)
            rows = []
            for doc_id, key, text, runs_ in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text", "runs"))):
                words = words_of(text)
                rows += [(r["prefix"], doc_id, key, r["first"], b" ".join(words[r["first"] : r["first"] + r["n"] + WINDOW - 1])) for r in runs_]
            made = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["prefix", "doc_id", "key", "first", "words"])


def suffix_array(x: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words as numbers from 1 and, for each, the end of its text: the suffixes in order of their first 128 words, and how many words each shares with the one before it (0 for the first)."""
    n = len(x)
    at, rank, levels, step = np.arange(n), x, [], 1
    while step <= 64:
        levels.append((step, rank.astype(np.int32)))
        then = np.where(at + step < end, rank[np.minimum(at + step, n - 1)], 0)
        rank = np.unique(rank * (int(then.max(initial=0)) + 1) + then, return_inverse=True)[1].reshape(-1) + 1
        step *= 2
    order = np.argsort(rank, kind="stable")
    i, j, common = order[1:].copy(), order[:-1].copy(), np.zeros(max(0, n - 1), np.int64)
    most = np.minimum(end[i] - i, end[j] - j)
    for step, rank in reversed(levels):
        same = (common < most) & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        common += step * same
        i += step * same
        j += step * same
    return order, np.concatenate([[0], np.minimum(common, most)])[:n]


def deep_nodes(order: np.ndarray, common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes below internal nodes of at least this depth, and for each the number of its topmost such node."""
    joined = common >= depth
    node = np.cumsum(~joined) - 1
    inner = joined | np.append(joined[1:], False)
    return order[inner], node[inner]


def _subtree(words: pa.Array, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (text, word) where a window starts that a text of a smaller doc_id has too."""
    lists = pc.split_pattern(words, b" ")
    size = pc.list_value_length(lists).to_numpy()
    ends = np.cumsum(size)
    x = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    of = np.repeat(np.arange(len(size)), size)
    at, node = deep_nodes(*suffix_array(x, ends[of]), WINDOW)
    least = np.full(int(node.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc_id[of[at]])
    gone = np.sort(at[least[node] < doc_id[of[at]]])
    return of[gone], gone - (ends - size)[of[gone]]


_SPANS = ("doc_id", "key", "a", "z")


def _subtree_batches(batches):
    """Rows come by prefix; whole groups are put together up to TREE_BYTES and make one tree. Gives the maximal repeats (doc_id, key, a, z)."""

    def spans(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        doc_id, key, first = (t.column(c).to_numpy() for c in ("doc_id", "key", "first"))
        text, at = _subtree(t.column("words").chunk(0), doc_id)
        begin = np.flatnonzero(np.diff(text, prepend=-1).astype(bool) | (np.diff(at, prepend=-2) != 1))  # windows that follow one another
        last = np.append(begin[1:], len(at))[: len(begin)] - 1
        r = text[begin]
        return pa.RecordBatch.from_arrays([pa.array(doc_id[r]), pa.array(key[r]), pa.array((first[r] + at[begin]).astype(np.int32)), pa.array((first[r] + at[last] + WINDOW).astype(np.int32))], names=list(_SPANS))

    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        prefix = b.column("prefix").to_numpy()
        if size >= TREE_BYTES:
            k = int(np.argmax(prefix != held[-1].column("prefix")[-1].as_py())) if prefix[0] == held[-1].column("prefix")[-1].as_py() else 0
            if k or prefix[0] != held[-1].column("prefix")[-1].as_py():
                yield spans([*held, b.slice(0, k)] if k else held)
                held, size, b = [], 0, b.slice(k)
        held.append(b)
        size += b.column("words").nbytes
    if held:
        yield spans(held)


def _suffix_batches(batches):
    """Every suffix of the runs that starts a window: the hash of its first LONGER words, and its window."""
    for big in batches:
        for at in range(0, big.num_rows, 100):
            b = big.slice(at, 100)
            rows = []
            for doc_id, key, first, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "first", "words"))):
                words = data.split(b" ")
                h = window_hashes(word_hashes(words), LONGER).view(np.int64).tolist()
                rows += [(h[i], doc_id, key, first + i, b" ".join(words[i : i + WINDOW])) for i in range(len(words) - WINDOW + 1)]
            made = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["longer", "doc_id", "key", "at", "window"])


def covered(n_words: int, spans) -> np.ndarray:
    """Which words lie in the spans (start, end)."""
    edge = np.zeros(n_words + 1, np.int64)
    for a, z in spans:
        edge[a] += 1
        edge[z] -= 1
    return np.cumsum(edge[:-1]) > 0


def _apply_batches(batches):
    for b in batches:
        rows = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            words = words_of(text)
            gone = covered(len(words), [(s["a"], s["z"]) for s in spans or ()])
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def repeats(docs: DataFrame) -> DataFrame:
    """Of (doc_id, key, text): doc_id, key, spans array<struct<a:int,z:int>>, the words to remove."""
    t = cut(docs.where("doc_id is not null").mapInArrow(_run_batches, "doc_id long, key long, first array<int>, n array<int>, prefix array<long>, run array<long>"), "runs")
    each = t.select("doc_id", "key", F.explode(F.arrays_zip("first", "n", "prefix", "run")).alias("r")).select("doc_id", "key", "r.*")
    many = each.groupBy("prefix").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("run").alias("r0"), F.max("run").alias("r1")).where("d0 < d1").select("prefix", (F.col("r0") < F.col("r1")).alias("branches"))
    shared = cut(skewed_lookup(each, many, ["prefix"]), "shared")
    owner = shared.groupBy("prefix", "run").agg(F.min("doc_id").alias("owner"))
    judged = cut(skewed_lookup(shared, owner, ["prefix", "run"]).where("owner < doc_id or branches").select("doc_id", "key", "first", "n", "prefix", (F.col("owner") < F.col("doc_id")).alias("gone")), "judged")
    whole = judged.where("gone").select("doc_id", "key", F.col("first").alias("a"), (F.col("first") + F.col("n") + (WINDOW - 1)).alias("z"))
    deeper = cut(judged.where("not gone").groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n", "prefix")).alias("runs")), "deeper")
    size = deeper.agg(F.sum(24 + 16 * F.size("runs"))).first()[0] or 0
    with_text = docs.join(F.broadcast(deeper) if size <= BROADCAST_BYTES else deeper.hint("shuffle_merge"), ["doc_id", "key"]).select("doc_id", "key", "text", "runs")
    suffixes = cut(with_text.mapInArrow(_runs_of, "prefix long, doc_id long, key long, first int, words binary"), "suffixes")
    return whole.union(_small_groups(suffixes)).union(_large_groups(suffixes)).groupBy("doc_id", "key").agg(F.collect_set(F.struct("a", "z")).alias("spans"))


def _large(suffixes: DataFrame) -> DataFrame:
    """Prefixes whose runs don't fit into memory: at most the bytes of all runs over GROUP_BYTES."""
    return suffixes.groupBy("prefix").agg(F.sum(F.octet_length("words")).alias("bytes")).where(F.col("bytes") > GROUP_BYTES).select("prefix")


def _small_groups(suffixes: DataFrame) -> DataFrame:
    n = partitions(suffixes.sparkSession)
    rest = suffixes.join(F.broadcast(_large(suffixes)), "prefix", "left_anti")
    return rest.repartition(n, "prefix").sortWithinPartitions("prefix").mapInArrow(_subtree_batches, "doc_id long, key long, a int, z int")


def _large_groups(suffixes: DataFrame) -> DataFrame:
    """Longer prefixes, by LONGER words and then by all of a window's."""
    every = cut(suffixes.join(F.broadcast(_large(suffixes)), "prefix", "left_semi").mapInArrow(_suffix_batches, "longer long, doc_id long, key long, at int, window binary"), "longer")
    many = every.groupBy("longer").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("longer")
    left = cut(skewed_lookup(every, many, ["longer"]).select("doc_id", "key", "at", "window"), "longer")
    node = left.groupBy("window").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("window", "d0")
    return skewed_lookup(left, node, ["window"]).where("d0 < doc_id").select("doc_id", "key", F.col("at").alias("a"), (F.col("at") + WINDOW).alias("z"))


def remove_repeats(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of every row."""
    d = plain(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("key", F.xxhash64("text"))
    spans = cut(repeats(d), "spans")
    return d.join(spans.hint("shuffle_merge"), ["doc_id", "key"], "left").select("doc_id", "text", "spans").mapInArrow(_apply_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
