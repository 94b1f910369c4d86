"""Operator 11, spelling variants by merging errata tries.

Words stand in a trie. Two words that differ by one edit part at one node: their common prefix. At every node the child
with the most words is heavy, the others (and a word that ends there) are light. Light subtrees are merged into the heavy
one with one character replaced, skipped or put in, and into each other with one replaced; where a terminal of a merged
subtree coincides with a terminal of the trie, the two words are one edit apart. A word is in a light subtree at log2(n)
nodes at most, so merging small into large looks up n log n strings. The trie is not built as objects: it is the sorted
array of its words, a node is a range of it and its subtrees are the ranges of equal next characters.

Spark spreads the trie: words are dealt out by prefix, lengthened step by step until a group has GROUP words at most, and
each group is a subtree that one task merges. The few nodes above these subtrees are merged by joins: each word posts, for
each depth above its subtree, itself with the character at that depth skipped. Equal posts of one depth are a replaced
character, a post that is a word is a skipped one.

A word is near another if they differ by one code point inserted, deleted or replaced. Its form is its near word of the
largest count, if that is `ratio` times its own count or more; forms are followed by pointer doubling.

Cases: null and empty texts have no words; a null doc_id is an empty string in the rule that deletes characters; repeated
rows count as often as they stand there; a word of any length is one word; an empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations, groupby
from os.path import commonprefix
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, plain, skewed_lookup, table

LEAST_LENGTH, LEAST_COUNT, RATIO, MODULUS = 7, 2, 10, 31
PREFIX, GROUP = 3, 4096
LETTERS = "a-z\u00c0-\u00ff"
_FLUSH = 50_000


def runs_of(least: int) -> re.Pattern:
    return re.compile(f"[{LETTERS}]{{{least},}}")


def words_of(text: str | None, doc_id: int | None, runs: re.Pattern, modulus: int = MODULUS, least: int = LEAST_LENGTH) -> Counter:
    """Words of a text with their counts, after the rule that deletes a character of every modulus-th (document, run)."""
    low = (text or "").encode("utf-8", "replace").lower().decode()  # bytes.lower() changes A-Z alone
    name = f"{'' if doc_id is None else doc_id}:"
    out: Counter = Counter()
    for run, n in Counter(runs.findall(low)).items():
        h = crc32((name + run).encode())
        if h % modulus == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def _count(modulus: int, least: int):
    def run(batches):
        total: Counter = Counter()
        runs = runs_of(least)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                total.update(words_of(text, doc_id, runs, modulus, least))
                if len(total) >= _FLUSH:
                    yield flush()
        yield flush()

    return run


def vocabulary(docs: DataFrame, doc_id="doc_id", text="text", least_count: int = LEAST_COUNT, modulus: int = MODULUS, least: int = LEAST_LENGTH) -> DataFrame:
    """word and n of the distinct words that occur often enough."""
    d = plain(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = d.mapInArrow(_count(modulus, least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def merged_pairs(words: list[str], depth: int = 0) -> list[tuple[str, str]]:
    """Pairs of distinct words one edit apart whose common prefix has `depth` characters at least, each pair once."""
    words = sorted(set(words))
    have, out = set(words), []
    todo = [(0, len(words), depth)] if words else []
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2:
            continue
        d = len(commonprefix([words[lo], words[hi - 1]]))  # down to where the node branches
        subtrees, at = [], lo  # a word that ends here sorts first and is a subtree of its own
        for c, group in groupby(words[lo:hi], key=lambda w: w[d : d + 1]):
            n = sum(1 for _ in group)
            subtrees.append((n, c, at))
            at += n
        todo += [(a, a + n, d + 1) for n, c, a in subtrees if c and n > 1]
        _, heavy, start = max(subtrees, key=lambda s: (s[1] != "", s[0]))
        rests = defaultdict(list)
        for n, c, a in subtrees:
            if a == start:
                continue
            for w in words[a : a + n]:
                head, rest = w[:d], w[d + 1 :]
                if c:
                    rests[rest].append(w)
                    if (other := head + heavy + rest) in have:  # replaced
                        out.append((w, other))
                    if (other := head + rest) in have and other[d : d + 1] != c:  # skipped
                        out.append((w, other))
                if (other := head + heavy + w[d:]) in have:  # put in
                    out.append((w, other))
        for same in rests.values():  # light subtrees with each other: as many as there are letters at most
            out += combinations(same, 2)
    return out


def grouped(words: DataFrame, least: int = PREFIX, most: int = GROUP) -> DataFrame:
    """words with q, the length of the prefix whose group it is in: the least, `least` or more, that has `most` words at most.

    A word shorter than its group's prefix is a group of its own, with q one more than its length.
    """
    words = words.withColumn("q", F.least(F.lit(least), F.length("word") + 1))
    while True:
        prefix = F.when(F.col("q") <= F.length("word"), F.substring("word", F.lit(1), F.col("q")))
        large = words.groupBy(prefix.alias("p"), "q").agg(F.count("*").alias("size")).where((F.col("size") > most) & F.col("p").isNotNull())
        large = cut(large, "large-prefixes")
        if large.isEmpty():
            return words
        longer = words.withColumn("p", prefix).join(large.hint("shuffle_merge"), ["p", "q"], "left")
        words = cut(longer.select("word", "n", F.when(F.col("size").isNotNull(), F.least(F.col("q") + 1, F.length("word") + 1)).otherwise(F.col("q")).alias("q")), "words")


def _merge(key, pdf):
    return pd.DataFrame(merged_pairs(pdf["word"].tolist(), int(pdf["q"].iloc[0])), columns=["a", "b"], dtype=object)


def near_pairs(words: DataFrame, least: int = PREFIX, most: int = GROUP) -> DataFrame:
    """Of distinct words (word, n): a, b, both ways, for all words one edit apart."""
    g = cut(grouped(words, least, most), "grouped")
    prefix = F.substring("word", F.lit(1), F.col("q"))
    below = g.where(F.col("q") <= F.length("word")).groupBy(prefix.alias("p"), "q").applyInPandas(_merge, "a string, b string")
    d = F.col("d")
    posts = g.select("word", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("d")).where(d < F.length("word"))
    own = F.substring("word", d + 1, F.lit(1))
    rest = F.concat(F.substring("word", F.lit(1), d), F.substr(F.col("word"), d + 2)).alias("rest")
    posts = posts.select("word", "d", rest, own.alias("c"), F.substring("word", d + 2, F.lit(1)).alias("next"))
    replaced = posts.groupBy("d", "rest").agg(F.collect_list("word").alias("ws")).where(F.size("ws") > 1)  # as many as there are letters at most
    replaced = replaced.select(F.explode("ws").alias("a"), "ws").select("a", F.explode("ws").alias("b")).where("a < b")
    skipped = posts.where(F.col("c") != F.col("next")).join(g.select(F.col("word").alias("b")), F.col("rest") == F.col("b")).select(F.col("word").alias("a"), "b")
    pairs = below.union(replaced).union(skipped)
    return pairs.union(pairs.select("b", "a"))


def variants(words: DataFrame, ratio: int = RATIO, least: int = PREFIX, most: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word (word, n)."""
    words = cut(words.select("word", "n"), "vocabulary")
    pairs = cut(near_pairs(words, least, most), "near-pairs")
    other = pairs.join(words.withColumnRenamed("word", "b").hint("shuffle_merge"), "b")
    best = other.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("b"))).alias("best"))
    d = words.join(best.hint("shuffle_merge"), "word", "left")
    has = -F.col("best.m") >= ratio * F.col("n")
    forms = cut(d.select("word", F.when(has, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, -F.col("best.m")).alias("form_n")), "forms")
    roots = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # counts grow tenfold with each step, so that a few doublings reach the last form
        far = skewed_lookup(roots, roots.select(F.col("word").alias("root"), F.col("root").alias("next")), ["root"], "left", "roots")
        roots = cut(far.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    return forms.join(roots.select("word", "root").hint("shuffle_merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))
