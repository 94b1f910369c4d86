"""Operator 4, token-ID output in a content-addressed store.

Texts are encoded and every document's ids are cut into chunks where a rolling hash of the last ids says so, so that
equal passages give equal chunks wherever they stand. A chunk is stored once under its digest; a document is a recipe,
the list of its chunks. Recipes are written in ascending document order with a Merkle root for each file part and one
over the parts, against which a read verifies what it reconstructs.

    path/encoded/kind=1/ key binary (the digest), width int (bytes an id), n long, payload binary (little-endian ids)
    path/encoded/kind=0/ recipes as they were encoded, without order
    path/recipes/  part int, place long, doc_id long, n_tokens long, start long, digests array<binary>, ends array<int>
    path/manifest/ part int, n_docs long, n_tokens long, root binary
    path/root/     n_parts int, n_docs long, n_tokens long, root binary: the Merkle root over the parts, one row

Cases: null text is the empty text; null doc_ids come first; repeated doc_ids are kept, one recipe each; other columns
are ignored; an empty table gives empty files and an empty result.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, new_dir, partitions, ready, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
WINDOW, MASK, LEAST, MOST = 32, 1023, 128, 8192
CACHE_WORDS, GIVEN, BATCH_BYTES = 600_000, 300_000, 4_000_000
LETTER_END = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/0-9:-@\[-`{-~])"  # such letters and marks are so in every version of Unicode
LINE_END = r"([!-~\x{c0}-\x{24f}])\n([!-~\x{c0}-\x{24f}])"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letters that byte-level models use for bytes: printable ones stand for themselves, the rest from 256 on."""
    plain_ones = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain_ones]
    return {b: chr(b) for b in plain_ones} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """The ids that Tokenizer.encode gives, with END_ID after each text.

    Pre-tokens always begin at a single space between two non-spaces, at a line end between two non-spaces and after it,
    and where letters meet a digit or mark, so texts are cut there, and each distinct piece is encoded once while it stays
    in the cache: its ids lie in one buffer, from which those of whole batches are gathered. A piece that is one word goes
    to the tokenizer's model at once. Texts with a piece of which this isn't sure, and those that may hold special tokens,
    are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.width = 2 if self.of.get_vocab_size() <= 65536 else 4
        self.letters = byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {"": 0}  # piece -> slot, -1 for one that says nothing by itself
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.n, self.used = np.zeros(1 << 20, "<u4"), 0, 0
        self._add(np.array([0, 1]), np.array([END_ID], "<u4"))

    def _add(self, sizes: np.ndarray, flat: np.ndarray) -> range:
        """Puts the ids of new slots into the buffer."""
        slots = range(self.n, self.n + len(sizes))
        while slots.stop > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.size[slots.start : slots.stop] = sizes
        self.first[slots.start : slots.stop] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.n, self.used = slots.stop, self.used + len(flat)
        return slots

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slots, end to end, and where each ends."""
        size = self.size[slots]
        upto = np.cumsum(size)
        return self.ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.first[slots] - upto + size, size)], upto

    def _word(self, w: str) -> list[int]:
        return [t.id for t in self.of.model.tokenize((w if w[0] != " " else "\u0120" + w[1:]) if w.isascii() else w.encode().decode("latin-1").translate(self.letters))]

    def learn(self, pieces: list[str]) -> None:
        """Gives new pieces their slots."""
        slot, words, rest = self.slot, [], []
        for w in pieces:
            if w.isalpha() or (w[:1] == " " and w[1:].isalpha()):
                words.append(w)
            elif w == " " or (w[0] == " " and w[1].isspace()):
                slot[w] = -1  # white space next to a cut
            else:
                rest.append(w)
        flat: list[int] = []
        sizes: list[int] = []
        for w in words:  # ids go into one list: a list for each word would keep the garbage collector busy
            ids = self._word(w)
            flat += ids
            sizes.append(len(ids))
        for e in self.of.encode_batch_fast(rest, add_special_tokens=False):
            flat += e.ids
            sizes.append(len(e))
        slot.update(zip(words + rest, self._add(np.array(sizes, np.int64), np.array(flat, "<u4"))))

    def _slots(self, pieces: list[str]) -> np.ndarray:
        slots = np.fromiter(map(self.slot.get, pieces, repeat(-2)), np.int64, len(pieces))
        new = np.flatnonzero(slots == -2)
        if len(new):
            unknown = [pieces[i] for i in new.tolist()]
            self.learn(unknown)
            slots[new] = np.fromiter(map(self.slot.__getitem__, unknown), np.int64, len(unknown))
        return slots

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, END_ID after each, and where each text's ids end."""
        if self.n > CACHE_WORDS:
            self._clear()
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.replace_substring_regex(texts, LETTER_END, "\\1\x00\\2")
        cut = pc.replace_substring_regex(cut, LINE_END, "\\1\x00\n\x00\\2")
        lists = pc.split_pattern(pc.replace_substring(cut, " ", "\x00 "), "\x00")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        begin = ends - np.diff(ends, prepend=0)
        coded = lists.flatten().dictionary_encode()
        pieces = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        odd = np.add.reduceat(pieces < 0, begin) > 0
        odd |= pc.match_substring_regex(texts, r"<\||\x00").to_numpy(zero_copy_only=False)
        n, used = self.n, self.used
        for i in np.flatnonzero(odd).tolist():
            pieces[begin[i] : ends[i]] = 0
            own = np.array(self.of.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
            pieces[begin[i]] = self._add(np.array([len(own)]), own)[0]
        pieces = np.insert(pieces, ends, 1)
        ids, upto = self._gather(pieces)
        self.n, self.used = n, used  # odd texts don't stay
        return ids, upto[ends + np.arange(len(ends))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file, with its cache, from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_GEAR = np.random.default_rng(7).integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)


def boundaries(ids: np.ndarray, of: np.ndarray | None = None) -> list[list[int]]:
    """Ends of the chunks of each text, where `of` has the texts' ends in ids (by default one text).

    A chunk ends where the sum of the gear values of the last WINDOW ids ends in zero bits, and has LEAST to MOST ids.
    """
    of = np.array([len(ids)]) if of is None else of
    hits = np.empty(0, np.int64)
    if len(ids) > LEAST:
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(_GEAR[ids & 0xFFFF] * (ids.astype(np.uint64) + np.uint64(1)))])
            roll = total[WINDOW:] - total[:-WINDOW]
            roll = (roll ^ (roll >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hits = np.flatnonzero((roll >> np.uint64(40)) & np.uint64(MASK) == 0) + WINDOW
    out, begin = [], 0
    cuts = np.searchsorted(hits, of, side="right").tolist()
    i, hits = 0, hits.tolist()
    for z, j in zip(of.tolist(), cuts):
        ends, at = [], begin
        for h in hits[i:j]:
            while h - at > MOST:
                at += MOST
                ends.append(at)
            if h - at >= LEAST and h - begin >= WINDOW:
                at = h
                ends.append(at)
        while z - at > MOST:
            at += MOST
            ends.append(at)
        if at < z:
            ends.append(z)
        out.append(ends)
        begin, i = z, j
    return out


def _digest(width: int, data) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=b"ids%d" % width).digest()


_CODED = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("digests", pa.list_(pa.binary())), ("ends", pa.list_(pa.int32())), ("width", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])
CODED = "kind int, key binary, doc_id long, row long, digests array<binary>, ends array<int>, width int, n long, payload binary"


def _gathered(batches, most: int = BATCH_BYTES):
    """The batches, joined to some `most` bytes each, so that a word that recurs in one is looked up once."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            held.append(part)
            n += part.column("text").nbytes
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held and (t := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield t[0]


def _encode_batches(batches, path: str):
    """Recipe rows (kind 0) and chunk rows (kind 1); a chunk that this task has given before is not given again while it is remembered."""
    encode, given = encoder(path), set()
    width = encode.width
    for b in _gathered(batches):
        if len(given) > GIVEN:
            given.clear()
        ids, of = encode(b.column("text"))
        data = memoryview(ids.astype(f"<u{width}").tobytes())
        chunks, recipes, begin = [], [], 0
        for doc_id, row, ends, z in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), boundaries(ids, of), of.tolist()):
            digests, a = [], begin
            for e in ends:
                part = data[a * width : e * width]
                digest = _digest(width, part)
                digests.append(digest)
                if digest not in given:
                    given.add(digest)
                    chunks.append((digest, e - a, bytes(part)))
                a = e
            recipes.append((b"r" + row.to_bytes(8, "big"), doc_id, row, digests, [e - begin for e in ends], z - begin))
            begin = z
        for rows, cols in ((chunks, {"key": 0, "n": 1, "payload": 2}), (recipes, {"key": 0, "doc_id": 1, "row": 2, "digests": 3, "ends": 4, "n": 5})):
            made = list(zip(*rows)) if rows else [()] * 6
            kind, m = int(rows is chunks), len(rows)
            whole = {"kind": pa.array(np.full(m, kind, np.int32)), "width": pa.array(np.full(m, width, np.int32))}
            yield pa.RecordBatch.from_arrays([whole[f.name] if f.name in whole else pa.array(made[cols[f.name]], f.type) if f.name in cols else pa.nulls(m, f.type) for f in _CODED], schema=_CODED)


def merkle(leaves: list[bytes]) -> bytes:
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=16).digest() for i in range(0, len(level), 2)]
    return level[0]


class _Tree:
    """A Merkle root over leaves that come one by one, in logarithmic memory."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (0, hashlib.blake2b(b"\0" + leaf, digest_size=16).digest())
        while self.peaks and self.peaks[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.blake2b(b"\1" + self.peaks.pop()[1] + node[1], digest_size=16).digest())
        self.peaks.append(node)

    def root(self) -> bytes:
        at = hashlib.blake2b(b"", digest_size=16).digest()
        for _, x in self.peaks:
            at = hashlib.blake2b(b"\1" + at + x, digest_size=16).digest()
        return at


def _manifest_batches(batches):
    """One row for each part: rows come by part and place."""
    trees: dict[int, list] = {}
    for b in batches:
        for part, doc_id, n, digests in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "digests"))):
            t = trees.setdefault(part, [_Tree(), 0, 0])
            t[0].add(str(doc_id).encode() + b":" + b"".join(digests))
            t[1] += 1
            t[2] += n
    rows = [(p, t[1], t[2], t[0].root()) for p, t in trees.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "n_docs", "n_tokens", "root"])


MANIFEST = "part int, n_docs long, n_tokens long, root binary"
RECIPES = "part int, place long, doc_id long, n_tokens long, start long, digests array<binary>, ends array<int>"


def _roots(recipes: DataFrame) -> DataFrame:
    n = partitions(recipes.sparkSession)
    return recipes.select("part", "place", "doc_id", "n_tokens", "digests").repartition(n, "part").sortWithinPartitions("part", "place").drop("place").mapInArrow(_manifest_batches, MANIFEST)


def _root_over(parts: list) -> bytes:
    """The Merkle root over the parts, whose rows are few: one for each shuffle partition at most."""
    return merkle([f"{r['part']}:{r['n_docs']}:{r['n_tokens']}:".encode() + bytes(r["root"]) for r in sorted(parts, key=lambda r: r["part"])])


def write_store(docs: DataFrame, path: str, doc_id="doc_id", text="text", order_by: str | None = None, tokenizer: str | None = None) -> None:
    """Encodes docs and writes the store. order_by: a long column, distinct in each row, that gives the stream order; by default that is the doc_id."""
    spark = ready(docs.sparkSession)
    n = partitions(spark)
    at = tokenizer or tokenizer_path()
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (F.monotonically_increasing_id() if order_by is None else F.col(order_by).cast("long")).alias("row"))
    coded = d.mapInArrow(lambda it: _encode_batches(it, at), CODED)
    once = F.row_number().over(Window.partitionBy("key").orderBy("kind"))
    one = coded.repartition(n, "key").withColumn("_nth", once).where("_nth = 1").drop("_nth")
    raw = f"{path}/encoded"
    one.write.partitionBy("kind").option("compression", "zstd").parquet(raw)
    recipes = spark.read.schema(CODED).parquet(raw).where("kind = 0").select("doc_id", "row", "digests", "ends", F.col("n").alias("n_tokens"))
    order = [F.col("row")] if order_by else [F.col("doc_id").asc_nulls_first(), F.col("row")]
    ranged = cut(recipes.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "recipes")
    sums = {r["part"]: (r["n"], r["t"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}  # a row for each part
    firsts, place, start = [], 0, 0
    for p in sorted(sums):
        firsts.append((p, place, start))
        place, start = place + sums[p][0], start + sums[p][1]
    w = Window.partitionBy("part").orderBy(*order)
    (ranged.join(F.broadcast(spark.createDataFrame(firsts, "part int, _place long, _start long")), "part")
        .withColumn("place", F.col("_place") + F.row_number().over(w) - 1)
        .withColumn("start", F.col("_start") + F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("part", "place", "doc_id", "n_tokens", "start", "digests", "ends")
        .write.option("compression", "zstd").parquet(f"{path}/recipes"))
    _roots(open_recipes(spark, path)).write.parquet(f"{path}/manifest")
    parts = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    spark.createDataFrame([(len(parts), place, start, _root_over(parts))], ROOT).coalesce(1).write.parquet(f"{path}/root")


ROOT = "n_parts int, n_docs long, n_tokens long, root binary"


def verify(spark: SparkSession, path: str) -> None:
    """Holds recipes against the manifest in both directions, and the manifest against the root over its parts."""
    told = {r["part"]: r for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()}
    top = spark.read.schema(ROOT).parquet(f"{path}/root").collect()
    if len(top) != 1 or top[0]["n_parts"] != len(told) or bytes(top[0]["root"]) != _root_over(list(told.values())):
        raise ValueError(f"the manifest of {path} doesn't match its root")
    found = {r["part"]: r for r in _roots(open_recipes(spark, path)).collect()}
    wrong = sorted(p for p in told.keys() | found.keys() if told.get(p) != found.get(p))
    if wrong:
        raise ValueError(f"{len(wrong)} parts of {path} don't match the manifest: {wrong[:10]}")


def open_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def open_chunks(spark: SparkSession, path: str) -> DataFrame:
    back = spark.read.schema("key binary, width int, n long, payload binary, kind int").parquet(f"{path}/encoded").where("kind = 1")
    return back.select(F.col("key").alias("digest"), "width", "n", "payload")


def _shift_tables(bits: int = 40) -> np.ndarray:
    """tables[k][i][b]: what byte i of a crc with value b becomes after 2**k zero bytes."""
    poly = np.uint32(0xEDB88320)

    def step(c):  # one zero byte
        for _ in range(8):
            c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ poly, c >> np.uint32(1)).astype(np.uint32)
        return c

    basis = np.array([[b << (8 * i) for b in range(256)] for i in range(4)], np.uint32)
    out = [step(basis)]
    for _ in range(bits - 1):
        out.append(_apply(out[-1], out[-1]))
    return np.stack(out)


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]


_TABLES: list = []


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The share in crc32(A + B) of a part A with this crc, before a B of n_bytes: crc32(A + B) = crc_shift(crc32(A), len(B)) ^ crc32(B)."""
    if not _TABLES:
        _TABLES.append(_shift_tables())
    crc, n_bytes = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k in range(40):
        on = (n_bytes >> k) & 1 == 1
        if on.any():
            crc = np.where(on, _apply(_TABLES[0][k], crc), crc)
    return crc


def _payload_crc(batches):
    """Of each stored chunk, after its payload is held against its digest: the crc32 of its ids as 32-bit integers."""
    for b in batches:
        crcs = []
        for digest, width, n, data in zip(*(b.column(c).to_pylist() for c in ("digest", "width", "n", "payload"))):
            if _digest(width, data) != digest or len(data) != n * width:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            crcs.append(zlib.crc32(data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])


def _shares(batches):
    """Of each piece of a document: what its chunk adds to the crc32 of the document's ids."""
    for b in batches:
        crc, after = (b.column(c).to_numpy(zero_copy_only=False) for c in ("crc", "after"))
        b = b.drop_columns(["crc", "after"])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(crc_shift(crc, after * 4).astype(np.int64))], names=[*b.schema.names, "share"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """place, doc_id and ids (array<int>) of each document, in full, from the files."""
    each = open_recipes(spark, path).select("place", "doc_id", F.posexplode("digests").alias("seq", "digest"))
    parts = each.join(open_chunks(spark, path), "digest").select("place", "doc_id", "seq", "width", "payload")

    def ids(batches):
        for b in batches:
            of = [np.frombuffer(p, f"<u{w}").astype(np.int32) for w, p in zip(b.column("width").to_pylist(), b.column("payload").to_pylist())]
            b = b.drop_columns(["width", "payload"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of, pa.list_(pa.int32()))], names=[*b.schema.names, "ids"])

    return parts.mapInArrow(ids, "place long, doc_id long, seq int, ids array<int>").groupBy("place", "doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "ids"))), lambda x: x["ids"])).alias("ids"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """place, doc_id, start, n_tokens and ids_crc32 of each document, from verified chunks; recipes, manifest and root are held against each other.

    No payload is moved: crc32 is linear, so a chunk adds to its document's crc according to what follows it. A document
    with a chunk that is not there has null n_tokens and crc.
    """
    verify(spark, path)
    crcs = open_chunks(spark, path).mapInArrow(_payload_crc, "digest binary, n long, crc long").hint("shuffle_merge")
    before = lambda i: F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
    pieces = F.transform("digests", lambda x, i: F.struct(x.alias("digest"), before(i).cast("long").alias("a"), F.get("ends", i).cast("long").alias("z")))
    each = open_recipes(spark, path).select("place", "doc_id", "start", "n_tokens", F.explode(pieces).alias("c")).select("place", "doc_id", "start", "n_tokens", "c.*")
    met = each.join(crcs, "digest", "left").select("place", "doc_id", "start", "n_tokens", (F.col("z") - F.col("a")).alias("take"), "n", F.coalesce("crc", F.lit(0)).alias("crc"), (F.col("n_tokens") - F.col("z")).alias("after"))
    shares = met.mapInArrow(_shares, "place long, doc_id long, start long, n_tokens long, take long, n long, share long")
    whole = F.sum(F.when(F.col("n") == F.col("take"), F.col("n"))) == F.col("n_tokens")
    return shares.groupBy("place", "doc_id", "start", "n_tokens").agg(F.expr("bit_xor(share)").alias("crc"), whole.alias("whole")).select(
        "place", "doc_id", "start", F.when(F.col("whole"), F.col("n_tokens")).alias("n_tokens"), F.when(F.col("whole"), F.col("crc")).alias("ids_crc32"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_back(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
