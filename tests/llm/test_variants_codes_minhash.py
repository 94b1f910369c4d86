"""Operators 11, 12 and 13 against brute force and SQL, on awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from veilmetrics.llm import minhash, spelling, vector_codes

from .test_operators import ROWS, SCHEMA, split

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def same(df, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(sql)
    cols = [c[0] for c in want.description]
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# operator 11


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    """Brute force of op11 over (doc_id, text)."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    form, out = {}, []
    for w in n:
        best = min(((-n[x], x) for x in n if near(w, x)), default=(0, None))
        form[w] = best[1] if -best[0] >= 10 * n[w] else None
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        out.append((w, form[w], root, n[w], sum(near(w, x) for x in n), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_merged_pairs():
    r = random.Random(3)
    for letters in ("ab", "abcé"):
        for size in (0, 1, 5, 60):
            ws = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(size)})
            want = sorted((a, b) for i, a in enumerate(ws) for b in ws[i + 1 :] if near(a, b))
            assert sorted(tuple(sorted(x)) for x in spelling.merged_pairs(ws)) == want
    long = "x" * 40_000
    assert spelling.merged_pairs([long, long + "y", long[:-1]]) == [(long, long + "y"), (long[:-1], long)] or len(spelling.merged_pairs([long, long + "y", long[:-1]])) == 2


@pytest.mark.parametrize("least,most", [(3, 4096), (1, 5), (2, 40)])
def test_near_pairs_at_any_depth(spark, least, most):
    r = random.Random(least)
    ws = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(400)})
    df = spark.createDataFrame([(w, 2) for w in ws], "word string, n long")
    assert sorted(map(tuple, spelling.near_pairs(df, least, most).collect())) == sorted((a, b) for a in ws for b in ws if a != b and near(a, b))


def test_forms(spark):
    counts = {"abcdefg": 500, "abcdefh": 50, "abcdeih": 5, "abcdxfg": 50, "abcdefgh": 49, "zzzzzzz": 3, "abcdefj": 500}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["form_n"]) for r in spelling.variants(df).collect()}
    assert got["abcdeih"] == ("abcdefh", "abcdefg", 50) and got["abcdefh"] == ("abcdefg", "abcdefg", 500)
    assert got["zzzzzzz"] == (None, "zzzzzzz", None) and got["abcdefg"] == (None, "abcdefg", None) and got["abcdefgh"] == ("abcdefg", "abcdefg", 500)


def test_spelling_of_awkward_rows(spark):
    r = random.Random(8)
    stems = ["Commitment", "commitement", "ÉTALONNAGE", "étalonnage", "wisdoms", "Wisdomss", "lettera" * 30]
    rows = [(i, " ".join(r.choice(stems) + r.choice(["", "", "", "s", "x"]) for _ in range(r.randint(0, 80)))) for i in range(60)]
    rows += [(1, None), (2, ""), (None, "commitment×commitment " * 40), (None, "commitment×commitment " * 40), (7, "wisdoms " * 300)]
    df = spark.createDataFrame([(i, t, 1, 1, "x", 2) for i, t in rows], "doc_id long, text string, n long, q int, word string, root long")
    assert sorted(map(tuple, spelling.variants(spelling.vocabulary(df)).collect()), key=repr) == spelled(rows)
    assert spelling.variants(spelling.vocabulary(df.limit(0))).collect() == []


@tables
def test_spelling_of_a_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = Counter(w for i, t in rows for w, c in spelling.words_of(t, i, spelling.runs_of(7)).items() for _ in range(c))
    got = {r["word"]: r for r in spelling.op11_spelling(spark, SF).collect()}
    assert {w: c for w, c in n.items() if c >= 2} == {w: r["n"] for w, r in got.items()}
    for w in random.Random(1).sample(sorted(got), 40):
        assert got[w]["n_near"] == sum(near(w, x) for x in got if x != w)


# operator 12


def coded(rows):
    """Brute force of op12 over (vec_id, vector, label), of vectors of one length."""
    kept = sorted(((i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda x: (x[0] is None, x[0], x[1]))
    w = len(kept[0][1]) // 16
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(16)]
    books = [[cut(v)[p] for _, v, _ in kept[:64]] for p in range(16)]
    assign = lambda: [[min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p])) for p, part in enumerate(cut(v))] for _, v, _ in kept]
    for _ in range(2):
        found = assign()
        for p in range(16):
            mine = defaultdict(list)
            for (_, v, _), f in zip(kept, found):
                mine[f[p][1]].append(cut(v)[p])
            for k, parts in mine.items():
                books[p][k] = [sum(c) // len(c) for c in zip(*parts)]
    found, by_label = assign(), Counter()
    for (_, _, lab), f in zip(kept, found):
        by_label[lab] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    fits = lambda e: e if e < 2**63 else None
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), fits(sum(d for d, _ in f)), fits(by_label[lab]), sha) for (i, _, lab), f in zip(kept, found)), key=repr)


def op12(df):
    kept = vector_codes.kept_vectors(df)
    books = vector_codes.learn(kept)
    d = vector_codes.with_label_error(vector_codes.encode(kept, books))
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], vector_codes.books_sha256(books)) for r in d.collect()), key=repr)


def test_nearest_is_exact():
    r = np.random.default_rng(4)
    for big in (3, 300, 10**12):
        points, entries = r.integers(-big, big, (500, 4)), r.integers(-big, big, (64, 4))
        entries[10] = entries[3]
        points[:20] = entries[:20]
        i, d = vector_codes.nearest(points, entries)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)), k) for k, e in enumerate(entries)) for p in points]
        assert list(zip(map(int, d), i.tolist())) == want


def test_vector_codes_of_awkward_rows(spark):
    r = random.Random(2)
    vec = lambda: [r.choice([r.gauss(0, 1), 0.0, -0.25]) for _ in range(32)]
    rows = [(i, vec(), r.choice([None, 1, 2])) for i in range(150)]
    rows += [rows[3], rows[3], (None, vec(), 1), (None, vec(), None), (200, None, 1), (201, [None] + vec()[1:], 1), (202, [math.nan] + vec()[1:], 1), (203, [-math.inf] + vec()[1:], 2)]
    df = spark.createDataFrame([(*x, 5, 6, 7, 8) for x in rows], "vec_id long, embedding array<float>, label int, part int, error long, code int, _none int").repartition(3)
    rows32 = [(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert op12(df) == coded(rows32)
    few = df.where("vec_id < 5")
    assert op12(few) == coded([x for x in rows32 if x[0] is not None and x[0] < 5])


def test_vector_codes_of_huge_components_and_other_lengths(spark):
    r = random.Random(6)
    rows = [(i, [float(np.float32(r.gauss(0, 1) * 10 ** r.choice([0, 8, 30]))) for _ in range(16)], 1) for i in range(90)]
    df = spark.createDataFrame(rows + [(900, [1.0] * 20, 1), (-1, [], 1), (-2, [1.0] * 5, 1)], "vec_id long, embedding array<float>, label int")
    assert op12(df) == coded(rows)


@tables
def test_vector_codes_of_tables(spark):
    same(vector_codes.op12_vector_codes(spark, SF), vector_codes.ORACLE_SQL["op12_vector_codes"])


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.op12_vector_codes(spark, str(tmp_path)).collect() == []


# operator 13


def grouped(rows, k=4):
    """Brute force of op13 over (doc_id, text)."""
    sets = []
    for _, t in rows:
        ws = ["".join(c.lower() if c.isascii() else c for c in w) for w in split(t)]
        sets.append({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set())
    of = list(range(len(rows)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                of[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((doc, len(sets[i]), least.get(top(i)), doc == least.get(top(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def edited(r, text, n):
    ws = text.split(" ")
    for _ in range(n):
        ws[r.randrange(len(ws))] = f"w{r.randint(0, 999)}"
    return " ".join(ws)


def groups(seed=9):
    """Texts with groups of near copies, some of chains, and a passage that many share."""
    r = random.Random(seed)
    say = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randint(0, 400)}" for _ in range(n))
    passage, base, chain = say(60), say(150), say(200)
    texts = [edited(r, base, r.randint(1, 6)) for _ in range(70)] + [passage + " " + say(r.randint(5, 80)) for _ in range(70)]
    for _ in range(30):
        chain = edited(r, chain, 4)
        texts.append(chain)
    texts += [base.upper(), base, base, passage, None, "", "  \t", "a b", "A b", "a b c d", "a b c d e", "x " * 500, say(9000)] + [say(30) for _ in range(20)]
    return list(enumerate(texts))


@pytest.mark.parametrize("how", [{}, {"large": 4, "block": 16}])
def test_minhash_against_brute_force(spark, how):
    rows = groups() + [(3, groups()[3][1]), (None, groups()[5][1]), (None, None), (None, "only one of no id here"), (-4, groups()[80][1])]
    df = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], "doc_id long, text string, class long, n int, u long, label string").repartition(3)
    assert sorted(map(tuple, minhash.near_duplicates(df, **how).collect()), key=repr) == grouped(rows)


def test_minhash_of_awkward_rows(spark):
    rows = [(x[0], x[1]) for x in ROWS]
    assert sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(ROWS, SCHEMA)).collect()), key=repr) == grouped(rows)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signatures_agree_like_sets():
    r = np.random.default_rng(1)
    agree = []
    for n in (5, 40, 3000, 70_000):
        pool = r.integers(0, 2**64, n + n // 4, np.uint64)
        a, b = minhash.signatures([np.unique(pool[: n + n // 8]), np.unique(pool[n // 8 :])], 2048)
        agree.append((a == b).mean())
        assert abs(agree[-1] - len(np.intersect1d(pool[: n + n // 8], pool[n // 8 :])) / len(np.unique(pool))) < 0.06
    assert minhash.signatures([np.empty(0, np.uint64)]) == [None]


@tables
def test_minhash_of_a_table(spark):
    same(minhash.op13_minhash(spark, SF), minhash.ORACLE_SQL["op13_minhash"])
