"""Filter audits, host rules and vector codes against plain versions, and the odd rows they must take."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from cloudloom.llm import filteraudit, hostrules, veccodes

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, mask int, part string, fp long, host string, kind int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, "p", 4, "h", 5) for i, t, s in rows], SCHEMA)


def prose(rng, n, vocab=900):
    return " ".join(f"{rng.choice('aeiou')}{rng.randrange(vocab)}" for _ in range(n))


# ---- op11 ------------------------------------------------------------------------------------------------------------


def plain_failures(rows):
    ids = defaultdict(set)
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""].add(i)
    out = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and min(ids[t]) < i]
        out.append((i, s or "", sum(1 << k for k, x in enumerate(fails) if x)))
    return out


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    failed = plain_failures(rows)
    out = {}
    for part in {p for _, p, _ in failed}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [(i, m) for i, p, m in failed if p == part]
            gone = []
            for step, c in enumerate(order, 1):
                bit = 1 << "ABCDE".index(c)
                fails = [i for i, m in left if m & bit]
                kept = [(i, m) for i, m in left if not m & bit]
                redundant = sum(1 for m in gone if m & bit)
                gone += [m for _, m in left if m & bit]
                left = kept
                shapley[c] += len(fails)
                unique = sum(1 for _, p, m in failed if p == part and m == bit)
                out[part, "".join(order), step] = [len(kept), len(fails), redundant, unique, sum(i in good for i in fails), sum(i in toxic for i in fails)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audit_rows(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, 60) for _ in range(6)] + [prose(rng, 70, 5), prose(rng, 8), "ABC " * 60 + "#", "", "x $", " \n"]
    rows = [(i, rng.choice(base), rng.choice(["a", "a", "a", "b", "", None])) for i in range(300)]
    rows += [(1000 + i, base[0], "hot") for i in range(400)]
    rows += [(7, rows[7][1], "a"), (7, rows[7][1], "a"), (None, base[0], "a"), (None, base[0], "n"), (None, None, None), (5000, None, "a"), (5001, prose(rng, 30_000), "long")]
    return rows


@pytest.mark.parametrize("fingerprint", ["xxhash64(text)", "cast(length(text) % 3 as bigint)", "0L"])
@pytest.mark.parametrize("parts", ["1", "7"])
def test_failures_at_boundaries(spark, fingerprint, parts):
    """Runs over several partitions, and texts that share their fingerprints."""
    rows = audit_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for limit in ("10000", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
            got = Counter(tuple(r) for r in filteraudit.failures(docs(spark, rows), fingerprint=fingerprint).collect())
            assert got == Counter(plain_failures(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_audit_against_plain_chains(spark):
    rows = audit_rows(4)
    labels = [(i, i % 2, (i // 3) % 2) for i in range(0, 300, 2)] + [(1005, None, 1), (1005, 1, None), (None, 1, 1), (1006, None, None)]
    got = filteraudit.audit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == plain_audit(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


def test_audit_of_own_filters_and_no_rows(spark):
    df = docs(spark, [(1, "a b", "s"), (2, "a b", "s"), (3, "c", "s")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filteraudit.audit(df, labels, filters={"S": "length(text) < 2"}, duplicate="X").collect()
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in got} == {("SX", 1): (2, 1, 2), ("SX", 2): (1, 1, 2), ("XS", 1): (2, 1, 2), ("XS", 2): (1, 1, 2)}
    none = filteraudit.audit(df.where("false"), labels)
    assert none.count() == 0 and none.columns[:4] == ["part", "filter_order", "step", "kept"]


# ---- op12 ------------------------------------------------------------------------------------------------------------


def plain_measures(t):
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(cover)


def test_measures(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "a b a b a b", "x y z x y z", "one\ntwo\none\n\n \n two\none", "ünï 漢字 #* ünï 漢字 #* ünï", "A b c a B C A b c\r\n# & | <>\x0b\x0c"]
    texts += [prose(rng, rng.randrange(1, 80), rng.choice([2, 3, 9, 900])) for _ in range(150)] + [prose(rng, 30_000, 300), "a " * 20_000]
    got = {r["doc_id"]: tuple(r[2:8]) for r in hostrules.measures(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).select("doc_id", "host", *hostrules.MEASURES).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}


def test_host_verdicts(spark):
    """A large bad host loses its good documents; a small one with the same rate does not, as its rate is drawn to the others'."""
    rng = random.Random(2)
    good, bad = lambda: prose(rng, 60), lambda: prose(rng, 60) + " ###" * 4 + " # % & |" * 4
    rows = [(i, bad() if i % 10 < 9 else good(), "bad") for i in range(200)]
    rows += [(1000 + i, bad() if i % 25 == 0 else good(), f"h{i % 40}") for i in range(2000)]
    rows += [(5000, bad(), "tiny"), (5001, good(), "tiny"), (5002, good(), None), (5003, bad(), None), (5004, "too few", "h1"), (5004, "too few", "h1"), (None, good(), "bad"), (5005, None, None), (5006, "", "")]
    got = hostrules.judge(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    host = {i: s for i, _, s in rows}
    for r in got:
        n = r["n_words"]
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        assert r["host_failed"] == (host[r["doc_id"]] == "bad"), r  # one failing text alone condemns no host
        assert r["kept"] == (not r["base_failed"] and not r["host_failed"])
    empty = hostrules.judge(docs(spark, rows).where("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", *hostrules.MEASURES, "base_failed", "host_failed", "kept"]


def test_beta_prior_recovers_the_spread():
    rng = np.random.default_rng(0)
    for a, b in ((2, 8), (0.5, 4), (20, 20)):
        n = rng.integers(5, 400, 4000)
        f = rng.binomial(n, rng.beta(a, b, 4000))
        got = hostrules.beta_prior(4000, n.sum(), (n * n).sum(), f.sum(), (f * f / n).sum())
        assert np.allclose(got, (a, b), rtol=0.12), got
    f = rng.binomial(n, 0.3)
    got = hostrules.beta_prior(4000, n.sum(), (n * n).sum(), f.sum(), (f * f / n).sum())
    assert got is None or sum(got) > 300
    assert hostrules.beta_prior(0, 0, 0, 0, 0) is None and hostrules.beta_prior(1, 5, 25, 5, 5) is None and hostrules.beta_prior(1, 5, 25, 2, 0.8) is None


def test_host_rules_run_no_python(spark):
    plan = hostrules.measures(docs(spark, [(1, "a", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- op13 ------------------------------------------------------------------------------------------------------------


def floors(v):
    return [math.floor(x * 4096) if abs(x) < 2**53 else int(x) * 4096 for x in v]


def plain_codes(rows, entries=16, rounds=6):
    """(id, code, error, label_error, sha) by plain loops over Python integers."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for width in {len(v) for _, v, _ in kept}:
        own = sorted([(i is None, i or 0, v, y) for i, v, y in kept if len(v) == width], key=lambda r: r[:3])
        size = -(-width // 8)
        cut = [[(floors(v) + [0] * (8 * size - width))[p * size : (p + 1) * size] for p in range(8)] for _, _, v, _ in own]
        books = [[c[p] for c in cut[:entries]] for p in range(8)]

        def nearest(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            for p in range(8):
                at = [nearest(c[p], books[p])[1] for c in cut]
                books[p] = [[sum(z) // at.count(k) for z in zip(*[c[p] for c, a in zip(cut, at, strict=True) if a == k], strict=True)] if k in at else e for k, e in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for (null, i, _, y), c in zip(own, cut, strict=True):
            found = [nearest(c[p], books[p]) for p in range(8)]
            out.append([None if null else i, "".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), 2**63 - 1), y, sha])
    total = Counter()
    for r in out:
        total[r[3]] += r[2]
    return sorted([(r[0] is None, r[0] or 0, r[1], r[2], min(total[r[3]], 2**63 - 1), r[4]) for r in out])


def codes(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, y, 1, 2) for i, v, y in rows], "vec_id long, embedding array<double>, label int, width int, v int")
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in veccodes.compress(df.repartition(3), **kw).collect())


def test_codes_against_plain_loops(spark):
    rng = random.Random(6)
    grid = [(i, [rng.randrange(-3, 4) / 4096 for _ in range(16)], i % 3 or None) for i in range(200)]  # many ties
    cloud = [(i, [rng.gauss(0, 1) for _ in range(24)], rng.choice([1, 2, None])) for i in range(150)]
    assert codes(spark, grid) == plain_codes(grid)
    assert codes(spark, cloud) == plain_codes(cloud)
    assert codes(spark, cloud, entries=5, rounds=2) == plain_codes(cloud, 5, 2)


def test_codes_of_odd_vectors(spark):
    rng = random.Random(7)
    v = lambda n, s=1.0: [rng.gauss(0, s) for _ in range(n)]
    rows = [(1, None, 1), (2, [None, *v(7)], 1), (3, [math.nan, *v(7)], 1), (4, [math.inf, *v(7)], 2), (5, [0.0] * 8, None), (6, v(8), 1), (6, v(8), 1), (None, v(8), 1), (7, v(8), 2), (7, rows7 := v(8), 2), (7, rows7, 2)]
    rows += [(20 + i, v(5), 3) for i in range(20)] + [(50, [], 4), (51, [], None)]
    rows += [(100 + i, v(16, 1e12), 5) for i in range(30)] + [(200, [1e300, -1e300] * 8, 6), (201, [5e-324] * 16, 6)]
    assert codes(spark, rows) == plain_codes(rows)
    assert codes(spark, rows[:4]) == []
    one = [(9, v(8), None)]
    assert codes(spark, one) == plain_codes(one)


def test_ball_tree_bounds():
    """Every entry lies in the balls above it, and the search equals trying all entries, at distances of any size."""
    rng = np.random.default_rng(8)
    for scale, dims in ((2, 1), (5, 3), (10**4, 8), (10**8, 8)):
        entries = rng.integers(-scale, scale + 1, (40, dims))
        x = rng.integers(-scale, scale + 1, (500, dims))
        book = veccodes.Book(entries.tolist())

        def check(ball, entries=entries):
            for m in ball.members:
                assert int(((entries[m].astype(object) - ball.center.astype(object)) ** 2).sum()) <= ball.radius**2
            for h in ball.halves:
                check(h)

        check(veccodes.ball_tree(entries))
        d = ((x[:, None, :].astype(object) - entries[None]) ** 2).sum(axis=2)
        index, best = book.nearest(x)
        assert index.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()
        index, best = book.nearest(x.astype(object))
        assert index.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    out = veccodes.compress(df)
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
