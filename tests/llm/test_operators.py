"""Training-data operators against brute force, planted cases, and the odd rows that every one must take."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import align, ann, decontaminate, jaccard, licenses, packing, sharding, substrings, suffixes, toxicity, urlfilter
from cloudloom.llm import textkit as tk
from cloudloom.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, n int, spans string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}x" for _ in range(n)]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, 1, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def odd(spark):
    """Nulls, empty and blank texts, a long one, repeated rows and ids."""
    rng = random.Random(0)
    long = " ".join(words(rng, 30_000))
    return docs(spark, [None, "", " \n\t", "one two", "one two", "one two three", long, "ünïcode ß 漢字 text", None], [1, 2, 3, 4, 4, 4, 5, None, None])


OPERATORS = {
    "shard": lambda s, d: sharding.shard(d), "pack": lambda s, d: packing.pack(d), "licenses": lambda s, d: licenses.scan_licenses(d),
    "leaks": lambda s, d: decontaminate.find_leaks(d, items(s)), "drop_leaks": lambda s, d: decontaminate.drop_leaks(d, items(s)),
    "suffixes": lambda s, d: suffixes.dedup_substrings(d), "passages": lambda s, d: substrings.find_passages(d), "drop_passages": lambda s, d: substrings.drop_passages(d),
    "jaccard": lambda s, d: jaccard.jaccard_join(d), "keep_one": lambda s, d: jaccard.keep_one(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)), "drop_toxic": lambda s, d: toxicity.drop_toxic(d, labels(s)),
}


def items(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, "")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    df = odd(spark)
    out = OPERATORS[name](spark, df)
    rows = out.collect()
    if name in ("shard", "licenses", "suffixes", "jaccard", "toxicity"):
        assert len(rows) == df.count()
    if name in ("drop_leaks", "drop_toxic", "keep_one", "drop_passages"):
        assert out.columns == df.columns
    if name in ("drop_leaks", "drop_toxic", "drop_passages"):
        assert len(rows) == df.count()
    empty = OPERATORS[name](spark, df.where("false"))
    assert empty.columns == out.columns and empty.count() == 0


def test_word_hashes(spark):
    import pyarrow as pa

    texts = ["The  cat\nSAT", None, "", "cat the", "a", "ß É x"]
    data, off = tk.text_buffer(pa.array(texts, pa.string()))
    w = tk.words(data, off)
    want = [[x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")] for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    by = defaultdict(set)
    for x, h in zip(flat, w.hash.tolist(), strict=True):
        by[x].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
    spans = [(texts[d] or "").encode()[s:e].decode() for d, s, e in zip(w.doc, w.start, w.end, strict=True)]
    assert spans == [x for t in texts for x in WORD.findall(t or "")]


# ---- op1, op2 --------------------------------------------------------------------------------------------------------


def test_url_validity(spark):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    events = [("example.com", "spam", "add", 2), ("example.com", "spam", "add", 3), ("example.com", "spam", "remove", 5), ("example.com", "spam", "add", 8), ("a.example.com", "bad", "add", 4), ("x.org", "spam", "remove", 1), (None, "spam", "add", 1), ("y.org", "spam", "add", None), ("z.org", "s", "add", 3), ("z.org", "s", "remove", 3)]
    entries = spark.createDataFrame([(a, b, c, None if t is None else day(t)) for a, b, c, t in events], "domain string, category string, action string, listed_at string").withColumn("listed_at", F.to_timestamp("listed_at"))
    urls = ["http://example.com/x", "https://u@A.Example.com:80/y", "http://b.a.example.com", "http://notexample.com", "ftp://x.org", None, "no url", "http://z.org./"]
    caps = [(i, u, day(t)) for i, u in enumerate(urls) for t in (1, 2, 4, 5, 7, 9)] + [(99, urls[0], None), (0, urls[0], day(2))]
    df = spark.createDataFrame(caps, "page_id int, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    got = urlfilter.filter_urls(df, entries).collect()
    spans = {"example.com": [(2, 5, "spam"), (8, 99, "spam")], "a.example.com": [(4, 99, "bad")]}
    hosts = {0: "example.com", 1: "a.example.com", 2: "b.a.example.com", 3: "notexample.com", 4: "x.org", 7: "z.org"}
    assert len(got) == len(caps)
    for r in got:
        host, t = hosts.get(r["page_id"] if r["page_id"] != 99 else 0), r["fetched_at"].day if r["fetched_at"] else None
        hits = [(-len(d), c, d) for d, ss in spans.items() for lo, hi, c in ss if host and t and (host == d or host.endswith("." + d)) and lo <= t < hi]
        best = min(hits) if hits else None
        assert r["blocked"] == bool(best) and r["category"] == (best and best[1]) and r["matched_domain"] == (best and best[2])
        assert r["host"] == host


def test_license_forms(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    noisy = "Copyright (c) 2024 Someone\n\n" + mit.upper().replace(",", " ,") + "\n All rights reserved."
    british = dict(licenses.KNOWN)["MIT-notice"].replace("License", "Licence")
    got = [r["license"] for r in licenses.scan_licenses(docs(spark, [mit, noisy, british, mit + " and more", ""])).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", "MIT-notice", None, None]
    own = spark.createDataFrame([("b", "Some text"), ("a", "some TEXT!"), ("e", "")], "license string, text string")
    assert [r["license"] for r in licenses.scan_licenses(docs(spark, ["some text", ""]), own).orderBy("doc_id").collect()] == ["a", None]


def test_published_licenses(spark):
    """MIT, ISC and BSD texts as published: unwrapped, wrapped at many widths, and on one line with their copyright notice."""
    import textwrap

    notice = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
    texts = {n: x for n, _, x in licenses._WHOLE}
    assert notice in texts["MIT"] and "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE" in texts["MIT"] and "provided that the above copyright notice and" in texts["ISC"]
    made, want = [], []
    for name, titles, text in licenses._WHOLE:
        for title in ("", *titles):
            for head in ("Copyright (c) 2024 Ann Other\n", "Copyright 2019-2024 Ann Other <a@b.c>. All rights reserved.\n", "Copyright Ann Other and Contributors\nAll rights reserved.\n", "(c) 2020 X\r\n"):
                for width in (30, 58, 72, 79, 10_000):
                    body = "\n\n".join(textwrap.fill(x, width) for x in text.split("\n\n"))
                    made.append(f"{title}\n\n{head}\n{body}\n")
                    want.append(name)
            made.append(" ".join(f"{title} Copyright (c) 2024 Ann Other. {text}".split()))
            want.append(name)
    made += [texts["MIT"] + " More.", "Copyright (c) 2024 X", "A word on copyright."]
    want += [None, None, None]
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs(spark, made)).collect()}
    wrong = [(want[k], got[k], made[k][:300]) for k in got if got[k] != want[k]]
    assert len(got) == len(made) and not wrong, (len(wrong), wrong[:3])


# ---- op3 -------------------------------------------------------------------------------------------------------------


def test_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 12)).round(1)
    x[700:760] = x[5]
    rows = [(i, [float(v) for v in p], 0) for i, p in enumerate(x)] + [(5000, None, 0), (5100, [0.0] * 12, 0), (5200, [float("nan")] * 12, 0), (5300, [None] + [1.0] * 11, 0), (None, [1.0] * 12, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    xs = x.astype(np.float32).astype(float)
    want = {}
    for q in range(0, 1200, 100):
        d = np.sqrt(((xs - xs[q]) ** 2).sum(1))
        want[q] = [(int(i), float(d[i])) for i in np.lexsort((np.arange(1200), d)) if i != q][:10]
    exact = defaultdict(list)
    for r in ann.search(df, probes=ann.PARTS).orderBy("query_id", "rank").collect():
        exact[r["query_id"]].append((r["vec_id"], r["score"]))
    assert {q: [i for i, _ in v] for q, v in exact.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(exact[q], want[q], strict=True))
    found = {(r["query_id"], r["vec_id"]) for r in ann.search(df).collect()}
    hits = sum((q, i) in found for q, v in want.items() for i, _ in v)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_fits_on_distinct_vectors(spark, monkeypatch):
    """A vector that a third of the rows repeat is in the sample at most once, and recall stays."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "vec_id long, embedding array<float>")
    least = df.orderBy(F.xxhash64(F.col("embedding").cast("array<double>"))).first()["vec_id"]
    x[1000:] = x[least]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "vec_id long, embedding array<float>")
    samples, fit = [], ann.fit_router
    monkeypatch.setattr(ann, "fit_router", lambda sample, parts: samples.append(sample) or fit(sample, parts))
    found = {(r["query_id"], r["vec_id"]) for r in ann.search(df, every=50, sample_rows=400).collect()}
    assert len(samples[0]) == len(np.unique(samples[0], axis=0)) == 400
    xs, hits, asked = x.astype(float), 0, 0
    for q in range(0, 1500, 50):
        d = np.sqrt(((xs - xs[q]) ** 2).sum(1))
        near = [int(i) for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        hits, asked = hits + sum((q, i) in found for i in near), asked + len(near)
    print("recall", hits / asked)
    assert hits >= 0.9 * asked


# ---- op4 -------------------------------------------------------------------------------------------------------------


def test_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (align.MATCH if a[i] == b[j] else align.MISMATCH), h[i, j + 1] - align.GAP, h[i + 1, j] - align.GAP)
        score, i0, i1, j0, j1 = align.smith_waterman(a, b)
        assert score == h.max() and 0 <= i0 <= i1 <= len(a) and 0 <= j0 <= j1 <= len(b)


def test_leaks(spark, monkeypatch):
    rng = random.Random(1)
    tests = [words(rng, rng.randrange(20, 60)) for _ in range(12)] + [["short", "item"]]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(tests)], "item_id long, text string")
    texts, want = [], {}
    for k in range(60):
        body = words(rng, 150)
        if k % 3 == 0:
            i = k // 3 % 12
            leak = list(tests[i])
            if k % 2:  # every eighth word replaced, one dropped
                leak = [w if j % 8 else "zz" for j, w in enumerate(leak)][1:]
            body[40:40] = [w.upper() + "," for w in leak]
            want[k] = i
        texts.append(" ".join(body))
    df = docs(spark, texts)
    for size in (decontaminate.BROADCAST_BYTES, 300):  # sent, and joined
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", size)
        got = {r["doc_id"]: r["item_id"] for r in decontaminate.find_leaks(df, bench).collect()}
        assert got == want
        kept = {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()}
        assert kept == set(range(60)) - set(want)


def test_leak_edited_beside_exact_copies(spark):
    """The n-grams that edits destroy are the rare ones where exact copies stand beside an edited one."""
    rng = random.Random(3)
    tests = [[f"t{i}n{j}" for j in range(rng.randrange(30, 60))] for i in range(20)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(tests)], "item_id long, text string")
    texts, want = [], set()
    for i, t in enumerate(tests):
        edited = [w if j % 7 and j % 11 else "zz" for j, w in enumerate(t)]
        spread = [x for j, w in enumerate(t) for x in ((w,) if j < 8 or j % 3 else (w, "yy", "yy"))]  # drifts by over half the item
        for copy in (t, t, edited, spread):
            want.add((len(texts), i))
            texts.append(" ".join(words(rng, 80) + copy + words(rng, 80)))
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
    assert set(found) == want
    for (k, i), r in found.items():
        assert r["score"] == align.smith_waterman(np.array([hash(w) for w in tests[i]]), np.array([hash(w) for w in texts[k].split()]))[0] / (2 * len(tests[i]))
    assert decontaminate.drop_leaks(docs(spark, texts), bench).count() == 0


# ---- op5 -------------------------------------------------------------------------------------------------------------


def one_by_one(lengths, sizes, permitted):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] - b[1] >= n]
        if fit:
            min(fit, key=lambda b: b[0] - b[1])[1] += n
        else:
            usable = [s for s in sizes if s >= n] or [min(s for s in permitted if s >= n)]
            bins.append([min(usable, key=lambda s: (s / (s // n), s)), n])
    return sum(min(s for s in permitted if s >= used) for _, used in bins), sorted(used for _, used in bins)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_item_by_item(seed):
    rng = random.Random(seed)
    sizes = [16, 32, 64]
    lengths = [rng.randrange(1, 65) if rng.random() < 0.7 else rng.choice([5, 17]) for _ in range(rng.randrange(1, 200))]
    plan = packing.plan_bins(sorted(Counter(lengths).items()), sizes)
    assert plan.cost == min(one_by_one(lengths, some, sizes)[0] for k in (1, 2, 3) for some in combinations(sizes, k))


def test_every_set_of_seven_sizes_is_tried():
    rng, gained = random.Random(8), 0
    for _ in range(30):
        sizes = sorted(rng.sample(range(20, 200), 7))
        hist = sorted(Counter(rng.randrange(1, sizes[-1] + 1) for _ in range(60)).items())
        price = {c: float(c) for c in sizes}
        cost = packing.plan_bins(hist, sizes).cost
        sets = [[s for k, s in enumerate(sizes) if mask >> k & 1] for mask in range(1, 128)]
        assert cost == min(packing._best_fit(hist, opened, price, sizes).cost for opened in sets)
        gained += cost < min(packing._best_fit(hist, sizes[:k], price, sizes).cost for k in range(1, 8))
    assert gained > 10


def test_pack(spark):
    rng = random.Random(3)
    n = [rng.randrange(0, 90) for _ in range(400)] + [500, 64, 64, 129]
    rows = packing.pack(docs(spark, [" ".join(["w"] * k) for k in n]), (16, 32, 64)).collect()
    total, bins = Counter(), defaultdict(list)
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
        if r["n_tokens"]:
            bins[r["bin_id"]].append((r["offset"], r["n_tokens"], r["capacity"]))
        else:
            assert r["bin_id"] is None
    assert [total[i] for i in range(len(n))] == n
    for parts in bins.values():
        parts.sort()
        assert all(a + b == c for (a, b, _), (c, _, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        fill = sum(p[1] for p in parts)
        assert {p[2] for p in parts} == {min(c for c in (16, 32, 64) if c >= fill)}
    assert sorted(bins) == list(range(len(bins)))


# ---- op6 -------------------------------------------------------------------------------------------------------------


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(c for c, x in zip(b, mask) if not x)
        out.append((len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [512 << 10, 400])
def test_suffix_dedup(spark, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    rng = random.Random(4)
    base = "".join(rng.choice("abcdé ") for _ in range(300))
    texts = [base, base, base[40:200], "x" + base[:90] + "yy" + base[100:], "ab" * 200, "for " * 60, "z" * 100, "z" * 19, None, "", "q" * 21, base[::-1]]
    texts += ["".join(rng.choice("ab") for _ in range(200)) for _ in range(6)] + [base[i : i + 60] for i in range(0, 200, 23)]
    ids = list(range(len(texts) - 1)) + [0]
    got = suffixes.dedup_substrings(docs(spark, texts, ids), length=20).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(removed(texts, 20))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for size in ([5, 9, 1, 30], [40], [3] * 12):
        text = rng.integers(97, 99, sum(size)).astype(np.uint8)
        first = np.cumsum(size) - size
        seg, end = np.repeat(np.arange(len(size)), size), np.repeat(first + size, size)
        sa, levels = suffixes.suffix_array(text, seg, end)
        key = [(bytes(text[i : end[i]]), seg[i]) for i in range(len(text))]
        assert sa.tolist() == sorted(range(len(text)), key=key.__getitem__)
        for cap in (3, 8):
            lcp = suffixes.common_prefixes(text, first, end, sa, levels, cap)
            for a, b in zip(sa, sa[1:]):
                x, y = key[a][0], key[b][0]
                if len(y) >= cap:
                    assert lcp[b] == min(cap, next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))))


# ---- op7 -------------------------------------------------------------------------------------------------------------


def test_minimisers():
    rng = np.random.default_rng(0)
    for counts in ([7, 0, 30, 1], [100]):
        first = np.concatenate([[0], np.cumsum(counts)])
        h = rng.integers(0, 20, first[-1]).astype(np.uint64)
        want = set()
        for a, b in zip(first, first[1:]):
            for s in range(a, b):
                part = h[s : min(s + 5, b)]
                want |= {s + i for i in np.flatnonzero(part == part.min())}
        assert substrings.minimisers(h, first, 5).tolist() == sorted(want)


def test_chains_are_best():
    rng = np.random.default_rng(1)
    for _ in range(30):
        b = substrings.blocks(rng.integers(0, 300, 12), rng.integers(0, 300, 12))
        end = b[:, 1] + b[:, 2] - b[:, 0]
        best = [0.0] * len(b)
        for i in sorted(range(len(b)), key=lambda i: b[i, 0]):
            gains = [best[j] - substrings.GAP_COST * float(b[i, 0] - b[j, 2] + b[i, 1] - end[j]) for j in range(len(b)) if b[j, 2] <= b[i, 0] and end[j] <= b[i, 1]]
            best[i] = b[i, 3] + max([0.0, *gains])
        found = substrings.chains(b)
        if max(best) >= substrings.MIN_SEEDS and found:
            c = found[0]
            ends = c[:, 1] + c[:, 2] - c[:, 0]
            score = c[:, 3].sum() - substrings.GAP_COST * float((c[1:, 0] - c[:-1, 2]).sum() + (c[1:, 1] - ends[:-1]).sum())
            assert score == pytest.approx(max(best))


def test_passages(spark):
    rng = random.Random(6)
    passages = [words(rng, n, 5000) for n in (55, 90, 140)]
    texts, want = [], defaultdict(list)
    for k in range(40):
        body = words(rng, 120, 5000)
        if k % 4 == 1:
            p = list(passages[k % 3])
            if k % 8 == 5:
                p = [w if j % 14 else "edit" for j, w in enumerate(p)]
                del p[20]
            body[30:30] = p
            want[k % 3].append((k, 30, 30 + len(p)))
        texts.append(" ".join(body))
    df = docs(spark, texts)
    got = defaultdict(list)
    for r in substrings.find_passages(df).collect():
        got[r["doc_id"]].append((r["first_word"], r["end_word"], r["source_id"]))
    repeats = {k: (lo, hi) for spots in want.values() for k, lo, hi in spots[1:]}
    assert set(got) == set(repeats)
    for k, (lo, hi) in repeats.items():
        cover = set().union(*[range(a, b) for a, b, _ in got[k]])
        assert len(cover & set(range(lo, hi))) >= 0.85 * (hi - lo) and len(cover - set(range(lo, hi))) <= 6
    kept = {r["doc_id"]: r for r in substrings.drop_passages(df).collect()}
    assert len(kept) == 40
    for k, r in kept.items():
        assert r["n_chars"] == len(r["text"]) and (r["text"] == texts[k]) == (k not in repeats)


def test_edited_passages_share_seeds():
    """Every eighth word of 55 replaced, contexts differ: what chaining needs is left."""
    rng = np.random.default_rng(5)
    new = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    for _ in range(100):
        passage = new(55)
        edited = np.where(np.arange(55) % 8 == 7, new(55), passage)
        grams = [tk.gram_hash(np.concatenate([new(60), p, new(60)]), substrings.K) for p in (passage, edited)]
        a, b = ({int(h[i]) for i in substrings.minimisers(h, np.array([0, len(h)]), substrings.WINDOW)} for h in grams)
        assert len(a & b) >= substrings.MIN_SEEDS


def test_seeds_of_many_documents_at_once(monkeypatch):
    """A batch of many short documents takes one pass, with the strings of each document alone; a document goes on over batches."""
    rng = np.random.default_rng(8)
    rid = np.sort(rng.integers(0, 500, 3000))
    pos = np.concatenate([rng.permutation(4 * n)[:n] for n in np.unique(rid, return_counts=True)[1]])
    table = pa.table({"gram": rng.integers(0, 40, 3000), "rid": rid, "pos": pos.astype(np.int32), "owner": rng.random(3000) < 0.2, "open": rng.random(3000) < 0.5, "low": rng.integers(0, 9, 3000)})
    want = []
    for k in np.unique(rid):
        own = table.filter(pa.array(rid == k)).sort_by("pos")
        at = own["pos"].to_numpy().astype(np.int64)
        h, i, j = substrings.strings(own["gram"].to_numpy().view(np.uint64), at, own["low"].to_numpy())
        owner, left = (own[c].to_numpy() for c in ("owner", "open"))
        want += [(x, k, at[a], at[b] - at[a], left[a : b + 1].any() and not owner[a : b + 1].any()) for x, a, b in zip(h.view(np.int64).tolist(), i, j)]
    calls, plain = [], substrings.strings
    monkeypatch.setattr(substrings, "strings", lambda *x: calls.append(1) or plain(*x))
    for size in (3000, 700, 3):
        calls.clear()
        got = [tuple(r.values()) for b in substrings._strings(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted(got) == sorted(want) and (size < 700 or len(calls) <= 3000 // size + 2)


def test_seeds_in_passages_are_not_open():
    rng = np.random.default_rng(10)
    rows, want = [], []
    for k in range(60):
        spans = [(int(lo), int(lo + rng.integers(40, 90))) for lo in rng.integers(0, 300, rng.integers(3))]
        rows += [(k, 0, lo, hi, None) for lo, hi in spans]
        for p in rng.permutation(400)[:30].tolist():
            kind, gram = int(rng.integers(1, 3)), int(rng.integers(-(2**63), 2**63))
            rows.append((k, kind, p, 0, gram))
            want.append((gram, k, p, kind == 2, kind == 1 and not any(lo <= p <= hi - substrings.K for lo, hi in spans)))
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["rid", "kind", "pos", "end", "gram"])
    for size in (2000, 70, 7):
        got = [tuple(r.values()) for b in substrings._open(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted(got) == sorted(want)


def test_slices_take_bounded_memory():
    """Arrays of a task that goes through long batches of texts."""
    rng = random.Random(9)
    texts = pa.record_batch([pa.array(range(2000)), pa.array([" ".join(words(rng, 600)) for _ in range(2000)])], names=["rid", "text"])
    tracemalloc.start()
    try:
        assert sum(1 for _, _, data, off in tk.slices(texts.column(1)) if tk.words(data, off, loose=True))
        assert tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("edits", [False, True])
def test_passage_in_parts_of_other_owners(spark, edits):
    """Documents that hold overlapping parts own all seeds; two later ones share the whole passage."""
    rng = random.Random(21)
    texts, want = [], {}
    for case in range(30):
        whole = [f"p{case}q{j}" for j in range(rng.randrange(56, 70))]
        third = len(whole) // 3
        cuts = ([(0, 30), (30, None)], [(0, 30), (15, 45), (30, None)], [(0, third), (third, 2 * third), (2 * third, None)])[case % 3]
        copy = [w if not edits or j % 12 != 11 else f"e{case}" for j, w in enumerate(whole)]
        for p in [whole[a:b] for a, b in cuts] + [whole, copy]:
            texts.append(" ".join(words(rng, 30, 10**6) + p + words(rng, 30, 10**6)))
        want[len(texts) - 1] = (len(texts) - 2, 30, 30 + len(whole))
    got = {(r["doc_id"], r["source_id"]): (r["first_word"], r["end_word"]) for r in substrings.find_passages(docs(spark, texts)).collect()}
    assert set(got) == {(k, o) for k, (o, _, _) in want.items()}
    for k, (o, lo, hi) in want.items():
        assert got[k, o] == (lo, hi) or edits and got[k, o][0] == lo and hi - got[k, o][1] <= 5  # an edit and up to four words after it score below 0


def every_pair(texts):
    """Words of each document in passages that it shares with an earlier one, by chaining all seeds of all pairs."""
    hashed = []
    for t in texts:
        data, off = tk.text_buffer(pa.array([t]))
        w = tk.words(data, off, loose=True)
        h, _, p = tk.grams(w, substrings.K)
        pick = substrings.minimisers(h, np.array([0, len(h)]), substrings.WINDOW)
        hashed.append((w.hash, h[pick], p[pick]))
    out = defaultdict(set)
    for i, (a, ga, pa_) in enumerate(hashed):
        for b, gb, pb in hashed[:i]:
            x, y = np.nonzero(ga[:, None] == gb[None, :])
            if len(x) < substrings.MIN_SEEDS:
                continue
            for c in substrings.chains(substrings.blocks(pa_[x], pb[y])):
                lo, olo = max(0, int(c[0, 0]) - substrings.PAD), max(0, int(c[0, 1]) - substrings.PAD)
                hi, ohi = int(c[-1, 2]) + substrings.PAD, int(c[-1, 1] + c[-1, 2] - c[-1, 0]) + substrings.PAD
                for s, e, _ in substrings.runs(substrings.align(a[lo:hi], b[olo:ohi], c[:, :3] - np.array([lo, olo, lo]))):
                    out[i] |= set(range(lo + s, lo + e))
    return out


def test_passages_do_not_depend_on_partitions(spark):
    """Documents with copies and edited copies of copies, dealt to 1, 4 and 32 tasks, give the same rows."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = [sorted(map(tuple, substrings.find_passages(df.repartition(n)).collect())) for n in (1, 4, 32)]
    assert got[0] and got[0] == got[1] == got[2]


def test_passages_against_all_pairs(spark):
    """Texts of shared phrases and edited passages: at least nine tenths of the words that chaining all pairs covers."""
    rng = random.Random(31)
    phrases = [words(rng, rng.randrange(8, 30), 10**6) for _ in range(25)]
    passages = [sum((rng.choice(phrases) + words(rng, rng.randrange(4), 10**6) for _ in range(4)), []) for _ in range(12)]
    texts = []
    for _ in range(70):
        body = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages) if rng.random() < 0.6 else rng.choice(phrases)
            body += words(rng, rng.randrange(10, 40), 10**6) + [w if rng.random() > 0.06 else f"e{rng.randrange(10**6)}" for w in p]
        texts.append(" ".join(body))
    want, got = every_pair(texts), defaultdict(set)
    rows = substrings.find_passages(docs(spark, texts)).collect()
    for r in rows:
        got[r["doc_id"]] |= set(range(r["first_word"], r["end_word"]))
    total, found = sum(map(len, want.values())), sum(len(want[i] & got[i]) for i in want)
    print("words covered", found, "of", total)
    assert total > 1000 and found >= 0.9 * total
    assert len(rows) == len(set(map(tuple, rows)))


def test_runs_near_each_other():
    """Two passages 11 to 20 words apart are both reported, once each; any stretch is what its definition says."""
    for gap in range(11, 21):
        hit = np.array([True] * 100 + [False] * gap + [True] * 41)
        assert substrings.runs(hit) == [(0, 100, 100), (100 + gap, 141 + gap, 41)]
        assert substrings.runs(hit[::-1]) == [(0, 41, 41), (41 + gap, 141 + gap, 100)]
    rng = random.Random(12)
    for _ in range(60):
        hit = np.array([rng.random() < rng.choice([0.5, 0.9]) for _ in range(40)])
        total = np.concatenate([[0], np.cumsum(np.where(hit, 20, -80))])
        strict = [(i, j) for i in range(40) for j in range(i + 1, 41) if total[i] < min(total[i + 1 : j + 1]) and total[j] > max(total[i:j])]
        want = [(i, j, int(hit[i:j].sum())) for i, j in strict if not any((a, b) != (i, j) and a <= i and j <= b for a, b in strict)]
        assert substrings.runs(hit, least=1) == want


# ---- op8 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_feistel(n):
    for seed in (0, 5):
        f = sharding.Feistel(n, seed)
        p = f.forward(np.arange(n))
        assert sorted(p.tolist()) == list(range(n)) and f.inverse(p).tolist() == list(range(n))


def test_shards(spark):
    rng = random.Random(8)
    texts = [" ".join(words(rng, rng.randrange(0, 20))) for _ in range(101)] + [None]
    rows = sharding.shard(docs(spark, texts), 8).collect()
    f = sharding.Feistel(102)
    per = defaultdict(list)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "rows", None)
        assert r["row_number"] == r["doc_id"] == f.inverse(np.array([r["slot"] * 8 + r["shard"]]))[0]
        per[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1


# ---- op9 -------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["grobble", "snark", "vexil"]
    texts, marks = [], []
    for k in range(900):
        body = words(rng, rng.randrange(20, 200), 3000)
        if k % 5 == 0:
            for _ in range(3 + len(body) // 25):
                body[rng.randrange(len(body))] = rng.choice(bad)
        texts.append(" ".join(body))
        marks.append((k, 1, int(k % 5 == 0)))
    df = docs(spark, texts)
    lab = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(df, lab).collect()
    assert len(rows) == 900
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(df, flipped).collect()} == {(r["doc_id"], r["score"]) for r in rows}
    joined = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, lab, broadcast_rows=0).collect()}
    assert all(abs(joined[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(df, lab).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["predicted"]}


# ---- op10 ------------------------------------------------------------------------------------------------------------


def shingles(text, n=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("hot,small", [(4, 8), (2, 2)])
def test_jaccard(spark, monkeypatch, hot, small):
    monkeypatch.setattr(jaccard, "HOT_DF", hot)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rng = random.Random(10)
    common, texts = words(rng, 25, 5000), []
    for _ in range(12):
        base = words(rng, rng.randrange(30, 120), 5000)
        for _ in range(rng.randrange(1, 14)):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(999)}"
            texts.append(" ".join(t + (common if rng.random() < 0.3 else [])))
    texts += ["", None, "a b", "A b", "a b c", " ".join(["x"] * 50), " ".join(["x"] * 9)]
    s = [shingles(t) for t in texts]
    parent = list(range(len(s)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = defaultdict(set)
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
                if s[i] != s[j]:
                    near[i].add(frozenset(s[j]))
                    near[j].add(frozenset(s[i]))
    got = jaccard.jaccard_join(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["n_links"]) == (len(s[i]), find(i), len(near[i]))
        assert r["class_id"] == min((j for j in range(len(s)) if s[i] and s[j] == s[i]), default=i)
    kept = {r["doc_id"] for r in jaccard.keep_one(docs(spark, texts)).collect()}
    assert kept == {i for i in range(len(s)) if find(i) == i}


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent}


def test_jaccard_blocks_and_fragments(spark, monkeypatch):
    """Groups over several blocks and fragments: near copies of one text beside many short texts that share a phrase."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "FULL", 300)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    rng = random.Random(5)
    base, phrase = words(rng, 120), words(rng, 12)
    texts = []
    for _ in range(30):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(phrase + words(rng, rng.randrange(5))) for _ in range(40)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    linked = defaultdict(set)
    for i, a in enumerate(sets):
        for b in sets:
            if a != b and 100 * len(a & b) >= 80 * len(a | b):
                linked[i].add(frozenset(b))
    got = {r["doc_id"]: r for r in jaccard.jaccard_join(docs(spark, texts)).collect()}
    assert max(map(len, linked.values())) > 8
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(linked[i]) for i in range(len(texts))}


def test_jaccard_short_texts_in_bounded_memory():
    """What a task does for two full blocks of short texts that share one phrase."""
    import tracemalloc

    import pyarrow as pa

    n = 2 * jaccard.BLOCK
    rng = np.random.default_rng(0)
    shared = np.arange(4, dtype=np.uint64)
    grams = [np.sort(np.concatenate([shared, rng.integers(10, 2**60, 5).astype(np.uint64)])).tobytes() for _ in range(n)]
    table = pa.table({"n": pa.array([9] * n), "grams": pa.array(grams, pa.binary()), "side": pa.array([0] * (n // 2) + [1] * (n // 2)), "bi": pa.array([0] * n), "bj": pa.array([1] * n)})
    tracemalloc.start()
    assert jaccard._fragment(table, 80) == b""
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_string_ids(spark):
    """Ids of any type: here text, in every operator that gives documents keys."""
    rng = random.Random(8)
    shared = words(rng, 60)
    rows = [(f"u-{i}", " ".join(words(rng, 30) + shared)) for i in range(3)] + [("v", " ".join(shared)), ("w", " ".join(shared))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    near = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(df).collect()}
    assert near["w"] == "v" and near["u-1"] == "u-1"
    assert {r["doc_id"] for r in suffixes.dedup_substrings(df, 100).collect()} == {r[0] for r in rows}
    found = {(r["doc_id"], r["source_id"]) for r in substrings.find_passages(df).collect()}
    assert {x for p in found for x in p} == {r[0] for r in rows}


def test_kneser_ney_equals_plain_model(spark):
    """Terms of a small corpus against dictionaries."""
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randrange(3, 40), 30) + (["bad"] * (k % 3) if k % 4 == 0 else [])) for k in range(120)]
    label = [int(k % 4 == 0) for k in range(120)]
    df = spark.createDataFrame(list(zip(label, texts, strict=True)), "__toxic int, text string")
    c = toxicity.count(df, "text")
    pair, inside = [Counter(), Counter()], [Counter(), Counter()]
    for t, y in zip(texts, label, strict=True):
        w = t.split()
        pair[y].update(set(zip([None, *w], w, strict=False)))
        inside[y].update(set(w))
    before = [Counter(v for _, v in p) for p in pair]
    both = Counter(v for _, v in pair[0].keys() | pair[1].keys())
    n, total = [sum(b.values()) for b in before], sum(both.values())
    kn = lambda counts: (lambda a, b: a / (a + 2 * b) if a else 0.5)(*(sum(x == k for x in counts.values()) for k in (1, 2)))
    ds = kn(both)
    base = ds * len(both) / (len(both) + 1) / total
    side = sum(inside[1].values()) / sum(sum(f.values()) for f in inside)
    counted = {p for p in pair[0].keys() | pair[1].keys() if pair[0][p] + pair[1][p] > 1}

    def p_word(y, v):
        d = kn(before[y])
        kept = sum(max(k - d, 0) for k in before[y].values())
        return max(before[y][v] - d, 0) / n[y] + (1 - kept / n[y]) * (max(both[v] - ds, 0) / total + base)

    def p_pair(y, u, v):
        d, all_ = kn(pair[y]), sum(k for (a, _), k in pair[y].items() if a == u)
        if not all_ or not any(a == u for a, _ in counted):
            return p_word(y, v)
        kept = sum(max(k - d, 0) for (a, b), k in pair[y].items() if a == u and (a, b) in counted)
        return (max(pair[y][u, v] - d, 0) / all_ if (u, v) in counted else 0) + (1 - kept / all_) * p_word(y, v)

    def weight(prior, t, o, share):
        gain = sum(k * np.log(k / (t + o) / s) for k, s in ((t, share), (o, 1 - share)) if k)
        return 1 / (1 + (1 - prior) / prior * np.exp(-gain))

    ratio = lambda p, *a: np.log(p(1, *a)) - np.log(p(0, *a))
    stored = lambda x, default: x if abs(x - default) > toxicity.TOLERANCE else default
    for q, r in ((0.01, 0.001), (0.2, 0.3)):
        model = toxicity.Model.collect(*toxicity.learn(c, q, r))
        assert len(model.tables[0][0])

        def term(u, v):
            t, o = inside[1][v], inside[0][v]
            w = weight(q, t, o, side)
            unseen = q * ratio(p_word, "not seen")
            fallback = stored(r * (ratio(p_pair, u, "not seen") - ratio(p_word, "not seen")), 0.0)
            added = fallback
            if (u, v) in counted:
                share = min(max(w * t / (t + o) + (1 - w) * side, 1e-6), 1 - 1e-6)
                added = stored(weight(r, pair[1][u, v], pair[0][u, v], share) * (ratio(p_pair, u, v) - ratio(p_word, v)), fallback)
            return stored(w * ratio(p_word, v), unseen) + added

        for t in [*texts[:20], "bad w1x bad", "never seen w2x"]:
            w = t.split()
            data, off = tk.text_buffer(pa.array([t]))
            x, k = model.sums(tk.words(data, off, loose=True))
            assert k[0] == len(w) and abs(x[0] - sum(term(u, v) for u, v in zip([None, *w], w, strict=False))) < 1e-9
    assert max(*c.word_d.values(), *c.pair_d.values()) < 1


def test_pairs_alone_tell_classes_apart(spark):
    """Both classes have the same words equally often; only their order differs."""
    rng = random.Random(12)
    texts = []
    for k in range(1200):
        body = words(rng, rng.randrange(30, 80), 400)
        for _ in range(4):
            at = rng.randrange(len(body))
            body[at:at] = ["green", "tide"] if k % 3 == 0 else ["tide", "green"]
        texts.append(" ".join(body))
    lab = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(1200)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(docs(spark, texts), lab).collect()
    for held in (True, False):
        these = [r for r in rows if r["held_out"] == held]
        assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in these) >= 0.97 * len(these)


def test_divided_anchors_equal_one_array(spark, monkeypatch):
    """Anchors with too much text are cut again and again, and dealt to shards at last; nothing changes."""
    rng = random.Random(17)
    shared = " ".join(words(rng, 40))
    texts = [" ".join(words(rng, rng.randrange(30))) + shared[: rng.randrange(60, 300)] + " ".join(words(rng, rng.randrange(30))) for _ in range(40)] + ["ab" * 300, "ab" * 200, "xyz" + "ab" * 90]
    want = removed(texts, 60)
    for shard, levels in ((1 << 19, 3), (2000, 3), (2000, 1), (600, 0)):
        monkeypatch.setattr(suffixes, "SHARD", shard)
        monkeypatch.setattr(suffixes, "LEVELS", levels)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup_substrings(docs(spark, texts), 60).collect()}
        assert got == dict(enumerate(want)), (shard, levels)


def test_divided_anchors_read_texts_no_more(spark, monkeypatch):
    """Texts are gone through equally often with and without anchors to divide: stretches carry their bytes once they are cut."""
    rng = random.Random(18)
    shared = " ".join(words(rng, 40))
    texts = [" ".join(words(rng, 9)) + shared[: rng.randrange(60, 300)] + " ".join(words(rng, 9)) for _ in range(40)]
    read = []
    for shard in (1 << 19, 2000):
        monkeypatch.setattr(suffixes, "SHARD", shard)
        seen = spark.sparkContext.accumulator(0)

        def passed(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        table = docs(spark, texts)
        suffixes.dedup_substrings(table.mapInArrow(passed, table.schema), 60).collect()
        read.append(seen.value)
    assert read[0] == read[1]


def test_long_licenses_by_digest(spark):
    """Whole long licences in other capitals and wrapping; only where the system has their texts."""
    import os
    import textwrap

    folder, names = "/usr/share/common-licenses", {"Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GPL-3": "GPL-3.0"}
    there = [f for f in names if os.path.exists(f"{folder}/{f}")]
    raw = [open(f"{folder}/{f}").read() for f in there]
    forms = [*raw, *[t.upper() for t in raw], *["\n\n".join(textwrap.fill(p, 50) for p in re.split(r"\n\s*\n", t)) for f, t in zip(there, raw, strict=True) if f != "GPL-3"], *[t[:-40] for t in raw]]
    want = [names[f] for f in there] * 2 + [names[f] for f in there if f != "GPL-3"] + [None] * len(raw)
    got = licenses.scan_licenses(docs(spark, forms)).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == want
    assert all(re.fullmatch("[0-9a-f]{64}", d) for _, d in licenses.DIGESTS)
