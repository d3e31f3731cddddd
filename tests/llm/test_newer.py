"""Spelling variants, shards and whitening against plain versions of themselves, with the odd cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from test_llm import LONG, odd_docs, vectors


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_fm_index():
    from tastegrid.llm.fm_index import FMIndex

    rnd = random.Random(5)
    for trial in range(120):
        letters = "ab" if trial % 2 else "abcé𝄞"
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 60))} | ({"ab" * 300, "ab" * 299 + "a"} if trial == 7 else set()))
        parts = rnd.choice([2, 4, 8])
        asked = [(k, t * len(w) // parts, (t + 1) * len(w) // parts) for k, w in enumerate(words) for t in range(parts)]
        k, i, j = np.array([x for x in asked if x[1] < x[2]]).T
        hit, rank = FMIndex(words).near([words[x] for x in k], i, j)
        want = [(x, y) for x, a in enumerate(words) for y, b in enumerate(words) if a != b and near(a, b)]
        assert sorted(zip(k[hit].tolist(), rank.tolist())) == want  # each once


def plain_variants(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            at = h % len(low)
            word = low[:at] + low[at + 1 :] if h % 97 == 0 else low
            if len(word) >= 5:
                count[word] += 1
    n = {w: c for w, c in count.items() if c >= 3}
    form, nears = {}, {}
    for w in n:
        others = sorted((v for v in n if v != w and near(w, v)), key=lambda v: (-n[v], v))
        nears[w], form[w] = len(others), others[0] if others and n[others[0]] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], nears[w], form[w], form[w] and n[form[w]], root))
    return out


@pytest.mark.parametrize("hot", [None, 12])
def test_spelling(spark, monkeypatch, hot):
    from tastegrid.llm import spelling as S
    from tastegrid.llm.common import ship

    ship(spark)
    if hot:  # halves are taken apart again and again
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "BLOCK_POINTS", 500)
    rnd = random.Random(2)
    base = ["straße", "naïveté", "letter", "lettre", "better", "aaaaaa", "internationalisation", "ÉCOLES"]
    typo = lambda w: (lambda i: rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("aet") + w[i:], w[:i] + rnd.choice("aet") + w[i + 1 :], w]))(rnd.randrange(len(w)))
    extra = [(100 + i, " ".join(typo(typo(rnd.choice(base))).title() if rnd.random() < 0.3 else typo(rnd.choice(base)) for _ in range(60)), "en", "a") for i in range(60)]
    docs = odd_docs(spark, extra)
    got = S.variants(S.vocabulary(docs)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(got) == len(want) > 80 and {tuple(r) for r in got} == want and any(r.root not in (r.word, r.form) for r in got)
    assert S.variants(S.vocabulary(docs.limit(0))).count() == 0


@pytest.mark.parametrize("ranges", [None, 3])
def test_shards(spark, ranges):
    from tastegrid.llm import sharding as S

    docs = odd_docs(spark, [(7000, LONG, "en", "a")] * 40).withColumnsRenamed({"score": "shard", "m": "slot"})
    rows = S.shards(S.measured(docs), 5, ranges).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(r.doc_id), size(r.text), zlib.crc32((r.text or "").encode())) for r in docs.collect())
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32, r.shard, r.slot))
    total, at, seen = sum(r["size"] for r in rows), 0, Counter()
    for r in rows:
        assert (r.shard, r.slot, r.law, r.grown_shard) == (at * 5 // total, seen[r.shard], "bytes", None)
        seen[r.shard] += 1
        at += r["size"]
    held = Counter()
    for r in rows:
        held[r.shard] += r["size"]
    assert set(seen) == set(range(5)) and max(held.values()) - min(held.values()) <= 2 * max(r["size"] for r in rows)
    assert S.shards(S.measured(docs.limit(0)), 5).count() == 0


def test_shard_files(spark):
    from tastegrid.llm import sharding as S
    from tastegrid.llm.common import scratch_dir

    docs, path = odd_docs(spark), scratch_dir(spark, "shards")
    S.write_shards(docs, 3, path, file_bytes=1 << 15)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1, 2}


def test_eigen():
    from tastegrid.llm.eigen import leading

    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    tests = [rng.normal(size=(n, n)) for n in (1, 2, 3, 17, 64)]
    tests = [x @ x.T for x in tests] + [np.zeros((3, 3)), np.eye(9) * 3, np.ones((20, 20)), np.diag([5.0, 5, 5, 1, 1, 0, 0]), q @ np.diag([4.0] * 10 + [1 + 1e-13 * i for i in range(30)]) @ q.T]
    for a in tests:
        values, axes = leading(a, 32)
        k, size = min(32, len(a)), max(np.abs(a).max(), 1)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=0, atol=1e-13 * size * len(a))
        assert np.abs(a @ axes - axes * values).max() < 1e-12 * size and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12


def test_whitening(spark):
    from tastegrid.llm.common import ship
    from tastegrid.llm.whitening import whiten

    ship(spark)
    df, v = vectors(spark)
    df = df.union(spark.createDataFrame([(900, [0.5] * 9, 1), (901, [2.0] * 16, 1), (901, [2.0] * 16, 1)], df.schema))  # a short one, a repeated one
    x = np.vstack([v.astype(float), np.zeros((1, 16)), np.ones((1, 16)), [[0.5] * 9 + [0.0] * 7], np.full((2, 16), 2.0)])
    ids = [*range(400), 460, None, 900, 901, 901]
    x = np.floor(64 * x).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s) / n
    cov = c.T @ c / n
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1], p[:, ::-1]
    want = c @ p / np.sqrt(e)
    got = whiten(df, components=10).toPandas()
    assert len(got) == 10 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and 0 <= got.identity_error[0] < 1e-10
    assert got.component.min() == 1 and sorted(got.vec_id[got.component == 3].fillna(-1)) == sorted(-1 if i is None else i for i in ids)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    for k, g in got.groupby("component"):
        g = g.assign(vec_id=g.vec_id.fillna(-1).astype(int)).sort_values("vec_id", kind="stable")
        order = np.argsort([-1 if i is None else i for i in ids], kind="stable")
        w = want[order, k - 1]
        sign = np.sign((w * g.whitened).sum())
        assert np.allclose(g.whitened * sign, w, atol=1e-9) and (g.deviation.to_numpy() == deviation[order]).all()
        assert np.allclose(g.explained, e[k - 1] / np.trace(cov), rtol=1e-10)
    assert whiten(df.limit(0)).count() == 0 and whiten(df.filter("vec_id = 901")).count() == 0
    assert whiten(df.filter("vec_id in (1, 2, 3)")).select("component").distinct().count() == 2  # three points span a plane
    with pytest.raises(Exception, match="64 bits"):
        whiten(spark.createDataFrame([(1, [1e30]), (2, [1.0])], "vec_id long, embedding array<double>")).count()


def test_first_lists_are_merged_from_what_can_be_among_the_best():
    import numpy as np

    from tastegrid.llm import nn_descent as N

    rng = np.random.default_rng(3)
    k, node = 5, np.repeat(np.arange(40), rng.integers(1, 60, 40))
    for kinds in (12, 1000):  # many copies of few ids, and few of many
        ids = rng.integers(0, kinds, len(node))
        scores = np.round(rng.normal(size=len(node)), 1).astype(np.float32)  # with ties
        new = np.ones(len(node), bool)
        some = N._likely(node, ids, scores, k)
        assert N._kept(node[some], ids[some], scores[some], new[some], k).equals(N._kept(node, ids, scores, new, k))
        assert some.sum() < len(node) if kinds == 1000 else True
    s = np.round(rng.normal(size=(30, 50)), 1).astype(np.float32)
    a, c = N._tops(s, 7)
    assert a.tolist() == np.repeat(np.arange(30), 7).tolist() and len(set(zip(a.tolist(), c.tolist(), strict=True))) == 210
    assert (np.sort(s[a, c].reshape(30, 7), axis=1) == np.sort(s, axis=1)[:, -7:]).all()
