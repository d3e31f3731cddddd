"""Each operator against a plain version of itself, on small tables with the odd cases in them."""

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, m long"
LONG = " ".join(f"word{i % 97}x{i % 89}" for i in range(4000))
PASSAGE = " ".join(f"passage{i} shared" for i in range(40))


def odd_docs(spark, extra=()):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a"), (2, "The quick brown fox jumps over the lazy dog", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n ", "en", "b"),
        (6, LONG, "en", "a"), (7, LONG + " end", "en", "a"), (8, "one", "en", "a"), (9, "ONE", "de", "b"), (10, "two words", "de", None), (10, "two words", "de", None),
        (None, "no id here at all", "en", "a"), (11, "start " + PASSAGE + " end", "en", "a"), (12, "other " + PASSAGE + " tail é中", "en", "c"), (13, "a" * 1500, "en", "c"), (14, "x  y \n\n z  'tis 12é中 <|endoftext|>", "en", "c"), (-5, "Released under the MIT License. Thanks", "en", "c"),
    ]
    return spark.createDataFrame([(i, t, g, s, None, 0.5, "r", 7) for i, t, g, s in [*rows, *extra]], DOCS)


def pairs(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_token_files(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tastegrid.llm import token_files as T
    from tastegrid.llm.common import scratch_dir

    path, folder = P.path("byte_bpe_50k.json"), scratch_dir(spark, "t")
    t = Tokenizer.from_file(path)
    docs = odd_docs(spark)
    T.write_token_files(docs, folder, path, 2)
    got = [tuple(r) for r in T.token_digests(spark, folder).orderBy("start").collect()]
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, at = [], 0
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want and 50256 in t.encode(docs.filter("doc_id = 14").first().text, add_special_tokens=False).ids
    block = spark.read.parquet(folder).orderBy("shard", "seq").first()
    own = [T.document_ids(bytes(block.payload), i) for i in range(block.n_docs)]
    assert [(len(x), zlib.crc32(x.astype("<u4").tobytes())) for x in own] == [w[2:] for w in want[: block.n_docs]]
    empty = scratch_dir(spark, "t")
    T.write_token_files(docs.limit(0), empty, path, 2)
    assert T.token_digests(spark, empty).count() == 0


def test_elias_fano():
    from tastegrid.llm.elias_fano import EliasFano

    rng = np.random.default_rng(0)
    for values in (np.array([0]), np.array([0, 0, 0, 5]), np.sort(rng.integers(0, 10**9, 3000)), np.arange(500), np.array([0, 10**12])):
        e, used = EliasFano.from_bytes((raw := EliasFano.of(values).to_bytes()) + b"rest")
        assert used == len(raw) and (e.all() == values).all() and [e[i] for i in range(len(values))] == values.tolist()
    values = np.cumsum(rng.integers(1, 2000, 20_000))
    assert len(EliasFano.of(values).to_bytes()) * 8 < 13 * len(values)  # 64-bit offsets would take 64


def test_cut_is_exact():
    import random

    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tastegrid.llm.token_files import encode

    rnd = random.Random(3)
    parts = ["a", "foo", "<|endoftext|>", "<|endof", " ", "  ", "\n", "\t", "'s", "12", "é", "中", "!", "--", "\x1c", "\r\n", " ", "　"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(1500)]
    ids, n = encode(pa.array(texts), P.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at = np.concatenate([[0], np.cumsum(n)])
    assert all(ids[at[i] : at[i + 1]].tolist() == e.ids for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)))


def vectors(spark, n=400):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(n, 16)).astype(np.float32)
    v[50:90] = v[50]  # one vector of many rows
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(n)]
    rows += [(n, None, 0), (n + 20, [], 1), (n + 40, [float("nan")] * 16, 1), (n + 60, [0.0] * 16, 2), (n + 80, [None, *[1.0] * 15], 2), (None, [1.0] * 16, 3)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), v


def test_nearest(spark):
    from pyspark.sql import functions as F

    from tastegrid.llm.nn_descent import nearest

    df, v = vectors(spark)
    got = nearest(df, lambda c: F.col(c) % 20 == 0, 20).toPandas()
    x = v.astype(float)
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        top = np.lexsort((np.arange(len(s)), -np.round(s, 9)))[:20]
        assert sorted(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id], atol=1e-12)
        hit += len(set(top) & set(g.vec_id))
    assert set(got.query_id) == set(range(0, 400, 20)) and hit >= 0.9 * len(got)
    assert nearest(df.limit(0), lambda c: F.col(c) % 20 == 0, 20).count() == 0


def test_nearest_beyond_a_block(spark, monkeypatch):
    """2,000 vectors in ranges of some hundred: the rounds and hops have to find what the first blocks can't hold."""
    from pyspark.sql import functions as F

    from tastegrid.llm import nn_descent as N

    monkeypatch.setattr(N, "BLOCK", 100)
    x = np.random.default_rng(8).normal(size=(2000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = N.nearest(df, lambda c: F.col(c) % 20 == 0, 20).toPandas()
    hit, s = 0, x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    for q, g in got.groupby("query_id"):
        assert sorted(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, s[q, g.vec_id], atol=1e-9)
        hit += len(set(np.argsort(-s[q])[:20]) & set(g.vec_id))
    assert got.query_id.nunique() == 100 and hit >= 0.9 * 2000


def test_exhaustive(spark):
    from pyspark.sql import functions as F

    from tastegrid.llm.exhaustive_topk import exhaustive_topk, quantised

    df, v = vectors(spark)
    q = quantised(df, "embedding", 64)
    got = exhaustive_topk(q, q.filter(F.col("vec_id") % 20 == 0), 20, block_rows=64).toPandas()
    w = np.vstack([np.floor(v.astype(float) * 64), np.zeros((61, 16))])
    ids = [*range(400), 420, 460]  # 420 is empty, 460 all zeros
    assert set(got.query_id) == {i for i in ids if i % 20 == 0}
    for query, g in got.groupby("query_id"):
        s = {i: int(w[query] @ w[i]) for i in ids if i != query}
        want = sorted(s, key=lambda i: (-s[i], i))[:20]
        g = g.sort_values("rank")
        assert g.vec_id.tolist() == want and g.score.tolist() == [s[i] for i in want]
    assert exhaustive_topk(q.limit(0), q.limit(0), 20).count() == 0


def test_mixing(spark):
    import duckdb

    from tastegrid.llm import mixing as M

    docs = odd_docs(spark, [(100 + i, f"w{i} " * (i % 17), "en", f"s{i % 5 if i % 3 else 0}") for i in range(400)])
    for params in ({}, {"budget_share": 0.8, "entropy_share": None, "max_repeat": 1.0}, {"budget_share": 2.5, "entropy_share": 0.99, "max_repeat": 4.0}):
        own = M.mix(docs, **params)
        con = duckdb.connect()
        con.register("d", docs.toPandas().astype({"doc_id": "Int64"}))
        sql = f"WITH RECURSIVE {M.mix_sql('d', **params)} SELECT doc_id, source, n_tokens, copies FROM mix_out"
        key = lambda r: str(r)
        want = sorted(((None if a is None else int(a), b, c, d) for a, b, c, d in con.execute(sql).fetchall()), key=key)
        assert sorted(map(tuple, own.drop("src").collect()), key=key) == want
    kept = M.mixed(docs, budget_share=0.8, entropy_share=None, max_repeat=1.0)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert M.mix(docs.limit(0)).count() == 0


def brute_components(fps, threshold=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("hot", [8192, 3])
def test_simhash_links(spark, hot):
    from tastegrid.llm.common import components
    from tastegrid.llm.simhash import near_links

    rng = np.random.default_rng(hot)
    base = [int(x) for x in rng.integers(0, 2**64, 12, dtype=np.uint64)]
    fps = set(base) | {0}
    for b in base[:6]:
        for _ in range(40):
            x = b
            for k in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(x - 2**64 if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(near_links(df, hot_homes=hot), "t").collect()}
    want = brute_components([x & (2**64 - 1) for x in fps])
    assert [got.get(x, x) for x in fps] == [fps[i] for i in want]


def test_simhash(spark):
    from tastegrid.llm import simhash as S

    docs = odd_docs(spark, [(20, LONG.replace("word5x", "word6x", 1), "en", "a")])
    got = {(r.doc_id, r.fingerprint): r.component_id for r in S.simhash_components(docs).collect()}

    def plain(t):
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    roots = brute_components([f for _, f in rows])
    least = {r: min(i for (i, _), q in zip(rows, roots, strict=True) if q == r and i is not None) if any(q == r and i is not None for (i, _), q in zip(rows, roots, strict=True)) else None for r in roots}
    assert got == {(i, f"{f:016x}"): least[q] for (i, f), q in zip(rows, roots, strict=True)}
    kept = S.near_dedup(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 2 not in ids and 4 not in ids and ids.count(10) == 1 and {1, 3, 6, 13, None} <= set(ids)
    assert S.near_dedup(docs.limit(0)).count() == 0


def test_licenses(spark):
    from tastegrid.llm import licenses as L

    filler = " ".join(f"filler{i}" for i in range(300))
    text = {1: filler + " " + L.TEMPLATES["MIT-grant"].lower() + " " + filler, 2: "x " + L.TEMPLATES["GPL-3.0"].replace("This", "That"), 3: L.TEMPLATES["Apache-2.0-header"][:60], 4: "license license license", 5: None, 6: "", 7: "(c) 2020 A. All rights reserved.", 8: filler + " " + L.TEMPLATES["MIT-text"] + " " + filler, 9: L.TEMPLATES["BSD-2-Clause-text"].replace("SOFTWARE", "PROGRAM", 1), 10: filler + L.TEMPLATES["Zlib"]}
    best = {(r.doc_id, r.template): (r.containment, r.word) for r in L.license_matches(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    got = set(best)

    def plain(t):
        w = L.words_of(t or "")
        out = {}
        for name, template in L.TEMPLATES.items():
            own, s = set(L.shingles_of(template)), L.size_of(template)
            n = 3 if s == 4 else 5
            for lo in range(0, len(w), s // 2):
                part = w[lo : lo + s + s // 2]
                share = len(own & {" ".join(part[i : i + n]) for i in range(len(part) - n + 1)}) / len(own)
                if share >= 0.8 and share > out.get(name, (0, 0))[0]:
                    out[name] = (share, lo)
        return {n: (round(x, 6), lo) for n, (x, lo) in out.items()}

    assert best == {(i, n): x for i, t in text.items() for n, x in plain(t).items()} and {(1, "MIT-grant"), (2, "GPL-3.0"), (7, "all-rights-reserved"), (8, "MIT-text"), (9, "BSD-2-Clause-text")} <= got
    again = spark.createDataFrame([(1, text[7]), (1, text[7]), (2, text[7]), (None, text[7])], "doc_id long, text string")
    found = [(r.doc_id, r.template, r.containment, r.word) for r in L.license_matches(again).collect()]
    assert sorted(found, key=str) == [(1, "all-rights-reserved", 1.0, 0), (2, "all-rights-reserved", 1.0, 0), (None, "all-rights-reserved", 1.0, 0)]
    assert L.license_matches(again.limit(0)).count() == 0
    assert L.license_matches(odd_docs(spark)).collect()[0]["template"] == "MIT"


def test_html():
    from tastegrid.llm.html_text import main_text

    page = "<!doctype html><html><head><title>t</title><style>p{}</style><script>var a='</p><article>'</script></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div class='cookie-notice'>accept</div><article><h1>Head &amp; line</h1><p>First <b>bold\n text</b><p>Second<br>line &#233;<div class=ad>buy</div><form>mail<input></form></article><aside>side</aside><section id=comments><p>first comment is very long indeed and has much text in it, much more than the article</p></section><footer>foot</footer></body></html>"
    assert main_text(page) == "Head & line\nFirst bold text\nSecond line é"
    assert main_text(None) == main_text("") == "" and main_text("<p>") == "" and main_text("plain") == "plain"
    body = "".join(f"<p>Paragraph {i} with a fair number of words in it, so that its density is high.</p>" for i in range(5))
    assert main_text(f"<body><div><ul>{'<li><a href=x>link</a></li>' * 20}</ul></div><div id=c>{body}</div></body>").count("\n") == 4
    assert main_text("<div>" * 5000 + "deep") == "deep" and main_text("<a <b <c \"") == ""


def plain_main(root):
    """Composite text density of a well-formed page without furniture, article or main, straight from the formula."""
    import math

    from tastegrid.llm.html_text import INLINE

    nodes, up = [], {}

    def walk(e):
        nodes.append(e)
        for x in e:
            up[x] = e
            walk(x)

    walk(root)
    linked = lambda e: e.tag == "a" or e in up and linked(up[e])
    size = lambda s: len(" ".join((s or "").split()))
    own = {e: size(e.text) + sum(size(x.tail) for x in e) for e in nodes}
    below = lambda e: [x for x in e.iter()]
    c = {e: sum(own[x] for x in below(e)) for e in nodes}
    t = {e: len(below(e)) - 1 for e in nodes}
    lc = {e: sum(own[x] for x in below(e) if linked(x)) for e in nodes}
    lt = {e: sum(x.tag == "a" for x in below(e)[1:]) for e in nodes}

    def density(e):
        if not c[e]:
            return 0.0
        base = math.log(math.log(c[e] / max(c[e] - lc[e], 1) * lc[e] + lc[root] / c[root] * c[e] + math.e))
        return c[e] / max(t[e], 1) * (math.log(c[e] / max(lc[e], 1) * max(t[e], 1) / max(lt[e], 1)) / base if base > 1e-9 else 1)

    dense = {e: density(e) for e in nodes}
    total = {e: own[e] + sum(dense[x] for x in e) for e in nodes}
    best = max(nodes, key=lambda e: (total[e], -nodes.index(e)))
    path = [best]
    while path[-1] in up:
        path.append(up[path[-1]])
    least, inside = min(dense[e] for e in path), set(below(best))
    chosen = [best] + [max(below(e), key=lambda x: (total[x], -nodes.index(x))) for e in nodes if e not in path and up.get(e) in path and up[e] is not best and e.tag not in INLINE and dense[e] >= least and c[e] and e not in inside]
    out = []

    def text(e, block):
        if e.tag not in INLINE:
            block = [[]] if block is None else block
            block.append([])
        block[-1].append(e.text or "")
        for x in e:
            text(x, block)
            block[-1].append(x.tail or "")
        if e.tag not in INLINE:
            block.append([])

    for e in sorted(chosen, key=nodes.index):
        block = [[]]
        text(e, block)
        tail = [" ".join("".join(b).split()) for b in block]
        out += [x for x in tail if x]
    return "\n".join(out)


def test_html_density():
    """Pages without article elements: the densest subtree and those over the threshold of the body path."""
    import random
    import xml.etree.ElementTree as ET

    from tastegrid.llm.html_text import main_text

    rnd, several = random.Random(5), 0

    def grow(e, depth):
        for _ in range(rnd.randrange(1, 5)):
            x = ET.SubElement(e, rnd.choice(["div", "div", "section", "p", "b", "a"]) if depth < 4 else rnd.choice(["b", "a", "i"]))
            if e.tag in ("p", "b", "a", "i") and x.tag in ("div", "section", "p"):
                x.tag = "b"
            if e.tag == "a" and x.tag == "a":
                x.tag = "i"
            words = " ".join(rnd.choice(["lorem", "ipsum", "dolor"]) for _ in range(rnd.choice([0, 2, 5, 30, 60])))
            x.text, x.tail = words, rnd.choice([" ", "", " tail words "])
            if depth < 5 and rnd.random() < 0.6:
                grow(x, depth + 1)

    for _ in range(150):
        body = ET.Element("body")
        grow(body, 0)
        want = plain_main(body)
        assert main_text("<html>" + ET.tostring(body, encoding="unicode", short_empty_elements=False) + "</html>") == want
        several += want.count("\n") > 2
    assert several > 20


def test_html_pages(spark, sf):
    """The given pages against their articles cut out by expressions alone."""
    import html
    import re

    from tastegrid.llm.common import table
    from tastegrid.llm.html_text import extract_pages

    def plain(page):
        a = re.search(r"<article>(.*?)</article>", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", page or ""), re.S)
        blocks = re.split(r"</?(?:p|div|h\d|ul|ol|li|br|section|article|blockquote|table|tr|td)\b[^>]*>", a[1]) if a else []
        return "\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))

    pages = table(spark, sf, "pages")
    want = {(r.page_id, plain(r.html)) for r in pages.collect()}
    got = {(r.page_id, r.text) for r in extract_pages(pages).collect()}
    assert got == want and len(want) > 20


def test_html_doubtful():
    from tastegrid.llm.html_text import main_text

    page = "<article><p>Some words stand here.</p><div class=related><a href=x>More to read</a></div><div class='legal-note'><p>The court ruled that it is so.</p></div></article>"
    assert main_text(page) == "Some words stand here.\nThe court ruled that it is so."
    long = "<p>Paragraph with words and no end.</p>" * 30_000
    assert main_text(f"<article>{long}</article>").count("\n") == 29_999


def test_html_table(spark):
    from tastegrid.llm.html_text import extract_pages

    df = spark.createDataFrame([(1, "u", "<article><p>x</article>", "t"), (1, "u", "<article><p>x</article>", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert pairs(extract_pages(df), "page_id", "url", "text", "n_chars") == pairs(spark.createDataFrame([(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)], "page_id long, url string, text string, n_chars long"), "page_id", "url", "text", "n_chars")
    assert extract_pages(df.limit(0)).count() == 0


def plain_toxicity(text, model):
    """The largest word's mean of gram weights, gram by gram."""
    import re

    from tastegrid.llm import toxicity as T

    logits, bias, mid = model

    def bucket(gram, n):
        h = sum((b + 7) * pow(T._BASE, i, 2**64) for i, b in enumerate(gram)) % 2**64
        return (h ^ h >> 29) * (0xBF58476D1CE4E5B9 + 2 * n) % 2**64 >> 64 - T.BITS

    z = []
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256)))):
        w = b" " + word + b" "
        grams = [bucket(w, 0)] + [bucket(w[i : i + n], n) for n in T.SIZES for i in range(len(w) - n + 1)]
        z.append(sum(float(logits[g]) for g in grams) / (len(grams) + T.PRIOR) + bias)
    best = max(z, default=bias)
    return 1 / (1 + np.exp(-(best - mid)))


def test_toxicity(spark):
    from tastegrid.llm import toxicity as T

    import pyspark.sql.functions as F

    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdeinorst"), rng.integers(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        w = list(rng.choice(words, rng.integers(20, 200)))
        if bad:
            w[rng.integers(len(w))] = "grubzak" + rng.choice(list("aeiou")) + rng.choice(["x", "lin", "mo"])
        rows.append((i, " ".join(w), "en", "a"))
        labels.append((i, int(bad)))
    docs = odd_docs(spark, [(1000 + i, t, g, s) for i, t, g, s in rows])
    lab = spark.createDataFrame([(1000 + i, y) for i, y in labels] + [(None, 1), (6, None)], "doc_id long, toxic int")
    model = T.fit(docs, lab)
    assert all(np.array_equal(a, b) for a, b in zip(model, T.fit(docs.orderBy(F.rand()), lab), strict=True))  # whatever the order of rows
    got = {r.doc_id: r for r in T.toxicity(docs, model).collect()}
    assert all(abs(got[r.doc_id].score - plain_toxicity(r.text, model)) < 1e-5 for r in docs.collect())
    held = [(got[1000 + i].predicted, y) for i, y in labels if got[1000 + i].held_out]
    assert all(got[1000 + i].held_out == (zlib.crc32(str(1000 + i).encode()) % 5 == 0) for i, _ in labels)
    assert len(held) > 60 and sum(p == y for p, y in held) >= 0.95 * len(held)
    assert 0 <= got[4].score <= 1 and got[3].score == got[4].score and len(got) == len({r.doc_id for r in docs.collect()})
    kept = T.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}
    assert T.fit(docs, lab.limit(0)) is None and T.toxicity(docs, None).filter("score <> 0").count() == 0
    assert T.toxicity(docs.limit(0), T.fit(docs, lab)).count() == 0


def test_byte_bpe(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    from tastegrid.llm.byte_bpe import heap_merge, read_ranks, token_texts

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd_docs(spark, [(30, "Pneumonoultramicroscopicsilicovolcanoconiosis " * 20, "en", "a")])
    want = sorted([(r.doc_id, len(ids := e.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()], key=str)
    for common in (0, 65_536):
        assert pairs(token_texts(docs, path, P.PATTERN, common), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert token_texts(docs.limit(0), path, P.PATTERN).count() == 0
    assert read_ranks(path) == ranks and heap_merge(b"a" * 700, ranks) == e._encode_single_piece(b"a" * 700)


def brute_repeats(texts, keep, length=400):
    first, count = {}, {}
    for i, t in texts:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            count[w] = count.get(w, 0) + 1
            first.setdefault(w, (i, k))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            if count[w] > 1 and (keep == "none" or first[w] != (i, k)):
                gone[k : k + length] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_factors():
    """Longest previous and later factors, and previous smaller values, against all pairs."""
    from tastegrid.llm import suffix_dedup as S

    rng = np.random.default_rng(1)
    for _ in range(100):
        a = rng.permutation(rng.integers(1, 80))
        assert S.previous_smaller(a).tolist() == [max((j for j in range(i) if a[j] < a[i]), default=-1) for i in range(len(a))]
    for trial in range(90):
        size = int(rng.choice([4, 5, 8, 12, 20, 31, 40]))
        n = int(rng.integers(size, 150))
        t = np.tile(rng.integers(97, 99, n).astype(np.uint8)[: 9 if trial % 3 == 1 else n], n)[:n]
        starts = np.flatnonzero(rng.random(n - size + 1) < (1 if trial % 2 else 0.6))
        raw = t.tobytes()

        def lcp(i, j):
            k = 0
            while k < size and max(i, j) + k < n and raw[i + k] == raw[j + k]:
                k += 1
            return k

        earlier, later = S.previous_factors(t, starts, size)
        assert earlier.tolist() == [max((lcp(i, j) for j in starts if j < i), default=0) for i in starts]
        assert later.tolist() == [max((lcp(i, j) for j in starts if j > i), default=0) for i in starts]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_dedup(spark, keep, hot, monkeypatch):
    from tastegrid.llm import suffix_dedup as S

    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefghij klmnopé"), n))
    shared, other = noise(700), noise(450)
    extra = [(40 + i, noise(rng.integers(1, 300)) + (shared if i % 2 else other)[rng.integers(0, 40) :] + noise(rng.integers(1, 300)), "en", "a") for i in range(14)]
    docs = odd_docs(spark, extra)
    if keep == "first":  # identical rows can't be told apart, so none of them is the later one
        docs = docs.dropDuplicates(["doc_id", "text"])
    monkeypatch.setattr(S.repeated_spans, "__defaults__", ("none", hot))
    rows = sorted(((r.doc_id, (r.text or "").encode()) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    got = pairs(S.repeat_digests(docs.select("doc_id", "text"), keep), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(rows, keep)
    if keep == "first" and hot == 2:
        cut = S.strip_repeats(docs)
        assert cut.columns == docs.columns and cut.count() == docs.count()
        lost = {(r.doc_id, r.n_bytes - r.n_removed) for r in S.repeat_digests(docs.select("doc_id", "text"), keep).collect()}
        for r in cut.collect():  # a character cut in part goes whole
            assert any(i == r.doc_id and 0 <= n - len((r.text or "").encode()) <= 6 for i, n in lost) and r.n_chars in (None, len(r.text or ""))
        assert S.repeat_digests(docs.limit(0)).count() == 0


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "byte_bpe"]
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() and os.path.isdir(sf)


def test_search_opens_all(spark):
    """A path of 60 nodes is walked to its end, however many hops that takes, if no recall is enough."""
    from tastegrid.llm import nn_descent as N

    x = np.random.default_rng(3).normal(size=(60, 8)).astype(np.float16)
    points = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "node long, half binary")
    s = x.astype(np.float32) @ x.T.astype(np.float32)
    graph = spark.createDataFrame([(i, [(i + 1) % 60], [float(s[i, (i + 1) % 60])]) for i in range(60)], "node long, ids array<long>, scores array<float>")
    got = {r.node: r.ids for r in N.search(points, graph, spark.createDataFrame([(0,), (30,)], "node long"), 8, target=2.0).collect()}
    for q, ids in got.items():
        assert set(ids) == set(range(60)) - {q}
