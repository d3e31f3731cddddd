"""The pipeline's stages on planted near copies, passages and hot sources."""

import numpy as np
import pytest
from test_llm import odd_docs


def near_fixture(rng, n=12, words=240):
    """(doc_id, text): a base and its copy of five changed words (similarity 0.8 to 0.9), and a half copy."""
    rows = []
    for k in range(n):
        w = [f"w{x}" for x in rng.integers(0, 50_000, words)]
        copy = list(w)
        for i in range(10, words, words // 5):
            copy[i] = f"new{i}x{k}"
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(copy)), (3 * k + 2, " ".join(w[: words // 2] + [f"v{x}" for x in rng.integers(0, 50_000, words // 2)]))]
    return rows


def jaccard(a, b):
    a, b = ({" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_dedup_stage(spark):
    pipeline = pytest.importorskip("corpus_pipeline")

    rows = near_fixture(np.random.default_rng(4))
    assert all(0.8 <= jaccard(rows[3 * k][1], rows[3 * k + 1][1]) < 0.9 and jaccard(rows[3 * k][1], rows[3 * k + 2][1]) < 0.8 for k in range(12))
    docs = odd_docs(spark, [(i + 1000, t, "en", "a") for i, t in rows])
    got = pipeline.near_dedup_stage(spark, docs, "")
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == docs.columns and {i for i in ids if i is not None and i >= 1000} == {1000 + i for i, _ in rows if i % 3 != 1}
    assert 2 not in ids and 4 not in ids and 7 not in ids and ids.count(10) == 1 and {1, 3, 6, 13, None} <= set(ids)
    assert pipeline.near_dedup_stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("chunk", [1 << 19, 3000])
def test_near_group(spark, chunk, monkeypatch):
    """A large group around one text, most pairs of it near the threshold: components as of all pairs, chunked or not."""
    from tastegrid.llm import near_copies as N

    monkeypatch.setattr(N, "CHUNK", chunk)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 150)]
    texts = []
    for i in range(90):
        w = list(base)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            w[at] = f"new{i}x{at}"
        texts.append(" ".join(w))
    texts += [" ".join(f"z{x}" for x in rng.integers(0, 900, 60)) for _ in range(40)] + ["short one", "short one", ""]
    parent = list(range(len(texts)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(texts)):
        for j in range(i):
            if (jaccard(texts[i], texts[j]) >= 0.8 if min(len(texts[i].split()), len(texts[j].split())) > 4 else texts[i] == texts[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    docs = odd_docs(spark).limit(0).union(odd_docs(spark, [(100 + i, t, "en", "a") for i, t in enumerate(texts)]).filter("doc_id >= 100"))
    got = {r.doc_id - 100 for r in N.near_copies(docs).collect()}
    assert got == {i for i in range(len(texts)) if root(i) == i} and 40 < len(got) < 130


def test_suffix_stage(spark):
    """Passages of 51 short words go from all documents but the first; 50 words and long unbroken strings as defined."""
    pipeline = pytest.importorskip("corpus_pipeline")

    rng = np.random.default_rng(6)
    words = lambda n: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 16, n))
    shared, short, unbroken = words(51), words(50), "".join(rng.choice(list("abcdefgh"), 450))
    texts = [(f"{a} ", p, f" {b}") for p in (shared, short, unbroken) for a, b in [(words(30), words(30)) for _ in range(3)]]
    docs = odd_docs(spark).limit(0).union(odd_docs(spark, [(100 + i, "".join(t), "en", "a") for i, t in enumerate(texts)]).filter("doc_id >= 100"))
    got = {r.doc_id - 100: r.text for r in pipeline.suffix_dedup_stage(spark, docs, "").collect()}
    assert len(shared) < 400
    for i in range(6):
        assert got[i] == (texts[i][0] + texts[i][2] if i in (1, 2) else "".join(texts[i]))
    assert unbroken in got[6] and unbroken[50:400] not in got[7] and unbroken[50:400] not in got[8]


def test_mixing_stage(spark):
    """A hot source of a third of the tokens keeps all its documents; small ones come up to twice."""
    pipeline = pytest.importorskip("corpus_pipeline")

    rows = [(i, f"hot {i} text", "en", "hot") for i in range(100)] + [(1000 + 100 * k + i, f"small {i} text", "en", f"s{k}") for k in range(10) for i in range(20)]
    docs = odd_docs(spark, [(10_000 + i, *r) for i, *r in rows]).filter("doc_id >= 10000")
    got = [r.doc_id for r in pipeline.mixing_stage(spark, docs, "").collect()]
    assert set(got) == {10_000 + i for i, *_ in rows} and max(got.count(i) for i in set(got)) <= 2 and len(got) > len(rows)


def plain_passages(rows, size=51):
    """Texts without the words of passages of `size` words that stand earlier; rows in order of (doc_id, ...)."""
    import re

    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        at = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", raw)]
        words = [raw[a:b] for a, b in at]
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            if w in seen:
                gone[k : k + size] = True
            seen.add(w)
        left, last = b"", 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            left, last = left + raw[last : at[a][0]], at[b - 1][1]
        out.append((i, None if t is None else (left + raw[last:]).decode()))
    return out


def test_run(spark):
    """The whole pipeline against plain versions of its stages, one after another."""
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken
    from test_llm import plain_toxicity

    pipeline = pytest.importorskip("corpus_pipeline")
    from tastegrid.llm import mixing as M
    from tastegrid.llm import toxicity as T
    from tastegrid.llm.common import scratch_dir

    rng = np.random.default_rng(12)
    words = lambda n: [f"{''.join(rng.choice(list('abcdeimnorstu'), 3))}{x:x}" for x in rng.integers(0, 1 << 12, n)]
    passage = words(60)
    rows, labels = [], []
    for i in range(150):
        w = words(int(rng.integers(5, 160)))
        if i % 5 == 0:
            w[len(w) // 2] = "grubzak" + "aeiou"[i % 3]
        if i % 7 == 1:
            w = w[:20] + passage + w[20:]
        rows.append((i, " ".join(w), "en", "hot" if i % 3 == 0 else f"s{i % 8}"))
        labels.append((i, int(i % 5 == 0)))
    for i in range(1, 40, 4):  # near copies, exact ones, and rows without text or id
        w = rows[i][1].split()
        w[len(w) // 2 :: 90] = ["changed"] * len(w[len(w) // 2 :: 90])
        rows += [(200 + i, " ".join(w), "en", "s1"), (300 + i, rows[i][1], "de", "s2")]
    rows += [(400, None, None, None), (401, "", "en", "s1"), (None, "no id here", "en", "s1"), (402, " \t ", "en", None)]
    path = scratch_dir(spark, "run")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], kind).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, lab = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    got = sorted((tuple(r) for r in pipeline.run(spark, path).collect()), key=str)

    model = T.fit(docs, lab)
    clean = [r for r in rows if plain_toxicity(r[1], model) < 0.5]
    own = [r for r in clean if r[0] is not None]
    parent = list(range(len(own)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    def alike(a, b):
        a, b = (a or "").split(), (b or "").split()
        return jaccard(" ".join(a), " ".join(b)) >= 0.8 if min(len(a), len(b)) > 4 else a == b

    own.sort()
    for i in range(len(own)):
        for j in range(i):
            if alike(own[i][1], own[j][1]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    kept = [r for r in clean if r[0] is None] + [r for i, r in enumerate(own) if root(i) == i]
    assert 10 < len(clean) - len(kept) < 40 and len(clean) < len(rows)
    cut = plain_passages([r[:2] for r in kept])
    assert sum(a[1] != b[1] for a, b in zip(kept, cut, strict=True)) > 8
    left = [(i, t, g, s, None) for (i, t), (_, _, g, s) in zip(cut, kept, strict=True)]
    copies = {(r.doc_id, r.source): r.copies for r in M.mix(spark.createDataFrame(left, kind), budget_share=None, entropy_share=None, max_repeat=2.0).collect()}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _, s, _ in left:
        ids = e.encode_ordinary(t or "")
        want += [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] * copies[i, s]
    assert got == sorted(want, key=str) and len(want) > len(left)


def test_stages_on_odd_tables(spark):
    """Every stage takes empty tables, nulls, repeated rows and clashing columns, and hands on the columns it was given."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tastegrid.llm.common import scratch_dir

    path = scratch_dir(spark, "odd")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == odd_docs(spark).columns
        n = docs.count()
        assert pipeline.STAGES[-1][1](spark, docs, path).count() == n
