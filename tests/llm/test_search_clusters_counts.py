"""Ranked search, centroid clustering and token counts against brute force, with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import tokenizers

from teebox.llm import centroids, queries, ranked_search, token_counts

DOCS = "doc_id long, text string, row long, rank int, score long, n long, item string, freq long, id long, pretoken string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _padded(rows):
    return [(i, t, 1, 2, 3, 4, "x", 5, 6, "y") for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 90))) for _ in range(150)]
    texts += [texts[0]] * 30 + [None, "", " \n\t ", "...", "Été ÀB été", "x" * 3000, "a " * 4000, "one<|endoftext|>two  <|endoftext|>", "it's  we'LL\r\n 　x ١٢ 中文 \U0001f600\U0001e4d0"]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(3, "another text under a used id"), (3, texts[3]), (None, texts[5]), (None, texts[5]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(_padded(rows), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- ranked search


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(rows, items, top):
    bags = [(i, Counter(terms(t))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in set(items):
        found = []
        for doc_id, bag in bags:
            m = 100 - 25 + 25 * sum(bag.values()) * n // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, r in Counter(terms(text)).items() if t in bag)
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return Counter(out)


@pytest.fixture(scope="module")
def items(rows):
    texts = [t for _, t in rows if t]
    asked = [(i, texts[7 * i][:200]) for i in range(12)]
    return asked + [(0, texts[0][:200]), (1, "other Words under ITEM one, " + texts[9]), (50, None), (51, ""), (52, "absentterm"), (53, "été ÉTÉ ab"), (None, texts[4]), (54, "a a a b")]


@pytest.mark.parametrize("top", [1, 3, 20, 500])
def test_ranked_search(spark, docs, rows, items, top):
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search.search(docs, frame, top=top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(rows, items, top)


def test_ranked_search_in_small_blocks(spark, docs, rows, items, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEMS", 4)
    monkeypatch.setattr(ranked_search, "DOCS", 9)
    monkeypatch.setattr(ranked_search, "PIECE", 50)
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, ranked_search.search(docs, frame, top=5).collect())) == brute_search(rows, items, 5)


def test_ranked_search_empty(spark, docs, empty, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.search(docs, none).count() == 0
    assert ranked_search.search(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_accumulators_are_limited():
    """Documents that only the last, common term holds get no accumulator once k others lead beyond reach."""
    n, docs = 1000, np.arange(1000, dtype="<i4")
    row = {
        "ids": list(range(n)), "lengths": np.full(n, 10, "<i8").tobytes(), "terms": np.array([0, 1], "<i4").tobytes(), "ends": np.array([5, 5 + n], "<i8").tobytes(),
        "docs": np.concatenate([docs[:5], docs]).tobytes(), "tf": np.ones(5 + n, "<i8").tobytes(),
    }
    block = ranked_search.Block(row, n, 10 * n)
    found, scores = block.search([(0, 9000), (1, 3)], 5, 0)
    assert found.tolist() == [0, 1, 2, 3, 4]
    part = 10**9 // (1000 + 12 * 100)
    assert scores.tolist() == [9003 * part] * 5
    assert len(block.search([(0, 9000), (1, 3)], 6, 0)[0]) == n  # ties of the sixth place are all candidates


# --- centroid clustering

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, v string, id long, hash string"


def vectors(n=400, dim=64):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, dim))
    data = [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(size=dim) * (0.2 if i % 2 else 1.5))]) for i in range(n)]
    data += [(i + n, data[i][1]) for i in range(0, 60)]  # equal vectors
    data += [(5, data[9][1]), (None, data[11][1]), (None, data[12][1]), (7, data[7][1])]
    bad = [(900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [1.0] * (dim + 1)), (904, [None, *[1.0] * (dim - 1)]), (905, [float("nan"), *[1.0] * (dim - 1)]), (906, [float("inf"), *[1.0] * (dim - 1)]), (907, [3e38, *[1.0] * (dim - 1)])]
    return data, bad


def brute_clusters(data, k=8, rounds=10):
    kept = sorted(((i, [math.floor(1024 * x) for x in v]) for i, v in data), key=lambda x: (hashlib.sha256(f"3:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
    v = np.array([x for _, x in kept], dtype=object)
    c = v[:k].copy()
    for step in range(rounds + 1):
        d = np.stack([((v - row) ** 2).sum(1) for row in c], axis=1)
        near = np.array([min(range(len(c)), key=lambda j: (row[j], j)) for row in d])
        if step < rounds:
            for j in range(len(c)):
                if (near == j).any():
                    mine = v[near == j]
                    c[j] = [int(s) // len(mine) for s in mine.sum(0)]
    dist = [int(d[r, j]) for r, j in enumerate(near)]
    inertia = Counter()
    for j, x in zip(near, dist):
        inertia[int(j)] += x
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]
    return Counter((i, int(j), x, inertia[int(j)], sum(dist), digest[j]) for (i, _), j, x in zip(kept, near, dist))


def test_centroid_clustering(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    data, bad = vectors()
    frame = spark.createDataFrame([(i, v, 1, 2, "x", 3, "y") for i, v in data + bad], VECTORS).repartition(4)
    got = centroids.with_digests(*centroids.cluster(frame))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_clusters(data)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    data, bad = vectors()
    frame = spark.createDataFrame([(i, v, 1, 2, "x", 3, "y") for i, v in data[:n] + bad], VECTORS)
    assert Counter(map(tuple, centroids.with_digests(*centroids.cluster(frame)).collect())) == (brute_clusters(data[:n]) if n else Counter())
    assert centroids.with_digests(*centroids.cluster(frame.limit(0))).count() == 0


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(np.float32(x)) for x in rng.integers(-20_000, 20_000, 64)]) for i in range(40)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert Counter(map(tuple, centroids.with_digests(*centroids.cluster(frame)).collect())) == brute_clusters(data)


def test_loosening_bounds_every_point_of_the_sphere():
    rng = np.random.default_rng(8)
    tighter = 0
    for _ in range(300):
        old = rng.normal(size=(2, 5)) * 3
        new = old + rng.normal(size=(2, 5)) * rng.choice([0.05, 0.5, 2])
        radius = rng.uniform(0, 3)
        loose = centroids.loosening(old, new, 0, radius)
        x = rng.normal(size=(2000, 5))
        x = old[0] + x / np.linalg.norm(x, axis=1)[:, None] * radius * rng.uniform(0, 1, 2000)[:, None] ** 0.2
        nearer = np.linalg.norm(x - old[1], axis=1) - np.linalg.norm(x - new[1], axis=1)
        drift = np.linalg.norm(new[1] - old[1])
        assert nearer.max() <= loose + 1e-9 and loose <= drift + 1e-9
        tighter += loose < 0.9 * drift
    assert tighter > 100


def test_bounds_spare_most_vectors():
    rng = np.random.default_rng(3)
    c = rng.integers(-5000, 5000, (8, 64))
    v = c[rng.integers(0, 8, 3000)] + rng.integers(-300, 300, (3000, 64))
    cluster, upper, lower = centroids.assign(v, c)
    new = c + rng.integers(-40, 40, c.shape)
    assert centroids.reassign(v, cluster, upper, lower, c, new) == 0
    assert (cluster == centroids.squared(v, new).argmin(1)).all()


# --- token counts


@pytest.mark.parametrize("most", [0, 20, token_counts.HEAD])
def test_token_counts(docs, rows, most):
    path = queries.vocabulary("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = token_counts.token_counts(docs, path, most=most, limit=100)
    want = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False))
        want[(i, len((t or "").encode()), n, n > 100)] += 1
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == want


def test_token_counts_of_an_empty_table(empty):
    assert token_counts.token_counts(empty, queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_pretokens_equal_the_library(monkeypatch):
    pieces = token_counts.load(queries.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(1)
    some = [" ", "  ", "\n", "\r", "\t", "\x0b", "\x1c", "'s", "'LL", "'re", "a", "Z", "7", "!", "é", "中", "́", " ", "　", "​", "͸", "꟎", "\U0001e4d0", "<|endoftext|>", "<|", "\x00", "\x7f"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(rng.choices(some[:16], k=12)) for _ in range(2000)]
    for limit in (0, token_counts.LIST_CHARS):
        monkeypatch.setattr(token_counts, "LIST_CHARS", limit)
        for t in texts:
            found, special = pieces.frequencies(t)
            names = list(found)
            assert special + sum(n * found[p] for n, p in zip(pieces.count(names), names)) == len(pieces.library.encode(t, add_special_tokens=False)), repr(t)


def test_registered_queries(spark, tmp_path, rows, items):
    """The op queries read the tables from a folder and return their contract's columns and rows."""
    d = str(tmp_path)
    data, bad = vectors(60)
    spark.createDataFrame(_padded(rows), DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(data + bad, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    assert Counter(map(tuple, queries.op11_ranked_search(spark, d).collect())) == brute_search(rows, items, 20)
    assert Counter(map(tuple, queries.op12_centroid_clustering(spark, d).collect())) == brute_clusters(data)
    got = {r.doc_id: r.n_tokens for r in queries.op13_token_counts(spark, d).collect()}
    library = tokenizers.Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    assert all(got[i] == len(library.encode(t or "", add_special_tokens=False)) for i, t in rows if i not in (3, None))


def test_stages_keep_clashing_columns(spark):
    """Input columns named like a stage's own pass through unchanged."""
    import corpus_pipeline
    from teebox.llm import exact_dedup

    german = "der die das und ist nicht ein eine mit auf für von dem den des wir sie haben werden kann "
    rows = [(1, german * 3, "de", 5, "kept", 0.5), (2, german * 3, "de", 6, "gone", 0.5), (3, "12 34 ..", None, 7, "gone", 0.5), (4, german * 2, "de", 8, "kept", 0.5), (None, german, "de", 9, "kept", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _drop long, _lang_pred string, _lang_score double")
    left = exact_dedup.distinct_documents(docs)
    assert left.columns == docs.columns and sorted((r._drop, r._lang_pred) for r in left.collect()) == [(5, "kept"), (7, "gone"), (8, "kept"), (9, "kept")]
    named = corpus_pipeline.language_id(spark, docs, "")
    assert named.columns == docs.columns and sorted((r._drop, r._lang_pred, r._lang_score) for r in named.collect()) == [(5, "kept", 0.5), (6, "gone", 0.5), (8, "kept", 0.5), (9, "kept", 0.5)]
