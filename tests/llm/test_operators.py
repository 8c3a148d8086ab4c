"""Training-data operators against brute force on small fixtures with awkward rows."""

import collections
import hashlib
import io
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from teebox.llm import bpe, decontaminate, exact_dedup, html_extract, langid, ngram_join, ngram_lm, queries, secret_scan, substring_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blk string, n long, label string"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 120))) for _ in range(30)]
    texts = [*base, *base[:6], base[0].upper(), base[1].replace(" ", "\n", 3), None, "", "one two", "one two", "a " * 200, "été " * 60, "x" * 5000]
    for b in base[8:14]:  # near copies
        w = b.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts.append(" ".join(base[20].split()[:50] + base[21].split()[:50]))
    return [(i, t, ("en", "de", None)[i % 3], "src", None, "x", 7, "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty, rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, *_ in rows}
    text = {i: t or "" for i, t, *_ in rows}
    groups = collections.defaultdict(list)
    for i, c in norm.items():
        groups[c].append(i)
    got = exact_dedup.verdicts(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        g = groups[norm[r.doc_id]]
        assert r.keep_id == min(g, key=lambda i: (-len(text[i]), i)) and r.group_size == len(g) and r.kept == (r.keep_id == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    assert exact_dedup.distinct_documents(docs).count() == len(groups)
    assert exact_dedup.verdicts(empty).count() == 0


def test_exact_dedup_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "ab"), (3, "c"), (3, "c"), (-1, "c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.verdicts(df).collect()), key=str)
    other = spark.createDataFrame([(3, "c"), (3, "other"), (-1, "c")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.distinct_documents(other).collect())) == [(-1, "c"), (3, "other")]
    assert got == sorted([(None, None, 2, True), (None, None, 2, True), (3, -1, 3, False), (3, -1, 3, False), (-1, -1, 3, True)], key=str)


def test_ngram_join(docs, empty, rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        break
    for _ in range(5):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    assert ngram_join.near_duplicates(empty).count() == 0


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 6, (300, 16)).astype(np.int32)
    n = v.sum(axis=1).astype(np.int64)
    got = {(min(i, j), max(i, j)) for a, b in ngram_join.CountTree(v, n).pairs() for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if 175 * np.minimum(v[i], v[j]).sum() >= 75 * (n[i] + n[j]) and 100 * n[i] >= 75 * n[j] and 100 * n[j] >= 75 * n[i]}
    assert got == want


def test_hot_key_is_split_and_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 20, raising=False)
    rng = np.random.default_rng(4)
    label = [1] * 130 + [2] * 45 + list(range(1000, 1030)) + [1, 2, 3]
    key = [7] * 205 + [8] * 3
    n = rng.integers(40, 60, len(label)).tolist()
    v = [np.bincount(rng.integers(0, 12, x), minlength=ngram_join.GROUPS).astype(np.uint8) for x in n]
    rows = spark.createDataFrame([(k, i, 0 if k == 7 else 205, x) for i, (k, x) in enumerate(zip(key, label))], "key long, doc_id long, pivot long, label long")
    points = spark.createDataFrame([(i, x, y.tobytes()) for i, (x, y) in enumerate(zip(n, v))], "doc_id long, n long, vector binary")
    groups = ngram_join._grouped(rows).collect()
    assert max(collections.Counter(r.grp for r in groups).values()) < 4 * 20
    got = {(r.a, r.b) for r in ngram_join._tree_pairs(rows, points, 75).collect()}
    want = {
        (i, j)
        for i in range(len(n))
        for j in range(i + 1, len(n))
        if key[i] == key[j] and label[i] != label[j] and 175 * np.minimum(v[i], v[j]).sum() >= 75 * (n[i] + n[j]) and 100 * n[i] >= 75 * n[j] and 100 * n[j] >= 75 * n[i]
    }
    assert got == want and want
    one = ngram_join.CountTree(np.stack(v[:130]), np.array(n[:130]), np.ones(130, np.int64))
    assert not list(one.pairs())  # one component: nothing is listed


def test_families_about_the_threshold_and_long_texts(spark):
    rng = np.random.default_rng(11)

    def edited(words, edits, tag):
        words = list(words)
        for at in rng.choice(len(words), edits, replace=False):
            words[at] = f"{tag}x{at}"
        return words

    base = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    long = [f"l{i}" for i in rng.integers(0, 10**6, 20_000)]
    texts = [edited(base, int(e), f"e{k}") for k, e in enumerate(rng.integers(5, 9, 60))]
    texts += [long, edited(long, 500, "near"), edited(long, 800, "far"), edited(long, 10, "copy"), texts[3], base[:2]]
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))
    under = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i] | sets[j])
            under += 70 * union <= 100 * both < 75 * union
            if 100 * both >= 75 * union:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert under > 30 and len(set(root)) > 5
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()} == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_keys_of_the_same_holders_count_as_one(spark):
    held = {1: [5, 6, 7], 2: [5, 6, 7], 3: [5, 6], 4: [6, 7], 8: [5, 6], 9: [5], 10: [5, 6, 6]}
    keys = spark.createDataFrame([(k, d) for k, docs in held.items() for d in docs], "key long, doc_id long")
    got = collections.defaultdict(list)
    for r in ngram_join._shared_keys(keys).collect():
        got[r.key, r.pivot, r.weight].append(r.doc_id)
    assert {k: sorted(v) for k, v in got.items()} == {(1, 5, 2): [5, 6, 7], (3, 5, 2): [5, 6], (4, 6, 1): [6, 7], (10, 5, 1): [5, 6, 6]}


def test_substring_dedup(docs, empty, rows):
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(docs).collect()}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    assert substring_dedup.repeated_spans(empty).count() == 0


def test_suffix_automaton_statistics(spark):
    rng = random.Random(1)
    ref = [[rng.choice("ab") for _ in range(30)] for _ in range(3)]
    text = [rng.choice("abc") for _ in range(60)]
    parts = {tuple(r[i:j]) for r in ref for i in range(31) for j in range(i, 31)}
    want = [max(k for k in range(i + 2) if tuple(text[i + 1 - k : i + 1]) in parts) for i in range(60)]
    assert substring_dedup.SuffixAutomaton(ref).statistics(text) == want
    d = spark.createDataFrame([(1, "p q a b c d z"), (2, None)], "doc_id long, text string")
    r = spark.createDataFrame([("x a b c d",), ("y",)], "text string")
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substring_dedup.remove_reference(d, r, length=3, shard_words=3).collect()}
    assert got == {1: (7, 4, "p q z"), 2: (0, 0, "")}


def test_lm_base_score_and_model(docs, empty, rows):
    toks = {i: [*WORD.findall(low(t or "")), None] for i, t, *_ in rows}
    train = {i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2}
    c = collections.Counter(w for i in train for w in toks[i])
    n, v = sum(c.values()), len(c)
    for r in ngram_lm.score(docs).collect():
        t = toks[r.doc_id]
        assert r.held_out == (r.doc_id not in train) and r.n_tokens == len(t) and r.train_tokens == n and r.n_known == sum(c[w] > 0 for w in t)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score <= 0
    assert ngram_lm.score(empty).count() == 0


def test_lm_score_keeps_rare_bigrams(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_lm, "FILTER_BITS", 1 << 12, raising=False)  # no fixed size may prune the model
    monkeypatch.setattr(ngram_lm, "BUCKET_BYTES", 1 << 10, raising=False)
    toks = {i: [*WORD.findall(low(t or "")), None] for i, t, *_ in rows}
    train = {i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2}
    c = collections.Counter(w for i in train for w in toks[i])
    pairs = collections.Counter(p for i in train for p in zip([None, *toks[i]], toks[i]))
    n, v, off = sum(c.values()), len(c), 0
    for r in ngram_lm.score(docs).collect():
        want = 0.0
        for a, b in zip([None, *toks[r.doc_id]], toks[r.doc_id]):
            seen = 1 << pairs[a, b].bit_length() - 1 if pairs[a, b] else 0
            want += math.log10((seen + ngram_lm.MU * (c[b] + 1) / (n + v + 1)) / (c[a] + ngram_lm.MU))
        off += not math.isclose(r.score, want, rel_tol=1e-9)
        assert r.score >= want - 1e-9 * abs(want)  # errors of the filter are one-sided
    assert off <= 0.1 * len(rows)


def test_log_frequency_filter():
    h = np.random.default_rng(3).integers(0, 1 << 63, 2000, dtype=np.uint64)
    counts = np.arange(1, 2001)
    order = np.argsort(h)
    f = ngram_lm.Filter(ngram_lm.segment(h[order] & ngram_lm._LOW40, counts[order], 1 << 20)[None, :])
    assert (f.counts(h) >= 2 ** np.floor(np.log2(counts))).all()  # errors are one-sided
    assert (f.counts(h + np.uint64(1)) > 0).mean() < 0.05


def test_language_id(docs, empty, rows):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.annotate(docs, model).collect()}
    assert set(model.langs) == {"en", "de"} and len(got) == len(rows)
    for i, t, *_ in rows[:8]:
        bits = langid.bits_by_walking(model, t)
        assert got[i].lang_pred == model.langs[int(np.argmin(bits))] and 0 <= got[i].score <= 1
    for i, t, *_ in rows:
        assert (got[i].lang_pred == "und") == (not t)
    assert langid.annotate(empty, langid.fit(empty)).count() == 0


def test_bpe_equals_the_library(docs, empty, rows):
    path = queries.vocabulary()
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    extra = "Don't <|endoftext|>ΣΑΣ 123 été\u0085!!###  " + "the" * 500
    b = bpe.Bpe(path)
    odd = "Ab\u0378 1\u0378\U0001F600 \u1C90x \U0001E900Y \u10A0"  # classes that differ by Unicode version
    for t in [extra, odd, *(t or "" for _, t, *_ in rows)]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(b.encode(t), "<u4").tolist() == ids and b.decode(b.encode(t)) == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs, path).count() == len(rows) and bpe.encode_decode(empty, path).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://a/{i}\né", ("<p>x</p>" if i % 4 == 0 else f"<p>{i}</p>" * i), "q") for i in range(40)] + [(40, None, None, "q"), (41, "u", "", "q"), (None, "u", "n", "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha string").repartition(2)
    manifest = warc.write_archives(df, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(manifest, str(tmp_path / "w"), payloads=True).collect()}
    assert len(got) == len(pages)
    heads = {}
    for i, _, h, _ in pages:
        if i is not None:
            heads[h or ""] = max(heads.get(h or "", -1), i)
    for i, _, h, _ in pages:
        r, data = got[i], (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.digest(data))
        if i is not None:
            assert (r.record_type, r.refers_to) == (("response", None) if heads[h or ""] == i else ("revisit", heads[h or ""]))
        assert bytes(r.payload) == (data if r.record_type == "response" else b"")


def test_warc_rejects_damage():
    good = warc.record(1, "http://a", b"body", None)
    assert warc.parse(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodz"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: 4", b"Content-Length: 5")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(b"not an archive")))


def test_html_template_and_markup(spark):
    def page(i):
        return f"<body><div><a href='/{i}'>Home</a> Welcome</div><nav>menu</nav><header>top</header><div id=main><h1>T{i}</h1><p>a &amp; <b>b{i}</b><br>c\n d<p>next{i}</div><div class='comments'>no</div><footer>f"

    rows = [(i, "http://h/x", page(i), "z") for i in range(10)] + [(20, "http://solo/", page(20), "z"), (21, None, None, "z"), (22, "bad", "plain &lt; text", "z"), (23, "http://h/", "<article><p>in</article>out", "z")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    for i in range(10):
        assert got[i] == f"T{i}\na & b{i} c d\nnext{i}"  # the recurring block is gone
    assert got[20].startswith("Home Welcome\nT20")  # a host of one page has no template
    assert (got[21], got[22], got[23]) == ("", "plain < text", "in")


def test_boxes_that_only_counting_finds(spark):
    schema = "page_id long, url string, html string"
    word = lambda i: "".join(chr(97 + (i * k) % 26) for k in (3, 5, 7, 11))
    story = lambda i: f"<h1>{word(i)} {i}</h1><p>tale {i} of {word(i)}</p><table><tr><td>0</td><td>{i}</td></tr></table><ul><li>yes</li><li>item {i} of {i}</li></ul>"
    box = "<div class=x7><p>Our <b>shop</b> sells maps</p><ul><li>one</li></ul></div>"
    inside = lambda i, extra: f"<body><article>{story(i)}{extra}<p>end {i}</p></article></body>"
    beside = lambda i, extra: f"<body>{extra}<div>{story(i)}</div></body>"
    clean = lambda i: f"{word(i)} {i}\ntale {i} of {word(i)}\n0\n{i}\nyes\nitem {i} of {i}"
    boxed = "Our shop sells maps\none"
    rows, want = [], {}

    def put(host, i, html, text):
        key = len(rows)
        rows.append((key, f"https://{host}/{i}", html))
        want[key] = text

    for i in range(40):  # half of a host's pages, inside a marked article
        put("half", i, inside(i, box if i % 2 else ""), f"{clean(i)}\nend {i}")
    for i in range(5):  # a small host, no article marked
        put("small", i, beside(i, box), clean(i))
    for i in range(3):  # too few bodies to tell
        put("few", i, beside(i, box), f"{boxed}\n{clean(i)}")
    for _ in range(30):  # one article copied: one body, so nothing recurs
        put("copies", 1, inside(1, box), f"{clean(1)}\n{boxed}\nend 1")
    for i in range(12):  # an opening line that a third of the articles share stays, one that all share goes
        line = "<h2>Same words on top</h2><p>Same words on top again</p>" if i % 3 == 0 else ""
        put("lines", i, inside(i, line + "<p>Read by everyone here</p>"), f"{clean(i)}\n" + ("Same words on top\nSame words on top again\n" if line else "") + f"end {i}")
    for i in range(8):  # named on some pages, unnamed on others
        put("named", i, beside(i, f"<div class={'promo' if i < 6 else 'q1'}>Buy two for one</div>"), clean(i))
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, schema).repartition(5)).collect()}
    assert got == want
    assert html_extract.main_text(spark.createDataFrame([], schema)).collect() == []
    long = "<p>" + "word &amp; " * 200_000
    only = html_extract.main_text(spark.createDataFrame([(1, None, long), (1, None, long)], schema)).collect()
    assert [r.text for r in only] == [("word & " * 200_000).strip()] * 2


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_registered_html_query_equals_plain_counting(spark, folder):
    """Template counts with Python sets, over all pages, equal what the query counts in Spark."""
    pages = queries.table(spark, f"/root/testdata/{folder}", "pages").select("page_id", "url", "html", html_extract.host(F.col("url")).alias("host")).collect()
    parsed = [html_extract.Page(r.html or "") for r in pages]
    seen, bodies = {}, {}
    for r, page in zip(pages, parsed):
        bodies.setdefault(r.host, set()).add(page.body())
        for x in page.subtrees():
            seen.setdefault((r.host, x), set()).add(page.body())
    template = {k for k, v in seen.items() if len(v) >= 4 and len(v) >= len(bodies[k[0]]) / 4}
    frequent = {k for k in template if len(seen[k]) >= 0.6 * len(bodies[k[0]])}
    want = {r.page_id: page.text({x for h, x in template if h == r.host}, {x for h, x in frequent if h == r.host}) for r, page in zip(pages, parsed)}
    got = queries.QUERIES["op5_html_extraction"](spark, f"/root/testdata/{folder}").collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(pages)
    assert all(r.n_chars == len(r.text) for r in got)


def test_decontamination(spark, docs, empty, rows):
    rng = random.Random(9)
    items = [" ".join("".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(n)) for n in (18, 30, 70)]
    changed = items[1].split()
    changed[4:6] = ["other"]
    planted = [(1000, rows[0][1] + " " + items[0] + " " + rows[1][1]), (1001, " ".join(changed)), (1002, items[2].upper().replace(" ", "!! ")), (1003, None)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(both, bench).collect()}
    assert got == {(1000, 0), (1001, 1), (1002, 2)}
    assert decontaminate.contaminated(empty, bench).count() == 0


def test_rows_without_or_with_repeated_ids_are_judged_on_their_texts(spark, rows):
    rng = random.Random(12)
    item = " ".join("".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(30))
    t = [r[1] for r in rows[:8]]
    near = lambda x: x.rsplit(" ", 1)[0] + " changed"
    data = [(None, t[0]), (None, t[1] + " " + item), (None, t[2]), (5, t[3]), (5, item), (6, t[4])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert set(map(tuple, decontaminate.clean_documents(df, bench).collect())) == {(None, t[0]), (None, t[2]), (5, t[3]), (6, t[4])}
    df = spark.createDataFrame([(None, "a b"), (None, "ab"), (None, "a b"), (None, None), (None, ""), (3, "c"), (None, "c"), (4, "d"), (4, "d")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.distinct_documents(df).collect()), key=str) == sorted([(None, "a b"), (None, ""), (3, "c"), (4, "d")], key=str)
    data = [(None, t[0]), (None, near(t[0])), (None, t[1]), (3, near(t[1])), (5, t[2]), (5, t[3]), (4, near(t[3])), (9, t[5]), (-8, near(t[5])), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = list(map(tuple, ngram_join.one_per_group(df).collect()))
    assert len([x for x in got if x[1] in (t[0], near(t[0]))]) == 1
    assert {x for x in got if x[1] not in (t[0], near(t[0]))} == {(3, near(t[1])), (5, t[2]), (4, near(t[3])), (-8, near(t[5])), (None, None)}


def test_lcs():
    rng = random.Random(4)
    for _ in range(30):
        a, b = [rng.randint(0, 5) for _ in range(12)], [rng.randint(0, 5) for _ in range(20)]
        t = [[0] * 21 for _ in range(13)]
        for i in range(12):
            for j in range(20):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs_length(a, b) == t[12][20]


def test_secret_scan(spark, empty):
    rng = random.Random(6)
    secret = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [(i, f'some words token = "{s}" and more', "app") for i, s in enumerate(secret)]
    texts += [(100 + i, "the " + "wordandthe" * 3 + " and", None) for i in range(60)] + [(300, None, "x"), (301, "", "x"), (302, 'token = "EXAMPLEexample0000000000"', "x")]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()}
    assert all(got[i].is_secret and got[i].secret == s for i, s in enumerate(secret))
    assert not any(r.is_secret for i, r in got.items() if i >= 100) and 300 not in got
    assert secret_scan.scan(empty).count() == 0


def test_secret_scan_finds_values_after_long_names(spark):
    texts = [(1, "POSTGRES_ADMIN_PASSWORD=S3cr3tPass!"), (2, "A_VERY_LONG_NAME_OF_TOKEN==abcd1234 and more"), (3, 'token = "0123456789abcdef0123456789"')]
    got = {(r.doc_id, r.secret) for r in secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {(1, "S3cr3tPass!"), (2, "=abcd1234"), (3, "0123456789abcdef0123456789")} <= got


def test_decontamination_learns_from_every_document(spark, monkeypatch):
    """The latent basis is fitted on all texts and items, however many there are."""
    from teebox.llm import decontaminate

    fitted = []
    real = decontaminate.latent_basis

    def basis(passages, idf):
        fitted.append(passages.count())
        return real(passages, idf)

    monkeypatch.setattr(decontaminate, "latent_basis", basis)
    phrase = "the quick amber fox jumps across seven lazy rivers before dawn breaks over hills"
    texts = [(i, f"word{i % 97} filler{i % 89} plain text number {i}" + (f" {phrase}" if i == 2999 else "")) for i in range(3000)]
    found = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, phrase)], "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(2999, 1)]
    assert fitted == [3001]


def test_segment_sums_add_runs_of_any_length(monkeypatch):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 9, (50, 4)).astype(np.float32)
    calls = []
    add = np.add

    class Counted:
        @staticmethod
        def reduceat(x, start, axis):
            calls.append(len(x))
            return add.reduceat(x, start, axis=axis)

    for lengths in ([1], [32], [33, 1], [1, 200, 31, 64, 2], [3] * 40):
        start = np.cumsum([0, *lengths[:-1]])
        pick = rng.integers(0, 50, sum(lengths))
        with monkeypatch.context() as m:
            m.setattr(decontaminate.np, "add", Counted)
            got = decontaminate._segment_sums(values, pick, start)
        assert np.array_equal(got, [values[pick[a : a + n]].sum(axis=0) for a, n in zip(start, lengths)])
    # only segments of more than one run are added up row by row, and by their runs
    assert calls == [3, 12]


def test_written_leaves_no_shuffle_files(spark):
    from teebox.llm import scratch

    def files():
        root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in root for _, _, found in os.walk(d) for f in found if f.startswith("shuffle_")}

    before = files()
    rows = spark.range(5000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count()
    assert scratch.written(rows, "test").count() == 7
    left = files() - before
    # the count's own shuffle is not a written one; those of the write are gone
    assert not [f for f in left if f.endswith(".data") and int(f.split("_")[1]) < max(int(g.split("_")[1]) for g in left)]


def test_components_of_stars_take_no_step(spark, monkeypatch):
    from teebox.llm import graph, scratch

    written, tags = scratch.written, []
    monkeypatch.setattr(scratch, "written", lambda df, tag: tags.append(tag) or written(df, tag))
    star = spark.createDataFrame([(5, 1), (1, 7), (9, 3), (5, 1)], "a long, b long")
    assert {tuple(r) for r in graph.components(star).collect()} == {(1, 1), (5, 1), (7, 1), (3, 3), (9, 3)}
    assert tags == ["edges"]
    path = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (40, 31)], "a long, b long")
    assert {tuple(r) for r in graph.components(path).collect()} == {(i, 0) for i in range(21)} | {(i, 30) for i in (30, 31, 40)}


def test_keys_are_shuffled_once(spark):
    keys = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, 7), (3, 7), (4, 8), (4, 9)], "key long, doc_id long")
    held = ngram_join._held_keys(keys)
    assert sorted(map(tuple, held.collect())) == [(1, 5), (1, 6), (4, 8), (4, 9)]
    plan = held._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2 and sum("ReusedExchange" in line for line in dealt) == 1


def test_rarity_stays_small_on_the_driver(spark, docs):
    import tracemalloc

    ngram_join.scratch.ready(docs)
    tracemalloc.start()
    levels = ngram_join.rarity(docs.select("text"), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(levels) == 1 << ngram_join.SKETCH_BITS and peak < 96 << 20


def test_copies_meet_at_the_text_they_were_made_from(spark, monkeypatch):
    """Copies that link with their text but not with each other are no candidates of each other; the text's id is not the smallest."""
    base = [f"w{i}" for i in range(150)]
    copies = [[f"e{k}" if i in (k, k + 7, 2 * k + 20) else w for i, w in enumerate(base)] for k in range(10, 60)]
    texts = copies[:20] + [base] + copies[20:]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    asked, verified = [], ngram_join._verified

    def counted(docs, pairs, words, percent):
        asked.append({(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()})
        return verified(docs, pairs, words, percent)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    assert {r.component_id for r in ngram_join.near_duplicates(df).collect()} == {0}
    assert asked == [{(min(i, 20), max(i, 20)) for i in range(len(texts)) if i != 20}, set()]
