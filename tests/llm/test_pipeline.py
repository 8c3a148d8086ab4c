"""The pipeline's stages and run() against a plain version, on a table with awkward rows and clashing columns."""

import hashlib
import random
import re

import pytest

pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from teebox.llm import exact_dedup, ngram_join, queries  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _drop string, _twice long, _key long, _row string, _group long, _lang_pred string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def row(i, text):
    return (i, text, "en", "src", None, "mine", 2, 3, "four", 5, "six")


def shingles(text):
    words = WORD.findall(text.lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain(rows, items):
    """Ids that stay: letters, one of equal texts, one of near copies, no benchmark item in it."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    best = {}
    for i, t in rows:
        at = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[at] = min(best.get(at, (0, 0, "")), (-len(t), i, t))
    rows = sorted((i, t) for _, i, t in best.values())
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {rows[r] for r in set(root) if not any(item in rows[r][1] for item in items)}


@pytest.fixture(scope="module")
def case():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [text(30) for _ in range(3)]
    base = [text(rng.randint(60, 140)) for _ in range(24)]
    rows = list(enumerate(base))
    rows += [(100 + k, b) for k, b in enumerate(base[:5])]  # copies
    rows += [(200 + k, b.replace(" ", "  ", 4)) for k, b in enumerate(base[3:7])]  # longer, so these stay
    rows += [(300 + k, b.rsplit(" ", 1)[0] + " changed") for k, b in enumerate(base[8:14])]  # near copies
    rows += [(400 + k, text(40) + " " + item + " " + text(40)) for k, item in enumerate(items)]
    rows += [(7, base[7])] * 3  # equal in everything
    rows += [(500, None), (501, ""), (502, "12 34 - 56"), (503, text(20_000))]
    return rows, items


def test_run_equals_the_plain_version(spark, tmp_path, case):
    rows, items = case
    spark.createDataFrame([row(*r) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    library = tokenizers.Tokenizer.from_file(queries.vocabulary())
    library.no_truncation()
    want = []
    for i, t in plain(rows, items):
        ids = library.encode(t, add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_fold_equal_rows_and_keep_clashing_columns(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [row(1, text)] * 3 + [row(None, "a b")] * 2 + [row(2, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    for stage in (exact_dedup.distinct_documents, ngram_join.one_per_group):
        assert sorted(map(tuple, stage(df).collect()), key=str) == sorted({row(1, text), row(None, "a b"), row(2, "c")}, key=str)
