"""Results are the same whichever way an operator takes, and for columns of any name."""

import numpy as np
import pytest

from sqlsift.llm import common, decontaminate, html_extract, langid, line_dedup, ngram_join, sharding

WORDS = [f"w{k}" for k in range(40)]


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    return [None, "", "\n\n", "x" * 20_000] + ["\n".join(" ".join(rng.choice(WORDS, rng.integers(0, 30))) if rng.random() < 0.6 else f" Line {rng.integers(0, 6)} " for _ in range(rng.integers(1, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 9 else None, t, ["en", "de", "fr", None][k % 4], k) for k, t in enumerate(texts(60))]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, `a.b c``d` int").repartition(3)


def key(df):
    return sorted(map(repr, df.collect()))


def test_line_index_asked_or_broadcast(docs):
    one, other = (line_dedup.line_dedup(docs, min_docs=4, limit=n) for n in (1 << 20, 0))
    assert one.columns == other.columns == ["doc_id", "text", "lang", "a.b c`d", "n_lines", "n_dropped", "kept_text"]
    assert key(one) == key(other) and one.filter("n_dropped > 0").count() > 20
    assert line_dedup.line_dedup(docs.limit(0), limit=0).count() == 0 and line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_counts_over_a_byte(spark):
    docs = spark.createDataFrame([(k, f"same\n{k}" if k < 300 else "other\nrare" if k < 499 else "rare") for k in range(500)], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(docs, min_docs=200).collect()}
    assert got == {k: 1 for k in range(300)} | {k: 1 for k in range(300, 500)} and line_dedup.line_dedup(docs, min_docs=301).filter("n_dropped > 0").count() == 0


def test_fingerprints_are_compact():
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 63, 20_000).astype(np.uint64))
    index = line_dedup.PerfectHash(keys, np.ones(len(keys), np.uint8))
    assert index.nbytes() < 5 * len(keys) and (index.known(keys) == 1).all()
    with pytest.raises(ValueError):
        index.known(keys + np.uint64(1))


def test_benchmark_in_blocks(spark, docs):
    rows = [(str(k), " ".join(WORDS[k : k + n])) for k, n in ((0, 12), (3, 2), (5, 1), (9, 25))] + [("9", "line 3"), (None, "w1"), ("n", None), ("e", "")]
    bench = spark.createDataFrame(rows, "item_id string, text string")
    one, other = decontaminate.decontaminate(docs, bench), decontaminate.decontaminate(docs, bench, block_bytes=70)
    assert key(one) == key(other) and one.filter("contaminated").count() > 10 and other.columns[:4] == docs.columns


def test_languages_in_groups(docs):
    whole, parts = langid.train(docs, bins=1 << 10), langid.train(docs, bins=1 << 10, max_cells=1 << 10)
    assert (len(whole), len(parts)) == (1, 3)
    one, other = (langid.predict(docs, m, per_gram=True) for m in (whole, parts))
    assert one.columns == other.columns
    for a, b in zip(*(sorted(df.collect(), key=lambda r: (str(r[1]), str(r[0]), r[3])) for df in (one, other))):
        assert a[:5] == b[:5] and a.score == pytest.approx(b.score) and a.per_gram == pytest.approx(b.per_gram)


def test_columns_of_any_name(spark, docs):
    assert sharding.shard(docs).columns[:3] == ["doc_id", "lang", "a.b c`d"]
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", 1)], "page_id long, url string, html string, `a.b``c` int")
    assert html_extract.extract_pages(pages).first()["text"] == "x"
    assert ngram_join.near_components(docs).count() == docs.count()


@pytest.mark.parametrize("shards", [3, 40])
def test_sharding_against_brute_force(spark, shards):
    rows = [(k, t) for k, t in enumerate(texts(300, 5) + ["copy " * 6] * 40 + ["hot " * 50] * 200 + ["a", "a", "b", "b"])]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=shards).toPandas()
    size = {k: len((t or "").encode()) + 16 for k, t in rows}
    assert dict(zip(got.doc_id, got["size"])) == size and {int(x) for x in got.shard} <= set(range(shards)) and len(got) == len(rows)
    sums = got.groupby("shard")["size"].sum()
    small = sum(size.values()) / shards
    assert sums.max() <= small * (1 + 1 / 8) + 2 * max(size.values())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for t in {t or "" for _, t in rows}:
        same = [k for k, x in rows if (x or "") == t]
        if sum(size[k] for k in same) * 8 <= small:
            assert got[got.doc_id.isin(same)].shard.nunique() == 1


def test_sets_with_very_many_empty_segments():
    # more empty segments than two bytes count: the set must still be known as deficient
    schemes = ngram_join.Schemes(80)
    sets = [np.arange(n, dtype=np.uint64) for n in (8_000_000,)]
    info, _, _ = ngram_join._signatures(sets, schemes)
    assert info["empty"].max() > 0xFFFF


def test_shared_folder(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
