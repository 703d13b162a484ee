"""Training-data operators against brute force, and their edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import SF, oracle, rows
from pyspark.sql import functions as F

from sqlsift.llm import chat, components, decontaminate, html_extract, langid, line_dedup, lm_score, ngram_join, packing, sharding, topk
from sqlsift.llm.queries import ORACLES, QUERIES

EDGE = [(1, None), (2, ""), (3, "one two"), (4, "A b\n\n b A\n" * 3), (5, "long " * 30_000), (6, "x"), (6, "x"), (None, "y z"), (7, "é " + "wörd " * 20), (8, "1234 !!"), (9, "one two"), (10, "\x1c \x85 ﬀ don't I'LL <|endoftext|> a;b ;; ?!")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en" if t else None, "s") for i, t in EDGE], "doc_id long, text string, lang string, Size string")


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert rows(QUERIES[name](spark, SF).toArrow()) == rows(oracle(ORACLES[name]))


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    index = line_dedup.PerfectHash(keys, np.arange(1, len(keys) + 1, dtype=np.uint32))
    assert (index.lookup(keys) == np.arange(1, len(keys) + 1)).all() and not index.lookup(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)].any()
    assert len(index.counts) == len(keys) and not line_dedup.PerfectHash(keys[:0], np.zeros(0, np.uint32)).lookup(keys).any()


def test_line_dedup_edges(edge, none):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(edge, min_docs=2, limit=1).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()}
    assert {(1, 1, 0, ""), (2, 1, 0, ""), (3, 1, 1, ""), (6, 1, 1, ""), (4, 10, 0, EDGE[3][1]), (None, 1, 0, "y z")} <= got
    assert line_dedup.line_dedup(none).count() == 0


def test_decontaminate_edges(spark, edge, none):
    bench = spark.createDataFrame([("i1", "ONE, two!"), ("i2", None), (None, "x"), ("i3", ""), ("i4", "wörd " * 12), ("i1", "one two")], "item_id string, text string")
    for block in (1 << 20, 4):  # one block, and many
        got = {r.doc_id: r for r in decontaminate.decontaminate(edge, bench, block_bytes=block).collect()}
        assert (got[3].n_hit, got[3].n_items, got[3].items_sha256) == (2, 1, hashlib.sha256(b"i1").hexdigest())
        assert (got[7].n_words, got[7].n_hit, got[7].contaminated) == (21, 20, True)
        assert (got[1].n_words, got[2].n_hit, got[6].contaminated, got[5].n_words) == (0, 0, False, 30_000)
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(edge, bench.limit(0)).filter("contaminated").count() == 0


def test_language_id(spark, edge, none):
    got = QUERIES["op2_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()
    out = {r.doc_id: r for r in langid.predict(edge, langid.train(edge)).collect()}
    assert [out[i].lang_pred for i in (1, 2, 8, 3)] == ["und", "und", "und", "en"] and out[1].score == 0
    assert {r.lang_pred for r in langid.predict(edge, langid.train(none)).collect()} == {"und"} and langid.predict(none, langid.train(edge)).count() == 0


def brute_ctw(train, text, depth):
    """Context-tree weighting by its recursion over dictionaries."""
    n = defaultdict(lambda: [0, 0])
    pad = b"\xff" * depth

    def decisions(t):
        t = pad + t + b"\xff"
        for i in range(depth, len(t)):
            for k in range(8):
                yield t[i - depth : i][::-1], (1 << k) | (t[i] >> (8 - k)), (t[i] >> (7 - k)) & 1

    for t in train:
        for c, v, bit in decisions(t):
            for d in range(depth + 1):
                n[c[:d], v][bit] += 1
    kids = defaultdict(set)
    for c, v in list(n):
        if c:
            kids[c[:-1], v].add((c, v))

    def pe(x):
        a, b = n[x]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    memo = {}

    def pw(x):
        if x not in memo:
            memo[x] = pe(x) if len(x[0]) == depth else np.logaddexp(pe(x), sum(map(pw, kids[x]))) - math.log(2)
        return memo[x]

    total = 0.0
    for c, v, bit in decisions(text):
        p = None
        for d in range(depth, -1, -1):
            x = (c[:d], v)
            if x in n and sum(n[x]):
                own = (n[x][bit] + 0.5) / (sum(n[x]) + 1)
                w = 1 if p is None else 1 / (1 + math.exp(-(pe(x) - sum(map(pw, kids[x])))))
                p = own if p is None else w * own + (1 - w) * p
        total += math.log10(0.5 if p is None else p)
    return total


def test_lm_score_brute_force(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate(["abracadabra abra", "abra cad", None, "", "zzz über", "abracadabra abra", "The the THE"] * 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts}
    train = [(t or "").encode() for i, t in texts if not held[i]]
    words = Counter(w for t in train for w in [*t.lower().split(), "end"])
    total = sum(words.values())
    monkeypatch.setattr(lm_score, "_TOGETHER", 2)  # several levels of merging
    for r in lm_score.lm_scores(docs, ~langid.held_out(10), depth=3, block_bytes=100).collect():
        t = (dict(texts)[r.doc_id] or "").encode()
        ws = [*t.lower().split(), "end"]
        assert r.score == pytest.approx(brute_ctw(train, t, 3), rel=1e-5)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (total + 0.1 * (len(words) + 1))) for w in ws))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in words for w in ws), total, held[r.doc_id])


def test_lm_score_edges(edge, none):
    assert lm_score.lm_scores(edge, ~langid.held_out(10)).count() == len(EDGE)
    assert lm_score.lm_scores(none, ~langid.held_out(10)).count() == 0
    r = lm_score.lm_scores(edge.filter("doc_id = 6"), F.lit(False)).first()
    assert r.score == pytest.approx(16 * math.log10(0.5)) and r.base_score == 0


def test_html(spark):
    e = html_extract.extract
    assert e(None) == "" and e("") == "" and e("plain &amp; text") == "plain & text"
    page = "<html><body><header><h1>Site</h1></header><div id='cookie-notice'>We</div><div class=content><h2>T</h2><p>One  two<br>x<p>y</div><ul><li><a href=x>menu</a></ul><div class='comments'><p>no</div><form>q</form>"
    assert e(page) == "T\nOne two x\ny"
    host = [f"<body><div class=t>Fixed words</div><div>own text {k}</div></body>" for k in range(5)]
    pages = spark.createDataFrame([(k, f"http://h.example/{k}", p) for k, p in enumerate(host)] + [(8, None, None), (9, "http://h.example/9", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert got == {**{k: f"own text {k}" for k in range(5)}, 8: "", 9: ""} and html_extract.extract_pages(pages.limit(0)).count() == 0


def test_html_copies_are_no_template(spark):
    article = "".join(f"<p>sentence {i} of the long article</p>" for i in range(12))
    page = "<body><nav>menu {0}</nav><div class=t>Fixed words</div><article>{1}</article></body>".format
    copies = [page(k, article) for k in range(6)]
    alone = spark.createDataFrame([(k, "http://c.example/", p) for k, p in enumerate(copies)], "page_id long, url string, html string")
    assert {len(r.text.split("\n")) for r in html_extract.extract_pages(alone).collect()} == {12}
    mixed = copies + [page(k, f"<p>short text {k}</p>") for k in range(6, 20)]
    got = html_extract.extract_pages(spark.createDataFrame([(k, "http://m.example/", p) for k, p in enumerate(mixed)], alone.schema))
    assert [len(r.text.split("\n")) for r in got.orderBy("page_id").collect()] == [12] * 6 + [1] * 14


def test_html_constant_on_all_pages_only(spark):
    # the same words on many pages of a host, other words on a few: no template; the fixed words are
    body = "<body><div class=t>Fixed words</div><div class=s>{1}</div><div>own text {0}</div></body>".format
    pages = [(k, "http://h.example/", body(k, "Rare words" if k % 50 == 7 else "Usual words")) for k in range(200)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == {k: f"{'Rare' if k % 50 == 7 else 'Usual'} words\nown text {k}" for k in range(200)}


def test_html_middle_of_long_pages():
    def page(k, n):
        words = [f"<p>text {k} {i}</p>" for i in range(n)]
        return f"<body>{''.join(words[: n // 2])}<div class=box>Fixed words</div><p>Same line</p>{''.join(words[n // 2 :])}</body>"

    for sizes in ([20, 24, 30, 22], [700, 640, 811, 905], [20, 700, 24, 905]):
        pages = [page(k, n) for k, n in enumerate(sizes)]
        wrapper = html_extract.induce(pages)
        for p, n in zip(pages, sizes):
            got = html_extract.extract(p, wrapper).split("\n")
            assert "Fixed words" not in got and len(got) in (n, n + 1)


def test_common_subsequence():
    rng = np.random.default_rng(3)
    for n, m, k in ((0, 5, 2), (1, 1, 1), (40, 70, 3), (90, 50, 12), (200, 200, 40)):
        xs, ys = rng.integers(0, k, n).tolist(), rng.integers(0, k, m).tolist()
        size = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                size[i + 1][j + 1] = size[i][j] + 1 if xs[i] == ys[j] else max(size[i][j + 1], size[i + 1][j])
        got = html_extract._common(xs, ys)
        assert len(got) == size[n][m] and all(xs[i] == ys[j] for i, j in got) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


def test_top_k_edges(spark):
    vs = [(k, [float(x) for x in np.random.default_rng(k).normal(size=6) * 0.2]) for k in range(200)] + [(300 + k, [0.5] * 6) for k in range(100)] + [(900, None), (901, [float("nan")] * 6), (902, [None] * 6), (None, [0.1] * 6), (903, [0.4, 0.4])]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.exact_top_k(df, F.col("vec_id") % 3 == 0, block_rows=20, most_pivots=4, query_rows=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    pad = lambda v: np.array([math.floor(256 * x) for x in v] + [0] * (6 - len(v)))
    ok = {k: pad(v) for k, v in vs if k is not None and v and None not in v and all(map(math.isfinite, v))}
    want = {q: [(c, s) for s, c in sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:5]] for q in ok if q % 3 == 0}
    assert {q: [(c, -s) for c, s in x] for q, x in want.items()} == dict(got)
    assert topk.exact_top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_stops_early_on_clusters(spark):
    random = np.random.default_rng(3)
    centres = random.normal(size=(40, 16))
    x = np.floor(256 * (centres[random.integers(0, 40, 4000)] + random.normal(size=(4000, 16)) * 0.02)) / 256
    searched = []
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0, block_rows=32, query_rows=16, progress=lambda *pairs: searched.append(pairs)).toPandas()
    scores = np.rint(x * 256) @ np.rint(x * 256).T
    np.fill_diagonal(scores, -np.inf)
    for q, rows in got.groupby("query_id"):
        best = np.lexsort((np.arange(4000), -scores[q]))[:5]
        rows = rows.sort_values("rank")
        assert list(rows.vec_id) == list(best) and list(rows.score) == list(scores[q][best])
    assert len(got) == 400 and sum(n for n, _ in searched) < 0.3 * searched[0][1]


def test_chat_edges(spark):
    t = spark.createDataFrame([(1, 0, "a", "hi"), (1, 1, "b", None), (1, 1, "b", None), (1, None, None, "x"), (2, 0, "system", "s"), (None, 0, "a", "n")], "conv_id long, turn long, role string, text string")
    got = chat.rotate(t).collect()
    assert Counter((r.conv_id, r.perspective) for r in got) == {(1, "a"): 4, (1, "b"): 4, (None, "a"): 1}
    mine = sorted((r for r in got if (r.conv_id, r.perspective) == (1, "b")), key=lambda r: r.seq)
    whole = "".join(r.message for r in mine)
    assert [whole[r.mask_start : r.mask_end] for r in mine] == ["", "", "", ""] and [r.seq for r in mine] == [1, 2, 3, 4] and mine[0].name == "unknown"
    assert chat.rotate(t.limit(0)).count() == 0


def test_packing(edge, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    got, rest = defaultdict(list), []
    for i, t in EDGE:
        if i != 6:
            want[i] = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    for r in packing.pack(edge).collect():
        rest.append(r)
        if r.doc_id != 6:
            got[r.doc_id].append(r)
    assert set(got) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for s in {r.sequence_id for r in rest}:
        at = 0
        for r in sorted((r for r in rest if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_packing_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(50):
        gaps = rng.integers(1, 9, 9)
        cuts, penalty = [0, *np.cumsum(gaps).tolist()], [0, *rng.integers(0, 6, 9).tolist()]
        penalty[-1] = 0

        def cost(chosen):
            sizes = [cuts[b] - cuts[a] for a, b in zip(chosen, chosen[1:])]
            if max(sizes) > 12:
                return math.inf
            return sum(12 - s for s in sizes[:-1]) + (0 if sizes[-1] & (sizes[-1] - 1) == 0 else 12 - sizes[-1]) + sum(penalty[k] for k in chosen[1:-1])

        best = min(cost([0, *[k for k in range(1, 9) if m >> k & 1], 9]) for m in range(0, 512, 2))
        assert cost(packing.choose(cuts, penalty, 12)) == best


def test_sharding(spark, edge, none):
    got = QUERIES["op9_sharding"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs) and all(r.size == len(docs.text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs.text[r.doc_id].encode()) for r in got.itertuples())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    same = sharding.shard(spark.range(2000).select(F.lit(1).alias("doc_id"), F.lit("copy").alias("text"))).groupBy("shard").count().toPandas()
    assert len(same) == 40 and same["count"].between(49, 51).all()
    assert sharding.shard(edge).count() == len(EDGE) and sharding.shard(none).count() == 0


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_many_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    shared = " ".join(f"s{k}" for k in range(60))
    docs = []
    for k in range(90):  # one large group of near copies, enough for large buckets
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            w[at] = f"n{rng.integers(0, 9)}"
        docs.append((k, " ".join(w)))
    docs += [(100 + k, shared + " " + " ".join(f"o{x}" for x in rng.integers(0, 9999, rng.integers(5, 70)))) for k in range(60)]
    docs += [(200 + k, " ".join(f"t{x}" for x in range(int(rng.integers(1, 14))))) for k in range(60)]
    docs += [(300, None), (301, ""), (302, docs[0][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def test_ngram_join_edges(edge, none):
    got = {r.doc_id: r for r in ngram_join.near_components(edge).collect()}
    assert got[9].component_id == 3 and got[1].component_id == 1 and got[1].n_shingles == 0 and got[None].component_id is None and got[5].n_shingles == 1
    assert ngram_join.near_components(none).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, 50), (50, 70), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, 50: 50, 70: 50, 100: 50}


def test_pipeline(spark):
    from corpus_pipeline import STAGES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from sqlsift.llm.common import stored

    counts = [docs.count()]
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, SF), name)
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] < counts[3] and counts[5] >= counts[4]


def test_pipeline_drops_foreign_and_random_texts(spark):
    from corpus_pipeline import language_id

    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789")
    planted = ["Это обычное русское предложение о погоде в большом городе сегодня утром.", "これは日本語の普通の文章です。今日は天気がとても良いです。", "".join(np.random.default_rng(0).choice(letters, 200))]
    kept = ["This is a normal English sentence about the weather in the big city today.", "the"]
    extra = spark.createDataFrame([(-1 - k, t, None, "s", len(t)) for k, t in enumerate(planted + kept)], docs.schema)
    got = {r.doc_id for r in language_id(spark, docs.unionByName(extra), "").select("doc_id").collect()}
    assert {k for k in got if k < 0} == {-4, -5} and len(got) == docs.count() + 2


def test_lean_keeps_results_and_ends_what_others_keep():
    from sqlsift.llm.common import KEPT, lean

    KEPT.update(a={1: 1}, b={2: 2})
    assert list(lean(lambda batches: iter(()), "a")([])) == []
    assert list(KEPT) == ["a"]

    def doubled(batches):
        for x in batches:
            yield 2 * x

    assert list(lean(doubled)([1, 2])) == [2, 4] and not KEPT
    assert lean(lambda t: t + 1)(1) == 2 and lean(lambda s, t: s + t)(1, 2) == 3


def test_sorted_distinct():
    from sqlsift.llm.common import sorted_distinct

    for keys in ([], [5], [3, 1, 3, 1 << 63, 1]):
        assert sorted_distinct(np.array(keys, np.uint64)).tolist() == sorted(set(keys))
