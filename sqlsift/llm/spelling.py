"""Spelling variants: words that one inserted, deleted or replaced letter makes of each other, grouped under the most frequent.

Rare-first prefix filter. A word's bigrams, with their positions, are put in one order for all words: by the number of words that have
the bigram, then by bigram and position. One edit touches at most two bigrams of either word, and those it leaves keep
their order, so the least bigram that both keep is among the first three of each. Only these three are joined, by bigram, length and
position: a replaced letter moves no bigram, a further letter moves those behind it by one. Every pair that meets
is then verified exactly.

Words are counted in each partition before they are shuffled; a bigram's count is broadcast (there are at most as many as pairs
of letters of the alphabet, 8,100).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlsift.llm.common import column, lean, named, stored, table

PREFIX = 3
_WORD = re.compile("[a-zÀ-ÿ]+")
_HELD = 200_000


def _counting(alter: int):
    def run(batches):
        counts: Counter = Counter()

        def taken():
            found = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return found

        for batch in batches:
            for key, text in zip(column(batch, "key").to_pylist(), column(batch, "text").cast(pa.binary())):
                words = _WORD.findall((text.as_py() or b"").lower().decode())  # of bytes: lowers A-Z alone
                if not alter or key is None:
                    counts.update(words)
                else:
                    head = zlib.crc32(f"{key}:".encode())
                    for word, n in Counter(words).items():
                        h = zlib.crc32(word.encode(), head)
                        if not h % alter:
                            word = word[: (k := h % len(word))] + word[k + 1 :]
                        counts[word] += n
                if len(counts) > _HELD:
                    yield taken()
        yield taken()

    return run


def word_counts(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", alter: int = 0) -> DataFrame:
    """word, n of all whole texts: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case.

    `alter`: where it divides the crc32 h of `<key>:<word>`, all occurrences of the word in the row lose the letter at h % length (0: never; rows
    without a key: never). Null and empty texts have no words.
    """
    rows = docs.select(named(docs, key_col).cast("string").alias("key"), named(docs, text_col).alias("text"))
    return rows.mapInArrow(lean(_counting(alter)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb of all pairs of `words` (word, n; each once, of six letters or more) one edit apart; the shorter, then lesser one is a."""
    size = F.length("word")
    grams = words.select("word", "n", size.alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.substring(F.col("word"), k, F.lit(2)))).alias("pos", "gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = grams.join(F.broadcast(often), "gram").groupBy("word", "n", "size").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "pos"))), 1, PREFIX).alias("first"))
    first = stored(ranked.select("word", "n", "size", F.explode("first").alias("g")).select("word", "n", "size", "g.gram", "g.pos"), "spelling-grams")
    reach = F.explode(F.array(*[F.struct(F.lit(longer).alias("longer"), F.lit(moved).alias("moved")) for longer, moved in ((0, 0), (1, 0), (1, 1))]))
    asking = first.select(F.col("word").alias("a"), F.col("n").alias("na"), "size", "gram", "pos", reach.alias("r")).select("a", "na", "gram", (F.col("size") + F.col("r.longer")).alias("size"), (F.col("pos") + F.col("r.moved")).alias("pos"), "r.longer")
    met = asking.join(first.withColumnsRenamed({"word": "b", "n": "nb"}), ["gram", "size", "pos"])
    return met.filter("(longer = 1 or a < b) and levenshtein(a, b, 1) = 1").select("a", "na", "b", "nb").distinct()


def spelling_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of `words` (word, n; each word once, six letters or more, no nulls).

    form: the near word of largest n (ties: the smallest in code-point order), if that is `ratio` times the word's own at least, else
    null; root: the last that forms lead to. `ratio`: 2 or more, so chains are as long as the logarithm of the largest count, and
    following two steps at a time takes its logarithm of rounds. No words give no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = stored(words.select("word", "n"), "spelling-words")
    pairs = stored(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    judged = words.join(near, "word", "left").withColumn("formed", -F.col("best.m") >= ratio * F.col("n"))
    judged = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("formed"), F.col("best.other")).alias("form"), F.when(F.col("formed"), -F.col("best.m")).alias("form_n")), "spelling-forms")
    steps = judged.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = stored(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not steps.filter("moved").limit(1).count():
            break
        steps = steps.drop("moved")
    return judged.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents"), alter=199)
    return spelling_groups(words.filter((F.length("word") >= 6) & (F.col("n") >= 5)))


#: crc32 over a list of bytes; its table from the polynomial. Letters beyond a-z become one byte each for levenshtein, which compares bytes.
OP13_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, list_transform(range(8), lambda x: 0::BIGINT)), lambda a, x: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS b))),
said AS (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents)
  GROUP BY ALL),
hashed AS (
  SELECT doc_id, w, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(hex(encode(doc_id || ':' || w))), 2), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || w)), i + 1, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, tab.t[(xor(a, x) & 255) + 1]))) AS h FROM said, tab),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed)
  GROUP BY word HAVING length(word) >= 6 AND sum(k) >= 5),
plain AS (
  SELECT word, n, length(word) AS size, list_aggregate(list_transform(range(1, length(word) + 1), lambda i: CASE WHEN unicode(substr(word, i::INT, 1)) >= 192 THEN chr((unicode(substr(word, i::INT, 1)) - 159)::INT) ELSE substr(word, i::INT, 1) END), 'string_agg', '') AS p FROM words),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM plain a JOIN plain b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word AND levenshtein(a.p, b.p) = 1),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
way AS (
  SELECT word, word AS root, form FROM judged
  UNION ALL SELECT way.word, j.word, j.form FROM way JOIN judged j ON j.word = way.form)
SELECT j.word, j.form, way.root, j.n, j.n_near, j.form_n FROM judged j JOIN way ON way.word = j.word AND way.form IS NULL
"""
