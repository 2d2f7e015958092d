"""Symbol sequences (source, pos, sym): n-gram counts, prefix trees, labelling, longest-match decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.operators.segments import runs
from segspark.registry import query


def _order():
    return Window.partitionBy("source").orderBy("pos")


def ngrams(symbols: DataFrame, n: int) -> DataFrame:
    """source, pos, gram (symbols joined by blanks) at every position that has n symbols."""
    parts = [F.col("sym").cast("string")] + [F.lead("sym", i).over(_order()).cast("string") for i in range(1, n)]
    rows = symbols.select("source", "pos", *[p.alias(f"g{i}") for i, p in enumerate(parts)])
    whole = F.col(f"g{n - 1}").isNotNull()
    return rows.where(whole).select("source", "pos", F.concat_ws(" ", *[f"g{i}" for i in range(n)]).alias("gram"))


def counts(symbols: DataFrame, order: int) -> DataFrame:
    """gram, n (its length), count of all k-grams with k up to order."""
    out = None
    for n in range(1, order + 1):
        part = ngrams(symbols, n).groupBy("gram").agg(F.lit(n).alias("n"), F.count("*").alias("count"))
        out = part if out is None else out.unionByName(part)
    return out


def longest_match(symbols: DataFrame, words: list[list[int]]) -> DataFrame:
    """source, pos, word: greedy left-to-right decoding; -1 for a symbol that starts no word. A source is one ordered pass."""
    tree: dict = {}
    for k, w in enumerate(words):
        node = tree
        for s in w:
            node = node.setdefault(s, {})
        node[None] = k

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        sym, pos = part["sym"].tolist(), part["pos"].tolist()
        at, out = 0, []
        while at < len(sym):
            node, best, end = tree, -1, at + 1
            for k in range(at, len(sym)):
                node = node.get(sym[k])
                if node is None:
                    break
                if None in node:
                    best, end = node[None], k + 1
            out.append((pos[at], best))
            at = end
        return pd.DataFrame({"source": part["source"].iloc[0], "pos": [p for p, _ in out], "word": [w for _, w in out]})

    return symbols.groupBy("source").applyInPandas(work, "source long, pos long, word int")


_G = """, g AS (SELECT source, pos, sym, lead(sym) OVER w AS s2, lead(sym, 2) OVER w AS s3 FROM symbols WINDOW w AS (PARTITION BY source ORDER BY pos)),
n1 AS (SELECT sym::VARCHAR AS gram, count(*) AS count FROM g GROUP BY 1), n2 AS (SELECT sym || ' ' || s2 AS gram, count(*) AS count FROM g WHERE s2 IS NOT NULL GROUP BY 1), n3 AS (SELECT sym || ' ' || s2 || ' ' || s3 AS gram, count(*) AS count FROM g WHERE s3 IS NOT NULL GROUP BY 1)
"""


@query("ngram_counts", "AGG-17 SEQ-03", _G + "SELECT gram, 1 AS n, count FROM n1 UNION ALL SELECT gram, 2, count FROM n2 UNION ALL SELECT gram, 3, count FROM n3")
def _(v):
    return counts(v.symbols, 3).select("gram", "n", "count")


@query("ngram_top", "SEQ-01", _G + "SELECT gram, count FROM n3 ORDER BY count DESC, gram LIMIT 10")
def _(v):
    return ngrams(v.symbols, 3).groupBy("gram").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "gram").limit(10)


@query("ngram_prefix_tree", "SEQ-04 SEQ-07", _G + "SELECT n3.gram, n3.count, n2.count AS prefix, round(n3.count * 1.0 / n2.count + 3e-8, 6) AS p FROM n3 JOIN n2 ON n3.gram LIKE n2.gram || ' %'")
def _(v):
    three = ngrams(v.symbols, 3).groupBy("gram").agg(F.count("*").alias("count")).withColumn("parent", F.substring_index("gram", " ", 2))
    two = ngrams(v.symbols, 2).groupBy(F.col("gram").alias("parent")).agg(F.count("*").alias("prefix"))
    return three.join(two, "parent").select("gram", "count", "prefix", F.round(F.col("count") / F.col("prefix") + 3e-8, 6).alias("p"))


@query("ngram_labels", "SEQ-02", _G + "SELECT source, pos, CASE WHEN sym = 0 AND s2 = 1 THEN '0 1' WHEN sym = 2 AND s2 = 2 THEN '2 2' ELSE 'oov' END AS label FROM g")
def _(v):
    two = F.concat_ws(" ", F.col("sym").cast("string"), F.lead("sym").over(_order()).cast("string"))
    return v.symbols.select("source", "pos", F.when(two.isin("0 1", "2 2"), two).otherwise("oov").alias("label"))


@query("symbol_runs", "WIN-15 SEQ-02", ', r AS (SELECT source, pos, sym, pos - row_number() OVER (PARTITION BY source, sym ORDER BY pos) AS island FROM symbols) SELECT source, min(pos) AS "begin", count(*) AS length, sym FROM r GROUP BY source, sym, island')
def _(v):
    return runs(v.symbols.withColumnRenamed("pos", "frame_idx"), "sym").select("source", "begin", "length", "sym")


@query("longest_match_decode", "SEQ-08")
def _(v):
    """Words: the 20 most frequent 2- and 3-grams (a top-k table, as the operator's word list is)."""
    top = counts(v.symbols, 3).where("n > 1").orderBy(F.col("count").desc(), "gram").limit(20).collect()
    return longest_match(v.symbols, [[int(s) for s in row["gram"].split()] for row in top])


@query("conversation_symbols", "SRC-02", "SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def _(v):
    rows = v.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return rows.select("conv_id", F.concat_ws(" ", F.transform("t", lambda x: x["role"])).alias("roles"), F.size("t").cast("long").alias("n"))


def read_symbols(text: Column, begin: int = 0, length: int | None = None) -> Column:
    """(idx, sym, oov) structs of a text: a run of digits is its number, any other word is -1 with its text; from `begin`, up to `length`."""
    words = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9\x00-\x20][^\x00-\x20]*)"), F.lit(1))
    word = lambda w, i: F.struct(i.cast("long").alias("idx"), F.coalesce(F.when(w.rlike("^[0-9]"), w.try_cast("bigint")), F.lit(-1).cast("long")).alias("sym"), F.when(w.rlike("^[0-9]"), F.lit(None)).otherwise(w).alias("oov"))
    all_words = F.transform(words, word)
    return F.slice(all_words, begin + 1, F.size(all_words) if length is None else F.lit(length))


@query(
    "source_symbols",
    "SEQ-09",
    ", w AS (SELECT conv_id, turn, regexp_extract_all(text, '([0-9]+|[^0-9\\x00-\\x20][^\\x00-\\x20]*)', 1) AS w FROM conversations), e AS (SELECT conv_id, turn, unnest(range(0, len(w))) AS idx, unnest(w) AS word FROM w) SELECT conv_id, turn, idx, coalesce(CASE WHEN regexp_matches(word, '^[0-9]') THEN try_cast(word AS BIGINT) END, -1) AS sym, CASE WHEN NOT regexp_matches(word, '^[0-9]') THEN word END AS oov FROM e WHERE idx >= 2 AND idx < 12",
)
def _(v):
    """Ten symbols of each turn from the third on."""
    rows = v.table("conversations").select("conv_id", "turn", F.explode(read_symbols(F.col("text"), 2, 10)).alias("s"))
    return rows.select("conv_id", "turn", "s.idx", "s.sym", "s.oov")
