"""Source divergence audit: how far the sources of each language lie apart, term by term.

Counts become integer shares, so every value is exact and hangs on the data alone. All pairs
of sources meet in a cube of cells: a cell (group block, group block, term block) gets the
slices of its two group blocks in its term block, adds up their divergences over those
terms, and the partial sums are reduced along the term axis. Each slice is copied to
the cells of its row and column only. A cell holds few groups and terms, whatever the data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajloom.llm.common import LOWER, slices, table, text_bytes
from trajloom.operators.lookup import fits_broadcast, lookup_join
from trajloom.operators.store import store

#: A term stays if at least so many documents of its language hold it.
LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
SMOOTHING = 2
TOP_TERMS = 10
#: Groups and terms of a cell, on average: blocks are made by hash.
GROUP_BLOCK = 64
TERM_BLOCK = 4096
#: Counted terms that a task holds before it hands them on.
HELD_TERMS = 300_000
PART_BYTES = 1 << 22


def _fold() -> bytes:
    """A-Z in lower case; ASCII other than letters becomes a space."""
    codes = np.arange(256)
    return np.where(((LOWER >= 97) & (LOWER <= 122)) | (codes >= 128), LOWER, 32).astype(np.uint8).tobytes()


FOLD = _fold()


def count_terms(text: bytes) -> Counter:
    """The terms of one text; a long one is cut at spaces, so only its distinct terms are held."""
    folded, counts, at = text.translate(FOLD), Counter(), 0
    while at < len(folded):
        end = len(folded) if at + PART_BYTES >= len(folded) else folded.find(b" ", at + PART_BYTES)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def counted(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """``kept`` (lang, source, term, n, lang_n, is_first), a row for each kept term that a group
    has, and ``groups`` (lang, source), from rows (lang, source, text); one pass over the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (number, documents) in held.items():
                # A row without term shows that the group occurs.
                terms = [None, *(t.decode() for t in number)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()),
                        pa.array([source] * len(terms), pa.string()),
                        pa.array(terms, pa.string()),
                        pa.array([0, *number.values()], pa.int64()),
                        pa.array([0, *(documents[t] for t in number)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "documents"],
                )
            held.clear()

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), text_bytes(part.column("text"))):
                    number, documents = held.setdefault((lang, source), (Counter(), Counter()))
                    own, before = count_terms(text), len(number)
                    number.update(own)
                    documents.update(own.keys())
                    size += len(number) - before
                    if size >= HELD_TERMS:
                        yield from rows()
                        size = 0
        yield from rows()

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = texts.mapInArrow(run, "lang string, source string, term string, n long, documents long")
    sums = store(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "term-counts")
    of_term = Window.partitionBy("lang", "term")
    kept = (
        sums.where("term IS NOT NULL")
        .withColumns(
            {
                "lang_n": F.sum("n").over(of_term),
                "_documents": F.sum("documents").over(of_term),
                "is_first": F.row_number().over(of_term.orderBy("source")) == 1,
            }
        )
        .where(F.col("_documents") >= least_documents)
        .select("lang", "source", "term", "n", "lang_n", "is_first")
    )
    return store(kept, "kept-terms"), sums.where("term IS NULL").select("lang", "source")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact at any size."""
    wide = "decimal(20,0)"
    top, bottom = (count + SMOOTHING).cast(wide) * F.lit(SCALE).cast("decimal(10,0)"), (total + SMOOTHING * terms).cast(wide)
    # No kept term: no share is ever used.
    return (F.floor((top - top % bottom) / F.nullif(bottom, F.lit(0).cast(wide))) + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most SCALE + 1, so long numbers hold all of it."""
    square = (p - q) * (p - q)
    return F.floor((square - square % (p + q)).cast("decimal(20,0)") / (p + q).cast("decimal(20,0)")).cast("long")


def with_totals(kept: DataFrame, groups: DataFrame, group_block: int, term_block: int) -> DataFrame:
    """Groups with their totals, their language's totals, and the blocks of both axes."""
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.where("is_first").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    sources = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / group_block).alias("group_blocks"))
    rows = groups.join(of_group, ["lang", "source"], "left").join(sources, "lang").join(terms, "lang", "left")
    rows = rows.na.fill(0, ["total", "terms", "lang_total"])
    return rows.withColumns(
        {
            "term_blocks": F.greatest(F.ceil(F.col("terms") / term_block), F.lit(1)),
            "block": F.pmod(F.xxhash64("source"), "group_blocks"),
            "zero": F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0),
        }
    )


def _matrix(rows: pd.DataFrame, sources: pd.Index, zeros: np.ndarray, terms: pd.Index) -> np.ndarray:
    """Share of each term in each group: that of a term without occurrences unless a row tells more."""
    out = np.repeat(zeros[:, None], len(terms), axis=1)
    out[sources.get_indexer(rows["source"]), terms.get_indexer(rows["term"])] = rows["p"].to_numpy()
    return out


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of the pairs of groups of one cell, over its term block.

    Rows without term are the groups, with the share of a term they lack and the
    number of the block's terms. Terms that no group of the cell has count by their number.
    """
    heads, cells = rows[rows["term"].isna()], rows[rows["term"].notna()]
    terms = pd.Index(cells["term"].unique())
    lang, number, sides = rows["lang"].iloc[0], int(heads["block_terms"].max()), []
    for side in (0, 1):
        own = heads[heads["side"] == side].sort_values("source")
        sources, zeros = pd.Index(own["source"]), own["p"].to_numpy(np.int64)
        sides.append((sources, zeros, _matrix(cells[cells["side"] == side], sources, zeros, terms)))
    same = rows["a"].iloc[0] == rows["b"].iloc[0]
    (sources, zeros, left), (others, other_zeros, right) = sides[0], sides[0] if same else sides[1]
    out: list[tuple] = []
    for i, source in enumerate(sources):
        rest = slice(i + 1, None) if same else slice(None)
        # A value is at most the greater share, and the shares of a group add up to little over SCALE.
        apart, base = right[rest] - left[i], other_zeros[rest] - zeros[i]
        sums = (apart * apart // np.maximum(right[rest] + left[i], 1)).sum(1)
        sums += (number - len(terms)) * (base * base // np.maximum(other_zeros[rest] + zeros[i], 1))
        out += zip([lang] * len(sums), [source] * len(sums), others[rest], sums.tolist())
    return pd.DataFrame(out, columns=["lang", "source", "other", "value"])


def pair_divergences(totals: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, other, value) for each unordered pair of sources of a language.

    ``terms`` are the kept terms with the totals of their groups.
    """
    term_block = F.pmod(F.xxhash64("term"), "term_blocks").alias("term_block")
    number = terms.where("is_first").groupBy("lang", term_block).agg(F.count(F.lit(1)).alias("block_terms"))
    heads = (
        totals.withColumn("term_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)))
        .join(number, ["lang", "term_block"], "left")
        .select(
            "lang", "source", "block", "group_blocks", "term_block", F.lit(None).cast("string").alias("term"),
            F.col("zero").alias("p"), F.coalesce("block_terms", F.lit(0)).alias("block_terms"),
        )
    )
    shares = terms.select(
        "lang", "source", "block", "group_blocks", term_block, "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), F.lit(0).cast("long").alias("block_terms"),
    )
    # A slice goes to the cells of its row and its column, each once.
    slices_ = heads.unionByName(shares).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1)))
    dealt = slices_.select(
        "lang", "source", "term", "p", "block_terms", "term_block",
        F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    partial = dealt.groupBy("lang", "a", "b", "term_block").applyInPandas(_cell, "lang string, source string, other string, value long")
    return partial.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame,
    least_documents: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS,
    group_block: int = GROUP_BLOCK,
    term_block: int = TERM_BLOCK,
) -> DataFrame:
    """Divergences of the sources of each language: (lang, source, part, item, value, rank).

    ``docs`` has lang, source and text; nulls in them count as '', further columns are not
    read, repeated rows are documents of their own. Part ``pair``: each other source of the
    language; part ``term``: the ``top`` terms that the source has more of than its language.
    Ties go to the smaller item, by bytes. A group without terms has pairs all the
    same; a language without kept terms has pairs of value 0 and no terms. An empty table
    gives an empty result.
    """
    kept, groups = counted(docs, least_documents)
    totals = store(with_totals(kept, groups, group_block, term_block), "group-totals")
    rows = lookup_join(kept, totals, ["lang", "source"], ["term"], fits_broadcast(totals))
    there, back = F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))
    pairs = pair_divergences(totals, rows).withColumn("way", F.explode(F.array(there, back)))
    pairs = pairs.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "part", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


def audited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all rows of ``documents``."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
docs AS (SELECT row_number() OVER () AS row, lang, source, terms FROM d),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
v AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN v ON v.lang = w.lang AND v.term = w.term GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS terms, sum(lang_n)::HUGEINT AS lang_total FROM v GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
s AS (SELECT t.lang, t.source, v.term, coalesce(c.n, 0) AS n,
  (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.total + 2 * l.terms))::HUGEINT AS p,
  (1 + 1000000000::HUGEINT * (v.lang_n + 2) // (l.lang_total + 2 * l.terms))::HUGEINT AS q
  FROM t JOIN l ON l.lang = t.lang JOIN v ON v.lang = t.lang
  LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = v.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT p.lang, p.source, 'pair' AS part, p.item, coalesce(f.value, 0)::BIGINT AS value
    FROM pairs p LEFT JOIN f ON f.lang = p.lang AND f.source = p.source AND f.item = p.item
  UNION ALL
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""
