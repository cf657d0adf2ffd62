"""How far the wording of sources is from each other, language by language.

Tasks run Arrow's compute functions over batches of texts: ascii_lower,
split_pattern_regex, dictionary_encode and a hash group_by give partial counts of terms by
language and source, which are merged within the task before they are shuffled once, by
language and term. The merged counts are dealt, as columns, into shards of a bounded
number of terms; a shard is a matrix of sources by terms, from which numpy takes the
shard's part of every pair's divergence. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut

#: What separates terms: all ASCII but letters.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Bytes of text whose words a task expands at once.
TEXT_BYTES = 1 << 20
#: Partial counts that a task holds before it merges them, and those that it passes on at once.
HELD_ROWS = 1_000_000
#: Cells (sources by terms) of a shard.
SHARD_CELLS = 250_000
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _runs(sizes: np.ndarray, most: int):
    """(from, to) runs of rows of about most bytes."""
    at = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(at, (at[start - 1] if start else 0) + most, side="right")))
        yield start, end
        start = end


def _counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """lang, source, term, n and docs of some rows; the empty term counts the rows of each group."""
    words = pc.split_pattern_regex(pc.ascii_lower(text), SEPARATORS)
    row, term = pc.list_parent_indices(words), pc.list_flatten(words)
    solid = pc.greater(pc.binary_length(term), 0)
    term = pc.dictionary_encode(term.filter(solid))
    in_rows = pa.table({"row": row.filter(solid), "code": term.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    groups = pa.table({"lang": lang, "source": source})
    by_row = groups.take(in_rows["row"]).append_column("code", in_rows["code"]).append_column("n", in_rows["count_all"])
    by_term = by_row.group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    rows = groups.group_by(["lang", "source"], use_threads=False).aggregate([([], "count_all")])
    empty = {"term": pa.array([""] * len(rows), pa.string()), "n": pa.array(np.zeros(len(rows), dtype=np.int64)), "docs": rows["count_all"]}
    names = term.dictionary.take(by_term["code"].combine_chunks())
    some = {"lang": by_term["lang"], "source": by_term["source"], "term": names, "n": by_term["n_sum"], "docs": by_term["count_all"]}
    return pa.concat_tables([pa.table(some), pa.table({"lang": rows["lang"], "source": rows["source"], **empty})])


def _merged(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    both = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return both.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (uses) and docs (rows that hold it), several times for a term where several tasks count it."""

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            lang, source, text = (pc.fill_null(batch.column(i).cast(pa.string()), "") for i in range(3))
            for a, b in _runs(pc.binary_length(text).to_numpy(), TEXT_BYTES):
                held.append(_counts(lang.slice(a, b - a), source.slice(a, b - a), text.slice(a, b - a)))
                if sum(map(len, held)) > 2 * HELD_ROWS:
                    held = [_merged(held)]
                    if len(held[0]) > HELD_ROWS:
                        yield from held.pop().to_batches()
        if held:
            yield from _merged(held).to_batches()
            held.clear()
        pa.default_memory_pool().release_unused()  # pooled workers outlive their tasks

    return docs.select(F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, COUNTS)


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n (uses in the language) and first (one true row a term of a language).

    Terms in fewer than min_docs rows of their language are out. The empty term stands
    for every group. One shuffle, by language and term: groups of a term are at most as
    many as its language has sources.
    """
    by_term = ["lang", "term"]
    whole = Window.partitionBy(*by_term)
    merged = partial_counts(docs).repartition(*by_term).groupBy(*by_term, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    ranked = merged.withColumns({"lang_docs": F.sum("docs").over(whole), "lang_n": F.sum("n").over(whole), "first": F.row_number().over(whole.orderBy("source")) == 1})
    return ranked.filter((F.col("lang_docs") >= min_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "lang_n", "first")


def rate(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exactly."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + kept).cast("decimal(20,0)")) + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exactly, of rates."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_totals(counts: DataFrame) -> DataFrame:
    """lang, source, total (uses of kept terms), lang_total, vocab (kept terms of the language) and shards (of the language)."""
    whole = Window.partitionBy("lang")
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("first") & (F.col("term") != "")).alias("own"))
    sums = own.withColumns({"lang_total": F.sum("total").over(whole), "vocab": F.sum("own").over(whole), "sources": F.count("*").over(whole)})
    # a shard's pairs are sources squared, so its cells are as many at least
    shards = F.ceil(F.col("vocab") * F.col("sources") / F.greatest(F.lit(SHARD_CELLS), F.col("sources") * F.col("sources")))
    return sums.select("lang", "source", "total", "lang_total", "vocab", F.greatest(F.lit(1), shards).cast("int").alias("shards"))


def _rates(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total) by long division in thousands; exact for totals up to 9 * 10^15."""
    rest, out = n + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


PAIRS = "lang string, source string, item string, value bigint"


def _pairs(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """One shard's part of the divergence of all pairs of sources of a language; shard 0 names every pair."""
    lang, shard = (k.as_py() for k in key)
    names = groups["of_source"].combine_chunks()
    many = len(names)
    sums = np.zeros((many, many), dtype=np.int64)
    if len(cells):
        term = cells["term"].combine_chunks().dictionary_encode()
        code, n = term.indices.to_numpy(), cells["n"].to_numpy()
        row = pc.index_in(cells["source"].combine_chunks(), value_set=names).to_numpy()
        total = (pc.add(groups["of_total"], groups["of_vocab"])).to_numpy()[:, None]
        order, width = np.argsort(code, kind="stable"), max(1, SHARD_CELLS // many)
        code, row, n = code[order], row[order], n[order]
        for at in range(0, len(term.dictionary), width):
            a, b = np.searchsorted(code, [at, at + width])
            block = np.zeros((many, min(width, len(term.dictionary) - at)), dtype=np.int64)
            block[row[a:b], code[a:b] - at] = n[a:b]
            p = _rates(block, total)
            for i in range(many):
                gap = p[i] - p
                sums[i] += (gap * gap // p).sum(axis=1)
    elif shard:
        return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    i, j = np.nonzero(~np.eye(many, dtype=bool))
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "value": sums[i, j]})


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: how sources differ from each other and from their language.

    Terms are runs of ASCII letters, lower-cased, and characters beyond ASCII, as they are;
    a language keeps those in at least min_docs of its rows. With rates p of a source,
    and q of another source (part pair) or of the language (part term), a term's value is
    floor((p - q)^2 / q); a pair's value sums over all kept terms of the language, 0
    without any. Part term lists the top_terms kept terms that the source uses more than
    its language does. Null texts, languages and sources are empty; a repeated row is a
    row of its own. Other columns are ignored. A task holds the sums of all pairs of sources of a
    language, as many as the result has rows.
    """
    counts = cut(term_counts(docs, min_docs))
    groups = cut(group_totals(counts))
    rows = counts.filter(F.col("term") != "").join(groups, ["lang", "source"])

    cells = rows.select("lang", F.pmod(F.xxhash64("term"), "shards").cast("int").alias("shard"), "term", "source", "n")
    aside = groups.select(*[F.col(c).alias(f"of_{c}") for c in groups.columns])
    everywhere = aside.withColumn("of_shard", F.explode(F.sequence(F.lit(0), F.col("of_shards") - 1)))
    parts = cells.groupBy("lang", "shard").cogroup(everywhere.groupBy("of_lang", "of_shard")).applyInArrow(_pairs, PAIRS)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = rate(F.col("n"), F.col("total"), F.col("vocab")), rate(F.col("lang_n"), F.col("lang_total"), F.col("vocab"))
    over = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = over.select("lang", "source", "item", excess(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top_terms))
