r"""Source divergence audit: DuckDB aggregates shards of (language, term), Spark merges what they give.

Terms are the matches of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased. A language
keeps the terms in at least ``least_docs`` of its documents; every group (language, source)
and the language as a whole give each kept term a smoothed share p of 10^9, and two shares
differ by f(p, q) = floor((p - q)^2 / (p + q)).

1. A task counts the terms of its own rows by group, so a word or source that is everywhere
   leaves it as one row and not as one a document. Rows are hashed by group and term, and
   DuckDB sums each shard, so what follows has one row for a term and source.
2. Rows are hashed by language and term. A shard has all sources of its terms; DuckDB drops
   rare terms there and marks one row a term, which counts the vocabulary.
3. Totals of the groups are joined to the rows, and each shard gives partial sums: f of two
   sources over the terms that both have (against what the terms would give if they were
   absent), the histogram of a source's counts, and its ten first terms. Absent terms all
   have one share, so no row is made for a term and a source without it.
4. Spark adds the partial sums of pairs and histograms and ranks sources and terms.

All arithmetic is on integers. Defined results: null text, language and source are empty
strings; a document without terms still makes its group occur; repeated rows count as
documents of their own; a null or repeated doc_id has no effect; a language that keeps no
term gives pairs of value 0 and no terms; an empty table gives an empty result; other
columns are ignored. Very long texts are counted piece by piece, whole. The result has a row
for every two sources of a language, as the audit asks for.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, batch_of, columns_of, cut

#: Bytes of terms as they are, A-Z lower-cased, all others as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_KEPT = "lang string, source string, term string, n long, mark long"
_PARTS = "part string, lang string, source string, item string, n long, value long"

#: Entries that a task counts before it sends them on.
_HELD = 300_000
#: More groups than these are joined by an exchange and not by a broadcast.
_GROUPS = 100_000

_SUMS = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from rows group by all"

#: Rows without a term stand for a group that occurs.
_FREQUENT = """
select lang, source, term, n, case when term <> '' and row_number() over (partition by lang, term order by source) = 1 then 1 else 0 end::bigint as mark
from rows qualify term = '' or sum(docs) over (partition by lang, term) >= {least}
"""

_PARTIALS = """
with s as (
  select lang, source, term, n, total, terms, (1 + 1000000000::hugeint * (n + 2) // (total + 2 * terms))::bigint as p, (1 + 2000000000 // (total + 2 * terms))::bigint as p0,
    (1 + 1000000000::hugeint * (sum(n) over (partition by lang, term) + 2) // (lang_total + 2 * terms))::bigint as q
  from rows
), shared as (
  select 'pair' as part, a.lang, a.source, b.source as item, 0::bigint as n,
    sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p) - (a.p - b.p0) * (a.p - b.p0) // (a.p + b.p0) - (a.p0 - b.p) * (a.p0 - b.p) // (a.p0 + b.p) + (a.p0 - b.p0) * (a.p0 - b.p0) // (a.p0 + b.p0))::bigint as value
  from s a join s b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all
), counts as (
  select 'count' as part, lang, source, '' as item, n, count(*)::bigint as value from s group by all
), terms as (
  select 'term' as part, lang, source, term as item, n, (p - q) * (p - q) // (p + q) as value from s where p > q
  qualify row_number() over (partition by lang, source order by value desc, term) <= {most}
)
select * from shared union all select * from counts union all select * from terms
"""


def _pieces(body: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a folded text, about ``size`` bytes at a time."""
    start = 0
    while start < len(body):
        end = body.find(b" ", start + size) if start + size < len(body) else -1
        end = len(body) if end < 0 else end
        yield body[start:end].split()
        start = end


def _entries(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in held.items():
        terms = list(counts)
        for at in range(0, len(terms), 20_000):
            some = terms[at : at + 20_000]
            yield batch_of(_COUNTS_ARROW, [[lang] * len(some), [source] * len(some), [t.decode("utf-8", "replace") for t in some], [counts[t] for t in some], [docs[t] for t in some]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms by group of a task's rows (lang, source, text as bytes); an empty term with count 0 for the group itself."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, body in zip(*columns_of(batch), strict=True):
            if (lang, source) not in held:
                held[lang, source] = Counter({b"": 0}), Counter({b"": 0})
            counts, docs = held[lang, source]
            size -= len(counts)
            seen: set[bytes] = set()
            for terms in _pieces(body.translate(_FOLD)):
                counts.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(counts)
            if size > _HELD:
                yield from _entries(held)
                held, size = {}, 0
    yield from _entries(held)


def _shard(sql: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """DuckDB over one shard: its batches are the table ``rows``; beyond the memory limit it spills to a folder of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        with tempfile.TemporaryDirectory(prefix="shard-") as folder, duckdb.connect() as con:
            con.execute(f"set threads = 1; set memory_limit = '512MB'; set temp_directory = '{folder}'; set preserve_insertion_order = false")
            con.register("batch", pa.Table.from_batches([first]))
            con.execute("create table rows as select * from batch")
            for later in batches:
                con.register("batch", pa.Table.from_batches([later]))
                con.execute("insert into rows select * from batch")
            yield from con.sql(sql).to_arrow_reader(20_000)

    return run


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exactly."""
    grown = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return F.call_function("div", grown, (total + 2 * terms).cast("decimal(19,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares, which are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far each source is from the others and from its language.

    Part ``pair`` has each other source of the language and the sum of f over all kept terms;
    part ``term`` the ``most_terms`` kept terms that the source has a larger share of than the
    language, by f. Ranks are by value, largest first, then by item.
    """
    spark = df.sparkSession
    with Tables(spark) as tables:
        blank = lambda name: F.coalesce(F.col(name), F.lit(""))
        counts = df.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).cast("binary").alias("text")).mapInArrow(_count, _COUNTS)
        summed = counts.repartition("lang", "source", "term").mapInArrow(_shard(_SUMS), _COUNTS)
        kept = tables.write(summed.repartition("lang", "term").mapInArrow(_shard(_FREQUENT.format(least=int(least_docs))), _KEPT))
        groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("mark").alias("marks"))
        wholes = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("marks").alias("terms"))
        groups = tables.write(groups.drop("marks").join(wholes, "lang"))
        few = groups.limit(_GROUPS + 1).count() <= _GROUPS
        shares = kept.where("term <> ''").drop("mark").join(F.broadcast(groups) if few else groups, ["lang", "source"])
        parts = tables.write(shares.repartition("lang", "term").mapInArrow(_shard(_PARTIALS.format(most=int(most_terms))), _PARTS))
        by_group = Window.partitionBy("lang", "source")
        terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value")
        terms = terms.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= most_terms)
        pairs = _pairs(groups, parts)
        pairs = pairs.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "item")))
        return cut(pairs.unionByName(terms))


def _pairs(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of every two sources of a language, from partial sums."""
    counts = parts.where("part = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").alias("k"))
    counts = counts.groupBy("lang", "source").agg(F.collect_list(F.struct("n", "k")).alias("counts"))
    whole = groups.join(counts, ["lang", "source"], "left").select("lang", "source", "total", "terms", F.coalesce("counts", F.array().cast("array<struct<n:bigint,k:bigint>>")).alias("counts"))
    other = whole.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"), F.col("counts").alias("item_counts"))
    both = whole.join(other, "lang").where("source < item")
    shared = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("shared"))
    p0, q0 = _share(F.lit(0), F.col("total"), F.col("terms")), _share(F.lit(0), F.col("item_total"), F.col("terms"))
    both = both.withColumn("p0", F.when(F.col("terms") > 0, p0)).withColumn("q0", F.when(F.col("terms") > 0, q0)).withColumn("f0", _apart(F.col("p0"), F.col("q0")))

    def over(own: str, total: str, absent: str) -> Column:
        """What the terms of one side add if the other has none of them."""
        each = lambda c: c["k"] * (_apart(_share(c["n"], F.col(total), F.col("terms")), F.col(absent)) - F.col("f0"))
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, c: acc + each(c))

    value = F.col("terms") * F.col("f0") + over("counts", "total", "q0") + over("item_counts", "item_total", "p0") + F.coalesce("shared", F.lit(0))
    both = both.join(shared, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce(value, F.lit(0)).cast("long").alias("value"))
    turned = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return both.unionByName(turned).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
