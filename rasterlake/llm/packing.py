"""Best-fit packing with conflicts.

Documents are dealt into shards by a hash of their id, length, source and cluster, so that a
shard has about ``shard_rows`` documents whatever source or duplicate cluster is frequent;
rows that are equal in all four and more than a shard's share are dealt on by their number. In a shard,
documents go from the longest to the shortest. A document longer than a bin first fills
whole bins of its own; its last part is packed. Bins are ordered by residual; each has a
bitmap of the duplicate clusters and, in ``per_source`` planes, of the sources that it
holds. The search starts at the tightest residual that fits and goes to the next larger
one until a bin has neither the document's cluster nor its source in every plane; that
bin is the tightest compatible one. Otherwise a new bin is opened.

Defined results: a null or empty text has length 0 and is placed as a part of length 0;
a null source or cluster conflicts with nothing; repeated rows are placed once each (they
share a cluster, so in different bins of their shard); ties in length go by id as text, null
ids last; an empty table has no bins; very long texts fill bins of their own; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, hot_limit

_DDL = "doc_id string, part long, bin_id string, offset long, length long, start long"


class Bins:
    """Open bins of one shard, ordered by residual."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.planes = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a part; ``source`` and ``cluster`` are single bits, or 0."""
        at = bisect_left(self.order, (length, -1))
        while at < len(self.order):
            residual, bin_ = self.order[at]
            if not (self.clusters[bin_] & cluster or (source and self.sources[bin_][-1] & source)):
                del self.order[at]
                break
            at += 1
        else:
            residual, bin_ = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.planes)
        self.clusters[bin_] |= cluster
        if source:
            planes = self.sources[bin_]
            planes[next(i for i in range(self.planes) if not planes[i] & source)] |= source
        insort(self.order, (residual - length, bin_))
        return bin_, self.capacity - residual


def _shard(capacity: int, per_source: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        rows = rows.sort_values(["length", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
        bits = {}
        for name in ("source", "cluster"):
            codes, _ = pd.factorize(rows[name])
            bits[name] = [1 << c if c >= 0 else 0 for c in codes.tolist()]
        bins, out, full = Bins(capacity, per_source), [], 0
        for doc, length, source, cluster in zip(rows["doc_id"].tolist(), rows["length"].tolist(), bits["source"], bits["cluster"], strict=True):
            whole = length // capacity if length > capacity else 0
            for part in range(whole):
                out.append((doc, part, f"{shard}-w{full}", 0, capacity, part * capacity))
                full += 1
            if (rest := length - whole * capacity) or not whole:
                bin_, offset = bins.place(rest, source, cluster)
                out.append((doc, whole, f"{shard}-{bin_}", offset, rest, whole * capacity))
        return pd.DataFrame(out, columns=["doc_id", "part", "bin_id", "offset", "length", "start"])

    return run


def pack(
    df: DataFrame,
    capacity: int = 16384,
    per_source: int = 4,
    shard_rows: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
) -> DataFrame:
    """Where each part of each document goes: doc_id, part, bin_id, offset, length, start.

    Lengths are UTF-8 bytes, ``start`` is the part's place in its text. Without a
    ``cluster`` column, texts that are equal are a cluster.
    """
    key = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if cluster is None else F.xxhash64(cluster)
    rows = df.select(
        F.col(doc_id).cast("long").cast("string").alias("doc_id"),  # pandas would make nullable numbers doubles
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("length"),
        F.col(source).cast("string").alias("source"),
        (F.when(F.coalesce(F.octet_length(text), F.lit(0)) > 0, key) if cluster is None else F.when(F.col(cluster).isNotNull(), key)).alias("cluster"),
    )
    with Tables(df.sparkSession) as tables:
        rows = tables.write(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("doc_id", "length", "source", "cluster")))
        total = rows.count()
        shards = max(1, -(-total // shard_rows))
        most = max(shard_rows, hot_limit(df, total))  # so fewer keys are broadcast than four a shuffle partition
        hot = rows.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > most).select("h", F.ceil(F.col("c") / shard_rows).alias("c"))
        rows = rows.join(F.broadcast(hot), "h", "left").withColumn("shard", F.pmod(F.xxhash64("h", F.pmod("row", "c")), F.lit(shards)))
        rows = rows.select("doc_id", "length", "source", "cluster", "shard")
        return cut(rows.groupBy("shard").applyInPandas(_shard(capacity, per_source), _DDL).withColumn("doc_id", F.col("doc_id").cast("long")))
