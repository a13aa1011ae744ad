r"""Personal data by bootstrapped contextual extraction.

1. Base entities (emails, IP addresses, cards, phones) are found by their forms. They are the
   seeds. Other stretches that look like identifiers are candidates: addresses spelled with
   words or brackets for ``@`` and dots, and groups of six digits or more.
2. Each seed and candidate stands in two lexical patterns: the two words before it, and the
   word before with the word after it (A-Z lower-cased, digits as 0). Patterns and instances
   (the strings themselves) are the two sides of a graph; an edge is there once, however often
   a text is copied.
3. Spark scores the graph in rounds, by joins and sums over its edges. A pattern's score for a kind is the
   score of its instances for it, over their number and ``doubt``; fewer than
   ``least_support`` instances that score at least ``confident`` give none. An instance's score is the chance that not all of
   its confident patterns are wrong; seeds keep 1 for their own kind. So instances that a confident pattern
   discovers support other patterns in the next round.
4. Candidates in a confident pattern become spans of its best kind. Base spans always stay.

The graph never reaches the driver, and what it sends through exchanges are identifiers and
their contexts, not texts. Patterns of more edges than a quarter of a partition's share are
broadcast with their scores, so that their edges stay where they are.

Defined results: a null text is empty; a null doc_id is kept as it is; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored. A context
word of more than 64 characters makes no pattern. Candidates never overlap base spans. Very
long texts and words are handled whole, in time that follows their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, hot_limit, in_slices, join_counted, left_join_salted

#: Kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Addresses in words: name (at) host (dot) domain, with spaces, brackets or both around the words.
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]{1,63})+"
)
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().:/_-]{0,2}[0-9])++")
_BEFORE = re.compile(r"(\S+)[^\S\n]+(\S+)[^\S\n]*$|(\S+)[^\S\n]*$")
_AFTER = re.compile(r"[^\S\n]*(\S+)")
_EDGE = "\"'`.,;!?<>[]{}*~|"
_ZEROS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")

_FOUND = "start long, stop long, kind string, family string, value string, before string, around string"
_ROW = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:long,kind:int,stop:long>>, digest string, sha string, found array<struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>>"
_BASE_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
_FOUND_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), *((name, pa.string()) for name in ("kind", "family", "value", "before", "around"))]))
_ROW_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{kind}", pa.int64()) for kind in KINDS), ("base", _BASE_ARROW), ("digest", pa.string()), ("sha", pa.string()), ("found", _FOUND_ARROW)])

_LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(_LUHN[d] for d in back[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the form, leftmost first: each ``@`` with what stands before it, since the last match."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def _plain(m: re.Match) -> str:
    return _NOT_DIGIT.sub("", m.group())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, stop) of the base entities, by start, then kind."""
    out = [(start, 0, stop) for start, stop in _emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _plain(m)) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_plain(m)) <= 15]
    return sorted(out)


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, stop, family) of stretches that look like identifiers and overlap no base span."""
    found = [(m.start(), m.end(), "address") for m in _SPELLED.finditer(text)] if " at " in text or " AT " in text or "at)" in text.lower() or "at]" in text.lower() or "at}" in text.lower() or "@" in text else []
    found += [(m.start(), m.end(), "number") for m in _NUMBER.finditer(text) if m.end() - m.start() >= 6 and len(_plain(m)) >= 6]
    out, at, last = [], 0, 0
    taken = sorted((start, stop) for start, _, stop in base)
    for start, stop, family in sorted(found):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= last and not any(a < stop and start < b for a, b in taken[at : at + 4]):
            out.append((start, stop, family))
            last = stop
    return out


def _word(word: str | None) -> str | None:
    """A context word as patterns have it; None if it can't be one."""
    word = (word or "").strip(_EDGE).translate(_ZEROS)
    return word if 0 < len(word) <= 64 else None


def _contexts(text: str, start: int, stop: int) -> tuple[str | None, str | None]:
    """The two patterns of a stretch: two words before it; the word before and the word after it. Of its own line only."""
    line = text.rfind("\n", max(0, start - 200), start) + 1
    m = _BEFORE.search(text[max(line, start - 200) : start])
    far, near = (_word(m.group(1)), _word(m.group(2) or m.group(3))) if m else (None, None)
    m = _AFTER.match(text, stop, stop + 200)
    after = _word(m.group(1)) if m else None
    return f"{far} {near} _" if far and near else None, f"{near} _ {after}" if near and after else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document: its base spans, and seeds and candidates with their patterns."""

    def rows():
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                counts = [sum(kind == k for _, kind, _ in base) for k in range(4)]
                listed = ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop in base)
                others = _candidates(text, base)
                found = [(start, stop, KINDS[kind], "address" if kind == 0 else "number", text[start:stop], *_contexts(text, start, stop)) for start, kind, stop in base]
                found += [(start, stop, None, family, text[start:stop], *_contexts(text, start, stop)) for start, stop, family in others]
                names = ("start", "stop", "kind", "family", "value", "before", "around")
                sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if others else None
                yield doc_id, *counts, [dict(zip(("start", "kind", "stop"), b, strict=True)) for b in base], hashlib.sha256(listed.encode()).hexdigest(), sha, [dict(zip(names, f, strict=True)) for f in found]

    yield from in_slices(rows(), _ROW_ARROW)


def _edges(rows: DataFrame) -> DataFrame:
    """(pattern, instance, one column a kind: 1 if the instance is a seed of it, family), once each."""
    found = rows.select(F.explode("found").alias("f")).select("f.*")
    each = found.select(F.explode(F.array("before", "around")).alias("pattern"), F.concat_ws(":", "family", F.lower("value")).alias("instance"), "kind", "family").where("pattern is not null")
    seeds = [F.max((F.coalesce("kind", F.lit("")) == kind).cast("double")).alias(kind) for kind in KINDS]
    return each.groupBy("pattern", "instance", "family").agg(*seeds)


def score_patterns(edges: DataFrame, tables: Tables, rounds: int = 3, confident: float = 0.8, doubt: float = 0.5, least_support: int = 3) -> DataFrame:
    """(pattern, size, one column a kind) of the patterns that score at least ``confident`` for some kind.

    ``edges`` has pattern, instance, family and, for each kind, 1 where the instance is a seed
    of it; every round is one pass to patterns and one to instances. The last round's
    patterns are returned.
    """
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    limit = hot_limit(edges, edges.count())
    now = edges
    for i in range(rounds):
        support = [F.sum((F.col(k) >= confident).cast("int")).alias(f"{k}_n") for k in KINDS]
        patterns = now.groupBy("pattern").agg(F.count("*").alias("size"), *(F.sum(k).alias(k) for k in KINDS), *support)
        scored = [F.when(F.col(f"{k}_n") >= least_support, F.col(k) / (F.col("size") + doubt)).otherwise(0.0).alias(k) for k in KINDS]
        patterns = tables.write(patterns.select("pattern", "size", *scored).where(F.greatest(*KINDS) >= confident))
        if i == rounds - 1:
            break
        scores = patterns.select("pattern", "size", *(F.when(F.col(k) >= confident, F.col(k)).otherwise(0.0).alias(f"p_{k}") for k in KINDS))
        reached = join_counted(edges.select("pattern", "instance", "family"), scores, "pattern", "size", limit)
        suits = lambda k: F.col("family") == ("address" if k == "email" else "number")
        missed = [F.sum(F.when(suits(k), F.log(1 - F.col(f"p_{k}"))).otherwise(0.0)).alias(f"i_{k}") for k in KINDS]
        instances = reached.groupBy("instance").agg(*missed).select("instance", *((1 - F.exp(f"i_{k}")).alias(f"i_{k}") for k in KINDS))
        # An instance that no confident pattern holds keeps what it is: its edges don't need this join to be whole.
        now = tables.write(edges.join(instances, "instance", "left").select("pattern", "instance", "family", *(F.greatest(F.col(k), F.coalesce(f"i_{k}", F.lit(0.0))).alias(k) for k in KINDS)))
    return patterns


def discovered(rows: DataFrame, patterns: DataFrame, confident: float) -> DataFrame:
    """(sha, spans) of texts with candidates in confident patterns: start, kind number, stop, the best kind of each."""
    spots = rows.where("sha is not null").select("sha", F.explode(F.expr("filter(found, f -> f.kind is null)")).alias("f"))
    each = spots.select("sha", "f.start", "f.stop", "f.family", F.explode(F.array("f.before", "f.around")).alias("pattern")).where("pattern is not null")
    counted = patterns.join(each.groupBy("pattern").agg(F.count("*").alias("spots")), "pattern").drop("size")
    hits = join_counted(each, counted, "pattern", "spots", hot_limit(rows, rows.count()))
    best = lambda kinds: F.greatest(*(F.struct(F.col(k).alias("score"), F.lit(-KINDS.index(k)).alias("kind")) for k in kinds))
    found = F.when(F.col("family") == "address", F.struct(F.col("email").alias("score"), F.lit(0).alias("kind"))).otherwise(best(KINDS[1:]))
    top = hits.groupBy("sha", "start", "stop").agg(F.max(found).alias("best")).where(F.col("best.score") >= confident)
    return top.groupBy("sha").agg(F.collect_list(F.struct(F.col("start"), (-F.col("best.kind")).alias("kind"), F.col("stop"))).alias("more"))


def _listed(spans: Column) -> Column:
    """kind:start:stop by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 3, confident: float = 0.8) -> DataFrame:
    """One row a document: doc_id, n_<kind> and base_sha256 of the base entities, and spans, all entities found."""
    with Tables(df.sparkSession) as tables:
        rows = tables.write(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_scan, _ROW))
        edges = tables.write(_edges(rows))
        patterns = score_patterns(edges, tables, rounds, confident)
        more = tables.write(discovered(rows, patterns, confident))
        counted = more.join(rows.where("sha is not null").groupBy("sha").agg(F.count("*").alias("copies")), "sha")
        slim = rows.drop("found")
        joined = left_join_salted(slim, counted, "sha", "copies", hot_limit(rows, rows.count()), ["doc_id"])
        spans = F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")))
        return cut(joined.select("doc_id", *(f"n_{kind}" for kind in KINDS), F.col("digest").alias("base_sha256"), _listed(spans).alias("spans")))
