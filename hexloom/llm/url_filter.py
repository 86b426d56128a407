"""URL verdicts: host and path rules first, and association rules over URL tokens for the rest."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import islice, product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.session import cut_lineage

#: (host, path, verdict): the rules of the query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Share of the labelled URLs that a token combination must have, and of its URLs that must have the verdict.
SUPPORT, CONFIDENCE = 0.002, 0.8
#: Association rules that go to a task at once; more of them are matched in blocks of this size.
BLOCK_RULES = 20_000
DEFAULT = "allow"
_SAYS = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end. Without ``://`` both are empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (like ``example.org/es/``) and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """A URL's distinct tokens: scheme, host labels and the words of hyphened ones, path words by place, and query names."""
    host, path = host_and_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    pieces = F.transform(labels, lambda x: F.concat(F.lit("host="), x))
    words = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.transform(F.split(x, "-"), lambda w: F.concat(F.lit("word="), w))))
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    shaped = F.transform(steps, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(x, "[0-9]+", "0")))
    asked = F.transform(F.regexp_extract_all(url, F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query="), x))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))))
    return F.array_distinct(F.concat(scheme, pieces, words, shaped, asked))


def _twins(baskets: DataFrame, support: float) -> dict[str, str]:
    """Of the tokens that meet the support, each one's representative: the least that stands in exactly the same baskets."""
    rows = baskets.count()
    marked = baskets.select(F.explode("items").alias("token"), *[F.pmod(F.xxhash64(F.lit(s), "items"), F.lit(1 << 31)).alias(f"h{s}") for s in (1, 2)])
    covers = marked.groupBy("token").agg(F.count("*").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).where((F.col("n") >= support * rows) & ~F.startswith("token", F.lit(_SAYS)))
    first: dict[tuple, str] = {}
    return {r.token: first.setdefault((r.n, r.h1, r.h2), r.token) for r in covers.orderBy("token").toLocalIterator()}


def _represented(batches: Iterator[pa.RecordBatch], twins: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Baskets of representatives and verdicts."""
    for batch in batches:
        items = [sorted({t if t.startswith(_SAYS) else twins[t] for t in found if t in twins or t.startswith(_SAYS)}) for found in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], ["items"])


def _spelt_out(batches: Iterator[pa.RecordBatch], twins: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Each rule once for every choice of tokens that its representatives stand for."""
    groups = defaultdict(list)
    for token, first in twins.items():
        groups[first].append(token)
    for batch in batches:
        for row in batch.to_pylist():
            choices = product(*(groups[t] for t in row["antecedent"]))
            while part := list(islice(choices, 4096)):
                yield pa.RecordBatch.from_pylist([{**row, "antecedent": list(c)} for c in part], batch.schema)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Association rules (antecedent, verdict, confidence, share) from ``labelled`` (url, verdict).

    FP-growth mines frequent sets of tokens with the verdict among them. A rule needs
    the support and confidence, and more confidence than every rule of the same verdict
    that needs only a part of its tokens; all such rules are kept. Tokens that stand in
    the same URLs are mined as one and spelt out in the rules that are left: rules with
    two of them would be redundant, and long paths would have sets beyond number.
    Without labelled URLs there are no rules.
    """
    spark = labelled.sparkSession
    baskets = labelled.where("url is not null and verdict is not null").select(F.array_append(tokens(F.col("url")), F.concat(F.lit(_SAYS), "verdict")).alias("items"))
    empty = "antecedent array<string>, verdict string, confidence double, share double"
    if not baskets.limit(1).count():
        return spark.createDataFrame([], empty)
    baskets = cut_lineage(baskets)
    twins = _twins(baskets, support)
    mined = baskets.mapInArrow(partial(_represented, twins=twins), "items array<string>")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0, predictionCol="unused").fit(mined)
    found = model.associationRules.where(F.startswith(F.element_at("consequent", 1), F.lit(_SAYS)))
    rules = found.select("antecedent", F.substring(F.element_at("consequent", 1), F.lit(len(_SAYS) + 1), F.lit(99)).alias("verdict"), "confidence", F.col("support").alias("share"))
    rules = rules.where(~F.exists("antecedent", lambda t: F.startswith(t, F.lit(_SAYS))))
    return pruned(cut_lineage(rules), confidence).select("antecedent", "verdict", "confidence", "share").mapInArrow(partial(_spelt_out, twins=twins), empty)


def pruned(rules: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """The rules that have the confidence, and more than every rule of the same verdict that needs only a part of their tokens.

    ``rules`` has all frequent antecedents, also of less confidence. They are closed under
    leaving tokens out, so that the best confidence of all parts comes up in one join for
    each size, from the parts that leave one token out.
    """
    key = lambda c: F.array_join(F.array_sort(c), "\n")
    known = cut_lineage(rules.withColumns({"key": key("antecedent"), "size": F.size("antecedent")}))
    longest = known.agg(F.max("size")).first()[0] or 0
    below, out = known.where("size = 1").withColumn("best", F.lit(-1.0)), None
    for size in range(1, longest + 1):
        if size > 1:
            own = known.where(F.col("size") == size)
            parts = own.select("key", "verdict", F.explode("antecedent").alias("left"), "antecedent").select("key", "verdict", key(F.array_remove("antecedent", F.col("left"))).alias("part"))
            best = parts.join(below.select(F.col("key").alias("part"), "verdict", F.greatest("confidence", "best").alias("b")), ["part", "verdict"]).groupBy("key", "verdict").agg(F.max("b").alias("best"))
            below = cut_lineage(own.join(best, ["key", "verdict"]).select(*known.columns, "best"))
        kept = below.where((F.col("confidence") >= confidence) & (F.col("confidence") > F.col("best"))).drop("key", "size", "best")
        out = kept if out is None else out.union(kept)
    return rules if out is None else out


def _matched(batches: Iterator[pa.RecordBatch], rules) -> Iterator[pa.RecordBatch]:
    """Batches, the last column of which is the verdict, with it filled in where it is null and a rule fits."""
    often = Counter(t for items, _ in rules.value for t in items)
    index = defaultdict(list)
    for rank, (items, verdict) in enumerate(rules.value):
        index[min(items, key=lambda t: (often[t], t))].append((rank, frozenset(items), verdict))
    for batch in batches:
        out = []
        for found, before in zip(batch.column("tokens__").to_pylist(), batch.columns[-1].to_pylist(), strict=True):
            if before is not None:
                out.append(before)
                continue
            has = frozenset(found or ())
            fits = [(rank, verdict) for t in has for rank, items, verdict in index.get(t, ()) if items <= has]
            out.append(min(fits)[1] if fits else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], batch.schema.names)


def match(urls: DataFrame, rules: DataFrame, url: str = "url", into: str = "mined") -> DataFrame:
    """``urls`` with the verdict of the best association rule that fits each, or null; nothing is shuffled.

    The rules go to every task as an inverted index: each is filed under that of its
    tokens which fewest rules have, and a URL looks up its own tokens. Of the rules
    whose tokens the URL has all, the most confident holds, then the most frequent, then
    block. More than ``BLOCK_RULES`` rules go in blocks, the best first, and a later
    block judges only what the earlier ones left. Null URLs fit no rule.
    """
    ranked = cut_lineage(rules.orderBy(F.desc("confidence"), F.desc("share"), F.desc("verdict"), F.array_sort("antecedent"))).toLocalIterator()
    urls = urls.drop(into)
    out = urls.withColumn("tokens__", tokens(F.coalesce(F.col(url), F.lit("")))).withColumn(into, F.lit(None).cast("string"))
    while block := [(r.antecedent, r.verdict) for r in islice(ranked, BLOCK_RULES)]:
        out = out.mapInArrow(partial(_matched, rules=urls.sparkSession.sparkContext.broadcast(block)), out.schema)
    return out.select(*[F.col(f"`{c}`") for c in urls.columns], into)


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``urls`` (url, any others) with host, path, rule and verdict.

    verdict: that of the longest rule that fits; else of the association rules, which
    are mined from ``labelled`` (url, verdict) or, without it, from the URLs that a rule
    fits; else ``DEFAULT``. Null URLs and ones without ``://`` have empty host and path
    and no rule. Repeated rows stay; columns already named like the added ones are
    replaced. No rows give no rows.
    """
    urls = urls.drop("host", "path", "rule", "verdict", "listed__")
    host, path = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    known = urls.withColumn("host", host).withColumn("path", path)
    rule, says = listed(F.col("host"), F.col("path"), rules)
    known = known.withColumn("rule", rule).withColumn("listed__", says)
    mined = mine(labelled if labelled is not None else known.select("url", F.col("listed__").alias("verdict")))
    out = match(known, mined, into="mined__")
    return out.withColumn("verdict", F.coalesce("listed__", "mined__", F.lit(DEFAULT))).drop("listed__", "mined__")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged; the pages that a rule fits are the labelled ones."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
