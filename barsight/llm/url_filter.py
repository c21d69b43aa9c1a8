"""URL filter: host and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give every character of a URL a
probability from its up to ORDER predecessors: Witten-Bell interpolation from order 0 up, down to a uniform 1/256. The
verdict is the difference of the two log-likelihoods divided by the URL's length in bytes, against a calibrated threshold: the
highest whose balanced accuracy on URLs that a rule decides is within TOLERANCE of the best, so that doubt accepts.

The rejected model learns from URLs that a rule blocks, the accepted one from all others: those that a rule allows, and those
that none decides, as most URLs are wanted and else a host with block rules alone would count as evidence by its name. So a
URL is blocked where it is like blocked URLs and unlike the rest. Learning and judging are apart: URLs are in two halves by a
hash of their text, and each half is scored by the other's models, for the calibration as for the verdict. Lists of known good
and bad URLs can be given and teach both models.

A character with its ORDER predecessors is one number (a gram,
exact), and its probability depends on nothing else. So Spark counts grams, whatever their number, and works out the log-ratio of
every distinct gram of the URLs to judge by joins, an order at a time; no table of the model goes through the driver. The HOT
most common grams are sent to the tasks that add up the URLs; the others are joined.

Cases: a null URL or one without :// has an empty host and path, fits no rule and is judged by its text ('' if null); an
empty text has ratio 0; repeated rows get equal verdicts; a model without learning URLs gives every character 1/256; where no
rule blocks or none allows a URL, the verdict is 'allow'; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

# Fixed values of the contract: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: A byte is 1 to 256, the place before a URL 0. Log-ratios are summed as whole multiples of 1 / SCALE, so order does not matter.
ORDER, BASE, SCALE, HOT = 5, 257, 1 << 32, 100_000
#: Bins of the ratio for the calibration.
BINS, SPAN, TOLERANCE = 4001, 8.0, 0.02


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones, the longer host, then the first in order."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all characters of the URLs, and the URLs' lengths in bytes."""
    raw = [u.encode("utf-8", "surrogatepass") for u in urls]
    lengths = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(lengths)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + 1
    place = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    grams, weight = flat.copy(), BASE
    for k in range(1, ORDER + 1):
        grams[k:] += np.where(place >= k, np.roll(flat, k), 0)[k:] * weight
        weight *= BASE
    return grams, lengths


def _counts(urls: DataFrame) -> DataFrame:
    """(gram, n0, n1, uses) from (text, n, rejected): uses in accepted and rejected URLs n times each, and in all URLs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, lengths = _grams(batch.column(0).to_pylist())
            n = np.repeat(batch.column(1).to_numpy(), lengths)
            rejected = np.repeat([-1 if r is None else r for r in batch.column(2).to_pylist()], lengths)
            found, at = np.unique(grams, return_inverse=True)
            sums = [np.zeros(len(found), np.int64) for _ in range(3)]
            for out, used in zip(sums, (np.where(rejected == 0, n, 0), np.where(rejected == 1, n, 0), np.ones(len(grams), np.int64))):
                np.add.at(out, at, used)
            yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], ["gram", "n0", "n1", "uses"])

    rows = urls.select("text", "n", "rejected").mapInArrow(run, "gram bigint, n0 bigint, n1 bigint, uses bigint")
    return cut(rows.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "uses"))))


def _distinct(df: DataFrame, url: str, rejected: Column) -> DataFrame:
    """(text, rejected, n) of the distinct URLs, null as ''."""
    return df.select(F.coalesce(F.col(url), F.lit("")).alias("text"), rejected.cast("int").alias("rejected")).groupBy("text", "rejected").agg(F.count("*").alias("n"))


class Model:
    """(gram, n0, n1): how often the accepted and the rejected learning URLs hold each gram."""

    def __init__(self, counts: DataFrame) -> None:
        self.counts = counts.where("n0 + n1 > 0").select("gram", "n0", "n1")

    def log_ratios(self, urls: list[str | None]) -> np.ndarray:
        """Per URL (log-likelihood as rejected minus as accepted) / bytes."""
        df = self.counts.sparkSession.createDataFrame(list(enumerate(urls)), "i int, url string")
        return np.array([r["_ratio"] for r in ratios(df, self).orderBy("i").collect()])

    def weights(self, grams: DataFrame) -> DataFrame:
        """(gram, weight): SCALE times the log-ratio of each gram. An order's rows meet at most BASE others of a key."""
        lower = None
        for k in range(ORDER + 1):
            few = F.broadcast if k < 2 else lambda df: df
            seen = self.counts.groupBy((F.col("gram") % BASE ** (k + 1)).alias("key")).agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))
            total = seen.groupBy(F.expr(f"key div {BASE}").alias("context")).agg(F.sum("s0").alias("t0"), F.sum("s1").alias("t1"), F.count_if(F.col("s0") > 0).alias("types0"), F.count_if(F.col("s1") > 0).alias("types1"))
            need = grams.select((F.col("gram") % BASE ** (k + 1)).alias("key")).distinct().withColumn("context", F.expr(f"key div {BASE}")).withColumn("short", F.col("key") % BASE**k)
            rows = need.join(few(seen), "key", "left").join(few(total), "context", "left")
            rows = rows.withColumns({"p0": F.lit(1 / 256), "p1": F.lit(1 / 256)}) if lower is None else rows.join(few(lower), "short", "left")
            p = [F.when(F.col(f"t{c}") > 0, (F.coalesce(f"s{c}", F.lit(0)) + F.col(f"types{c}") * F.col(f"p{c}")) / (F.col(f"t{c}") + F.col(f"types{c}"))).otherwise(F.col(f"p{c}")) for c in (0, 1)]
            level = cut(rows.select("key", p[0].alias("p0"), p[1].alias("p1")))
            lower = level.withColumnRenamed("key", "short")
        log = [F.log(F.greatest(F.col(f"p{c}"), F.lit(1e-12))) for c in (0, 1)]
        return level.select(F.col("key").alias("gram"), F.round((log[1] - log[0]) * SCALE).cast("bigint").alias("weight"))


def train(learning: DataFrame) -> Model:
    """A model from (url, rejected 0/1)."""
    return Model(_counts(_distinct(learning, "url", F.col("rejected"))))


def ratios(df: DataFrame, model: Model, url: str = "url", counts: DataFrame | None = None) -> DataFrame:
    """df with the column _ratio. counts: of the grams of df's URLs, if they are known."""
    urls = cut(_distinct(df, url, F.lit(None)).select("text", "n", "rejected"))
    counts = _counts(urls) if counts is None else counts
    weights = cut(model.weights(counts.select("gram")).join(counts.select("gram", "uses"), "gram"))
    # A fixed number of rows; the others stay distributed.
    hot = weights.orderBy(F.desc("uses"), "gram").limit(HOT).select("gram", "weight").orderBy("gram").toArrow()
    sent = df.sparkSession.sparkContext.broadcast((hot["gram"].to_numpy(), hot["weight"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per URL a row with the sum of its hot grams, and one for each other gram."""
        known, values = sent.value
        for batch in batches:
            grams, lengths = _grams(batch.column(1).to_pylist())
            row = np.repeat(np.arange(batch.num_rows), lengths)
            at = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
            is_hot = known[at] == grams if len(known) else np.zeros(len(grams), bool)
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[is_hot], values[at[is_hot]])
            rare = row[~is_hot]
            ids = pa.chunked_array([batch.column(0), batch.column(0).take(pa.array(rare))]).combine_chunks()
            gram = pa.array(np.concatenate([np.zeros(len(sums), np.int64), grams[~is_hot]]), mask=np.arange(len(sums) + len(rare)) < len(sums))
            yield pa.RecordBatch.from_arrays([ids, gram, pa.array(np.concatenate([sums, np.zeros(len(rare), np.int64)]))], ["id", "gram", "weight"])

    parts = cut(urls.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("id"), "text").mapInArrow(run, "id binary, gram bigint, weight bigint"))
    rare = parts.where("gram is not null").select("id", "gram").join(weights.select("gram", "weight"), "gram").select("id", "weight")
    sums = parts.where("gram is null").select("id", "weight").union(rare).groupBy("id").agg(F.sum("weight").alias("_sum"))
    text = F.coalesce(F.col(url), F.lit(""))
    keyed = df.withColumn("_text_id", F.unhex(F.md5(text.cast("binary"))))
    ratio = F.col("_sum") / F.lit(float(SCALE)) / F.greatest(F.octet_length(text), F.lit(1))
    return keyed.join(sums, keyed["_text_id"] == sums["id"]).select(*[df[c] for c in df.columns], ratio.alias("_ratio"))


def threshold(scored: DataFrame) -> float:
    """The ratio from which rejecting has the best balanced accuracy on (_ratio, rejected); histograms of fixed size decide."""
    bin_of = F.floor((F.least(F.greatest(F.col("_ratio"), F.lit(-SPAN)), F.lit(SPAN)) + SPAN) / (2 * SPAN) * (BINS - 1)).cast("int")
    hist = np.zeros((2, BINS))
    for b, c, n in scored.groupBy(bin_of.alias("b"), "rejected").count().collect():
        hist[c, b] = n
    if not hist.sum(axis=1).all():
        return float("inf")
    share = hist / hist.sum(axis=1, keepdims=True)
    good = share[1][::-1].cumsum()[::-1] + share[0].cumsum() - share[0]
    best = int(np.flatnonzero(good >= good.max() - TOLERANCE)[-1])
    return best / (BINS - 1) * 2 * SPAN - SPAN


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, accepted: Sequence[str] = (), rejected: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and ratio of every URL. accepted and rejected: known URLs beside those of the table."""
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    base = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("decided"))
    base = cut(base.withColumn("half", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(2)).cast("int")))
    learning = base.select("url", "half", F.coalesce((F.col("decided") == "block").cast("int"), F.lit(0)).alias("rejected"))
    known = [(u, h, y) for y, urls in ((0, accepted), (1, rejected)) for u in urls for h in (0, 1)]
    if known:
        learning = learning.union(spark.createDataFrame(known, "url string, half int, rejected int"))
    parts = [ratios(base.where(F.col("half") == h), train(learning.where(F.col("half") != h))) for h in (0, 1)]
    scored = cut(parts[0].union(parts[1]))
    at = threshold(scored.where("decided is not null").withColumn("rejected", (F.col("decided") == "block").cast("int")))
    verdict = F.coalesce("decided", F.when(F.col("_ratio") >= at, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.col("_ratio").alias("ratio"))


def op4(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"))

