"""Language of whole texts by fusing evidence: text, declared markup language, address and host.

The likelihood of a text under each language is that of its byte trigrams, tempered, since
neighbouring trigrams say much the same. A language that is none of the known ones has all
trigrams alike. The host's prior is a share of what its rows' texts say, smoothed towards that
of its domain, this towards that of its address suffix, and this towards that of all rows; all
are sums by grouped aggregation. What markup declares counts by how often texts of each
language declare it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, text_column
from .words import _LOWER, SLICE, buffer

BITS = 16
UNKNOWN = "und"
#: Labelled texts of a language that are learned from, at most; languages, of which more raise.
PER_LANGUAGE, LANGUAGES = 2000, 200
#: Languages whose likelihoods are looked up together.
TOGETHER = 32
#: Counts of trigrams that a task holds before it merges them, about.
HELD = 1 << 21
#: Trigrams of a text that count as independent, at most.
INDEPENDENT = 150
#: Rows that a parent's share is worth in its child's prior.
SMOOTHING = 20.0
#: Shares of the unknown language before any text is seen, and of each language in a prior at least.
UNKNOWN_PRIOR, FLOOR = 0.005, 0.002


def trigrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all byte trigrams of whole texts, slice by slice of their bytes: one text after another, and where
    each text's begin in the slice. A text of one or two bytes has none."""
    data, bounds = buffer(texts)
    for a in range(0, max(0, len(data) - 2), SLICE):
        low = _LOWER[data[a : a + SLICE + 2]].astype(np.uint32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        whole = np.ones(len(code), bool)
        for back in (1, 2):
            at = bounds[1:-1] - back - a
            whole[at[(at >= 0) & (at < len(code))]] = False
        edges = np.append(0, np.cumsum(whole))[np.clip(bounds - a, 0, len(code))]
        yield ((code[whole] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), edges


def base_language(code: Column) -> Column:
    """A language code without region, script and case; null where nothing is left."""
    found = F.lower(F.regexp_extract(code, r"^\s*([^-_\s]+)", 1))
    return F.when(found != "", found)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    key, place = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    return key, np.bincount(place, np.concatenate([np.zeros(0), *counts]), len(key)).astype(np.int64)


def _trained(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: k for k, x in enumerate(languages)}
        keys, counts, held = [], [], 0
        for batch in small_batches(batches):
            which = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for found, edges in trigrams(text_column(batch)):
                key, n = np.unique(np.repeat(which, np.diff(edges)) << BITS | found, return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > HELD:  # only buckets that were seen, of languages that were seen
                    keys, counts = ([x] for x in _merged(keys, counts))
                    held = 0
        key, n = _merged(keys, counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(key >> BITS, pa.int32()), "bucket": pa.array(key & ((1 << BITS) - 1), pa.int32()), "n": pa.array(n, pa.int64())})

    return run


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (bucket x language, the unknown one last), from the rows of ``docs``
    (``doc_id``, ``text``, ``lang``) with a language: all languages, of each a bounded sample by a hash of the id.

    A language is known without its region and case (``en-GB`` is ``en``). More than LANGUAGES raise.
    """
    own = docs.select("doc_id", "text", base_language(F.col("lang")).alias("lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 2))
    languages = sorted(r.lang for r in own.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    total = np.zeros((1 << BITS, len(languages) + 1))
    if languages:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
        ids = own.select("doc_id", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE).drop("rank")
        # The sample of ids has a bound: languages times their texts.
        rows = own.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
        found = rows.mapInArrow(_trained(languages), "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        total[found["bucket"], found["lang"]] = found["n"]
    total[:, :-1] += 0.05
    total[:, -1] = 1
    return languages, np.log(total / total.sum(0)).astype(np.float32)


def likelihoods(rows: DataFrame, table: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``logs array<double>``, a text's tempered log likelihoods less their mean."""
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    shared = rows.sparkSession.sparkContext.broadcast(table)  # 2**BITS rows, LANGUAGES + 1 columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches, "_text"):
            n, sums = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, own.shape[1]))
            for found, edges in trigrams(text_column(batch, "_text")):
                here = np.flatnonzero(np.diff(edges))
                n += np.diff(edges)
                if len(here):
                    for a in range(0, own.shape[1], TOGETHER):
                        sums[here, a : a + TOGETHER] += np.add.reduceat(own[found, a : a + TOGETHER], edges[:-1][here], axis=0)
            sums *= np.minimum(1, INDEPENDENT / np.maximum(n, 1))[:, None]
            sums -= sums.mean(1, keepdims=True)
            logs = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, own.shape[1]), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), logs], [*keep, "logs"])

    fields = rows.select(*keep).schema.fields
    schema = StructType([*fields]).add("logs", ArrayType(DoubleType()))
    return rows.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _shares(logs: Column) -> Column:
    """Probabilities in proportion to the exponentials."""
    top = F.array_max(logs)
    exp = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(exp, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exp, lambda x: x / total)


def host_priors(rows: DataFrame, k: int) -> DataFrame:
    """``host, prior, by_domain, by_suffix``, arrays of doubles, from ``host`` and ``seen`` (a row's shares by its
    text alone): the smoothed shares of the host, of its domain and of its address suffix. Null is a host too."""
    sums = [F.sum(F.col("seen")[j]).alias(f"s{j}") for j in range(k)]
    again = [F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]
    hosts = stored(rows.groupBy("host").agg(*sums), "hosts")
    parts = F.split(F.coalesce("host", F.lit("")), r"\.")
    levels = hosts.withColumns({"domain": F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."), "suffix": F.element_at(parts, -1)})
    everything = levels.agg(*again).head()
    total = sum(everything[j] or 0.0 for j in range(k))
    start = [(1 - UNKNOWN_PRIOR) / max(1, k - 1)] * (k - 1) + [UNKNOWN_PRIOR]
    world = [((everything[j] or 0.0) + SMOOTHING * start[j]) / (total + SMOOTHING) for j in range(k)]

    def smoothed(df: DataFrame, parent: Column, name: str) -> DataFrame:
        n = F.aggregate(F.array(*[f"s{j}" for j in range(k)]), F.lit(0.0), lambda a, x: a + x)
        return df.withColumn("_n", n).withColumn(name, F.array(*[(F.col(f"s{j}") + SMOOTHING * parent[j]) / (F.col("_n") + SMOOTHING) for j in range(k)]))

    suffix = smoothed(levels.groupBy("suffix").agg(*again), F.array(*[F.lit(x) for x in world]), "by_suffix").select("suffix", "by_suffix")
    domain = levels.groupBy("suffix", "domain").agg(*again).join(suffix, "suffix")
    domain = smoothed(domain, F.col("by_suffix"), "by_domain").select("suffix", "domain", "by_domain", "by_suffix")
    return smoothed(levels.join(domain, ["suffix", "domain"]), F.col("by_domain"), "prior").select("host", "prior", "by_domain", "by_suffix")


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], host: Column, declared: Column | None = None, text: str = "text", least: float = 0.5, evidence: bool = False) -> DataFrame:
    """The columns ``keep`` with ``language``, ``probability`` and ``known`` of each row, and, if asked for, what each
    kind of ``evidence`` alone says: ``by_text, by_markup, by_suffix, by_domain, by_host`` (null where there is none).

    ``host`` and ``declared`` give a row's address host and the language its markup declares,
    null where it has none: then the host's prior is that of all such rows, and markup says
    nothing. ``known``: the language is one of the model's and its probability ``least`` or
    more. A null, empty or very short text has no likelihoods and is of the unknown language.
    Null ids and repeated rows are kept; an empty table gives an empty table.
    """
    languages, table = model
    names, k = [*languages, UNKNOWN], len(languages) + 1
    source = rows.withColumns({"_host": host, "_declared": F.lit(None).cast("string") if declared is None else base_language(declared)})
    kept = [f"_keep_{j}" for j in range(len(keep))]
    source = source.select(*[F.col(c).alias(a) for c, a in zip(keep, kept, strict=True)], "_host", "_declared", F.col(text).alias("_body"))
    found = stored(likelihoods(source, table, [*kept, "_host", "_declared"], "_body"), "language")
    start = [np.log((1 - UNKNOWN_PRIOR) / max(1, k - 1))] * (k - 1) + [np.log(UNKNOWN_PRIOR)]
    seen = _shares(F.zip_with("logs", F.array(*[F.lit(float(x)) for x in start]), lambda a, b: a + b))
    blank = F.array_max("logs") == F.array_min("logs") if languages else F.lit(True)
    told = found.withColumns({"seen": seen, "blank": blank})
    priors = host_priors(told.where(~F.col("blank")).select(F.col("_host").alias("host"), "seen"), k)
    known = F.when(F.col("_declared").isin(languages), F.col("_declared")).when(F.col("_declared").isNotNull(), UNKNOWN) if languages else F.lit(None).cast("string")
    told = told.withColumn("declared", known)
    logs, terms = F.col("logs"), F.lit(None).cast("array<double>")
    if declared is not None:
        # One row for a declared language: at most the model's languages and one more.
        sums = told.where(F.col("declared").isNotNull() & ~F.col("blank")).groupBy("declared").agg(*[F.sum(F.col("seen")[j]).alias(f"s{j}") for j in range(k)]).collect()
        counts = {r.declared: [r[f"s{j}"] for j in range(k)] for r in sums}
        totals = [sum(c[j] for c in counts.values()) for j in range(k)]
        terms = F.array(*[F.lit(0.0)] * k)
        for name in names:
            own = counts.get(name, [0.0] * k)
            terms = F.when(F.col("declared") == name, F.array(*[F.lit(float(np.log((own[j] + 1.0) / (totals[j] + k)))) for j in range(k)])).otherwise(terms)
        logs = F.zip_with(logs, terms, lambda a, b: a + b)
    told = told.withColumns({"by_markup": F.when(F.col("declared").isNotNull(), terms)})
    joined = told.join(priors.withColumnRenamed("host", "_h"), F.col("_host").eqNullSafe(F.col("_h")), "left")
    prior = F.coalesce("prior", F.array(*[F.lit(float(np.exp(x))) for x in start]))
    shares = _shares(F.zip_with(logs, prior, lambda a, p: a + F.ln(F.greatest(p, F.lit(FLOOR / 10)))))
    out = joined.withColumn("shares", shares).withColumn("probability", F.array_max("shares"))
    best = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("shares", F.col("probability")).cast("int"))
    out = out.withColumn("language", F.when(F.col("blank"), UNKNOWN).otherwise(best)).withColumn("probability", F.when(F.col("blank"), 1.0).otherwise(F.col("probability")))
    is_known = (F.col("language") != UNKNOWN) & (F.col("probability") >= least)
    each = {"by_text": F.when(~F.col("blank"), F.col("seen")), "by_markup": F.col("by_markup"), "by_suffix": F.col("by_suffix"), "by_domain": F.col("by_domain"), "by_host": F.col("prior")}
    top = [F.when(x.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(x, F.array_max(x)).cast("int"))).alias(c) for c, x in each.items()]
    return out.select(*[F.col(a).alias(c) for c, a in zip(keep, kept, strict=True)], "language", "probability", is_known.alias("known"), *(top if evidence else []))


def address_host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def markup_language(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1)
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """Text without comments, scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")
