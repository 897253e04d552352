"""Quality rules whose limits come from the data: mergeable quantile sketches per language and source.

1. One pass over the texts gives a few counts per document.
2. Every count is turned into integer rates; a rate falls into a log-linear bucket (16 buckets per
   doubling, so the value is known to 1/16). A sketch is the bucket histogram of one group, and
   sketches merge by adding counts: partial aggregation does it before the shuffle, and adding the
   sketches of all sources of a language, or of all languages, gives the coarser groups.
3. Limits are quartile fences of the sketch of (lang, source); a group with too few documents takes
   the sketch of its language, and then the one of everything.
4. Documents join the limits of their group and are judged.

The fences are ``q3 + reach * max(q3 - q1, spread)`` and ``q1 - reach * max(q3 - q1, spread)``. The least
``spread`` of a rate is what keeps ordinary documents when a group is uniform.

Cases: a null or empty text has no words, fails the base rule and is never kept. Null languages and
sources are groups of their own. Repeated rows are judged row by row. An empty table gives no rows.
Columns of the input other than those named here do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.llm.cells import SPACE, Texts, owner, per_text, repeated, slices, windows
from clickloom.operators.layout import lookup
from clickloom.session import broadcast_if_small, scratch_path

SYMBOLS = np.isin(np.arange(256), [*b"#*$%&|<>"])
BANGS = np.isin(np.arange(256), [*b"!?"])
UPPER = np.isin(np.arange(256), [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]
MIN_WORDS = 50
MIN_GROUP = 200
REACH = 3
#: Rate: (least spread, sides judged). Rates are per 1,000 words but for the word length, in 1/100 characters.
RATES = {
    "symbols": (30, "high"),
    "bangs": (30, "high"),
    "upper": (250, "high"),
    "dup_lines": (150, "high"),
    "repeats": (100, "high"),
    "length": (60, "both"),
}
_SUB = 4  # 16 buckets per doubling


def counts_of(texts: Texts) -> dict[str, np.ndarray]:
    start, end, ptr = texts.runs(~SPACE)
    h = texts.hashes(start, end)
    heads = (texts.raw & 0xC0) != 0x80
    in_word = ~SPACE[texts.raw]
    doc = owner(ptr)
    three, first = windows(h, ptr, 3)
    again, _ = repeated(three, doc[first])
    covered = np.zeros(len(h) + 1, np.int64)
    hit = first[again]
    np.add.at(covered, hit, 1)
    np.add.at(covered, np.minimum(hit + 3, len(h)), -1)
    lines, line_end, line_ptr = texts.runs(np.arange(256) != 10)
    words_before = np.searchsorted(start, np.stack([lines, line_end])) if len(lines) else np.zeros((2, 0), int)
    worded = words_before[1] > words_before[0]
    line_doc = owner(line_ptr)
    later = np.zeros(len(lines), bool)
    later[worded] = repeated(texts.hashes(lines, line_end)[worded], line_doc[worded])[1]
    n_lines = np.bincount(line_doc[worded], minlength=texts.n)
    return {
        "n_words": np.diff(ptr),
        "word_chars": texts.sums(heads & in_word),
        "n_symbols": texts.count(SYMBOLS),
        "n_dup_lines": per_text(later, line_ptr),
        "n_repeat_words": per_text(np.cumsum(covered)[: len(h)] > 0, ptr),
        "n_lines": n_lines,
        "n_upper": texts.count(UPPER),
        "n_bangs": texts.count(BANGS),
    }


#: A slice of a counting pass: its arrays take some forty bytes a byte of text.
COUNT_BYTES = 1 << 20


def text_counts(docs: DataFrame, keys: list[str], text: str = "text", within: str | None = None) -> DataFrame:
    """Counts of every text beside its key columns; one pass, no shuffle.

    With ``within`` the text is that field of this key, a struct, and goes to the workers once only.
    """

    def run(batches):
        for batch in batches:
            if within:
                batch = batch.append_column(text, pc.struct_field(batch.column(within), text))
            for part in slices(batch, text, COUNT_BYTES):
                found = counts_of(Texts(part.column(text)))
                columns = [part.column(k) for k in keys] + [pa.array(found[c].astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *COUNTS])

    kinds = dict(docs.select(*keys).dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} bigint" for c in COUNTS)])
    return docs.select(*keys, *([] if within else [text])).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_rates(counts: DataFrame) -> DataFrame:
    per = lambda c, k: F.expr(f"({k} * {c}) div greatest(n_words, 1)")
    return counts.withColumns(
        {
            "symbols": per("n_symbols", 1000),
            "bangs": per("n_bangs", 1000),
            "upper": per("n_upper", 1000),
            "dup_lines": F.expr("(1000 * n_dup_lines) div greatest(n_lines, 1)"),
            "repeats": per("n_repeat_words", 1000),
            "length": per("word_chars", 100),
            "base_failed": base_failed(),
        }
    )


def bucket(value: str) -> str:
    """Log-linear bucket number of a non-negative integer, in exact integer arithmetic."""
    fine = 1 << _SUB
    shift = f"(length(conv({value}, 10, 2)) - {_SUB + 1})"
    return f"CASE WHEN {value} < {2 * fine} THEN {value} ELSE {shift} * {fine} + shiftright({value}, {shift}) END"


def bucket_floor(b: str) -> str:
    """Smallest value of a bucket."""
    fine = 1 << _SUB
    return f"CASE WHEN {b} < {2 * fine} THEN {b} ELSE shiftleft({b} % {fine} + {fine}, CAST({b} div {fine} - 1 AS INT)) END"


def sketches(rated: DataFrame) -> DataFrame:
    """Bucket counts per (level, lang, source, rate): level 0 has both, 1 the language, 2 everything."""
    pairs = ", ".join(f"'{r}', {bucket(f'`{r}`')}" for r in RATES)
    # base failures say nothing about ordinary documents of the group
    fine = (
        rated.filter(~F.col("base_failed"))
        .select("lang", "source", F.expr(f"stack({len(RATES)}, {pairs}) AS (rate, b)"))
        .groupBy("lang", "source", "rate", "b")
        .agg(F.count("*").alias("c"))
    )
    none = F.lit(None).cast("string")
    mid = fine.groupBy("lang", "rate", "b").agg(F.sum("c").alias("c"))
    top = mid.groupBy("rate", "b").agg(F.sum("c").alias("c"))
    return (
        fine.select(F.lit(0).alias("level"), "lang", "source", "rate", "b", "c")
        .unionByName(mid.select(F.lit(1).alias("level"), "lang", none.alias("source"), "rate", "b", "c"))
        .unionByName(top.select(F.lit(2).alias("level"), none.alias("lang"), none.alias("source"), "rate", "b", "c"))
    )


def limits(sketch: DataFrame, reach: int = REACH) -> DataFrame:
    """Quartile fences of each sketch: lo and hi per (level, lang, source), one column pair per rate."""
    group = ["level", "lang", "source", "rate"]
    # a group has at most some hundred buckets, whatever the number of documents
    run = Window.partitionBy(*group).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    ranked = sketch.withColumns({"up": F.sum("c").over(run), "n": F.sum("c").over(whole)})
    value = F.expr(bucket_floor("b"))
    quart = ranked.groupBy(*group).agg(
        F.max("n").alias("n"),
        F.min(F.when(4 * F.col("up") >= F.col("n"), value)).alias("q1"),
        F.min(F.when(4 * F.col("up") >= 3 * F.col("n"), value)).alias("q3"),
    )
    spread = F.create_map(*[x for r, (s, _) in RATES.items() for x in (F.lit(r), F.lit(s))])[F.col("rate")]
    width = reach * F.greatest(F.col("q3") - F.col("q1"), spread)
    fenced = quart.withColumns({"hi": F.col("q3") + width, "lo": F.col("q1") - width})
    cells = [F.max(F.when(F.col("rate") == r, F.col(s))).alias(f"{s}_{r}") for r in RATES for s in ("lo", "hi")]
    return fenced.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *cells)


def group_limits(rated: DataFrame, reach: int = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """Limits for each (lang, source) of the data, from the finest level with enough documents."""
    found = limits(sketches(rated), reach)
    groups = rated.groupBy("lang", "source").agg(F.count("*").alias("_all"))
    cells = [c for c in found.columns if c[:3] in ("lo_", "hi_")]
    named = lambda level, tag: found.filter(F.col("level") == level).select(
        *(F.col(k).alias(f"_{k}") for k in ("lang", "source")), F.col("n").alias(f"n{tag}"), *(F.col(c).alias(f"{c}{tag}") for c in cells)
    )
    own, tongue, every = named(0, "_0"), named(1, "_1").drop("_source"), named(2, "_2").drop("_lang", "_source")
    out = groups.join(own, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    out = out.join(tongue, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    out = out.join(F.broadcast(every), F.lit(True), "left")  # one row
    level = F.when(F.col("n_0") >= min_group, 0).when(F.col("n_1") >= min_group, 1).otherwise(2)
    pick = [F.when(level == 0, F.col(f"{c}_0")).when(level == 1, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(c) for c in cells]
    return out.select("lang", "source", level.alias("level"), *pick)


def verdict() -> Column:
    ok = F.lit(True)
    for rate, (_, side) in RATES.items():
        ok &= F.coalesce(F.col(rate) <= F.col(f"hi_{rate}"), F.lit(True))
        if side == "both":
            ok &= F.coalesce(F.col(rate) >= F.col(f"lo_{rate}"), F.lit(True))
    return ~F.col("base_failed") & ok


def _named(docs: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))


def _coded(name: str) -> Column:
    """A text that is never null, different for null and for an empty text."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit(""))


def _limited(rated: DataFrame, bounds: DataFrame, salt_on: str) -> DataFrame:
    """Rows beside the limits of their group: by broadcast within a proven size, else with hot groups salted."""
    keyed = rated.withColumns({"_l": _coded("lang"), "_s": _coded("source")})
    hinted = broadcast_if_small(bounds, 100_000)
    if hinted is bounds:
        hot = keyed.groupBy("_l", "_s").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1_000_000).drop("_n")
        joined = lookup(keyed, bounds, ["_l", "_s"], hot, salt_on=salt_on)
    else:
        joined = keyed.join(hinted, ["_l", "_s"], "left")
    return joined.drop("_l", "_s")


def _measured(docs: DataFrame, reach: int, min_group: int) -> tuple[DataFrame, DataFrame]:
    """Rated counts of all documents (_key, lang, source, _text) and the limits of the groups, both written once."""
    spark = docs.sparkSession
    path = scratch_path(spark, "rule-counts")
    text_counts(docs, ["_key", "lang", "source"], "_text").write.parquet(path)
    rated = with_rates(spark.read.parquet(path))
    bounds_path = scratch_path(spark, "rule-limits")
    group_limits(rated, reach, min_group).withColumns({"lang": _coded("lang"), "source": _coded("source")}).write.parquet(bounds_path)
    return rated, spark.read.parquet(bounds_path).withColumnsRenamed({"lang": "_l", "source": "_s"})


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", reach: int = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts, rates, limits' level and verdict of every document.

    The counts are written once to the shared folder; sketches and verdicts read them from there.
    """
    rated, bounds = _measured(_named(docs, key, text, lang, source), reach, min_group)
    return _limited(rated, bounds, "_key").withColumn("kept", verdict()).withColumnRenamed("_key", key)


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", reach: int = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that pass, with all their columns.

    The limits come from a first pass; a second one counts again beside the whole rows, so texts are
    not shuffled to meet a verdict and repeated keys do not matter.
    """
    named = _named(docs, key, text, lang, source)
    _, bounds = _measured(named, reach, min_group)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(key).alias("_key"))
    judged = _limited(with_rates(text_counts(rows, ["_row", "lang", "source", "_key"], text, "_row")), bounds, "_key")
    return judged.filter(verdict()).select("_row.*")


def oracle(reach: int = REACH, min_group: int = MIN_GROUP) -> str:
    """DuckDB SQL for :func:`judge` on the table ``documents``: the same counts, sketches, fences and verdicts."""
    word = r"[^\x20\x09-\x0D]"
    b, lowest = "CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) END", "CASE WHEN b < 32 THEN b ELSE (b % 16 + 16) << (b // 16 - 1) END"
    rates = ", ".join(f"'{r}'" for r in RATES)
    spread = "CASE rate " + " ".join(f"WHEN '{r}' THEN {w}" for r, (w, _) in RATES.items()) + " END"
    ok = " AND ".join(f"(r.rate <> '{r}' OR (v <= hi{' AND v >= lo' if side == 'both' else ''}))" for r, (_, side) in RATES.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT rid, regexp_extract_all(text, '{word}+') AS ws FROM d)),
tri AS (
  SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL),
cover AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE c > 1) GROUP BY rid),
wc AS (SELECT rid, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY rid),
ln AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
    len(regexp_extract_all(text, '[!?]')) AS n_bangs FROM d),
m AS (
  SELECT d.rid, doc_id, lang, source, coalesce(wc.n, 0) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
    n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words,
    len(ls) AS n_lines, n_upper, n_bangs
  FROM d JOIN ln USING (rid) LEFT JOIN wc USING (rid) LEFT JOIN cover USING (rid)),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS k FROM m),
r AS (
  SELECT rid, lang, source, base_failed, unnest([{rates}]) AS rate,
    unnest([1000 * n_symbols // k, 1000 * n_bangs // k, 1000 * n_upper // k, 1000 * n_dup_lines // greatest(n_lines, 1),
      1000 * n_repeat_words // k, 100 * word_chars // k]) AS v FROM f),
sk AS (SELECT *, {b} AS b FROM r WHERE NOT base_failed),
lv AS (
  SELECT 0 AS level, lang, source, rate, b, count(*) AS c FROM sk GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, rate, b, count(*) FROM sk GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, rate, b, count(*) FROM sk GROUP BY ALL),
up AS (
  SELECT *, sum(c) OVER (PARTITION BY level, lang, source, rate ORDER BY b) AS u,
    sum(c) OVER (PARTITION BY level, lang, source, rate) AS n FROM lv),
q AS (
  SELECT level, lang, source, rate, max(n) AS n, min(CASE WHEN 4 * u >= n THEN {lowest} END) AS q1,
    min(CASE WHEN 4 * u >= 3 * n THEN {lowest} END) AS q3 FROM up GROUP BY ALL),
fence AS (
  SELECT level, lang, source, rate, n, q1 - {reach} * greatest(q3 - q1, {spread}) AS lo, q3 + {reach} * greatest(q3 - q1, {spread}) AS hi FROM q),
lim AS (
  SELECT r.rid, r.rate, r.v,
    CASE WHEN a.n >= {min_group} THEN a.lo WHEN t.n >= {min_group} THEN t.lo ELSE e.lo END AS lo,
    CASE WHEN a.n >= {min_group} THEN a.hi WHEN t.n >= {min_group} THEN t.hi ELSE e.hi END AS hi
  FROM r
  LEFT JOIN fence a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM r.lang AND a.source IS NOT DISTINCT FROM r.source AND a.rate = r.rate
  LEFT JOIN fence t ON t.level = 1 AND t.lang IS NOT DISTINCT FROM r.lang AND t.rate = r.rate
  LEFT JOIN fence e ON e.level = 2 AND e.rate = r.rate),
ver AS (SELECT rid, bool_and(coalesce({ok}, true)) AS good FROM lim r GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept
FROM f JOIN ver USING (rid)
"""
