"""Quality rules with verdicts on hosts.

Each document is measured and held against rules; failures are added up by
host (the ``source`` column). A host's rate of failure under a rule is shrunk
towards the other hosts with a beta prior fitted to their rates by moments, so
a host with few documents isn't judged on them alone. A host is rejected, with
all its documents, when a shrunk rate lies more than ``spread`` standard
deviations of that prior above its mean and above ``floor``; hosts that are
alike keep theirs. A document also goes if it breaks a rule itself.

All of it is built-in expressions. Words in repeated windows are found in the
row: the windows' hashes are compared, and only texts with a repeat have their
windows sorted with their positions. Measures are written once and read for
the hosts' sums and for the verdicts, as the texts are read only once.

Defined cases: a null or empty text has no words and fails for it; a null
source is a host of its own; a single host has no others to be judged by and
isn't; repeated rows are judged alike, and a rate at a limit passes; a very
long text is measured whole, in arrays of its own row; an empty table gives an
empty result; further columns stay in ``kept_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, stored

#: Words in a window that counts as repeated.
WINDOW = 5
BLANKS = " \t\n\x0b\x0c\r"

#: A host goes when its shrunk rate is above FLOOR and more than SPREAD standard deviations above the mean.
FLOOR, SPREAD = 0.3, 4.0

#: name -> whether a measured document fails.
RULES: dict[str, str] = {
    "base": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 40 * n_lines",
    "shouting": "10 * n_capitals > 3 * word_chars OR 10 * n_exclaims > 3 * n_words",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims"]


def _only(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in the regex class ``chars``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc, source, q) for each row: all its columns as a struct, its host, and the measures as a struct."""
    docs = docs.select(F.struct("*").alias("doc"), "text", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = docs.withColumns({"words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP)), "lines": lines})
    window = lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)])
    rows = rows.withColumn("hashes", F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    # (hash, position) in order, for the texts that have a repeat
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn("pairs", F.when(repeats, pairs))
    same = lambda p, k, step: F.coalesce(F.get(F.col("pairs"), k + step)["h"] == p["h"], F.lit(False))
    twice = F.filter("pairs", lambda p, k: same(p, k, 1) | ((k > 0) & same(p, k, -1)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda p: p["i"])))
    covered = F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), k + 1) - s, F.lit(WINDOW))))
    measures = {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": _only(text, r"#*$%&|<>"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_capitals": _only(text, "A-Z"),
        "n_exclaims": _only(text, "!"),
    }
    return rows.select("doc", "source", F.struct(*[c.alias(k) for k, c in measures.items()]).alias("q"))


def host_rates(judged: DataFrame, floor: float = FLOOR, spread: float = SPREAD) -> DataFrame:
    """(source, host_rate, host_rejected): the highest of a host's shrunk failure rates, and its verdict.

    ``judged`` has source and a Boolean fail_<rule> for each rule. For each
    rule and host the prior's mean and strength follow from the mean m and
    variance v of the other hosts' rates: strength m(1-m)/v - 1, at least 1 and
    at most the mean number of their documents, which bounds how well rates are known.
    """
    sums = judged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"fail_{r}").alias(r) for r in RULES])
    rate = {r: F.col(r) / F.col("n") for r in RULES}
    moments = sums.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("all_n"), *[F.sum(rate[r] ** p).alias(f"s{p}_{r}") for r in RULES for p in (1, 2)])
    # the one row of moments goes to every host
    both = sums.crossJoin(F.broadcast(moments)).withColumn("others", F.nullif(F.col("hosts") - 1, F.lit(0)))
    documents = (F.col("all_n") - F.col("n")) / F.col("others")

    def judgement(r: str) -> Column:
        m = F.greatest(F.lit(0.0), (F.col(f"s1_{r}") - rate[r]) / F.col("others"))
        v = (F.col(f"s2_{r}") - rate[r] * rate[r]) / F.col("others") - m * m
        s = F.when(v > 1e-12, F.greatest(F.lit(1.0), F.least(documents, m * (1 - m) / v - 1))).otherwise(documents)
        limit = F.greatest(F.lit(floor), m + spread * F.sqrt(F.greatest(F.lit(0.0), m * (1 - m)) / (s + 1)))
        shrunk = (F.col(r) + m * s) / (F.col("n") + s)
        return F.struct(shrunk.alias("rate"), F.coalesce(shrunk > limit, F.lit(False)).alias("rejected"))

    each = both.select("source", *[judgement(r).alias(r) for r in RULES])
    return each.select("source", F.greatest(*[F.col(r)["rate"] for r in RULES]).alias("host_rate"), F.greatest(*[F.col(r)["rejected"] for r in RULES]).alias("host_rejected"))


def judge(rows: DataFrame, floor: float, spread: float) -> DataFrame:
    """Measured rows (as stored) with fail_<rule>, host_rate, host_rejected and kept."""
    failed = rows.withColumns({f"fail_{r}": F.expr(rule) for r, rule in RULES.items()})
    hosts = host_rates(failed, floor, spread).withColumnRenamed("source", "host")
    any_own = F.greatest(*[F.col(f"fail_{r}") for r in RULES])
    return failed.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left").drop("host").withColumn("kept", ~any_own & ~F.col("host_rejected"))


def quality_report(docs: DataFrame, floor: float = FLOOR, spread: float = SPREAD) -> DataFrame:
    """For each document its measures, base_failed, kept and host_rejected."""
    rows = measured(docs.select("doc_id", "text", "source")).select(F.col("doc.doc_id").cast("long").alias("doc_id"), "source", "q.*")
    return judge(stored(rows), floor, spread).select("doc_id", *MEASURES[:5], F.col("fail_base").alias("base_failed"), "kept", "host_rejected")


def kept_documents(docs: DataFrame, floor: float = FLOOR, spread: float = SPREAD) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    out = judge(stored(measured(docs)).select("doc", "source", "q.*"), floor, spread)
    return out.where("kept").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


#: DuckDB SQL for ``quality_report`` over ``{documents}``.
SQL = r"""
WITH q_d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM {documents}),
q_win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM q_d WHERE len(ws) >= 5)),
q_rep AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS gap
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM q_win) WHERE c > 1),
q_cov AS (SELECT doc_id, sum(least(5, coalesce(gap, 5))) AS n FROM q_rep GROUP BY doc_id),
q_m AS (
  SELECT d.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS n_lines,
         length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims
  FROM q_d d LEFT JOIN q_cov c ON d.doc_id = c.doc_id),
q_f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS f1, 10 * n_symbols > n_words AS f2,
         100 * n_dup_lines > 40 * n_lines AS f3, 10 * n_capitals > 3 * word_chars OR 10 * n_exclaims > 3 * n_words AS f4
  FROM q_m),
q_long AS (
  SELECT source, r, avg(CAST(f AS INTEGER)) AS rate, count(*) AS n, CAST(sum(CAST(f AS INTEGER)) AS DOUBLE) AS k
  FROM (SELECT source, 1 AS r, f1 AS f FROM q_f UNION ALL SELECT source, 2, f2 FROM q_f
        UNION ALL SELECT source, 3, f3 FROM q_f UNION ALL SELECT source, 4, f4 FROM q_f)
  GROUP BY source, r),
q_sum AS (SELECT r, count(*) AS h, sum(n) AS an, sum(rate) AS s1, sum(rate * rate) AS s2 FROM q_long GROUP BY r),
q_m1 AS (
  SELECT source, l.r, k, n, rate, nullif(h - 1, 0) AS o, (an - n) / nullif(h - 1, 0) AS dn,
         greatest(0.0, (s1 - rate) / nullif(h - 1, 0)) AS m, s2 FROM q_long l JOIN q_sum USING (r)),
q_m2 AS (SELECT *, (s2 - rate * rate) / o - m * m AS v FROM q_m1),
q_prior AS (SELECT *, CASE WHEN v > 1e-12 THEN greatest(1.0, least(dn, m * (1 - m) / v - 1)) ELSE dn END AS s FROM q_m2),
q_host AS (
  SELECT source, bool_or(coalesce((k + m * s) / (n + s) > greatest({floor}, m + {spread} * sqrt(greatest(0.0, m * (1 - m)) / (s + 1))), false)) AS host_rejected
  FROM q_prior WHERE o IS NOT NULL GROUP BY source)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed,
       NOT (f1 OR f2 OR f3 OR f4) AND NOT coalesce(host_rejected, false) AS kept, coalesce(host_rejected, false) AS host_rejected
FROM q_f f LEFT JOIN q_host h ON f.source IS NOT DISTINCT FROM h.source
"""
