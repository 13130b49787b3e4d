"""Quality rules with host verdicts (native).

Every document is measured by a few whole-text rules. The failures of the rules are counted by host,
the hosts' failure rates are shrunk towards an empirical beta prior (method of moments over the hosts),
and a host whose shrunk rate is above ``max_host_rate`` takes all its documents with it.

Only DataFrame expressions are used. Arrays live inside one row, and a host's rows are only ever counted,
so a host with a third of all documents costs no more than its share.

Defined cases: a null or blank text has no words and fails the rules; a null host is the host ''; repeated
rows count as often as they occur and are each returned; an empty table gives no rows; a text of any length is measured
whole; other columns, whatever their names, pass through the filter untouched, and quality_rules ignores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediastrata.llm.common import materialize, table, whole_row

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_RATE = 0.5
#: More bad hosts than this aren't broadcast, but for those with so large a share of all documents, of which there can't be many.
BROADCAST_HOSTS, HOT_SHARE = 100_000, 1e-4
#: Documents' worth of prior where the hosts' rates don't differ, so that the moments give none.
FLAT_STRENGTH = 10.0

_BLANKS = r"\x20\x09-\x0D"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and binds it to name in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(hashes: str) -> str:
    """SQL: how many words stand in windows found twice or more, from the array of word hashes."""
    n = WINDOW
    windows = f"transform(sequence(0, size({hashes}) - {n}), i -> xxhash64({', '.join(f'{hashes}[i + {k}]' for k in range(n))}))"
    again = "(k > 0 and q[k].h = q[k - 1].h) or (k < size(q) - 1 and q[k].h = q[k + 1].h)"
    starts = f"sort_array(transform(filter(sequence(0, size(q) - 1), k -> {again}), k -> q[k].i))"
    covered = f"aggregate(sequence(0, size(p) - 1), 0L, (a, k) -> a + if(k = size(p) - 1, {n}, least({n}, p[k + 1] - p[k])))"
    by_hash = "array_sort(transform(s, (x, i) -> struct(x as h, i as i)))"
    found = f"if(size(array_distinct(s)) = size(s), 0L, {_let(by_hash, 'q', _let(starts, 'p', covered))})"
    return f"if(size({hashes}) < {n}, 0L, {_let(windows, 's', found)})"


def measures_sql(text: str) -> str:
    """SQL: a struct of the rules' counts for one text column: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    split = rf"if(t = '', cast(array() as array<string>), split(t, r'[{_BLANKS}]+'))"
    trimmed = rf"regexp_replace(t, r'^[{_BLANKS}]+|[{_BLANKS}]+\z', '')"
    words = _let(trimmed, "t", split)
    lines = rf"filter(split(t, '\n'), x -> x rlike r'[^{_BLANKS}]')"
    counts = f"""struct(
        cast(size(w) as bigint) as n_words,
        cast(length(array_join(w, '')) as bigint) as word_chars,
        cast(regexp_count(t, r'[#*$%&|<>]') as bigint) as n_symbols,
        {_let(lines, "l", "cast(size(l) - size(array_distinct(l)) as bigint)")} as n_dup_lines,
        {_let("transform(w, x -> xxhash64(x))", "h", _repeat_words("h"))} as n_repeat_words)"""
    return _let(f"coalesce({text}, '')", "t", _let(words, "w", counts))


def measures(text: str) -> Column:
    return F.expr(measures_sql(text))


def fails(text: str) -> Column:
    """Whether one text fails the rules, as one expression that measures once wherever the optimizer puts it."""
    sql = measures_sql(text)
    return F.expr(_let(sql, "m", f"m.n_words < {MIN_WORDS} or 100 * m.n_repeat_words > {MAX_REPEAT_PERCENT} * m.n_words"))


def host_rates(rows: DataFrame, host: Column, failed: Column, weight: Column | None = None) -> DataFrame:
    """One row per host: n_docs, n_failed, and shrunk_rate = (n_failed + strength * mean) / (n_docs + strength).

    The beta prior has the mean and the variance that the hosts' own rates have. weight is how many
    documents a row stands for. The moments are one row, taken to the driver.
    """
    n = F.lit(1).cast("long") if weight is None else weight
    hosts = rows.groupBy(host.alias("host")).agg(F.sum(n).alias("n_docs"), F.sum(F.when(failed, n).otherwise(0)).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    strength = F.col("mean") * (1 - F.col("mean")) / F.nullif(F.col("var"), F.lit(0.0)) - 1
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).select("mean", F.when(strength > 0, strength).otherwise(FLAT_STRENGTH).alias("strength")).first()
    if prior["mean"] is None:  # no hosts
        return hosts.withColumn("shrunk_rate", F.lit(0.0))
    shrunk = (F.col("n_failed") + F.lit(prior["strength"]) * F.lit(prior["mean"])) / (F.col("n_docs") + F.lit(prior["strength"]))
    return hosts.withColumn("shrunk_rate", shrunk)


def host_verdicts(rows: DataFrame, host: Column, failed: Column, weight: Column | None = None, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, bad) of each host, as a written table; bad: its shrunk failure rate is above max_host_rate."""
    rates = host_rates(rows, host, failed, weight)
    return materialize(rates.select("host", "n_docs", (F.col("shrunk_rate") > max_host_rate).alias("bad")), "hosts")


def with_verdict(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """rows (host, failed, ...) with column kept: not failed, and not of a bad host.

    Up to BROADCAST_HOSTS bad hosts are broadcast, so that rows stay where they are. Of more, those that hold a HOT_SHARE of all documents
    or more still are (1 / HOT_SHARE at most); the others meet their rows in a join, in which rows of hot hosts, which match nothing there,
    are dealt out by what they hold and where they stood.
    """
    bad = hosts.where("bad")
    if bad.count() <= BROADCAST_HOSTS:
        found = F.broadcast(bad.select(F.col("host").alias("its"), F.lit(True).alias("is_bad")))  # broadcast: counted above
        joined = rows.join(found, F.col("host") == F.col("its"), "left")
        return joined.withColumn("kept", ~F.col("failed") & F.col("is_bad").isNull()).drop("its", "is_bad")
    total = hosts.agg(F.sum("n_docs")).first()[0]
    hot = hosts.where(F.col("n_docs") >= HOT_SHARE * total).select(F.col("host").alias("hot"), F.col("bad").alias("hot_bad"))
    rows = rows.join(F.broadcast(hot), F.col("host") == F.col("hot"), "left")  # broadcast: 1 / HOT_SHARE hosts at most
    own = F.xxhash64(F.spark_partition_id(), *[c for c, t in rows.dtypes if "map<" not in t])
    rows = rows.withColumn("salt", F.when(F.col("hot").isNotNull(), own.bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("bigint")))
    rest = bad.join(hot.select(F.col("hot").alias("host")), "host", "left_anti").select(F.col("host").alias("its"), F.lit(0).cast("bigint").alias("its_salt"))
    joined = rows.join(rest, (F.col("host") == F.col("its")) & (F.col("salt") == F.col("its_salt")), "left")
    is_bad = F.coalesce("hot_bad", F.col("its").isNotNull())
    return joined.withColumn("kept", ~F.col("failed") & ~is_bad).drop("its", "its_salt", "salt", "hot", "hot_bad")


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: its id, the measures, base_failed and kept."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _host(host_col).alias("host"), measures(f"`{text_col}`").alias("m"))
    failed = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))
    rows = materialize(rows.withColumn("failed", failed), "quality")
    out = with_verdict(rows, host_verdicts(rows, F.col("host"), F.col("failed")))
    return out.select(F.col("id").alias(id_col), "m.*", F.col("failed").alias("base_failed"), "kept")


def filter_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that quality_rules keeps, with the columns of docs.

    The texts are measured twice, once for the hosts' rates and once where they are kept, rather than written in between.
    """
    rows = docs.select(_host(host_col).alias("host"), fails(f"`{text_col}`").alias("failed"), whole_row(docs).alias("row"))
    counts = materialize(rows.groupBy("host", "failed").agg(F.count("*").alias("n")), "host-counts")
    hosts = host_verdicts(counts, F.col("host"), F.col("failed"), F.col("n"))
    return with_verdict(rows, hosts).where("kept").select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_SQL_MEASURES = r"""
d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM s WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
q AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
hosts AS (SELECT host, count(*) AS n_docs, count(*) FILTER (base_failed) AS n_failed FROM q GROUP BY host),
prior AS (SELECT avg(n_failed / n_docs) AS mean, var_pop(n_failed / n_docs) AS var FROM hosts),
strength AS (SELECT mean, CASE WHEN mean * (1 - mean) / nullif(var, 0) - 1 > 0 THEN mean * (1 - mean) / nullif(var, 0) - 1 ELSE 10 END AS strength FROM prior),
bad AS (SELECT host FROM hosts CROSS JOIN strength WHERE (n_failed + strength * mean) / (n_docs + strength) > 0.5)
"""

SQL = f"""WITH {_SQL_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host NOT IN (SELECT host FROM bad) AS kept FROM q"""
