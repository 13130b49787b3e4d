"""Signature policy, fingerprints, labels and mismatch reports of signed manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediastrata.sources.staging import written

DEFAULT_TTP_NAME = "Trusted Third Party"


def signature_policy(signatures: DataFrame, keys: list[str], ttp_key: str, valid: str = "valid", public_key: str = "public_key") -> DataFrame:
    """keys, n_signatures, all_valid, has_ttp, ok: every signature is valid and one is the trusted third party's. No row: no signature."""
    out = signatures.groupBy(*keys).agg(
        F.count("*").alias("n_signatures"),
        F.coalesce(F.bool_and(F.coalesce(F.col(valid), F.lit(False))), F.lit(False)).alias("all_valid"),
        F.coalesce(F.bool_or(F.col(public_key) == ttp_key), F.lit(False)).alias("has_ttp"),
    )
    return out.withColumn("ok", F.col("all_valid") & F.col("has_ttp"))


def authorship_fingerprint(authors: Column) -> Column:
    """SHA-256 (hex) of the authors' ids, names and roles, in their order and without separators."""
    parts = F.transform(authors, lambda a: F.concat(a["author_id"], a["name"], a["role"]))
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def derivative_fingerprint(clipper_id: Column) -> Column:
    """SHA-256 (hex) of a clipper's key, as text."""
    return F.sha2(clipper_id.cast("binary"), 256)


def signature_labels(signatures: DataFrame, authors: DataFrame, keys: list[str], ttp_key: str, ttp_name: str = DEFAULT_TTP_NAME) -> DataFrame:
    """Adds label: the third party's name, else the author of that key, else the display name, else 'Author Key'."""
    known = authors.groupBy(*keys, F.col("author_id").alias("public_key")).agg(F.min_by("name", "ord").alias("__author"))
    label = F.when(F.col("public_key") == ttp_key, F.coalesce("display_name", F.lit(ttp_name))).otherwise(F.coalesce("__author", "display_name", F.lit("Author Key")))
    return signatures.join(known, [*keys, "public_key"], "left").withColumn("label", label).drop("__author")


def ttp_display_name(signatures: DataFrame, authors: DataFrame, keys: list[str], ttp_key: str, default: str = DEFAULT_TTP_NAME) -> DataFrame:
    """keys and ttp_name: the display name beside the third party's key, else the only one that no author has, else the default."""
    named = signatures.where("display_name IS NOT NULL AND trim(display_name) <> ''")
    theirs = named.where(F.col("public_key") == ttp_key).groupBy(*keys).agg(F.min_by("display_name", "ord").alias("__own"))
    others = named.join(authors.select(*keys, F.col("name").alias("display_name")).distinct(), [*keys, "display_name"], "left_anti")
    only = others.groupBy(*keys).agg(F.countDistinct("display_name").alias("__n"), F.min("display_name").alias("__only"))
    rows = signatures.select(*keys).distinct().join(theirs, keys, "left").join(only, keys, "left")
    return rows.select(*keys, F.coalesce("__own", F.when(F.col("__n") == 1, F.col("__only")), F.lit(default)).alias("ttp_name"))


def name_list(rows: DataFrame, keys: list[str], name: str, order: str, as_col: str = "names") -> DataFrame:
    """Names in order, joined by ', '."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, name))), lambda x: x[name]), ", ").alias(as_col))


def mismatches(checks: Sequence[tuple[Column, str]]) -> Column:
    """The messages of the checks that fail (or are null), joined by '; '; empty: all hold."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in checks])), "; ")


def clean_name(name: Column) -> Column:
    """Trimmed; null if blank."""
    return F.nullif(F.trim(name), F.lit(""))


def work_id_tag(tags: Column, expected: str) -> Column:
    """The work id among lower-cased tags: of the expected key, else the work's, else the original work's."""
    lower = F.transform_keys(tags, lambda k, _: F.lower(k))
    return F.coalesce(*[F.try_element_at(lower, F.lit(f"smed.{k}")) for k in (expected, "work_id", "original_work_id")])


def ancestry(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, ancestor, depth) of chains of derivation: one row for each way up, whatever its length.

    Written tables that double the depth: paths of up to n steps, continued by those of exactly n. So neither cteRecursionLevelLimit nor
    cteRecursionRowLimit of spark.sql bounds the answer. A work that is its own ancestor is an error.
    """
    rows = edges.where(F.col(parent).isNotNull()).select(F.col(child).alias("child"), F.col(parent).alias("ancestor"), F.lit(1).cast("bigint").alias("depth"))
    found, steps = written(rows, "ancestry"), 1
    every, longest = found, found
    while True:
        n, looped = found.agg(F.count("*"), F.max(F.col("child") == F.col("ancestor"))).first()
        if looped:
            raise ValueError("a work is its own ancestor")
        if not n:
            return every
        further = longest.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("__next"))
        found = written(every.join(further, "ancestor").select("child", F.col("__next").alias("ancestor"), (F.col("depth") + steps).alias("depth")), "ancestry")
        every, steps = every.unionByName(found), 2 * steps
        longest = found.where(F.col("depth") == steps)


def chain_print(chain: DataFrame, keys: list[str], name: str, depth: str) -> DataFrame:
    """keys and chain: names from the root to the work itself, joined by ' -> '."""
    return chain.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(depth, name)), asc=False), lambda x: x[name].cast("string")), " -> ").alias("chain"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__r = 1").drop("__r")
