"""What a log of requests says of each endpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct errors that an endpoint keeps, and the kind of entries that aren't requests (fixed values).
ERRORS, NO_REQUEST = 5, "outline_candidate"


def sanitized(path: Column, origin: str = "") -> Column:
    """A request's path without origin, with the ids of users and the values of its query masked; an empty query goes, and so does the fragment
    of an address of another origin than the named one."""
    foreign = F.regexp_replace(F.regexp_replace(path, r"(?i)^https?://[^/?#]*", ""), r"#[\s\S]*$", "")
    local = F.when(path.rlike(r"(?i)^https?://"), F.when(foreign.startswith("/"), foreign).otherwise(F.concat(F.lit("/"), foreign))).otherwise(path)
    if origin:
        local = F.when(path.startswith(origin), F.substring(path, len(origin) + 1, 2**30)).otherwise(local)
    parts = F.split(local, r"\?")
    clean = F.regexp_replace(parts[0], r"(?i)/(users?)/\d+(?=/|$)", "/$1/{userId}")
    keys = F.filter(F.transform(F.split(F.get(parts, F.lit(1)), "&"), lambda kv: F.split(kv, "=")[0]), lambda k: k != "")
    query = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("=…"))), "&")
    return F.when(F.size(keys) > 0, F.concat(clean, F.lit("?"), query)).otherwise(clean)


def org_unit(path: Column) -> Column:
    """The course number in a path of the API, or of a course's content; null elsewhere."""
    of = lambda p: F.nullif(F.regexp_extract(path, p, 1), F.lit(""))
    return F.coalesce(of(r"/d2l/api/(?:le|lp)/[\d.]+/(\d+)/"), of(r"/d2l/le/content/(\d+)/")).try_cast("long")


def template(path: Column) -> Column:
    """A path with its version and numbers masked, so that repeated calls are one."""
    versioned = F.regexp_replace(path, r"^(.*?)/d2l/api/(le|lp)/[\d.]+/", "$1/d2l/api/$2/{v}/")
    return F.regexp_replace(versioned, r"/\d+(?=/|$|\?)", "/{id}")


def summary(entries: DataFrame, by: Sequence[str] = (), errors: int = ERRORS) -> DataFrame:
    """Per endpoint (and `by`): calls, items, bytes, statuses (a map from status to calls) and errors (the first distinct ones, in order).

    entries: ord, kind, path, status, items, bytes, error. Entries that aren't requests are left out; a null status counts as `none`, null
    sums as 0, an empty error as none; entries without a path are one endpoint, null.

    Statuses are counted, and errors brought down to the first time each was seen, before anything meets by endpoint; an endpoint gets
    `errors` rows of a partition and no more."""
    key = [*by, "endpoint"]
    calls = entries.filter(F.coalesce(F.col("kind") != NO_REQUEST, F.lit(True))).withColumn("endpoint", template(sanitized(F.col("path"))))
    by_status = calls.groupBy(*key, F.coalesce(F.col("status").cast("string"), F.lit("none")).alias("status")).agg(F.count("*").alias("calls"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    sums = by_status.groupBy(*key).agg(
        F.sum("calls").alias("calls"),
        F.sum("items").alias("items"),
        F.sum("bytes").alias("bytes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "calls")))).alias("statuses"),
    )
    seen = calls.filter("error <> ''").groupBy(*key, "error").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("ord", "error"))
    first = seen.withColumn("place", place).filter(F.col("place") <= errors).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "error"))).alias("e"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
    both = sums.join(first, same(sums, first), "left")
    return both.select(*(sums[k] for k in key), "calls", "items", "bytes", "statuses", F.coalesce(F.col("e.error"), F.array().cast("array<string>")).alias("errors"))
