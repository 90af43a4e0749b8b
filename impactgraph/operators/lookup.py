"""The shapes of lookup that name resolution and attribution need, as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import last_part, prefixes


def longest_prefix(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """names with known(prefix)'s longest dotted prefix of each name, and the rest; null where none is known."""
    each = names.select(name).distinct().select(name, F.explode(prefixes(F.split(name, "[.]"))).alias("prefix"))
    best = each.join(known.select("prefix").distinct(), "prefix").groupBy(name).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    rest = F.when(F.length(name) > F.length("prefix"), F.expr(f"substring({name}, length(prefix) + 2)"))
    return names.join(best, name, "left").withColumn("rest", rest)


def first_rule(candidates: DataFrame, site: list[str]) -> DataFrame:
    """Of candidates(site..., prio, target), all of the first rule that gave any; a null target stops with nothing."""
    w = Window.partitionBy(*site).orderBy("prio")
    return candidates.withColumn("__r", F.rank().over(w)).where("__r = 1 and target is not null").drop("__r")


def bare_keys(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(name, key) of names(name) and all of keys(key), as file:function, whose function's last dotted part is the name.

    Keys without a colon have no such name; names that no key has give no row. One row a match, so
    a name that many keys have is not gathered.
    """
    told = keys.where(F.col("key").contains(":")).select(last_part(F.substring_index("key", ":", -1)).alias("name"), "key").distinct()
    return told.join(names.select("name").distinct(), "name", "left_semi").select("name", "key")


def capped(matches: DataFrame, site: list[str], cap: int = 8) -> DataFrame:
    """Matches of sites that have at most cap of them."""
    w = Window.partitionBy(*site)
    return matches.withColumn("__n", F.count("*").over(w)).where(F.col("__n") <= cap).drop("__n")


def attribute_lines(lines: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """lines(keys, line) to the id of the span(keys, id, start, end) that holds each, the outermost first.

    Spans without an end hold what follows their start, if no ended span holds the line; of those
    the last to start counts. Ended spans join by key with the range as a filter, open ones by one
    sort.
    """
    asked = lines.select(*keys, "line").distinct()
    met = asked.join(spans.where("end is not null"), keys).where("start <= line and line <= end")
    held = merge_best(met, [*keys, "line"], [F.col("start"), F.col("id")]).select(*keys, "line", "id")
    starts = spans.where("end is null").groupBy(*keys, F.col("start").alias("line")).agg(F.min("id").alias("id"))
    rest = nearest_preceding(asked.join(held, [*keys, "line"], "left_anti").select(*keys, "line"), starts, keys, "line", "id")
    return held.unionByName(rest.where("last_id is not null").select(*keys, "line", F.col("last_id").alias("id")))


def nearest_preceding(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """left with the value of right's last row at or before left's order, by one sort of the union."""
    both = left.withColumn("__side", F.lit(1)).unionByName(right.select(*keys, order, F.col(value).alias(f"__{value}")).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(f"last_{value}", F.last(f"__{value}", ignorenulls=True).over(w))
    return found.where("__side = 1").select(*left.columns, f"last_{value}")


def exports(own: DataFrame, imported: DataFrame, listed: DataFrame) -> DataFrame:
    """(module, name, target): with an explicit list(module, name) its names, imports first; else all, own names first."""
    explicit = listed.select("module").distinct().withColumn("__all", F.lit(True))
    rows = own.select("module", "name", "target", F.lit(0).alias("from_import")).unionByName(imported.select("module", "name", "target", F.lit(1).alias("from_import")))
    rows = rows.join(explicit, "module", "left")
    chosen = rows.join(listed.select("module", "name", F.lit(True).alias("__named")), ["module", "name"], "left").where("__all is null or __named")
    prio = F.when(F.col("__all"), 1 - F.col("from_import")).otherwise(F.col("from_import"))
    return merge_best(chosen.withColumn("__prio", prio), ["module", "name"], [F.col("__prio"), F.col("target")]).select("module", "name", "target")


def accessible(pairs: DataFrame, imports: DataFrame) -> DataFrame:
    """pairs(file, module, target) whose target shares the caller's root package or is imported; files without imports reach all."""
    root = lambda c: F.element_at(F.split(c, "[.]"), 1)
    roots = imports.select("file", F.explode(F.array(F.col("local_name"), root(F.col("fqn")))).alias("__root")).distinct()
    files = imports.select("file").distinct().withColumn("__any", F.lit(True))
    met = pairs.withColumn("__root", root(F.col("target"))).join(files, "file", "left").join(roots.withColumn("__has", F.lit(True)), ["file", "__root"], "left")
    return met.where(F.col("__any").isNull() | F.col("__has") | (F.col("__root") == root(F.col("module")))).select(*pairs.columns)


def without_overridden(found: DataFrame, ancestors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """found(keys..., owner, target) without owners that a descendant among the same keys' owners overrides; ancestors(cls, ancestor)."""
    keys = keys or ["cls"]
    other = found.select(*keys, F.col("owner").alias("__below"))
    over = other.join(ancestors.select(F.col("cls").alias("__below"), F.col("ancestor").alias("owner")), "__below").where("owner != __below").select(*keys, "owner").distinct()
    return found.join(over, [*keys, "owner"], "left_anti")


def merge_best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the least by order (a number is turned round by its sign), then by the other columns.

    Rows are reduced where they are before any moves. Maps cannot be compared, so rows may not hold any.
    """
    rest = [c for c in rows.columns if c not in keys]
    ranked = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], *rest)
    best = rows.groupBy(*keys).agg(F.min(ranked).alias("__best"))
    return best.select(*[F.col(c) if c in keys else F.col("__best").getField(c).alias(c) for c in rows.columns])
