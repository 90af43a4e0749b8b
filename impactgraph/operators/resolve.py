"""Name resolution as prioritised joins: imports to their definitions, classes to their ancestors, calls to symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import last_part
from ..shared import materialize
from .lookup import exports, first_rule, longest_prefix, merge_best, without_overridden
from .reach import chase

#: Rounds after which a loop that should long have settled raises.
MOST_ROUNDS = 1000


def first_part(name: Column | str) -> Column:
    return F.element_at(F.split(name, "[.]"), 1)


def rest_of(name: str) -> Column:
    """What follows the first dot of a dotted name; null without one."""
    return F.when(F.col(name).contains("."), F.expr(f"substring({name}, instr({name}, '.') + 1)"))


def files_of(modules: DataFrame) -> DataFrame:
    """(module, of_file): the first file by path answers for a module."""
    return modules.groupBy("module").agg(F.min("filepath").alias("of_file"))


def public_names(symbols: DataFrame) -> DataFrame:
    """(module, name, target) of public functions and classes of each module's top level."""
    own = symbols.where("visibility = 'public' and class_name is null and parent_id is null")
    return own.select("module", last_part(F.col("unique_id")).alias("name"), F.col("unique_id").alias("target"))


def offered_names(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, name, target) that modules have by import."""
    met = imports.join(files_of(modules), F.col("file") == F.col("of_file"))
    return met.select("module", F.col("local_name").alias("name"), F.col("fqn").alias("target")).where("not startswith(name, '__')")


def listed_names(meta: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, name) of modules with a list of their own."""
    return meta.where("all_names is not null").join(files_of(modules), F.col("file") == F.col("of_file")).select("module", F.explode("all_names").alias("name"))


def follow_aliases(names: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(fqn, to) for names(fqn) that lead elsewhere: module.local.rest goes to what the module imports as local.

    Each round follows names that are new; then chains are chased to their ends. A cycle stops at
    the first name met again, a name that would only grow by itself stays as it is.
    """
    known = modules.select(F.col("module").alias("prefix"))
    there = imports.join(files_of(modules), F.col("file") == F.col("of_file")).select(F.col("module").alias("prefix"), F.col("local_name").alias("head"), F.col("fqn").alias("further"))
    seen = frontier = names.select(F.col("fqn").alias("name")).distinct()
    links = None
    for _ in range(MOST_ROUNDS):
        split = longest_prefix(frontier, known).where("rest is not null").withColumn("head", first_part("rest"))
        tail = F.expr("substring(rest, length(head) + 1)")
        step = split.join(there, ["prefix", "head"]).select(F.col("name").alias("key"), F.concat("further", tail).alias("next"))
        step = materialize(step.where("key != next and not startswith(next, concat(key, '.'))"), "alias-links")
        links = step if links is None else links.unionByName(step)
        frontier = step.select(F.col("next").alias("name")).distinct().join(seen, "name", "left_anti")
        if frontier.isEmpty():
            return chase(links).select(F.col("key").alias("fqn"), F.col("root").alias("to")).where("fqn != to")
        frontier = materialize(frontier, "names")
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"aliases still grow after {MOST_ROUNDS} rounds")


def close_imports(imports: DataFrame, meta: DataFrame, modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, local_name, fqn) with wildcards expanded and aliases of aliases followed to their definition; cycles stop.

    Of several wildcards that offer a name at the same time the first in the file wins; a name that
    a file has already is not replaced. Every round adds names, so chains of any length are closed.
    """
    wild = meta.select("file", F.posexplode("wildcards").alias("place", "module"))
    own, listed = public_names(symbols), listed_names(meta, modules)
    now = imports
    if not wild.isEmpty():
        while True:
            offered = wild.join(exports(own, offered_names(now, modules), listed), "module").select("file", F.col("name").alias("local_name"), "place", F.col("target").alias("fqn"))
            new = offered.join(now, ["file", "local_name"], "left_anti")
            new = materialize(merge_best(new, ["file", "local_name"], [F.col("place"), F.col("fqn")]).select("file", "local_name", "fqn"), "wild")
            if new.isEmpty():
                break
            now = materialize(now.unionByName(new), "imports")
    ends = follow_aliases(now.select("fqn"), now, modules)
    return materialize(now.join(ends, "fqn", "left").select("file", "local_name", F.coalesce("to", "fqn").alias("fqn")), "closed")


def bare_matches(names: DataFrame, keys: list[str], imports: DataFrame, symbols: DataFrame, cap: int = 8) -> DataFrame:
    """names(keys..., file, module, name) with the symbols of that bare name that the file may reach; more than cap give none.

    A file reaches its own root package and those it imports; without any import, all. Symbols are
    counted by (name, root) first, so that only what can pass the cap is ever joined.
    """
    root = first_part("target")
    by_name = symbols.select(last_part(F.col("unique_id")).alias("name"), F.col("unique_id").alias("target")).withColumn("root", root)
    counts = by_name.groupBy("name", "root").agg(F.count("*").alias("n"))
    few = by_name.join(counts.where(F.col("n") <= cap), ["name", "root"], "left_semi")
    files = imports.select("file").distinct()
    roots = imports.select("file", F.explode(F.array(F.col("local_name"), first_part("fqn"))).alias("root")).distinct()
    some = names.join(files, "file", "left_semi")
    pairs = some.join(roots, "file").unionByName(some.withColumn("root", first_part("module"))).select(*keys, "name", "root").distinct()
    open_ = pairs.join(counts, ["name", "root"]).groupBy(*keys, "name").agg(F.sum("n").alias("n")).where(F.col("n") <= cap).select(*keys, "name")
    near = pairs.join(open_, [*keys, "name"], "left_semi").join(few, ["name", "root"]).select(*keys, "target")
    rare = counts.groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") <= cap).select("name")
    free = names.join(files, "file", "left_anti").join(rare, "name", "left_semi").join(few.drop("root"), "name").select(*keys, "target")
    return near.unionByName(free).distinct()


def resolve_names(names: DataFrame, imports: DataFrame, symbols: DataFrame, cap: int = 8) -> DataFrame:
    """names(file, module, name) with all targets of the first rule that gives any: an import, the module's own, a bare name."""
    key = ["file", "module", "name"]
    ids = symbols.select(F.col("unique_id").alias("target"))
    each = names.select(*key).distinct()
    away = each.withColumn("local_name", first_part("name")).join(imports, ["file", "local_name"]).select(*key, F.lit(0).alias("prio"), F.concat("fqn", F.expr("substring(name, length(local_name) + 1)")).alias("target"))
    own = each.withColumn("target", F.concat_ws(".", "module", "name")).join(ids, "target", "left_semi").select(*key, F.lit(1).alias("prio"), "target")
    met = first_rule(away.unionByName(own), key).select(*key, "target")
    asked = each.join(met, key, "left_anti").withColumn("whole", F.col("name")).withColumn("name", last_part(F.col("name")))
    bare = bare_matches(asked, ["file", "module", "whole"], imports, symbols, cap).select("file", "module", F.col("whole").alias("name"), "target")
    return met.unionByName(bare).join(ids, "target", "left_semi")


def base_links(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(cls, base, pos) of known base classes; of several candidates the first by name."""
    each = symbols.where("kind = 'class'").select(F.col("unique_id").alias("cls"), F.col("filepath").alias("file"), "module", F.posexplode("bases").alias("pos", "name"))
    classes = symbols.where("kind = 'class'").select(F.col("unique_id").alias("target"))
    met = resolve_names(each, imports, symbols).join(classes, "target", "left_semi").groupBy("file", "module", "name").agg(F.min("target").alias("base"))
    return each.join(met, ["file", "module", "name"]).select("cls", "base", "pos")


def ancestors(bases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(cls, ancestor, depth) with each class as its own ancestor at depth 0; a level only holds what is new, so cycles stop."""
    level = symbols.where("kind = 'class'").select(F.col("unique_id").alias("cls"), F.col("unique_id").alias("ancestor"), F.lit(0).alias("depth"))
    out = level
    up = bases.select(F.col("cls").alias("ancestor"), "base").distinct()
    depth = 0
    while True:
        depth += 1
        further = level.join(up, "ancestor").select("cls", F.col("base").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        level = further.join(out, ["cls", "ancestor"], "left_anti")
        if level.isEmpty():
            return out
        level = materialize(level, "mro")
        out = out.unionByName(level)


def c3(cls: str, parents: dict[str, list[str]], known: dict[str, list[str]] | None = None) -> list[str]:
    """The C3 order of a class and its ancestors. A class met again below itself stands alone; where no head is free the first is taken."""
    known = {} if known is None else known
    if cls in known:
        return known[cls]
    known[cls] = [cls]
    above = parents.get(cls, [])
    rows = [*(c3(p, parents, known) for p in above), list(above)]
    out = [cls]
    while rows := [r for r in rows if r]:
        tails = {x for r in rows for x in r[1:]}
        pick = next((r[0] for r in rows if r[0] not in tails), rows[0][0])
        rows = [[x for x in r if x != pick] for r in rows]
        if pick not in out:
            out.append(pick)
    known[cls] = out
    return out


def linearize(bases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(cls, ancestor, pos): every class's ancestors in C3 order, itself at 0. A group is the lattice above one class."""
    import pandas as pd

    links = ancestors(bases, symbols).join(bases.select(F.col("cls").alias("ancestor"), "base", F.col("pos").alias("nth")), "ancestor", "left")

    def order(group: pd.DataFrame) -> pd.DataFrame:
        parents: dict[str, list[str]] = {}
        for r in group.sort_values(["ancestor", "nth"]).itertuples(index=False):
            if isinstance(r.base, str):
                parents.setdefault(r.ancestor, []).append(r.base)
        found = c3(group["cls"].iloc[0], parents)
        return pd.DataFrame({"cls": found[0], "ancestor": found, "pos": range(len(found))})

    return links.select("cls", "ancestor", "base", "nth").groupBy("cls").applyInPandas(order, "cls string, ancestor string, pos int")


def members_of(mro: DataFrame, symbols: DataFrame) -> DataFrame:
    """(cls, member, target): what a class answers by, methods and inner classes; nearer owners hide farther ones, equals all count."""
    own = symbols.where("class_name is not null and parent_id is null").select(F.concat_ws(".", "module", "class_name").alias("owner"), last_part(F.col("unique_id")).alias("member"), F.col("unique_id").alias("target"))
    met = mro.select("cls", F.col("ancestor").alias("owner")).join(own, "owner")
    return without_overridden(met, mro.select("cls", "ancestor"), ["cls", "member"]).select("cls", "member", "target")


def star_excludes(meta: DataFrame, modules: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, call): public and imported names of wildcard-imported modules that the module's own list leaves out."""
    listed = listed_names(meta, modules)
    with_list = meta.where("all_names is not null").join(files_of(modules), F.col("file") == F.col("of_file")).select("module")
    names = public_names(symbols).unionByName(offered_names(imports, modules)).select("module", "name").distinct()
    left_out = names.join(with_list, "module", "left_semi").join(listed, ["module", "name"], "left_anti")
    return meta.select("file", F.explode("wildcards").alias("module")).join(left_out, "module").select("file", F.col("name").alias("call")).distinct()


def enclosing_scopes(symbols: DataFrame) -> DataFrame:
    """(scope, around, climb): each nested function with every function around it, the nearest at 1."""
    up = symbols.where("parent_id is not null").select(F.col("unique_id").alias("scope"), F.col("parent_id").alias("around"))
    out = level = up.withColumn("climb", F.lit(1))
    climb = 1
    while True:
        climb += 1
        further = level.select("scope", F.col("around").alias("between")).join(up.withColumnRenamed("scope", "between"), "between").select("scope", "around", F.lit(climb).alias("climb"))
        level = further.join(out, ["scope", "around"], "left_anti")
        if level.isEmpty():
            return out
        level = materialize(level, "scopes")
        out = out.unionByName(level)


def lexical_scopes(symbols: DataFrame, plain: DataFrame, around: DataFrame) -> DataFrame:
    """(caller, call, climb, target, certainty) for plain(caller, module, call): what a function, or one around it, defines; around is enclosing_scopes.

    Names declared global go to the module and climb no further; those declared nonlocal start at
    the parent. What the caller itself defines is surer than what is around it.
    """
    said = symbols.where("size(globals) > 0 or size(nonlocals) > 0").select(F.col("unique_id").alias("caller"), "globals", "nonlocals")
    asked = plain.join(said, "caller", "left").withColumn("global", F.coalesce(F.array_contains("globals", F.col("call")), F.lit(False)))
    asked = asked.withColumn("skip", F.coalesce(F.array_contains("nonlocals", F.col("call")), F.lit(False)))
    of_module = symbols.select(F.col("unique_id").alias("target"))
    told = asked.where("global").withColumn("target", F.concat_ws(".", "module", "call")).join(of_module, "target", "left_semi")
    told = told.select("caller", "call", F.lit(0).alias("climb"), "target", F.lit(0.95).alias("certainty"))
    nested = symbols.where("parent_id is not null").select(F.col("parent_id").alias("around"), last_part(F.col("unique_id")).alias("call"), F.col("unique_id").alias("target"))
    inner = asked.where("not global")
    own = inner.where("not skip").withColumn("around", F.col("caller")).join(nested, ["around", "call"]).select("caller", "call", F.lit(0).alias("climb"), "target", F.lit(0.98).alias("certainty"))
    wider = inner.join(around.withColumnRenamed("scope", "caller"), "caller").join(nested, ["around", "call"]).select("caller", "call", "climb", "target", F.lit(0.95).alias("certainty"))
    return told.unionByName(own).unionByName(wider)


# What a queued task is called by.
TASK_SUFFIXES = ["delay", "apply_async", "apply", "signature", "s", "si"]


def call_sites(symbols: DataFrame) -> DataFrame:
    """(caller, ord, call): every call that is not dynamic."""
    sites = symbols.where("kind in ('function', 'method')").select(F.col("unique_id").alias("caller"), F.posexplode("calls").alias("ord", "call"))
    return sites.where(~F.col("call").startswith("dynamic:"))


def asked_names(symbols: DataFrame, sites: DataFrame) -> DataFrame:
    """Each distinct (caller, call) with its context, and all names that its answer needs.

    A call on a local variable needs the variable's type, a call with a task suffix what stands
    before it; those are asked for under the same caller, and so on until nothing is new.
    """
    who = symbols.where("kind in ('function', 'method')").select(F.col("unique_id").alias("caller"), F.col("filepath").alias("file"), "module", F.when(F.col("class_name").isNotNull(), F.concat_ws(".", "module", "class_name")).alias("cls"), "local_types")
    base = F.expr("substring(call, 1, length(call) - length(substring_index(call, '.', -1)) - 1)")

    def described(asks: DataFrame) -> DataFrame:
        rest = rest_of("call")
        told = asks.withColumn("head", first_part("call")).withColumn("rest", rest).withColumn("type", F.when(rest.isNotNull(), F.try_element_at("local_types", F.col("head"))))
        return told.withColumn("before", F.when(rest.isNotNull() & last_part(F.col("call")).isin(TASK_SUFFIXES), base))

    out = new = described(sites.select("caller", "call").distinct().join(who, "caller"))
    for _ in range(MOST_ROUNDS):
        needs = new.withColumn("call", F.explode(F.array_compact(F.array("type", "before")))).dropDuplicates(["caller", "call"])
        new = described(needs.drop("head", "rest", "type", "before").join(out.select("caller", "call"), ["caller", "call"], "left_anti"))
        if new.isEmpty():
            return out.drop("local_types")
        new = materialize(new, "asks")
        out = out.unionByName(new)
    raise RuntimeError(f"types still lead on after {MOST_ROUNDS} rounds")


def resolve_calls(symbols: DataFrame, imports: DataFrame, cap: int = 8, excludes: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """(src, dst, certainty, ord): each call's symbols by the first rule that fires; targets must be known symbols.

    A call that ends in a task suffix goes to what its base resolves to, if anything: to those
    decorated as tasks (0.95), or to all where none is (0.90). A call on a local variable goes to
    the members of the variable's type, which is resolved like a call; types that lead back to
    themselves give nothing. excludes(file, call) stops plain names from being looked up by their
    bare name; with modules, targets are followed through what modules import under a name.
    """
    sites = call_sites(symbols)
    asks = materialize(asked_names(symbols, sites), "asked")
    bases = materialize(base_links(symbols, imports), "bases")
    members = materialize(members_of(ancestors(bases, symbols), symbols), "members")
    around = enclosing_scopes(symbols)
    key = ["caller", "call"]

    def direct(rows: DataFrame) -> DataFrame:
        return materialize(_cascade(rows, symbols, imports, bases, members, around, cap, excludes, modules), "found")

    now = asks.where("type is null and before is null")
    found, done = direct(now), now.select(*key)
    waiting = asks.where("type is not null or before is not null")
    has_tasks = not asks.where("before is not null").isEmpty()
    tags = symbols.select(F.col("unique_id").alias("target"), F.exists(F.coalesce("decorators", F.array()), lambda d: F.lower(d).contains("task")).alias("tagged"))
    while not waiting.isEmpty():
        new, ready, open_ = [], [], waiting
        if has_tasks:
            known = done.select("caller", F.col("call").alias("before"))
            queued = waiting.select(*key, "before").join(found.select("caller", F.col("call").alias("before"), "target"), ["caller", "before"]).join(tags, "target")
            any_ = queued.groupBy(*key).agg(F.bool_or("tagged").alias("any"))
            queued = queued.join(any_, key).where("tagged or not any").select(*key, "target", F.when(F.col("tagged"), 0.95).otherwise(0.90).alias("certainty"))
            queued = materialize(queued, "queued")
            left = waiting.join(queued, key, "left_anti").select(*asks.columns)
            open_ = materialize(left.where("before is null").unionByName(left.join(known, ["caller", "before"], "left_semi").select(*asks.columns)), "open")
            other = open_.where("type is null")
            new += [queued] if other.isEmpty() else [queued, direct(other)]
            ready += [queued.select(*key), other.select(*key)]
        typed = open_.join(done.select("caller", F.col("call").alias("type")), ["caller", "type"], "left_semi")
        met = typed.join(found.select("caller", F.col("call").alias("type"), F.col("target").alias("cls_id")), ["caller", "type"]).join(members.select(F.col("cls").alias("cls_id"), F.col("member").alias("rest"), "target"), ["cls_id", "rest"])
        first = met.groupBy(*key).agg(F.min("cls_id").alias("cls_id"))
        new.append(met.join(first, [*key, "cls_id"], "left_semi").select(*key, "target", F.lit(0.85).alias("certainty")))
        ready.append(typed.select(*key))
        for rows in new:
            found = found.unionByName(rows)
        settled = ready[0]
        for rows in ready[1:]:
            settled = settled.unionByName(rows)
        if settled.isEmpty():
            break
        later = waiting.join(settled, key, "left_anti").select(*asks.columns)
        if later.isEmpty():
            break
        waiting, found = materialize(later, "waiting"), materialize(found, "found")
        done = materialize(done.unionByName(settled).distinct(), "done")
    chosen = sites.join(found, key).select(F.col("caller").alias("src"), F.col("target").alias("dst"), "certainty", "ord")
    return merge_best(chosen, ["src", "dst"], [F.col("ord"), -F.col("certainty")]).select("src", "dst", "certainty", "ord")


def _cascade(asks: DataFrame, symbols: DataFrame, imports: DataFrame, bases: DataFrame, members: DataFrame, around: DataFrame, cap: int, excludes: DataFrame | None, modules: DataFrame | None) -> DataFrame:
    """(caller, call, target, certainty) of untyped asks by the first rule that fires for each."""
    ids = symbols.select(F.col("unique_id").alias("target"))
    key = ["caller", "call"]

    def rule(rows: DataFrame, prio: int, sure: float, target: Column | str = "target") -> DataFrame:
        return rows.select(*key, F.lit(prio).alias("prio"), F.lit(sure).alias("certainty"), (F.col(target) if isinstance(target, str) else target).alias("target"))

    plain, compound = asks.where("rest is null"), asks.where("rest is not null").withColumn("member", first_part("rest"))
    lexical = lexical_scopes(symbols, plain.select("caller", "module", "call"), around)
    imported = asks.join(imports.withColumnRenamed("local_name", "head"), ["file", "head"])
    own = compound.where("head in ('self', 'cls', 'this') and cls is not null").join(members, ["cls", "member"])
    above = compound.where("head = 'super' and cls is not null").join(bases.select("cls", "base"), "cls").join(members.withColumnRenamed("cls", "base"), ["base", "member"])
    beside = compound.drop("cls").withColumn("cls", F.concat_ws(".", "module", "head")).join(members, ["cls", "member"])
    here = plain.withColumn("target", F.concat_ws(".", "module", "call")).join(ids, "target", "left_semi")
    mate = plain.where("cls is not null").withColumn("target", F.concat_ws(".", "cls", "call")).join(ids, "target", "left_semi")
    rules = [
        lexical.select(*key, (F.col("climb") + 20).alias("prio"), "certainty", "target"),
        rule(imported, 1_000_050, 1.0, F.concat_ws(".", "fqn", "rest")),
        rule(own, 1_000_060, 0.95),
        rule(above, 1_000_070, 0.95),
        rule(beside, 1_000_080, 0.90),
        rule(here, 1_000_090, 0.90),
        rule(mate, 1_000_091, 0.90),
    ]
    found = rules[0]
    for r in rules[1:]:
        found = found.unionByName(r)
    found = materialize(first_rule(found.distinct(), key).select(*key, "target", "certainty"), "ruled")
    open_ = asks.join(found, key, "left_anti")
    if excludes is not None:
        open_ = open_.join(excludes, ["file", "call"], "left_anti").select(*open_.columns)
    bare = bare_matches(open_.withColumn("name", last_part(F.col("call"))), key, imports, symbols, cap).withColumn("certainty", F.lit(0.60))
    found = found.unionByName(bare.select(*found.columns))
    if modules is not None:
        ends = follow_aliases(found.join(ids, "target", "left_anti").select(F.col("target").alias("fqn")), imports, modules)
        found = found.join(ends.withColumnRenamed("fqn", "target"), "target", "left").select(*key, F.coalesce("to", "target").alias("target"), "certainty")
    return found.join(ids, "target", "left_semi").select(*key, "target", "certainty").distinct()
