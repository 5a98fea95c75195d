"""Comparing versions: snapshot differences, identity of renamed or moved items, key reconciliation, unique names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovewise.operators.ordering import ranked_order, running_totals


def snapshot_diff(before: DataFrame, now: DataFrame, key: str, stamp: str, is_dir: str | None = None) -> DataFrame:
    """(key, action): add, edit, delete or same. A directory is never edited. One full outer join on the key."""
    a = before.select(F.col(key), F.col(stamp).alias("_old"), F.lit(True).alias("_had"))
    b = now.select(F.col(key), F.col(stamp).alias("_new"), (F.col(is_dir) if is_dir else F.lit(False)).alias("_dir"), F.lit(True).alias("_has"))
    action = (
        F.when(F.col("_had").isNull(), "add")
        .when(F.col("_has").isNull(), "delete")
        .when(~F.col("_old").eqNullSafe(F.col("_new")) & ~F.col("_dir"), "edit")
        .otherwise("same")
    )
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def apply_snapshot(diff: DataFrame, source: DataFrame, copy: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, stamp, done, columns of ``source``): the working copy after a snapshot's actions (key, action).

    ``source`` holds the files as they are now, with their contents, ``copy`` (key, stamp) what the working copy has with
    the stamp recorded for it (``recorded``). Deleted files go, new and edited ones are copied; of the others those that
    are missing from the copy, or whose stamp isn't the recorded one, are copied again. All are equi-joins on the key.
    """
    found = diff.where("action <> 'delete'").join(source, key).join(copy.select(key, F.col(stamp).alias("_at"), F.col("recorded").alias("_recorded")), key, "left")
    done = F.when(F.col("action").isin("add", "edit"), "copied").when(F.col("_at").isNull() | ~F.col("_at").eqNullSafe(F.col("_recorded")), "copied again").otherwise("kept")
    return found.withColumn("done", done).drop("_at", "_recorded", "action")


def reconcile(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """(key, state): added, deleted or matched."""
    both = have.select(key, F.lit(1).alias("h")).distinct().join(want.select(key, F.lit(1).alias("w")).distinct(), key, "full_outer")
    return both.select(key, F.when(F.col("h").isNull(), "added").when(F.col("w").isNull(), "deleted").otherwise("matched").alias("state"))


def uninherited(now: DataFrame, inherited: DataFrame, key: str) -> DataFrame:
    """Items that a cycle wrote anew: those not carried over from the previous one."""
    return now.join(inherited.select(key), key, "left_anti")


def identity_match(before: DataFrame, now: DataFrame, keys: Sequence[Sequence[str]], id_: str) -> DataFrame:
    """(new id, old id): items matched by the first key list that names exactly one item on each side.

    A key with several items on a side matches nothing at that stage; what stays unmatched goes to the next list.
    """
    left, right, found = now, before, None
    for columns in keys:
        one = [df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*columns))).where("_n = 1").select(F.col(id_).alias(name), *columns) for df, name in ((left, "new_id"), (right, "old_id"))]
        pairs = one[0].join(one[1], list(columns)).select("new_id", "old_id")
        found = pairs if found is None else found.unionByName(pairs)
        left = left.join(pairs.select(F.col("new_id").alias(id_)), id_, "left_anti")
        right = right.join(pairs.select(F.col("old_id").alias(id_)), id_, "left_anti")
    return found


def hierarchical_match(levels: Sequence[tuple[DataFrame, DataFrame, Sequence[Sequence[str]]]], id_: str, parent: str) -> list[DataFrame]:
    """(new id, old id) for each level of a hierarchy, given from the top as (before, now, key lists as in
    ``identity_match``): parents are matched first, and items match only below parents that do. What has no such parent is
    new, or gone."""
    out: list[DataFrame] = []
    for before, now, keys in levels:
        if out:
            up = out[-1].select(F.col("new_id").alias(parent), F.col("old_id").alias("_old"))
            now = now.join(up, parent).drop(parent).withColumnRenamed("_old", parent)
            keys = [[parent, *k] for k in keys]
        out.append(identity_match(before, now, keys, id_))
    return out


def change_records(before: DataFrame, now: DataFrame, matches: DataFrame, id_: str, content: Sequence[str]) -> DataFrame:
    """(id, action): matched items whose content differs are edits, the others additions and deletions."""
    print_ = F.xxhash64(*content)
    new, old = now.select(F.col(id_).alias("new_id"), print_.alias("_n")), before.select(F.col(id_).alias("old_id"), print_.alias("_o"))
    edits = matches.join(new, "new_id").join(old, "old_id").where("_n <> _o").select(F.col("new_id").alias("id"), F.lit("edit").alias("action"))
    adds = new.join(matches, "new_id", "left_anti").select(F.col("new_id").alias("id"), F.lit("add").alias("action"))
    gone = old.join(matches, "old_id", "left_anti").select(F.col("old_id").alias("id"), F.lit("delete").alias("action"))
    return edits.unionByName(adds).unionByName(gone)


def duplicate_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """All but the first holder of a name, with their number among its holders. Holders are numbered over ranges, so that
    those of one name aren't one task's."""
    numbered = ranked_order(rows, name, [], order, "serial").where("serial > 1")
    held = rows.groupBy(F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("n_holders")).where("n_holders > 1")
    return numbered.join(held, F.col(name).eqNullSafe(F.col("_name"))).select(*rows.columns, "n_holders", "serial")


def dispense_names(rows: DataFrame, name: str, order: str, kind: Column) -> DataFrame:
    """Unique names: a repeated name becomes ``base-N``, a missing one ``kind-N``.

    N starts at the holder's number and moves past names that are taken. With the taken numbers of a base in order, the
    j-th pushes up every number from its own less j - 1 on, so how far a holder moves is a running count; numbers and
    counts are running totals over ranges, and no base's rows, however many, meet in one task.
    """
    named = F.col(name).isNotNull()
    keyed = rows.withColumn("_base", F.coalesce(F.col(name), kind)).withColumn("_late", (~named).cast("int")).withColumn("_one", F.lit(1)).withColumn("_named", named.cast("int"))
    keyed = running_totals(keyed, "_base", ["_late", order], {"_k": "_one", "_held": "_named"})
    want = F.col("_k").cast("long") - F.when(~named & (F.col("_held") == 0), 0).otherwise(1)
    keyed = keyed.withColumn("_want", want)

    number = F.regexp_extract(name, "^(.*)-([0-9]+)$", 2).try_cast("long")
    taken = rows.where(F.col(name).rlike("-[1-9][0-9]*$")).select(F.regexp_extract(name, "^(.*)-([0-9]+)$", 1).alias("_base"), number.alias("_t"), F.lit(1).alias("_one")).where("_t is not null").distinct()
    taken = running_totals(taken, "_base", ["_t"], {"_j": "_one"}).select("_base", (F.col("_t") - F.col("_j") + 1).alias("_want"), F.lit(1).alias("_push"))
    marks = taken.unionByName(keyed.select("_base", "_want").distinct().withColumn("_push", F.lit(0)))
    marks = marks.groupBy("_base", "_want").agg(F.sum("_push").alias("_push"))
    moved = running_totals(marks, "_base", ["_want"], {"_moved": "_push"}).where("_moved > 0").select("_base", "_want", "_moved")
    found = keyed.join(moved, ["_base", "_want"], "left")
    fresh = F.concat("_base", F.lit("-"), (F.col("_want") + F.coalesce("_moved", F.lit(0))).cast("string"))
    unique = F.when(named & (F.col("_k") == 1), F.col(name)).otherwise(fresh)
    return found.select(*rows.columns, unique.alias("unique_name"))


def resolve_in_scopes(refs: DataFrame, scopes: Sequence[tuple[str, DataFrame, Column | Mapping[str, str]]]) -> DataFrame:
    """Resolve each reference in the first scope that knows it.

    ``scopes`` are (name, definitions with column ``target``, how they meet) in order of priority: columns of references to
    columns of definitions that equal them, or any condition. A scope with several targets for a reference makes it
    ambiguous, a miss in all unresolved; both are recorded, not dropped. Definitions that are met by columns are aggregated
    before they are joined, so that no reference is multiplied by them.
    """
    out = refs
    for i, (_, definitions, on) in enumerate(scopes):
        if isinstance(on, Mapping):
            own = definitions.groupBy(*[F.col(d).alias(f"_k{j}") for j, d in enumerate(on.values())]).agg(F.min("target").alias(f"_t{i}"), F.countDistinct("target").alias(f"_n{i}"))
            out = out.join(own, [F.col(r) == F.col(f"_k{j}") for j, r in enumerate(on)], "left").drop(*[f"_k{j}" for j in range(len(on))])
            continue
        hits = refs.join(definitions, on).groupBy("ref_id").agg(F.min("target").alias(f"_t{i}"), F.countDistinct("target").alias(f"_n{i}"))
        out = out.join(hits, "ref_id", "left")
    n, found, scope, many = range(len(scopes)), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for i in reversed(n):
        known = F.col(f"_n{i}") > 0
        found = F.when(known, F.when(F.col(f"_n{i}") == 1, F.col(f"_t{i}"))).otherwise(found)
        scope = F.when(known, F.lit(scopes[i][0])).otherwise(scope)
        many = F.when(known, F.col(f"_n{i}") > 1).otherwise(many)
    status = F.when(many, "ambiguous").when(scope.isNull(), "unresolved").otherwise("resolved")
    return out.select(*refs.columns, found.alias("target"), scope.alias("scope"), status.alias("status"))


# Types that have no declaration.
PRIMITIVES = ("boolean", "byte", "char", "double", "float", "int", "long", "short", "void")


def resolve_types(refs: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref_id, target, scope, status) of references (ref_id, doc, name, package, enclosing) to types (impl, full).

    ``enclosing`` lists the types around the reference, the innermost first; ``impl`` has ``$`` between nested types.
    ``imports`` are (doc, name), those of whole packages ending in ``.*``. A name's first part is looked up among the
    types being defined, their members from the innermost out, the named imports, the own package and the packages
    imported whole; the first scope that knows it decides, and its other parts are nested types. Where no scope knows it,
    the shortest leading parts that name a type do. Several types for a name are ambiguous.
    """
    refs = refs.withColumn("_first", F.substring_index("name", ".", 1)).withColumn("_rest", F.expr("replace(substring(name, length(substring_index(name, '.', 1)) + 1), '.', '$')"))
    plain = refs.where(~F.col("name").isin(*PRIMITIVES))
    known = types.groupBy(F.col("impl").alias("_impl")).agg(F.min("full").alias("_full"), F.count(F.lit(1)).alias("_n"))
    at = lambda df, scope, place, impl: df.select("ref_id", F.lit(scope).alias("scope"), place.cast("int").alias("_place"), impl.alias("_impl"), "_rest")
    around = plain.select("*", F.posexplode("enclosing").alias("_pos", "_in"))
    simple = F.regexp_extract("_in", r"[^.$]+$", 0)
    given = imports.select("doc", F.col("name").alias("_name"), F.substring_index("name", ".", -1).alias("_last"))
    own = F.when(F.coalesce("package", F.lit("")) == "", F.col("_first")).otherwise(F.concat("package", F.lit("."), "_first"))
    sure = at(around.where(simple == F.col("_first")), "defined", F.lit(0), F.col("_in"))
    sure = sure.unionByName(at(plain.join(given.where("_last <> '*'"), ["doc"]).where("_last = _first"), "import", F.lit(1_000_000), F.col("_name")))
    maybe = at(around, "member", F.col("_pos") + 1, F.concat("_in", F.lit("$"), "_first")).unionByName(at(plain, "package", F.lit(1_000_001), own))
    whole = plain.join(given.where("_last = '*'"), "doc")
    maybe = maybe.unionByName(at(whole, "packages", F.lit(1_000_002), F.concat(F.expr("substring(_name, 1, length(_name) - 1)"), F.col("_first"))))
    parts = F.split("name", "[.]")
    walked = plain.where("name like '%.%'").withColumn("_k", F.explode(F.sequence(F.lit(2), F.size(parts))))
    rest = F.concat(F.when(F.col("_k") < F.size(parts), "$").otherwise(""), F.array_join(F.slice(parts, F.col("_k") + 1, F.size(parts)), "$"))
    walked = walked.select("ref_id", F.lit("path").alias("scope"), (F.col("_k") + 2_000_000).alias("_place"), F.array_join(F.slice(parts, F.lit(1), F.col("_k")), ".").alias("_impl"), rest.alias("_rest"))
    found = sure.unionByName(maybe.unionByName(walked).join(known.select("_impl"), "_impl", "left_semi")).distinct()
    best = found.groupBy("ref_id").agg(F.min("_place").alias("_place"))
    chosen = found.join(best, ["ref_id", "_place"]).groupBy("ref_id").agg(F.min("scope").alias("scope"), F.min(F.concat("_impl", "_rest")).alias("_impl"), F.countDistinct("_impl").alias("_many"))
    loaded = refs.select("ref_id", "name").join(chosen, "ref_id", "left").join(known, "_impl", "left")
    primitive = F.col("name").isin(*PRIMITIVES)
    many = F.coalesce((F.col("_many") > 1) | (F.col("_n") > 1), F.lit(False))
    status = F.when(primitive, "resolved").when(many, "ambiguous").when(F.col("_full").isNull(), "unresolved").otherwise("resolved")
    target = F.when(primitive, F.col("name")).when(~many, F.col("_full"))
    return loaded.select("ref_id", target.alias("target"), F.when(primitive, "primitive").otherwise(F.col("scope")).alias("scope"), status.alias("status"))
