"""Size, cohesion and coupling metrics, and rules on them.

Types come as four relations: ``types`` (type, kind, file), ``methods`` (type,
method), ``fields`` (type, field) and ``accesses`` (type, method, field).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import UserError
from edgeloom.operators.components import components
from edgeloom.plans.lineage import cut

#: Lines at which a file's size discount is full, and the discount (fixed values).
SIZE_LINES, SIZE_DISCOUNT = 100.0, 0.5
PAIN_LIMIT, USELESS_LIMIT = 0.3, 0.7


def _zero(x: str) -> Column:
    return F.coalesce(F.col(x), F.lit(0)).cast("bigint")


def method_count(types: DataFrame, methods: DataFrame) -> DataFrame:
    n = methods.groupBy("type").agg(F.count_distinct("method").alias("n"))
    return types.select("type").join(n, "type", "left").select("type", _zero("n").alias("value"))


def field_count(types: DataFrame, fields: DataFrame) -> DataFrame:
    n = fields.groupBy("type").agg(F.count_distinct("field").alias("n"))
    return types.select("type").join(n, "type", "left").select("type", _zero("n").alias("value"))


def accessed_by(fields: DataFrame, accesses: DataFrame) -> DataFrame:
    """(type, field, methods): the distinct methods that access a declared field, sorted."""
    used = accesses.groupBy("type", "field").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    return fields.select("type", "field").distinct().join(used, ["type", "field"], "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))


def declared_accesses(fields: DataFrame, accesses: DataFrame) -> DataFrame:
    return accesses.select("type", "method", "field").distinct().join(fields.select("type", "field").distinct(), ["type", "field"], "left_semi")


def lcom_inputs(types: DataFrame, methods: DataFrame, fields: DataFrame, accesses: DataFrame) -> DataFrame:
    """(type, m, a, s): methods, fields and distinct accesses of structs that have a method."""
    m = methods.groupBy("type").agg(F.count_distinct("method").alias("m"))
    a = fields.groupBy("type").agg(F.count_distinct("field").alias("a"))
    s = declared_accesses(fields, accesses).groupBy("type").agg(F.count(F.lit(1)).alias("s"))
    out = types.filter("kind = 'struct'").select("type").distinct().join(m, "type").join(a, "type", "left").join(s, "type", "left")
    return out.select("type", F.col("m").cast("bigint").alias("m"), _zero("a").alias("a"), _zero("s").alias("s"))


def lcom96a(inputs: DataFrame) -> DataFrame:
    """Also lcom3, lcom5 and lcom_star: (m - s/a) / (m - 1)."""
    value = F.when((F.col("m") <= 1) | (F.col("a") == 0), 0.0).otherwise((F.col("m") - F.try_divide("s", "a")) / F.greatest(F.col("m") - 1, F.lit(1)))
    return inputs.select("type", value.cast("double").alias("value"))


def lcom96b(inputs: DataFrame) -> DataFrame:
    """Also lcom2: 1 - s / (m * a)."""
    value = F.when((F.col("m") <= 1) | (F.col("a") == 0), 0.0).otherwise(1 - F.try_divide(F.col("s"), F.col("m") * F.col("a")))
    return inputs.select("type", value.cast("double").alias("value"))


def field_sets(fields: DataFrame, accesses: DataFrame) -> DataFrame:
    """(type, fields, methods): the distinct sets of declared fields that methods access, and how many methods have each."""
    used = declared_accesses(fields, accesses).groupBy("type", "method").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    return used.groupBy("type", "fields").agg(F.count(F.lit(1)).alias("methods"))


#: Accesses of a type, its declared fields, and its methods, up to which it is folded inside one row.
FOLDED_ACCESSES, FOLDED_METHODS = 10_000, 100


def lcom1(types: DataFrame, methods: DataFrame, fields: DataFrame, accesses: DataFrame, folded: int = FOLDED_METHODS) -> DataFrame:
    """max(pairs of methods without a shared field - pairs with one, 0).

    A type of at most ``folded`` methods and ``FOLDED_ACCESSES`` accesses and fields is counted in
    a fold over its row, its fields as bits of a number where 64 are enough.  Pairs of a larger
    type are counted by a join over fields between its distinct field sets, times their
    methods; so a field that many methods use alike makes no pairs of methods.
    """
    kept = types.filter("kind = 'struct'").select("type").distinct()
    used = cut(accesses.groupBy("type", "method").agg(F.collect_set("field").alias("fields")).join(kept, "type", "left_semi"))
    declared = cut(fields.select("type", "field").distinct())
    of_methods = used.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("fields")).alias("size"))
    of_fields = declared.groupBy("type").agg(F.count(F.lit(1)).alias("size"))
    large = of_methods.filter((F.col("n") > folded) | (F.col("size") > FOLDED_ACCESSES)).select("type")
    large = cut(large.union(of_fields.filter(F.col("size") > FOLDED_ACCESSES).select("type")).distinct())

    known = declared.join(large, "type", "left_anti").groupBy("type").agg(F.collect_list("field").alias("known"))
    small = used.join(large, "type", "left_anti").groupBy("type").agg(F.collect_list("fields").alias("sets")).join(known, "type")
    bit = lambda f: F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.array_position("known", f) - 1).cast("int"))
    mask = lambda fs: F.aggregate(F.array_intersect(fs, F.col("known")), F.lit(0).cast("bigint"), lambda m, f: m.bitwiseOR(bit(f)))
    meeting = lambda sets, meet: F.aggregate(sets, F.lit(0).cast("bigint"), lambda n, x: n + F.size(F.filter(sets, lambda y: meet(x, y)))) - F.size(sets)
    bound = lambda sets, meet: F.transform(F.array(sets), lambda s: meeting(s, meet))[0]  # noqa: E731  the sets are made once, not for each pair
    # ordered pairs of different methods, so each pair counts twice
    bits = F.filter(F.transform("sets", mask), lambda m: m != 0)
    names = F.filter(F.transform("sets", lambda fs: F.array_intersect(fs, F.col("known"))), lambda fs: F.size(fs) > 0)
    twice = F.when(F.size("known") <= 64, bound(bits, lambda x, y: x.bitwiseAND(y) != 0)).otherwise(bound(names, F.arrays_overlap))
    sharing = small.select("type", twice.alias("twice"))
    if not large.isEmpty():
        of_large = used.join(large, "type", "left_semi").select("type", "method", F.explode("fields").alias("field"))
        rest = cut(field_sets(declared, of_large))
        held = rest.select("type", F.col("fields").alias("own"), F.col("methods").alias("n"), F.explode("fields").alias("field"))
        other = held.select("type", "field", F.col("own").alias("other"), F.col("n").alias("k"))
        across = held.join(other, ["type", "field"]).filter("own < other").select("type", "own", "other", "n", "k").distinct().select("type", F.expr("2 * n * k").alias("twice"))
        alike = rest.select("type", F.expr("methods * (methods - 1)").alias("twice"))
        sharing = sharing.unionByName(alike.unionByName(across).groupBy("type").agg(F.sum("twice").alias("twice")))
    m = methods.join(kept, "type", "left_semi").groupBy("type").agg(F.count_distinct("method").alias("m"))
    out = m.join(sharing, "type", "left").withColumn("pairs", F.expr("m * (m - 1) div 2"))
    return out.select("type", F.greatest(F.col("pairs") - _zero("twice"), F.lit(0)).cast("double").alias("value"))


def lcom4(types: DataFrame, methods: DataFrame, fields: DataFrame, accesses: DataFrame, folded: int = FOLDED_ACCESSES) -> DataFrame:
    """Connected components of methods over shared fields; a method without any is one by itself.

    Components never leave a type: the field sets of a type of at most ``folded`` accesses
    are united in a fold over its row, those of larger types by joins of stars.
    """
    kept = types.filter("kind = 'struct'").select("type").distinct()
    used = cut(declared_accesses(fields, accesses).join(kept, "type", "left_semi"))
    n = cut(used.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("method").alias("with_field")))
    large = n.filter(F.col("n") > folded).select("type")

    def unite(groups: Column, fresh: Column) -> Column:
        met = F.filter(groups, lambda g: F.arrays_overlap(g, fresh))
        return F.concat(F.filter(groups, lambda g: ~F.arrays_overlap(g, fresh)), F.array(F.array_distinct(F.concat(F.flatten(met), fresh))))

    small = field_sets(fields, used.join(large, "type", "left_anti")).groupBy("type").agg(F.collect_list("fields").alias("sets"))
    united = F.aggregate("sets", F.array().cast("array<array<string>>"), unite)
    found = small.select("type", F.size(united).cast("bigint").alias("c"))
    if not large.isEmpty():
        name = lambda kind, c: F.concat_ws("\u0001", F.col("type"), F.lit(kind), F.col(c).cast("string"))
        of = used.join(large, "type", "left_semi").select("type", name("m", "method").alias("a"), name("f", "field").alias("b"))
        labels = of.select("type", F.col("a").alias("node")).distinct().join(components(of.select("a", "b")), "node")
        found = found.unionByName(labels.groupBy("type").agg(F.count_distinct("component").alias("c")))
    m = methods.select("type", "method").join(kept, "type", "left_semi").groupBy("type").agg(F.count_distinct("method").alias("m"))
    out = m.join(n, "type", "left").join(found, "type", "left")
    return out.select("type", (F.col("m") - _zero("with_field") + _zero("c")).cast("double").alias("value"))


# ---- distance ---------------------------------------------------------------------


def coupling(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, ca, ce, n): distinct dependents and dependencies among ``files`` (file), and the number of all files."""
    inner = edges.filter("not external and source <> target").select("source", "target").distinct()
    inner = inner.join(files.select(F.col("file").alias("source")), "source", "left_semi").join(files.select(F.col("file").alias("target")), "target", "left_semi")
    ca = inner.groupBy(F.col("target").alias("file")).agg(F.count(F.lit(1)).alias("ca"))
    ce = inner.groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("ce"))
    total = files.agg(F.count(F.lit(1)).alias("n"))
    out = files.join(ca, "file", "left").join(ce, "file", "left").crossJoin(F.broadcast(total))
    return out.withColumns({"ca": _zero("ca"), "ce": _zero("ce")})


def distance_metrics(infos: DataFrame) -> DataFrame:
    """Adds the five values to rows with traits, concrete, ca, ce, n and loc."""
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))
    col = F.col
    out = infos.withColumn("abstractness", ratio(col("traits"), col("traits") + col("concrete"))).withColumn("instability", ratio(col("ce"), col("ca") + col("ce")))
    out = out.withColumn("distance", F.abs(col("abstractness") + col("instability") - 1))
    out = out.withColumn("coupling_factor", F.when(col("n") <= 1, F.lit(0.0)).otherwise(ratio(col("ca") + col("ce"), 2 * (col("n") - 1))))
    return out.withColumn("normalized_distance", col("distance") * (1 - F.least(col("loc") / SIZE_LINES, F.lit(1.0)) * SIZE_DISCOUNT))


def in_zone_of_pain(infos: DataFrame) -> DataFrame:
    return infos.filter((F.col("abstractness") < PAIN_LIMIT) & (F.col("instability") < PAIN_LIMIT))


def in_zone_of_uselessness(infos: DataFrame) -> DataFrame:
    return infos.filter((F.col("abstractness") > USELESS_LIMIT) & (F.col("instability") > USELESS_LIMIT))


# ---- rules --------------------------------------------------------------------------

_COMPARE = {
    "below": lambda v, t: v < t,
    "below_or_equal": lambda v, t: v <= t,
    "above": lambda v, t: v > t,
    "above_or_equal": lambda v, t: v >= t,
    "equal": lambda v, t: v == t,
}


def threshold_violations(measured: DataFrame, verb: str, threshold: float, value: str = "value") -> DataFrame:
    """Rows whose value is not as asked; not-a-number violates every verb."""
    if verb not in _COMPARE:
        raise UserError(f"unknown comparison {verb!r}")
    if not math.isfinite(threshold):
        raise UserError("a threshold must be finite")
    v = F.col(value).cast("double")
    return measured.filter(F.isnan(v) | ~_COMPARE[verb](v, F.lit(float(threshold)))).withColumn("threshold", F.lit(float(threshold)))


def predicate_violations(measured: DataFrame, predicate: Column) -> DataFrame:
    return measured.filter(~F.coalesce(predicate, F.lit(False)))


def custom_metric(types: DataFrame, name: str, description: str, value: Column) -> DataFrame:
    if not name.strip() or not description.strip():
        raise UserError("a custom metric needs a name and a description")
    return types.withColumns({"metric_name": F.lit(name), "description": F.lit(description), "value": value.cast("double")})


def associate_impls(impls: DataFrame, types: DataFrame) -> DataFrame:
    """(impl_id, type): the unique type with the impl's exact name, else the unique one of the
    same simple name in its file, else in the project; a tie leaves the impl without a type.

    ``impls``: impl_id, name, file; ``types``: type (its name), file.
    """
    simple = lambda c: F.element_at(F.split(c, "::"), -1)
    known = types.select(F.struct("type", F.col("file").alias("type_file")).alias("hit"), F.col("type").alias("name"), simple("type").alias("s"), "file")

    def alone(order: str, *keys: str) -> DataFrame:
        """Types that have these keys to themselves."""
        only = known.groupBy(*keys).agg(F.min("hit").alias(order), F.count(F.lit(1)).alias("n"))
        return only.filter("n = 1").drop("n")

    out = impls.select("impl_id", "name", "file", simple("name").alias("s"))
    for order, keys in {"first": ["name"], "second": ["s", "file"], "third": ["s"]}.items():
        out = out.join(alone(order, *keys), keys, "left")  # at most one row of each key: no impl meets several types
    best = out.select("impl_id", F.coalesce("first", "second", "third").alias("best")).filter("best is not null")
    return best.select("impl_id", "best.type", "best.type_file")


def retain_types(types: DataFrame, keep: Column, files: DataFrame | None = None) -> DataFrame:
    """Per file the concrete types and traits that a type selector leaves; files without any go.

    With ``files`` (file and any counts) the two counts are replaced, all others stay as they are.
    """
    kept = types.filter(keep)
    out = kept.groupBy("file").agg(F.count_if(F.col("kind") != "trait").alias("concrete_types"), F.count_if(F.col("kind") == "trait").alias("traits"))
    return out if files is None else files.drop("concrete_types", "traits").join(out, "file")


def retain_impls(impls: DataFrame, kept_types: DataFrame) -> DataFrame:
    """The impls (name, file, ..) for which their file keeps a type with the same last segment, as any of the same name has."""
    last = lambda c: F.element_at(F.split(c, "::"), -1)
    kept = kept_types.select(F.col("file").alias("of_file"), last("type").alias("of_name")).distinct()
    rows = impls.select(F.struct("*").alias("impl"))  # so no column can clash
    return rows.join(kept, (F.col("impl.file") == F.col("of_file")) & (last("impl.name") == F.col("of_name")), "left_semi").select("impl.*")


def components_with_type(infos: DataFrame, types: DataFrame, keep: Column) -> DataFrame:
    """The components (file, ..) that hold at least one type a selector matches, with their values unchanged."""
    return infos.join(types.filter(keep).select("file"), "file", "left_semi")


def zone_text(infos: DataFrame, zone: str) -> DataFrame:
    """(text): components of a zone, ratios with three decimals."""
    return infos.select(F.format_string(f"'%s' is in the zone of {zone} (abstractness %.3f, instability %.3f)", "file", "abstractness", "instability").alias("text"))
