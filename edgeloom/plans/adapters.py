"""The relations of the library, made from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.functions import identifiers as ids
from edgeloom.plans import edges as E

#: Return flag and line status name the kind of a reference (fixed values).
KIND_OF = {"NO": "use", "NF": "pub_use", "AO": "extern_crate", "AF": "mod", "RO": "path_reference", "RF": "macro_reference"}

#: Line items that a task of a join sorts, about: some 90 bytes each while it does.
ROWS_OF_A_TASK = 1_000_000
#: Rows of a table that Spark may broadcast if it takes them for small.
ROWS_OF_A_BROADCAST = 200_000


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def _slug(c: str) -> Column:
    return F.lower(F.replace(F.col(c), F.lit(" "), F.lit("_")))


def nation_files(t: Tables) -> DataFrame:
    """(nationkey, file, region, nation): at most as many rows as there are nations."""
    joined = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    file = F.concat(F.lit("src/"), _slug("r_name"), F.lit("/"), _slug("n_name"), F.lit(".rs"))
    return joined.select(F.col("n_nationkey").alias("nationkey"), file.alias("file"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"))


def _of(t: Tables, key: str, name: str) -> DataFrame:
    return F.broadcast(nation_files(t).select(F.col("nationkey").alias(key), F.col("file").alias(name)))


def _tasks(t: Tables) -> int:
    """Partitions of the joins of all line items, by their number (read from the files' footers); 0: few rows, as Spark chooses."""
    tasks = -(-t.lineitem.count() // ROWS_OF_A_TASK)
    return 0 if tasks <= 4 else max(tasks, int(t.spark.conf.get("spark.sql.shuffle.partitions")))


def _met(many: DataFrame, few: DataFrame, key: str, tasks: int) -> DataFrame:
    """Both sides dealt over so many tasks, so that what one of them sorts does not grow with the tables."""
    return many.repartition(tasks, key).join(few.repartition(tasks, key), key) if tasks else many.join(few, key)


def _looked_up(rows: DataFrame, count: int) -> DataFrame:
    """The smaller side of a join: too large for a broadcast it is hashed by partition, and the line items beside it are not sorted."""
    return rows.hint("shuffle_hash") if count > ROWS_OF_A_BROADCAST else rows


def _ordered_lines(t: Tables, *columns: str | Column) -> DataFrame:
    """(columns of the line item, l_orderkey, source): a row per line item with the file of its customer's nation."""
    tasks = _tasks(t)
    customers = t.customer.join(_of(t, "c_nationkey", "source"), "c_nationkey").select("c_custkey", "source")
    orders = _met(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), customers, "c_custkey", tasks)
    return _met(t.lineitem.select("l_orderkey", *columns), orders.select("l_orderkey", "source"), "l_orderkey", tasks)


def trade_refs(t: Tables) -> DataFrame:
    """(source, target, external, kind): a row per line item, from the customer's nation to the supplier's."""
    suppliers = t.supplier.join(_of(t, "s_nationkey", "target"), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "target")
    code = F.concat("l_returnflag", "l_linestatus")
    kind = F.coalesce(*(F.when(code == k, F.lit(v)) for k, v in KIND_OF.items()))
    lines = _ordered_lines(t, "l_suppkey", kind.alias("kind"))
    return lines.join(_looked_up(suppliers, t.supplier.count()), "l_suppkey").select("source", "target", F.lit(False).alias("external"), "kind")


def trade_edges(t: Tables) -> DataFrame:
    return E.graph(trade_refs(t), nation_files(t).withColumnRenamed("file", "identifier"))


def brand_refs(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("target"))
    lines = _ordered_lines(t, "l_partkey").join(_looked_up(parts, t.part.count()), "l_partkey")
    return lines.select("source", "target", F.lit(True).alias("external"), F.lit("use").alias("kind"))


def mixed_edges(t: Tables) -> DataFrame:
    """Trade and brand references in one graph."""
    files = nation_files(t).withColumnRenamed("file", "identifier")
    return E.graph(trade_refs(t).unionByName(brand_refs(t)), files)


def trade_top3(t: Tables) -> DataFrame:
    """Each nation's three most frequent other targets, as plain edges with kind use."""
    n = trade_refs(t).filter("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "target"))
    rows = n.withColumn("r", first).filter("r <= 3").select("source", "target", F.lit(False).alias("external"), F.lit("use").alias("kind"))
    return E.merge_edges(rows)


def flow_edges(t: Tables) -> DataFrame:
    """Event types that follow each other for a user; even counts are use, odd ones mod."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = t.events.select(F.col("event_type").alias("source"), after.alias("target")).filter("target is not null")
    n = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") % 2 == 0, F.lit("use")).otherwise(F.lit("mod"))
    return E.merge_edges(n.select("source", "target", F.lit(False).alias("external"), kind.alias("kind")))


def part_edges(t: Tables) -> DataFrame:
    """(source, target): parts that follow each other in an order, where the first was bought in large quantity; grows with the orders."""
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_quantity").alias("q"), after.alias("b")).filter("q >= 48 and b is not null")
    part = lambda c: F.concat(F.lit("part_"), F.col(c).cast("string"))
    return pairs.select(part("a").alias("source"), part("b").alias("target")).distinct()


def doc_files(t: Tables) -> DataFrame:
    """(path, name, extension, directory, content, non_blank_line_count)."""
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    out = t.documents.select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return out.select(
        "path", ids.stem("path").alias("name"), ids.extension("path").alias("extension"), ids.folder("path").alias("directory"), "content",
        ids.non_blank_lines("content").alias("non_blank_line_count"),
    )


def link_refs(t: Tables) -> DataFrame:
    links = t.pages.select("url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))
    return links.distinct()


def type_relations(t: Tables) -> dict[str, DataFrame]:
    """Customers as types: orders are methods, brands fields, an order's lines access brands."""
    kind = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("trait")).otherwise(F.lit("struct"))
    name = F.concat(F.lit("Customer_"), F.col("c_custkey").cast("string"))
    file = F.concat(F.lit("src/nation_"), F.col("c_nationkey").cast("string"), F.lit(".rs"))
    types = t.customer.select(name.alias("type"), kind.alias("kind"), file.alias("file"))
    owner = F.concat(F.lit("Customer_"), F.col("o_custkey").cast("string"))
    methods = t.orders.select(owner.alias("type"), F.col("o_orderkey").cast("string").alias("method"))
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("field")), "l_partkey")
    used = lines.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), owner.alias("type")), "l_orderkey")
    # distinct by the number that the join has dealt the lines by: no further shuffle
    accesses = used.select("type", "l_orderkey", "field").distinct().select("type", F.col("l_orderkey").cast("string").alias("method"), "field")
    fields = accesses.select("type", "field").distinct()
    return {"types": types, "methods": methods, "fields": fields, "accesses": accesses}


def nation_components(t: Tables) -> DataFrame:
    """(file, traits, concrete, loc) for distance metrics."""
    of = nation_files(t)
    rich = F.col("c_acctbal") > (24 - F.col("c_nationkey")) * 400
    own = t.customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count_if(rich).alias("traits"), F.count_if(~rich).alias("concrete"))
    by_nation = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nationkey")), "o_custkey")
    loc = by_nation.groupBy("nationkey").agg(F.count(F.lit(1)).alias("loc"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return of.join(own, "nationkey", "left").join(loc, "nationkey", "left").select("file", zero("traits"), zero("concrete"), zero("loc"))


def nation_types(t: Tables) -> DataFrame:
    """(type, kind, file): customers as types of their nation's file."""
    return t.customer.join(_of(t, "c_nationkey", "file"), "c_nationkey").select(F.concat(F.lit("Customer_"), F.col("c_custkey").cast("string")).alias("type"), F.lit("struct").alias("kind"), "file")


def impl_relations(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Impl blocks named after nations (even keys with their region) and types with such names."""
    rows = nation_files(t)
    full = F.concat("region", F.lit("::"), "nation")
    impls = rows.select(F.col("nationkey").cast("bigint").alias("impl_id"), F.when(F.col("nationkey") % 2 == 0, full).otherwise(F.col("nation")).alias("name"), F.col("region").alias("file"))
    types = rows.select(full.alias("type"), F.col("region").alias("file")).unionByName(rows.filter("nationkey % 3 = 0").select(F.col("nation").alias("type"), F.lit("shared").alias("file")))
    return impls, types
