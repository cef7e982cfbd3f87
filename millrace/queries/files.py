"""Sources and sinks (S, K). Files are written to the shared scratch folder from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import join
from ..operators.sets import union
from ..session import scratch_path
from ..sources import custom, memory, readers, writers
from .base import query, rounded, table

@query(
    "s1_read_csv",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderpriority "
    "FROM orders",
)
def s1(spark, d):
    path = scratch_path(spark, "csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    table(spark, d, "orders").select(*columns).write.option("header", "true").option("sep", ";").csv(path)
    found = readers.read_csv(spark, path, delimiter=";")
    return found.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "s2_read_parquet",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' "
    "AND l_returnflag = 'N'",
)
def s2(spark, d):
    df = readers.read_parquet(spark, f"{d}/lineitem.parquet")
    kept = df.filter((F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "N"))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("s3_read_json", "SELECT event_id, user_id, event_type, value, props, CAST(ts AS TIMESTAMP) AS ts FROM events")
def s3(spark, d):
    path = scratch_path(spark, "json")
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    found = readers.read_json(spark, path).select("event_id", "user_id", "event_type", "value", "props", "ts")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("s4_read_dir", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s4(spark, d):
    path = scratch_path(spark, "tree")
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    df.write.partitionBy("o_orderstatus", "o_orderpriority").parquet(path)
    return readers.read_dir(spark, path, "parquet")


@query("s5_trim_names", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def s5(spark, d):
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("  id"), F.col("s_name").alias("name "))
    return readers.trimmed_names(df)


_LABELS = "(VALUES ('O', 'open', 1.5), ('F', 'filled', NULL), ('P', NULL, 3.0)) AS t(code, label, weight)"


@query(
    "s6_from_rows",
    "SELECT o.o_orderkey, t.label, CAST(t.weight AS DOUBLE) AS weight FROM orders o JOIN "
    f"{_LABELS} ON o.o_orderstatus = t.code",
)
def s6(spark, d):
    rows = [{"code": "O", "label": "open", "weight": 1.5}, {"code": "F", "label": "filled"}, {"code": "P", "weight": 3}]
    labels = memory.from_rows(spark, rows)
    both = join(table(spark, d, "orders"), labels, {"o_orderstatus": "code"})
    return both.select("o_orderkey", "label", "weight")


@query(
    "s7_from_columns",
    "SELECT l.l_orderkey, l.l_linenumber, t.meaning FROM lineitem l JOIN "
    "(VALUES ('A', 'accepted'), ('R', 'returned')) AS t(flag, meaning) ON l.l_returnflag = t.flag",
)
def s7(spark, d):
    flags = memory.from_columns(spark, {"flag": ["A", "R"], "meaning": ["accepted", "returned"]})
    both = join(table(spark, d, "lineitem"), flags, {"l_returnflag": "flag"})
    return both.select("l_orderkey", "l_linenumber", "meaning")


@query(
    "s8_from_typed",
    "SELECT p.p_partkey, t.low FROM part p JOIN (VALUES ('SMALL', 10), ('ECONOMY', NULL)) AS t(kind, low) "
    "ON p.p_type = t.kind",
)
def s8(spark, d):
    limits = memory.from_typed(spark, [("kind", "String"), ("low", "Int32")], [["SMALL", "ECONOMY"], ["10", "ten"]])
    return join(table(spark, d, "part"), limits, {"p_type": "kind"}).select("p_partkey", "low")


@query("s9_empty", "SELECT r_regionkey, r_name, CAST(NULL AS DATE) AS founded FROM region")
def s9(spark, d):
    return union(table(spark, d, "region"), memory.empty(spark, "r_regionkey int, founded date"))


def _check_digits(partition, partitions, keys, filters=()):
    """Numbers with their check digits (modulo 97), as a service outside of Spark might hand them out, in Arrow batches."""
    import numpy as np
    import pyarrow as pa

    low = max([0, *(value for name, operator, value in filters if name == "key" and operator in (">", ">=", "="))])
    for start in range(low + partition * 4096, int(keys), partitions * 4096):
        key = np.arange(start, min(start + 4096, int(keys)))
        yield pa.RecordBatch.from_pydict({"unused": key, "check": (98 - key * 100 % 97).astype(np.int32), "key": key})


@query(
    "s11_read_custom",
    "SELECT c_custkey, c_name, CAST(98 - c_custkey * 100 % 97 AS INTEGER) AS check_digits FROM customer WHERE c_custkey >= 20",
)
def s11(spark, d):
    customers = table(spark, d, "customer")
    keys = customers.agg(F.max("c_custkey") + 1).first()[0]
    fields = [("key", "Int64"), {"name": "check", "type": "Int32"}]
    digits = custom.read_custom(spark, _check_digits, fields, partitions=4, keys=str(keys)).filter("key >= 20")
    return join(customers, digits, {"c_custkey": "key"}).select("c_custkey", "c_name", F.col("check").alias("check_digits"))


@query(
    "s12_sequence",
    "SELECT n.id, o.o_totalprice FROM range((SELECT count(*) FROM orders)) AS n(id) JOIN orders o ON o.o_orderkey = n.id",
)
def s12(spark, d):
    orders = table(spark, d, "orders")
    numbers = memory.sequence(spark, orders.count(), "id")
    return join(numbers, orders, {"id": "o_orderkey"}).select("id", "o_totalprice")


@query(
    "s13_synthetic_people",
    "SELECT c_nationkey, count(*) AS people, count(*) AS named, count(*) AS reachable, count(*) AS called, count(*) AS born, count(*) AS housed, "
    "count(*) AS sold, count(*) AS again FROM customer GROUP BY c_nationkey",
)
def s13(spark, d):
    """A person for every customer; what is fixed about people is checked, their made-up values are not an SQL engine's matter."""
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = customers.count()
    people, again = (memory.synthetic_people(spark, n, seed=7, number=name) for name in ("n", "m"))
    found = join(customers, people, {"c_custkey": "n"})
    found = found.join(again.repartition(5).select("m", F.xxhash64(*memory.PEOPLE).alias("same")), F.col("c_custkey") == F.col("m"))
    checks = {
        "named": F.col("Name").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$"),
        "reachable": F.col("Email").rlike("^[a-z]+_[a-z]+[.][0-9]{1,2}@example[.](com|org|net)$"),
        "called": F.col("Phone").rlike("^555-[0-9]{3}-[0-9]{4}$"),
        "born": F.col("DOB").between("1940-01-01", "2008-06-13"),
        "housed": F.col("Address").rlike("^[1-9][0-9]{2} [A-Z]") & F.col("Zipcode").rlike("^[0-9]{5}$") & F.col("City").isNotNull() & F.col("Country").isNotNull(),
        "sold": F.col("sales_data").between(0, 1000) & F.col("ID").between(1, 1_000_000) & F.col("Work").isNotNull(),
        "again": F.xxhash64(*memory.PEOPLE) == F.col("same"),
    }
    return found.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"), *[F.count_if(c).alias(k) for k, c in checks.items()])


@query("k1_write_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def k1(spark, d):
    path = scratch_path(spark, "csv")
    columns = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    writers.write_csv(table(spark, d, "part").select(*columns), path, delimiter="|")
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    return readers.read_csv(spark, path, delimiter="|", schema=schema)


@query("k1_csv_line_breaks", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def k1_line_breaks(spark, d):
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, d, "documents"), path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return readers.read_csv(spark, path, schema=schema, multi_line=True)


@query("k2_write_parquet", "SELECT l_returnflag, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY l_returnflag")
def k2(spark, d):
    path = scratch_path(spark, "parquet")
    writers.write_parquet(table(spark, d, "lineitem"), path, "zstd")
    return rounded(spark.read.parquet(path).groupBy("l_returnflag").agg(F.sum("l_tax").alias("tax")))


@query("k3_write_json", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def k3(spark, d):
    path = scratch_path(spark, "json")
    writers.write_json(table(spark, d, "documents"), path)
    return readers.read_json(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


@query("k1_append_mode", "SELECT n_name, CAST(2 AS BIGINT) AS copies FROM nation")
def k1_append(spark, d):
    path = scratch_path(spark, "csv")
    for mode in ("overwrite", "append"):
        writers.write_csv(table(spark, d, "nation"), path, mode=mode)
    return readers.read_csv(spark, path).groupBy("n_name").agg(F.count("*").alias("copies"))


@query("k5_create_mode", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def k5(spark, d):
    path = scratch_path(spark, "create")
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    writers.write_parquet(df.filter("c_acctbal > 0"), path, mode="create")
    writers.write_parquet(df, path, mode="create")  # exists: nothing happens
    return spark.read.parquet(path)


@query(
    "k6_materialise",
    "SELECT a.o_custkey, a.total, b.best FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders "
    "GROUP BY 1) a JOIN (SELECT max(total) AS best FROM (SELECT round(sum(o_totalprice), 2) AS total FROM orders "
    "GROUP BY o_custkey) t) b ON TRUE",
)
def k6(spark, d):
    totals = rounded(table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")), 2)
    kept = writers.materialise(totals, scratch_path(spark, "kept"))
    return kept.join(F.broadcast(kept.agg(F.max("total").alias("best"))))  # one row
