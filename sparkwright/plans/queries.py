"""The queries over the relational tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions.dates import due, strict_date
from sparkwright.functions.identifiers import fiscal_control, fiscal_valid, fiscal_verdict, iban_check_digits, iban_print, iban_valid, iban_verdict
from sparkwright.functions.money import net_of
from sparkwright.operators.reconcile import reconcile
from sparkwright.sources.sinks import nested, read_csv, write_csv, write_json, write_xml
from sparkwright.sources.tables import new_folder, table
from sparkwright.streaming.checks import closing, read_codes, start, valid_per_hour


def order_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


ORDER_RECONCILE = """
with l as (
  select l_orderkey, (l_extendedprice::decimal(15,2) * (1 - l_discount::decimal(4,2)))::decimal(18,4) as n, l_tax::decimal(4,2) as t from lineitem),
s as (
  select l_orderkey, count(*) as n_lines, round(sum(n), 2) as net, round(sum((n * t)::decimal(18,6)), 2) as tax from l group by 1),
b as (
  select o_orderkey, n_lines, net, tax, o_totalprice::decimal(18,2) as total, o_totalprice::decimal(18,2) - net - tax as gap
  from orders left join s on o_orderkey = l_orderkey)
select o_orderkey, coalesce(n_lines, 0) as n_lines, net::double as net, tax::double as tax, total::double as total, gap::double as gap,
  case when n_lines is null then 'no_lines' when abs(gap) <= 0.01 then 'balanced' when gap > 0 then 'over' else 'under' end as status
from b
"""


def iban_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account codes made from customer keys, and whether each is valid: as made, and with its last digit changed."""
    bban = F.concat(F.lit("10020030"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", bban.alias("bban"))
    rows = rows.withColumn("iban", F.concat(F.lit("DE"), iban_check_digits("DE", F.col("bban")), "bban"))
    wrong = F.concat(F.left("iban", F.lit(21)), ((F.right("iban", F.lit(1)).cast("int") + 1) % 10).cast("string"))
    return rows.select("c_custkey", "iban", iban_print(F.col("iban")).alias("printed"), iban_valid(F.col("iban")).alias("valid"), iban_valid(wrong).alias("wrong_valid"))


IBAN_CHECK = """
with b as (select c_custkey, '10020030' || lpad(c_custkey::varchar, 10, '0') as bban from customer),
i as (select c_custkey, 'DE' || lpad((98 - (bban || '131400')::hugeint % 97)::varchar, 2, '0') || bban as iban from b)
select c_custkey, iban, trim(regexp_replace(iban, '(.{4})', '\\1 ', 'g')) as printed,
  (iban[5:] || '1314' || iban[3:4])::hugeint % 97 = 1 as valid,
  (iban[5:21] || ((iban[22]::int + 1) % 10)::varchar || '1314' || iban[3:4])::hugeint % 97 = 1 as wrong_valid
from i
"""


def fiscal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal codes made from supplier keys with their control digit, every third one with the next digit instead, and whether each, and the key alone, would pass for one."""
    base = (F.col("s_suppkey") + 1000).cast("string")
    digit = (fiscal_control(base) + F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0)) % 10
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", base.alias("base"), F.concat(base, digit.cast("string")).alias("code"))
    return rows.select("s_suppkey", "code", fiscal_valid(F.col("code")).alias("valid"), fiscal_valid(F.col("base")).alias("base_valid"))


FISCAL_CHECK = """
with b as (select s_suppkey, (s_suppkey + 1000)::varchar as base from supplier),
p as (select s_suppkey, base, lpad(base, 9, '0') as p from b),
c as (
  select s_suppkey, base, base || (((7 * p[1]::int + 5 * p[2]::int + 3 * p[3]::int + 2 * p[4]::int + p[5]::int + 7 * p[6]::int + 5 * p[7]::int + 3 * p[8]::int + 2 * p[9]::int) * 10 % 11 % 10 + case when s_suppkey % 3 = 0 then 1 else 0 end) % 10)::varchar as code
  from p),
d as (select *, lpad(code[:-2], 9, '0') as of_code, lpad(base[:-2], 9, '0') as of_base from c)
select s_suppkey, code,
  (7 * of_code[1]::int + 5 * of_code[2]::int + 3 * of_code[3]::int + 2 * of_code[4]::int + of_code[5]::int + 7 * of_code[6]::int + 5 * of_code[7]::int + 3 * of_code[8]::int + 2 * of_code[9]::int) * 10 % 11 % 10 = code[-1:]::int as valid,
  (7 * of_base[1]::int + 5 * of_base[2]::int + 3 * of_base[3]::int + 2 * of_base[4]::int + of_base[5]::int + 7 * of_base[6]::int + 5 * of_base[7]::int + 3 * of_base[8]::int + 2 * of_base[9]::int) * 10 % 11 % 10 = base[-1:]::int as base_valid
from d
"""


def tax_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per return flag and line status: prices taken as gross at 20 percent, split into net and tax."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("decimal(18,2)").alias("gross"))
    rows = rows.withColumn("net", net_of(F.col("gross"), F.lit(20)))
    sums = rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("gross").alias("gross"), F.sum("net").alias("net"))
    return sums.select("l_returnflag", "l_linestatus", "n", F.col("gross").cast("double").alias("gross"), F.col("net").cast("double").alias("net"), (F.col("gross") - F.col("net")).cast("double").alias("tax"))


TAX_SPLIT = """
with r as (select l_returnflag, l_linestatus, (l_extendedprice::decimal(18,2) * 100)::hugeint as cents from lineitem),
s as (select l_returnflag, l_linestatus, cents, (cents * 1000 + 600) // 1200 as net from r)
select l_returnflag, l_linestatus, count(*) as n, (sum(cents)::decimal(38,2) / 100)::double as gross, (sum(net)::decimal(38,2) / 100)::double as net,
  ((sum(cents) - sum(net))::decimal(38,2) / 100)::double as tax
from s group by 1, 2
"""


def due_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order with lines: when it is due by its priority's term, and days between that and its last shipment. Dates go through their text; in every seventh the day is 31, which not all months have (then null and 0 days)."""
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    day = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("31"), F.substring(day, 3, 8))).otherwise(day)
    term = F.when(F.col("o_orderpriority").startswith("1"), 10).when(F.col("o_orderpriority").startswith("2"), 20).otherwise(30)
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", strict_date(day, "dd.MM.yyyy").alias("issued"), term.alias("days"))
    rows = rows.withColumn("due", due(F.col("issued"), F.col("days"))).join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", F.col("due").cast("string").alias("due"), F.coalesce(F.datediff(F.col("last").cast("date"), "due"), F.lit(0)).cast("long").alias("late_days"))


DUE_DATES = """
with last as (select l_orderkey, max(l_shipdate)::date as last from lineitem group by 1),
t as (
  select *, case when o_orderkey % 7 = 0 then strftime(o_orderdate, '%Y-%m-31') else strftime(o_orderdate, '%Y-%m-%d') end as day from orders),
d as (
  select o_orderkey, try_cast(day as date) + (case when o_orderpriority like '1%' then 10 when o_orderpriority like '2%' then 20 else 30 end)::int as due from t)
select o_orderkey, due::date::varchar as due, coalesce(last - due::date, 0)::bigint as late_days from d join last on o_orderkey = l_orderkey
"""


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit('a "quoted", '), F.col("p_name"), F.lit("; 'x' & <y>")).alias("name"), price.alias("price"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with awkward names, written as CSV and read back."""
    write_csv(_exported(spark, sf_dir), path := new_folder(spark))
    return read_csv(spark, path, "key string, name string, price string")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    write_json(_exported(spark, sf_dir), path := new_folder(spark))
    return spark.read.schema("key string, name string, price string").json(path)


def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    write_xml(_exported(spark, sf_dir), path := new_folder(spark))
    return spark.read.format("xml").option("rowTag", "row").schema("key string, name string, price string").load(path)


ROUND_TRIP = """
select p_partkey::varchar as key, 'a "quoted", ' || p_name || '; ''x'' & <y>' as name, p_retailprice::decimal(18,2)::varchar as price from part
"""


def codes_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream: account codes made from users, every fifth with a wrong length, counted by hour and validity once their hour is over. A last row ends all hours."""
    bban = F.concat(F.lit("10020030"), F.lpad(F.col("user_id").cast("string"), 10, "0"))
    code = F.concat(F.lit("DE"), iban_check_digits("DE", bban), bban, F.when(F.col("event_id") % 5 == 0, "1").otherwise(""))
    source, out, log = (new_folder(spark) for _ in range(3))
    codes = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), code.alias("code"), F.col("ts").cast("timestamp").alias("arrived"))
    codes.write.parquet(source)
    closing(codes).write.mode("append").parquet(source)
    start(valid_per_hour(read_codes(spark, source)), out, log).awaitTermination()
    return spark.read.parquet(out).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "valid", "n")


CODES_PER_HOUR = """
select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_id % 5 <> 0 as valid, count(*) as n
from events where ts is not null group by all
"""


def code_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account codes made from customer keys, and fiscal codes made from the same, spoilt in turn in each way that a verdict names."""
    n, bban = F.col("c_custkey") % 6, F.concat(F.lit("10020030"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    good = F.concat(F.lit("DE"), iban_check_digits("DE", bban), bban)
    last = ((F.right(good, F.lit(1)).cast("int") + 1) % 10).cast("string")
    iban = F.when(n == 1, F.concat(F.left(good, F.lit(21)), last)).when(n == 2, F.left(good, F.lit(21))).when(n == 3, F.concat(F.lit("ZZ"), F.substring(good, 3, 30))).when(n == 4, F.concat(F.left(good, F.lit(21)), F.lit("?"))).when(n == 5, iban_print(F.lower(good))).otherwise(good)
    base = (F.col("c_custkey") + 1000).cast("string")
    digit = (fiscal_control(base) + (n == 1).cast("int")) % 10
    fiscal = F.concat(F.when(n == 2, "ro").when(n == 3, "RO ").otherwise(""), base, F.when(n == 4, "x").otherwise(digit.cast("string")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 50 != 0, iban).alias("iban"), fiscal.alias("fiscal"))
    return rows.select("c_custkey", "iban", iban_verdict(F.col("iban")).alias("iban_verdict"), "fiscal", fiscal_verdict(F.col("fiscal")).alias("fiscal_verdict"))


CODE_VERDICTS = """
with b as (select c_custkey, c_custkey % 6 as n, '10020030' || lpad(c_custkey::varchar, 10, '0') as bban, (c_custkey + 1000)::varchar as base from customer),
g as (select *, 'DE' || lpad((98 - (bban || '131400')::hugeint % 97)::varchar, 2, '0') || bban as good, lpad(base, 9, '0') as p from b),
f as (
  select *, (7 * p[1]::int + 5 * p[2]::int + 3 * p[3]::int + 2 * p[4]::int + p[5]::int + 7 * p[6]::int + 5 * p[7]::int + 3 * p[8]::int + 2 * p[9]::int) * 10 % 11 % 10 as digit from g)
select c_custkey,
  case when c_custkey % 50 = 0 then null when n = 1 then good[:21] || ((good[22]::int + 1) % 10)::varchar when n = 2 then good[:21] when n = 3 then 'ZZ' || good[3:]
    when n = 4 then good[:21] || '?' when n = 5 then trim(regexp_replace(good, '(.{4})', '\\1 ', 'g')) else good end as iban,
  case when c_custkey % 50 = 0 then null when n = 1 then 'wrong_check_digits' when n = 2 then 'wrong_length' when n = 3 then 'unknown_country' when n = 4 then 'malformed' else 'valid' end as iban_verdict,
  case when n = 2 then 'ro' when n = 3 then 'RO ' else '' end || base || case when n = 4 then 'x' when n = 1 then ((digit + 1) % 10)::varchar else digit::varchar end as fiscal,
  case when n = 1 then 'wrong_check_digit' when n = 4 then 'malformed' else 'valid' end as fiscal_verdict
from f
"""


def csv_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts as CSV and back, line breaks and quotes included; every seventh is null and every eleventh empty, and they stay apart."""
    text = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.when(text != "", F.md5(text)).otherwise(text).alias("text"), F.concat(F.lit('"'), F.col("lang"), F.lit('","')).alias("lang"))
    write_csv(rows, path := new_folder(spark))
    return read_csv(spark, path, "key string, text string, lang string")


CSV_NULLS = """
with t as (select doc_id, lang, case when doc_id % 7 = 0 then null when doc_id % 11 = 0 then '' else text end as text from documents)
select doc_id::varchar as key, case when text <> '' then md5(text) else text end as text, '"' || lang || '","' as lang from t
"""


def _order_documents(spark: SparkSession, sf_dir: str, mark: str = "") -> DataFrame:
    """Orders with their lines as an array of structs; columns marked by a prefix are XML attributes."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(f"{mark}key"), F.col("o_orderpriority").alias("priority"), money("o_totalprice").alias("total"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias(f"{mark}number"), F.col("l_partkey").alias("part"), money("l_quantity").alias("quantity"), money("l_extendedprice").alias("price"))
    return nested(orders, lines, f"{mark}key", "l_orderkey", "line")


def _flat(documents: DataFrame, mark: str = "") -> DataFrame:
    """A row for each line of an order, or one, with number and part 0, of an order without lines."""
    rows = documents.select(F.col(f"{mark}key").alias("key"), "priority", "total", F.explode_outer("line").alias("l"))
    return rows.select("key", "priority", F.col("total").cast("double").alias("total"), F.coalesce(f"l.{mark}number", F.lit(0)).alias("number"), F.coalesce("l.part", F.lit(0)).alias("part"), F.col("l.quantity").cast("double").alias("quantity"), F.col("l.price").cast("double").alias("price"))


def orders_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON documents with their lines nested, read back and flattened."""
    made = _order_documents(spark, sf_dir)
    write_json(made, path := new_folder(spark))
    return _flat(spark.read.schema(made.schema).json(path))


def orders_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as XML elements with keys and line numbers as attributes and a repeated element for the lines, read back and flattened."""
    made = _order_documents(spark, sf_dir, "_")
    write_xml(made, path := new_folder(spark), "orders", "order")
    return _flat(spark.read.format("xml").option("rowTag", "order").schema(made.schema).load(path), "_")


ORDER_DOCUMENTS = """
select o_orderkey as key, o_orderpriority as priority, o_totalprice::decimal(18,2)::double as total, coalesce(l_linenumber, 0) as number, coalesce(l_partkey, 0) as part,
  l_quantity::decimal(18,2)::double as quantity, l_extendedprice::decimal(18,2)::double as price
from orders left join lineitem on o_orderkey = l_orderkey
"""


def queries() -> dict:
    return {f.__name__: f for f in (order_reconcile, iban_check, fiscal_check, tax_split, due_dates, csv_round_trip, json_round_trip, xml_round_trip, codes_per_hour, code_verdicts, csv_nulls, orders_json, orders_xml)}


def oracle_sql() -> dict[str, str]:
    return {"order_reconcile": ORDER_RECONCILE, "iban_check": IBAN_CHECK, "fiscal_check": FISCAL_CHECK, "tax_split": TAX_SPLIT, "due_dates": DUE_DATES, "csv_round_trip": ROUND_TRIP, "json_round_trip": ROUND_TRIP, "xml_round_trip": ROUND_TRIP, "codes_per_hour": CODES_PER_HOUR, "code_verdicts": CODE_VERDICTS, "csv_nulls": CSV_NULLS, "orders_json": ORDER_DOCUMENTS, "orders_xml": ORDER_DOCUMENTS}
