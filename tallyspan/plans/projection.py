"""Bank and ledger transactions projected from orders and customers.

Every order is a payment; its key modulo 20 decides what its two records look like: bank
only, ledger only, late, net of a fee, paid twice, reversed, without evidence, or clean.
SQL below says the same in DuckDB's dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TXN = ["id", "ord", "source", "date", "amount", "description", "reference", "alt_references"]


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    amount = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("long").alias("k"), (F.col("o_orderkey") % 20).cast("int").alias("c"), F.col("o_custkey").cast("long").alias("customer"),
        F.to_date("o_orderdate").alias("d"), amount.cast("decimal(18,2)").alias("a"), F.substring(F.md5("c_name"), 1, 8).alias("p"),
    )


def _leg(rows: DataFrame, source: str, name: str, leg: int, date, amount, description, reference) -> DataFrame:
    return rows.select(
        F.concat(F.lit(name), F.col("k")).alias("id"), (F.col("k") * 4 + leg).alias("ord"), F.lit(source).alias("source"), date.alias("date"),
        amount.cast("decimal(18,2)").alias("amount"), description.alias("description"), reference.alias("reference"), F.array().cast("array<string>").alias("alt_references"),
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payments(spark, sf_dir)
    neft = F.concat(F.lit("NEFT/NFT"), "k", F.lit("/"), F.upper("p"))
    ref = F.concat(F.lit("NFT"), "k")
    main = _leg(rows.where("c <> 1"), "bank", "B", 0, F.col("d"), F.col("a"), F.when(F.col("c") == 8, "SMS ALERT CHRG Q2").otherwise(neft), F.when(~F.col("c").isin(8, 9), ref))
    twice = _leg(rows.where("c in (4, 5)"), "bank", "BD", 1, F.date_add("d", 1), F.col("a"), neft, F.concat(ref, F.lit("D")))
    back = _leg(rows.where("c = 7"), "bank", "BR", 2, F.date_add("d", 2), -F.col("a"), F.concat(neft, F.lit("/REVERSAL")), F.concat(ref, F.lit("R")))
    return main.unionByName(twice).unionByName(back)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payments(spark, sf_dir)
    ref = F.concat(F.lit("NFT"), "k")
    lag = F.when(F.col("c") == 2, 5).when(F.col("c") == 6, 30).when(F.col("c").isin(3, 4, 5), 0).otherwise((F.col("k") % 4).cast("int"))
    words = F.when(F.col("c") == 9, "Sundry adjustment").otherwise(F.concat(F.lit("Payment to "), "p", F.lit(" invoice")))
    amount = F.col("a") + F.when(F.col("c") == 3, 25).otherwise(0)
    main = _leg(rows.where("c not in (0, 8)"), "ledger", "L", 0, F.date_add("d", lag), amount, words, F.when(~F.col("c").isin(3, 9), ref))
    twice = _leg(rows.where("c = 4"), "ledger", "LD", 1, F.date_add("d", 1), F.col("a"), words, F.concat(ref, F.lit("D")))
    return main.unionByName(twice)


#: The same rows for DuckDB: common table expressions to stand after WITH.
SQL = """
payments AS (SELECT o_orderkey::BIGINT AS k, (o_orderkey % 20)::INT AS c, o_custkey::BIGINT AS customer, o_orderdate::DATE AS d,
    CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS a, substr(md5(c_name), 1, 8) AS p
    FROM orders JOIN customer ON o_custkey = c_custkey),
bank AS MATERIALIZED (
    SELECT 'B' || k AS id, k * 4 AS ord, 'bank' AS source, d AS date, a AS amount,
        CASE WHEN c = 8 THEN 'SMS ALERT CHRG Q2' ELSE 'NEFT/NFT' || k || '/' || upper(p) END AS description,
        CASE WHEN c NOT IN (8, 9) THEN 'NFT' || k END AS reference FROM payments WHERE c <> 1
    UNION ALL SELECT 'BD' || k, k * 4 + 1, 'bank', d + 1, a, 'NEFT/NFT' || k || '/' || upper(p), 'NFT' || k || 'D' FROM payments WHERE c IN (4, 5)
    UNION ALL SELECT 'BR' || k, k * 4 + 2, 'bank', d + 2, -a, 'NEFT/NFT' || k || '/' || upper(p) || '/REVERSAL', 'NFT' || k || 'R' FROM payments WHERE c = 7),
ledger AS MATERIALIZED (
    SELECT 'L' || k AS id, k * 4 AS ord, 'ledger' AS source,
        d + CASE WHEN c = 2 THEN 5 WHEN c = 6 THEN 30 WHEN c IN (3, 4, 5) THEN 0 ELSE (k % 4)::INT END AS date,
        (a + CASE WHEN c = 3 THEN 25 ELSE 0 END)::DECIMAL(18,2) AS amount,
        CASE WHEN c = 9 THEN 'Sundry adjustment' ELSE 'Payment to ' || p || ' invoice' END AS description,
        CASE WHEN c NOT IN (3, 9) THEN 'NFT' || k END AS reference FROM payments WHERE c NOT IN (0, 8)
    UNION ALL SELECT 'LD' || k, k * 4 + 1, 'ledger', d + 1, a, 'Payment to ' || p || ' invoice', 'NFT' || k || 'D' FROM payments WHERE c = 4)
"""
