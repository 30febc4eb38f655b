"""Sizes as text, at and beyond the largest unit."""

from conftest import SF
from pyspark.sql import functions as F

from tallyrill.functions import records as R
from tallyrill.plans import catalog


def test_batch_ratios_of_large_batches(spark, duck, same_rows, tmp_path):
    """Squares of 1 TiB and more, which sf0.001 has none of; the SQL ends at GiB."""
    keys = [0, 3, 32, 10485, 10486, 15000, 900000, None]
    spark.createDataFrame(list(enumerate(keys, 1)), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    sql = catalog.ORACLE_SQL["batch_ratios"].replace(" FROM orders", f" FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    same_rows(catalog.QUERIES["batch_ratios"](spark, str(tmp_path)), sql)


def test_human_bytes(spark, duck):
    """printf's decimals of the double, halves to even; no text for null."""
    tie = 1024**4 // 20 * 2049
    sizes = [0, 1023, 1024, 1075, 1076, 1088, 1152, 1177, 1024**2 - 1, 1024**3 - 1, 1024**4 - 1, 1024**4, 1024**4 * 5 // 4, tie, tie + 1, 2**53 + 1, 2**62 + 3]
    got = dict(spark.createDataFrame([(n,) for n in [*sizes, None]], "n long").select("n", R.human_bytes(F.col("n"))).collect())

    def want(n):
        k = min(sum(n >= 1024**j for j in range(1, 5)), 4)
        return f"{n} B" if k == 0 else f"{n / 1024**k:.1f} {R.BYTE_UNITS[k]}"

    assert got == {n: want(n) for n in sizes} | {None: None}
