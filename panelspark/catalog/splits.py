"""Time splits and their audit."""

from __future__ import annotations

from panelspark.catalog.base import SPLIT_DATE, TEST_FRACTION, panel, query, with_ctes
from panelspark.config import SKU_KEYS
from panelspark.operators import splits

_KEEP = 1 - TEST_FRACTION
_AT = f"least(CAST(floor(len(days) * CAST({_KEEP} AS DOUBLE)) AS INTEGER) + 1, len(days))"
_OWN = f"""
    SELECT productID, storeID, days[{_AT}] AS split_date FROM (
      SELECT productID, storeID, list(DISTINCT date ORDER BY date) AS days FROM panel GROUP BY ALL) t"""
_MARK = "CASE WHEN p.date < {cut} THEN 'train' ELSE 'test' END AS split"


@query(with_ctes(f"""
    SELECT p.bdID, p.productID, p.storeID, p.date, c.split_date, {_MARK.format(cut='c.split_date')}
    FROM panel p JOIN cuts c USING (productID, storeID)""", "panel", cuts=_OWN))
def split_by_fraction(spark, sf):
    marked = splits.by_fraction(panel(spark, sf), TEST_FRACTION, list(SKU_KEYS))
    return marked.select("bdID", *SKU_KEYS, "date", "split_date", "split")


@query(with_ctes(f"""
    SELECT p.bdID, p.date, c.split_date, {_MARK.format(cut='c.split_date')} FROM panel p, cuts c""", "panel",
    cuts=f"SELECT days[{_AT}] AS split_date FROM (SELECT list(DISTINCT date ORDER BY date) AS days FROM panel) t"))
def split_by_fraction_combined(spark, sf):
    marked = splits.by_fraction(panel(spark, sf), TEST_FRACTION, [])
    return marked.select("bdID", "date", "split_date", "split")


@query(with_ctes(f"SELECT p.bdID, p.date, {_MARK.format(cut=f'''DATE '{SPLIT_DATE}' ''')} FROM panel p", "panel"))
def split_by_date(spark, sf):
    return splits.by_date(panel(spark, sf), SPLIT_DATE).select("bdID", "date", "split")


@query(with_ctes("""
    SELECT productID, storeID, count(*) AS n_rows, count(DISTINCT bdID) AS n_ids,
           count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
           max(date) FILTER (WHERE split = 'train') AS last_train,
           min(date) FILTER (WHERE split = 'test') AS first_test,
           n_train + n_test = n_rows AS covers_all, n_ids = n_rows AS disjoint,
           coalesce(last_train < first_test, true) AS in_order
    FROM (SELECT p.*, CASE WHEN p.date < c.split_date THEN 'train' ELSE 'test' END AS split
          FROM panel p JOIN cuts c USING (productID, storeID)) s GROUP BY productID, storeID""",
    "panel", cuts=_OWN))
def split_audit(spark, sf):
    marked = splits.by_fraction(panel(spark, sf), TEST_FRACTION, list(SKU_KEYS))
    return splits.audit(marked, list(SKU_KEYS))
