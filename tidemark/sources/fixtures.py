"""Small literal tables for semantics that the star schema doesn't hold; their VALUES text is valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (columns with types, VALUES rows)
FIXTURES = {
    "fx_splits": ("code string, dt date, ratio double", "('A','2020-01-10',2.0),('A','2020-03-02',3.0),('A','2020-06-01',0.00000005),('B','2020-02-03',0.1),('B','2020-05-04',1500.0)"),
    "fx_bars": (
        "code string, dt date, open double, high double, low double, close double, volume double, dividend double, split double",
        "('A','2020-01-06',100,110,95,105,1000,0,0),('A','2020-01-07',105,108,101,102,900,0,0),('A','2020-01-08',51,55,50,53,2100,0,2),('A','2020-01-09',53,52,54,53,0,0,0),"
        "('A','2020-01-10',54,60,53,59,1500,1.5,0),('A','2020-01-14',59,61,58,60,1200,0,0),('B','2020-01-06',2000,2100,1990,2050,10,0,0),('B','2020-01-07',2050,2060,900,910,15,700,0),"
        "('B','2020-01-08',905,-1,900,902,12,0,0),('B','2020-01-09',NULL,NULL,NULL,NULL,NULL,0,0),('B','2020-01-11',910,915,905,912,9,0,0),('B','2020-01-14',920,930,915,925,20,0,0.5),"
        "('B','2020-01-14',920,930,915,925,20,0,0),('C','2020-01-07',10,11,9,10,500,0,0),('C','2020-01-08',10,18,10,17,800,0,0),('C','2020-01-10',17,17,17,17,300,0,0)",
    ),
    "fx_holidays": ("dt date", "('1995-05-01'),('1996-01-01'),('1996-07-04'),('1998-12-25'),('2000-02-29')"),
    "fx_events": (
        "dt date, out_code string, in_code string",
        "('2020-01-15','B','E'),('2020-03-02','C',NULL),('2020-03-02',NULL,'F'),('2020-06-01','E','C'),('2020-09-01','F','B'),('2020-09-01','D','G')",
    ),
    "fx_members": ("code string", "('A'),('B'),('C'),('G')"),
    "fx_base": ("base double", "(NULL),(0.0),(99.999),(100.0),(199.0),(200.0),(999.99),(1000.0),(2999.0),(3000.0),(49999.0),(50000.0),(999999.0),(1000000.0),(50000000.0),(1e12)"),
    "fx_adv": ("adv double", "(NULL),(0.0),(99999999.0),(100000000.0),(299999999.0),(300000000.0),(999999999.0),(1000000000.0),(5e10)"),
    "fx_spec": ("spec string", "('M4r|N10|K3|th0.2|g0.05|none'),('M1|N1|K10|th0.01|gNone|idx_above_sma200'),('M2a|N20|K5|th0.1|g0.08|idx_vol_below_p80')"),
}


def select(name: str, quoted_types: bool = False) -> str:
    """A SELECT of the fixture."""
    columns, rows = FIXTURES[name]
    cols = [c.split() for c in columns.split(", ")]
    picked = ", ".join(f"cast(c{i} as {'varchar' if t == 'string' else t}) as {n}" if quoted_types else f"cast(c{i} as {t}) as {n}" for i, (n, t) in enumerate(cols))
    return f"select {picked} from (values {rows}) as v({', '.join(f'c{i}' for i in range(len(cols)))})"


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(select(name))


def cte(*names: str) -> str:
    return ", ".join(f"{n} as ({select(n, quoted_types=True)})" for n in names)
