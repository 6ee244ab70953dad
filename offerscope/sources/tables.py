"""Offers derived from the benchmark tables.

The mapping below is one set of expressions that both engines understand, so the SQL checks and
the Spark queries start from the same rows. It only prepares input; no operator lives here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETAILER_EXPR = """CASE s_suppkey WHEN 0 THEN 'Home Store' WHEN 1 THEN 'MediaMarkt'
 WHEN 2 THEN 'Samsung Store' WHEN 3 THEN 'Apple Store' WHEN 4 THEN 'El Corte Inglés'
 WHEN 5 THEN 'Amazon' WHEN 6 THEN 'Movistar' WHEN 7 THEN 'Grover' WHEN 8 THEN 'Rentik'
 WHEN 9 THEN 'Orange' ELSE s_name END"""
CANONICAL_RETAILER_EXPR = """CASE s_suppkey WHEN 0 THEN 'Home Store' WHEN 1 THEN 'Media Markt'
 WHEN 2 THEN 'Samsung Oficial' WHEN 3 THEN 'Apple Oficial' WHEN 4 THEN 'El Corte Ingles'
 WHEN 5 THEN 'Amazon' WHEN 6 THEN 'Movistar' WHEN 7 THEN 'Grover' WHEN 8 THEN 'Rentik'
 WHEN 9 THEN 'Orange' ELSE s_name END"""
SLUG_EXPR = """CASE s_suppkey WHEN 1 THEN 'mediamarkt' WHEN 2 THEN 'samsung_store'
 WHEN 3 THEN 'apple_store' ELSE 'shop_' || CAST(s_suppkey AS STRING) END"""
PRICE_EXPR = """CAST(floor((CAST(round(l_extendedprice * 100) AS BIGINT) * 100)
 / CAST(l_quantity AS BIGINT)) / 1e4 AS DECIMAL(18,4))"""
MODEL_EXPR = """p_name || CASE p_partkey % 7 WHEN 0 THEN ' pro' WHEN 1 THEN ' ultra'
 WHEN 2 THEN ' WiFi' WHEN 3 THEN ' 5G' ELSE '' END || ' ' || CAST(p_partkey AS STRING)"""
CAPACITY_EXPR = """CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 64
 WHEN p_size % 5 = 1 THEN 128 WHEN p_size % 5 = 2 THEN 256 WHEN p_size % 5 = 3 THEN 512
 ELSE 1024 END"""
MODALITY_EXPR = """CASE WHEN l_returnflag = 'R' THEN 'cash' WHEN l_returnflag = 'A'
 THEN 'financing_max_term' WHEN l_linestatus = 'O' THEN 'renting_with_insurance'
 ELSE 'renting_no_insurance' END"""
DEVICE_EXPR = """CASE p_type WHEN 'ECONOMY' THEN 'tablet' WHEN 'LARGE' THEN 'laptop'
 WHEN 'SMALL' THEN '' ELSE 'mobile' END"""
SHIP_DAY = "substr(CAST(l_shipdate AS STRING), 1, 10)"
ORDERING = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)

# Typed offers, as a published snapshot would hold them. A few prices are missing on purpose.
OFFER_COLUMNS = {
    "country": "'ES'",
    "retailer": CANONICAL_RETAILER_EXPR,
    "retailer_slug": SLUG_EXPR,
    "product_family": "p_brand",
    "brand": "p_brand",
    "device_type": f"CASE WHEN {DEVICE_EXPR} = '' THEN 'mobile' ELSE {DEVICE_EXPR} END",
    "model": MODEL_EXPR,
    "capacity_gb": f"CAST({CAPACITY_EXPR} AS INT)",
    "product_code": "'SM-A' || CAST(p_partkey AS STRING)",
    "offer_type": MODALITY_EXPR,
    "price_value": f"CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE {PRICE_EXPR} END",
    "price_text": f"CAST({PRICE_EXPR} AS STRING) || ' EUR'",
    "price_unit": "CASE WHEN l_returnflag = 'R' THEN 'EUR' ELSE 'EUR/month' END",
    "term_months": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_linenumber * 6 AS INT) END",
    "in_stock": "CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_linestatus = 'O' END",
    "data_quality_tier": """CASE l_suppkey % 3 WHEN 0 THEN 'api_live' WHEN 1 THEN 'embedded_json'
 ELSE 'adapter_live' END""",
    "price_capture_kind": """CASE l_suppkey % 3 WHEN 0 THEN 'api_exact'
 WHEN 1 THEN 'embedded_json_exact' ELSE 'visible_dom' END""",
    "extracted_at": f"{SHIP_DAY} || 'T08:00:00+00:00'",
    "source_url": """'https://shop' || CAST(s_suppkey AS STRING) || '.example/p/'
 || CAST(p_partkey AS STRING)""",
    "source_title": MODEL_EXPR,
    "source_snapshot": "''",
    "source_snapshots": "''",
    "snapshot_id": "substr(CAST(l_shipdate AS STRING), 1, 7)",
}

# Untyped offers as they arrive: text everywhere, defects that each gate rule has to catch.
RAW_COLUMNS = dict(
    OFFER_COLUMNS,
    country="CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'ES' END",
    retailer=RETAILER_EXPR,
    product_family="CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END",
    device_type=DEVICE_EXPR,
    capacity_gb=f"""CASE WHEN ({CAPACITY_EXPR}) IS NULL THEN '' WHEN p_partkey % 2 = 0
 THEN CAST(({CAPACITY_EXPR}) AS STRING) || '.0' ELSE CAST(({CAPACITY_EXPR}) AS STRING) END""",
    price_value=f"""CASE WHEN l_orderkey % 97 = 0 THEN '' WHEN l_orderkey % 89 = 0 THEN '0'
 WHEN l_orderkey % 83 = 0 THEN 'consultar' WHEN l_suppkey % 2 = 0
 THEN replace(CAST({PRICE_EXPR} AS STRING), '.', ',') ELSE CAST({PRICE_EXPR} AS STRING) END""",
    price_text=f"""CAST({PRICE_EXPR} AS STRING) || CASE WHEN l_orderkey % 37 = 0
 THEN ' EUR con portabilidad' WHEN l_orderkey % 41 = 0 THEN ' EUR (cash / 36)' ELSE ' EUR' END""",
    term_months="""CASE WHEN l_returnflag = 'R' THEN '' WHEN l_linenumber = 3 THEN '18.0'
 ELSE CAST(l_linenumber * 6 AS STRING) END""",
    in_stock="""CASE WHEN l_orderkey % 19 = 0 THEN '' WHEN l_linestatus = 'O' THEN 'True'
 WHEN l_linenumber = 2 THEN 'no' ELSE 'False' END""",
    data_quality_tier="""CASE l_suppkey % 5 WHEN 0 THEN 'api_live' WHEN 1 THEN 'embedded_json'
 WHEN 2 THEN 'adapter_live' WHEN 3 THEN CASE WHEN l_linenumber = 5 THEN 'precio calculado'
 ELSE '' END ELSE 'dom' END""",
    price_capture_kind="""CASE l_linenumber WHEN 1 THEN 'visible' WHEN 2 THEN 'API'
 WHEN 3 THEN 'Embedded-JSON' WHEN 4 THEN 'api_exact' WHEN 5 THEN 'unknown' ELSE '' END""",
    source_url="""CASE WHEN l_orderkey % 101 = 0 THEN '' ELSE 'https://shop'
 || CAST(s_suppkey AS STRING) || '.example/p/' || CASE WHEN l_linenumber = 4
 THEN 'sm-a' || CAST(p_partkey AS STRING) ELSE CAST(p_partkey AS STRING) END END""",
    source_title=f"""CASE WHEN l_orderkey % 101 = 0 AND l_orderkey % 2 = 0 THEN ''
 WHEN l_orderkey % 13 = 0 THEN 'Funda ' || {MODEL_EXPR}
 WHEN l_orderkey % 17 = 0 THEN {MODEL_EXPR} || ' Plan  Renové'
 WHEN l_orderkey % 23 = 0 THEN {MODEL_EXPR} || ' 2tb'
 WHEN l_orderkey % 29 = 0 THEN {MODEL_EXPR} || ' mini'
 WHEN l_orderkey % 31 = 0 THEN {MODEL_EXPR} || ' Wi-Fi '
 WHEN l_orderkey % 43 = 0 THEN {MODEL_EXPR} || ' LTE'
 WHEN l_orderkey % 47 = 0 THEN 'artículo reacondicionado'
 WHEN ({CAPACITY_EXPR}) IS NOT NULL AND l_orderkey % 2 = 0
 THEN {MODEL_EXPR} || ' ' || CAST(({CAPACITY_EXPR}) AS STRING) || ' GB'
 ELSE {MODEL_EXPR} END""",
)

_FROM = "lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"


def _sql_of(columns: dict[str, str]) -> str:
    body = ",\n  ".join(f"{expr} AS {name}" for name, expr in columns.items())
    order = ", ".join(ORDERING)
    return f"SELECT {body},\n  row_number() OVER (ORDER BY {order}) AS _ord\nFROM {_FROM}"


def offers_sql() -> str:
    """The derived offers for the SQL side of a check; ``_ord`` is the same total order."""
    return _sql_of(OFFER_COLUMNS)


def raw_offers_sql() -> str:
    return _sql_of(RAW_COLUMNS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute an input too small to occupy the cluster; larger inputs stay as they are.

    A file with a single row group is one task however many cores there are. At scale an input has
    far more splits than cores, so no shuffle is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Parts of the mapping that hang on one product or seller: worked out once for each of them, before the join. All in
# one place they made a generated method too long to be compiled.
OF_PART = {"_model": MODEL_EXPR, "_capacity": CAPACITY_EXPR, "_device": DEVICE_EXPR, "_part": "CAST(p_partkey AS STRING)"}
OF_SUPPLIER = {"_seller": RETAILER_EXPR, "_canonical_seller": CANONICAL_RETAILER_EXPR, "_slug": SLUG_EXPR, "_shop": "CAST(s_suppkey AS STRING)"}
OF_LINE = {"_price": PRICE_EXPR}


def _derive(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    def with_parts(df: DataFrame, parts: dict[str, str]) -> DataFrame:
        return df.withColumns({name: F.expr(expr) for name, expr in parts.items()})

    rows = (
        spread(read_table(spark, sf_dir, "lineitem"))
        .join(with_parts(read_table(spark, sf_dir, "part"), OF_PART), F.col("l_partkey") == F.col("p_partkey"))
        .join(with_parts(read_table(spark, sf_dir, "supplier"), OF_SUPPLIER), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    short = dict(columns)
    for name, expr in (OF_PART | OF_SUPPLIER | OF_LINE).items():
        short = {column: own.replace(expr, name) for column, own in short.items()}
    return with_parts(rows, OF_LINE).select(
        *[F.expr(expr).alias(name) for name, expr in short.items()],
        F.struct(*ORDERING).alias("_ord"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed offers; ``_ord`` is an explicit arrival order that survives any shuffle."""
    return _derive(spark, sf_dir, OFFER_COLUMNS)


def raw_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, RAW_COLUMNS)
