"""The given tables seen as landings, factors, members and code dictionaries.

Parts stand for products (brand = taxon, type = presentation), suppliers for
vessels, customers for ports, and the price of a part for a factor of the
nation its size points to.  Each view exists as a DataFrame and as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tareline import vocab
from tareline.operators.joins import semi_keys


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nation_code(c: Column | str) -> Column:
    return F.concat(F.lit("N"), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))


def form(fine: bool) -> Column:
    """Presentation of a part: its type, or type and noun of its name."""
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    return F.concat_ws(" ", "p_type", noun) if fine else F.col("p_type")


def tariff_code() -> Column:
    """Six digits that stand for a traded product."""
    sub = F.lpad((F.col("p_partkey") % 7 * 10 + 11).cast("string"), 2, "0")
    return F.concat(F.lit("0"), (301 + F.col("p_size") % 5).cast("string"), sub)


def landings(spark: SparkSession, sf: str, port: bool = False, fine: bool = False,
             products: DataFrame | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Lineitems as landed quantities; ``port`` adds the customer's nation.

    Codes and labels are built on the small sides, once per part or vessel.
    ``products`` (scientific_name, landings_code) restricts the parts before
    any line is joined, ``years`` (first, last) the dates read by the scan.
    """
    line = table(spark, sf, "lineitem")
    if years is not None:
        line = line.where(f"l_shipdate >= make_date({years[0]}, 1, 1) AND l_shipdate < make_date({years[1] + 1}, 1, 1)")
    part = table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("scientific_name"), form(fine).alias("presentation"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("common_name"),
        tariff_code().alias("code"))
    if products is not None:
        part = semi_keys(part, products, {"scientific_name": "scientific_name", "presentation": "landings_code"})
    supplier = table(spark, sf, "supplier").select("s_suppkey", nation_code("s_nationkey").alias("iso3c"))
    rows = line.join(part, F.expr("l_partkey = p_partkey")).join(supplier, F.expr("l_suppkey = s_suppkey"))
    if port:
        orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
        customer = table(spark, sf, "customer").select("c_custkey", nation_code("c_nationkey").alias("port_iso3c"),
                                                         F.concat(F.lit("Port "), F.col("c_mktsegment")).alias("reporting_entity"))
        # Orders meet their customers first, so the lines are shuffled for one join less.
        ports = orders.join(customer, F.expr("o_custkey = c_custkey"))
        rows = rows.join(ports, F.expr("l_orderkey = o_orderkey"))
    return rows.select(
        "scientific_name",
        "presentation",
        "iso3c",
        "common_name",
        "code",
        *(["port_iso3c", "reporting_entity"] if port else []),
        F.year("l_shipdate").alias("year"),
        F.col("l_returnflag").alias("use"),
        F.col("l_linestatus").alias("unit"),
        F.col("l_quantity").alias("value"),
        F.col("l_extendedprice").alias("price"),
    )


def factors(spark: SparkSession, sf: str, fine: bool = False, affiliation: bool = False) -> DataFrame:
    """Parts as conversion factors; nation 0 stands for the bloc.

    ``affiliation`` adds whether the nation belongs to the bloc.
    """
    rows = table(spark, sf, "part")
    key = F.col("p_size") % 25
    wide = key == 0
    belongs = []
    if affiliation:
        nation = table(spark, sf, "nation").join(
            table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
        rows = rows.join(nation, key == F.col("n_nationkey"), "left")
        belongs = [F.when(wide | (F.col("r_name") == "EUROPE"), "EU")
                   .when(F.col("r_name") == "MIDDLE EAST", "European, non-EU")
                   .otherwise("other").alias("continent_affiliation")]
    return rows.select(
        F.col("p_partkey"),
        tariff_code().alias("code"),
        F.col("p_brand").alias("scientific_name"),
        form(fine).alias("landings_code"),
        F.when(wide, vocab.WIDE_CODE).otherwise(nation_code(key)).alias("iso3c"),
        F.round(1 + (F.col("p_retailprice") - 900) / 100, 3).alias("conversion_factor"),
        F.when(wide, vocab.WIDE_CF).otherwise(vocab.NATIONAL_CF).alias("implementation"),
        *belongs,
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("reference"),
    )


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of the nations of one region, the bloc."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey).where("r_name = 'EUROPE'")
            .select(nation_code("n_nationkey").alias("iso3c")))


SQL_VIEWS = {
    "lv": """
        SELECT p_brand AS scientific_name, p_type AS presentation, 'N' || CAST(s_nationkey AS VARCHAR) AS iso3c,
               CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS use, l_linestatus AS unit,
               l_quantity AS value, l_extendedprice AS price, split_part(p_name, ' ', 2) AS common_name
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "lvp": """
        SELECT p_brand AS scientific_name, p_type AS presentation, 'N' || CAST(s_nationkey AS VARCHAR) AS iso3c,
               'N' || CAST(c_nationkey AS VARCHAR) AS port_iso3c, split_part(p_name, ' ', 2) AS common_name,
               '0' || CAST(301 + p_size % 5 AS VARCHAR) || lpad(CAST(p_partkey % 7 * 10 + 11 AS VARCHAR), 2, '0') AS code,
               'Port ' || c_mktsegment AS reporting_entity,
               CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS use, l_linestatus AS unit,
               l_quantity AS value, l_extendedprice AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
             JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "fv": """
        SELECT p_partkey, p_brand AS scientific_name, p_type AS landings_code,
               '0' || CAST(301 + p_size % 5 AS VARCHAR) || lpad(CAST(p_partkey % 7 * 10 + 11 AS VARCHAR), 2, '0') AS code,
               CASE WHEN p_size % 25 = 0 THEN 'EU' ELSE 'N' || CAST(p_size % 25 AS VARCHAR) END AS iso3c,
               round(1 + (p_retailprice - 900) / 100, 3) AS conversion_factor,
               CASE WHEN p_size % 25 = 0 THEN 'EU-wide CF' ELSE 'national CF' END AS implementation,
               CASE WHEN p_size % 25 = 0 OR r_name = 'EUROPE' THEN 'EU'
                    WHEN r_name = 'MIDDLE EAST' THEN 'European, non-EU' ELSE 'other' END AS continent_affiliation,
               split_part(p_name, ' ', 1) AS reference
        FROM part LEFT JOIN nation ON p_size % 25 = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "mv": """
        SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS iso3c
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'""",
    # One factor per product and nation: the exact mean, rounded to four places.
    "cv": """
        SELECT scientific_name, landings_code, iso3c,
               floor(CAST(sum(CAST(conversion_factor AS DECIMAL(18,6))) AS DOUBLE) / count(conversion_factor)
                     * 10000.0 + 0.5) / 10000.0 AS conversion_factor
        FROM (SELECT p_brand AS scientific_name, p_type AS landings_code,
                     CASE WHEN p_size % 25 = 0 THEN 'EU' ELSE 'N' || CAST(p_size % 25 AS VARCHAR) END AS iso3c,
                     round(1 + (p_retailprice - 900) / 100, 3) AS conversion_factor
              FROM part) GROUP BY ALL""",
}
