"""One query per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tareline import vocab
from tareline.functions.flags import flag_letters, flagged_value
from tareline.functions.nulls import max_of, min_of, paste, sum_of
from tareline.functions.recode import first_match, last_match, recode
from tareline.functions.text import (
    clean_taxon,
    first_dot_removed,
    name_key,
    product_code,
    sentence_case,
    without_commas,
)
from tareline.operators import aggregate, checks, filters, joins, lookup, ranking, reshape, sets
from tareline.registry.base import query, sql
from tareline.registry.fixtures import SQL_CELLS, calendar, wide_cells, write_wide
from tareline.registry.views import factors, landings, members, nation_code, table
from tareline.session import materialise, new_scratch_path
from tareline.sources.tables import curation_worklist, read_csv_table, write_safe_csv
from tareline.sources.wide import read_wide_flagged

PRODUCT = ["scientific_name", "presentation"]
CODE = ["scientific_name", "landings_code"]
ON_PRODUCT = {"scientific_name": "scientific_name", "presentation": "landings_code"}


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles to four places, so both engines agree on the value."""
    return df.withColumns({c: F.round(c, 4) for c in columns})


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return landings(spark, sf).groupBy(*PRODUCT, "iso3c", "year").agg(F.sum("value").alias("landings"))


SQL_PANEL = """panel AS (SELECT scientific_name, presentation, iso3c, year, sum(value) AS landings
                         FROM lv GROUP BY ALL)"""


# Sources and sinks

WIDE_KEYS = ["scientific_name", "presentation", "unit", "iso3c"]


@query("read_wide_flagged", sql(
    "lv", "SELECT scientific_name AS species, presentation AS pres, unit, iso3c AS geo, year, value, flag FROM cells",
    SQL_CELLS.format(keys=", ".join(WIDE_KEYS), source="lv")))
def read_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = wide_cells(landings(spark, sf), WIDE_KEYS, "value", calendar(table(spark, sf, "lineitem")))
    path = write_wide(wide, WIDE_KEYS, "species,pres,unit,geo\\time", "wide")
    return reshape.unpack_years(read_wide_flagged(spark, path, source_file=None))


@query("union_sources", """
    SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity,
           CAST(sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS BIGINT) AS n_tax
    FROM lineitem GROUP BY l_returnflag""")
def union_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_tax")
    a, r = (line.where(F.col("l_returnflag") == f) for f in ("A", "R"))
    n = line.where("l_returnflag = 'N'").drop("l_tax")
    both = sets.union_sources(a, r, n, allow_missing=True)
    return both.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.count("l_tax").alias("n_tax"))


@query("decode_codes", """
    SELECT c_custkey, coalesce(d.n_name, CAST(c_nationkey AS VARCHAR)) AS nation,
           CAST(c_nationkey AS VARCHAR) AS nation_code, coalesce(g.label, c_mktsegment) AS segment,
           c_mktsegment AS segment_code
    FROM customer
    LEFT JOIN (SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
               WHERE r_name <> 'ASIA') d ON c_nationkey = d.n_nationkey
    LEFT JOIN (VALUES ('MACHINERY', 'Machines'), ('BUILDING', 'Buildings')) g(code, label) ON c_mktsegment = g.code""")
def decoded(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    nations = nation.where("r_name <> 'ASIA'").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    segments = spark.sql("SELECT * FROM VALUES ('MACHINERY', 'Machines'), ('BUILDING', 'Buildings') AS t(code, label)")
    coded = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return lookup.decode_codes(coded, {"nation": nations, "segment": segments}, code_suffix="_code")


@query("read_csv_table", """
    SELECT p_partkey, p_retailprice AS price,
           'The "' || p_name || '", sold' || chr(10) || chr(10) || 'as ' || p_type AS explanation FROM part""")
def csv_table(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit('The "'), "p_name", F.lit('", sold\n\nas '), "p_type").alias("explanation")
    path = new_scratch_path(spark, "csv")
    table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"), text).write.options(
        header=True, escape='"').csv(path)
    return read_csv_table(spark, path, "p_partkey bigint, price double, explanation string", multiline=True)


@query("write_safe_csv", """
    SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand || ' ' || p_type AS label,
           CASE WHEN p_type = 'PROMO' THEN 'NA' ELSE p_name END AS note FROM part""")
def safe_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = new_scratch_path(spark, "safe")
    shape = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(", ", "p_brand", "p_type").alias("label"),
        F.when(F.col("p_type") != "PROMO", F.col("p_name")).alias("note"))
    write_safe_csv(shape, path)
    return read_csv_table(spark, path, "p_partkey string, label string, note string")


@query("curation_roundtrip", """
    SELECT DISTINCT p_brand || ' ' || p_name AS type_of_processing FROM part
    WHERE p_brand || ' ' || p_name NOT IN (SELECT p_brand || ' ' || p_name FROM part WHERE p_type = 'PROMO')""")
def curation(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("type_of_processing"), "p_type")
    return curation_worklist(texts, "type_of_processing", texts.where("p_type = 'PROMO'"))


# Projections and scalar expressions

@query("project_rename", "SELECT s_suppkey AS vessel, s_nationkey AS nationality, s_acctbal AS balance FROM supplier")
def renamed(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.project_rename(table(spark, sf, "supplier"),
                                 {"s_suppkey": "vessel", "s_nationkey": "nationality", "s_acctbal": "balance"})


def consolidated(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.consolidate_factors(factors(spark, sf), [*CODE, "iso3c"], digits=4)


@query("apply_factor", sql("lv cv", """
    SELECT scientific_name, presentation, iso3c, year, landings, national_CF, EU_CF,
           round(landings * national_CF, 4) AS catch_by_national_CF, round(landings * EU_CF, 4) AS catch_by_EU_CF
    FROM panel
    LEFT JOIN (SELECT scientific_name, landings_code AS presentation, iso3c, conversion_factor AS national_CF FROM cv)
         USING (scientific_name, presentation, iso3c)
    LEFT JOIN (SELECT scientific_name, landings_code AS presentation, conversion_factor AS EU_CF
               FROM cv WHERE iso3c = 'EU') USING (scientific_name, presentation)""", SQL_PANEL))
def applied(spark: SparkSession, sf: str) -> DataFrame:
    own = consolidated(spark, sf)
    matched = joins.match_factor(panel(spark, sf), own, {**ON_PRODUCT, "iso3c": "iso3c"}, into="national_CF")
    matched = joins.match_factor(matched, own.where("iso3c = 'EU'"), ON_PRODUCT, into="EU_CF")
    products = {"catch_by_national_CF": "national_CF", "catch_by_EU_CF": "EU_CF"}
    return rounded(joins.apply_factor(matched, "landings", products), *products)


@query("recode_literal", """
    SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'first' WHEN '2-HIGH' THEN 'second' ELSE 'none' END AS rank,
           CASE o_orderstatus WHEN 'F' THEN 'final' ELSE o_orderstatus END AS status, count(*) AS n
    FROM orders GROUP BY ALL""")
def recoded(spark: SparkSession, sf: str) -> DataFrame:
    rank = recode("o_orderpriority", {"1-URGENT": "first", "2-HIGH": "second"}, "none")
    status = recode("o_orderstatus", {"F": "final"})
    return table(spark, sf, "orders").groupBy(rank.alias("rank"), status.alias("status")).agg(F.count("*").alias("n"))


@query("recode_regex", r"""
    SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\bold\b|ancient') THEN 'Old'
                           WHEN regexp_matches(p_name, 'ring') THEN 'Ring'
                           WHEN regexp_matches(p_name, 'r') THEN 'Rest' ELSE 'none' END AS label FROM part""")
def recoded_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    rules = [(r"\bold\b|ancient", "Old"), ("ring", "Ring"), ("r", "Rest")]
    return table(spark, sf, "part").select("p_partkey", first_match("p_name", rules, "none").alias("label"))


@query("classify_rules", """
    SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_name LIKE '%widget%' THEN 'device'
                           WHEN p_name LIKE '%r%' THEN 'with r' WHEN p_name = 'blue bolt' THEN 'exact' END AS label
    FROM part""")
def classified_by_rules(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    rules = [(name == "blue bolt", "exact"), (name.rlike("r"), "with r"), (name.rlike("widget"), "device"),
             (F.col("p_type") == "PROMO", None)]
    return table(spark, sf, "part").select("p_partkey", last_match(rules).alias("label"))


@query("membership_flag", sql("mv", """
    SELECT s_suppkey, CASE WHEN iso3c IS NULL THEN 'non-EU' ELSE 'EU' END AS affiliation,
           CASE WHEN iso3c IS NULL THEN s_name || '*' ELSE s_name END AS s_name
    FROM supplier LEFT JOIN mv ON iso3c = 'N' || CAST(s_nationkey AS VARCHAR)"""))
def flagged_members(spark: SparkSession, sf: str) -> DataFrame:
    bloc = members(spark, sf)
    vessels = table(spark, sf, "supplier").withColumn("iso3c", nation_code("s_nationkey"))
    flagged = lookup.membership_flag(vessels, "iso3c", bloc, "affiliation")
    return lookup.mark_non_members(flagged, "s_name", "iso3c", bloc).select("s_suppkey", "affiliation", "s_name")


@query("compose_key", """
    SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'NA' ELSE p_type END || ', ' || p_brand AS product,
           p_brand || ' (' || CASE WHEN p_type = 'PROMO' THEN 'NA' ELSE p_type END || ')' AS label FROM part""")
def composed(spark: SparkSession, sf: str) -> DataFrame:
    form = F.when(F.col("p_type") != "PROMO", F.col("p_type"))
    return table(spark, sf, "part").select(
        "p_partkey", paste(form, "p_brand", sep=", ").alias("product"),
        paste("p_brand", F.lit(" ("), form, F.lit(")"), sep="").alias("label"))


@query("normalise_text", r"""
    SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS sentence,
           replace(p_type || ', ' || p_name, ',', '') AS plain, p_brand || ' spp. x' AS undotted_from,
           p_brand || ' spp x' AS undotted, lower(p_brand) AS taxon, lower(p_name) AS key,
           upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' '
             || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS title
    FROM part""")
def normalised(spark: SparkSession, sf: str) -> DataFrame:
    dotted = F.concat("p_brand", F.lit(" spp. x"))
    noisy = F.concat(F.lit(" "), F.upper("p_brand"), F.when(F.col("p_type") == "PROMO", " spp.").otherwise(" (all)"))
    spaced = F.concat(F.lit("  "), F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("  "))))
    return table(spark, sf, "part").select(
        "p_partkey", sentence_case("p_name").alias("sentence"),
        without_commas(F.concat_ws(", ", "p_type", "p_name")).alias("plain"), dotted.alias("undotted_from"),
        first_dot_removed(dotted).alias("undotted"), clean_taxon(noisy).alias("taxon"),
        name_key(spaced).alias("key"), F.initcap("p_name").alias("title"))


@query("parse_flagged", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus,
           CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS value,
           CASE l_returnflag WHEN 'A' THEN 'ep' WHEN 'R' THEN 'c' END AS flag
    FROM lineitem""")
def parsed_cells(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("l_quantity").cast("string")
    cell = (F.when(F.col("l_returnflag") == "A", F.concat(number, F.lit(" e p")))
            .when(F.col("l_returnflag") == "R", ": c").otherwise(F.concat(number, F.lit(" "))))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus",
        flagged_value(cell).alias("value"), flag_letters(cell).alias("flag"))


@query("split_key", """
    SELECT p_partkey, p_brand AS species, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS pres,
           CASE WHEN p_type = 'PROMO' THEN NULL ELSE CAST(p_size AS VARCHAR) END AS geo FROM part""")
def split_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("p_type") == "PROMO", F.col("p_brand")).otherwise(
        F.concat_ws(",", "p_brand", "p_type", "p_size", F.lit("surplus")))
    return reshape.split_key(table(spark, sf, "part").select("p_partkey", key.alias("key")), "species,pres,geo\\time", "key")


@query("split_pair", """
    SELECT p_partkey, p_name AS common_name, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_brand END AS scientific_name
    FROM part""")
def split_pairs(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("p_type") == "PROMO", F.col("p_name")).otherwise(F.concat_ws(" - ", "p_name", "p_brand", "p_type"))
    return reshape.split_pair(table(spark, sf, "part").select("p_partkey", label.alias("species")), "species",
                              ("common_name", "scientific_name"))


@query("normalise_code", """
    SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR) || CAST(p_size AS VARCHAR), 8, '0') AS code,
           lpad(CAST(p_partkey AS VARCHAR) || CAST(p_size AS VARCHAR), 8, '0') LIKE '00001%' AS listed FROM part""")
def coded(spark: SparkSession, sf: str) -> DataFrame:
    code = product_code(F.concat_ws(" ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", code.alias("code"), F.startswith(code, F.lit("00001")).alias("listed"))


@query("fill_missing", sql("lv cv", """
    SELECT scientific_name, presentation, iso3c, year, landings, coalesce(conversion_factor, 0) AS conversion_factor,
           CASE WHEN conversion_factor IS NULL THEN 'not available' ELSE 'yes' END AS status
    FROM panel LEFT JOIN (SELECT scientific_name, landings_code AS presentation, iso3c, conversion_factor FROM cv)
               USING (scientific_name, presentation, iso3c)""", SQL_PANEL))
def filled(spark: SparkSession, sf: str) -> DataFrame:
    own = consolidated(spark, sf).withColumn("status", F.lit("yes"))
    matched = joins.join_on(panel(spark, sf), own, {**ON_PRODUCT, "iso3c": "iso3c"})
    return matched.na.fill({"conversion_factor": 0.0, "status": vocab.NOT_AVAILABLE})


# Filters

@query("clean_filter", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
    WHERE l_quantity <> 0 AND l_linestatus = 'O' AND l_returnflag NOT IN ('N')
          AND year(l_shipdate) BETWEEN 1996 AND 2000 GROUP BY ALL""")
def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    kept = filters.clean_filter(rows, filled=["l_returnflag"], nonzero=["l_quantity"], equals={"l_linestatus": "O"},
                                exclude={"l_returnflag": ["N"]}, years=(1996, 2000))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("member_filter", """
    SELECT n_regionkey, r_name = 'EUROPE' AS member, count(*) AS n, sum(l_quantity) AS quantity
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def member_rows(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    bloc = nation.join(region, F.expr("n_regionkey = r_regionkey")).where("r_name = 'EUROPE'").select("n_nationkey")
    vessels = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity")
    per_vessel = line.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))

    def side(member: bool) -> DataFrame:
        return filters.member_filter(vessels, "s_nationkey", bloc, member).withColumn("member", F.lit(member))

    both = side(True).unionByName(side(False))
    return (per_vessel.join(both, F.expr("l_suppkey = s_suppkey")).join(nation, F.expr("s_nationkey = n_nationkey"))
            .groupBy("n_regionkey", "member").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity")))


PATTERNS = ["^ECO", "PROMO", "^S", "RD$", "M", "L.RGE", "absent"]


@query("share_by_pattern", sql("lv", """
    SELECT pattern, sum(CASE WHEN regexp_matches(presentation, pattern) THEN value ELSE 0 END) / sum(value) AS share
    FROM (SELECT presentation, sum(value) AS value FROM lv GROUP BY ALL)
         CROSS JOIN (VALUES ('^ECO'), ('PROMO'), ('^S'), ('RD$'), ('M'), ('L.RGE'), ('absent')) p(pattern)
    GROUP BY pattern"""))
def pattern_shares(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.share_by_pattern(landings(spark, sf), "presentation", "value", PATTERNS)


# Reshaping

@query("unpivot_years", sql(
    "lv", "SELECT scientific_name, iso3c, year, value, flag FROM cells",
    SQL_CELLS.format(keys="scientific_name, iso3c", source="lv")))
def unpivoted_years(spark: SparkSession, sf: str) -> DataFrame:
    years = calendar(table(spark, sf, "lineitem"))
    return reshape.unpivot_years(wide_cells(landings(spark, sf), ["scientific_name", "iso3c"], "value", years))


@query("unpivot_measures", sql("lv cv", """
    SELECT scientific_name, presentation, year, calculation, value FROM (
        SELECT scientific_name, presentation, year, landings,
               round(landings * low, 4) AS catch_low, round(landings * high, 4) AS catch_high
        FROM (SELECT scientific_name, presentation, year, sum(landings) AS landings FROM panel GROUP BY ALL)
             JOIN (SELECT scientific_name, landings_code AS presentation, min(conversion_factor) AS low,
                          max(conversion_factor) AS high FROM cv GROUP BY ALL) USING (scientific_name, presentation))
    UNPIVOT (value FOR calculation IN (landings, catch_low, catch_high))""", SQL_PANEL))
def unpivoted_measures(spark: SparkSession, sf: str) -> DataFrame:
    spread = consolidated(spark, sf).groupBy(*CODE).agg(
        F.min("conversion_factor").alias("low"), F.max("conversion_factor").alias("high"))
    yearly = panel(spark, sf).groupBy(*PRODUCT, "year").agg(F.sum("landings").alias("landings"))
    caught = joins.apply_factor(joins.join_on(yearly, spread, ON_PRODUCT, "inner"), "landings",
                                {"catch_low": "low", "catch_high": "high"})
    return reshape.unpivot_measures(rounded(caught, "catch_low", "catch_high").drop("low", "high"), "^(landings|catch_)")


@query("lift_category", sql("fv", """
    SELECT scientific_name, landings_code, max(conversion_factor) AS EU_CF
    FROM fv WHERE implementation = 'EU-wide CF' GROUP BY ALL"""))
def lifted(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.lift_category(factors(spark, sf), CODE, F.col("implementation") == vocab.WIDE_CF,
                                 "conversion_factor", "EU_CF")


@query("explode_list", "SELECT p_partkey, unnest(string_split(p_name || ', ' || p_brand, ', ')) AS taxon FROM part")
def exploded(spark: SparkSession, sf: str) -> DataFrame:
    listed = table(spark, sf, "part").select("p_partkey", F.concat_ws(", ", "p_name", "p_brand").alias("taxon"))
    return reshape.explode_list(listed, "taxon")


@query("complete_grid", """
    SELECT a.p_brand, b.p_name, coalesce(n, 0) AS n FROM (SELECT DISTINCT p_brand FROM part) a
    CROSS JOIN (SELECT DISTINCT p_name FROM part) b
    LEFT JOIN (SELECT p_brand, p_name, count(*) AS n FROM part WHERE p_type = 'PROMO' GROUP BY ALL) c
         ON a.p_brand = c.p_brand AND b.p_name = c.p_name""")
def completed(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").groupBy("p_brand", "p_name").agg(F.count_if(F.col("p_type") == "PROMO").alias("n"))
    return reshape.complete_grid(part, "p_brand", "p_name", fill={"n": 0})


@query("densify_years", """
    SELECT g.user_id, g.event_type, g.day, coalesce(n, 0) AS n FROM (
        SELECT user_id, event_type, CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS day
        FROM events GROUP BY user_id, event_type) g
    LEFT JOIN (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) e
         ON g.user_id = e.user_id AND g.event_type = e.event_type AND g.day = e.day""")
def densified(spark: SparkSession, sf: str) -> DataFrame:
    daily = (table(spark, sf, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day"))
             .agg(F.count("*").alias("n")))
    return reshape.densify_years(daily, ["user_id", "event_type"], ["n"], year="day", step=F.expr("interval 1 day"))


# Joins

@query("match_factor", sql("lv fv", """
    SELECT scientific_name, presentation, iso3c, year, landings, conversion_factor AS factor, reference AS source
    FROM panel LEFT JOIN (SELECT scientific_name, landings_code AS presentation, iso3c, conversion_factor, reference
                          FROM fv) USING (scientific_name, presentation, iso3c)""", SQL_PANEL))
def matched_factors(spark: SparkSession, sf: str) -> DataFrame:
    return joins.match_factor(panel(spark, sf), factors(spark, sf), {**ON_PRODUCT, "iso3c": "iso3c"},
                              extra={"reference": "source"})


@query("resolve_synonyms", """
    SELECT p_partkey, coalesce(a.accepted, b.accepted, p_brand) AS scientific_name FROM part
    LEFT JOIN (SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR) AS synonym, n_name AS accepted
               FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('EUROPE', 'ASIA')) a
         ON p_brand = a.synonym
    LEFT JOIN (SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR) AS synonym, r_name AS accepted
               FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('EUROPE', 'AFRICA')) b
         ON p_brand = b.synonym""")
def synonyms_resolved(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))

    def tier(accepted: str, regions: list[str]) -> DataFrame:
        status = F.when(F.col("r_name").isin(regions), "synonym").otherwise("accepted name")
        return nation.select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("synonym"),
                             F.col(accepted).alias("accepted"), status.alias("status"))

    named = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("scientific_name"))
    return lookup.resolve_synonyms(named, "scientific_name", tier("n_name", ["EUROPE", "ASIA"]),
                                   tier("r_name", ["EUROPE", "AFRICA"]))


@query("resolve_common_names", """
    SELECT p_partkey, p_brand || ' ' || p_name AS common_name,
           CASE WHEN p_type = 'PROMO' THEN coalesce(lower(t), '') ELSE p_type END AS scientific_name
    FROM part LEFT JOIN (SELECT p_brand || ' ' || p_name AS c, max(p_type) AS t FROM part WHERE p_type <> 'PROMO'
                         GROUP BY c HAVING count(DISTINCT p_type) = 1) ON p_brand || ' ' || p_name = c""")
def common_names_resolved(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("common_name"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type")).alias("scientific_name"))
    known = named.where("scientific_name <> ''").select("common_name", "scientific_name")
    return lookup.resolve_common_names(named, "common_name", "scientific_name", known)


@query("resolve_country", """
    SELECT s_suppkey, s_nationkey, 'N' || CAST(n_nationkey AS VARCHAR) AS iso3c, lower(left(n_name, 2)) AS iso2c,
           CASE WHEN r_name IN ('EUROPE', 'MIDDLE EAST') THEN 'Europe' ELSE r_name END AS continent
    FROM supplier LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
         ON s_nationkey = n_nationkey""")
def countries_resolved(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    europe = F.col("r_name").isin("EUROPE", "MIDDLE EAST")
    known = nation.where("r_name <> 'ASIA'").select(
        F.lower("n_name").alias("name_key"), nation_code("n_nationkey").alias("iso3c"),
        F.lower(F.left("n_name", F.lit(2))).alias("iso2c"), F.when(europe, "Europe").otherwise(F.col("r_name")).alias("continent"))
    vessels = table(spark, sf, "supplier").select(
        "s_suppkey", "s_nationkey", F.concat(F.lit(" Nation_"), F.col("s_nationkey").cast("string")).alias("country"))
    return lookup.resolve_country(vessels, "country", known).drop("country")


@query("align_vocab", """
    SELECT a.p_name AS factor_side, b.p_name AS landing_side
    FROM (SELECT DISTINCT p_brand || ' ' || p_name AS p_name FROM part WHERE p_type = 'PROMO') a
    FULL OUTER JOIN (SELECT DISTINCT p_brand || ' ' || p_name AS p_name FROM part WHERE p_type <> 'PROMO') b
    ON a.p_name = b.p_name""")
def aligned(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("term", F.concat_ws(" ", "p_brand", "p_name"))
    return lookup.align_vocab(part.where("p_type = 'PROMO'"), part.where("p_type <> 'PROMO'"), "term",
                              ("factor_side", "landing_side"))


@query("semi_keys", sql("lv fv", """
    SELECT scientific_name, presentation, iso3c, year, landings FROM panel
    WHERE EXISTS (SELECT 1 FROM fv WHERE fv.scientific_name = panel.scientific_name
                  AND fv.landings_code = panel.presentation AND fv.iso3c = panel.iso3c)""", SQL_PANEL))
def semi(spark: SparkSession, sf: str) -> DataFrame:
    return joins.semi_keys(panel(spark, sf), factors(spark, sf), {**ON_PRODUCT, "iso3c": "iso3c"})


@query("series_difference", sql("lv", """
    SELECT scientific_name, year, sum(CASE WHEN unit = 'O' THEN value END) AS open,
           sum(CASE WHEN unit = 'F' THEN value END) AS final,
           sum(CASE WHEN unit = 'O' THEN value END) - sum(CASE WHEN unit = 'F' THEN value END) AS difference
    FROM lv GROUP BY ALL"""))
def series(spark: SparkSession, sf: str) -> DataFrame:
    rows = landings(spark, sf).groupBy("scientific_name", "unit", "year").agg(F.sum("value").alias("total"))
    rows = materialise(rows, "series")
    return aggregate.series_difference(rows.where("unit = 'O'"), rows.where("unit = 'F'"),
                                       ["scientific_name", "year"], "total", ("open", "final"), keep="all")


# Aggregations

@query("min_max_with_holders", sql("fv", """
    SELECT scientific_name, landings_code, min_cf, max_cf,
           string_agg(DISTINCT CASE WHEN conversion_factor = min_cf THEN iso3c END, ', '
                      ORDER BY CASE WHEN conversion_factor = min_cf THEN iso3c END) AS min_iso3c,
           string_agg(DISTINCT CASE WHEN conversion_factor = max_cf THEN iso3c END, ', '
                      ORDER BY CASE WHEN conversion_factor = max_cf THEN iso3c END) AS max_iso3c
    FROM fv JOIN (SELECT scientific_name, landings_code, min(conversion_factor) AS min_cf,
                         max(conversion_factor) AS max_cf FROM fv GROUP BY ALL) USING (scientific_name, landings_code)
    GROUP BY ALL"""))
def holders(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.min_max_with_holders(factors(spark, sf), CODE, "conversion_factor", "iso3c")


@query("group_by_all_but", sql("lv", """
    SELECT scientific_name, presentation, iso3c, year, use, sum(value) AS value FROM lv GROUP BY ALL"""))
def grouped_by_rest(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.group_by_all_but(landings(spark, sf), ["value"], drop=["unit", "price", "common_name", "code"])


@query("bucket_uncovered", sql("lv cv", """
    SELECT scientific_name, iso3c, year, conversion_factor, sum(landings) AS landings,
           CASE WHEN conversion_factor IS NULL THEN 'no national CF value' ELSE presentation END AS presentation,
           CASE WHEN conversion_factor IS NULL THEN 'unaccounted' ELSE 'catch' END AS catch_vs_unaccounted
    FROM panel LEFT JOIN (SELECT scientific_name, landings_code AS presentation, iso3c, conversion_factor FROM cv)
               USING (scientific_name, presentation, iso3c) GROUP BY ALL""", SQL_PANEL))
def bucketed(spark: SparkSession, sf: str) -> DataFrame:
    matched = joins.join_on(panel(spark, sf), consolidated(spark, sf), {**ON_PRODUCT, "iso3c": "iso3c"})
    return aggregate.bucket_uncovered(matched, "conversion_factor", "presentation", vocab.NO_NATIONAL_CF, ["landings"])


@query("covered_totals", sql("lv cv", """
    SELECT year, sum(CASE WHEN conversion_factor IS NOT NULL THEN landings END) AS covered,
           sum(CASE WHEN conversion_factor IS NULL THEN landings END) AS uncovered
    FROM panel LEFT JOIN (SELECT scientific_name, landings_code AS presentation, iso3c, conversion_factor FROM cv)
               USING (scientific_name, presentation, iso3c) GROUP BY year""", SQL_PANEL))
def totals_by_coverage(spark: SparkSession, sf: str) -> DataFrame:
    matched = joins.join_on(panel(spark, sf), consolidated(spark, sf), {**ON_PRODUCT, "iso3c": "iso3c"})
    return aggregate.covered_totals(matched, ["year"], "conversion_factor", "landings")


@query("list_members", sql("lv", """
    SELECT scientific_name, presentation, string_agg(DISTINCT iso3c, ', ' ORDER BY iso3c) AS list_of_iso3c_landing,
           count(DISTINCT iso3c) AS n_countries_landing FROM lv GROUP BY ALL"""))
def listed(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.list_members(landings(spark, sf), PRODUCT, "iso3c", "list_of_iso3c_landing", "n_countries_landing")


@query("distinct_keys", sql("lv", "SELECT DISTINCT scientific_name, presentation, iso3c FROM lv"))
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.distinct_keys(landings(spark, sf), [*PRODUCT, "iso3c"])


@query("distinct_counts", sql("lv", """
    SELECT count(DISTINCT scientific_name) AS n_scientific_name, count(DISTINCT presentation) AS n_presentation FROM lv"""))
def counted_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.distinct_counts(landings(spark, sf), PRODUCT)


@query("consolidate_factors", sql("fv", """
    SELECT scientific_name, landings_code, iso3c,
           CAST(sum(CAST(conversion_factor AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS conversion_factor
    FROM fv GROUP BY ALL"""))
def consolidation(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.consolidate_factors(factors(spark, sf), [*CODE, "iso3c"])


@query("first_per_key", """
    SELECT p_brand, p_name, p_partkey, p_retailprice FROM (
        SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_size DESC, p_partkey) AS rn FROM part)
    WHERE rn = 1""")
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("__largest", -F.col("p_size"))
    return ranking.first_per_key(part, ["p_brand", "p_name"], ["__largest", "p_partkey"]).select(
        "p_brand", "p_name", "p_partkey", "p_retailprice")


@query("drop_ambiguous", """
    SELECT p_partkey, p_brand, p_type, p_size FROM part
    WHERE (p_brand, p_type, p_size) IN (SELECT (p_brand, p_type, p_size) FROM part GROUP BY ALL HAVING count(*) = 1)""")
def unambiguous(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return ranking.only_unambiguous(part, ["p_brand", "p_type", "p_size"])


@query("coverage_ratio", sql("lv fv", """
    SELECT scientific_name, presentation, count(*) AS n_countries_landing,
           CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_CF, count(f.iso3c) AS n_CF_with_landings,
           count(f.iso3c) / count(*) AS proportion_have_CF
    FROM (SELECT DISTINCT scientific_name, presentation, iso3c FROM lv) l
    LEFT JOIN (SELECT DISTINCT scientific_name, landings_code AS presentation, iso3c FROM fv) f
         USING (scientific_name, presentation, iso3c)
    LEFT JOIN (SELECT scientific_name, landings_code AS presentation, count(DISTINCT iso3c) AS n FROM fv GROUP BY ALL) c
         USING (scientific_name, presentation)
    GROUP BY scientific_name, presentation"""))
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    held = factors(spark, sf).withColumnRenamed("landings_code", "presentation")
    return aggregate.coverage_ratio(landings(spark, sf), held, PRODUCT, "iso3c")


@query("strict_aggregates", """
    SELECT p_brand, CASE WHEN bool_or(p_size < 3) THEN NULL ELSE max(p_retailprice) END AS strict_max,
           max(CASE WHEN p_size >= 3 THEN p_retailprice END) AS max,
           CASE WHEN bool_or(p_size < 3) THEN NULL ELSE min(p_retailprice) END AS strict_min,
           CASE WHEN bool_or(p_size < 3) THEN NULL ELSE sum(p_size) END AS strict_sum
    FROM part GROUP BY p_brand""")
def strict(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumns({
        "price": F.when(F.col("p_size") >= 3, F.col("p_retailprice")),
        "size": F.when(F.col("p_size") >= 3, F.col("p_size").cast("long"))})
    return part.groupBy("p_brand").agg(
        max_of("price", "propagate").alias("strict_max"), max_of("price").alias("max"),
        min_of("price", "propagate").alias("strict_min"), sum_of("size", "propagate").alias("strict_sum"))


# Rankings

@query("prefer_source", sql("fv", """
    SELECT p_partkey, scientific_name, landings_code, iso3c, reference FROM (
        SELECT *, count(*) OVER (PARTITION BY scientific_name, landings_code, iso3c) AS n FROM fv)
    WHERE n = 1 OR reference IN ('red', 'blue')"""))
def preferred(spark: SparkSession, sf: str) -> DataFrame:
    rows = factors(spark, sf).select("p_partkey", *CODE, "iso3c", "reference")
    return ranking.prefer_source(rows, [*CODE, "iso3c"], "reference", ["red", "blue"])


@query("max_rows_per_group", sql("lv", """
    SELECT scientific_name, presentation, iso3c, year, landings FROM (
        SELECT *, max(landings) OVER (PARTITION BY scientific_name, presentation, iso3c) AS best FROM panel)
    WHERE landings = best""", SQL_PANEL))
def peak_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.max_rows_per_group(materialise(panel(spark, sf), "panel"), [*PRODUCT, "iso3c"], "landings")


@query("cumulative_share", sql("lv", """
    SELECT iso3c, total, sum(total) OVER w AS cumulative_sum, sum(total) OVER w / sum(total) OVER () AS proportion
    FROM (SELECT scientific_name || ' ' || presentation || ' ' || iso3c AS iso3c, sum(value) AS total FROM lv GROUP BY 1)
    WINDOW w AS (ORDER BY total DESC, iso3c ROWS UNBOUNDED PRECEDING)"""))
def running_share(spark: SparkSession, sf: str) -> DataFrame:
    rows = landings(spark, sf).withColumn("iso3c", F.concat_ws(" ", *PRODUCT, "iso3c"))
    return ranking.cumulative_share(rows, "iso3c", "value")


@query("row_index", sql("lv", """
    SELECT scientific_name, presentation, iso3c, year, landings,
           row_number() OVER (PARTITION BY scientific_name, iso3c ORDER BY landings DESC, presentation, year) AS row_index
    FROM panel""", SQL_PANEL))
def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.row_index(panel(spark, sf), ["scientific_name", "iso3c"], ["-landings", "presentation", "year"])


@query("discrepancy_groups", sql("fv", """
    SELECT p_partkey, scientific_name, landings_code, iso3c FROM fv
    WHERE (scientific_name, landings_code) IN (
        SELECT (scientific_name, landings_code) FROM fv WHERE iso3c = 'EU' AND conversion_factor > 1.8)"""))
def discrepant(spark: SparkSession, sf: str) -> DataFrame:
    flag = (F.col("iso3c") == vocab.WIDE_CODE) & (F.col("conversion_factor") > 1.8)
    return ranking.groups_with(factors(spark, sf), CODE, flag).select("p_partkey", *CODE, "iso3c")


@query("top_k", sql("fv", """
    SELECT scientific_name, landings_code, max(conversion_factor) - min(conversion_factor) AS range FROM fv GROUP BY ALL
    ORDER BY range DESC, scientific_name, landings_code LIMIT 20"""))
def top(spark: SparkSession, sf: str) -> DataFrame:
    ranges = factors(spark, sf).groupBy(*CODE).agg(
        (F.max("conversion_factor") - F.min("conversion_factor")).alias("range"))
    return ranking.top_k(ranges, "range", 20, CODE)


@query("rows_at_maximum", "SELECT * FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def at_maximum(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rows_at_maximum(table(spark, sf, "part"), "p_size")


@query("order_by_ranking", sql("fv", """
    SELECT p_partkey, scientific_name, landings_code, rank FROM fv LEFT JOIN (
        SELECT scientific_name, landings_code, row_number() OVER (ORDER BY range DESC, scientific_name, landings_code) AS rank
        FROM (SELECT scientific_name, landings_code, max(conversion_factor) - min(conversion_factor) AS range
              FROM fv GROUP BY ALL)) USING (scientific_name, landings_code)"""))
def ordered(spark: SparkSession, sf: str) -> DataFrame:
    rows = factors(spark, sf)
    ranges = rows.groupBy(*CODE).agg((F.max("conversion_factor") - F.min("conversion_factor")).alias("range"))
    rank = ranking.row_index(ranges, [], ["-range", *CODE], "rank")
    return ranking.order_by_ranking(rows.select("p_partkey", *CODE), rank, CODE)


@query("rank_categories", sql("fv", """
    SELECT scientific_name, median, dense_rank() OVER (ORDER BY median) AS rank
    FROM (SELECT scientific_name, median(conversion_factor) AS median FROM fv GROUP BY ALL)"""))
def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rank_categories(factors(spark, sf), "scientific_name", "conversion_factor")


# Sets and checks

@query("common_categories", sql("lv fv", """
    SELECT unnest(['landed', 'held']) AS side, * FROM (
        SELECT DISTINCT iso3c, scientific_name, presentation FROM lv
        INTERSECT SELECT iso3c, scientific_name, landings_code FROM fv)"""))
def common(spark: SparkSession, sf: str) -> DataFrame:
    landed = materialise(landings(spark, sf).select("iso3c", *PRODUCT).distinct(), "landed")
    held = factors(spark, sf).select("iso3c", "scientific_name", F.col("landings_code").alias("presentation"))
    left, right = sets.common_categories(landed, held.distinct(), ["iso3c", "scientific_name"], "presentation")
    return left.withColumn("side", F.lit("landed")).unionByName(right.withColumn("side", F.lit("held")))


@query("reconcile_sources", """
    SELECT sum(greatest(a - b, 0))::BIGINT AS only_in_a, sum(greatest(b - a, 0))::BIGINT AS only_in_b,
           sum(least(a, b))::BIGINT AS in_both FROM (
        SELECT l_partkey, l_quantity, count(*) FILTER (l_returnflag <> 'N' OR l_linestatus = 'F') AS a,
               count(*) FILTER (l_linestatus = 'O') AS b
        FROM lineitem GROUP BY ALL)""")
def reconciled(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    columns = ["l_partkey", "l_quantity"]
    return sets.reconcile_sources(line.where("l_returnflag <> 'N' OR l_linestatus = 'F'").select(*columns),
                                  line.where("l_linestatus = 'O'").select(*columns))


@query("check_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicated(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_nonempty", """
    SELECT p_partkey, coalesce(sum(l_quantity), 0) AS total FROM part
    LEFT JOIN (SELECT l_partkey, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_quantity END AS l_quantity
               FROM lineitem) ON p_partkey = l_partkey
    GROUP BY p_partkey HAVING coalesce(sum(l_quantity), 0) < 1""")
def empty_keys(spark: SparkSession, sf: str) -> DataFrame:
    # Quantities of other lines are unknown here; their parts stay as keys.
    counted = F.when(F.expr("l_returnflag = 'R' AND l_linestatus = 'O'"), F.col("l_quantity"))
    sums = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(counted).alias("quantity"))
    both = joins.join_on(table(spark, sf, "part").select("p_partkey"), sums, {"p_partkey": "l_partkey"})
    return checks.check_nonempty(both, ["p_partkey"], "quantity")


@query("check_null_keys", """
    SELECT count(*) FILTER (n_name IS NULL) AS null_n_name, count(*) FILTER (l_orderkey IS NULL) AS null_l_orderkey
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
         ON s_nationkey = n_nationkey""")
def null_keys(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    known = nation.where("r_name <> 'ASIA'").select("n_nationkey", "n_name")
    vessels = joins.join_on(table(spark, sf, "supplier"), known, {"s_nationkey": "n_nationkey"})
    line = joins.join_on(table(spark, sf, "lineitem"), vessels, {"l_suppkey": "s_suppkey"}, "inner")
    return checks.check_null_keys(line, ["n_name", "l_orderkey"])
