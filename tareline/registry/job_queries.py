"""One query per ready-made job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tareline import vocab
from tareline.functions.measure import display
from tareline.functions.recode import recode
from tareline.plans import catch, coverage, factors as factor_jobs, trade
from tareline.plans.landings import clean_catch, clean_landings, with_countries
from tareline.registry.base import SQL, query, sql
from tareline.registry.fixtures import SQL_CELLS, calendar, move_files, wide_cells, write_dictionary, write_wide
from tareline.registry.operator_queries import CODE, PRODUCT, consolidated, rounded
from tareline.registry.views import factors, landings, members, nation_code, table
from tareline.session import materialise, new_scratch_path
from tareline.sources.tables import read_code_dictionary
from tareline.sources.wide import list_wide_files


# Factors

@query("factor_ranges", sql("fv", """
    SELECT scientific_name, landings_code, count(*) AS n_CF,
           count(*) FILTER (continent_affiliation = 'EU') AS n_EU,
           count(*) FILTER (continent_affiliation = 'other') AS n_nonEuropean,
           count(*) FILTER (implementation = 'EU-wide CF') AS eu_wide_available,
           max(conversion_factor) AS max_CF, min(conversion_factor) AS min_CF,
           max(conversion_factor) - min(conversion_factor) AS range
    FROM fv WHERE landings_code IN (SELECT DISTINCT p_type FROM lineitem JOIN part ON l_partkey = p_partkey)
    GROUP BY ALL HAVING n_CF > 1 AND n_EU > 0 AND range <> 0"""))
def ranges(spark: SparkSession, sf: str) -> DataFrame:
    landed = landings(spark, sf).select("presentation").distinct()
    return factor_jobs.factor_ranges(factors(spark, sf, affiliation=True), landed, CODE)


SQL_CASES = """
    cases AS (SELECT scientific_name, landings_code FROM fv GROUP BY ALL
              HAVING count(*) > 1 AND count(*) FILTER (continent_affiliation = 'EU') > 0
                     AND max(conversion_factor) <> min(conversion_factor)
                     AND count(*) FILTER (implementation = 'EU-wide CF') = 1)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    return factor_jobs.case_products(factor_jobs.factor_ranges(factors(spark, sf, affiliation=True), keys=CODE), k=None)


@query("relative_factors", sql("fv", """
    SELECT p_partkey, scientific_name, landings_code, conversion_factor, min(conversion_factor) OVER w AS min_in_group,
           max(conversion_factor) OVER w AS max_in_group,
           max(conversion_factor) OVER w - min(conversion_factor) OVER w AS range_in_group,
           conversion_factor / min(conversion_factor) OVER w AS cf_relative,
           max(conversion_factor) OVER w / min(conversion_factor) OVER w AS max_cf_relative,
           printf('%.2f', round_even(conversion_factor / min(conversion_factor) OVER w, 2)) AS cf_relative_shown,
           printf('%.2f', round_even(max(conversion_factor) OVER w - min(conversion_factor) OVER w, 2)) AS range_shown
    FROM fv JOIN cases USING (scientific_name, landings_code)
    WINDOW w AS (PARTITION BY scientific_name, landings_code)""", SQL_CASES))
def relative(spark: SparkSession, sf: str) -> DataFrame:
    rows = factors(spark, sf).select("p_partkey", *CODE, "conversion_factor")
    found = factor_jobs.relative_factors(rows, cases(spark, sf))
    return found.withColumns({"cf_relative_shown": display("cf_relative"), "range_shown": display("range_in_group")})


@query("relative_by_presentation", sql("fv", """
    SELECT landings_code, min(conversion_factor) AS min_in_group, max(conversion_factor) AS max_in_group,
           max(conversion_factor) - min(conversion_factor) AS range_in_group,
           max(conversion_factor) / min(conversion_factor) AS max_cf_relative
    FROM fv JOIN cases USING (scientific_name, landings_code) GROUP BY landings_code""", SQL_CASES))
def relative_presentations(spark: SparkSession, sf: str) -> DataFrame:
    return factor_jobs.relative_by_presentation(factors(spark, sf), cases(spark, sf))


@query("factor_drift", """
    WITH f AS (SELECT lpad(substr(p_brand, 7) || CAST(length(p_name) AS VARCHAR), 8, '0') AS CN8, p_size AS year,
                      round(1 + (p_retailprice - 900) / 100, 3) AS CF FROM part),
         s AS (SELECT CN8, year, any_value(CF) AS CF FROM f GROUP BY CN8, year HAVING count(*) = 1),
         t AS (SELECT *, max(CF) OVER (PARTITION BY CN8) AS high, min(CF) OVER (PARTITION BY CN8) AS low
               FROM s WHERE CF NOT IN (0, 1))
    SELECT CN8, year, CF, high, low FROM t WHERE high - low > 0.01""")
def drift(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat_ws(" ", F.substring("p_brand", 7, 9), F.length("p_name").cast("string"))
    official = table(spark, sf, "part").select(
        code.alias("CN8"), F.col("p_size").alias("year"),
        F.round(1 + (F.col("p_retailprice") - 900) / 100, 3).alias("CF"))
    return factor_jobs.factor_drift(official)


@query("spread_examples", sql("fv", """
    SELECT * FROM (
        SELECT p_partkey, scientific_name, landings_code, iso3c, conversion_factor, count(*) OVER w AS n,
               max(conversion_factor) OVER w AS upper, min(conversion_factor) OVER w AS lower,
               max(conversion_factor) OVER w - min(conversion_factor) OVER w AS range
        FROM fv WINDOW w AS (PARTITION BY scientific_name, landings_code, reference))
    WHERE range > 0.3 AND n > 3""".replace("p_partkey,", "p_partkey, reference,")))
def spread(spark: SparkSession, sf: str) -> DataFrame:
    rows = factors(spark, sf).select("p_partkey", *CODE, "iso3c", "reference", "conversion_factor")
    return factor_jobs.spread_examples(rows, [*CODE, "reference"], "conversion_factor")


@query("presentation_alignment", sql("lv", """
    SELECT f.term AS EU_Commission, l.term AS Eurostat_Landings
    FROM (SELECT DISTINCT p_type || ' ' || CAST(p_size AS VARCHAR) AS term FROM part) f
    FULL OUTER JOIN (SELECT DISTINCT presentation || ' ' || CAST(CAST(value AS INTEGER) * 2 AS VARCHAR) AS term FROM lv) l
    ON f.term = l.term"""))
def presentation_terms(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "part").select(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("landings_code"))
    doubled = (F.col("value").cast("int") * 2).cast("string")
    landed = landings(spark, sf).select(F.concat_ws(" ", "presentation", doubled).alias("presentation"))
    return factor_jobs.presentation_alignment(held, landed)


GENERAL = """
    SELECT CASE WHEN p_type = 'PROMO' THEN 'Aquatic plants' WHEN p_type = 'LARGE' THEN 'Molluscs' ELSE 'Fishes' END AS type,
           CASE WHEN p_size > 45 THEN '' ELSE p_brand END AS scientific_name,
           p_brand || ' ' || p_name AS common_name,
           CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'Frozen' WHEN 'blue' THEN 'Fresh/chilled' WHEN 'hot' THEN 'Live'
                WHEN 'old' THEN 'Liver oil, canned' WHEN 'new' THEN 'Salted' ELSE 'Smoked' END
           || CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN ', guttted' WHEN 'bolt' THEN ', fillets'
                   WHEN 'gear' THEN ', gutted, split' WHEN 'plate' THEN ', fillets, blocks' WHEN 'anvil' THEN ', roe'
                   ELSE '' END AS type_of_processing,
           round(1 + (p_retailprice - 950) / 100, 3) AS conversion_factor, p_partkey
    FROM part"""


@query("classify_products", f"""
    WITH g AS ({GENERAL}),
    t AS (SELECT p_partkey, type, common_name, conversion_factor, lower(scientific_name) AS scientific_name,
                 CASE WHEN lower(type_of_processing) LIKE '%guttted%' THEN 'gutted'
                      ELSE lower(type_of_processing) END AS type_of_processing
          FROM g WHERE conversion_factor >= 1 AND type <> 'Aquatic plants'),
    c AS (SELECT p_brand || ' ' || p_name AS common_name, lower(max(p_type || ' ' || p_brand)) AS taxon FROM part
          GROUP BY 1 HAVING count(DISTINCT p_type) = 1),
    n AS (SELECT t.* EXCLUDE (scientific_name), CASE WHEN scientific_name = '' THEN coalesce(taxon, '')
                 ELSE scientific_name END AS scientific_name
          FROM t LEFT JOIN c USING (common_name)),
    s AS (SELECT DISTINCT lower(p_type || ' ' || p_brand) AS synonym, lower(n_name) AS accepted
          FROM nation JOIN part ON p_brand = 'Brand#' || CAST(n_nationkey AS VARCHAR) WHERE p_type <> 'SMALL')
    SELECT p_partkey, type, common_name, conversion_factor, type_of_processing,
           CASE WHEN scientific_name NOT IN (SELECT lower('MEDIUM ' || p_brand) FROM part)
                THEN coalesce(accepted, scientific_name) ELSE scientific_name END AS scientific_name,
           CASE WHEN regexp_matches(type_of_processing, 'dried|canned|fermented|pickled|preserved|salted|brine|smoked')
                THEN 'preserved' WHEN type_of_processing LIKE '%frozen%' THEN 'frozen'
                WHEN type_of_processing LIKE '%fresh%' THEN 'fresh' WHEN type_of_processing LIKE '%liver%' THEN NULL
                WHEN type_of_processing LIKE '%live%' THEN 'live' END AS preparation,
           CASE WHEN type NOT LIKE '%Fishes%' THEN 'non-fish, non-fmp form'
                WHEN type_of_processing LIKE '%fillet%' AND type_of_processing NOT LIKE '%blocks%' THEN 'fillet'
                WHEN regexp_matches(type_of_processing, 'roe|liver') THEN 'livers and roes'
                WHEN regexp_matches(type_of_processing, 'blocks|split') THEN 'other meat'
                WHEN type_of_processing LIKE '%gutted%' THEN 'whole'
                WHEN type_of_processing IN ('fresh/chilled', 'frozen', 'salted', 'smoked', 'live') THEN 'whole'
                END AS separation
    FROM n LEFT JOIN s ON scientific_name = synonym""")
def classified(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    name = F.split("p_name", " ")
    start = {"red": "Frozen", "blue": "Fresh/chilled", "hot": "Live", "old": "Liver oil, canned", "new": "Salted"}
    end = {"ring": ", guttted", "bolt": ", fillets", "gear": ", gutted, split", "plate": ", fillets, blocks",
           "anvil": ", roe"}
    general = part.select(
        "p_partkey",
        F.when(F.col("p_type") == "PROMO", "Aquatic plants").when(F.col("p_type") == "LARGE", "Molluscs")
        .otherwise("Fishes").alias("type"),
        F.when(F.col("p_size") > 45, "").otherwise(F.col("p_brand")).alias("scientific_name"),
        F.concat_ws(" ", "p_brand", "p_name").alias("common_name"),
        F.concat(cases_of(name[0], start, "Smoked"), cases_of(name[1], end, "")).alias("type_of_processing"),
        F.round(1 + (F.col("p_retailprice") - 950) / 100, 3).alias("conversion_factor"))
    taxon = F.concat_ws(" ", "p_type", "p_brand")
    common = part.select(F.concat_ws(" ", "p_brand", "p_name").alias("common_name"), taxon.alias("scientific_name"))
    known = part.select(F.lower(F.concat(F.lit("MEDIUM "), "p_brand")).alias("taxon"))
    kinds = part.select("p_type", "p_brand").distinct()
    named = kinds.join(table(spark, sf, "nation"), F.expr("p_brand = concat('Brand#', n_nationkey)"))
    status = F.when(F.col("p_type") == "SMALL", "provisional").otherwise("synonym")
    synonyms = named.select(taxon.alias("synonym"), F.col("n_name").alias("accepted"), status.alias("status"))
    return factor_jobs.classify_products(general, common, known, synonyms)


def cases_of(c: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    return recode(c, mapping, default)


@query("compile_factors", r"""
    WITH nr AS (SELECT n_nationkey, r_name, CASE n_nationkey WHEN 0 THEN 'EU' WHEN 2 THEN 'UK' WHEN 5 THEN 'Greenland'
                                                             ELSE n_name END AS n_name
                FROM nation JOIN region ON n_regionkey = r_regionkey),
    p AS (SELECT *, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun,
                 round(1 + (p_retailprice - 900) / 100, 3) AS cf FROM part),
    countries AS (SELECT n_nationkey, n_name AS country, CASE n_nationkey WHEN 0 THEN 'EU' ELSE 'N' || n_nationkey END AS iso3c,
                         CASE n_nationkey WHEN 0 THEN 'EU' ELSE 'n' || n_nationkey END AS iso2c,
                         CASE WHEN n_nationkey IN (0, 5) OR r_name IN ('EUROPE', 'MIDDLE EAST') THEN 'Europe' ELSE r_name END
                             AS continent
                  FROM nr),
    official AS (
        SELECT n_name AS country, p_brand || '. spp.' AS scientific_name,
               CASE p_type WHEN 'STANDARD' THEN 'Fresh' WHEN 'ECONOMY' THEN 'Frozen' WHEN 'MEDIUM' THEN 'Salted'
                    WHEN 'SMALL' THEN 'Alive' ELSE 'none' END AS state,
               CASE noun WHEN 'ring' THEN 'gutted' WHEN 'bolt' THEN 'gutted and headed' WHEN 'widget' THEN 'whole'
                    ELSE 'none' END AS presentation,
               cf AS conversion_factor, CASE adj WHEN 'blue' THEN NULL ELSE adj END AS note,
               CASE adj WHEN 'small' THEN 'EU Council Regulations Annex' ELSE 'FAO' END AS reference
        FROM p JOIN nr ON n_nationkey = p_size % 25 WHERE adj <> 'red'
        UNION ALL
        SELECT n_name, 'Brand#' || CAST(s_suppkey % 25 AS VARCHAR) || '. spp.', 'Fresh', 'gutted', 1 + s_nationkey / 100, NULL,
               'EU Council Website Third Country Info'
        FROM supplier JOIN nr ON s_nationkey = n_nationkey),
    curated AS (SELECT * FROM (VALUES ('frozen ring', 'gutted'), ('frozen ring', 'gutted, tail off'),
                                      ('fresh bolt', 'gutted and headed'), ('salted gear', 'filleted'),
                                      ('alive plate', 'whole'), ('dried anvil', 'whole')) v(text, presentation)),
    general AS (
        SELECT DISTINCT n_name AS country, p_brand AS scientific_name,
               CASE WHEN noun = 'plate' THEN 'Alive' WHEN noun = 'bolt' THEN 'Fresh' WHEN noun = 'ring' THEN 'Frozen'
                    ELSE 'Salted' END AS state,
               presentation, cf AS conversion_factor, adj AS note,
               CASE adj WHEN 'old' THEN 'EU Council Regulations Annex' ELSE 'FAO 2000' END AS reference
        FROM p JOIN nr ON n_nationkey = p_size % 25
             JOIN curated ON text = CASE noun WHEN 'ring' THEN 'frozen' WHEN 'bolt' THEN 'fresh' WHEN 'gear' THEN 'salted'
                                         WHEN 'plate' THEN 'alive' ELSE 'dried' END || ' ' || noun
        WHERE p_type <> 'PROMO' AND adj NOT IN ('hot') AND noun <> 'anvil'
              AND NOT (n_name = 'NATION_3' AND noun = 'bolt')),
    stacked AS (
        SELECT o.*, iso3c, iso2c, 'Europe' AS continent FROM official o JOIN countries USING (country)
        UNION ALL SELECT g.*, iso3c, iso2c, continent FROM general g JOIN countries USING (country)),
    syn AS (SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR) AS synonym,
                   'brand#' || CAST((n_nationkey + 1) % 25 AS VARCHAR) AS accepted FROM nr WHERE r_name = 'EUROPE'),
    named AS (
        SELECT * EXCLUDE (scientific_name), regexp_replace(upper(left(sn, 1)) || lower(substr(sn, 2)), '\.', '') AS scientific_name
        FROM (SELECT *, coalesce(accepted, scientific_name) AS sn FROM stacked LEFT JOIN syn ON scientific_name = synonym)),
    labelled AS (
        SELECT scientific_name, state, presentation, state || ', ' || presentation AS landings_code, conversion_factor, country,
               iso3c, iso2c, note, reference,
               CASE WHEN continent = 'Europe' AND (iso3c = 'EU' OR iso3c IN (
                         SELECT 'N' || n_nationkey FROM nr WHERE r_name = 'EUROPE')) THEN 'EU'
                    WHEN continent = 'Europe' THEN 'European, non-EU' ELSE 'other' END AS continent_affiliation,
               CASE iso3c WHEN 'EU' THEN 'EU-wide CF' ELSE 'national CF' END AS implementation,
               count(*) OVER (PARTITION BY scientific_name, state || ', ' || presentation, iso3c) AS n
        FROM named)
    SELECT * EXCLUDE (n) FROM labelled
    WHERE n = 1 OR reference IN ('EU Council Regulations Annex', 'EU Council Website Third Country Info')""")
def compiled(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    shown = F.when(F.col("n_nationkey") == 0, "EU").when(F.col("n_nationkey") == 2, "UK").when(F.col("n_nationkey") == 5, "Greenland")
    nation = nation.withColumn("n_name", F.coalesce(shown, "n_name"))
    part = table(spark, sf, "part").join(nation, F.expr("n_nationkey = p_size % 25"))
    adj, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    factor = F.round(1 + (F.col("p_retailprice") - 900) / 100, 3)
    states = {"STANDARD": "FRE", "ECONOMY": "FRO", "MEDIUM": "SAL", "SMALL": "ALI"}
    national = part.select(
        F.col("n_name").alias("country"), F.concat("p_brand", F.lit(". spp.")).alias("scientific_name"),
        cases_of(F.col("p_type"), states, "DRI").alias("state"),
        cases_of(noun, {"ring": "GUT", "bolt": "GUH", "widget": "WHL"}, "OTH").alias("presentation"),
        factor.alias("factor"),
        F.when(adj == "red", "see list of CCF").when(adj != "blue", adj).alias("note"),
        F.when(adj == "small", "EU Council Regulations Annex").otherwise("FAO").alias("reference"))
    third_country = table(spark, sf, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).select(
        F.col("n_name").alias("country"),
        F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string"), F.lit(". spp.")).alias("scientific_name"),
        F.lit("FRE").alias("state"), F.lit("GUT").alias("presentation"), (1 + F.col("s_nationkey") / 100).alias("factor"),
        F.lit(None).cast("string").alias("note"), F.lit("EU Council Website Third Country Info").alias("reference"))
    texts = {"ring": "Frozen, ring", "bolt": "Fresh, bolt", "gear": "Salted, gear", "plate": "alive plate"}
    reference = (F.when(adj == "old", "EU Council Regulations Annex").when(adj == "hot", "EUMOFA Appendix 7")
                 .otherwise("FAO 2000"))
    superseded = (F.col("n_name") == "NATION_3") & (noun == "bolt")
    general = part.select(
        F.when(F.col("p_type") == "PROMO", "Aquatic plants").otherwise("Fishes").alias("Type"),
        F.when(superseded, " ").otherwise(F.col("p_brand")).alias("Species"), noun.alias("Common.name"),
        F.coalesce(cases_of(noun, texts, "Dried, anvil")).alias("Type.of.Processing"),
        F.lower("n_name").alias("Country"), factor.alias("Conversion.factor"), adj.alias("Note"), reference.alias("REF"))
    curated = spark.sql("""
        SELECT * FROM VALUES ('frozen ring', 'GUT'), ('frozen ring', 'GTA'), ('fresh bolt', 'GUH'), ('salted gear', 'FIL'),
                             ('alive plate', 'WHL'), ('dried anvil', 'WHL'), ('smoked', '')
        AS t(type_of_processing, presentation)""")
    synonyms = nation.select(
        F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("synonym"),
        F.concat(F.lit("brand#"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("accepted"),
        F.when(F.col("r_name") == "EUROPE", "synonym").otherwise("accepted name").alias("status"))
    # The bloc, the spelling UK and the continent of Greenland come from the library's own rows.
    listed = F.when(F.col("n_name") == "UK", "United Kingdom").otherwise(F.col("n_name"))
    european = F.col("r_name").isin("EUROPE", "MIDDLE EAST") & (F.col("n_name") != "Greenland")
    countries = nation.where("n_nationkey <> 0").select(
        F.lower(listed).alias("name_key"), listed.alias("country"), nation_code("n_nationkey").alias("iso3c"),
        F.lower(nation_code("n_nationkey")).alias("iso2c"),
        F.when(european, "Europe").otherwise(F.col("r_name")).alias("continent"))
    return factor_jobs.compile_factors(national, third_country, general, curated, synonyms, countries, members(spark, sf))


@query("short_sources", sql("fv", """
    SELECT p_partkey, CASE reference WHEN 'red' THEN 'EU Council' WHEN 'blue' THEN 'FAO'
                      WHEN 'old' THEN 'National Fisheries Authority' ELSE reference END AS reference FROM fv"""))
def sources(spark: SparkSession, sf: str) -> DataFrame:
    long = {"red": "EU Council Regulations Annex", "blue": "FAO 2000", "old": "EU Council Website Third Country Info"}
    rows = factors(spark, sf).select("p_partkey", cases_of(F.col("reference"), long).alias("reference"))
    return factor_jobs.short_sources(rows)


@query("spread_labels", """
    SELECT p_partkey, country, upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS scientific_name,
           common_name, lower(p_type) AS type_of_processing, p_brand || ' (' || lower(p_type) || ')' AS Species_prep,
           common_name || ' (' || lower(p_type) || ')' AS Common_name_prep,
           CASE WHEN country IN ('Russia', 'UK') THEN 'non-EU' ELSE 'EU' END AS State_membership
    FROM (SELECT *, CASE n_nationkey WHEN 1 THEN 'Bulgaria' WHEN 2 THEN 'UK' WHEN 3 THEN 'Russia' WHEN 4 THEN 'Hong Kong'
                                     WHEN 5 THEN 'Nation five' ELSE n_name END AS country,
                 CASE WHEN p_name = 'red ring' THEN 'Monkfish' WHEN p_name = 'blue bolt' THEN 'Common ling'
                      WHEN p_name LIKE '% gear' THEN 'Piked dogfish' WHEN p_name = 'old plate' THEN 'Greenland halibut'
                      ELSE p_name END AS common_name
          FROM part JOIN nation ON p_size % 25 = n_nationkey WHERE n_nationkey <> 0)
    WHERE NOT (common_name = 'Greenland halibut' AND p_type = 'SMALL')""".replace("lower(p_type)",
    "CASE p_type WHEN 'SMALL' THEN 'frozen' ELSE lower(p_type) END"))
def labelled_spread(spark: SparkSession, sf: str) -> DataFrame:
    spelt = {0: "Eu", 1: "BULG", 2: "Uk", 3: "Russian Federation", 4: "China, H. Kong"}
    key = F.col("n_nationkey").cast("string")
    country = recode(key, {str(k): name for k, name in spelt.items()}, "")
    names = {"red ring": "Angler(=Monk)", "blue bolt": "Ling", "old plate": "Greenland halibut"}
    common = F.when(F.col("p_name").endswith(" gear"), F.concat("p_name", F.lit(" dogfish"))).otherwise(recode("p_name", names))
    rows = table(spark, sf, "part").join(table(spark, sf, "nation"), F.expr("p_size % 25 = n_nationkey")).select(
        "p_partkey", F.when(country != "", country).otherwise(F.col("n_name")).alias("country"),
        F.upper("p_brand").alias("scientific_name"), common.alias("common_name"),
        F.when(F.col("p_type") == "SMALL", "frozen").otherwise(F.lower("p_type")).alias("type_of_processing"))
    return factor_jobs.spread_labels(rows, countries={"nation_5": "Nation five"})


@query("taxa_of_codes", """
    SELECT Code, Taxa, CASE WHEN Code = '16043' THEN 'caviar' ELSE p_type END AS Separation
    FROM (SELECT DISTINCT '1604' || CAST(p_size % 10 AS VARCHAR) AS Code,
                          unnest(string_split(p_brand || ', ' || p_name, ', ')) AS Taxa, p_type FROM part)""")
def code_taxa(spark: SparkSession, sf: str) -> DataFrame:
    codes = table(spark, sf, "part").select(
        F.concat(F.lit("1604"), (F.col("p_size") % 10).cast("string")).alias("Code"),
        F.concat_ws(", ", "p_brand", "p_name").alias("Taxa"), F.col("p_type").alias("Separation"))
    return factor_jobs.taxa_of_codes(codes)


# Landings files

def dictionaries(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    part, nation = table(spark, sf, "part"), table(spark, sf, "nation")
    taxa = part.groupBy("p_brand").agg(F.min("p_name").alias("name"))
    species = taxa.select(
        F.col("p_brand").alias("code"),
        F.when(F.col("name") < "blue gear", F.concat_ws(" - ", "name", "p_brand")).otherwise(F.col("name")).alias("label"))
    nations = nation.select(nation_code("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    forms = spark.sql("SELECT * FROM VALUES ('SMALL', 'Fresh, small'), ('PROMO', 'Fresh') AS t(code, label)")
    tables = {"species": species, "pres": forms, "natvessr": nations}
    read = {name: read_code_dictionary(spark, write_dictionary(d, f"{name}.dic")) for name, d in tables.items()}
    return read | {"fishreg": read["pres"], "geo": read["natvessr"]}


SQL_TAXA = """
    taxa AS (SELECT p_brand AS scientific_name, min(p_name) AS common_name,
                    CASE WHEN min(p_name) < 'blue gear' THEN coalesce(any_value(accepted), p_brand) END AS name
             FROM part LEFT JOIN (SELECT 'Brand#' || n_nationkey AS synonym, n_name AS accepted FROM nation
                                  JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE') ON synonym = p_brand
             GROUP BY p_brand)"""


def synonyms_of_taxa(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    return nation.select(
        F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("synonym"), F.col("n_name").alias("accepted"),
        F.when(F.col("r_name") == "EUROPE", "synonym").otherwise("provisional").alias("status"))


def wide_files(spark: SparkSession, sf: str, keys: list[str], header: str, name: str) -> list[str]:
    """The files that a folder lists: two kinds whose year columns run in opposite order, and a file of totals that is dropped."""
    rows = landings(spark, sf).withColumns({"dest_use": F.lit("TOTAL"), "geo": F.col("iso3c")})
    years = calendar(table(spark, sf, "lineitem"))
    folder = new_scratch_path(spark, "wide")
    parts = {"f": (rows.where("unit = 'F'"), years), "o": (rows.where("unit = 'O'"), years[::-1])}
    cells = {part: wide_cells(df, keys, "value", order) for part, (df, order) in parts.items()}
    totals = rows.withColumns({k: F.lit("all") for k in keys if k not in ("unit", "dest_use")})
    # The list leaves out one file of totals; they are summed wherever the rows are, and only then brought together.
    cells["main"] = wide_cells(totals, keys, "value", years).repartition(1)
    for part, wide in cells.items():
        written = write_wide(wide, keys, header, f"{name}-{part}")
        move_files(spark, written, folder, f"{name}_{part}")
    return list_wide_files(spark, folder, name)


@query("clean_landings", sql("lv", f"""
    SELECT common_name, name AS scientific_name, scientific_name AS species_code,
           CASE presentation WHEN 'SMALL' THEN 'Fresh, small' WHEN 'PROMO' THEN 'Fresh' ELSE presentation END AS presentation,
           presentation AS presentation_code, 'TOTAL' AS use, unit, n_name AS nationality_of_vessel,
           iso3c AS nationality_of_vessel_code, n_name AS reporting_entity, iso3c AS reporting_entity_code, year, value, flag
    FROM cells JOIN taxa USING (scientific_name) JOIN nation ON iso3c = 'N' || n_nationkey""",
    SQL_CELLS.format(keys="scientific_name, presentation, unit, iso3c", source="lv") + "," + SQL_TAXA))
def landings_files(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["scientific_name", "presentation", "dest_use", "iso3c", "unit", "geo"]
    paths = wide_files(spark, sf, keys, "species,pres,dest_use,natvessr,unit,geo\\time", "fish_ld")
    tidy = clean_landings(spark, paths, dictionaries(spark, sf), synonyms_of_taxa(spark, sf))
    return tidy.drop("source_file")


@query("clean_catch", sql("lv", f"""
    SELECT common_name, name AS scientific_name, scientific_name AS species_code,
           CASE presentation WHEN 'SMALL' THEN 'Fresh, small' WHEN 'PROMO' THEN 'Fresh' ELSE presentation END AS fishing_region,
           presentation AS fishing_region_code, unit, n_name AS reporting_entity, iso3c AS reporting_entity_code,
           year, value, flag
    FROM cells JOIN taxa USING (scientific_name) JOIN nation ON iso3c = 'N' || n_nationkey""",
    SQL_CELLS.format(keys="scientific_name, presentation, unit, iso3c", source="lv") + "," + SQL_TAXA))
def catch_files(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["scientific_name", "presentation", "unit", "geo"]
    paths = wide_files(spark, sf, keys, "species,fishreg,unit,geo\\time", "fish_ca")
    return clean_catch(spark, paths, dictionaries(spark, sf), synonyms_of_taxa(spark, sf)).drop("source_file")


@query("vessel_and_port_countries", """
    SELECT 'N' || CAST(v.n_nationkey AS VARCHAR) AS iso3c, v.n_name AS iso2c, 'N' || CAST(p.n_nationkey AS VARCHAR) AS port_iso3c,
           p.n_name AS port_iso2c, count(*) AS n, sum(l_quantity) AS value
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
         JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') v
         ON s_nationkey = v.n_nationkey
    LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') p
         ON c_nationkey = p.n_nationkey
    GROUP BY ALL""")
def vessel_and_port(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    known = nation.where("r_name <> 'ASIA'").select(
        F.lower("n_name").alias("name_key"), nation_code("n_nationkey").alias("iso3c"), F.col("n_name").alias("iso2c"))

    def spelt(key: str, name: str) -> Column:
        return F.concat(F.lit("Nation_"), F.col(key).cast("string")).alias(name)

    vessels = table(spark, sf, "supplier").select("s_suppkey", spelt("s_nationkey", "nationality_of_vessel"))
    ports = table(spark, sf, "customer").select("c_custkey", spelt("c_nationkey", "reporting_entity"))
    rows = (table(spark, sf, "lineitem").join(vessels, F.expr("l_suppkey = s_suppkey"))
            .join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).join(ports, F.expr("o_custkey = c_custkey"))
            .groupBy("nationality_of_vessel", "reporting_entity").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("value")))
    coded = with_countries(rows, known).groupBy("iso3c", "iso2c", "port_iso3c", "port_iso2c")
    return coded.agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


# Catch

@query("catch_min_max_by_product", sql("lv fv", """
    SELECT scientific_name, presentation, year, year_landings, min_cf, max_cf, min_iso3c, max_iso3c,
           round(year_landings * min_cf, 4) AS year_catch_min, round(year_landings * max_cf, 4) AS year_catch_max
    FROM (SELECT scientific_name, presentation, year, sum(value) AS year_landings FROM lv WHERE year >= 1996
          AND iso3c IN (SELECT 'N' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
          GROUP BY ALL)
    LEFT JOIN (SELECT scientific_name, landings_code AS presentation, min(low) AS min_cf, max(high) AS max_cf,
                      string_agg(DISTINCT CASE WHEN conversion_factor = low THEN iso3c END, ', '
                                 ORDER BY CASE WHEN conversion_factor = low THEN iso3c END) AS min_iso3c,
                      string_agg(DISTINCT CASE WHEN conversion_factor = high THEN iso3c END, ', '
                                 ORDER BY CASE WHEN conversion_factor = high THEN iso3c END) AS max_iso3c
               FROM (SELECT *, min(conversion_factor) OVER w AS low, max(conversion_factor) OVER w AS high
                     FROM fv WINDOW w AS (PARTITION BY scientific_name, landings_code)) GROUP BY ALL)
         USING (scientific_name, presentation)"""))
def min_max_products(spark: SparkSession, sf: str) -> DataFrame:
    by_product = catch.min_max_by_product(landings(spark, sf), factors(spark, sf), members(spark, sf), first_year=1996)
    return rounded(by_product, "year_catch_min", "year_catch_max")


ALL_BUT_RED = ["blue", "cold", "hot", "large", "new", "old", "small"]


@query("catch_min_max_series", sql("lv fv", """
    SELECT scientific_name, year, round(sum(landings * min_cf), 4) AS year_total_catch_min,
           round(sum(landings * max_cf), 4) AS year_total_catch_max,
           sum(CASE WHEN min_cf IS NULL THEN landings END) AS year_landings_no_cf,
           round(sum(landings * max_cf) - sum(landings * min_cf), 4) AS difference
    FROM (SELECT scientific_name, presentation, year, sum(value) AS landings FROM lv GROUP BY ALL)
    LEFT JOIN (SELECT scientific_name, landings_code AS presentation, min(conversion_factor) AS min_cf,
                      max(conversion_factor) AS max_cf FROM fv WHERE reference <> 'red' GROUP BY ALL)
         USING (scientific_name, presentation)
    GROUP BY ALL"""))
def min_max_series(spark: SparkSession, sf: str) -> DataFrame:
    by_product = catch.min_max_by_product(landings(spark, sf), factors(spark, sf), sources=ALL_BUT_RED)
    series = catch.catch_min_max_series(by_product)
    return rounded(series, "year_total_catch_min", "year_total_catch_max", "difference")


SQL_SERIES = """
    both_cf AS (SELECT a.scientific_name, a.landings_code AS presentation, a.iso3c, a.conversion_factor AS nat,
                       b.conversion_factor AS wide
                FROM cv a JOIN (SELECT * FROM cv WHERE iso3c = 'EU') b USING (scientific_name, landings_code)),
    sums AS (SELECT scientific_name, iso3c, year, sum(value * nat) AS n, sum(value * wide) AS w
             FROM lv JOIN both_cf USING (scientific_name, presentation, iso3c) GROUP BY ALL),
    grid AS (SELECT scientific_name, iso3c, CAST(unnest(generate_series(min(year), max(year))) AS INTEGER) AS year
             FROM sums GROUP BY scientific_name, iso3c),
    series AS (SELECT scientific_name, iso3c, year, round(coalesce(n, 0), 4) AS national_catch,
                      round(coalesce(w, 0), 4) AS EU_catch, round(coalesce(n, 0) - coalesce(w, 0), 4) AS difference
               FROM grid LEFT JOIN sums USING (scientific_name, iso3c, year))"""


def national_series(spark: SparkSession, sf: str) -> DataFrame:
    series = catch.catch_national_vs_wide(landings(spark, sf), factors(spark, sf), digits=4)
    return rounded(series, "national_catch", "EU_catch", "difference")


@query("catch_national_vs_wide", sql("lv cv", "SELECT * FROM series", SQL_SERIES))
def national_vs_wide(spark: SparkSession, sf: str) -> DataFrame:
    return national_series(spark, sf)


@query("catch_per_presentation", sql("lv fv cv", """
    SELECT l.common_name, l.scientific_name, l.presentation, l.iso3c, l.year, landings, n.cf AS national_CF, n.ref AS national_ref,
           w.cf AS EU_wide_CF, w.ref AS EU_ref, round(landings * n.cf, 4) AS catch_by_national_CF,
           round(landings * w.cf, 4) AS catch_by_EU_wide_CF
    FROM (SELECT common_name, scientific_name, presentation, iso3c, year, sum(value) AS landings FROM lv GROUP BY ALL) l
    LEFT JOIN own n ON l.scientific_name = n.scientific_name AND l.presentation = n.landings_code AND l.iso3c = n.iso3c
    LEFT JOIN own w ON l.scientific_name = w.scientific_name AND l.presentation = w.landings_code AND w.iso3c = 'EU'""", """
    own AS (SELECT scientific_name, landings_code, iso3c, any_value(cv.conversion_factor) AS cf,
                   string_agg(DISTINCT reference, ', ' ORDER BY reference) AS ref
            FROM cv JOIN fv USING (scientific_name, landings_code, iso3c) GROUP BY ALL)"""))
def per_presentation(spark: SparkSession, sf: str) -> DataFrame:
    found = catch.catch_per_presentation(landings(spark, sf), factors(spark, sf), ["common_name"], digits=4)
    return rounded(found, "catch_by_national_CF", "catch_by_EU_wide_CF")


@query("largest_gaps", sql("lv cv", """
    SELECT *, abs(difference) AS gap FROM series
    WHERE (scientific_name, abs(difference)) IN (SELECT (scientific_name, max(abs(difference))) FROM series
                                                 GROUP BY scientific_name)""", SQL_SERIES))
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return catch.largest_gaps(national_series(spark, sf), ["scientific_name"])


SQL_COVERED = """
    SELECT scientific_name, iso3c, year, factor, sum(landings) AS landings, round(coalesce(sum(landings * factor), 0), 4) AS catch,
           CASE WHEN factor IS NULL THEN '{bucket}' ELSE presentation END AS presentation,
           CASE WHEN factor IS NULL THEN 'unaccounted' ELSE 'catch' END AS catch_vs_unaccounted
    FROM (SELECT scientific_name, presentation, iso3c, year, sum(value) AS landings FROM lv GROUP BY ALL)
    LEFT JOIN ({factors}) USING ({keys}) GROUP BY ALL"""


@query("landings_by_national_coverage", sql("lv cv", SQL_COVERED.format(
    bucket="no national CF value", keys="scientific_name, presentation, iso3c",
    factors="SELECT scientific_name, landings_code AS presentation, iso3c, conversion_factor AS factor FROM cv")))
def by_national_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(catch.landings_by_coverage(landings(spark, sf), factors(spark, sf), digits=4), "catch")


@query("landings_by_wide_coverage", sql("lv cv", SQL_COVERED.format(
    bucket="no EU-wide CF value", keys="scientific_name, presentation",
    factors="SELECT scientific_name, landings_code AS presentation, conversion_factor AS factor FROM cv "
            "WHERE iso3c = 'EU'")))
def by_wide_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(catch.landings_by_coverage(landings(spark, sf), factors(spark, sf), wide=True, digits=4), "catch")


SQL_STUDY = SQL_CASES + """,
    seen AS (SELECT DISTINCT scientific_name, presentation, common_name, reporting_entity, iso3c, port_iso3c, year, value
             FROM lvp JOIN (SELECT scientific_name, landings_code AS presentation FROM cases)
                  USING (scientific_name, presentation)),
    peak AS (SELECT * EXCLUDE (best) FROM (
                 SELECT *, max(value) OVER (PARTITION BY scientific_name, presentation, iso3c) AS best FROM seen)
             WHERE value = best),
    nat AS (SELECT scientific_name, landings_code AS presentation, iso3c, conversion_factor AS cf, reference FROM fv
            WHERE iso3c <> 'EU'),
    caught AS (
        SELECT p.*, v.cf AS vessel_CF, v.reference AS vessel_ref, h.cf AS port_CF, h.reference AS port_ref, EU_CF, EU_ref, round(value * v.cf, 4) AS catch_by_vessel_CF,
               round(value * h.cf, 4) AS catch_by_port_CF, round(value * EU_CF, 4) AS catch_by_EU_CF
        FROM peak p LEFT JOIN nat v USING (scientific_name, presentation, iso3c)
        LEFT JOIN nat h ON p.scientific_name = h.scientific_name AND p.presentation = h.presentation AND port_iso3c = h.iso3c
        LEFT JOIN (SELECT scientific_name, landings_code AS presentation, max(conversion_factor) AS EU_CF,
                          string_agg(DISTINCT reference, ', ' ORDER BY reference) AS EU_ref
                   FROM fv WHERE iso3c = 'EU' GROUP BY ALL) w
             ON p.scientific_name = w.scientific_name AND p.presentation = w.presentation),
    study AS (SELECT DISTINCT * FROM caught WHERE (scientific_name, presentation, year) IN (
                  SELECT (scientific_name, presentation, year) FROM caught WHERE catch_by_vessel_CF <> catch_by_EU_CF))"""


def study(spark: SparkSession, sf: str) -> DataFrame:
    wanted = materialise(cases(spark, sf).select("scientific_name", "landings_code").distinct(), "cases")
    landed = landings(spark, sf, port=True, products=wanted, years=(1995, 2001))
    found = catch.case_study_catch(landed, factors(spark, sf), wanted, range(1995, 2002), labels=["common_name", "reporting_entity"])
    return rounded(found, "catch_by_vessel_CF", "catch_by_port_CF", "catch_by_EU_CF")


@query("case_study_catch", sql("lvp fv", "SELECT * FROM study", SQL_STUDY))
def case_study(spark: SparkSession, sf: str) -> DataFrame:
    return study(spark, sf)


@query("case_study_by_year", sql("lv fv", """
    SELECT * FROM caught WHERE (scientific_name, presentation, year) IN (
        SELECT (scientific_name, presentation, year) FROM caught WHERE catch_by_vessel_CF <> catch_by_EU_CF)
    """, SQL_CASES + """,
    yearly AS (SELECT scientific_name, presentation, iso3c, year, sum(value) AS value
               FROM lv JOIN (SELECT scientific_name, landings_code AS presentation FROM cases)
                    USING (scientific_name, presentation) WHERE year >= 1999 GROUP BY ALL),
    peak AS (SELECT * EXCLUDE (best) FROM (
                 SELECT *, max(value) OVER (PARTITION BY scientific_name, presentation, iso3c) AS best FROM yearly)
             WHERE value = best),
    caught AS (
        SELECT DISTINCT scientific_name, presentation, iso3c, year, value, cf AS vessel_CF, vessel_ref, EU_CF, EU_ref,
               round(value * cf, 4) AS catch_by_vessel_CF, round(value * EU_CF, 4) AS catch_by_EU_CF
        FROM peak LEFT JOIN (SELECT scientific_name, landings_code AS presentation, iso3c, conversion_factor AS cf,
                                    reference AS vessel_ref FROM fv WHERE iso3c <> 'EU') USING (scientific_name, presentation, iso3c)
        LEFT JOIN (SELECT scientific_name, landings_code AS presentation, max(conversion_factor) AS EU_CF,
                          string_agg(DISTINCT reference, ', ' ORDER BY reference) AS EU_ref
                   FROM fv WHERE iso3c = 'EU' GROUP BY ALL) USING (scientific_name, presentation))"""))
def case_study_yearly(spark: SparkSession, sf: str) -> DataFrame:
    wanted = materialise(cases(spark, sf).select("scientific_name", "landings_code").distinct(), "cases")
    landed = landings(spark, sf, products=wanted, years=(1999, 2001))
    found = catch.case_study_catch(landed, factors(spark, sf), wanted, (1999, 2000, 2001), "year")
    return rounded(found, "catch_by_vessel_CF", "catch_by_EU_CF")


@query("case_study_long", sql("lvp fv mv", """
    SELECT *, row_number() OVER (PARTITION BY scientific_name, presentation, vessel
                                 ORDER BY calculation, year, port_iso3c, value) AS index_to_plot_all_values
    FROM (SELECT DISTINCT scientific_name, presentation, iso3c, port_iso3c, year, calculation, value,
                 CASE WHEN iso3c IN (SELECT iso3c FROM mv) THEN iso3c ELSE iso3c || '*' END AS vessel
          FROM (SELECT scientific_name, presentation, iso3c, port_iso3c, year, 'landings' AS calculation, value FROM study
                UNION ALL SELECT scientific_name, presentation, iso3c, port_iso3c, year, 'catch_by_vessel_CF',
                                 catch_by_vessel_CF FROM study
                UNION ALL SELECT scientific_name, presentation, iso3c, port_iso3c, year, 'catch_by_EU_CF',
                                 catch_by_EU_CF FROM study))""", SQL_STUDY))
def case_study_rows(spark: SparkSession, sf: str) -> DataFrame:
    return catch.case_study_long(study(spark, sf), members(spark, sf))


@query("value_catch", sql("lv", """
    SELECT *, value * Euro_per_tonne AS Euros
    FROM (SELECT scientific_name, presentation, iso3c, year, sum(value) AS value FROM lv GROUP BY ALL)
    LEFT JOIN (SELECT scientific_name, presentation, iso3c, Euro_per_tonne FROM (
                   SELECT *, max(year) OVER (PARTITION BY scientific_name, presentation, iso3c) AS latest FROM (
                       SELECT scientific_name, presentation, iso3c, year, round(sum(price), 2) / sum(value) AS Euro_per_tonne
                       FROM lv GROUP BY ALL)) WHERE year = latest) USING (scientific_name, presentation, iso3c)"""))
def valued(spark: SparkSession, sf: str) -> DataFrame:
    yearly = landings(spark, sf).groupBy(*PRODUCT, "iso3c", "year").agg(
        F.sum("value").alias("value"), (F.round(F.sum("price"), 2) / F.sum("value")).alias("Euro_per_tonne"))
    yearly = materialise(yearly, "yearly")
    return catch.value_catch(yearly.drop("Euro_per_tonne"), yearly.drop("value"))


@query("landings_against_catch", sql("lv", """
    SELECT scientific_name, iso3c, year, sum(CASE WHEN unit = 'O' THEN value END) AS landings,
           sum(CASE WHEN unit = 'F' THEN value END) AS catch,
           sum(CASE WHEN unit = 'O' THEN value END) - sum(CASE WHEN unit = 'F' THEN value END) AS difference
    FROM lv GROUP BY ALL"""))
def against_catch(spark: SparkSession, sf: str) -> DataFrame:
    rows = landings(spark, sf)
    return catch.landings_against_catch(rows.where("unit = 'O'"), rows.where("unit = 'F'"), ["scientific_name", "iso3c"])


# Coverage

SQL_HELD = """
    held AS (SELECT p_brand AS scientific_name, p_type || ' ' || split_part(p_name, ' ', 2) AS presentation,
                    CASE WHEN p_size % 25 = 0 THEN 'EU' ELSE 'N' || CAST(p_size % 25 AS VARCHAR) END AS iso3c
             FROM part WHERE split_part(p_name, ' ', 1) IN ('red', 'blue', 'old')),
    landed_rows AS (SELECT p_brand AS scientific_name, p_type || ' ' || split_part(p_name, ' ', 2) AS presentation,
                           'N' || CAST(s_nationkey AS VARCHAR) AS iso3c, l_quantity AS value
                    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
    landed AS (SELECT DISTINCT scientific_name, presentation, iso3c FROM landed_rows),
    grid AS (SELECT * FROM (SELECT DISTINCT scientific_name FROM landed) CROSS JOIN (SELECT DISTINCT presentation FROM landed))"""


SOURCES = ["red", "blue", "old"]


def held_and_landed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Finer presentations, so that some are never landed; the jobs take factors of three sources."""
    return landings(spark, sf, fine=True), factors(spark, sf, fine=True)


@query("coverage_grid", sql("", """
    SELECT scientific_name, presentation, n_countries_landing,
           CASE WHEN n_countries_landing IS NOT NULL THEN coalesce(n_held, 0) END AS n_CF, n_CF_with_landings,
           n_CF_with_landings / n_countries_landing AS proportion_have_CF, countries_landing,
           CASE WHEN n_countries_landing IS NOT NULL THEN coalesce(listed, '') END AS "countries_with_CF"
    FROM grid LEFT JOIN (
        SELECT scientific_name, presentation, count(*) AS n_countries_landing, count(h.iso3c) AS n_CF_with_landings,
               string_agg(landed.iso3c, ', ' ORDER BY landed.iso3c) AS countries_landing
        FROM landed LEFT JOIN (SELECT DISTINCT * FROM held) h USING (scientific_name, presentation, iso3c)
        GROUP BY scientific_name, presentation) USING (scientific_name, presentation)
    LEFT JOIN (SELECT scientific_name, presentation, count(DISTINCT iso3c) AS n_held,
                      string_agg(DISTINCT iso3c, ', ' ORDER BY iso3c) AS listed FROM held GROUP BY ALL)
         USING (scientific_name, presentation)""", SQL_HELD))
def coverage_cells(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage_grid(*held_and_landed(spark, sf), sources=SOURCES)


SQL_STATUS = SQL_HELD + """,
    status AS (
        SELECT scientific_name, presentation,
               CASE WHEN l.scientific_name IS NULL THEN 'not landed' WHEN wide THEN 'EU-wide CF value available'
                    ELSE 'not available' END AS EU_CF,
               CASE WHEN l.scientific_name IS NULL THEN 'not landed' WHEN wide IS NULL THEN 'no' ELSE 'yes' END AS any_CF
        FROM grid g LEFT JOIN (SELECT DISTINCT scientific_name, presentation FROM landed) l
             USING (scientific_name, presentation)
        LEFT JOIN (SELECT scientific_name, presentation, bool_or(iso3c = 'EU') AS wide FROM held GROUP BY ALL)
             USING (scientific_name, presentation))"""


@query("availability_grid", sql("", "SELECT * FROM status", SQL_STATUS))
def availability(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.availability_grid(*held_and_landed(spark, sf), sources=SOURCES)


@query("availability_counts", sql("", """
    SELECT count(*) FILTER (any_CF = 'not landed') AS not_landed, count(*) FILTER (any_CF = 'no') AS landed_no_factor,
           count(*) FILTER (any_CF = 'yes') AS landed_with_factor, count(*) AS cells FROM status""", SQL_STATUS))
def availability_totals(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.availability_totals(*held_and_landed(spark, sf), sources=SOURCES)


@query("missing_factors", sql("", """
    SELECT DISTINCT scientific_name, presentation FROM landed
    WHERE (scientific_name, presentation) NOT IN (SELECT (scientific_name, presentation) FROM held)""", SQL_HELD))
def without_factor(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.missing_factors(*held_and_landed(spark, sf), sources=SOURCES)


SQL_MEMBER_HELD = """
    m AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS iso3c FROM nation JOIN region ON n_regionkey = r_regionkey
          WHERE r_name = 'EUROPE'),
    landed AS (SELECT DISTINCT p_brand AS scientific_name, p_type || ' ' || split_part(p_name, ' ', 2) AS presentation,
                               'N' || CAST(s_nationkey AS VARCHAR) AS iso3c
               FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
               WHERE 'N' || CAST(s_nationkey AS VARCHAR) IN (SELECT iso3c FROM m)),
    held AS (SELECT p_brand AS scientific_name, p_type || ' ' || split_part(p_name, ' ', 2) AS presentation,
                    CASE WHEN p_size % 25 = 0 THEN 'EU' ELSE 'N' || CAST(p_size % 25 AS VARCHAR) END AS iso3c
             FROM part WHERE p_size % 25 = 0 OR 'N' || CAST(p_size % 25 AS VARCHAR) IN (SELECT iso3c FROM m))"""


def fine_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return landings(spark, sf, fine=True), factors(spark, sf, fine=True), members(spark, sf)


@query("coverage_grid_of_members", sql("", """
    SELECT scientific_name, presentation, n_countries_landing,
           CASE WHEN n_countries_landing IS NOT NULL THEN coalesce(n_held, 0) END AS n_CF, n_CF_with_landings,
           n_CF_with_landings / n_countries_landing AS proportion_have_CF, countries_landing,
           CASE WHEN n_countries_landing IS NOT NULL THEN coalesce(listed, '') END AS "countries_with_CF"
    FROM (SELECT DISTINCT scientific_name FROM landed) CROSS JOIN (SELECT DISTINCT presentation FROM landed)
    LEFT JOIN (
        SELECT scientific_name, presentation, count(*) AS n_countries_landing, count(h.iso3c) AS n_CF_with_landings,
               string_agg(landed.iso3c, ', ' ORDER BY landed.iso3c) AS countries_landing
        FROM landed LEFT JOIN (SELECT DISTINCT * FROM held) h USING (scientific_name, presentation, iso3c)
        GROUP BY scientific_name, presentation) USING (scientific_name, presentation)
    LEFT JOIN (SELECT scientific_name, presentation, count(DISTINCT iso3c) AS n_held,
                      string_agg(DISTINCT iso3c, ', ' ORDER BY iso3c) AS listed FROM held WHERE iso3c <> 'EU'
               GROUP BY ALL) USING (scientific_name, presentation)""", SQL_MEMBER_HELD))
def member_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage_grid(*fine_tables(spark, sf))


@query("availability_grid_of_members", sql("", """
    SELECT g.scientific_name, g.presentation,
           CASE WHEN l.scientific_name IS NULL THEN 'not landed' WHEN wide THEN 'EU-wide CF value available'
                ELSE 'not available' END AS EU_CF,
           CASE WHEN l.scientific_name IS NULL THEN 'not landed' WHEN wide IS NULL THEN 'no' ELSE 'yes' END AS any_CF
    FROM (SELECT * FROM (SELECT DISTINCT scientific_name FROM landed)
          CROSS JOIN (SELECT DISTINCT presentation FROM landed)) g
    LEFT JOIN (SELECT DISTINCT scientific_name, presentation FROM landed) l USING (scientific_name, presentation)
    LEFT JOIN (SELECT scientific_name, presentation, bool_or(iso3c = 'EU') AS wide FROM held GROUP BY ALL)
         USING (scientific_name, presentation)""", SQL_MEMBER_HELD))
def member_availability(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.availability_grid(*fine_tables(spark, sf))


@query("missing_factors_of_members", sql("", """
    SELECT DISTINCT scientific_name, presentation FROM landed
    WHERE (scientific_name, presentation) NOT IN (SELECT (scientific_name, presentation) FROM held)""", SQL_MEMBER_HELD))
def members_without_factor(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.missing_factors(*fine_tables(spark, sf))


@query("vague_shares", sql("lv", f"""
    SELECT pattern, sum(CASE WHEN regexp_matches(presentation, pattern) THEN value ELSE 0 END) / sum(value) AS share
    FROM (SELECT presentation, sum(value) AS value FROM lv GROUP BY ALL)
         CROSS JOIN (VALUES {", ".join("('" + p.replace("'", "''") + "')" for p in vocab.VAGUE_PATTERNS)}) p(pattern)
    GROUP BY pattern"""))
def vague(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.vague_shares(landings(spark, sf))


@query("top_taxa", sql("lv", """
    SELECT scientific_name, total, sum(total) OVER w AS cumulative_sum,
           sum(total) OVER w / sum(total) OVER () AS proportion
    FROM (SELECT scientific_name, sum(value) AS total FROM lv GROUP BY 1)
    WINDOW w AS (ORDER BY total DESC, scientific_name ROWS UNBOUNDED PRECEDING)
    ORDER BY total DESC, scientific_name LIMIT 10"""))
def leading_taxa(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.top_taxa(landings(spark, sf), 10)


@query("grid_of_top_taxa", sql("", """
    SELECT * FROM status WHERE scientific_name IN (
        SELECT scientific_name FROM landed_rows GROUP BY 1 ORDER BY sum(value) DESC, scientific_name LIMIT 10)""", SQL_STATUS))
def top_grid(spark: SparkSession, sf: str) -> DataFrame:
    landed, held = held_and_landed(spark, sf)
    # The grid and the ranking of taxa both start from this stored sum.
    landed = materialise(landed.groupBy(*PRODUCT, "iso3c").agg(F.sum("value").alias("value")), "landed")
    return coverage.availability_grid(landed, held, sources=SOURCES, taxa=coverage.top_taxa(landed, 10))


# Trade

@query("trade_live_weight", sql("lvp fv", """
    SELECT year, product, exporter, calculation, value,
           CASE calculation WHEN 'product_q' THEN 'product form' ELSE 'nominal weight' END AS "group"
    FROM (
        SELECT year, product, exporter, q AS product_q, round(q * own, 4) AS q_by_exporter, round(q * top, 4) AS q_by_max,
               round(q * low, 4) AS q_by_min, round(q * posted, 4) AS q_by_official
        FROM (SELECT year, presentation AS product, iso3c AS exporter, sum(value) AS q FROM lvp
              WHERE port_iso3c IN (SELECT 'N' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
                                   WHERE r_name = 'EUROPE') GROUP BY ALL)
        LEFT JOIN (SELECT landings_code AS product, iso3c AS exporter,
                          floor(CAST(sum(CAST(conversion_factor AS DECIMAL(18,6))) AS DOUBLE) / count(*)
                                * 10000.0 + 0.5) / 10000.0 AS own FROM fv GROUP BY ALL) USING (product, exporter)
        LEFT JOIN (SELECT landings_code AS product, max(conversion_factor) AS top, min(conversion_factor) AS low
                   FROM fv GROUP BY ALL) USING (product)
        LEFT JOIN (SELECT landings_code AS product,
                          floor(CAST(sum(CAST(conversion_factor AS DECIMAL(18,6))) AS DOUBLE) / count(*)
                                * 10000.0 + 0.5) / 10000.0 AS posted
                   FROM fv WHERE implementation = 'EU-wide CF' GROUP BY ALL) USING (product))
    UNPIVOT INCLUDE NULLS (value FOR calculation IN (product_q, q_by_exporter, q_by_max, q_by_min, q_by_official))"""))
def traded(spark: SparkSession, sf: str) -> DataFrame:
    flows = landings(spark, sf, port=True).select(
        "year", F.col("presentation").alias("product"), F.col("iso3c").alias("exporter"),
        F.col("port_iso3c").alias("importer"), F.col("value").alias("q"))
    held = factors(spark, sf).select(F.col("landings_code").alias("product"), F.col("iso3c").alias("country"),
                                     F.col("conversion_factor").alias("factor"), "implementation")
    official = held.where("implementation = 'EU-wide CF'")
    weights = trade.trade_live_weight(flows, held, official, members(spark, sf), digits=4)
    return rounded(weights, "value")


@query("trade_by_code_prefix", sql("lvp fv", """
    SELECT year, product, exporter, calculation, value,
           CASE calculation WHEN 'product_q' THEN 'product form' ELSE 'nominal weight' END AS "group"
    FROM (
        SELECT year, product, exporter, q AS product_q, round(q * own, 4) AS q_by_exporter, round(q * top, 4) AS q_by_max,
               round(q * low, 4) AS q_by_min, round(q * posted, 4) AS q_by_official
        FROM flows
        LEFT JOIN (SELECT product, exporter, floor(CAST(sum(CAST(cf AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 10000.0 + 0.5)
                                             / 10000.0 AS own FROM held GROUP BY ALL) USING (product, exporter)
        LEFT JOIN (SELECT product, max(cf) AS top, min(cf) AS low FROM held GROUP BY ALL) USING (product)
        LEFT JOIN (SELECT product, arg_max(posted, length(prefix)) AS posted
                   FROM (SELECT DISTINCT product FROM flows) JOIN branches ON starts_with(product, prefix)
                   GROUP BY ALL) USING (product))
    UNPIVOT INCLUDE NULLS (value FOR calculation IN (product_q, q_by_exporter, q_by_max, q_by_min, q_by_official))""", """
    flows AS (SELECT year, code AS product, iso3c AS exporter, sum(value) AS q FROM lvp
              WHERE port_iso3c IN (SELECT 'N' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
                                   WHERE r_name = 'EUROPE') GROUP BY ALL),
    held AS (SELECT code AS product, iso3c AS exporter, conversion_factor AS cf FROM fv
             WHERE scientific_name NOT IN ('Brand#11', 'Brand#23', 'Brand#13')),
    official AS (SELECT CASE p_partkey % 3 WHEN 0 THEN left(code, 4) WHEN 1 THEN code
                                           ELSE code || lpad(CAST(p_partkey % 10 * 10 AS VARCHAR), 2, '0') END AS code,
                        conversion_factor AS cf FROM fv WHERE p_partkey % 11 = 0 AND p_partkey % 7 < 4 AND left(code, 4) <> '0305'),
    branches AS (SELECT prefix, floor(CAST(sum(CAST(cf AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 10000.0 + 0.5) / 10000.0 AS posted
                 FROM (SELECT left(code, CAST(unnest(generate_series(4, length(code))) AS INTEGER)) AS prefix, cf FROM official)
                 GROUP BY prefix)"""))
def traded_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Official codes have 4, 6 or 8 digits, written with spaces; those of a heading and of some codes below do not exist."""
    flows = landings(spark, sf, port=True).select(
        "year", F.col("code").alias("product"), F.col("iso3c").alias("exporter"),
        F.col("port_iso3c").alias("importer"), F.col("value").alias("q"))
    rows = factors(spark, sf).withColumn("factor", F.col("conversion_factor"))
    held = rows.select(F.col("code").alias("product"), F.col("iso3c").alias("country"), "factor", "scientific_name")
    key, code = F.col("p_partkey"), F.col("code")
    heading, sub, item = F.substring(code, 1, 4), F.substring(code, 5, 2), F.lpad((key % 10 * 10).cast("string"), 2, "0")
    written = F.when(key % 3 == 0, heading).when(key % 3 == 1, F.concat_ws(" ", heading, sub)).otherwise(
        F.concat_ws(" ", heading, sub, item))
    official = rows.where((key % 11 == 0) & (key % 7 < 4) & (heading != "0305")).select(written.alias("product"), "factor")
    weights = trade.trade_live_weight(flows, held, official, members(spark, sf), digits=4, shortest_prefix=4,
                                      exclude=["Brand#11", "Brand#23", "Brand#13"])
    return rounded(weights, "value")
