import gzip
import os
from types import SimpleNamespace

import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F

from tareline import materialise, recommended_conf, session, vocab
from tareline.plans.landings import clean_catch, clean_landings, usable_landings
from tareline.operators.reshape import unpack_years
from tareline.sources.tables import (
    curation_worklist,
    read_code_dictionary,
    read_csv_table,
    write_safe_csv,
    write_tidy,
)
from tareline.sources.wide import list_wide_files, read_wide_flagged, wide_headers

LANDINGS = """species,pres,dest_use,natvessr,unit,geo\\time\t2018 \t2017 \t1999 
COD,FRE_GUH,TOTAL,PT,TPW,PT\t12.5 e\t: c\t: 
COD,FRE_GUH,TOTAL,NA,TPW,NA\t3 \t0 n\t7 bp
"""
SHORTER = """species,pres,dest_use,natvessr,unit,geo\\time\t2018 \t1999 
HKE,FRE,TOTAL,DE,TPW,XX\t5 \t6 
FIN,FRE_GUH,OTHER,PT01,EUR_T,PT\t8 z\t: z
"""
DICTIONARIES = {
    "species": "COD\tAtlantic cod - Gadus morhua\r\nHKE\tHake - Merluccius m.\r\nFIN\tFinfishes\r\n",
    "pres": "FRE_GUH\tFresh, gutted and headed\r\nFRE\tFresh\r\n",
    "dest_use": "TOTAL\tTotal\r\n",
    "natvessr": "PT\tPortugal\r\nPT01\tPortugal\r\nNA\tNamibia\r\nDE\tGermany (until 1990 former territory of the FRG)\r\n",
    "geo": "PT\tPortugal\r\nNA\tNamibia\r\n",
    "unit": "TPW\tTonnes product weight\r\nEUR_T\tEuro per tonne\r\n",
    "fishreg": "27_1\tBarents Sea\r\n",
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "fish_ld_pt.tsv").write_text(LANDINGS)
    (tmp_path / "fish_ld_de.tsv").write_text(SHORTER)
    (tmp_path / "fish_ld_main.tsv").write_text(LANDINGS)
    (tmp_path / "notes.txt").write_text("no data")
    for name, text in DICTIONARIES.items():
        (tmp_path / f"{name}.dic").write_text(text, newline="")
    return tmp_path


@pytest.fixture
def dictionaries(spark, folder):
    return {name: read_code_dictionary(spark, str(folder / f"{name}.dic")) for name in DICTIONARIES}


def test_files_are_listed_without_totals(spark, folder):
    names = [os.path.basename(p) for p in list_wide_files(spark, str(folder), "fish_ld")]
    assert names == ["fish_ld_de.tsv", "fish_ld_pt.tsv"]


def test_dictionary_keeps_the_code_na_and_drops_line_ends(spark, dictionaries):
    assert rows(dictionaries["natvessr"].where("code IN ('NA', 'PT01')")) == [("NA", "Namibia"), ("PT01", "Portugal")]


def test_one_scan_whatever_the_headers(spark, folder):
    paths = list_wide_files(spark, str(folder), "fish_ld", exclude=())
    wide = read_wide_flagged(spark, paths)
    assert plan_of(wide).split("== Physical Plan ==")[-1].count("FileScan text") == 1
    years = wide.select("source_file", F.size("__cells").alias("n")).groupBy("source_file").agg(F.min("n"), F.max("n"), F.count("*"))
    found = {r[0]: tuple(r[1:]) for r in years.collect()}
    assert found["fish_ld_main.tsv"] == found["fish_ld_pt.tsv"] and found["fish_ld_main.tsv"][2] == 2
    assert found["fish_ld_de.tsv"][:2] == (found["fish_ld_pt.tsv"][0] - 1,) * 2


def test_a_folder_keeps_every_file_under_its_own_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("species,geo\\time\t2001\t2000\nCOD,A\t1\t2\n")
    (tmp_path / "b.tsv").write_text("species,geo\\time\t2000\t2001\nEEL,A\t3\t4\n\n")
    found = rows(unpack_years(read_wide_flagged(spark, str(tmp_path), source_file=None)), "species", "year", "value")
    assert sorted(found) == [("COD", 2000, 2.0), ("COD", 2001, 1.0), ("EEL", 2000, 3.0), ("EEL", 2001, 4.0)]


def test_headers_of_compressed_and_oddly_named_files(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    with gzip.open(folder / "é 1.tsv.gz", "wt", encoding="utf-8") as f:
        f.write("species,geo\\time\t2001\tnote\r\nCOD,A\t1\tx\r\n")
    (folder / "empty.tsv").write_text("")
    (folder / "c%20d.tsv").write_text("geo,species,unit\\time\t1999\nB,EEL,kg\t5\n")
    found = unpack_years(read_wide_flagged(spark, str(folder), source_file=None))
    assert rows(found, "species", "geo", "unit", "note", "year", "value") == [
        ("COD", "A", None, "x", 2001, 1.0), ("EEL", "B", "kg", None, 1999, 5.0)]


@pytest.mark.parametrize("line", ["COD,A\t1\t2\t99", "COD,A\t1"])
def test_a_ragged_line_ends_the_query(spark, tmp_path, line):
    (tmp_path / "a.tsv").write_text("species,geo\\time\t2001\t2000\n" + line + "\n")
    with pytest.raises(Exception, match="expected 3 cells"):
        read_wide_flagged(spark, str(tmp_path / "a.tsv")).collect()


def test_joins_do_not_grow_with_headers(spark, folder, dictionaries):
    def joins(paths):
        return plan_of(clean_landings(spark, paths, dictionaries)).split("== Physical Plan ==")[-1].count("Join")

    both = list_wide_files(spark, str(folder), "fish_ld")
    assert len(set(wide_headers(spark, both).values())) == 2
    assert joins(both) == joins(both[:1])


def test_dotted_names_in_safe_csv(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1)], ["Common.name", "CN.8"])
    write_safe_csv(df.coalesce(1), str(tmp_path / "dots"))
    assert rows(spark.read.csv(str(tmp_path / "dots"), header=True)) == [("ab", "1")]


def test_clean_landings(spark, folder, dictionaries):
    synonyms = spark.createDataFrame([("Merluccius m.", "Merluccius merluccius", "synonym")],
                                     "synonym string, accepted string, status string")
    tidy = clean_landings(spark, list_wide_files(spark, str(folder), "fish_ld"), dictionaries, synonyms)
    assert tidy.count() == 2 * 3 + 2 * 2
    cells = rows(tidy.where("scientific_name = 'Gadus morhua'"), "reporting_entity", "year", "value", "flag")
    assert cells == [("Namibia", 1999, 7.0, "bp"), ("Namibia", 2017, 0.0, "n"), ("Namibia", 2018, 3.0, None),
                     ("Portugal", 1999, None, None), ("Portugal", 2017, None, "c"), ("Portugal", 2018, 12.5, "e")]
    hake = rows(tidy.where("common_name = 'Hake'"), "scientific_name", "reporting_entity", "year", "value", "source_file")
    assert hake == [("Merluccius merluccius", "XX", 1999, 6.0, "fish_ld_de.tsv"),
                    ("Merluccius merluccius", "XX", 2018, 5.0, "fish_ld_de.tsv")]
    fish = tidy.where("common_name = 'Finfishes' AND year = 2018").first()
    assert (fish.scientific_name, fish.use, fish.nationality_of_vessel, fish.nationality_of_vessel_code, fish.flag) == (
        None, "OTHER", "Portugal", "PT01", "z")
    usable = rows(usable_landings(tidy), "nationality_of_vessel", "year", "value")
    assert usable == [("Namibia", 1999, 7.0), ("Namibia", 2018, 3.0), ("Portugal", 2018, 12.5)]


def test_totals_are_dropped_and_germany_renamed(spark, folder, dictionaries):
    tidy = clean_landings(spark, str(folder / "fish_ld_de.tsv"), dictionaries)
    kept = usable_landings(tidy.withColumn("presentation", F.lit(None).cast("string")))
    assert rows(kept, "nationality_of_vessel", "year") == [("Germany", 1999), ("Germany", 2018)]
    assert usable_landings(tidy).count() == 0
    assert "Fresh" in vocab.PRESENTATION_TOTALS


def test_clean_catch(spark, tmp_path, dictionaries):
    (tmp_path / "fish_ca_atl27.tsv").write_text(
        "species,fishreg,unit,geo\\time\t2001 \t1998 \nCOD,27_1,TLW,PT\t4 \t: \n")
    tidy = clean_catch(spark, str(tmp_path / "fish_ca_atl27.tsv"), dictionaries)
    assert rows(tidy, "fishing_region", "unit", "reporting_entity", "year", "value") == [
        ("Barents Sea", "TLW", "Portugal", 1998, None), ("Barents Sea", "TLW", "Portugal", 2001, 4.0)]


def test_quoted_text_over_several_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"","Year","Text","CF"\n"1",2015,"Frozen ""Scomber""","1"\n"2",2016,"traded\n\n\nwhole, CF 1,00",1\n')
    df = read_csv_table(spark, str(tmp_path / "a.csv"), "id string, year int, text string, cf double", multiline=True)
    assert rows(df) == [("1", 2015, 'Frozen "Scomber"', 1.0), ("2", 2016, "traded\n\n\nwhole, CF 1,00", 1.0)]


def test_malformed_number_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\nabc\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        read_csv_table(spark, str(tmp_path / "a.csv"), "x double").collect()


def test_comma_free_csv(spark, tmp_path):
    df = spark.createDataFrame([("Fresh, gutted", 1.5), (None, 2.0), ('say "x"', None)], "label string, v double")
    write_safe_csv(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.splitlines() == ["label,v", "Fresh gutted,1.5", "NA,2.0", 'say "x",NA']


def test_tidy_table_is_partitioned_by_year(spark, tmp_path):
    df = spark.createDataFrame([("a", 2000, 1.0), ("b", 2001, 2.0)], "k string, year int, v double")
    write_tidy(df, str(tmp_path / "tidy"), sort_by=["k"])
    assert sorted(p.name for p in (tmp_path / "tidy").glob("year=*")) == ["year=2000", "year=2001"]
    back = spark.read.parquet(str(tmp_path / "tidy")).where("year = 2001")
    assert rows(back, "k", "year", "v") == [("b", 2001, 2.0)]
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().toString()


def test_worklist_of_unknown_descriptions(spark):
    seen = spark.createDataFrame([("frozen",), ("frozen",), ("dried",), (None,)], "t string")
    known = spark.createDataFrame([("dried",)], "t string")
    assert rows(curation_worklist(seen, "t", known)) == [("frozen",), (None,)]


def session_like(master, named=None, checkpoint=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default),
                           sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint))


def test_scratch_folder_is_the_one_the_cluster_names():
    assert session.scratch_dir(session_like("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.scratch_dir(session_like("yarn", None, "hdfs:///set-on-context")) == "hdfs:///set-on-context"
    assert os.path.isdir(session.scratch_dir(session_like("local[2]")))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(session_like("yarn"))


def test_shuffle_partitions_follow_the_data():
    assert "spark.sql.shuffle.partitions" not in recommended_conf()
    assert recommended_conf(20 << 40)["spark.sql.shuffle.partitions"] == "81920"


def test_stored_table_has_fixed_values_and_a_known_size(spark):
    stored = materialise(spark.range(1000).withColumn("r", F.rand()))
    assert rows(stored) == rows(stored)
    assert stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 100_000
