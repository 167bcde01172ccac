import pytest
from pyspark.sql import functions as F

from peakforge.functions.scalars import canonical_id, capitalise, hash_uniform, pad8, recode
from peakforge.operators import amr, catalog
from peakforge.operators.identification import accepted, normalise_species, validate_matches

GOOD = ("Escherichia coli A", 2.3)


def analyte(extern="18252920", target="D5", *matches):
    return (extern, target, [{"pattern": p, "score": s} for p, s in matches])


RULES = {
    "missing_attributes": analyte(None, "D5", GOOD, GOOD, GOOD),
    "missing_attributes#target": analyte("18252920", "", GOOD, GOOD, GOOD),
    "missing_attributes#matches": analyte("18252920", "D5"),
    "bad_extern_id": analyte("1825292", "D5", GOOD, GOOD, GOOD),
    "bad_extern_id#digits": analyte("1234567x", "D5", GOOD, GOOD, GOOD),
    "low_score": analyte("18252920", "D5", ("Escherichia coli", 1.69), GOOD, GOOD),
    "bad_species_1": analyte("18252920", "D5", ("Bacillus sp.", 2.0), GOOD, GOOD),
    "bad_pattern_1": analyte("18252920", "D5", ("Bacillus", 2.0), GOOD, GOOD),
    "too_few_matches": analyte("18252920", "D5", GOOD, GOOD),
    "bad_pattern_2": analyte("18252920", "D5", GOOD, ("Escherichia", 1.0), GOOD),
    "bad_species_2": analyte("18252920", "D5", GOOD, ("Escherichia sp.", 1.0), GOOD),
    "genus_mismatch_2": analyte("18252920", "D5", GOOD, ("Shigella coli", 1.8), GOOD),
    "species_mismatch_2": analyte("18252920", "D5", GOOD, ("Escherichia fergusonii", 1.8), GOOD),
    "bad_species_3": analyte("18252920", "D5", GOOD, GOOD, ("Escherichia 12", 1.0)),
    "genus_mismatch_3": analyte("18252920", "D5", GOOD, GOOD, ("Shigella coli", 1.7)),
    "species_mismatch_3": analyte("18252920", "D5", GOOD, GOOD, ("Escherichia albertii", 1.7)),
}
SCHEMA = "extern_id string, target_position string, matches array<struct<pattern:string,score:double>>"


@pytest.mark.parametrize("case", sorted(RULES))
def test_rejecting_rules(spark, case):
    row = validate_matches(spark.createDataFrame([RULES[case]], SCHEMA)).first()
    assert (row["status"], row["reason"], row["genus"]) == ("rejected", case.split("#")[0], None)


def test_accepting(spark):
    rows = [analyte("18252920", "D5", ("Escherichia coli(x) 1", 1.7), GOOD, GOOD, ("Shigella sonnei", 2.2)),
            analyte("18252920X", "D5", ("escherichia COLI", 2.0), ("escherichia fergusonii", 1.5), ("Other thing", 1.6))]
    got = validate_matches(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["status"], r["genus"], r["species"], r["warning"]) for r in got] == [
        ("accepted", "Escherichia", "Coli", None),
        ("accepted", "escherichia", "Coli", "species_mismatch_2,species_mismatch_3")]
    assert accepted(validate_matches(spark.createDataFrame(rows * 40, SCHEMA)), limit=50).count() == 50


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_ids(spark):
    raw = ["1", "12345678", "123456789", "18117816.0", "abc", None, " 7 ", "1e3", "nan", "5d", "1e30"]
    assert column(spark, raw, canonical_id("v")) == ["00000001", "12345678", "123456789", "18117816", None, None, "00000007",
                                                     "00001000", None, None, None]
    assert column(spark, ["1", "123456789"], pad8("v")) == ["00000001", "123456789"]


def test_recode(spark):
    raw = ["S", "R", "I", "R*", "ESBL", "EBL?", "X", None, ""]
    assert column(spark, raw, recode("v", "merge_i")) == ["S", "R", "R", None, None, None, "X", None, None]
    assert column(spark, raw, recode("v", "keep_i")) == ["S", "R", "I", "R", None, None, "X", None, None]


def test_capitalise(spark):
    assert column(spark, ["aBC-dEF", "x", ""], capitalise("v")) == ["Abc-def", "X", ""]


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(200).withColumn("u", hash_uniform(F.col("id"), F.lit("a"), F.lit(1)))
    one, many = (df.repartition(1).collect(), df.repartition(7).collect())
    assert sorted(one) == sorted(many) and all(0 <= r["u"] < 1 for r in one)


def test_public_labels(spark):
    df = spark.createDataFrame([("a", "escherichia coli"), ("b", "MIX!klebsiella pneumoniae[x] y"), ("c", "single"),
                                ("d", "MIX!KLEBSIELLA oxytoca")], "code string, species string")
    got = {r["code"]: (r["genus"], r["species"]) for r in normalise_species(df).collect()}
    assert got == {"a": ("Escherichia", "Coli"), "b": ("Klebsiella", "Pneumoniae"), "d": ("Klebsiella", "Oxytoca")}


def test_blobs(spark):
    df = spark.createDataFrame([("a", bytes(8)), ("b", b""), ("c", b"\x01\x00"), ("d", b"\x01\x00")], "path string, fid binary")
    prints = {r["path"]: (r["is_empty"], r["no_bytes"]) for r in catalog.fingerprint(df).collect()}
    assert prints == {"a": (True, False), "b": (False, True), "c": (False, False), "d": (False, False)}
    assert sorted(r["path"] for r in catalog.drop_empty(df).collect()) == ["b", "c", "d"]
    assert [(r["path"], r["first_path"]) for r in catalog.duplicate_report(catalog.fingerprint(df)).collect()] == [("d", "c")]


def test_wide_table_keeps_rows_with_any_letter(spark):
    df = spark.createDataFrame([("1.0", "ORINA", "I", None), ("2", "ORINA", None, ""), ("x", "ORINA", "R", "R"),
                                ("3", "SANGRE", "ESBL", None)], "Muestra string, Origen string, `A Interpretación` string, `B Interpretación` string")
    wide = amr.amr_wide(df)
    assert wide.columns == ["extern_id", "origin", "A", "B"]
    assert sorted(tuple(r) for r in wide.collect()) == [("00000001", "ORINA", "R", None), ("00000003", "SANGRE", None, None)]
    assert [tuple(r) for r in amr.amr_long(df, "keep_i", origin="ORINA").collect()] == [("00000001", "ORINA", "A", "I")]
    assert [r["Muestra"] for r in amr.rejected_ids(df).collect()] == ["x"]


def test_folder_states(spark):
    members = spark.createDataFrame([("a", m) for m in (
        "2018/x/00000001/0_A1/", "2018/x/00000001/0_A1/1/1SLin/fid", "2018/x/00000002/0_B2/1/1SLin/fid", "2018/readme.txt")],
        "archive string, member string")
    valid = spark.createDataFrame([("00000001", "A1"), ("00000002", "B2"), ("00000003", "C3")], "extern_id string, target_position string")
    found, missing = catalog.match_folders(valid, members)
    assert {r["extern_id"]: (r["folder_status"], r["files"]) for r in found.collect()} == {
        "00000001": ("found", 1), "00000002": ("illegal", 1)}
    assert [r["extern_id"] for r in missing.collect()] == ["00000003"]


def test_one_per_sample(spark):
    rows = [("s", "A2", "1"), ("s", "A1", "1"), ("s", "A1", "2"), ("t", "B1", "2")]
    df = spark.createDataFrame(rows, "extern_id string, target_position string, replicate string")
    assert [tuple(r) for r in catalog.one_per_sample(df).collect()] == [("s", "A1", "1")]


def test_emptied_folders(spark):
    """Folders of all three levels; a folder that still has rows stays; an empty right side empties all."""
    schema = "genus string, species string, extern_id string, path string"
    before = spark.createDataFrame([("g", "s", "1", "a"), ("g", "s", "1", "b"), ("g", "s", "2", "c"), ("g", "t", "3", "d"),
                                    ("h", "s", "1", "e"), ("k", None, "4", "f")], schema)
    def left(*paths):
        return {tuple(r) for r in catalog.pruned_levels(before, before.filter(before.path.isin(*paths))).select("level", "name").collect()}
    assert left("b", "d", "f") == {("sample", "g/s/2"), ("genus", "h"), ("species", "h/s"), ("sample", "h/s/1")}
    assert left("a", "b", "c", "d", "e", "f") == set()
    assert len(left("")) == 3 + 4 + 5
