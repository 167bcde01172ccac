import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.operators.catalog import match_labels
from peakforge.plans.clean_year import clean_year, identifications
from peakforge.plans.preprocess import preprocess
from peakforge.sources import archives, readers, sinks

HEADER = {"TD": 60, "DELAY": 19000, "DW": 400.0, "ML1": 2500000.0, "ML2": 100.0, "ML3": 0.0, "BYTORDA": 0, "NTBCal": "x"}


def header(**changed):
    return "##TITLE= x\n" + "\n".join(f"##${k}= {v}" for k, v in {**HEADER, **changed}.items()) + "\n##END=\n"


def blob(values, big=False):
    return struct.pack(f"{'>' if big else '<'}{len(values)}i", *values)


def decode(spark, acqu, fid):
    r = readers.decode_acquisition(spark.createDataFrame([("p", acqu, fid)], "path string, acqu string, fid binary")).first()
    return r["mz"], r["intensity"]


@pytest.mark.parametrize("big", [False, True])
def test_decode(spark, big):
    mz, y = decode(spark, header(TD=4, BYTORDA=int(big)), blob([5, -3, 7, 1], big))
    assert y == [5, 0, 7, 1]
    tof = 19000 + 400.0 * np.arange(4)
    assert np.allclose(mz, (100 - tof) ** 2 / (1e12 / 2.5e6))


def test_decode_lengths_and_last_header_line(spark):
    mz, y = decode(spark, header(TD=10), blob([1, 2, 3]))
    assert len(mz) == len(y) == 3
    mz, y = decode(spark, header(TD=2), blob([1, 2, 3]))
    assert len(mz) == len(y) == 2
    mz, y = decode(spark, header(TD=9) + "##$TD= 1\n", blob([1, 2, 3]))
    assert len(mz) == len(y) == 1
    mz, y = decode(spark, header(), b"")
    assert mz == [] and y == []


def write_tree(root, rows):
    for parts, acqu, fid in rows:
        folder = os.path.join(root, *parts, "1SLin")
        os.makedirs(folder)
        if acqu is not None:
            with open(os.path.join(folder, "acqu"), "w") as f:
                f.write(acqu)
        if fid is not None:
            with open(os.path.join(folder, "fid"), "wb") as f:
                f.write(fid)


def test_tree_scan_and_preprocess(spark, tmp_path):
    signal = [int(100 + 50 * np.sin(i / 3)) for i in range(60)]
    write_tree(tmp_path, [
        (("2018", "matched_bacteria", "Klebsiella", "Pneumoniae", "18117816", "0_D9", "1"), header(), blob(signal)),
        (("2018", "matched_bacteria", "Klebsiella", "Pneumoniae", "18117816", "0_D9", "2"), header(), bytes(240)),
        (("2019", "Escherichia", "Coli", "18252920", "0_A1", "1"), header(), blob(signal[::-1])),
        (("2019", "Escherichia", "Coli", "18252921", "0_A1", "1"), header(), None),
    ])
    rows = {(r["year"], r["label"], r["target_position"], r["replicate"])
            for r in readers.scan_spectra(spark, str(tmp_path)).collect()}
    assert rows == {(2018, "Klebsiella_Pneumoniae_18117816", "0_D9", "1"), (2018, "Klebsiella_Pneumoniae_18117816", "0_D9", "2"),
                    (2019, "Escherichia_Coli_18252920", "0_A1", "1")}
    assert readers.scan_spectra(spark, str(tmp_path), years=[2019]).count() == 1
    assert readers.scan_spectra(spark, str(tmp_path), species=["Klebsiella Pneumoniae"]).count() == 2
    made = preprocess(spark, str(tmp_path))
    got = {r["extern_id"]: r["features"] for r in made.collect()}
    assert set(got) == {"18117816", "18252920"} and all(len(v) == 6000 for v in got.values())
    y = np.sqrt(np.array(signal, float))[None]
    y = kernels.smooth(y)
    y = y - kernels.snip_baseline(y)
    y = (y / y.sum())[0]
    mz = (100 - 19000 - 400.0 * np.arange(60)) ** 2 / 4e5
    keep = (mz > 2000) & (mz < 20000)
    assert np.allclose(got["18117816"], kernels.bin_values(mz[keep], y[keep], kernels.equal_edges()))
    sinks.write_features(made, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.schema["features"].dataType.simpleString() == "array<float>" and back.count() == 2


def xml(*analytes):
    out = "<Results><Run>"
    for extern, target, names in analytes:
        matches = "".join(f'<MspMatch referencePatternName="{n}" globalMatchValue="{s}"/>' for n, s in names)
        out += f'<Analyte externId="{extern}" targetPosition="{target}"><Found>{matches}</Found></Analyte>'
    return out + "</Run></Results>"


COLI = [("Escherichia coli 1", 2.3), ("Escherichia coli 2", 2.1), ("Escherichia coli 3", 2.0), ("Other thing", 2.0)]


def test_clean_year(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("2018/a.xml", xml(("00000001", "A1", COLI), ("00000002", "B2", COLI), ("00000003", "C3", COLI[:2])))
        z.writestr("2018/broken.xml", "<Results><Analyte>")
        z.writestr("2017/other.xml", xml(("00000009", "A1", COLI)))
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        for name in ("2018/q/00000001/0_A1/", "2018/q/00000001/0_A1/1/1SLin/fid", "2018/q/00000001/0_A1/1/1SLin/acqu"):
            z.writestr(name, b"" if name.endswith("/") else b"data")
    xmls, spectra = [str(tmp_path / "x.zip")], [str(tmp_path / "s.zip")]
    checked, broken = identifications(spark, xmls, 2018)
    assert {r["extern_id"]: r["reason"] for r in checked.collect()} == {
        "00000001": None, "00000002": None, "00000003": "too_few_matches"}
    assert [r["member"] for r in broken.collect()] == ["2018/broken.xml"]
    found, missing, report = clean_year(spark, xmls, spectra, 2018)
    assert [(r["extern_id"], r["files"], r["folder_status"]) for r in found.collect()] == [("00000001", 2, "found")]
    assert [r["extern_id"] for r in missing.collect()] == ["00000002"]
    assert [tuple(r) for r in report.collect()] == [("Escherichia", "Coli", 1)]
    members = archives.list_members(spark, spectra).filter(~F.col("member").endswith("/"))
    own = archives.spectrum_members(members, found)
    assert {(r["member"][-4:], r["content"]) for r in archives.read_members(own).collect()} == {("/fid", b"data"), ("acqu", b"data")}


def test_year_folders_are_pruned(spark, tmp_path):
    """Only wanted years are listed, one scan per kind; years without a folder and no years give no rows."""
    write_tree(tmp_path, [((year, "Escherichia", "Coli", f"1{year}", "0_A1", "1"), header(), blob(range(60)))
                          for year in ("2017", "2018", "2019")])
    root = str(tmp_path / "{year}")
    df = readers.scan_spectra(spark, root, years=[2018, 2030])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [r["year"] for r in df.collect()] == [2018]
    assert plan.count("FileScan binaryFile") == 2 and "2017" not in plan and len(df.inputFiles()) == 2
    assert readers.scan_spectra(spark, root).count() == 3
    assert readers.scan_spectra(spark, root, years=[2030]).count() == readers.scan_spectra(spark, root, years=[]).count() == 0
    assert readers.scan_spectra(spark, str(tmp_path), years=[]).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.scan_spectra(spark, str(tmp_path / "nowhere"))


def test_malformed_acquisitions_say_so(spark):
    cut = "\n".join(line for line in header().splitlines() if "ML1" not in line)
    no_td = "\n".join(line for line in header().splitlines() if "$TD" not in line)
    rows = [("a", header(), blob(range(60))), ("b", cut, blob(range(60))), ("c", no_td, blob(range(60))), ("d", header(), blob(range(9))),
            ("e", header(), b""), ("f", "", None), ("g", header(), blob(range(3)) + b"xx")]
    df = readers.decode_acquisition(spark.createDataFrame(rows, "path string, acqu string, fid binary"))
    got = {r["path"]: (r["status"], r["intensity"] and len(r["intensity"])) for r in df.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "ok", "b": "no calibration", "c": "no length", "d": "short signal", "e": "no length",
                                               "f": "no length", "g": "short signal"}
    assert got["a"][1] == 60 and got["d"][1] == 9 and got["g"][1] == 3


def test_members_leave_in_frames(spark, tmp_path):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(2500):
            z.writestr(f"2019/{i}/fid", b"" if i % 7 == 0 else b"x" * i)
    got = {r["member"]: r["content"] for r in archives.scan_archives(spark, [str(path)], 2019, "fid").collect()}
    assert len(got) == 2500 and all(len(got[f"2019/{i}/fid"]) == (0 if i % 7 == 0 else i) for i in range(2500))


def test_damaged_member_is_reported(spark, tmp_path):
    path = tmp_path / "bad.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("2019/a/fid", b"good bytes")
        z.writestr("2019/b/fid", b"other bytes")
    raw = path.read_bytes().replace(b"good bytes", b"gone bytes")
    path.write_bytes(raw)
    got = {r["member"]: (r["content"], r["error"]) for r in archives.scan_archives(spark, [str(path)], 2019, "fid").collect()}
    assert got["2019/b/fid"] == (b"other bytes", None)
    assert got["2019/a/fid"][0] is None and "CRC" in got["2019/a/fid"][1]


def test_loose_xml(spark, tmp_path):
    body = ('<Results><Analyte externId="00000001" targetPosition="A1">' + "".join(
        f'<MspMatch referencePatternName="{n}" globalMatchValue="{s}"/>' for n, s in COLI) + "</Analyte></Results>")
    (tmp_path / "a.xml").write_text(body)
    r = readers.read_analytes(spark, str(tmp_path / "a.xml")).first()
    assert r["extern_id"] == "00000001" and [m["pattern"] for m in r["matches"]] == [n for n, _ in COLI[:3]]


def test_text_spectra_and_labels(spark, tmp_path):
    for year, code, species in ((2015, "a1", "escherichia coli"), (2017, "b2", "MIX!klebsiella pneumoniae[x]")):
        os.makedirs(tmp_path / "id" / str(year))
        (tmp_path / "id" / str(year) / f"{year}_clean.csv").write_text(f"code,species\n{code},{species}\nzz,one\n")
    os.makedirs(tmp_path / "raw" / "2015")
    (tmp_path / "raw" / "2015" / "a1.txt").write_text("# header\n2001.9,7\n2000.2,513.8\n")
    got = readers.read_text_spectra(spark, str(tmp_path / "raw" / "*")).first()
    assert (got["year"], got["spectrum_id"], got["mz"], got["intensity"]) == ("2015", "a1", [2000, 2001], [513, 7])
    labels = readers.read_yearly_labels(spark, str(tmp_path / "id"))
    assert sorted((r["year"], r["code"]) for r in labels.collect()) == [("2015", "a1"), ("2015", "zz"), ("2017", "b2"), ("2017", "zz")]
    spectra = readers.read_text_spectra(spark, str(tmp_path / "raw" / "*")).withColumnRenamed("spectrum_id", "code")
    found, missing = match_labels(labels, spectra)
    assert [r["code"] for r in found.collect()] == ["a1"] and missing.count() == 3


def test_amr_csv(spark, tmp_path):
    path = tmp_path / "amr.csv"
    path.write_text("﻿Muestra,Origen,Ciprofloxacina Interpretación\n1.0,ORINA,S\n", encoding="utf-8")
    assert readers.read_amr(spark, str(path)).columns == ["Muestra", "Origen", "Ciprofloxacina Interpretación"]
    path.write_text("Id,Origen\n1,ORINA\n")
    with pytest.raises(ValueError):
        readers.read_amr(spark, str(path))


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("A", "X"), ("A", "X"), ("A", "Y"), ("B", "Z")], "genus string, species string")
    for fmt in ("csv", "json", "xml"):
        sinks.write_report(df, str(tmp_path / fmt), fmt)
    csv = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in csv.collect()) == [("A", "X", "2"), ("A", "Y", "1"), ("B", "Z", "1")]
    text = " ".join(r[0] for r in spark.read.text(str(tmp_path / "json")).collect())
    assert '{"genus":"A","species":{"X":2,"Y":1}}' in text
    text = "".join(r[0].strip() for r in spark.read.text(str(tmp_path / "xml")).collect())
    assert '<Genus name="A"><Species name="X">2</Species><Species name="Y">1</Species></Genus>' in text
    with pytest.raises(ValueError):
        sinks.write_report(df, str(tmp_path / "no"), "pickle")
    sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).count() == 4
