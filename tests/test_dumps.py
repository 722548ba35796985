"""Dump scan: the six tables from several byte ranges and from an archive, escapes, repeats and nulls."""

import zipfile

import pytest

from affinityloom.sources import dumps as DU

LONG = "x" * 200_000
DUMP = [
    "-- header",
    "INSERT INTO `other` VALUES (1);",
    "INSERT INTO `pdb_bdb` VALUES (' 1abc','1001; 1002,zz','1001',NULL,NULL,NULL,NULL,NULL,NULL),('','1001',NULL),('2xyz',NULL,'null');",
    "INSERT INTO `cobweb_bdb` VALUES ('Kinase A','ATP',42,'Kd',5.0000,' 5.0',0,1001,'Homo sapiens'),(NULL,'ATP',42,'Ki',9,'<9',0,1001,NULL);",
    "INSERT INTO `cobweb_bdb` VALUES (NULL,'ATP',42,'Ki',9,'<9',0,1001,NULL),('no set','ATP',42,'Ki',9,'9',0,NULL,'x');",
    "INSERT INTO `monomer` VALUES (0,'','null','C10','OLD','OLD','K',NULL,NULL,42,'I','507.00','Small',1,'CCO',NULL);",
    "INSERT INTO `monomer` VALUES (0,'','null','C10','null','it\\'s (R)-a, \\\"b\\\"\\\\n','AAAA-BBBB',NULL,NULL,42,'" + LONG + "','507.00','Small organic molecule',1,'C(=O)\\\\O',NULL);",
    "INSERT INTO `enzyme_reactant_set` VALUES ('Kinase A',NULL,1,1001,NULL,NULL,7,NULL,NULL,NULL,'ATP',NULL,42,NULL,NULL,NULL,8,'protein_ligand',NULL,NULL);",
    "INSERT INTO `polymer` VALUES (NULL,NULL,'Linear',NULL,'Homo sapiens','Q1,P12345','Homo sapiens','Protein','Kinase A K3R',320,NULL,1,'9606','P12345',8,'1ABC',NULL,NULL,NULL);",
    "INSERT INTO `entry` VALUES (NULL,'Example citation; (x)','2026-03-16 00:00:00','Example kinase binding',NULL,NULL,7,'Enzyme Inhibition',NULL,'EZ123');",
]


@pytest.fixture
def plain_file(tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text("\n".join(DUMP))
    return str(path)


def check(rows):
    got = [r.asDict() for r in rows.orderBy("kind").collect()]
    assert [(r["entry_id"], r["set_id"], r["kind"], r["affinity_nm"], r["source_organism"]) for r in got] == [
        ("1ABC", 1001, "Kd", 5.0, "Homo sapiens"), ("1ABC", 1001, "Ki", 9.0, None), ("1ABC", 1001, "Ki", 9.0, None)]
    first = got[0]
    assert (first["ligand_id"], first["ligand_name"], first["ligand_smiles"], first["ligand_inchi_key"]) == ("BDBM42", "it's (R)-a, \"b\"\\n", "C(=O)\\O", "AAAA-BBBB")
    assert (first["target_display_name"], first["accession_1"], first["accession_2"]) == ("Kinase A K3R", "P12345", "Q1,P12345")
    assert (first["article_title"], first["article_comments"], first["technique"], first["ezid"]) == (
        "Example kinase binding", "Example citation; (x)", "Enzyme Inhibition", "EZ123")
    assert first["affinity_display"] == "5.0" and first["target_name"] == "Kinase A"


def test_a_file_in_several_ranges(spark, plain_file, tmp_path):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = DU.dump_lines(spark, plain_file)
        assert lines.rdd.getNumPartitions() > 4
        DU.split_dump(lines, str(tmp_path / "split"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    check(DU.bulk_rows(spark, str(tmp_path / "split")))


def test_an_archive(spark, tmp_path):
    path = tmp_path / "dump.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("readme.txt", "x")
        out.writestr("all.dmp", "\r\n".join(DUMP))
    check(DU.dump_rows_of(spark, str(path), str(tmp_path / "split")))


def test_samples_of_an_entry(spark, plain_file, tmp_path):
    rows = DU.dump_rows_of(spark, plain_file, str(tmp_path / "split"))
    got = {r.kind: r for r in DU.dump_samples(rows).collect()}
    assert got["Kd"].sample_id == "BDB_BULK_1ABC_1001_42_Kd" and got["Kd"].accessions == "P12345;Q1" and got["Kd"].value == 5.0 and got["Kd"].state == "wildtype"
    assert got["Ki"].relation == "<" and got["Ki"].mutation == "K3R" and got["Ki"].organism == "Homo sapiens"
    assert got["Kd"].reference_text == "Example citation; (x)" and got["Kd"].ligand_inchi_key == "AAAA-BBBB"


def test_tables_without_rows(spark, tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text("\n".join(DUMP[:3]))
    assert DU.dump_rows_of(spark, str(path), str(tmp_path / "split")).count() == 0
    assert DU.dump_table(spark, str(tmp_path / "split"), "polymer").count() == 0
