"""Six related tables of a SQL dump, scanned in byte ranges, and the rows they join to.

A dump holds one ``INSERT`` statement a line. Spark's text scan cuts a plain file into byte ranges at line
ends, so its tasks start at statements; a zipped dump can only be read from its beginning and is one task.
The dump is tokenised once; its tables are written below ``target`` and read from there by name.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from affinityloom.operators.ordering import first_rows
from affinityloom.sources.archives import opened
from affinityloom.sources.assays import FIELD, TUPLE, bulk_samples, int_tokens, unescaped

BATCH_BYTES = 4 << 20
OPENING = "INSERT INTO `"

# Position of each column in its table's tuples.
TABLES = {
    "pdb_bdb": {"entry_id": 0, "sets": 1, "more_sets": 2},
    "cobweb_bdb": {"target_name": 0, "inhibitor_name": 1, "monomer_id": 2, "kind": 3, "affinity_nm": 4, "affinity_display": 5,
                   "affinity_strength": 6, "set_id": 7, "source_organism": 8},
    "monomer": {"ligand_id": 4, "ligand_name": 5, "ligand_inchi_key": 6, "monomer_id": 9, "ligand_type": 12, "ligand_smiles": 14},
    "enzyme_reactant_set": {"set_id": 3, "article_id": 6, "reactant_inhibitor": 10, "inhibitor_monomer_id": 12, "polymer_id": 16, "category": 17},
    "polymer": {"polymer_organism": 4, "accession_2": 5, "scientific_name": 6, "target_display_name": 8, "accession_1": 13, "polymer_id": 14},
    "entry": {"article_comments": 1, "article_date": 2, "article_title": 3, "article_id": 6, "technique": 7, "ezid": 9},
}
INTEGERS = {"monomer_id", "affinity_strength", "set_id", "article_id", "inhibitor_monomer_id", "polymer_id"}


class Archive(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class ZippedLinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uris = options["path"].split("\n")
        self.ending, self.opening = options.get("ending", ""), options.get("opening", "")

    def partitions(self) -> list[Archive]:
        return [Archive(uri) for uri in self.uris]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        opening, lines, size = self.opening.encode(), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "file": pa.array([partition.uri] * len(lines)), "line": pa.array([n for n, _ in lines], pa.int64()),
                "value": pa.array([v.decode("utf-8", "replace") for _, v in lines])})

        with opened(partition.uri) as f, zipfile.ZipFile(f) as archive:
            names = sorted(n for n in archive.namelist() if n.endswith(self.ending))
            if not names:
                raise FileNotFoundError(f"{partition.uri} holds no {self.ending} member")
            with archive.open(names[0]) as member:
                for n, line in enumerate(member):
                    if not line.startswith(opening):
                        continue
                    lines.append((n, line.rstrip(b"\r\n")))
                    size += len(line)
                    if size >= BATCH_BYTES:
                        yield batch()
                        lines, size = [], 0
        if lines:
            yield batch()


class ZippedLines(DataSource):
    """Lines of the first member (by name) with the given ending in each archive: file, line, value."""

    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return "file string, line bigint, value string"

    def reader(self, schema) -> ZippedLinesReader:
        return ZippedLinesReader(dict(self.options))


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """Insert statements of a dump, with their order: ``ord`` and ``value``.

    A path that ends in .zip is read from its first .dmp member; any other is text, cut in byte ranges.
    """
    if path.endswith(".zip"):
        spark.dataSource.register(ZippedLines)
        lines = spark.read.format("zipped_lines").option("ending", ".dmp").option("opening", OPENING).load(path)
        return lines.select(F.struct("file", F.lit(0).cast("bigint").alias("block"), F.col("line").alias("row")).alias("ord"), "value")
    lines = spark.read.text(path).filter(F.col("value").startswith(OPENING))
    return lines.select(F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"), "value")


def split_dump(lines: DataFrame, target: str) -> None:
    """Tokenise the statements of the six tables once; one folder per table, each tuple as an array of texts."""
    name = F.regexp_extract("value", r"\AINSERT INTO `([^`]*)`", 1)
    statements = lines.withColumn("table", name).filter(F.col("table").isin(*TABLES))
    values = F.substr("value", F.locate(" VALUES ", "value"))
    tuples = statements.select("ord", "table", F.posexplode(F.regexp_extract_all(values, F.lit(TUPLE), F.lit(0))).alias("place", "_t"))
    fields = F.transform(F.regexp_extract_all("_t", F.lit(FIELD), F.lit(1)), unescaped)
    tuples.select("table", F.struct("ord.*", "place").alias("ord"), fields.alias("fields")).write.partitionBy("table").parquet(target)


def cleaned(c: Column) -> Column:
    """Text without outer blanks; blank and ``null`` in any case are null."""
    bare = F.regexp_replace(c, r"\A\s+|\s+\z", "")
    return F.when((bare != "") & (F.lower(bare) != "null"), bare)


def dump_table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """One table of a split dump: texts cleaned, ids as numbers, and the order of its rows."""
    at = lambda i: F.try_element_at("fields", F.lit(i + 1))
    typed = lambda c, i: at(i).try_cast("bigint") if c in INTEGERS else at(i).try_cast("double") if c == "affinity_nm" else cleaned(at(i))
    rows = spark.read.schema(
        "ord struct<file: string, block: bigint, row: bigint, place: int>, fields array<string>, table string").parquet(target)
    return rows.filter(F.col("table") == name).select("ord", *[typed(c, i).alias(c) for c, i in TABLES[name].items()])


def entry_sets(pairs: DataFrame) -> DataFrame:
    """Distinct (entry, set) of the delimited lists in both columns; tokens that are no integers are left out."""
    ids = F.array_union(int_tokens("sets"), int_tokens("more_sets"))
    return pairs.filter(F.col("entry_id").isNotNull()).select(F.upper("entry_id").alias("entry_id"), F.explode(ids).alias("set_id")).distinct()


def last_rows(rows: DataFrame, keys: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key; rows whose key is null are left out, a null in ``optional`` equals nothing."""
    apart = F.when(F.lit(False) if not optional else F.greatest(*[F.col(c).isNull() for c in optional], F.lit(False)), F.col("ord"))
    known = rows.na.drop(subset=keys).withColumn("_apart", apart)
    return first_rows(known, [*keys, *optional, "_apart"], [F.col("ord").desc()]).drop("ord", "_apart")


def bulk_rows(spark: SparkSession, target: str) -> DataFrame:
    """One row per entry and measurement of its reactant sets, with ligand, target and article where known.

    Repeated ids: the last row counts. Measurements are one per set, monomer, kind and organism; those without
    kind or organism are all kept. The measurement side may have hot polymers and articles, but is never the
    unique side of a join, so adaptive execution can split it.
    """
    read = lambda name: dump_table(spark, target, name)
    ligands = last_rows(read("monomer"), ["monomer_id"])
    fallback = F.concat(F.lit("BDBM"), F.col("monomer_id").cast("string"))
    ligands = ligands.withColumns({c: F.coalesce(c, fallback) for c in ("ligand_id", "ligand_name")})
    measured = last_rows(read("cobweb_bdb"), ["set_id", "monomer_id"], ("kind", "source_organism"))
    return (entry_sets(read("pdb_bdb")).join(measured, "set_id").join(last_rows(read("enzyme_reactant_set"), ["set_id"]), "set_id", "left")
            .join(ligands, "monomer_id", "left").join(last_rows(read("polymer"), ["polymer_id"]), "polymer_id", "left")
            .join(last_rows(read("entry"), ["article_id"]), "article_id", "left"))


def dump_rows_of(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Split the dump at ``path`` below ``target`` and join its tables."""
    split_dump(dump_lines(spark, path), target)
    return bulk_rows(spark, target)


def dump_samples(rows: DataFrame) -> DataFrame:
    """Joined dump rows as samples: an unnamed target takes its polymer's name, the article's comment is the reference text."""
    named = rows.withColumns({
        "target_name": F.coalesce("target_name", "target_display_name"), "reference_text": F.coalesce("article_comments", "article_title"),
        "organism": F.coalesce("source_organism", "scientific_name")})
    return bulk_samples(named, ["set_id", "ligand_id", "ligand_name", "ligand_smiles", "ligand_inchi_key", "target_name", "organism", "reference_text",
                                "article_title", "article_date", "technique", "ezid"])
