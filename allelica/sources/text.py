"""Readers of the text formats: sequences, genes, genome maps, lists, annotations, tables and logs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from allelica.operators.logs import parse


def fasta(spark: SparkSession, path: str, full_header: bool = False, upper: bool = True) -> DataFrame:
    """``scaffold, sequence, length, file`` of FASTA files; gzip is read by name. The name ends at the first blank unless ``full_header``."""
    # records end where a line starts with ">"; only the first one still has its own
    d = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value"), F.col("_metadata.file_name").alias("file"))
    d = d.where(F.trim("value") != "")
    header = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "\r", ""))
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise(F.lit(""))
    seq = F.regexp_replace(body, r"\s", "")
    name = header if full_header else F.regexp_extract(header, r"^\S+", 0)
    d = d.select(name.alias("scaffold"), header.alias("header"), (F.upper(seq) if upper else seq).alias("sequence"), "file")
    return d.withColumn("length", F.length("sequence").cast("long"))


def prodigal_genes(spark: SparkSession, path: str) -> DataFrame:
    """Genes of nucleotide FASTA with headers ``gene # start # end # strand # attributes``; positions become 0-based."""
    d = fasta(spark, path, full_header=True)
    p = F.split("header", " # ")
    gene = F.trim(p[0])
    attrs = F.get(p, F.lit(4))
    return d.where(F.size(p) >= 4).select(
        F.regexp_replace(gene, r"_[^_]*$", "").alias("scaffold"), gene.alias("gene"), (p[1].cast("long") - 1).alias("start"), (p[2].cast("long") - 1).alias("end"),
        p[3].cast("int").alias("direction"), (~F.coalesce(F.regexp_extract(attrs, r"partial=(\d\d)", 1).isin("00", ""), F.lit(True))).alias("partial"), "sequence",
    )


_GENE = T.StructType(
    [T.StructField("scaffold", T.StringType()), T.StructField("gene", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
     T.StructField("direction", T.IntegerType()), T.StructField("partial", T.BooleanType()), T.StructField("sequence", T.StringType())]
)


def genbank_genes(spark: SparkSession, path: str) -> DataFrame:
    """Coding sequences of GenBank files; each file is parsed in one task. Joined locations span their first to last base and are ``partial``."""
    d = spark.read.text(path, wholetext=True)

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for text in batch["value"] for r in parse_genbank(text)]
            yield pd.DataFrame(rows, columns=_GENE.names)

    return d.mapInPandas(read, _GENE)


def parse_genbank(text: str) -> list[tuple]:
    out = []
    for record in re.split(r"^//\s*$", text, flags=re.M):
        name = re.search(r"^(?:VERSION|LOCUS)\s+(\S+)", record, flags=re.M)
        version = re.search(r"^VERSION\s+(\S+)", record, flags=re.M)
        origin = re.search(r"^ORIGIN.*?$(.*)", record, flags=re.M | re.S)
        if not name or not origin:
            continue
        seq = re.sub(r"[^A-Za-z]", "", origin[1]).upper()
        features = re.search(r"^FEATURES.*?$(.*?)^ORIGIN", record, flags=re.M | re.S)
        for k, m in enumerate(re.finditer(r"^ {5}CDS +(.*?)(?=^ {5}\S|\Z)", features[1] if features else "", flags=re.M | re.S)):
            place = re.sub(r"\s", "", m[1].split("/", 1)[0])
            spans = [(int(a) - 1, int(b) - 1) for a, b in re.findall(r"<?(\d+)\.\.>?(\d+)", place)]
            if not spans:
                continue
            gene = re.search(r'/gene="([^"]+)"', m[1]) or re.search(r'/locus_tag="([^"]+)"', m[1])
            start, end = min(a for a, _ in spans), max(b for _, b in spans)
            own = "".join(seq[a : b + 1] for a, b in spans)
            minus = place.startswith("complement")
            if minus:
                own = own[::-1].translate(str.maketrans("ACGT", "TGCA"))
            out.append(((version or name)[1], gene[1] if gene else f"CDS_{k}", start, end, -1 if minus else 1, len(spans) > 1, own))
    return out


def genes(spark: SparkSession, path: str) -> DataFrame:
    """Genes by the file's ending."""
    return genbank_genes(spark, path) if re.search(r"\.(gb|gbk|gbff)(\.gz)?$", path) else prodigal_genes(spark, path)


def stb(spark: SparkSession, path: str) -> DataFrame:
    """``scaffold, genome``: the first two columns of a tab-separated file, blanks around them removed. Of a repeated scaffold the last line counts."""
    d = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("p"), F.monotonically_increasing_id().alias("line"))
    d = d.where(F.size("p") >= 2).select(F.trim(F.col("p")[0]).alias("scaffold"), F.trim(F.col("p")[1]).alias("genome"), "line")
    return d.groupBy("scaffold").agg(F.max_by("genome", "line").alias("genome"))


def stb_from_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Each scaffold's genome is the name of its file."""
    return fasta(spark, ",".join(paths) if len(paths) == 1 else paths).select("scaffold", F.col("file").alias("genome"))


def resolve_stb(spark: SparkSession, given: list[str], scaffolds: DataFrame | None = None) -> DataFrame:
    """A genome map from what a user gave: nothing (all scaffolds are one genome), FASTA files, or one table."""
    if not given:
        if scaffolds is None:
            return spark.createDataFrame([], "scaffold string, genome string")
        return scaffolds.select("scaffold", F.lit("all_scaffolds").alias("genome"))
    if all(re.search(r"\.(fa|fasta|fna)(\.gz)?$", p) for p in given):
        return stb_from_fasta(spark, given)
    if len(given) == 1:
        return stb(spark, given[0])
    raise ValueError("give FASTA files, or one table of scaffolds and genomes")


def scaffold_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a FASTA file, or one name on each line."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''")
    if lines.where(F.col("v").startswith(">")).isEmpty():
        return lines.select(F.col("v").alias("scaffold"))
    return lines.where(F.col("v").startswith(">")).select(F.regexp_extract("v", r"^>\s*(\S+)", 1).alias("scaffold"))


def priority_reads(spark: SparkSession, path: str) -> DataFrame:
    """Read names (``pair``): lines starting with ``@`` of a FASTQ file (quality lines that do, too), else all lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''")
    at = lines.where(F.col("v").startswith("@"))
    return (lines if at.isEmpty() else at).select(F.regexp_extract("v", r"^@?(\S+)", 1).alias("pair"))


def null_model(spark: SparkSession, path: str) -> list[tuple[int, list[float]]]:
    """A table of depths and probabilities of 1, 2, ... wrong bases; at most 100,000 depths are read to the driver."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("a null model has at most 100,000 depths")
    out = []
    for r in rows:
        try:
            out.append((int(float(r.p[0])), [float(x) for x in r.p[1:]]))
        except ValueError:
            continue  # the header
    return out


def annotations(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Distinct ``gene, anno`` of CSV files: always the first two columns, lines with another number of fields left out.

    Headers must name both columns.
    """
    d = spark.read.text(paths).select(F.split("value", ",").alias("p")).where(F.size("p") == 2)
    d = d.select(F.trim(F.col("p")[0]).alias("gene"), F.trim(F.col("p")[1]).alias("anno"))
    return d.where(~((F.col("gene") == "gene") & (F.col("anno") == "anno"))).distinct()


def long_annotations(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The long annotation table as it was written: genes and bases of each annotation in each sample's genomes."""
    return spark.read.csv(paths, header=True, schema="sample string, anno string, genome string, genes long, bases long")


def output_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated result table; lines starting with ``#`` are comments. Types are told from the data, which these small tables allow.

    Columns that only differ by case get their place as a suffix, unless the session is case sensitive.
    """
    return spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=True)


def logs(spark: SparkSession, path: str) -> DataFrame:
    """Typed log events with ``line``, in file order, and the line two before (where runs tell their command)."""
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    w = Window.partitionBy("file").orderBy("line")
    return parse(d.withColumn("before", F.lag("value", 2).over(w)))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Aligned reads of SAM files: mapped ones, with mismatches from the NM tag and 0-based positions.

    ``length`` is the read's, from its CIGAR string where it has no sequence; both ends are included in positions.
    """
    d = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("p"), F.monotonically_increasing_id().alias("file_order"))
    d = d.where((F.size("p") >= 11) & (F.col("p")[5] != "*") & (F.col("p")[1].cast("int").bitwiseAND(4) == 0))
    cigar = F.col("p")[5]
    nm = F.try_element_at(F.filter("p", lambda x: x.startswith("NM:i:")), F.lit(1))
    start = F.col("p")[3].cast("long") - 1
    return d.select(
        F.col("p")[2].alias("scaffold"), F.col("p")[0].alias("read_name"), F.coalesce(F.substring(nm, 6, 9).cast("int"), F.lit(0)).alias("nm"), F.col("p")[4].cast("int").alias("mapq"),
        cigar_length(cigar, "MIS=X").alias("length"), start.alias("ref_start"), (start + cigar_length(cigar, "MDN=X") - 1).alias("ref_end"),
        F.col("p")[1].cast("int").alias("flag"), cigar.alias("cigar"), F.col("p")[9].alias("sequence"), F.col("p")[10].alias("quality"), "file_order",
    )


def cigar_length(cigar: Column, kinds: str) -> Column:
    """Bases of the given operations."""
    n = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
