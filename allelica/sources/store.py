"""The profile store: one Parquet table for each attribute and sample, a catalog, and the tables that users read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The order of columns in each user-facing table; other columns follow by name.
COLUMN_ORDER = {
    "SNVs": "scaffold position position_coverage allele_count ref_base con_base var_base ref_freq con_freq var_freq A C T G gene mutation mutation_type cryptic",
    "scaffold_info": "scaffold length coverage breadth nucl_diversity coverage_median coverage_std coverage_SEM breadth_minCov breadth_expected nucl_diversity_median "
    "nucl_diversity_rarefied nucl_diversity_rarefied_median breadth_rarefied conANI_reference popANI_reference SNS_count SNV_count divergent_site_count",
    "linkage": "scaffold position_A position_B distance r2 d_prime r2_normalized d_prime_normalized allele_A allele_a allele_B allele_b countab countAb countaB countAB total",
    "gene_info": "scaffold gene gene_length coverage breadth breadth_minCov nucl_diversity start end direction partial dNdS_substitutions pNpS_variants SNV_count SNV_S_count SNV_N_count "
    "SNS_count SNS_S_count SNS_N_count divergent_site_count",
    "genome_info": "genome coverage breadth nucl_diversity length true_scaffolds detected_scaffolds coverage_median coverage_std coverage_SEM breadth_minCov breadth_expected nucl_diversity_rarefied "
    "conANI_reference popANI_reference iRep iRep_GC_corrected linked_SNV_count SNV_distance_mean r2_mean d_prime_mean consensus_divergent_sites population_divergent_sites SNS_count SNV_count "
    "filtered_read_pair_count reads_unfiltered_pairs reads_mean_PID",
    "mapping_info": "scaffold pass_pairing_filter filtered_pairs",
    "pairwise_SNP_locations": "mm scaffold position name1 name2 consensus_SNP population_SNP con_base_1 ref_base_1 var_base_1 position_coverage_1 A_1 C_1 T_1 G_1 "
    "con_base_2 ref_base_2 var_base_2 position_coverage_2 A_2 C_2 T_2 G_2",
    "pooled_SNV_info": "scaffold position depth A C T G ref_base con_base var_base sample_detections sample_5x_detections DivergentSite_count SNS_count SNV_count con_SNV_count pop_SNV_count",
    "pooled_SNV_data": "sample scaffold position A C T G",
    "pooled_SNV_data_keys": "key sample scaffold",
}

CATALOG = "name string, type string, description string"


class ProfileStore:
    """Attributes under a folder that Spark can reach; ``sample`` partitions each table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def catalog(self) -> DataFrame:
        """``name, type, description`` of all attributes; the last entry of each name counts."""
        try:
            d = self.spark.read.schema(CATALOG + ", at long").parquet(f"{self.root}/catalog")
            d.schema  # noqa: B018
            return d.groupBy("name").agg(F.max_by(F.struct("type", "description"), "at").alias("x")).select("name", "x.type", "x.description")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], CATALOG)

    def write(self, name: str, df: DataFrame, sample: str, description: str = "") -> None:
        """Writes one sample's attribute; another type or description than the catalog's is refused."""
        kind = df.schema.simpleString()
        known = self.catalog().where(F.col("name") == name).collect()
        if known and (known[0].type, known[0].description) != (kind, description):
            raise ValueError(f"{name} is stored with another type or description")
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/sample={sample}")
        if not known:
            entry = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(description).alias("description"), F.unix_micros(F.current_timestamp()).alias("at"))
            entry.write.mode("append").parquet(f"{self.root}/catalog")

    def read(self, name: str, samples: list[str] | None = None, scaffolds: list[str] | None = None) -> DataFrame:
        """An attribute; samples prune folders and scaffolds are pushed to the files."""
        d = self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        if samples is not None:
            d = d.where(F.col("sample").isin(*samples))
        return d if scaffolds is None else d.where(F.col("scaffold").isin(*scaffolds))

    def scaffolds(self, name: str) -> DataFrame:
        return self.read(name).select("scaffold").distinct()


@contextmanager
def case_sensitive(spark: SparkSession) -> Iterator[None]:
    """Some published columns differ by case only (``allele_A`` and ``allele_a``)."""
    name = "spark.sql.caseSensitive"
    old = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def ordered(df: DataFrame, name: str) -> DataFrame:
    """Columns in a table's order, as far as it has them, then the rest by name."""
    have = set(df.columns)
    first = [c for c in COLUMN_ORDER.get(name, "").split() if c in have]
    return df.select(*first, *sorted(c for c in have if c not in first))


def write_table(df: DataFrame, path: str, name: str = "", header: str | None = None, compress: bool = False, sep: str = "\t") -> None:
    """A text table with column names. ``header`` is a comment line before them, which needs one file.

    Without ``header`` files are written in parallel, each with column names.
    """
    with case_sensitive(df.sparkSession):
        d = ordered(df, name) if name else df
        flat = d.select(*[(F.to_json(F.col(c)) if t.startswith(("array", "map", "struct")) else F.col(c)).alias(c) for c, t in d.dtypes])
        if header is None:
            flat.write.mode("overwrite").csv(path, sep=sep, header=True, compression="gzip" if compress else "none")
            return
        # a report with one row a scaffold
        text = flat.select(F.lit(2).alias("line"), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in flat.columns]), sep).alias("value"))
        top = df.sparkSession.createDataFrame([(0, f"#{header}"), (1, sep.join(flat.columns))], "line int, value string")
        top.unionByName(text).repartition(1).sortWithinPartitions("line").select("value").write.mode("overwrite").text(path, compression="gzip" if compress else "none")
