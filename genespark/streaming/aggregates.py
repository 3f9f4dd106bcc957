"""The single-level aggregates also run on streams, in complete mode.

Genotype counts, allele frequencies, composition and methylation counts only add up, so Structured
Streaming keeps their state; operators that chain aggregations or order by position stay batch.
"""

from genespark.operators import methylation, popgen, sequences, variants

STREAMABLE = {
    "genotype_counts": variants.genotype_counts,
    "allele_freq_by_group": popgen.allele_freq_by_group,
    "nucleotide_composition": sequences.nucleotide_composition,
    "quality_histogram": sequences.quality_histogram,
    "meth_count_table": methylation.meth_count_table,
    "conversion_stats": methylation.conversion_stats,
}


def stream_table(spark, path, schema, files_per_trigger=16):
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_complete(df, name, checkpoint, fmt="memory", **options):
    """Start the running totals; the checkpoint folder makes the query survive a restart."""
    writer = df.writeStream.outputMode("complete").format(fmt).queryName(name).option("checkpointLocation", checkpoint)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.start()
