"""PLINK bed files through Spark's Python data source interface.

A bed file is a three-byte header and then a fixed number of bytes per site, so the file is planned as
ranges of sites; each task opens the file, seeks to its range and unpacks it.
"""

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from genespark.sources.formats import _at, _space
from genespark.sources.lines import read_numbered

# File magic, and the two-bit codes as copies of the first allele (1 is missing).
MAGIC = b"\x6c\x1b\x01"
CODES = [0, None, 1, 2]


def _open(path):
    if "://" in path or path.startswith("file:"):
        filesystem, inner = fs.FileSystem.from_uri(path)
    else:
        filesystem, inner = fs.LocalFileSystem(), path
    return filesystem, inner


class SiteRange(InputPartition):
    def __init__(self, first, last):
        self.first, self.last = first, last


class BedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.people = int(options["individuals"])
        self.bytes_per_site = (self.people + 3) // 4
        self.chunk = int(options.get("sitesperpartition", max(1, (32 << 20) // self.bytes_per_site)))

    def partitions(self):
        filesystem, inner = _open(self.path)
        with filesystem.open_input_file(inner) as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{self.path}: not a site-major bed file")
            sites, rest = divmod(f.size() - 3, self.bytes_per_site)
        if rest:
            raise ValueError(f"{self.path}: size does not fit {self.people} individuals")
        return [SiteRange(i, min(i + self.chunk, sites)) for i in range(0, sites, self.chunk)]

    def read(self, part):
        filesystem, inner = _open(self.path)
        step = max(1, (4 << 20) // max(1, self.people))
        table = np.array([0, -1, 1, 2], dtype=np.int32)
        with filesystem.open_input_file(inner) as f:
            for first in range(part.first, part.last, step):
                n = min(step, part.last - first)
                f.seek(3 + first * self.bytes_per_site)
                raw = np.frombuffer(f.read(n * self.bytes_per_site), dtype=np.uint8).reshape(n, -1)
                codes = np.stack([(raw >> (2 * k)) & 3 for k in range(4)], axis=2).reshape(n, -1)[:, : self.people]
                gt = table[codes].ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.arange(first, first + n, dtype=np.int64), self.people)),
                        pa.array(np.tile(np.arange(self.people, dtype=np.int32), n)),
                        pa.array(gt, mask=gt < 0),
                    ],
                    names=["site_id", "idx", "gt"],
                )


class PlinkBed(DataSource):
    @classmethod
    def name(cls):
        return "plink_bed"

    def schema(self):
        return "site_id long, idx int, gt int"

    def reader(self, schema):
        return BedReader(self.options)


def read_plink(spark, prefix, sites_per_partition=None):
    """Long rows: site_id, chrom, pos, idx, fid, iid, gt."""
    f = F.col("_f")
    fam = read_numbered(spark, f"{prefix}.fam").withColumn("_f", _space()).select(
        F.col("line_no").cast("int").alias("idx"), _at(f, 0).alias("fid"), _at(f, 1).alias("iid"))
    bim = read_numbered(spark, f"{prefix}.bim").withColumn("_f", _space()).select(
        F.col("line_no").alias("site_id"), _at(f, 0).alias("chrom"), _at(f, 3).cast("long").alias("pos"))
    spark.dataSource.register(PlinkBed)
    reader = spark.read.format("plink_bed").option("path", f"{prefix}.bed").option("individuals", fam.count())
    if sites_per_partition:
        reader = reader.option("sitesPerPartition", sites_per_partition)
    return reader.load().join(bim, "site_id").join(fam, "idx")


def locus_genotypes(calls, chrom, pos):
    return calls.filter((F.col("chrom") == chrom) & (F.col("pos") == pos))
