"""Functional annotation: transcripts over variants, codons, protein changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import translate_codon
from .ranges import binned, point_join


def best_transcript(variants: DataFrame, transcripts: DataFrame, id_col: str = "id", width: int = 10_000) -> DataFrame:
    """Each variant with the first transcript over it: principal ones first, then the longest, then by name.

    transcripts: contig, start, end, transcript, principal. Variants without one keep a null transcript.
    """
    hits = point_join(variants.select(id_col, "contig", "pos"), transcripts, width)
    w = Window.partitionBy(id_col).orderBy(F.col("principal_r").desc(), (F.col("end_r") - F.col("start_r")).desc(), "transcript_r")
    best = hits.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(id_col, F.col("transcript_r").alias("transcript"), F.col("start_r").alias("transcript_start"))
    return variants.join(best, id_col, "left")


def region_class(variants: DataFrame, exons: DataFrame, coding: DataFrame, width: int = 1000, id_col: str = "id") -> DataFrame:
    """CDS, UTR (exon outside the coding range), INTRON (inside ``coding`` but no exon) or IGR for each variant."""
    def hit(df: DataFrame, name: str) -> DataFrame:
        return point_join(variants.select(id_col, "contig", "pos"), df.select("contig", "start", "end"), width, how="left_semi").select(id_col).withColumn(name, F.lit(True))

    out = variants.join(hit(exons, "_e"), id_col, "left").join(hit(coding, "_c"), id_col, "left")
    e, c = F.coalesce("_e", F.lit(False)), F.coalesce("_c", F.lit(False))
    return out.withColumn("region", F.when(e & c, "CDS").when(e, "UTR").when(c, "INTRON").otherwise("IGR")).drop("_e", "_c")


def codon_change(cds: Column, offset: Column, alt: Column) -> Column:
    """struct(ref_codon, alt_codon, ref_aa, alt_aa, kind) of a base change at a 0-based offset of a coding sequence."""
    begin = (F.floor(offset / 3) * 3).cast("int")
    at = (offset - begin).cast("int")
    ref = F.substr(cds, begin + 1, F.lit(3))
    new = F.concat(F.substr(ref, F.lit(1), at), alt, F.substr(ref, at + 2, F.lit(3)))
    a, b = translate_codon(ref), translate_codon(new)
    kind = F.when(F.length(ref) < 3, "OUTSIDE").when(a == b, "SILENT").when(b == "*", "NONSENSE").when(a == "*", "NONSTOP").otherwise("MISSENSE")
    return F.struct(ref.alias("ref_codon"), new.alias("alt_codon"), a.alias("ref_aa"), b.alias("alt_aa"), kind.alias("kind"))


def tabular_annotation(variants: DataFrame, table: DataFrame, columns: list[str], locatable: bool = True, key: str | None = None) -> DataFrame:
    """Columns of a data source, by position (contig, start, end) or by a key column; several hits are joined with |."""
    if not locatable:
        per = table.groupBy(key).agg(*[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(c) for c in columns])
        return variants.join(per, key, "left")
    r = binned(table.select("contig", "start", "end", *columns), 1000)
    v = variants.withColumn("_bin", F.floor(F.col("pos") / 1000))
    hit = v.select("id", "contig", "pos", "_bin").join(r, ["contig", "_bin"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    per = hit.groupBy("id").agg(*[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(c) for c in columns])
    return variants.join(per, "id", "left")
