"""SAM, VCF, interval-list, BED, GTF and table text, read with Spark's text reader and split into typed columns.

1-based inclusive files become 0-based half-open rows and back. Lines that start with a header mark are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, skip: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").rlike(skip) & (F.length("value") > 0)).select(F.split("value", "\t").alias("f"), "value")


def _at(k: int) -> Column:
    return F.get(F.col("f"), F.lit(k))


def _given(c: Column) -> Column:
    return F.when(c != ".", c)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines; tags as a map of their text; * is null."""
    f = _lines(spark, path, "^@")
    star = lambda c: F.when(c != "*", c)
    tags = F.map_from_entries(F.transform(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.substr(t, F.lit(6)))))
    mate = F.when(_at(6) == "=", _at(2)).otherwise(_at(6))
    return f.select(
        _at(0).alias("qname"), _at(1).cast("int").alias("flag"), star(_at(2)).alias("contig"), (_at(3).cast("long") - 1).alias("pos"), _at(4).cast("int").alias("mapq"), star(_at(5)).alias("cigar"),
        star(mate).alias("mate_contig"), (_at(7).cast("long") - 1).alias("mate_pos"), _at(8).cast("long").alias("tlen"), star(_at(9)).alias("seq"), star(_at(10)).alias("qual"), tags.alias("tags"),
    ).withColumn("read_group", F.try_element_at("tags", F.lit("RG")))


def read_vcf(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """Records with INFO as a map of value arrays (flags have an empty one), the raw INFO text, and genotypes by sample.

    Sample names come from the header line; the file's lines may come in any order.
    """
    if samples is None:
        head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
        samples = head["value"].split("\t")[9:] if head else []
    f = _lines(spark, path, "^#")
    entries = F.filter(F.split(_at(7), ";"), lambda e: (e != ".") & (e != ""))
    info = F.map_from_entries(F.transform(entries, lambda e: F.struct(F.substring_index(e, "=", 1), F.when(e.contains("="), F.split(F.substr(e, F.instr(e, "=") + 1), ",")).otherwise(F.array().cast("array<string>")))))
    keys = F.split(_at(8), ":")

    def genotype(k: int) -> Column:
        values = F.split(_at(9 + k), ":")
        get = lambda name: _given(F.get(values, F.array_position(keys, name).cast("int") - 1))
        ints = lambda name: F.transform(F.split(get(name), ","), lambda x: x.try_cast("int"))
        return F.struct(
            F.lit(samples[k]).alias("sample"), F.transform(F.split(F.get(values, F.array_position(keys, "GT").cast("int") - 1), "[/|]"), lambda a: F.coalesce(a.try_cast("int"), F.lit(-1))).alias("gt"),
            get("GQ").try_cast("int").alias("gq"), get("DP").try_cast("int").alias("dp"), ints("AD").alias("ad"), ints("PL").alias("pl"), get("FT").alias("ft"))

    out = f.select(
        _at(0).alias("contig"), (_at(1).cast("long") - 1).alias("pos"), _given(_at(2)).alias("id"), _at(3).alias("ref"), F.when(_at(4) != ".", F.split(_at(4), ",")).otherwise(F.array().cast("array<string>")).alias("alts"),
        _given(_at(5)).try_cast("double").alias("qual"), F.when(_at(6) != ".", F.split(_at(6), ";")).otherwise(F.array().cast("array<string>")).alias("filter"), info.alias("info"), _at(7).alias("info_text"),
        *([F.array(*[genotype(k) for k in range(len(samples))]).alias("genotypes")] if samples else []))
    end = F.try_element_at("info", F.lit("END"))
    return out.withColumn("end", F.coalesce(F.get(end, F.lit(0)).try_cast("long"), F.col("pos") + F.length("ref")))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """BED (0-based), or interval lists and ``contig:start-end`` literals (1-based), told apart by their lines."""
    bed = path.split("?")[0].removesuffix(".gz").endswith(".bed")
    f = _lines(spark, path, "^(@|#|track|browser)")
    if bed:
        return f.select(_at(0).alias("contig"), _at(1).cast("long").alias("start"), _at(2).cast("long").alias("end"), _at(3).alias("name"))
    literal = F.size("f") == 1
    contig = F.regexp_extract("value", "^(.*?)(?::([0-9,]+)(?:-([0-9,]+))?)?$", 1)
    number = lambda k: F.regexp_replace(F.regexp_extract("value", "^(.*?)(?::([0-9,]+)(?:-([0-9,]+))?)?$", k), ",", "").try_cast("long")
    return f.select(F.when(literal, contig).otherwise(_at(0)).alias("contig"), (F.when(literal, number(2)).otherwise(_at(1).try_cast("long")) - 1).alias("start"),
                    F.when(literal, F.coalesce(number(3), number(2))).otherwise(_at(2).try_cast("long")).alias("end"), F.when(~literal, _at(4)).alias("name"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Features with gene_id, transcript_id and gene_name."""
    attribute = lambda k: F.nullif(F.regexp_extract(_at(8), f'{k} "([^"]*)"', 1), F.lit(""))
    return _lines(spark, path, "^#").select(_at(0).alias("contig"), _at(2).alias("feature"), (_at(3).cast("long") - 1).alias("start"), _at(4).cast("long").alias("end"), _at(6).alias("strand"), *[attribute(k).alias(k) for k in ("gene_id", "transcript_id", "gene_name")])


def read_table(spark: SparkSession, path: str, schema: str, comment: str = "@") -> DataFrame:
    """A tab-separated table with a header row and comment lines, with a declared schema."""
    return spark.read.csv(path, sep="\t", header=True, comment=comment, schema=schema, mode="FAILFAST")


def read_fasta(spark: SparkSession, path: str, width: int = 100_000) -> DataFrame:
    """(contig, start, seq) in chunks of at most ``width`` bases; a record is read whole by one task, headers may hold any sign."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.length("value") > 0)
    record = F.regexp_replace("value", "^>", "")
    name = F.regexp_extract(record, "^(\\S*)", 1)
    seq = F.regexp_replace(F.regexp_replace(record, "^[^\n]*", ""), "\\s", "")
    chunks = raw.select(name.alias("contig"), F.posexplode(F.regexp_extract_all(seq, F.lit(f"(.{{1,{width}}})"))).alias("_k", "seq"))
    return chunks.select("contig", (F.col("_k").cast("long") * width).alias("start"), "seq")


def fasta_dictionary(reference: DataFrame) -> DataFrame:
    """(name, length, md5 of the upper-case bases) of each contig of (contig, start, seq) chunks."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq"))), lambda x: x["seq"]), "")
    return reference.groupBy(F.col("contig").alias("name")).agg(F.sum(F.length("seq")).alias("length"), F.md5(F.upper(whole).cast("binary")).alias("md5"))


_FORMAT = ("gt", "gq", "dp", "ad", "pl", "ft")


def _genotype_text(g: Column, fields: list[str]) -> Column:
    """A sample's column, of the FORMAT keys ``fields``."""
    number = lambda a: F.coalesce(a.cast("string"), F.lit("."))
    parts = []
    for f in fields:
        if f == "gt":
            parts.append(F.array_join(F.transform(g[f], lambda a: F.when(F.coalesce(a >= 0, F.lit(False)), a.cast("string")).otherwise(".")), "/"))
        elif f in ("ad", "pl"):
            parts.append(F.coalesce(F.array_join(F.transform(g[f], number), ","), F.lit(".")))
        else:
            parts.append(number(g[f]))
    return F.concat_ws(":", *parts)


def _vcf_value(df: DataFrame) -> Column:
    info = F.array_join(F.transform(F.array_sort(F.map_keys("info")), lambda k: F.when(F.size(F.col("info")[k]) > 0, F.concat(k, F.lit("="), F.array_join(F.col("info")[k], ","))).otherwise(k)), ";")
    dot = lambda c: F.when(c.isNull() | (c == ""), ".").otherwise(c)
    columns = [F.col("contig").cast("string"), (F.col("pos") + 1).cast("string"), dot(F.col("id")), F.col("ref"), dot(F.array_join("alts", ",")), dot(F.col("qual").cast("string")), dot(F.array_join("filter", ";")), dot(info)]
    if "genotypes" in df.columns:
        there = df.schema["genotypes"].dataType.elementType.fieldNames()
        fields = [f for f in _FORMAT if f in there]
        columns += [F.lit(":".join(f.upper() for f in fields)), F.array_join(F.transform("genotypes", lambda g: _genotype_text(g, fields)), "\t")]
    return F.concat_ws("\t", *columns)


def vcf_lines(df: DataFrame) -> DataFrame:
    """One text column, value: records as VCF lines (1-based), with a column for each genotype in their order, if there are any."""
    return df.select(_vcf_value(df).alias("value"))


def write_vcf(df: DataFrame, path: str, header: list[str] | None = None, samples: list[str] | None = None) -> None:
    """One folder of text parts that make up a VCF in the order of their names: the header's lines lead the first part, then come
    the records by contig (numbers as such) and position, over range partitions. samples: the genotypes' names, by default those
    of the first row."""
    spark = df.sparkSession
    fixed = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
    if "genotypes" in df.columns:
        if samples is None:
            first = df.select(F.transform("genotypes", lambda g: g["sample"]).alias("s")).first()
            samples = list(first["s"]) if first else []
        fixed += ["FORMAT", *samples]
    head = ["##fileformat=VCFv4.2", *(header or []), "\t".join(fixed)]
    top = spark.createDataFrame([(k, "", -1, x) for k, x in enumerate(head)], "_n int, _contig string, _pos long, value string")
    contig = F.col("contig").cast("string")
    place = F.when(contig.rlike("^[0-9]{1,9}$"), F.lpad(contig, 10, "0")).otherwise(contig)
    rows = df.select(F.lit(len(head)).alias("_n"), place.alias("_contig"), F.col("pos").cast("long").alias("_pos"), _vcf_value(df).alias("value"))
    order = ["_n", "_contig", "_pos"]
    top.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_fasta(reference: DataFrame, path: str, width: int = 60) -> None:
    """(contig, seq) as FASTA, one record a row, lines of ``width`` bases."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    reference.select(F.concat(F.lit(">"), F.col("contig").cast("string"), F.lit("\n"), lines).alias("value")).write.mode("overwrite").text(path)


def rotated(seq: Column, start: Column) -> Column:
    """A circular sequence that starts ``start`` bases further on."""
    n = F.greatest(F.length(seq), F.lit(1))
    k = F.pmod(start, n).cast("int")
    return F.concat(F.substr(seq, k + 1, F.length(seq)), F.substr(seq, F.lit(1), k))
