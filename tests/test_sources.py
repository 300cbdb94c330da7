"""Text formats."""

import hashlib
import time

import pytest

from pyspark.sql import functions as F

from helixframe.sources import regions, report, text
from helixframe.streaming import events


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nr1\t99\tchr1\t101\t60\t5M\t=\t201\t105\tACGTA\tIIIII\tRG:Z:g1\tNM:i:0\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    rows = {r["qname"]: r for r in text.read_sam(spark, str(tmp_path / "a.sam")).collect()}
    assert rows["r1"]["pos"] == 100 and rows["r1"]["mate_contig"] == "chr1" and rows["r1"]["read_group"] == "g1"
    assert rows["r2"]["contig"] is None and rows["r2"]["cigar"] is None and rows["r2"]["tags"] == {}


def test_vcf_round_trip(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t10\trs1\tA\tC,T\t50.5\tPASS\tDP=7;AF=0.1,0.2;DB\tGT:AD:PL\t0/1:3,4,0:10,0,20,30,40,50\t./.\nchr1\t20\t.\tG\t.\t.\t.\tEND=30\tGT\t0|0\t0/0\n")
    df = text.read_vcf(spark, str(tmp_path / "a.vcf"))
    a, b = sorted(df.collect(), key=lambda r: r["pos"])
    assert (a["pos"], a["id"], a["alts"], a["info"]["AF"], a["info"]["DB"]) == (9, "rs1", ["C", "T"], ["0.1", "0.2"], [])
    assert a["genotypes"][0]["gt"] == [0, 1] and a["genotypes"][0]["pl"] == [10, 0, 20, 30, 40, 50] and a["genotypes"][1]["gt"] == [-1, -1]
    assert b["alts"] == [] and b["qual"] is None and b["end"] == 30
    lines = sorted(r[0] for r in text.vcf_lines(df).collect())
    assert lines[0] == "chr1\t10\trs1\tA\tC,T\t50.5\tPASS\tAF=0.1,0.2;DB;DP=7\tGT:GQ:DP:AD:PL:FT\t0/1:.:.:3,4,0:10,0,20,30,40,50:.\t./.:.:.:.:.:."
    text.write_vcf(df.repartition(3), str(tmp_path / "out"), ["##source=test"])
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    whole = "".join(p.read_text() for p in parts).splitlines()
    assert whole[:3] == ["##fileformat=VCFv4.2", "##source=test", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"] and [x.split("\t")[1] for x in whole[3:]] == ["10", "20"]
    again = sorted(text.read_vcf(spark, str(tmp_path / "out")).collect(), key=lambda r: r["pos"])
    assert [(r["pos"], r["alts"], r["info"], r["filter"]) for r in again] == [(r["pos"], r["alts"], r["info"], r["filter"]) for r in (a, b)]
    assert [g["gt"] for r in again for g in r["genotypes"]] == [g["gt"] for r in (a, b) for g in r["genotypes"]] and again[0]["genotypes"][0]["pl"] == [10, 0, 20, 30, 40, 50]


def test_intervals_and_gtf(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t0\t10\tx\n")
    (tmp_path / "a.list").write_text("@HD\nchr1\t1\t10\t+\tx\nchr2:5-9\nchr3:7\n")
    (tmp_path / "a.gtf").write_text('chr1\tsrc\texon\t5\t9\t.\t+\t.\tgene_id "g"; transcript_id "t";\n')
    assert [tuple(r)[:3] for r in text.read_intervals(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 0, 10)]
    assert sorted(tuple(r)[:3] for r in text.read_intervals(spark, str(tmp_path / "a.list")).collect()) == [("chr1", 0, 10), ("chr2", 4, 9), ("chr3", 6, 7)]
    g = text.read_gtf(spark, str(tmp_path / "a.gtf")).first()
    assert (g["start"], g["end"], g["gene_id"], g["gene_name"]) == (4, 9, "g", None)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 text a>b\nACGT\nAC\n>chr2\nGG\n")
    assert sorted(tuple(r) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("chr1", 0, "ACGTAC"), ("chr2", 0, "GG")]
    chunks = text.read_fasta(spark, str(tmp_path / "a.fa"), width=4)
    assert sorted(tuple(r) for r in chunks.collect()) == [("chr1", 0, "ACGT"), ("chr1", 4, "AC"), ("chr2", 0, "GG")]
    assert {r["name"]: (r["length"], r["md5"]) for r in text.fasta_dictionary(chunks).collect()} == {"chr1": (6, hashlib.md5(b"ACGTAC").hexdigest()), "chr2": (2, hashlib.md5(b"GG").hexdigest())}
    text.write_fasta(text.read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"), 3)
    assert sorted(tuple(r) for r in text.read_fasta(spark, str(tmp_path / "out")).collect()) == [("chr1", 0, "ACGTAC"), ("chr2", 0, "GG")]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, name string")
    text.write_table(df, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in text.read_table(spark, str(tmp_path / "t"), "n int, name string").collect()) == [(1, "a"), (2, None)]


def test_reports_round_trip(spark, tmp_path):
    one = spark.createDataFrame([("x", 1.5, None), ("long name here", 2.0, "b")], "key string, value double, note string")
    two = spark.createDataFrame([], "a int, b int")
    report.write_report(spark, {"First": one, "Empty:1": two}, str(tmp_path / "r"))
    rows = report.read_report(spark, str(tmp_path / "r")).collect()
    assert [(r["table"], r["row"], r["cells"]) for r in sorted(rows, key=lambda r: r["row"])] == [("First", 0, {"key": "long name here", "value": "2.0", "note": "b"}), ("First", 1, {"key": "x", "value": "1.5", "note": "NA"})]
    with pytest.raises(ValueError, match="more than 1 rows"):
        report.render({"First": one}, most_rows=1)


def test_first_seen_as_a_stream(spark, tmp_path):
    rows = [(k % 4, f"2024-01-01 00:{k:02d}:00") for k in range(12)]
    spark.createDataFrame(rows, "event_id long, t string").selectExpr("event_id", "cast(t as timestamp) as ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("seen", events.first_seen(stream)), ("sessions", events.session_islands(stream, "5 minutes", keys=("event_id",)))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("seen").collect()) == [0, 1, 2, 3]
    batch = events.session_islands(spark.read.parquet(str(tmp_path / "in")), "5 minutes", keys=("event_id",)).collect()
    assert {tuple(r) for r in spark.table("sessions").collect()} <= {tuple(r) for r in batch} and {r["n"] for r in batch} == {3}


def test_region_scans_open_their_folders_only(spark, tmp_path):
    rows = [(c, p, p + 30 + p % 50, f"{c}:{p}") for c in (1, 2, 3) for p in range(0, 5000, 7)]
    df = spark.createDataFrame(rows, "contig int, pos long, end long, name string")
    regions.write_by_place(df, str(tmp_path / "t"), width=500, end="end")
    wanted = [(1, 600, 720), (1, 700, 750), (3, 0, 5), (2, 4990, 9000), (9, 0, 10)]
    got = regions.read_regions(spark, str(tmp_path / "t"), wanted)
    want = sorted(n for c, a, b, n in rows if any(c == k and a < y and b > x for k, x, y in wanted))
    assert sorted(r["name"] for r in got.collect()) == want and got.columns == df.columns
    files = {f.split("rows/")[1].rsplit("/", 1)[0] for f in got.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert files <= {"_contig=1/_bin=1", "_contig=3/_bin=0", "_contig=2/_bin=9"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bin" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert regions.read_regions(spark, str(tmp_path / "t")).count() == len(rows)
    assert regions.spanning_regions(df.where("contig = 2 and pos < 100"), 500) == [(2, 0, 99)]
    with pytest.raises(ValueError, match="more than 2 bins"):
        regions.spanning_regions(df, 500, most=2)


def test_stitched_blocks_as_a_stream(spark, tmp_path):
    """Files of blocks over two runs of a query, the second going on where the first ends: open blocks are its state, and come out
    once their keys are idle."""
    schema = "key string, start long, end long, band int, gq int"
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = events.stitched_blocks(stream, "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        done = q.awaitTermination(60)
        q.stop()
        assert done

    add(("a", 0, 10, 1, 9), ("a", 10, 20, 1, 7), ("b", 5, 6, 2, 3), ("a", 20, 30, 1, 8), ("a", 30, 40, 2, 5), ("b", 9, 12, 2, 4))
    run()
    time.sleep(2)
    add(("c", 0, 1, 0, 0))
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("key <> 'c'").collect())
    assert got == [("a", 0, 30, 1, 7, 3), ("a", 30, 40, 2, 5, 1), ("b", 5, 6, 2, 3, 1), ("b", 9, 12, 2, 4, 1)]
