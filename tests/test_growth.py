"""Work and results that must not change with a table's size or with the order of its rows."""

import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from helixframe.operators import gvcf, joint, kernels, pileup, ranges, readfilters, validate
from helixframe.queries import reads


def _computed(df, name):
    """How often the optimised plan has a function."""
    return df._jdf.queryExecution().optimizedPlan().toString().upper().count(name)


def test_call_confidence_computes_a_step_once(spark):
    v = spark.range(50).select(F.array(F.col("id") * 3, F.col("id") % 20, F.col("id") % 45).cast("array<int>").alias("pl"))
    c = v.select(joint.call_confidence(F.col("pl"), F.lit(10.0), F.lit(0.01)).alias("c")).select("c.qual", "c.log10_p_absent")
    assert _computed(c, "POWER(") <= 6
    assert all(r.qual >= 0 for r in c.collect())


def test_joint_pl_computes_scores_once(spark):
    reads = F.array(*[F.array(*[-(F.col("id") * (r + 1) % 7 + a) / 10.0 for a in range(3)]) for r in range(2)])
    df = spark.range(50).select(joint.joint_pl(reads, 99).alias("pl"))
    assert _computed(df, "LOG10(") == 1
    assert all(min(r.pl) == 0 for r in df.collect())


def test_score_matrix_scores_different_texts_once(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choices("ACGT", k=n))
    forms = [(text(12), [30 - k] * 12, text(20)) for k in range(3)]
    reads = [(k % 2, k, *forms[k % 3][:2]) for k in range(60)] + [(1, 1, *forms[1][:2])]
    haps = [(k % 2, k, forms[k % 3][2]) for k in range(24)]
    df = kernels.score_matrix(spark.createDataFrame(reads, "region int, read_id int, read string, quals array<int>"), spark.createDataFrame(haps, "region int, hap_id int, hap string"))
    got = sorted((x.region, x.read_id, x.hap_id, round(x.log10_likelihood, 9)) for x in df.collect())
    assert got == sorted((g, i, j, round(kernels.pair_hmm(s, q, h), 9)) for g, i, s, q in reads for e, j, h in haps if g == e)
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")
    assert len(plan) == 2 and "Aggregate [read" in plan[1].split("\n")[1]  # scored: distinct texts


def _restless(df):
    """``df``, its rows in another order at each reading, as after a shuffle over a network."""
    def mixed(batches):
        rows = pd.concat(list(batches))
        yield rows.iloc[np.random.default_rng(time.time_ns()).permutation(len(rows))]

    return df.coalesce(1).mapInPandas(mixed, df.schema)


def test_block_split_of_rows_in_any_order(spark):
    r = random.Random(3)
    blocks = [(k % 3, 100 * k, 100 * k + r.randrange(40, 99), f"b{k}" if k % 4 else None) for k in range(120)]
    blocks += [(0, 500, 900, "long"), (0, 500, 900, "long"), (None, 1, 5, "x"), (1, 50, 50, "empty")]
    cuts = [(r.randrange(3), s := r.randrange(12000), s + r.randrange(0, 60)) for _ in range(200)]
    a, b = spark.createDataFrame(blocks, "contig int, start long, end long, name string"), spark.createDataFrame(cuts, "contig int, start long, end long")
    want = []
    for c, s, e, name in blocks:
        at = s
        for _, x, y in sorted(k for k in cuts if k[0] == c and k[1] < e and k[2] > s):
            want += [(c, name, at, x)] if x > at else []
            at = max(at, y)
        want += [(c, name, at, e)] if at < e else []
    got = gvcf.split_at_variants(_restless(a), b)
    assert got.columns == ["contig", "name", "start", "end"]
    assert sorted(map(str, got.collect())) == sorted(str(Row(contig=c, name=n, start=s, end=e)) for c, n, s, e in want)


def test_overlap_and_scores_of_rows_in_any_order(spark):
    a = spark.range(400).selectExpr("cast(id % 2 as int) as contig", "id * 10 as start", "id * 10 + 5 as end", "id")
    b = spark.range(50).selectExpr("cast(id % 2 as int) as contig", "id * 77 as start", "id * 77 + 9 as end")
    hit = {i for i in range(400) if any(i % 2 == j % 2 and i * 10 < j * 77 + 9 and j * 77 < i * 10 + 5 for j in range(50))}
    for how, want in (("left_semi", hit), ("left_anti", set(range(400)) - hit)):
        got = ranges.overlap_join(_restless(a), b, how=how)
        assert got.columns == a.columns and sorted(x.id for x in got.collect()) == sorted(want)
    v = spark.range(300).selectExpr("1 as contig", "id as pos", "'A' as ref", "array('C', 'G') as alts")
    s = spark.range(0, 300, 3).selectExpr("1 as contig", "id as pos", "'A' as ref", "'G' as alt", "id / 7 as score", "'q' as culprit", "true as positive", "false as negative")
    got = joint.apply_scores(_restless(v), s, True).collect()
    assert sorted((x.pos, x.score) for x in got if x.score is not None) == [(k, k / 7) for k in range(0, 300, 3)] and len(got) == 300


def test_unsorted_is_no_matter_of_ties(spark):
    rows = [(0, p, o, ["A"]) for o in range(40) for p in (9, 3, 7)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "contig int, pos int, ord int, alts array<string>").withColumn("id", F.col("pos"))
        got = validate.issues(df).where("rule = 'unsorted'").collect()
        assert [x.pos for x in got] == [3] * 39


def test_depth_reads_its_input_once(spark, sf):
    df = reads.depth_of_coverage(spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan parquet") == 1 and plan.count("ReusedExchange") == 1


def test_clear_bits_are_tested_at_once(spark):
    names = [*readfilters.COUNTING, "NotSecondary", "ForwardStrand"]
    rows = [(f, c, p, 60) for f in (None, 0, 1, 4, 16, 256, 512, 1024, 2048, 99) for c in (None, -1, 0) for p in (None, -1, 5)]
    df = spark.createDataFrame(rows, "flag int, contig int, pos int, mapq int")
    each = [F.coalesce(readfilters.FILTERS[n](), F.lit(False)) for n in names]
    for inverted in ([], ["Paired"], ["Mapped"]):
        keep = F.lit(True)
        for x in [*each, *[~F.coalesce(readfilters.FILTERS[n](), F.lit(False)) for n in inverted]]:
            keep = keep & x
        assert sorted(map(str, df.where(readfilters.chain(names, inverted)).collect())) == sorted(map(str, df.where(keep).collect()))
    given = df.select(F.hash("flag").alias("flag"), "contig", "pos", "mapq").where(readfilters.chain(readfilters.COUNTING))
    assert _computed(given, "HASH(") <= 3


def _counted_once(df):
    """Whether the plan reads one table, joins nothing and groups once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [") == 1 and "Join" not in plan and plan.count("Aggregate [") == 1


def test_allele_counts_need_no_table_of_sites(spark, sf):
    assert _counted_once(reads.allelic_counts(spark, sf))
    r = random.Random(7)
    rows = [(r.choice([0, 1, None, -2]), r.choice([3, 4, 5, None, -9]), r.choice(["A", "C", "G", "T", "N", None])) for _ in range(400)]
    bases = spark.createDataFrame(rows, "contig int, pos long, base string")
    ref, alt = reads._alleles()
    sites = bases.select("contig", "pos").distinct().select("contig", "pos", ref.alias("ref"), alt.alias("alt"))
    got, want = pileup.allele_counts_at(bases, ref, alt), pileup.allele_counts(bases, sites)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_nucleotide_counts_need_no_table_of_sites(spark, sf):
    assert _counted_once(reads.nucleotide_counts(spark, sf))
    r = random.Random(8)
    bases = spark.createDataFrame([(k % 2, r.randrange(9), r.choice("ACGTN")) for k in range(300)], "contig int, pos long, base string")
    ref = reads._alleles()[0]
    got, want = pileup.nucleotide_counts(bases, ["contig", "pos"], ref), pileup.nucleotide_counts(bases.withColumn("ref", ref), ["contig", "pos"])
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
