"""Operators against brute force on small inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import numeric, sequence as S
from helixframe.operators import cnv, dedup, expr, genotype, gvcf, kernels, methods, pileup, ranges, readfilters, recal, scan, tranche, variants as V


def _intervals(spark, rows):
    return spark.createDataFrame(rows, "contig int, start long, end long")


def test_overlap_join_is_exact(spark):
    r = random.Random(1)
    make = lambda n: [(r.randrange(3), s := r.randrange(5000), s + r.randrange(1, 900)) for _ in range(n)]
    a, b = make(120), make(90)
    got = sorted(tuple(x) for x in ranges.overlap_join(_intervals(spark, a), _intervals(spark, b), 256).collect())
    want = sorted((*x, *y) for x, y in itertools.product(a, b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert got == want


@pytest.mark.parametrize("abutting", [True, False])
def test_merge(spark, abutting):
    rows = [(0, 1, 5), (0, 5, 7), (0, 6, 9), (0, 20, 21), (1, 1, 2)]
    got = sorted(tuple(x) for x in ranges.merge(_intervals(spark, rows), abutting).select("contig", "start", "end").collect())
    assert got == ([(0, 1, 9), (0, 20, 21), (1, 1, 2)] if abutting else [(0, 1, 5), (0, 5, 9), (0, 20, 21), (1, 1, 2)])


def test_subtract_and_depth(spark):
    a, b = _intervals(spark, [(0, 0, 100), (0, 50, 120)]), _intervals(spark, [(0, 10, 20), (0, 110, 130), (1, 0, 9)])
    assert sorted(tuple(x) for x in ranges.subtract(a, b).select("start", "end").collect()) == [(0, 10), (20, 110)]
    assert sorted(tuple(x) for x in ranges.depth_segments(a).select("start", "end", "depth").collect()) == [(0, 50, 1), (50, 100, 2), (100, 120, 1)]
    assert ranges.merge(_intervals(spark, [])).count() == 0


def test_expression_missing_policy(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, "abc")], "id int, dp double, note string")
    field = expr.column_resolver({"dp": "num", "note": "str"})
    def run(text, fails=False):
        return [r[0] for r in df.orderBy("id").select(expr.compile_expression(text, field, missing_fails=fails)).collect()]
    assert run("dp < 4") == [False, True] and run("dp < 4", True) == [True, True]
    assert run("!(dp < 4)") == [True, False] and run("!(dp < 4)", True) == [False, False]
    assert run("dp == null") == [True, False] and run("dp != null") == [False, True]
    assert run('note !~ "b"') == [True, False] and run('note =~ "b"') == [False, True]
    assert run("dp == 3 || dp == 4 && dp == 5") == [False, True]
    assert run("nothing == 1") == [False, False]
    for bad in ("dp <", "(dp < 1", "dp ~ 1", "dp < 1 2"):
        with pytest.raises(expr.ExpressionError):
            expr.compile_expression(bad, field)


def test_cigar_functions(spark):
    df = spark.createDataFrame([("5S10M2I3M4D6M3S", 100), ("10M", 7), (None, 0)], "cigar string, pos long").withColumn("ops", S.cigar_ops(F.col("cigar")))
    got = df.select(S.reference_length(F.col("ops")), S.query_length(F.col("ops")), S.unclipped_five_prime(F.col("pos"), F.col("ops"), F.lit(False)), S.unclipped_five_prime(F.col("pos"), F.col("ops"), F.lit(True))).collect()
    assert [tuple(r) for r in got] == [(23, 29, 95, 125), (10, 10, 7, 16), (0, 0, 0, -1)]
    cigars = {"10M": True, "0M5M": False, "5M3N5M": False, "5M2I2D5M": False, "3D5M": False, "2S3D5M": False, "5M3D": False, "5M3D2S": False, "3S5M1D5M2H": True}
    rows = spark.createDataFrame(list(cigars.items()), "c string, want boolean").select(S.good_cigar(F.col("c")), "want").collect()
    assert all(a == b for a, b in rows)


def test_minimal_alleles_and_left_align(spark):
    df = spark.createDataFrame([(10, "ACGT", "AGGT"), (5, "GCC", "GC"), (3, "A", "A"), (7, "TAAA", "TA")], "pos long, ref string, alt string")
    got = [tuple(r[0]) for r in df.select(V.minimal_alleles(F.col("pos"), F.col("ref"), F.col("alt"))).collect()]
    assert got == [(11, "C", "G"), (5, "GC", "G"), (3, "A", "A"), (7, "TAA", "T")]
    ref = spark.createDataFrame([(0, 0, "GGTTACACACACAGGT")], "contig int, start long, seq string")
    rows = [(0, 9, "CAC", "C"), (0, 9, "CAC", "C"), (0, 4, "A", "ACA"), (0, 14, "G", "T"), (7, 9, "CAC", "C"), (7, 5, "AT", "AG")]
    v = spark.createDataFrame(rows, "contig int, pos long, ref string, alt string")
    assert sorted(tuple(x) for x in V.left_align(v, ref).collect()) == [(0, 3, "T", "TAC"), (0, 3, "TAC", "T"), (0, 3, "TAC", "T"), (0, 14, "G", "T"), (7, 6, "T", "G"), (7, 9, "CAC", "C")]


def test_genotypes(spark):
    df = spark.createDataFrame([([0, 30, 60],), ([10, 10, 99],), ([-1, -1, 5],), ([300, 0, 300],)], "pl array<int>")
    assert [tuple(r[0]) for r in df.select(genotype.best_genotype(F.col("pl"))).collect()] == [(0, 30), (0, 0), (2, 0), (1, 99)]
    assert numeric.genotypes_of(3) == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]


def test_fisher_and_excess_het():
    for a, b, c, d in ((3, 1, 1, 3), (10, 0, 2, 9), (0, 0, 0, 0)):
        n, r, k = a + b + c + d, a + b, a + c
        p = {x: math.comb(r, x) * math.comb(n - r, k - x) / math.comb(n, k) for x in range(max(0, r + k - n), min(r, k) + 1)}
        assert genotype._fisher(a, b, c, d) == pytest.approx(min(1, sum(v for v in p.values() if v <= p[a] * (1 + 1e-9))))
    assert genotype._excess_het(10, 0, 10) < 0.1 and genotype._excess_het(0, 20, 0) > 20


def test_empirical_quality(spark):
    def brute(n, k, prior):
        best = None
        for q in range(61):
            p = 10 ** (-q / 10)
            z = -0.5 * (min(abs(q - prior), 40) / 0.5) ** 2 + (k + 1) * math.log(p) + (n + 2 - k - 1) * (math.log(1 - p) if q else -1e300)
            if best is None or z > best[0]:
                best = (z, q)
        return best[1]
    rows = [(1000, 1.0, 30), (10, 5.0, 30), (100000, 2000.0, 25), (0, 0.0, 40)]
    df = spark.createDataFrame(rows, "n long, k double, prior int")
    got = [r[0] for r in df.select(recal.empirical_quality(F.col("n"), F.col("k"), F.col("prior"))).collect()]
    assert got == [brute(*r) for r in rows]


def test_quantiles(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "v array<double>")
    got = df.select(numeric.quantile_n_plus_one(F.col("v"), 50.0), numeric.quantile_floor(F.col("v"), 0.75)).collect()
    assert tuple(got[0]) == (2.5, 3.0) and tuple(got[1]) == (None, None)


def test_pair_hmm_matches_sums_of_paths():
    read, hap, q = "ACG", "AACGT", [30, 30, 30]
    go, ge = 10**-4.5, 10**-1.0
    mm, mi, im, ii = 1 - 2 * go, go, 1 - ge, ge
    n = len(hap)
    m = np.zeros((4, n + 1)); i = np.zeros((4, n + 1)); d = np.zeros((4, n + 1))
    d[0] = 1 / n
    for r in range(1, 4):
        for j in range(1, n + 1):
            e = 10 ** (-q[r - 1] / 10)
            p = 1 - e if read[r - 1] == hap[j - 1] else e / 3
            m[r, j] = p * (m[r - 1, j - 1] * mm + (i[r - 1, j - 1] + d[r - 1, j - 1]) * im)
            i[r, j] = m[r - 1, j] * mi + i[r - 1, j] * ii
            d[r, j] = m[r, j - 1] * mi + d[r, j - 1] * ii
    assert kernels.pair_hmm(read, q, hap) == pytest.approx(math.log10((m[3] + i[3])[1:].sum()))


def test_pair_hmm_batches_equal_single_pairs():
    r = random.Random(6)
    reads = ["".join(r.choice("ACGTN") for _ in range(r.randrange(0, 30))) for _ in range(200)]
    haps = ["".join(r.choice("ACGT") for _ in range(r.randrange(0, 50))) for _ in range(200)]
    quals = [np.array([r.randrange(2, 41) for _ in x]) for x in reads]
    go, ge = 10**-4.5, 10**-1.0
    mm, mi, im, ii = 1 - 2 * go, go, 1 - ge, ge
    for read, q, hap, got in zip(reads, quals, haps, kernels.pair_hmm_scores(reads, quals, haps), strict=True):
        if not read or not hap:
            assert got == (-math.inf if read else 0.0)
            continue
        m, i, d = [0.0] * (len(hap) + 1), [0.0] * (len(hap) + 1), [1 / len(hap)] * (len(hap) + 1)
        for base, x in zip(read, q, strict=True):
            e, nm, ni, nd = 10 ** (-x / 10), [0.0], [0.0], [0.0]
            for j, h in enumerate(hap, 1):
                nm.append((1 - e if h == base or base == "N" else e / 3) * (m[j - 1] * mm + (i[j - 1] + d[j - 1]) * im))
                ni.append(m[j] * mi + i[j] * ii)
                nd.append(nm[j - 1] * mi + nd[j - 1] * ii)
            m, i, d = nm, ni, nd
        assert got == pytest.approx(math.log10(sum(m[1:]) + sum(i[1:])), abs=1e-9)


def align_by_cells(ref, alt, overhang, match, mismatch, opening, extending):
    """The aligner's rules, a cell at a time, for the batched form's test."""
    if overhang in ("softclip", "ignore") and alt in ref:
        return len(alt) * match, f"{len(alt)}M", ref.rindex(alt)
    n, m, low = len(ref), len(alt), -(10**9)
    score, how, gap_d, gap_i = {}, {}, {}, {}
    for i in range(n + 1):
        for j in range(m + 1):
            if not i or not j:
                score[i, j] = opening + extending * (i + j - 1) if i + j and "indel" in overhang else 0
                gap_d[i, j] = gap_i[i, j] = (low, 0)
                continue
            new, old = score[i - 1, j] + opening, gap_d[i - 1, j]
            gap_d[i, j] = (new, 1) if new > old[0] + extending else (old[0] + extending, old[1] + 1)
            new, old = score[i, j - 1] + opening, gap_i[i, j - 1]
            gap_i[i, j] = (new, 1) if new > old[0] + extending else (old[0] + extending, old[1] + 1)
            x = score[i - 1, j - 1] + (match if ref[i - 1] == alt[j - 1] else mismatch)
            score[i, j] = max(x, gap_i[i, j][0], gap_d[i, j][0])
            how[i, j] = ("M", 1) if score[i, j] == x else ("I", gap_i[i, j][1]) if score[i, j] == gap_i[i, j][0] else ("D", gap_d[i, j][1])
    ends = [(n, m)] if overhang == "indel" else [max(((k, m) for k in range(1, n + 1)), key=lambda c: (score[c], c))]
    if overhang in ("softclip", "ignore"):
        ends += [(n, k) for k in range(1, m + 1)]
    i, j = ends[0]
    for c in ends[1:]:
        if (score[c], -abs(c[0] - c[1])) > (score[i, j], -abs(i - j)):
            i, j = c
    total, path = score[i, j], ("S" if overhang == "softclip" else "M") * (m - j)
    while i and j:
        op, size = how[i, j]
        path += op * size
        i, j = i - (op != "I") * size, j - (op != "D") * size
    offset = 0 if "indel" in overhang else i if overhang == "softclip" else i - j
    path += "S" * j if overhang == "softclip" else path[-1] * j if overhang == "ignore" else "D" * i or "I" * j
    return total, "".join(f"{len(list(g))}{o}" for o, g in itertools.groupby(path[::-1])), offset


@pytest.mark.parametrize("overhang", ["softclip", "indel", "leading_indel", "ignore"])
def test_smith_waterman_batches_equal_cells(overhang):
    r = random.Random(overhang)
    refs = ["".join(r.choice("AC" if k % 2 else "ACGT") for _ in range(r.choice([1, 3, 12, 20]))) for k in range(300)]
    alts = [x[:4] + x[4 + r.randrange(3) :] if k % 3 else "".join(r.choice("ACG") for _ in range(r.choice([1, 4, 15]))) for k, x in enumerate(refs)]
    for weights in ((10, -15, -30, -5), (3, -1, -4, -3), (25, -50, -110, -6)):
        got = kernels.smith_waterman_batch(refs, alts, overhang, *weights)
        for ref, alt, x in zip(refs, alts, got, strict=True):
            assert x == align_by_cells(ref, alt, overhang, *weights), (ref, alt)


def test_smith_waterman():
    assert kernels.smith_waterman("ACGTACGTAC", "ACGTACGTAC") == (100, "10M", 0)
    assert kernels.smith_waterman("TTTTACGTACGTACGG", "ACGTACGTAC")[1:] == ("10M", 4)
    score, cigar, offset = kernels.smith_waterman("AAAACCCCGGGGTTTTACACAC", "AAAACCCCTTTTACACAC", "indel")
    assert cigar == "8M4D10M" and offset == 0 and score == 180 - 30 - 15
    assert kernels.smith_waterman("ACGTAAAAAATTG", "ACGTAAAATTG", "indel")[1] == "4M2D7M"  # a tie in a homopolymer
    assert kernels.smith_waterman("", "AC") == (0, "2S", 0)


def test_assembly_finds_both_alleles():
    left, right = "ACGTTGCAGTCAGGATCCAT", "GGCTTAACCGTATGCGATTC"
    a, b = left + "A" + right, left + "T" + right
    found = [s for s, _ in kernels.assemble([(a, True)] + [(b, False)] * 3, k=9)]
    assert sorted(found) == sorted([a, b]) and found[0] == b


def test_segments_and_calls(spark):
    rows = [(0, k, k + 1, 0.0 if k < 5 else 2.0) for k in range(10)] + [(0, 20, 21, 2.0)]
    df = spark.createDataFrame(rows, "contig int, start long, end long, log2_ratio double")
    got = sorted(tuple(r) for r in cnv.segment(df, 0.5).select("start", "end", "n_points", "mean").collect())
    assert got == [(0, 5, 5, 0.0), (5, 10, 5, 2.0), (20, 21, 1, 2.0)]
    seg = spark.createDataFrame([(10, 1.0), (10, 1.02), (10, 0.98), (5, 1.5), (5, 0.5)], "n_points long, ratio double")
    assert {r["ratio"]: r["call"] for r in cnv.call_segments(seg).collect()} == {1.0: "0", 1.02: "0", 0.98: "0", 1.5: "+", 0.5: "-"}


def test_tranches(spark):
    df = spark.createDataFrame([(float(k), k % 2 == 0) for k in range(100)], "score double, truth boolean")
    got = {r["target"]: (r["min_score"], r["truth_calls"]) for r in tranche.tranche_table(df, (50.0, 100.0)).collect()}
    assert got == {50.0: (50.0, 25), 100.0: (0.0, 50)}


def test_library_size():
    n, size = 10_000, 25_000
    unique = round(size * -math.expm1(-n / size))
    assert abs(dedup.estimate_library_size(n, unique) - size) < 50
    assert dedup.estimate_library_size(10, 10) == 0


def test_results_do_not_depend_on_partitions(spark):
    r = random.Random(3)
    rows = [(r.randrange(4), s := r.randrange(900), s + r.randrange(1, 60)) for _ in range(300)]
    out = []
    for n in (1, 7):
        df = _intervals(spark, rows).repartition(n)
        out.append((sorted(map(tuple, ranges.merge(df).collect())), sorted(map(tuple, ranges.scatter(ranges.merge(df), 5).collect()))))
    assert out[0] == out[1]


def test_read_filter_names(spark):
    with pytest.raises(ValueError):
        readfilters.chain(["NoSuchFilter"])
    assert len(readfilters.FILTERS) >= 30


def test_block_split(spark):
    blocks = _intervals(spark, [(0, 0, 100), (0, 100, 120), (0, 200, 210)])
    cut = _intervals(spark, [(0, 10, 20), (0, 15, 30), (0, 100, 125), (0, 205, 300)])
    got = sorted(tuple(x) for x in gvcf.split_at_variants(blocks, cut).select("start", "end").collect())
    assert got == [(0, 10), (30, 100), (200, 205)]


def test_streaming_matches_batch(spark, tmp_path):
    from helixframe.streaming.events import tumbling_counts

    df = spark.sql("select cast(id as long) as event_id, timestamp_seconds(id * 97) as ts, concat('t', id % 3) as event_type from range(500)")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = tumbling_counts(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("tumbling").collect()))
    assert got == sorted(map(tuple, tumbling_counts(df).collect()))


def test_kernel_changepoints_finds_many_and_weak_ones():
    import numpy as np

    from helixframe.operators.cnv import kernel_changepoints

    rng = np.random.default_rng(4)
    many = kernel_changepoints(np.repeat([0.0, 3.0] * 15, 40) + rng.normal(0, 0.1, 1200))
    assert many == list(range(40, 1200, 40))
    weak = kernel_changepoints(np.repeat([0.0, 0.8], 400) + rng.normal(0, 0.8, 800))
    assert len(weak) == 1 and abs(weak[0] - 400) <= 20
    assert len(kernel_changepoints(np.repeat([0.0, 3.0] * 15, 40), most=5)) == 5
    assert kernel_changepoints(np.zeros(15)) == kernel_changepoints(np.zeros(300)) == []


def test_mixture_is_fitted_on_all_rows(spark):
    import numpy as np

    from helixframe.operators.kernels import fit_mixture
    from helixframe.queries.models import _weighted_points

    v = spark.range(5000).selectExpr("id", "id % 7 / 10.0D as x", "id % 5 / 5.0D as y")
    x, n = _weighted_points(v)
    assert n.sum() == 5000 and len(x) == 35
    _, means, cov = fit_mixture(x, 1, weight=n)
    rows = np.array([[k % 7 / 10, k % 5 / 5] for k in range(5000)])
    assert np.allclose(means[0], rows.mean(0)) and np.allclose(cov[0], np.cov(rows.T, bias=True) + 1e-3 * np.eye(2))


def test_scans_in_blocks_equal_scans_in_order(spark):
    r = random.Random(14)
    rows = [(r.randrange(3), r.randrange(-50, 400), k, r.randrange(100) if k % 7 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "key int, at int, id int, v int").repartition(5)
    out = scan.scanned(df, ["key"], ["at", "id"], scan.position_block("at", 37), sums=["v"], maxima=["v"], lags=["v"], leads=["v", "id"])
    got = {x["id"]: (x["sum_v"], x["max_v"], x["lag_v"], x["lead_v"], x["lead_id"]) for x in out.collect()}
    want = {}
    for key in range(3):
        mine = sorted(((at, i, v) for k, at, i, v in rows if k == key))
        for n, (_, i, v) in enumerate(mine):
            seen = [x for _, _, x in mine[: n + 1] if x is not None]
            before = [x for _, _, x in mine[:n] if x is not None]
            want[i] = (sum(seen), max(before, default=None), mine[n - 1][2] if n else None, mine[n + 1][2] if n + 1 < len(mine) else None, mine[n + 1][1] if n + 1 < len(mine) else None)
    bad = {k: (got[k], want[k]) for k in want if got[k][1:] != want[k][1:] or (got[k][0] or 0) != want[k][0]}
    assert got.keys() == want.keys() and not bad
    scored, block = scan.value_block(df.select((F.col("id") / 7.0).alias("x")), "x", blocks=9, descending=True)
    ranked = scan.scanned(scored.withColumn("down", -F.col("x")).withColumn("one", F.lit(1)), [], ["down"], block, sums=["one"]).collect()
    assert [x["sum_one"] for x in sorted(ranked, key=lambda x: -x["x"])] == list(range(1, 501))


def test_target_walk():
    rows = [(0.2, "a"), (0.5, "b"), (0.89, "c"), (0.91, "d"), (1.0, "e")]
    assert tranche.target_walk(rows, [90.0, 100.0]) == [(90.0, "d"), (100.0, "e")]
    assert tranche.target_walk(rows, [99.9, 100.0, 30.0]) == [(30.0, "b"), (99.9, "e"), (100.0, "e")]
    assert tranche.target_walk(rows[:1], [90.0]) == [] and tranche.target_walk(rows, []) == []


def test_expression_objects(spark):
    known = methods.site_methods()
    for text in ("vc.getReference()", "vc.getReference().isHet()", "vc.isNothing()", "vc.getGenotype(\"S\")"):
        with pytest.raises(expr.ExpressionError):
            expr.compile_expression(text, expr.column_resolver({}), known)
    g = "struct<sample:string,gt:array<int>,dp:int,gq:int,ad:array<int>,pl:array<int>>"
    rows = [("A", ["<DEL>", "*"], None, None, [("S1", [0, -1], None, 9, None, None)]), ("AT", ["A", "A[1:5[", "G."], ["q10"], {"DP": "1"}, [("S1", [2, 2], 3, None, [1, 2], None)])]
    df = spark.createDataFrame(rows, f"ref string, alts array<string>, filter array<string>, info map<string,string>, genotypes array<{g}>")
    tests = ["vc.isSymbolic()", "vc.isMultiallelic()", "vc.getAlternateAllele(1).isSymbolic()", "vc.getAlternateAllele(1).isBreakpoint()", "vc.getAlternateAllele(2).isSingleBreakend()", "vc.isFiltered()", "vc.hasAttribute('DP')",
             "vc.getGenotype('S1').isHomVar()", "vc.getGenotype('S1').isNoCall()", "vc.getGenotype('S1').getAD()[1] == 2", "vc.getGenotype('S1').hasGQ()", "vc.isPolymorphicInSamples()"]
    got = df.select(*[expr.compile_expression(t, expr.column_resolver({}), known).alias(f"t{k}") for k, t in enumerate(tests)]).collect()
    assert [tuple(x) for x in got] == [(True, True, True, False, False, False, False, False, True, False, True, False), (False, True, True, True, True, True, True, True, False, True, False, True)]


def test_active_regions_do_not_depend_on_tiles(spark):
    r = random.Random(5)
    rows = [(c, p, 0.5 if r.random() < 0.3 else 0.0) for c in (1, 2) for k in range(12) for p in range(k * 700 + r.randrange(300), k * 700 + 320)]
    df = spark.createDataFrame(list({(c, p): (c, p, a) for c, p, a in rows}.values()), "contig int, pos long, activity double")
    got = [sorted(tuple(x) for x in kernels.active_regions(df, 0.02, tile=t).collect()) for t in (128, 1000, 1 << 16)]
    assert got[0] == got[1] == got[2] and all(b - a <= 300 for _, a, b in got[0]) and len(got[0]) > 10


def test_weights_equal_repeated_rows():
    rng = np.random.default_rng(3)
    rows = np.c_[rng.integers(10, 40, 50), rng.integers(0, 9, 50), np.zeros(50, int)]
    rows[:, 2] = rng.integers(0, rows[:, 1] + 1)
    n = rng.integers(1, 6, 50)
    assert kernels.orientation_em(rows, weight=n.astype(float)) == pytest.approx(kernels.orientation_em(np.repeat(rows, n, 0)))
    x = rows.astype(float)
    frequency = rng.random(50) / 2
    big = [np.repeat(v, n) for v in (x[:, 1], x[:, 0], frequency)]
    assert kernels.contamination(x[:, 1], x[:, 0], frequency, weight=n.astype(float)) == pytest.approx(kernels.contamination(*big))


def test_assembly_says_when_it_gives_up():
    r = random.Random(2)
    reads = [("".join(r.choice("AC") for _ in range(60)), k == 0) for k in range(40)]
    with pytest.raises(ValueError, match="too many paths"):
        kernels.assemble(reads, k=4, most=10**6, most_steps=20)


def test_smoothed_segments(spark):
    rows = [(1, 0, 10, 30, 0.0, 0.1), (1, 10, 20, 30, 0.01, 0.1), (1, 20, 30, 30, 1.0, 0.1), (1, 30, 40, 30, 1.01, 0.1), (2, 0, 5, 4, 0.0, 0.0), (2, 5, 9, 4, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "contig int, start long, end long, n_points long, mean double, sd double")
    got = sorted((x[0], x[1], x[2], x[3], round(x[4], 6)) for x in cnv.smooth(df).collect())
    assert got == [(1, 0, 20, 60, 0.005), (1, 20, 40, 60, 1.005), (2, 0, 5, 4, 0.0), (2, 5, 9, 4, 3.0)]
