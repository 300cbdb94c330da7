"""Row types. Intervals and positions are 0-based and half-open inside the engine; readers and writers convert."""

from __future__ import annotations

READS = "rid long, qname string, flag int, contig int, pos long, mapq int, cigar string, mate_contig int, mate_pos long, seq string, qual string, read_group string"
INTERVALS = "contig int, start long, end long"
VARIANTS = "contig int, pos long, id string, ref string, alts array<string>, qual double, filter array<string>, info map<string,array<string>>, genotypes array<struct<sample:string,gt:array<int>,gq:int,dp:int,ad:array<int>,pl:array<int>,ft:string>>"
PILEUP_SUMMARIES = "contig string, position long, ref_count int, alt_count int, other_alt_count int, allele_frequency double"
READ_COUNTS = "contig string, start long, end long, count long"
COPY_RATIOS = "contig string, start long, end long, log2_copy_ratio double"
