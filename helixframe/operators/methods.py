"""Methods of the filter-expression language: of sites (``vc.isSNP()``), genotypes (``vc.getGenotype("S1").isHet()``, or ``isHet``
and ``GQ`` in per-genotype expressions) and alleles (``vc.getAlternateAllele(0).length()``), and selections that use them.

Rows have ref, alts (array of texts), filter (array of texts), info (map) and genotypes (array of structs with sample, gt as an
array of allele numbers, and any of dp, gq, min_dp, ad, pl). Missing allele numbers are null or negative.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import Members, compile_expression
from .variants import variant_type

_TRANSITIONS = ("AG", "GA", "CT", "TC")


def is_breakpoint(allele: Column) -> Column:
    return (F.length(allele) > 1) & (allele.contains("[") | allele.contains("]"))


def is_single_breakend(allele: Column) -> Column:
    return (F.length(allele) > 1) & (allele.startswith(".") | allele.endswith("."))


def is_symbolic(allele: Column) -> Column:
    """``<X>``, breakends, and the spanning deletion."""
    return (allele == "*") | (F.length(allele) > 1) & (allele.startswith("<") | allele.endswith(">") | is_breakpoint(allele) | is_single_breakend(allele))


def allele_members(allele: Column, reference: bool) -> Members:
    """Methods of one allele; a site that doesn't have it has no values."""
    there = allele.isNotNull()
    flag = lambda c: (F.when(there, c), "bool")
    return {
        "length": lambda: (F.when(there & (allele != "."), F.when(is_symbolic(allele), 0).otherwise(F.length(allele))).cast("double"), "num"),
        "isSymbolic": lambda: flag(is_symbolic(allele)), "isBreakpoint": lambda: flag(is_breakpoint(allele)), "isSingleBreakend": lambda: flag(is_single_breakend(allele)),
        "isReference": lambda: flag(F.lit(reference)), "isNonReference": lambda: flag(F.lit(not reference) & (allele != ".")), "isNoCall": lambda: flag(allele == "."),
        "isCalled": lambda: flag(allele != "."), "isNonRefAllele": lambda: flag(allele == "<NON_REF>"),
    }


def _missing(gt: Column) -> Column:
    return F.exists(gt, lambda a: F.coalesce(a < 0, F.lit(True)))


def genotype_members(g: Column, fields: set[str]) -> Members:
    """Methods of one genotype; those about its alleles have no value where one of them is missing. fields: what its struct has."""
    gt = g["gt"]
    has = gt.isNotNull() & (F.size(gt) > 0)
    called = lambda c: (F.when(has & ~_missing(gt), c), "bool")
    same = F.array_min(gt) == F.array_max(gt)
    none = F.lit(None).cast("int")
    field = lambda name: g[name] if name in fields else none
    at = lambda name, k: F.get(g[name], F.lit(int(k))) if name in fields else none
    number = lambda c: (F.when(c >= 0, c).cast("double"), "num")
    there = lambda c: (F.when(g.isNotNull(), F.coalesce(c >= 0, F.lit(False))), "bool")
    return {
        "isAvailable": lambda: (F.when(has, F.lit(True)), "bool"), "isNoCall": lambda: (F.when(has, _missing(gt)), "bool"), "isCalled": lambda: (F.when(has, ~_missing(gt)), "bool"),
        "isHet": lambda: called(~same), "isHom": lambda: called(same), "isHomRef": lambda: called(F.array_max(gt) == 0), "isHomVar": lambda: called(same & (F.array_min(gt) > 0)),
        "getDP": lambda: number(field("dp")), "getMIN_DP": lambda: number(field("min_dp")), "getGQ": lambda: number(field("gq")), "getPhredScaledQual": lambda: number(field("gq")),
        "getPloidy": lambda: (F.when(has, F.size(gt)).cast("double"), "num"), "getAD": lambda k=0: number(at("ad", k)), "getPL": lambda k=0: number(at("pl", k)),
        "hasDP": lambda: there(field("dp")), "hasGQ": lambda: there(field("gq")), "hasAD": lambda: there(at("ad", 0)), "hasPL": lambda: there(at("pl", 0)),
    }


def is_filtered(labels: Column) -> Column:
    """Whether a FILTER array has anything but PASS and the dot."""
    return F.size(F.array_except(F.coalesce(labels, F.array().cast("array<string>")), F.array(F.lit("PASS"), F.lit(".")))) > 0


def polymorphic(genotypes: Column) -> Column:
    """Whether some genotype calls an alternate."""
    return F.coalesce(F.exists(genotypes, lambda g: F.exists(g["gt"], lambda a: F.coalesce(a > 0, F.lit(False)))), F.lit(False))


def _substitutions(ref: Column, alts: Column, transitions: bool) -> Column:
    single = (F.length(ref) == 1) & (F.size(alts) > 0) & F.forall(alts, lambda a: F.length(a) == 1)
    kind = lambda a: F.upper(F.concat(ref, a)).isin(*_TRANSITIONS)
    return F.coalesce(single & F.forall(alts, kind if transitions else lambda a: ~kind(a)), F.lit(False))


def site_methods(genotype_fields: set[str] = frozenset({"gt", "dp", "gq", "ad", "pl"})) -> dict[str, Callable]:
    """``vc.`` methods over the columns that the module names, for ``expr.compile_expression``."""
    ref, alts, genotypes = F.col("ref"), F.col("alts"), F.col("genotypes")
    kind = variant_type(ref, alts)
    real = F.filter(alts, lambda a: a != ".")
    one = lambda name: lambda: kind == name
    sample = lambda s: genotype_members(F.get(F.filter(genotypes, lambda g: g["sample"] == s), F.lit(0)), genotype_fields)
    methods = {
        "isSNP": one("SNP"), "isIndel": one("INDEL"), "isMNP": one("MNP"), "isSymbolic": one("SYMBOLIC"), "isMixed": one("MIXED"), "isNoVariation": one("NO_VARIATION"), "isVariant": lambda: (F.size(real) > 0) & (kind != "NO_VARIATION"),
        "isTransition": lambda: _substitutions(ref, alts, True), "isTransversion": lambda: _substitutions(ref, alts, False), "isBiallelic": lambda: F.size(real) == 1, "isMultiallelic": lambda: F.size(real) > 1,
        "isFiltered": lambda: is_filtered(F.col("filter")), "isPass": lambda: ~is_filtered(F.col("filter")), "isNotFiltered": lambda: ~is_filtered(F.col("filter")), "filtersIsEmpty": lambda: ~is_filtered(F.col("filter")),
        "isPolymorphicInSamples": lambda: polymorphic(genotypes), "isMonomorphicInSamples": lambda: ~polymorphic(genotypes), "hasGenotypes": lambda: F.size(genotypes) > 0, "genotypesIsEmpty": lambda: F.coalesce(F.size(genotypes) <= 0, F.lit(True)),
        "hasAttribute": lambda key: F.coalesce(F.try_element_at(F.col("info"), F.lit(key)).isNotNull(), F.lit(False)), "hasAlternateAllele": lambda k: F.lit(k >= 0) & (F.lit(int(k)) < F.size(real)),
        "getGenotype": lambda s: (sample(s), "members"), "getReference": lambda: (allele_members(ref, True), "members"), "getAlternateAllele": lambda k=0: (allele_members(F.get(alts, F.lit(int(k))), False), "members"),
    }
    return {f"vc.{k}": f for k, f in methods.items()}


def genotype_rule(text: str, fields: set[str] = frozenset({"gt", "dp", "gq", "ad", "pl"}), missing_fails: bool = False) -> Callable[[Column], Column]:
    """A per-genotype expression (``GQ < 20 && isHet()``, ``isHomVar == 1``, ``AD[1] > 3``) as a function of a genotype."""

    def rule(g: Column) -> Column:
        members = genotype_members(g, fields)
        methods = {f"g.{k}": f for k, f in members.items()} | {k: f for k, f in members.items()}

        def field(name: str, index: int | None) -> tuple[Column, str]:
            if name in members:  # isHet == 1
                column, kind = members[name]()
                return (column.cast("double"), "num") if kind == "bool" else (column, kind)
            key = name.lower()
            if key not in fields:
                return F.lit(None).cast("double"), "num"
            value = g[key] if index is None else F.get(g[key], F.lit(index))
            return F.when(value >= 0, value).cast("double"), "num"

        return compile_expression(text, field, methods, missing_fails)

    return rule


def select_genotypes(df: DataFrame, text: str, fields: set[str] = frozenset({"gt", "dp", "gq", "ad", "pl"})) -> DataFrame:
    """Rows where some genotype meets the per-genotype expression."""
    rule = genotype_rule(text, fields)
    return df.where(F.exists("genotypes", rule))


def is_non_variant(alts: Column, genotypes: Column | None = None) -> Column:
    """No alternate at all, or genotypes of which none calls one (site-only rows need an alternate only)."""
    real = F.filter(alts, lambda a: a != ".")
    if genotypes is None:
        return F.size(real) <= 0
    called = F.exists(F.flatten(F.transform(genotypes, lambda g: g["gt"])), lambda a: F.coalesce((a > 0) & (a <= F.size(real)), F.lit(False)))
    return (F.size(real) <= 0) | (F.coalesce(F.size(genotypes), F.lit(0)) > 0) & ~F.coalesce(called, F.lit(False))
