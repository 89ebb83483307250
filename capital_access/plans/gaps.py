"""Amounts per worker, firm ownership, and the gaps between areas and groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from capital_access.config import StudyConfig
from capital_access.functions.columns import (
    between_columns,
    containing,
    map_columns,
    numeric,
    pick,
    select_renamed,
    suffixed,
)
from capital_access.functions.nulls import as_col, ratio, sum_of
from capital_access.functions.text import pad_code
from capital_access.operators.aggregates import compare_to_peers, peer_stats, shares, weighted_means
from capital_access.operators.joins import left_join, star_join
from capital_access.operators.reshape import column_names, lengthen, vocabulary, widen
from capital_access.session import settle

# Measures of the attainment table.
ATTAINMENT_COLUMNS = {
    "baplus_white": "S1501_C01_033E",
    "baplus_black": "S1501_C01_036E",
    "baplus_asian": "S1501_C01_042E",
    "baplus_latino": "S1501_C01_054E",
    "hsplus_white": "S1501_C01_032E",
    "hsplus_black": "S1501_C01_035E",
    "hsplus_asian": "S1501_C01_041E",
    "hsplus_latino": "S1501_C01_053E",
}
# Labels of the owners table, and the short names used for shares.
ALL_FIRMS_LABEL = "All firms classifiable by gender, ethnicity, race, and veteran status"
DROPPED_LABEL = (
    "Publicly held and other firms not classifiable by gender, ethnicity, race, and veteran status"
)
ALL_FIRMS = "All_classified"
OWNER_GROUPS = {
    "female": "Female-owned",
    "black": "Black or African American",
    "white": "White",
    "hispanic": "Hispanic",
    "minority": "Minority",
    "nonminority": "Nonminority",
}
OWNER_LABELS = (ALL_FIRMS, *OWNER_GROUPS.values(), "Male-owned")
TRADED = ("traded", "local")
# Worker shares of the demographics table.
FEMALE_WORKERS = "female"
MINORITY_WORKERS = "Black or Hispanic"


def attainment_summary(raw: DataFrame, study: StudyConfig) -> DataFrame:
    """Education counts of the compared areas under readable names, codes padded."""
    codes = containing(raw, "code")
    padded = map_columns(raw, codes, lambda c: pad_code(c, 5)).filter(study.in_area())
    return select_renamed(padded, **{c: c for c in codes}, **ATTAINMENT_COLUMNS)


# ---- ownership -------------------------------------------------------------


def _only_value(c: Column) -> Column:
    """The value of a cell; an error where rows give it different ones."""
    return F.when(F.min(c) == F.max(c), F.max(c)).when(F.count(c) > 0, F.raise_error(F.lit("an owner group has two values in one cell")).cast("double"))


def clean_owners(owners: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per area, a column ``label_traded`` per owner group and firm type.

    All labels of the data become columns, after the known ones, which are there
    in any case; reading them is a job. With ``labels`` only these are shown.
    Rows that repeat count once, rows that contradict each other are an error.
    """
    kept = (
        owners.distinct()
        .withColumn(
            "label", F.when(F.col("label") == ALL_FIRMS_LABEL, ALL_FIRMS).otherwise(F.col("label"))
        )
        .filter(F.col("label") != DROPPED_LABEL)
        .drop("firmall")
    )
    keys = [c for c in kept.columns if c not in ("label", "is.traded", "firmdemp")]
    if labels is None:
        labels = dict.fromkeys((*OWNER_LABELS, *column_names(vocabulary(kept, "label"))))
    names = [f"{label}_{kind}" for label in labels for kind in TRADED]
    return widen(kept, [as_col(k) for k in keys], ["label", "is.traded"], names, "firmdemp", _only_value, rest=None)


def ownership_shares(firms: DataFrame, groups: Mapping[str, str] = OWNER_GROUPS) -> DataFrame:
    """Firm totals, the traded share, and each owner group's share of traded and of all firms.

    All groups are the sum of traded and local firms.
    """
    totals = firms.withColumn("tot_firms", as_col(f"{ALL_FIRMS}_traded") + as_col(f"{ALL_FIRMS}_local"))
    added = {"pct_traded": ratio(f"{ALL_FIRMS}_traded", "tot_firms")}
    for group, label in groups.items():
        traded, local = as_col(f"{label}_traded"), as_col(f"{label}_local")
        added[f"pct_{group}_traded"] = ratio(traded, f"{ALL_FIRMS}_traded")
        added[f"pct_{group}_all"] = ratio(traded + local, "tot_firms")
    return totals.withColumns(added)


def ownership_gap(firms: DataFrame, na_rm: bool = True) -> DataFrame:
    """Firms missing to reach the best peer, and to match the group's share of workers.

    ``share`` is ownership relative to the share of workers. A gap's
    ``_traded`` variant is its traded part. The traded gap itself is multiplied
    by the traded share as well, unlike the gap to the average.
    """
    owned = {
        "female": (F.col("pct_female_all"), as_col(FEMALE_WORKERS)),
        "hispanic_black": (F.col("pct_hispanic_all") + F.col("pct_black_all"), as_col(MINORITY_WORKERS)),
    }
    df = ownership_shares(firms).withColumns(
        {f"share_{g}": ratio(share, workers) for g, (share, workers) in owned.items()}
    )
    firms_total, traded = F.col("tot_firms"), F.col("pct_traded")
    rates = {g: (f"share_{g}", firms_total, na_rm, na_rm) for g in owned}
    rates["traded"] = ("pct_traded", firms_total, na_rm, na_rm)
    df = df.withColumn("_peers", peer_stats(df, rates))
    for g, (share, workers) in owned.items():
        to_peer = (F.col("_peers")[g]["best"] * workers - share) * firms_total
        to_parity = (workers - share) * firms_total
        df = df.withColumns(
            {
                f"gap_{g}_peer": to_peer,
                f"gap_{g}_peer_traded": to_peer * traded,
                f"gap_{g}_self": to_parity,
                f"gap_{g}_self_traded": to_parity * traded,
            }
        )
    peers = F.col("_peers")["traded"]
    return df.withColumns(
        {
            "gap_traded": (peers["best"] - traded) * firms_total * traded,
            "gap_traded_avg": (peers["average"] - traded) * firms_total,
        }
    ).drop("_peers")


def ownership_summary(owners: DataFrame, demographics: DataFrame, study: StudyConfig) -> DataFrame:
    """Ownership table of the compared areas, gaps and traded columns first."""
    areas = left_join(owners.filter(study.in_area()), demographics, study.code)
    gaps = ownership_gap(settle(clean_owners(areas), "owners"))
    return pick(
        gaps, study.code, "GEO_TTL", containing(gaps, "gap"), containing(gaps, "traded"), rest=True
    )


# ---- program shares --------------------------------------------------------


def award_shares(df: DataFrame) -> DataFrame:
    return shares(df, "amt_tot", {"pct_female": "amt_female", "pct_minority": "amt_minority"})


def export_shares(df: DataFrame) -> DataFrame:
    return shares(
        df, "amt_tot",
        {"pct_small": "amt_small", "pct_woman": "amt_woman", "pct_minority": "amt_minority"},
    )


# ---- lending per worker ----------------------------------------------------


def per_worker_aggregates(
    df: DataFrame, rate: Column, year_suffix: str, n_years: int
) -> list[Column]:
    """Mean rate weighted by each employment group, and each group's yearly size.

    Employment repeats once per lending year, hence the division by ``n_years``.
    """
    groups = [c for c in containing(df, year_suffix) if c.startswith("emp_")]
    means = {c.replace("emp_", "amt_per_").replace(year_suffix, ""): c for c in groups}
    sums = [sum_of(as_col(c).cast("double") / n_years).alias(f"{c}_sum") for c in groups]
    return weighted_means(rate, means) + sums


def zone_aggregates(rate: Column, workers: Column, zone: Column) -> list[Column]:
    """Amount and amount per worker inside and outside zones; missing where there is no tract."""
    amount = F.coalesce((rate * workers).cast("double"), F.lit(0.0))
    staff = F.coalesce(workers.cast("double"), F.lit(0.0))
    out = []
    for where, label in ((zone.isNotNull(), "in"), (zone.isNull(), "out")):
        out += [
            F.sum(F.when(where, amount)).alias(f"_amt_{label}"),
            F.sum(F.when(where, staff)).alias(f"_emp_{label}"),
        ]
    return out


def _zone_columns() -> dict[str, Column]:
    inside, outside = F.col("_amt_in"), F.col("_amt_out")
    return {
        "pct_amt_oz": ratio(inside, inside + outside),
        "amt_per_oz": ratio(inside, "_emp_in"),
        "amt_per_noz": ratio(outside, "_emp_out"),
    }


def zone_split(df: DataFrame, amount: str, keys: Sequence[str], emp_total: str = "emp_tot_17",
               zone: str = "stco_type") -> DataFrame:
    """Per area: share of the amount in zones, and amount per worker inside and outside."""
    workers = as_col(emp_total)
    sums = df.groupBy(*keys).agg(*zone_aggregates(ratio(amount, workers), workers, as_col(zone)))
    columns = _zone_columns()
    return sums.withColumns(columns).select(*keys, *columns)


def per_worker_summary(
    df: DataFrame,
    amount: str,
    study: StudyConfig,
    suffix: str,
    year_suffix: str = "_17",
    zone: str = "stco_type",
    na_rm: bool = True,
) -> DataFrame:
    """Lending per worker of each area: by employment group, by zone, and its peer gaps.

    One aggregate over the tracts serves both halves, so they need no join; the
    areas are settled before they are compared. Every number's name ends in ``suffix``.
    """
    return per_worker_summaries(df, {suffix: amount}, study, year_suffix, zone, na_rm)[suffix]


def per_worker_summaries(
    df: DataFrame,
    amounts: Mapping[str, str],
    study: StudyConfig,
    year_suffix: str = "_17",
    zone: str = "stco_type",
    na_rm: bool = True,
) -> dict[str, DataFrame]:
    """``per_worker_summary`` of several programs, ``{suffix: amount}``, from one aggregate over the tracts."""
    emp_total = f"emp_tot{year_suffix}"
    workers, total = as_col(emp_total), f"{emp_total}_sum"
    programs = []
    for suffix, amount in amounts.items():
        rate = ratio(amount, workers)
        numbers = [*per_worker_aggregates(df, rate, year_suffix, study.n_years), *zone_aggregates(rate, workers, as_col(zone))]
        names = df.groupBy(*study.keys).agg(*numbers).columns[len(study.keys):]
        programs.append((suffix, numbers, names))
    every = [n.alias(f"{name}{suffix}") for suffix, numbers, names in programs for n, name in zip(numbers, names)]
    areas = settle(df.groupBy(*study.keys).agg(*every), "per_worker")
    summaries = {}
    for suffix, _, names in programs:
        mine = areas.select(*study.keys, *[as_col(f"{n}{suffix}").alias(n) for n in names])
        out = compare_to_peers(mine, {"gap_amt_emp": ("amt_per_tot", total, na_rm, na_rm)})
        out = out.withColumns(_zone_columns()).drop("_amt_in", "_emp_in", "_amt_out", "_emp_out")
        summaries[suffix] = suffixed(out, numeric(out), suffix)
    return summaries


def per_worker_by_product(
    df: DataFrame,
    keys: Sequence[str],
    first: str = "amt_below100k",
    last: str = "amt_tot_CDFI",
    emp_total: str = "emp_tot_17",
    totals: Sequence[str] = ("amt_tot", "amt_tot_CDFI"),
) -> DataFrame:
    """Amount per worker by product in long form, with the product's category by its name."""
    products = containing(df, "amt_")
    sums = df.groupBy(*keys).agg(
        *[sum_of(c).alias(c) for c in products], sum_of(emp_total).alias("_workers")
    )
    rates = map_columns(sums, products, lambda c: ratio(c, "_workers"))
    chosen = between_columns(rates, first, last)
    name = F.col("program")
    category = (
        F.when(name.isin(list(totals)), "all")
        .when(name.rlike("0"), "FDIC")
        .when(name.rlike(r"\p{Upper}"), "CDFI")
        .otherwise("others")
    )
    return lengthen(rates.select(*keys, *chosen), chosen, "program", "amt_per_emp").withColumn(
        "category", category
    )


# ---- reports ---------------------------------------------------------------


def combine_summaries(
    attainment: DataFrame,
    owners: DataFrame,
    disclosure: DataFrame,
    lender: DataFrame,
    exports: DataFrame,
    awards: DataFrame,
    study: StudyConfig,
) -> DataFrame:
    """One row per compared area with all summaries side by side.

    Ownership columns get the suffix ``_SBO``; the lending tables arrive with
    theirs. Tables after the first lending one are joined on code and name.
    The result is settled, as both reports compare its rows.
    """
    firms = suffixed(owners, [c for c in owners.columns if c not in study.keys], "_SBO")
    joined = star_join(
        attainment,
        [
            (firms, [study.code]),
            (disclosure, [study.code]),
            (lender, study.keys),
            (exports, study.keys),
            (awards, study.keys),
        ],
    )
    return settle(joined.withColumnRenamed("emp_tot_17_sum_FDIC", "emp_tot"), "combined")


# Whether the (best, average) of a gap's rates skips missing ones, as the study's report has it.
REPORT_MODES = {
    "gap_allfirms_emp": (False, False),
    "gap_amt_traded_EXIM": (True, True),
    "gap_amt_traded_SSTR": (False, True),
}


def peer_gap_report(combined: DataFrame, na_rm: Mapping[str, tuple[bool, bool]] | None = None) -> DataFrame:
    """Gaps to the best and average peer in firms, export credit and awards.

    ``na_rm`` tells for each gap whether the best and the average skip areas
    whose rate is missing, as ``REPORT_MODES`` does; a gap that it does not name
    skips them. Without skipping one missing rate makes all gaps missing.
    """
    modes = na_rm or {}
    traded = f"{ALL_FIRMS}_traded_SBO"
    rates = combined.withColumns(
        {
            "pct_owner": ratio("tot_firms_SBO", "emp_tot"),
            "EXIM_per_traded": ratio("amt_tot_EXIM", traded),
            "SSTR_per_traded": ratio("amt_tot_SSTR", traded),
        }
    )
    out = compare_to_peers(
        rates,
        {
            name: (rate, weight, *modes.get(name, (True, True)))
            for name, rate, weight in (
                ("gap_allfirms_emp", "pct_owner", "emp_tot"),
                ("gap_amt_traded_EXIM", "EXIM_per_traded", traded),
                ("gap_amt_traded_SSTR", "SSTR_per_traded", traded),
            )
        },
    ).withColumn("tot_traded", as_col(traded))
    return pick(
        out, containing(out, "code"), containing(out, "name"), "emp_tot", containing(out, "gap"),
        "tot_firms_SBO", "tot_traded", containing(out, "amt_tot"),
    )


def demographic_gap_report(combined: DataFrame) -> DataFrame:
    """Gaps by race, gender and zone.

    Firms per educated resident and lending per worker are the first group
    minus the second. Export and award gaps are minority minus rest, and women
    minus men, per traded firm.
    """
    rates = combined.withColumns(
        {
            f"rate_hsplus_all_{g}": ratio(F.col("tot_firms_SBO") * F.col(f"pct_{g}_all_SBO"), f"hsplus_{g}")
            for g in ("black", "white")
        }
        | {
            f"rate_baplus_traded_{g}": ratio(f"{OWNER_GROUPS[g]}_traded_SBO", f"baplus_{g}")
            for g in ("black", "white")
        }
    )

    def per_firm(program: str, part: str, group: str, others: str) -> Column:
        amount, total = F.col(f"amt_{part}_{program}"), F.col(f"amt_tot_{program}")
        return ratio(amount, f"{group}_traded_SBO") - ratio(total - amount, f"{others}_traded_SBO")

    gaps = {
        "gap_hsplus_all_white_black": (F.col("rate_hsplus_all_white") - F.col("rate_hsplus_all_black"))
        * F.col("hsplus_black"),
        "gap_baplus_traded_white_black": (F.col("rate_baplus_traded_white") - F.col("rate_baplus_traded_black"))
        * F.col("baplus_black"),
    }
    for program in ("FDIC", "CDFI"):
        for name, more, less in (("white_black", "white", "black"), ("male_female", "male", "female"),
                                 ("oz", "noz", "oz")):
            gaps[f"gap_{program}_{name}"] = F.col(f"amt_per_{more}_{program}") - F.col(f"amt_per_{less}_{program}")
    for program, women in (("EXIM", "woman"), ("SSTR", "female")):
        gaps[f"gap_{program}_white_nonwhite"] = per_firm(program, "minority", "Minority", "Nonminority")
        gaps[f"gap_{program}_male_female"] = per_firm(program, women, "Female-owned", "Male-owned")
    out = rates.withColumns(gaps)
    return pick(out, containing(out, "code"), containing(out, "name"), containing(out, "gap"))
