"""Column functions that grade the evidence for a pair."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.functions.identifiers import _col, method_ids


def dominant_channel(*, prefix: str = "") -> Column:
    """Label of the largest channel; equal values go to the last channel name, all <= 0 gives ''."""
    best = F.greatest(*[
        F.struct(F.coalesce(F.col(prefix + c), F.lit(0.0)).alias("v"), F.lit(c).alias("c")) for c in K.CHANNELS
    ])
    label = F.lit("")
    for channel, text in K.CHANNEL_LABELS.items():
        label = F.when(best["c"] == channel, F.lit(text)).otherwise(label)
    return F.when(best["v"] <= 0.0, F.lit("")).otherwise(label)


def location_buckets(location, component) -> Column:
    """Coarse location buckets named in the two texts, sorted by name."""
    blob = F.lower(F.concat(F.coalesce(_col(location), F.lit("")), F.lit(" "),
                            F.coalesce(_col(component), F.lit(""))))
    marks = []
    for bucket in sorted(K.LOCATION_KEYWORDS):
        hit = F.lit(False)
        for word in K.LOCATION_KEYWORDS[bucket]:
            hit = hit | blob.contains(word)
        marks.append(F.when(hit, F.lit(bucket)))
    return F.array_compact(F.array(*marks))


def location_overlap(a, b) -> Column:
    """compatible / conflicting / unclear; only lone exclusive buckets can conflict."""
    a, b = _col(a), _col(b)

    def lone(x):
        return (F.size(x) == 1) & F.get(x, F.lit(0)).isin(*K.EXCLUSIVE_LOCATIONS)

    return (F.when((F.coalesce(F.size(a), F.lit(0)) == 0) | (F.coalesce(F.size(b), F.lit(0)) == 0), F.lit("unclear"))
            .when(F.arrays_overlap(a, b), F.lit("compatible"))
            .when(lone(a) & lone(b), F.lit("conflicting"))
            .otherwise(F.lit("unclear")))


def evidence_class(physical, combined, dominant, overlap, degree_product, cutoff) -> Column:
    """Exclusive class: physical, then risk of artefact, then functional, then unreported."""
    physical, combined, dominant = _col(physical), _col(combined), _col(dominant)
    functional = combined >= K.CONTEXT_SCORE
    risk = ((_col(overlap) == "conflicting")
            | (functional & (dominant == "textmining"))
            | (_col(degree_product).cast("double") >= _col(cutoff)))
    return (F.when(physical, F.lit(K.CLASS_PHYSICAL))
            .when(risk, F.lit(K.CLASS_ARTIFACT))
            .when(functional, F.lit(K.CLASS_FUNCTIONAL))
            .otherwise(F.lit(K.CLASS_UNREPORTED)))


def is_tier1(assays, methods, interaction_types) -> Column:
    """A direct assay name, or a direct method id in the method or type texts."""
    names = F.array(*[F.lit(x) for x in K.TIER1_ASSAYS])
    ids = F.array(*[F.lit(x) for x in K.TIER1_METHODS])
    blob = F.concat(F.array_join(_col(methods), " "), F.lit(" "), F.array_join(_col(interaction_types), " "))
    return (F.coalesce(F.arrays_overlap(F.transform(_col(assays), lambda x: F.trim(x)), names), F.lit(False))
            | F.coalesce(F.arrays_overlap(method_ids(blob), ids), F.lit(False)))


def gate(n_absent, frac_physical, frac_unreported, spearman) -> tuple[Column, Column]:
    """Decision and reason whether the benchmark is worth running."""
    n_absent, frac_physical = _col(n_absent), _col(frac_physical)
    rho = F.coalesce(F.abs(F.nanvl(_col(spearman), F.lit(None).cast("double"))), F.lit(0.0))
    none, covered = n_absent == 0, frac_physical >= K.GATE_PHYSICAL_STOP
    run = ~(none | covered)
    reason = (F.when(none, F.lit("no absent candidate pairs"))
              .when(covered, F.lit("absent pairs are already curated: publish a missingness resource"))
              .when(_col(frac_unreported) >= K.GATE_UNREPORTED_RUN, F.lit("a large unreported set remains"))
              .when(rho >= K.GATE_SPEARMAN_RUN, F.lit("model scores follow the degree product"))
              .otherwise(F.lit("sources disagree")))
    return run, reason
