"""Column functions on inline rows."""
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import evidence as E
from edgeloom.functions import identifiers as I
from edgeloom.functions import vectors as V


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("r")).first().r


def test_accessions(spark):
    assert set(one(spark, I.accessions("t"), t="uniprotkb:P46937|uniprotkb:Q9H0")) == {"P46937"}
    assert set(one(spark, I.accessions("t"), t="P46937|P60709")) == {"P46937", "P60709"}
    assert one(spark, I.accessions("t"), t="-") == []
    assert one(spark, I.accessions("t"), t="uniprotkb:P46937-2") == ["P46937"]
    assert one(spark, I.accessions("t"), t="UNIPROTKB:P46937_x") == ["P46937"]


def test_publication_and_method_ids(spark):
    assert set(one(spark, I.publication_ids("t"), t="pubmed:4444|imex:IM-15364-1")) == {"4444", "15364"}
    assert one(spark, I.publication_ids("t"), t="NA") == []
    assert one(spark, I.method_ids("t"), t='psi-mi:"MI:0018"(x) MI:0407') == ["MI:0018", "MI:0407"]
    assert one(spark, I.digits_sorted(F.array(F.lit("900"), F.lit("1000")))) == ["900", "1000"]
    assert one(spark, I.digits_sorted(F.array(F.lit("b9"), F.lit("1000")))) == ["1000", "b9"]


@pytest.mark.parametrize("text, want", [("taxid:9606(human)", 9606), ("4932", 4932), (" 7 ", 7), ("-", None), ("x", None)])
def test_taxon(spark, text, want):
    assert one(spark, I.taxon("t"), t=text) == want


@pytest.mark.parametrize("raw, want", [(0.9, 0.9), (900.0, 0.9), (1.0, 1.0), (0.0, 0.0)])
def test_normalize_score(spark, raw, want):
    assert one(spark, I.normalize_score("x"), x=raw) == want


def test_alias_and_names(spark):
    assert one(spark, I.canonical_taxon("x"), x=559292) == 4932
    assert one(spark, I.short_group_name("x"), x="Homo sapiens") == "H. sapiens"


def test_headers_resolve_together():
    wanted = {"id": ("Interaction ID",), "through": ("Pace", "throughput"), "more": ("Remark",)}
    cells = ["#Interaction ID", " Throughput ", "x"]
    assert I.resolve_headers(cells, wanted, optional=("more",)) == {"id": 0, "through": 1, "more": None}
    with pytest.raises(KeyError, match="more.*Remark"):
        I.resolve_headers(cells, wanted)
    with pytest.raises(KeyError, match="id.*more.*through"):
        I.resolve_headers(["x"], wanted)


def channel(spark, **values):
    names = ("nscore", "fscore", "pscore", "ascore", "escore", "dscore", "tscore")
    return one(spark, E.dominant_channel(), **{n: values.get(n, 0.0) for n in names})


def test_dominant_channel(spark):
    assert channel(spark, nscore=0.1, escore=0.6, tscore=0.2) == "experiments"
    assert channel(spark) == ""
    assert channel(spark, nscore=0.5, tscore=0.5) == "textmining"      # equal values: last channel name
    assert channel(spark, ascore=0.5, dscore=0.5) == "databases"


def overlap(spark, a, b):
    arr = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    return one(spark, E.location_overlap(arr(a), arr(b)))


def test_location_overlap(spark):
    assert overlap(spark, ["cytoplasm"], ["cytoplasm", "nucleus"]) == "compatible"
    assert overlap(spark, ["nucleus"], ["extracellular"]) == "conflicting"
    assert overlap(spark, ["nucleus"], ["mitochondrion"]) == "conflicting"
    assert overlap(spark, ["nucleus"], ["cytoskeleton"]) == "unclear"
    assert overlap(spark, ["nucleus", "cortex"], ["extracellular"]) == "unclear"
    assert overlap(spark, [], ["nucleus"]) == "unclear"


def test_location_buckets(spark):
    got = one(spark, E.location_buckets("l", "g"), l="SUBCELLULAR LOCATION: Nucleus. Cytoplasm.", g="C:cytoskeleton")
    assert got == ["cytoplasm", "cytoskeleton", "nucleus"]


@pytest.mark.parametrize("physical, combined, dominant, where, product, want", [
    (True, 0.2, "textmining", "conflicting", 10_000, "physical_curated"),
    (False, 0.8, "experiments", "compatible", 10, "string_functional_only"),
    (False, 0.2, "", "unclear", 10, "unreported"),
    (False, 0.8, "textmining", "compatible", 10, "artifact_risk"),
    (False, 0.1, "", "conflicting", 10, "artifact_risk"),
    (False, 0.1, "", "unclear", 100, "artifact_risk"),                 # the cut-off itself counts
])
def test_class_order(spark, physical, combined, dominant, where, product, want):
    got = E.evidence_class(F.lit(physical), F.lit(combined), F.lit(dominant), F.lit(where), F.lit(product), F.lit(100.0))
    assert one(spark, got) == want


@pytest.mark.parametrize("n, phys, unrep, rho, run, word", [
    (0, 0.0, 0.0, None, False, "no absent"), (156, 0.95, 0.02, 0.1, False, "resource"), (156, 0.2, 0.5, 0.05, True, "unreported"),
    (156, 0.2, 0.05, 0.6, True, "degree"), (156, 0.2, 0.05, -0.6, True, "degree"), (156, 0.2, 0.05, float("nan"), True, "disagree"),
])
def test_gate(spark, n, phys, unrep, rho, run, word):
    go, reason = E.gate(F.lit(n), F.lit(phys), F.lit(unrep), F.lit(rho).cast("double"))
    assert one(spark, go) is run
    assert word in one(spark, reason)


def test_tier1(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    assert one(spark, E.is_tier1(arr(" Two-hybrid "), arr(), arr()))
    assert one(spark, E.is_tier1(arr(), arr(), arr('psi-mi:"MI:0407"(x)')))
    assert not one(spark, E.is_tier1(arr("Affinity Capture-MS"), arr("MI:0006"), arr()))


def test_vectors(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])                # noqa: E731
    assert one(spark, V.pair_encoding(arr(1, 5), arr(3, 2))) == [1, 5, 3, 2, 2, 3]
    assert one(spark, V.sigmoid(F.lit(99.0))) == pytest.approx(1 / (1 + 2.718281828459045 ** -30))
    assert one(spark, V.bce_with_logits(F.lit(1), F.lit(0.0))) == pytest.approx(0.693147, abs=1e-6)
