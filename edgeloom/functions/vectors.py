"""Column functions over feature vectors and scores."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.functions.identifiers import _col


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def sigmoid(logit) -> Column:
    clipped = F.greatest(F.least(_col(logit), F.lit(K.LOGIT_CLIP)), F.lit(-K.LOGIT_CLIP))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def pair_encoding(a, b) -> Column:
    """Both vectors followed by their absolute difference."""
    a, b = _col(a), _col(b)
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def bce_with_logits(label, logit) -> Column:
    z, y = _col(logit), _col(label).cast("double")
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * y


def round_metric(value) -> Column:
    return F.round(_col(value), 6)
