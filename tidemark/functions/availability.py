"""Terms of availability and their classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabulary's terms by class.
CLASSES = {
    "AVAILABLE": ("InStock", "InStoreOnly", "OnlineOnly", "LimitedAvailability"),
    "ORDERABLE": ("BackOrder", "PreOrder", "PreSale", "MadeToOrder"),
    "UNAVAILABLE": ("OutOfStock", "SoldOut", "Discontinued", "Reserved"),
}


def term(x) -> Column:
    """The last part of a URL or name, without spaces, underscores and hyphens; case is ignored."""
    c = x if isinstance(x, Column) else F.col(x)
    return F.lower(F.regexp_replace(F.regexp_extract(F.btrim(c), r"([^/#:]*)$", 1), r"[\s_-]", ""))


def availability_class(x) -> Column:
    t, out = term(x), F.lit("UNKNOWN")
    for name, terms in CLASSES.items():
        out = F.when(t.isin(*[s.lower() for s in terms]), name).otherwise(out)
    return out
