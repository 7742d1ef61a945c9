"""Display form of facet names and values."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_text(value: Column) -> Column:
    """Underscores become spaces; first letter upper case, the rest lower case."""
    spaced = F.replace(value, F.lit("_"), F.lit(" "))
    return F.concat(
        F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, 2, 2**31 - 1))
    )


def display_values(values: Column) -> Column:
    return F.transform(values, display_text)
