"""Column references by name.

``F.col("a.b")`` reads a dot as struct-field access; data columns can be
named with dots (``a.1`` after de-duplicating CSV headers), so columns named
by the user are always referenced quoted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qcol(name: str) -> Column:
    """The top-level column called exactly ``name``."""
    return F.col("`" + name.replace("`", "``") + "`")
