"""Arrow functions that are declared at import, when no session exists yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf(ddl)``, but the type is parsed when the function is used."""

    def declare(f: Callable) -> Callable[..., Column]:
        def use(*columns) -> Column:
            return F.pandas_udf(f, ddl)(*columns)

        use.__doc__, use.__name__ = f.__doc__, f.__name__
        return use

    return declare
