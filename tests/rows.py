"""Rows of a DataFrame in a fixed order, for comparing."""


def rows_of(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
