"""Plain functions that several test files use; not in ``conftest``, of which there is one per folder."""


def rows(df, *order):
    """All rows as plain tuples in a fixed order."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
