"""Helpers that test modules import by name; fixtures stay in conftest."""


def rows(df, *columns):
    """Rows of ``columns`` as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
