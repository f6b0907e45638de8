"""What several test files share (a plain module, so that no conftest is ever imported by name)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


def rows(df, *cols):
    """Collected rows as tuples (optionally a column subset), in order."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
