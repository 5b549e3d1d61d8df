def rows(df, *columns):
    """Rows as a sorted list of tuples, missing values last."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is None, str(v)) for v in r])


def plan_of(df):
    return df._jdf.queryExecution().toString()
