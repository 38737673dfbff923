"""Helper of the tests; not in conftest.py, a name that the folder below takes as well."""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
