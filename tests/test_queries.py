"""Every registered query of the library gives the rows of its SQL."""

import pytest

from weft.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    names, rows = duck(FOLDER, registry.oracle_sql()[name])
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() >= 0
