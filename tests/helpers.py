"""Comparing a query's rows with those of its SQL, whatever their order."""

import math


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def same_rows(df, con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall())
    assert ours == theirs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
