"""Comparison of a Spark result with rows of another engine."""

from __future__ import annotations

import math

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(con, sql, columns):
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def assert_matches(df, con, sql):
    columns = sorted(df.columns)
    ours, theirs = rows_of(df, columns), duck_rows(con, sql, columns)
    assert len(ours) == len(theirs)
    assert ours == theirs


def choose_levels(series: list[dict], most: int) -> dict[int, int]:
    """Level of each manifest: start finest, and while all bins exceed `most`, coarsen the manifest that saves most.

    series: dicts of manifest_id, level, bins for one query, a few rows for each manifest that it overlaps. The
    first manifest wins ties; if nothing can be coarsened, the finest possible choice stands.
    """
    bins = {(s["manifest_id"], s["level"]): s["bins"] for s in series}
    chosen = {m: min(lv for k, lv in bins if k == m) for m in sorted({s["manifest_id"] for s in series})}
    while sum(bins[m, lv] for m, lv in chosen.items()) > most:
        savings = [(bins[m, lv] - bins[m, lv + 1], -m) for m, lv in chosen.items() if (m, lv + 1) in bins]
        if not savings or max(savings)[0] <= 0:
            break
        m = -max(savings)[1]
        chosen[m] += 1
    return chosen
