"""Fixtures that several tests share."""

from __future__ import annotations

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()


def text(seed: int, n: int) -> str:
    x, out = seed * 2654435761 % 2**32, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x >> 16 & 15] + WORDS[x >> 8 & 15][:3])
    return " ".join(out)


#: Columns that clash with names that operators use within or return.
CLASH = "size long, target double, kept boolean, shard string, score double, ids string, blob string, id long, label int, component_id long, findings string, rate double, __n double, __rate double, __copy long, __at string, __blob string, __findings string, __id long, __key long, c0 long, n long, copy long, dropped long"


def documents(spark, rows, clash: bool = True):
    """(doc_id, text, lang, source, n_chars) rows, with further columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = tuple(EXTRA.get(c.split()[1], None) for c in CLASH.split(",")) if clash else ()
    return spark.createDataFrame([tuple(r) + extra for r in rows], schema + (", " + CLASH if clash else ""))


#: Values of the further columns, by type: operators must leave them as they are.
EXTRA = {"double": 7.0, "long": 70, "string": "seven"}


def untouched(df) -> bool:
    """Whether the further columns hold what `documents` put there."""
    return all(r[n] == EXTRA[kind] for r in df.collect() for n, kind in (c.split() for c in CLASH.split(",")) if kind in EXTRA)


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    long = text(99, 30_000)
    return [
        (0, text(1, 60), "en", "a", 1),
        (1, text(1, 60), "en", "a", 1),
        (2, None, "en", "b", None),
        (3, "", None, "b", 0),
        (4, "   \n\t ", "de", None, 5),
        (5, long, "de", "a", len(long)),
        (None, text(1, 60), "en", None, 1),
        (None, None, None, None, None),
        (6, "one", "en", "c", 3),
        (6, "one", "en", "c", 3),
        (7, "two words", "en", "c", 9),
        (7, "other text of the same id", "fr", "c", 2),
        (8, text(2, 40) + " 日本語 😀 it's 'quoted' don't\r\n", "ja", "c", 4),
    ]


def union_find(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]
