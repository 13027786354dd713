"""Awkward documents: nulls, empty and long texts, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, h long, component_id long"


def rows():
    base = "the quick brown fox jumps over the lazy dog near the old river bank today"
    long = " ".join(f"w{i % 977} x{i * 7 % 1013}" for i in range(12000))
    texts = [
        base, base, base.upper(), base + " again", "", None, " \t\n", "a", "a b", long, long + " end", "line one is here\nline two is here\n" + base, "line one is here\nother text goes there",
        "Licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License, version 3.", "cc by cc by cc by", "mail a.b@x.com or 4111 1111 1111 1111 or +1 (555) 123-4567 at 10.1.2.300 and 10.1.2.30",
        "=" * 3000, "é ü ñ ñandú über straße", "x\x00y z", "@@@ a@b.c.@d.e._q@z.zz 1.2.3.4.5.6.7.8 + +1", "general public license " * 40, "z " * 500,
    ]
    out = [(i, t, "en" if i % 2 else None, ["s1", "s2", None][i % 3], None, 5, 9, 1, 3) for i, t in enumerate(texts)]
    out += [out[3], out[0], (None, base, None, None, 1, 1, 1, 1, 1), (None, "lonely words of a row without id", "en", "s1", 1, 1, 1, 1, 1), (None, base, None, None, 1, 1, 1, 1, 1)]
    return out


def make(spark, given=None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA).repartition(3)


def save(spark, at, given=None):
    make(spark, given).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    return str(at)
