"""Small tables with the awkward rows that every operator has to take."""

import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as columns of the input they must do no harm.
CLASHES = ("bucket", "key", "rep", "kept", "score", "h", "n", "value", "taken_id", "class_id")

BASE = (
    "The quick brown fox jumps over the lazy dog near the river bank. It was a bright cold day in April, "
    "and the clocks were striking thirteen.\nAll happy families are alike; each unhappy family is unhappy in its own way."
)


def awkward_rows():
    return [
        (1, BASE, "en", "src1", 10),
        (2, BASE, "en", "src2", 10),
        (3, BASE + " One more short tail.", "en", "src12", 10),
        (4, None, "en", None, None),
        (5, "", None, "src3", 0),
        (6, "word", "fr", "src19", 4),
        (7, "élan vital " * 3000, "fr", "src4", 33000),
        (8, "日本語 テキスト 😀\r\n\ttab", "de", "noname", 12),
        (9, "a" * 700, "es", "src5", 700),
        (9, "a" * 700, "es", "src5", 700),
        (None, "a row without an id", "en", "src6", 19),
        (10, "a row without an id", "en", "src6", 19),
        (11, "line one\nline one\nline one\n\n", "en", "src7", 28),
    ]


def documents(spark, rows=None, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows() if rows is None else rows, DOCUMENTS)
    return df.withColumns({c: F.lit(f"not {c}") for c in CLASHES}) if clash else df


def shingles(text, k=5):
    words = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_groups(rows, threshold=0.8):
    """{position: (smallest id of its group, links)} by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    label, links = list(range(n)), [0] * n

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return {i: (least[root(i)], links[i]) for i in range(n)}


def duck_rows(sql, **views):
    """Rows of a DuckDB query over pandas frames, sorted, by column name."""
    import duckdb

    con = duckdb.connect()
    for name, frame in views.items():
        con.register(name, frame)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
