"""The manifest against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recollect.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    """(leaf, subroot, root, siblings) of every row, sorted."""
    leaves = sorted(((r[2] or "", r[2] is not None, r[0] is not None, r[0] or 0, digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))) for r in rows), key=lambda x: (x[1], x[0].encode(), x[2:]))
    parts = {}
    for lang, has, _, _, leaf in leaves:
        parts.setdefault((has, lang.encode()), []).append(leaf)

    def tree(nodes):
        paths = [[] for _ in nodes]
        own = list(range(len(nodes)))
        while len(nodes) > 1:
            for path, k in zip(paths, own, strict=True):
                if k ^ 1 < len(nodes):
                    path.append(nodes[k ^ 1])
            nodes = [digest("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
            own = [k // 2 for k in own]
        return nodes[0], paths

    subs = {part: tree(nodes) for part, nodes in sorted(parts.items())}
    if not subs:
        return []
    root, tops = tree([peak for peak, _ in subs.values()])
    return sorted((leaf, peak, root, "".join(path + top)) for (part, (peak, paths)), top in zip(subs.items(), tops, strict=True) for leaf, path in zip(parts[part], paths, strict=True))


@pytest.mark.parametrize("block,top,n,langs", [(1024, 1 << 14, 300, 3), (2, 4, 333, 4), (4, 3, 150, 40), (8, 2, 65, 2), (4, 8, 1, 1), (2, 2, 16, 16)])
def test_against_plain_python(spark, block, top, n, langs):
    r = random.Random(n)
    rows = [(r.choice([None, *range(-50, 200)]), r.choice([None, "", "web"]), r.choice([None, *(f"l{k}é" for k in range(langs))]), r.choice([None, 3]), r.choice([None, "", "ein Wort", "x" * 5000])) for _ in range(n)]
    rows += rows[: n // 3]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = merkle.manifest(df, merkle.leaf_digest(*map(F.col, FIELDS)), block=block, top=top)
    found = found.withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("others", merkle.siblings(F.col("path"))).collect()
    assert sorted((x["leaf"], x["peak"], x["root"], x["others"]) for x in found) == plain(rows)
    assert all(x["again"] == x["root"] for x in found)


def test_a_changed_row_does_not_fold_to_the_root(spark):
    rows = [(k, "s", "en", k, f"text {k}") for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("other", merkle.leaf_digest(F.lit("x")))
    found = merkle.manifest(df, merkle.leaf_digest(*map(F.col, FIELDS)), carry=["doc_id", "other"], block=4)
    assert found.where(merkle.folded(F.col("other"), F.col("path")) == F.col("root")).count() == 0


def test_empty_tables_and_clashes(spark):
    leaf = merkle.leaf_digest(*map(F.col, FIELDS))
    empty = merkle.manifest(spark.createDataFrame([], SCHEMA), leaf)
    assert empty.collect() == [] and empty.columns == ["doc_id", "part", "place", "leaf", "peak", "root", "path"]
    for name in merkle.RESULTS:
        with pytest.raises(ValueError, match=name):
            merkle.manifest(spark.createDataFrame([], f"{SCHEMA}, {name} long"), leaf, carry=["doc_id", name])
    odd = spark.createDataFrame([(1, "s", "en", 2, "t", "a", 7, 8)], SCHEMA + ", _part string, _n long, block long")
    assert [tuple(x)[:4] for x in merkle.manifest(odd, leaf, carry=["doc_id", "_part", "_n", "block"]).collect()] == [(1, "a", 7, 8)]
