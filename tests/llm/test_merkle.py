"""The manifest against a plain recursive tree in hashlib."""

import hashlib
import random
import zlib

import pytest

from textloom.llm import merkle

from .helpers import documents


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root and each leaf's (left, right) siblings, level by level."""
    proofs, level, of = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(of):
            run = at // 3 * 3
            proofs[k].append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        of = [at // 3 for at in of]
    return level[0], proofs


def plain(rows: list[tuple]) -> list[tuple]:
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, text: h(*map(field, (*r[:4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[n], key=lambda x: x[:3])]) for n in names]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for name, (subroot, proofs), top in zip(names, trees, tops, strict=True):
        for (_, _, own, r), proof in zip(sorted(groups[name], key=lambda x: x[:3]), proofs, strict=True):
            seen = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                seen = leaf(r, r[4].replace("\n", ""))
            for left, right in proof + top:
                seen = h(left, seen, right)
            out.append((r[0], own, subroot, root, h(*(x for step in proof + top for x in step)), seen, seen == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _at int, _keep0 string, leaf string"


def held(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = merkle.tamper_check(table).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_awkward_rows_sources_and_ids(spark):
    rng = random.Random(1)
    sources = [None, "", "a", "é", "z", "😀", "￿", "a b"]
    rows = [(rng.randrange(10**9), rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice([None, "", "one\ntwo", "é\n\n", "x" * 50_000])) for _ in range(60)]
    rows += [(7, "a", None, None, "tie\n"), (7, "a", None, None, "tie\n"), (7, "a", None, None, "tie"), (None, "a", None, 1, "n\n"), (None, None, None, None, None)]
    held(spark, rows)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, count):
    held(spark, [(k, "s", "en", 1, f"t{k}\n") for k in range(count)])


def test_every_shape_of_the_exchange(spark, monkeypatch):
    """Blocks of three leaves: groups of 1 to 31 blocks, full and ragged, go through up to four rounds."""
    from pyspark.sql import functions as F

    from textloom.llm.shared import Scope

    rows = [(n, k, h(f"{n}:{k}")) for n in [*range(1, 32), 40, 55, 81, 82, 83, 92] for k in range(n)]
    with Scope(spark) as scope:
        table = spark.createDataFrame(rows, "n long, k long, d string")
        blocks, uppers = merkle.trees(scope, table, "n", ["k"], "d", ["k"], levels=1)
        got = blocks.join(uppers, ["_group", "_block"]).select("_group", "_node", "_upper", F.explode("_leaves").alias("x"))
        got = {(r[0], r.x.k): (r[1], [tuple(s) for s in [*r.x._proof, *r[2]]]) for r in got.collect()}
    assert len(got) == len(rows)
    for n in {r[0] for r in rows}:
        root, proofs = plain_tree([h(f"{n}:{k}") for k in range(n)])
        assert [got[n, k] for k in range(n)] == [(root, p) for p in proofs]


def test_empty_table(spark):
    assert merkle.tamper_check(documents(spark).limit(0)).collect() == []


def test_hot_source_over_many_blocks(spark):
    held(spark, [(k * 3, "hot" if k % 3 else f"s{k % 11}", "en", k, f"line {k}\nend") for k in range(4000)])


def test_other_fields_change_the_leaf(spark):
    rows = [(1, "a", "en", 2, "x"), (1, "a", "e", 2, "x"), (1, "a", None, 2, "x"), (1, "a", "", 2, "x")]
    got = {r.leaf for r in merkle.tamper_check(spark.createDataFrame([(*r, 1, "", "") for r in rows], SCHEMA)).collect()}
    assert len(got) == 4
