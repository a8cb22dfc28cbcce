import random
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.conftest import ODD
from tessella.llm import merkle, queries


def H(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text))


def climb(nodes, at):
    """The root of nodes, and of one of them its siblings."""
    steps = []
    while len(nodes) > 1:
        first = at // 16 * 16
        steps.append((nodes[first:at], nodes[at + 1 : first + 16]))
        nodes = [H(nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], steps


def plain(rows, now):
    trees = defaultdict(list)
    for r in rows:
        trees[r.source].append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    leaves = {s: [leaf(r, r.text) for r in v] for s, v in trees.items()}
    subroots = [climb(leaves[s], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(trees[s]):
            root, above = climb(subroots, k)
            steps = climb(leaves[s], at)[1] + above
            node = leaf(r, now(r))
            for left, right in steps:
                node = H([*left, node, *right])
            out.append((r.doc_id, r.source, leaves[s][at], subroots[k], root, H(d for a, b in steps for d in a + b), node, node == root))
    return out


def lowered(r):
    return r.text if r.text is None or r.doc_id is None or r.doc_id % 3 else r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def found():
    return F.when(F.col("doc_id") % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = queries.op11_merkle(spark, SF)
    want = con.sql(queries.oracle_sql()["op11_merkle"])
    assert Counter(map(tuple, out.select(*want.columns).collect())) == Counter(want.fetchall())
    assert 0 < out.where("NOT verified").count() < out.count() / 2


@pytest.mark.parametrize("block,top", [(4096, 1 << 14), (16, 1000), (16, 3), (256, 5)])
def test_blocks_and_rounds_change_nothing(spark, make_docs, block, top):
    """A large source, some that fill blocks exactly, many of a row: the top tree from the driver, or by more rounds of blocks."""
    rng = random.Random(7)
    rows = [(rng.randrange(5000), f"Text {rng.random()} É", "en", "big") for _ in range(600)]
    rows += [(i, "T", None, f"s{k}") for k, n in enumerate((1, 15, 16, 17, 256, 257)) for i in range(n)]
    rows += [(i, None, "de", f"lone{i}") for i in range(40)]
    rows += [(*r[:2], "en", s) for r in ODD for s in (None, "", "Z", "é")]
    docs = make_docs(rows)
    got = merkle.manifest(docs, found(), block=block, top=top).collect()
    assert Counter(map(tuple, got)) == Counter(plain(docs.collect(), lowered))


def test_one_row_and_none(spark, make_docs):
    docs = make_docs([(3, "ABC")])
    (row,) = merkle.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == H([]) and row.verified
    (row,) = merkle.manifest(docs, found()).collect()
    assert row.folded_root != row.root and not row.verified
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_proofs_fold_to_the_root(spark, make_docs):
    docs = make_docs([(i, f"t{i}", "en", f"s{i % 3}") for i in range(100)])
    for r in merkle.manifest(docs, proofs=True, block=16, top=4).collect():
        steps = [(p.left, p.right) for p in r.proof]
        assert merkle.fold(r.leaf, steps) == r.root
        assert H(d for a, b in steps for d in [*a, *b]) == r.proof_sha256


def test_a_changed_row_changes_the_root(spark, make_docs):
    rows = [(i, f"t{i}", "en", f"s{i % 3}") for i in range(60)]
    roots = {merkle.manifest(make_docs(r)).first().root for r in (rows, rows[::-1], [*rows[:-1], (59, "t59 ", "en", "s2")], rows[:-1])}
    assert len(roots) == 3
