import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tests.llm import cases
from casegate.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        found.append(nodes)
    return found


def path(tree, pos):
    found = []
    for nodes in tree[:-1]:
        first = pos - pos % 3
        found.append((nodes[first:pos], nodes[pos + 1 : first + 3]))
        pos //= 3
    return found


def brute(rows):
    """The contract in plain Python: rows are (doc_id, source, lang, n_chars, text)."""
    groups, out = {}, []
    for doc_id, source, lang, n_chars, text in rows:
        lost = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        found = leaf(doc_id, source, lang, n_chars, text.replace("\n", "") if lost else text)
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), found, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(groups[s], key=lambda x: x[:4])]) for s in names]
    top = levels([t[-1][0] for t in trees])
    for k, s in enumerate(names):
        for i, (*_, own, found, doc_id) in enumerate(sorted(groups[s], key=lambda x: x[:4])):
            proof = path(trees[k], i) + path(top, k)
            folded = found
            for before, after in proof:
                folded = digest(*before, folded, *after)
            siblings = digest(*[x for before, after in proof for x in before + after])
            out.append((doc_id, own, trees[k][-1][0], top[-1][0], siblings, folded, folded == top[-1][0]))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def manifest(docs):
    lost = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(docs, F.when(lost, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def compared(spark, rows):
    docs = cases.documents(spark, rows)
    plain = [(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    assert in_order(manifest(docs).collect()) == in_order(brute(plain))


def test_awkward_rows(spark):
    compared(spark, cases.rows() + [(20, "a\nb", "en", "é", 3, *cases.rows()[0][5:]), (30, "\n", "en", "Z", 1, *cases.rows()[0][5:])])


def test_one_row(spark):
    compared(spark, cases.rows()[:1])


def test_trees_of_several_blocks_and_many_sources(spark):
    rng = random.Random(2)
    sources = ["hot"] * 5000 + [f"s{i}" for i in range(90) for _ in range(rng.randint(1, 30))] + [None] * 40
    extra = cases.rows()[0][5:]
    rows = [(i if rng.random() > 0.02 else None, f"text {i % 700}\nend", "en", s, i % 700, *extra) for i, s in enumerate(sources)]
    compared(spark, rows)


def test_without_other_texts_every_proof_holds(spark):
    rows = merkle.manifest(cases.documents(spark)).collect()
    assert len(rows) == len(cases.rows()) and all(r["verified"] for r in rows)


def test_no_rows(spark):
    assert manifest(cases.empty(spark)).count() == 0
