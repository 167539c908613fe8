"""The summariser by centrality against a dense version."""

import random

import numpy as np

from engramlake import session
from engramlake.operators import central as C
from engramlake.operators.ingest import DocumentStore


def dense(found):
    bags = [set(C._WORD.findall(s.lower())) for s in found]
    n = len(bags)
    links = np.array([[0.0 if i == j else len(a & b) / np.sqrt(len(a) * len(b)) for j, b in enumerate(bags)] for i, a in enumerate(bags)]).reshape(n, n)
    degree = links.sum(axis=1)
    walk = np.array([links[i] / degree[i] if degree[i] > 0 else np.full(n, 1 / n) for i in range(n)]).reshape(n, n)
    x = np.full(n, 1 / n)
    for _ in range(400):
        x = (1 - C.DAMPING) / n + C.DAMPING * walk.T @ x
    return x


def test_centrality_equals_the_dense_walk():
    r = random.Random(2)
    for n in (1, 2, 5, 40):
        found = [" ".join(r.choice("a b c d e f g h i j unique".split()) for _ in range(r.randrange(1, 9))) + (f" only{i}" if r.random() < 0.2 else "") for i in range(n)] + ["alone here"]
        got = C.centrality(found)
        assert np.allclose(got, dense(found), atol=1e-6) and abs(got.sum() - 1) < 1e-6
    assert len(C.centrality([])) == 0


def test_overviews():
    text = "# Head\nThe cat sat on the mat. The cat ate. A dog ran!\n\nThe cat and the dog sat. Zebra quiz? The cat sat on the mat."
    out = C.overview("T", text)
    assert out.startswith("# T\n\n") and "Zebra" not in out and out.count("The cat sat on the mat.") == 1
    assert C.overview(None, None) == "#" and C.overview("T", "") == "# T" and C.overview("T", "x " * 9000, most=100) == "# T"
    assert C.overview("T", "same a. same b. same c. same d.") == "# T\n\nsame a. same b. same c."


def test_a_store_with_it(spark, tmp_path):
    session.ship(spark)
    store = DocumentStore(spark, f"file://{tmp_path}", C.central)
    store.ingest(spark.createDataFrame([("A", "/x", "reference", [], "One cat. Two cats. Cat and cat. Three."), ("B", "/x", "reference", [], "")], "title string, hierarchy_path string, doc_type string, tags array<string>, content string"))
    assert {r.title: r.l1_overview for r in store.documents().collect()}["B"] == "# B"
